"""Queries of records from answers, judged rates, run totals and matrix slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.operators import context, nested
from evigraph.operators import records as A
from evigraph.plans.catalogue import Tables, query

_ANSWERS = [
    ("Drug Overview", '```json\n{"sponsor": "Not Found", "phase": null, "drug": "Belix"}\n```'),
    ("Nonclinical Toxicology", '{"species": "Rat", "genotoxicity_in_vitro": "Negative", "genotoxicity_in_vivo": "Not Found", "carcinogenicity_results": "Not Found"}'),
    ("Other", 'Here it is: {"free": 3, "semantic_relationships": [{"subject": "a", "predicate": "binds", "object": "b"}]}'),
    ("Drug Overview", '{"sponsor": "S", "phase": "2", "drug": "other", "semantic_relationships": {"relationships": [{"subject": "c", "predicate": "causes", "object": "d", "confidence": "High"}]}}'),
    ("Safety and Adverse Events", "no answer"),
    ("Cardiac Safety", '{"qtc": {"max": 450}}'),
]


def _answers(t: Tables) -> DataFrame:
    both = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(a).alias("answer")) for s, a in _ANSWERS])
    # dealt by document while they are only keys, so what is gathered by document and field later stays where it is
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id")).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return docs.select("doc_id", F.posexplode(both).alias("chunk_index", "a")).select("doc_id", "chunk_index", "a.*")


@query(
    """SELECT DISTINCT o_orderkey AS doc_id, key, field, value FROM orders, (VALUES ('study_metadata', 'sponsor', 'S'), ('study_metadata', 'phase', '2'), ('study_metadata', 'drug', 'Belix'), ('preclinical_toxicology', 'species', 'Rat'),
('genotoxicity', 'genotoxicity_in_vitro', 'Negative'), ('genotoxicity', 'genotoxicity_in_vivo', 'Not Found'), ('', 'free', '3'), ('safety_data', 'qtc', '{"max":450}')) v(key, field, value)"""
)
def record_fields(t: Tables) -> DataFrame:
    return A.record_fields(_answers(t))


@query("SELECT DISTINCT o_orderkey AS doc_id, c AS chunk_index, s AS subject, p AS predicate, o AS object, f AS confidence FROM orders, (VALUES (2, 'a', 'binds', 'b', NULL), (3, 'c', 'causes', 'd', 'High')) v(c, s, p, o, f)")
def answer_statements(t: Tables) -> DataFrame:
    return A.statements(_answers(t)).drop("place")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Safety and Adverse Events' WHEN 2 THEN 'Nonclinical Toxicology' WHEN 3 THEN 'Drug Overview' ELSE 'Other' END AS module FROM part")
def section_modules(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ["Deaths and Serious Adverse Events", "Cardiac Safety", "Genotoxicity", "Drug Overview", "Hepatotoxicity"]))
    rows = t.part.select("p_partkey", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("s"))
    return rows.select("p_partkey", A.asked_as("s", ["Safety and Adverse Events", "Nonclinical Toxicology", "Drug Overview"]).alias("module"))


@query(
    """WITH j AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'hallucination' ELSE 'faithfulness' END AS task, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 7 <> 0 THEN 0.75 END AS score FROM events)
SELECT user_id, coalesce(round(count(*) FILTER (task = 'hallucination' AND score = 0)::DOUBLE / nullif(count(score) FILTER (task = 'hallucination'), 0), 3), 0) AS hallucination_rate,
coalesce(round(sum(CASE WHEN score > 0 THEN 75 ELSE 0 END) FILTER (task = 'faithfulness' AND score IS NOT NULL)::DOUBLE / (100 * nullif(count(score) FILTER (task = 'faithfulness'), 0)), 3), 1) AS faithfulness FROM j GROUP BY user_id"""
)
def judge_rates(t: Tables) -> DataFrame:
    n = F.col("event_id")
    rows = t.events.select("user_id", F.when(n % 2 == 0, "hallucination").otherwise("faithfulness").alias("task"), F.when(n % 3 == 0, F.lit(0.0)).when(n % 7 != 0, F.lit(0.75)).alias("score"))
    return A.judge_rates(rows, "user_id")


_TOTALS = "SELECT user_id AS run, count(*)::BIGINT AS chunks, sum(event_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 10)::BIGINT AS completion_tokens, sum(event_id % 100 + event_id % 10)::BIGINT AS total_tokens, sum(event_id % 3)::BIGINT AS retries, count(*) FILTER (event_type = 'error')::BIGINT AS errors, (sum(event_id % 8) / 8)::DOUBLE AS latency FROM events GROUP BY user_id"


def _telemetry(t: Tables) -> DataFrame:
    n = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("run"), (n % 100).alias("prompt_tokens"), (n % 10).alias("completion_tokens"), (n % 100 + n % 10).alias("total_tokens"), (n % 3).alias("retry_count"),
        F.when(F.col("event_type") == "error", "e").alias("error"), (n % 8 / 8.0).cast("double").alias("latency_seconds"),
    )


@query(_TOTALS)
def run_totals(t: Tables) -> DataFrame:
    return A.run_totals(_telemetry(t))


@query(
    f"""WITH t AS ({_TOTALS}) SELECT run, 'Run Summary (' || run || '):' || chr(10) || '- Duration: ' || latency || 's' || chr(10) || '- Prompt Tokens: ' || prompt_tokens || chr(10) || '- Completion Tokens: ' || completion_tokens
|| chr(10) || '- Total Tokens: ' || total_tokens AS summary FROM t"""
)
def run_summaries(t: Tables) -> DataFrame:
    return A.run_lines(A.run_totals(_telemetry(t)))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def named_members(t: Tables) -> DataFrame:
    return A.members(t.customer, "c_mktsegment", ["Building", "machinery"]).select("c_custkey", "c_mktsegment")


@query("SELECT DISTINCT 'P' || a.s_suppkey % 11 AS prefix FROM supplier a JOIN nation b ON a.s_suppkey % 11 = b.n_nationkey % 13")
def plate_prefixes(t: Tables) -> DataFrame:
    a = t.supplier.select(F.concat(F.lit("P"), F.col("s_suppkey") % 11, F.lit("_A_"), "s_suppkey").alias("id"))
    return A.common_prefixes(a, "id", t.nation.select(F.concat(F.lit("P"), F.col("n_nationkey") % 13, F.lit("_B")).alias("id")), "id")


@query("SELECT l_partkey AS row, l_suppkey AS col, l_quantity AS value FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def matrix_columns(t: Tables) -> DataFrame:
    """A long matrix read for the columns of chosen samples; ids that it lacks are asked for as well."""
    cells = t.lineitem.select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("value"))
    wanted = t.supplier.where("s_nationkey < 12").select("s_suppkey").union(t.nation.select((F.col("n_nationkey") + 10**9).cast("long")))
    return A.matrix_columns(cells, wanted, "col", "s_suppkey").select("row", "col", "value")


_TEXT = T.StringType()
_RECORD = T.StructType([
    T.StructField("study_metadata", T.StructType([T.StructField("sponsor", _TEXT, metadata={"default": "not asked"}), T.StructField("protocol_ids", T.ArrayType(_TEXT))])),
    T.StructField("safety_data", T.StructType([T.StructField("adverse_events", T.ArrayType(T.StructType([T.StructField("term", _TEXT), T.StructField("grade", T.LongType())]))), T.StructField("serious", T.BooleanType()), T.StructField("deaths", T.LongType())])),
    T.StructField("preclinical_toxicology", T.StructType([T.StructField("species", _TEXT)])),
    T.StructField("genotoxicity", T.StructType([T.StructField("genotoxicity_in_vitro", _TEXT)])),
])


@query(
    """WITH e AS (SELECT *, coalesce(value, 0) AS v FROM events), u AS (SELECT DISTINCT user_id FROM events),
p AS (SELECT user_id, x, min((event_id, i)) AS f FROM (SELECT user_id, event_id, unnest(['P' || event_id % 3, 'P' || event_id % 5]) AS x, unnest([0, 1]) AS i FROM e WHERE event_type = 'signup') GROUP BY ALL),
a AS (SELECT user_id, 'T' || event_id % 4 || ':' || event_id % 3 AS x, min(event_id) AS f FROM e WHERE event_type = 'error' GROUP BY ALL),
s AS (SELECT user_id, coalesce(arg_min('S' || floor(v / 100)::BIGINT, event_id) FILTER (v >= 250), max('Not Found'), 'not asked') AS sponsor FROM (SELECT * FROM e WHERE event_type = 'signup') GROUP BY user_id),
d AS (SELECT user_id, arg_min(CASE event_type WHEN 'error' THEN event_id % 50 ELSE event_id % 7 END, event_id)::BIGINT AS deaths FROM e WHERE event_type IN ('error', 'view') GROUP BY user_id),
c AS (SELECT user_id, bool_or(v > 400) FILTER (event_type = 'error') AS serious, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'Rat' END AS species, CASE WHEN count(*) FILTER (event_type = 'click' AND v < 100) > 0 THEN 'Negative' END AS in_vitro,
  arg_min(json_extract_string(props, '$.k'), event_id) FILTER (event_type = 'view' AND json_extract_string(props, '$.k') IS NOT NULL) AS other FROM e GROUP BY user_id)
SELECT u.user_id AS doc_id, coalesce(sponsor, 'not asked') AS sponsor, coalesce((SELECT string_agg(x, ',' ORDER BY f) FROM p WHERE p.user_id = u.user_id), '') AS protocol_ids, coalesce((SELECT string_agg(x, ',' ORDER BY f) FROM a WHERE a.user_id = u.user_id), '') AS adverse_events,
serious, deaths, species, in_vitro, other FROM u JOIN c USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN d USING (user_id)"""
)
def nested_records(t: Tables) -> DataFrame:
    """Each event is an answer about a section of its user's record: lists united, flags and first values merged, defaults, and what the schema lacks."""
    n, v, kind = F.col("event_id"), F.coalesce("value", F.lit(0.0)), F.col("event_type")
    p = lambda k: F.concat(F.lit("P"), n % k)
    signup = F.to_json(F.struct(F.when(v < 250, F.lit("Not Found")).otherwise(F.concat(F.lit("S"), F.floor(v / 100))).alias("sponsor"), F.array(p(3), p(5)).alias("protocol_ids")))
    error = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("T"), n % 4).alias("term"), (n % 3).alias("grade"))).alias("adverse_events"), (v > 400).alias("serious"), (n % 50).alias("deaths")))
    click = F.to_json(F.struct(F.lit("Rat").alias("species"), F.when(v < 100, F.lit("Negative")).otherwise(F.lit("Not Found")).alias("genotoxicity_in_vitro")))
    view = F.concat(F.lit('Found this:\n```json\n{"safety_data": {"deaths": '), n % 7, F.lit('}, "props": '), F.coalesce("props", F.lit("null")), F.lit("}\n```"))
    section = F.when(kind == "signup", "Drug Overview").when(kind == "error", "Safety and Adverse Events").when(kind == "click", "Nonclinical Toxicology").otherwise("Other")
    answer = F.when(kind == "signup", signup).when(kind == "error", error).when(kind == "click", click).when(kind == "view", view).otherwise("nothing found")
    got = nested.nested_records(t.events.select(F.col("user_id").alias("doc_id"), n.alias("chunk_index"), section.alias("section"), answer.alias("answer")), _RECORD)
    r = F.col("record")
    events = F.transform(r["safety_data"]["adverse_events"], lambda x: F.concat(x["term"], F.lit(":"), x["grade"]))
    return got.select(
        "doc_id", r["study_metadata"]["sponsor"].alias("sponsor"), F.array_join(r["study_metadata"]["protocol_ids"], ",").alias("protocol_ids"), F.array_join(events, ",").alias("adverse_events"), r["safety_data"]["serious"].alias("serious"),
        r["safety_data"]["deaths"].alias("deaths"), r["preclinical_toxicology"]["species"].alias("species"), r["genotoxicity"]["genotoxicity_in_vitro"].alias("in_vitro"), F.col("other")["props.k"].alias("other"),
    )


_SAID = """e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'Safety and Adverse Events' WHEN 'signup' THEN 'Drug Overview' WHEN 'view' THEN 'Dosing Regimen' WHEN 'purchase' THEN 'Efficacy Outcomes' ELSE 'Other' END AS section,
CASE event_type WHEN 'click' THEN 'adverse_event' WHEN 'signup' THEN 'study_id' WHEN 'view' THEN 'dose_level' WHEN 'purchase' THEN 'orr' END AS field,
CASE event_type WHEN 'click' THEN 'AE' || event_id % 13 WHEN 'signup' THEN 'S' || event_id % 4 WHEN 'view' THEN event_id % 9 || ' mg' WHEN 'purchase' THEN event_id % 100 || '%' END AS said FROM events),
l AS (SELECT user_id, field, said, min(event_id) AS since FROM e WHERE field IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY since) AS rn FROM l)"""


def _facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(sections, facts): each event is a section of its user's document, and most say something."""
    n, kind = F.col("event_id"), F.col("event_type")
    section = F.when(kind == "click", "Safety and Adverse Events").when(kind == "signup", "Drug Overview").when(kind == "view", "Dosing Regimen").when(kind == "purchase", "Efficacy Outcomes").otherwise("Other")
    field = F.when(kind == "click", "adverse_event").when(kind == "signup", "study_id").when(kind == "view", "dose_level").when(kind == "purchase", "orr")
    said = F.when(kind == "click", F.concat(F.lit("AE"), n % 13)).when(kind == "signup", F.concat(F.lit("S"), n % 4)).when(kind == "view", F.concat((n % 9).cast("string"), F.lit(" mg"))).when(kind == "purchase", F.concat((n % 100).cast("string"), F.lit("%")))
    rows = t.events.select(F.col("user_id").alias("doc_id"), n.alias("at"), section.alias("section"), field.alias("field"), said.alias("value"))
    return rows.select("doc_id", "at", "section"), rows.where("field IS NOT NULL")


@query(
    f"""WITH {_SAID}, d AS (SELECT user_id, section, min(event_id) AS since FROM e GROUP BY ALL)
SELECT user_id AS doc_id, event_id AS at, section, 'Drug: Belix (class unknown)' || chr(10) || 'Studies so far: ' || coalesce((SELECT string_agg(said, ', ' ORDER BY since) FROM l WHERE l.user_id = e.user_id AND l.field = 'study_id' AND since < event_id), 'none yet')
|| CASE WHEN section LIKE 'Safety%' THEN coalesce(chr(10) || 'Adverse events so far: ' || (SELECT string_agg(said, ', ' ORDER BY since) FROM o WHERE o.user_id = e.user_id AND o.field = 'adverse_event' AND since < event_id AND rn <= 10), '') ELSE '' END
|| CASE WHEN section LIKE 'Safety%' OR section LIKE 'Dosing%' THEN coalesce(chr(10) || 'Confirmed Dose: ' || (SELECT max(said) FROM o WHERE o.user_id = e.user_id AND o.field = 'dose_level' AND rn = 1 AND since < event_id), '') ELSE '' END
|| CASE WHEN section LIKE 'Efficacy%' THEN coalesce(chr(10) || 'Confirmed Response rate: ' || (SELECT max(said) FROM o WHERE o.user_id = e.user_id AND o.field = 'orr' AND rn = 1 AND since < event_id), '') ELSE '' END
|| coalesce(chr(10) || 'Sections done: ' || (SELECT string_agg(section, ', ' ORDER BY since) FROM d WHERE d.user_id = e.user_id AND since < event_id), '') AS context FROM e"""
)
def running_context(t: Tables) -> DataFrame:
    """What each section of a document is told of the sections before it."""
    return context.running_context(*_facts(t), "Belix")


@query(
    f"""WITH {_SAID}, r AS (SELECT user_id, CASE field WHEN 'dose_level' THEN 1 WHEN 'orr' THEN 2 ELSE rn + 2 END AS rank, field = 'adverse_event' AS event, CASE field WHEN 'adverse_event' THEN '"' || said || '"' ELSE '"' || field || '":"' || said || '"' END AS x
FROM o WHERE field = 'adverse_event' AND rn <= 20 OR field IN ('dose_level', 'orr') AND rn = 1),
s AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY user_id ORDER BY rank) AS size FROM r QUALIFY size + 22 <= 100),
g AS (SELECT user_id, string_agg(x, ',' ORDER BY rank) FILTER (NOT event) AS p, string_agg(x, ',' ORDER BY rank) FILTER (event) AS v, count(*)::BIGINT AS n FROM s GROUP BY user_id)
SELECT u.user_id AS doc_id, CASE WHEN n IS NULL THEN '{{"fallback":true}}' ELSE '{{' || coalesce(p, '') || CASE WHEN p IS NOT NULL AND v IS NOT NULL THEN ',' ELSE '' END || coalesce('"adverse_events":[' || v || ']', '') || '}}' END AS digest, coalesce(n, 0) AS entries
FROM (SELECT DISTINCT user_id FROM e WHERE field IS NOT NULL) u LEFT JOIN g USING (user_id)"""
)
def fact_digests(t: Tables) -> DataFrame:
    """A document's facts as an object of at most 100 characters."""
    return context.digests(_facts(t)[1], ["dose_level", "orr"], budget=100)
