"""Queries of text operators over whole texts of documents and conversations. Where a hit is needed, a sentence with values of the row stands in the
text; the SQL reads the same texts or computes what the sentence says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions import cleaning as C
from evigraph.functions import text as X
from evigraph.operators import graph as G
from evigraph.operators import records as A
from evigraph.operators import retrieval as Q
from evigraph.plans.catalogue import Tables, query


def _with(t: Tables, *sentence: Column | str) -> DataFrame:
    """(doc_id, t): each document's text, the sentence, and the text again."""
    said = F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in sentence])
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.concat(text, F.lit("\n"), said, F.lit("\n"), text).alias("t"))


@query(
    """SELECT doc_id, '≥' || doc_id % 30 || '.5 × 10⁹/L' AS anc, '≥' || (60 + doc_id % 50) || '000' || CASE WHEN contains((60 + doc_id % 50) || ',000', '10') THEN ' × 10⁹/L' ELSE '/mm³' END AS platelets, '≥' || (30 + doc_id % 40) || ' mL/min' AS crcl,
'≤' || doc_id % 5 || '.5 × ULN' AS bilirubin, '≤' || doc_id % 7 || '.5 × ULN' AS alt_ast FROM documents"""
)
def eligibility_texts(t: Tables) -> DataFrame:
    """The limits that stand somewhere in a whole document."""
    n = F.col("doc_id")
    rows = _with(t, "ANC ≥ ", n % 30, ".5 x 10^9/L; platelets >= ", 60 + n % 50, ",000/mm3; CrCl ≥ ", 30 + n % 40, " mL/min; bilirubin ≤ ", n % 5, ".5 × ULN; ALT ≤ ", n % 7, ".5 x ULN")
    fields = {"anc": "anc_threshold", "platelets": "platelet_threshold", "crcl": "creatinine_clearance", "bilirubin": "bilirubin_threshold", "alt_ast": "alt_ast_threshold"}
    return rows.select("doc_id", *[X.extract_cascade("t", f"eligibility_{f}").alias(name) for name, f in fields.items()])


@query(
    """SELECT doc_id, (10 + doc_id % 50) || ',000 to ' || (70 + doc_id % 20) || ',000 h·ng/mL' AS auc, doc_id % 90 || '.5 μg/mL' AS cmax, (50 + doc_id % 50) || '%' AS binding, (1 + doc_id % 300) || ' L' AS volume, 'UGT1A' || doc_id % 9 AS pathway FROM documents"""
)
def kinetics_texts(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    rows = _with(t, "The AUC rose from ", 10 + n % 50, ",000 to ", 70 + n % 20, ",000 ng·h/mL and mean Cmax was ", n % 90, ".5 μg/mL. Vdss was ", 1 + n % 300, " L and ", 50 + n % 50, "% bound to protein. It is metabolized by UGT1A", n % 9, ".")
    fields = {"auc": "auc_value", "cmax": "cmax_value", "binding": "plasma_protein_binding", "volume": "volume_of_distribution", "pathway": "metabolism_pathway"}
    return rows.select("doc_id", *[X.extract_cascade("t", f).alias(name) for name, f in fields.items()])


_PAGES = """c AS (SELECT source AS doc_id, doc_id AS n, lang, coalesce(text, '') AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
k AS (SELECT *, '# Table ' || n % 40 || chr(10) || x || chr(10) || 'see Table ' || (n * 7) % 60 || ' and section 2.' || n % 6 AS content FROM c),
r AS (SELECT doc_id, i, unnest(list_concat(list_transform(regexp_extract_all(lower(content), 'table\\s*(\\d+[\\-\\.]\\d+|\\d+)', 1), lambda v: 'table ' || v), list_transform(regexp_extract_all(lower(content), 'section\\s*(\\d+[\\.\\d]+)', 1), lambda v: 'section ' || v))) AS ref,
  generate_subscripts(list_concat(regexp_extract_all(lower(content), 'table\\s*(\\d+[\\-\\.]\\d+|\\d+)', 1), regexp_extract_all(lower(content), 'section\\s*(\\d+[\\.\\d]+)', 1)), 1) AS p FROM k),
d AS (SELECT doc_id, i, ref, min(p) AS p FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY p) AS rn FROM d),
h AS (SELECT doc_id, i, unnest(list_concat(list_transform(regexp_extract_all(content, '(?im)^#{1,6}\\s+Table\\s+([\\d.\\-]+)', 1), lambda v: 'table ' || v), list_transform(regexp_extract_all(content, '(?im)^#{1,6}\\s+Section\\s+([\\d.]+)', 1), lambda v: 'section ' || v),
  list_transform(regexp_extract_all(content, '(?m)^#{1,6}\\s+([\\d.]+)\\s', 1), lambda v: 'section ' || rtrim(v, '.')))) AS ref FROM k),
x AS (SELECT doc_id, lower(ref) AS ref, min(i) AS target FROM h GROUP BY ALL)"""


def _pages(t: Tables) -> DataFrame:
    """A source is a document, its documents are its chunks: a table's heading, the whole text, and references."""
    rows = t.documents.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("n"), F.col("lang").alias("section"), F.coalesce("text", F.lit("")).alias("x"), (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).alias("chunk_index"))
    said = F.concat(F.lit("# Table "), F.col("n") % 40, F.lit("\n"), "x", F.lit("\nsee Table "), F.col("n") * 7 % 60, F.lit(" and section 2."), F.col("n") % 6)
    return rows.select("doc_id", "chunk_index", "section", said.alias("content"))


@query(f"WITH {_PAGES} SELECT doc_id, i AS chunk_index, string_agg(ref, ',' ORDER BY p) AS refs FROM d GROUP BY ALL")
def reference_texts(t: Tables) -> DataFrame:
    return _pages(t).select("doc_id", "chunk_index", F.array_join(X.references("content"), ",").alias("refs"))


@query(f"WITH {_PAGES} SELECT doc_id, ref, target FROM x")
def reference_index_texts(t: Tables) -> DataFrame:
    return Q.reference_index(_pages(t)).select("doc_id", "ref", "target")


@query(f"WITH {_PAGES} SELECT DISTINCT o.doc_id, o.i AS chunk_index, target FROM o JOIN x USING (doc_id, ref) WHERE rn <= 2 AND target <> o.i")
def reference_expand_texts(t: Tables) -> DataFrame:
    return Q.expand_references(_pages(t)).select("doc_id", "chunk_index", "target")


@query(f"WITH {_PAGES} SELECT DISTINCT doc_id, ref FROM d ANTI JOIN x USING (doc_id, ref)")
def references_open_texts(t: Tables) -> DataFrame:
    return Q.unresolved(_pages(t)).select("doc_id", "ref")


@query(f"WITH {_PAGES}, s AS (SELECT doc_id, lang, count(*) AS m, min(i) AS a, max(i) AS b FROM c GROUP BY ALL) SELECT doc_id, string_agg(lang || ': ' || m || ' chunks (' || a || '-' || b || ')', chr(10) ORDER BY a) AS summary FROM s GROUP BY doc_id")
def section_lines_texts(t: Tables) -> DataFrame:
    return Q.summary_text(_pages(t)).select("doc_id", "summary")


@query(f"WITH {_PAGES} SELECT DISTINCT a.doc_id, b.i AS chunk_index FROM c a JOIN c b ON a.doc_id = b.doc_id AND abs(a.i - b.i) IN (1, 2) WHERE a.n % 11 = 0")
def chunk_window_texts(t: Tables) -> DataFrame:
    """Two chunks before and after each asked one, without it."""
    c = _pages(t)
    asked = t.documents.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("n"), (F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1).alias("chunk_index")).where("n % 11 = 0").drop("n")
    return Q.adjacent(c, asked, 2).select("doc_id", "chunk_index")


@query(
    """WITH m AS (SELECT conv_id, string_agg('## ' || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id), h AS (SELECT conv_id, regexp_extract_all(chr(10) || t, '\\n(#{1,6})\\s+([^\\n]*)', 1) AS l, regexp_extract_all(chr(10) || t, '\\n(#{1,6})\\s+([^\\n]*)', 2) AS w FROM m)
SELECT conv_id, len(l)::BIGINT AS blocks, list_sum(list_transform(l, lambda x: len(x)))::BIGINT AS levels, array_to_string(list_transform(w, lambda x: trim(x)), '|') AS titles FROM h"""
)
def header_block_texts(t: Tables) -> DataFrame:
    """Whole conversations as one text with a heading for each turn, cut at the headings again."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("x")))).alias("l"))
    texts = turns.select("conv_id", F.array_join(F.transform("l", lambda x: x["x"]), "\n").alias("t"))
    blocks = X.header_blocks(texts, "conv_id", "t")
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "title"))), lambda x: x["title"]), "|")
    return blocks.groupBy("conv_id").agg(F.count("*").alias("blocks"), F.sum("level").cast("long").alias("levels"), titles.alias("titles"))


_WORDS = ["software", "warranty", "report", "stat", "license"]


@query(
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)
SELECT doc_id, array_to_string(list_filter(['license', 'report', 'software', 'stat', 'warranty'], lambda w: regexp_matches(x, '\\b' || w || '\\b')), ',') AS named FROM d WHERE regexp_matches(x, '\\b(license|report|software|stat|warranty)\\b')"""
)
def named_term_texts(t: Tables) -> DataFrame:
    """The words of a vocabulary that whole documents name."""
    found = X.found_terms(t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "t", {"WORD": _WORDS})
    return found.where(F.size("entities") > 0).select("doc_id", F.array_join(F.col("entities")["WORD"], ",").alias("named"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || ' count' ELSE event_type END AS parameter, CASE WHEN event_id % 7 = 0 THEN '' ELSE (1 + event_id % 20)::VARCHAR END AS cycle FROM events")
def parameter_cycle_rows(t: Tables) -> DataFrame:
    n = F.col("event_id")
    name = F.when(n % 4 == 0, F.concat("event_type", F.lit(" count"))).otherwise(F.col("event_type"))
    parameter, cycle = C.parameter_cycle(F.when(n % 7 == 0, name).otherwise(F.concat(F.lit(" "), name, F.lit(" Cycle "), 1 + n % 20, F.lit(" (n="), n, F.lit(")"))))
    return t.events.select("event_id", parameter.alias("parameter"), cycle.alias("cycle"))


@query("SELECT p_partkey, replace(lower(p_type), ' ', '_') || ':' || replace(lower(trim(p_name)), ' ', '_') AS ident FROM part")
def node_id_rows(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", G.node_id(F.col("p_type"), F.col("p_name")).alias("ident"))


@query(
    """WITH a AS (SELECT user_id AS doc_id, event_id, event_type, coalesce(value, 0) AS v, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IN ('signup', 'click')),
f AS (SELECT doc_id, event_id, 'study_metadata' AS key, 'sponsor' AS field, CASE WHEN v < 250 THEN 'Not Found' ELSE 'S' || floor(v / 100)::BIGINT END AS value FROM a WHERE event_type = 'signup'
UNION ALL SELECT doc_id, event_id, 'study_metadata', 'props_k', k FROM a WHERE event_type = 'signup' AND k IS NOT NULL
UNION ALL SELECT doc_id, event_id, 'preclinical_toxicology', 'species', 'Rat' || event_id % 3 FROM a WHERE event_type = 'click'
UNION ALL SELECT doc_id, event_id, 'genotoxicity', 'genotoxicity_in_vitro', 'Negative' FROM a WHERE event_type = 'click' AND v < 100)
SELECT doc_id, key, field, coalesce(arg_min(value, event_id) FILTER (value <> 'Not Found'), min(value)) AS value FROM f GROUP BY ALL"""
)
def record_field_rows(t: Tables) -> DataFrame:
    """Answers made of events, and where each field of them goes in its user's record."""
    n, v, kind = F.col("event_id"), F.coalesce("value", F.lit(0.0)), F.col("event_type")
    signup = F.to_json(F.struct(F.when(v < 250, F.lit("Not Found")).otherwise(F.concat(F.lit("S"), F.floor(v / 100))).alias("sponsor"), F.get_json_object("props", "$.k").alias("props_k")))
    click = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.lit("Rat"), n % 3).alias("species"), F.when(v < 100, F.lit("Negative")).otherwise(F.lit("Not Found")).alias("genotoxicity_in_vitro"))), F.lit("\n```"))
    rows = t.events.where(kind.isin("signup", "click")).select(F.col("user_id").alias("doc_id"), n.alias("chunk_index"), F.when(kind == "signup", "Drug Overview").otherwise("Nonclinical Toxicology").alias("section"), F.when(kind == "signup", signup).otherwise(click).alias("answer"))
    return A.record_fields(rows)


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'error') THEN 'error' WHEN contains(lower(text), 'the') THEN 'The' WHEN contains(lower(text), 'a') THEN 'a' ELSE 'Other' END AS label FROM conversations WHERE length(text) > 20")
def router_label_texts(t: Tables) -> DataFrame:
    return t.conversations.where(F.length("text") > 20).select("conv_id", "turn", X.fuzzy_label("text", ["error", "The", "a"]).alias("label"))
