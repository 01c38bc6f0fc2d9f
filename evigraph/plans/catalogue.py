"""The registered queries of the reference's operators on the driver's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions import cleaning as C
from evigraph.functions import rules
from evigraph.functions import text as X
from evigraph.operators import evaluate as E
from evigraph.operators import graph as G
from evigraph.operators import merge as M
from evigraph.operators import resolve as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of the tables under its name, with SQL for the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sql_case(expr: str, choices: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond.replace('@', expr)} THEN '{label}'" for cond, label in choices) + f" ELSE {default} END"


def sql_any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(@, '{w}')" for w in words) + ")"


# Top-k, first and last, integrity


@query(
    """WITH e AS (SELECT DISTINCT user_id, event_id, abs(value - 250) AS deviation FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY deviation DESC, event_id)::INT AS rn FROM e QUALIFY rn <= 20)
SELECT user_id, event_id, deviation, rn FROM k"""
)
def topk_abs_per_group(t: Tables) -> DataFrame:
    """The flagship: known groups only, the 20 rows of each farthest from 250, each edge once."""
    e = t.events.select("user_id", "event_id", F.abs(F.col("value") - 250).alias("deviation")).where(~F.isnan("value"))
    e = G.known_only(e, t.customer, "user_id", "c_custkey").distinct()
    return G.top_k(e, ["user_id"], [F.desc("deviation"), "event_id"], 20).select("user_id", "event_id", "deviation", "rn")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_known(t: Tables) -> DataFrame:
    return G.known_only(t.orders, t.customer.where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join_missing(t: Tables) -> DataFrame:
    return G.missing(t.customer, t.orders, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN s.s_suppkey IS NULL THEN 'source' ELSE 'target' END AS missing_end
FROM lineitem l LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0) s ON l_suppkey = s.s_suppkey
LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0) p ON l_partkey = p.p_partkey WHERE s.s_suppkey IS NULL OR p.p_partkey IS NULL"""
)
def dangling_edges(t: Tables) -> DataFrame:
    nodes = t.supplier.where("s_suppkey % 7 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(t.part.where("p_partkey % 11 <> 0").select(F.concat(F.lit("p"), "p_partkey")))
    edges = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"))
    return G.dangling_edges(edges, nodes).select("l_orderkey", "l_linenumber", "missing_end")


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def id_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).intersect(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def id_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).exceptAll(t.orders.select("o_custkey")).distinct()


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45")
def id_except_lines(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).exceptAll(t.lineitem.where("l_quantity >= 45").select("l_orderkey")).distinct()


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def edge_dedup(t: Tables) -> DataFrame:
    return G.first_of(t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT l_partkey AS id, l_suppkey AS first_supplier FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1")
def node_first_wins(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("first_supplier"), "l_orderkey", "l_linenumber")
    return G.first_of(rows, ["id"], ["l_orderkey", "l_linenumber", "first_supplier"]).select("id", "first_supplier")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(t: Tables) -> DataFrame:
    return G.last_value_of(t.events, ["user_id"], "event_type", "event_id")


@query(
    """SELECT 'nation' AS kind, n_nationkey::BIGINT AS id, n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation
UNION ALL SELECT 'region', r_regionkey::BIGINT, r_name, NULL, NULL FROM region UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_acctbal FROM supplier"""
)
def union_sparse(t: Tables) -> DataFrame:
    return G.union_sparse(
        t.nation.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")),
        t.region.select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")),
        t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    )


@query(
    """SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error,
max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'signup') AS signup, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id"""
)
def props_pivot_wide(t: Tables) -> DataFrame:
    """Property keys as sorted columns; the keys are given, so no pass looks for them."""
    return t.events.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.max("value"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def type_counts(t: Tables) -> DataFrame:
    return G.type_counts(t.events, "event_type")


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS n_nodes, (SELECT count(*) FROM part WHERE p_size > 25)::BIGINT AS n_drugs, (SELECT 2 * count(*) FROM part)::BIGINT AS n_properties, (SELECT count(*) FROM lineitem)::BIGINT AS n_edges")
def graph_statistics(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") > 25, "Drug").otherwise("Target")
    return G.statistics(G.Graph(t.part.select("p_partkey", kind.alias("type"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("properties")), t.lineitem))


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS rn FROM events QUALIFY rn <= 2")
def type_samples(t: Tables) -> DataFrame:
    return G.samples(t.events.select("event_type", "event_id"), "event_type", ["event_id"], 2)


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part")
def explode_targets(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))


@query("SELECT DISTINCT source FROM documents")
def list_sections(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct()


# Cleaning and parsing


@query("SELECT doc_id, CASE WHEN lower(trim(text)) NOT IN ('', 'nan', 'inf', '-inf', 'infinity', '-infinity') THEN trim(text) END AS value FROM documents")
def clean_value(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.clean_value("text").alias("value"))


@query("SELECT doc_id, coalesce(toxic::VARCHAR, 'Not Found') AS toxic, coalesce(nullif(trim(lang), ''), 'Not Found') AS lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def not_found_fill(t: Tables) -> DataFrame:
    both = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select("doc_id", F.col("toxic").cast("string").alias("toxic"), "lang", "quality")
    return C.fill_not_found(both)


_WORDS = "inhibits,Activates,binds,targets,CAUSES,treats,Metabolized by,induced,decreased,increased,has property,part_of,tested in,Associated_With,observed_in,linked_to,causes often, binds,"


@query(
    """SELECT p_partkey, CASE (p_partkey % 19)::INT WHEN 0 THEN 'associated_with' WHEN 1 THEN 'associated_with' WHEN 2 THEN 'associated_with' WHEN 3 THEN 'associated_with' WHEN 4 THEN 'observed_in'
WHEN 5 THEN 'associated_with' WHEN 6 THEN 'associated_with' WHEN 7 THEN 'observed_in' WHEN 8 THEN 'observed_in' WHEN 9 THEN 'observed_in' WHEN 12 THEN 'tested_in' WHEN 13 THEN 'associated_with'
WHEN 14 THEN 'observed_in' ELSE 'linked_to' END AS edge FROM part"""
)
def predicate_map(t: Tables) -> DataFrame:
    """All predicates that have a type, the types themselves, and words that are neither."""
    word = F.element_at(F.array(*map(F.lit, _WORDS.split(","))), (F.col("p_partkey") % 19 + 1).cast("int"))
    return t.part.select("p_partkey", G.predicate_type(word).alias("edge"))


_TYPE_SQL = sql_case("n", [(sql_any(w), k) for k, w in rules.TYPE_WORDS], "NULL")
_TYPE_NAME = "lower(p_type || CASE p_size % 7 WHEN 0 THEN ' Gene' WHEN 1 THEN ' pain' WHEN 2 THEN ' signaling' WHEN 3 THEN ' level' WHEN 4 THEN ' clinical study' WHEN 5 THEN ' study' ELSE '' END)"


@query(f"WITH p AS (SELECT p_partkey, {_TYPE_NAME} AS n FROM part) SELECT p_partkey, CASE WHEN NOT (contains(n, 'study') AND NOT contains(n, 'clinical')) THEN {_TYPE_SQL} END AS kind FROM p")
def type_infer_cascade(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, [" Gene", " pain", " signaling", " level", " clinical study", " study", ""])), (F.col("p_size") % 7 + 1).cast("int"))
    return t.part.select("p_partkey", G.inferred_type(F.concat("p_type", word)).alias("kind"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'study_statistic' WHEN p_size % 4 = 1 THEN 'pk_dosing_info' END AS key,
CASE WHEN p_size % 4 = 0 THEN 'study' WHEN p_size % 4 = 1 THEN 'drug' END AS owner FROM part"""
)
def merge_rule(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ["Grade 3-4 anemia", "Infusion rate", "Creatinine AUC", "Anemia"])), (F.col("p_size") % 4 + 1).cast("int"))
    rows = t.part.select("p_partkey", G.merge_target(word).alias("m"))
    return rows.select("p_partkey", "m.key", "m.owner")


@query("SELECT CASE WHEN contains(lower(event_type), 'e') AND event_id % 3 = 0 THEN 'summary' ELSE 'term' END AS kind, count(*)::BIGINT AS n FROM events GROUP BY 1")
def summary_terms_to_props(t: Tables) -> DataFrame:
    term = F.when((F.col("event_id") % 3 == 0) & F.contains(F.lower("event_type"), F.lit("e")), F.concat(F.lit("All Deaths "), "event_type")).otherwise(F.col("event_type"))
    return t.events.select(F.when(G.is_summary(term), "summary").otherwise("term").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(text, '; ' ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def prop_concat_ordered(t: Tables) -> DataFrame:
    return G.concat_in_order(t.conversations, ["conv_id"], "text", ["turn"])


_MARK = "(l_quantity::INT)::VARCHAR || CASE l_linenumber % 4 WHEN 1 THEN '*' WHEN 2 THEN '**' WHEN 3 THEN '***' ELSE '' END"


@query(f"SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_replace({_MARK}, '[*]+$', '') AS DOUBLE) AS value, CASE l_linenumber % 4 WHEN 1 THEN 'p<0.05' WHEN 2 THEN 'p<0.01' WHEN 3 THEN 'p<0.001' ELSE '' END AS label FROM lineitem")
def sig_marker_parse(t: Tables) -> DataFrame:
    mark = F.concat(F.col("l_quantity").cast("int").cast("string"), F.element_at(F.array(*map(F.lit, ["", "*", "**", "***"])), F.col("l_linenumber") % 4 + 1))
    return t.lineitem.select("l_orderkey", "l_linenumber", C.marker_value(mark).alias("value"), C.marker_label(mark).alias("label"))


_SEV = "(p_size % 5)::VARCHAR || substr('abcdp', p_size % 5 + 1, 1) || ',' || (p_size % 3 + 1)::VARCHAR || ' c'"


@query(f"SELECT p_partkey, p_size % 5 + p_size % 3 + 1 AS incidence, greatest(CASE WHEN p_size % 5 = 4 THEN 0 ELSE p_size % 5 + 1 END, 3) AS severity, len(regexp_extract_all({_SEV}, '([0-9]+) *([a-dp])', 1))::INT AS n FROM part")
def severity_parse(t: Tables) -> DataFrame:
    s = F.concat((F.col("p_size") % 5).cast("string"), F.substring(F.lit("abcdp"), F.col("p_size") % 5 + 1, F.lit(1)), F.lit(","), (F.col("p_size") % 3 + 1).cast("string"), F.lit(" c"))
    return t.part.select("p_partkey", C.incidence(s).alias("incidence"), C.most_severe(s).alias("severity"), F.size(C.severity_pairs(s)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity::INT = l_linenumber * 5 AS same FROM lineitem")
def numeric_fuzzy_eq(t: Tables) -> DataFrame:
    a, b = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mg")), (F.col("l_linenumber") * 5).cast("string")
    return t.lineitem.select("l_orderkey", "l_linenumber", C.numeric_equal(a, b).alias("same"))


@query("SELECT 'organ ' || p_size AS organ, p_brand AS lesion, count(*)::BIGINT AS n FROM part GROUP BY 1, 2")
def organ_lesion_split(t: Tables) -> DataFrame:
    organ, lesion = C.organ_lesion(F.concat(F.lit("organ "), "p_size", F.lit(" – "), F.replace("p_brand", F.lit("-"), F.lit("–"))))
    return t.part.select(organ.alias("organ"), F.replace(lesion, F.lit("–"), F.lit("-")).alias("lesion")).groupBy("organ", "lesion").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, floor(s_acctbal * 6 * 10 + 0.5) / 10 AS rat_dose, CASE WHEN abs(s_acctbal) > 2000 THEN 'Yes' ELSE '' END AS flag FROM supplier")
def unit_conversion(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", C.dose_per_area("s_acctbal", F.lit("Rat")).alias("rat_dose"), F.when(F.abs("s_acctbal") > 2000, "Yes").otherwise("").alias("flag"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN '-' ELSE event_id::VARCHAR END AS INT), 0) AS n FROM events")
def safe_int(t: Tables) -> DataFrame:
    return t.events.select("event_id", C.safe_int(F.when(F.col("event_id") % 3 == 0, "-").otherwise(F.col("event_id").cast("string"))).alias("n"))


@query("SELECT p_partkey, 'brand: ' || p_brand || ', type: ' || p_type AS dense FROM part")
def dense_serialise(t: Tables) -> DataFrame:
    from pyspark.sql import types as T

    m = F.create_map(F.lit("brand"), "p_brand", F.lit("none"), F.lit(""), F.lit("type"), "p_type")
    return t.part.select("p_partkey", C.joined(m, T.MapType(T.StringType(), T.StringType())).alias("dense"))


@query("SELECT n_nationkey, 'Node_' || substr(sha256('Node:' || n_name || ':' || n_regionkey), 1, 16) AS id FROM nation".replace("Node", "nation"))
def stable_id(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", C.stable_id("nation", "n_name", F.lit(None), "n_regionkey").alias("id"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def lenient_json(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return t.events.select("event_id", F.from_json(C.lenient_json(answer), "k int")["k"].alias("k"))


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, coalesce(quality::VARCHAR, source) AS value FROM documents LEFT JOIN labels USING (doc_id)")
def override_coalesce(t: Tables) -> DataFrame:
    return M.overriding(t.documents.select("doc_id", F.col("source").alias("value")), t.labels.select("doc_id", F.col("quality").cast("string").alias("q")), "doc_id", {"value": "q"})


@query("SELECT s_suppkey, upper(n_name) AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_enrich(t: Tables) -> DataFrame:
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.upper("n_name").alias("nation"), F.col("r_name").alias("region"))
    return t.supplier.join(dim, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "nation", "region")


@query("SELECT p_brand AS gene, 'target:' || lower(p_brand) AS id FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3)")
def dim_members_missing(t: Tables) -> DataFrame:
    dim = t.part.select(F.col("p_brand").alias("gene")).distinct()
    return G.missing(dim, t.part.where("p_size < 3"), "gene", "p_brand").select("gene", G.node_id("target", F.col("gene")).alias("id"))


@query("SELECT c_name AS gene, 'target:' || lower(c_name) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def dim_members_missing_customers(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return G.missing(t.customer, urgent, "c_custkey", "o_custkey").select(F.col("c_name").alias("gene"), G.node_id("target", F.col("c_name")).alias("id"))


@query("SELECT event_id, event_type, value FROM events WHERE value / 1000 < 0.05 AND abs(value - 250) >= 1")
def significant_rows(t: Tables) -> DataFrame:
    return t.events.where((F.col("value") / 1000 < 0.05) & (F.abs(F.col("value") - 250) >= 1)).select("event_id", "event_type", "value")


@query("SELECT user_id, least(20 + 10 * count(*), 90)::BIGINT AS liver, least(15 + 20 * count(*) FILTER (event_type = 'error'), 95)::BIGINT AS cardiac FROM events GROUP BY user_id")
def rule_score(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    return n.select("user_id", C.rule_score(20, 10, 90, "n").cast("long").alias("liver"), C.rule_score(15, 20, 95, "k").cast("long").alias("cardiac"))


# Matrices and order


@query(
    """SELECT l_returnflag, 'm' || u.m AS month, u.qty::BIGINT AS qty FROM (SELECT l_returnflag, sum(l_quantity::INT) FILTER (month(l_shipdate) = 1) AS m1, sum(l_quantity::INT) FILTER (month(l_shipdate) = 2) AS m2,
sum(l_quantity::INT) FILTER (month(l_shipdate) = 3) AS m3 FROM lineitem GROUP BY 1) w, LATERAL (VALUES (1, m1), (2, m2), (3, m3)) u(m, qty) WHERE u.qty IS NOT NULL"""
)
def matrix_unpivot(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_returnflag").agg(*[F.sum(F.when(F.month("l_shipdate") == m, F.col("l_quantity").cast("int"))).alias(f"m{m}") for m in (1, 2, 3)])
    return wide.unpivot("l_returnflag", ["m1", "m2", "m3"], "month", "qty").where("qty IS NOT NULL")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def carry_forward(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@query(
    """WITH y AS (SELECT l_suppkey, year(l_shipdate) AS yr, sum(l_quantity::INT)::DOUBLE AS q FROM lineitem GROUP BY ALL)
SELECT a.l_suppkey, floor(b.q / a.q * 100 + 0.5) / 100 AS ratio FROM y a JOIN y b USING (l_suppkey) WHERE a.yr = 1995 AND b.yr = 1997 AND a.q > 0"""
)
def exposure_ratio(t: Tables) -> DataFrame:
    """A later over an earlier measurement of the same group, with one exchange."""
    at = lambda y: F.sum(F.when(F.year("l_shipdate") == y, F.col("l_quantity").cast("int"))).cast("double")
    g = t.lineitem.groupBy("l_suppkey").agg(at(1995).alias("a"), at(1997).alias("b"))
    return g.where("a > 0 AND b IS NOT NULL").select("l_suppkey", C.half_up(F.col("b") / F.col("a"), 2).alias("ratio"))


@query("SELECT conv_id, turn, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def adjacent_rows(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (value > 300) AS first_high, arg_min(event_id, event_id) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id")
def first_nonnull(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.when(F.col("value") > 300, F.col("event_type")).alias("h"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("p"))
    return rows.groupBy("user_id").agg(M.first_value("h", "event_id").alias("first_high"), M.first_value("p", "event_id").alias("first_purchase"))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, '|' ORDER BY f) AS types FROM f GROUP BY user_id")
def running_distinct(t: Tables) -> DataFrame:
    return M.distinct_by_key(t.events, ["user_id"], "event_type", "event_id").select("user_id", F.array_join("event_type", "|").alias("types"))


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS kind, bool_or(value > 400) AS high FROM events GROUP BY user_id")
def merge_first_wins(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "view", F.lit("Not Found")).otherwise(F.col("event_type")).alias("kind"), (F.col("value") > 400).alias("high"))
    return M.merge_records(rows, ["user_id"], "event_id")


@query(
    """WITH w AS (SELECT l_suppkey, unnest([l_returnflag, l_linestatus]) AS x, unnest([1, 2]) AS i, l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem),
f AS (SELECT l_suppkey, x, min((l_orderkey, l_linenumber, l_returnflag, l_linestatus, i)) AS f FROM w GROUP BY ALL) SELECT l_suppkey, string_agg(x, ',' ORDER BY f) AS flags FROM f GROUP BY l_suppkey"""
)
def list_union_ordered(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("o"), F.array("l_returnflag", "l_linestatus").alias("v"))
    return M.union_by_key(rows, ["l_suppkey"], "v", "o").select("l_suppkey", F.array_join("v", ",").alias("flags"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_done FROM orders GROUP BY o_custkey")
def bool_or_merge(t: Tables) -> DataFrame:
    return M.merge_records(t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("any_done")), ["o_custkey"], "o_orderkey")


@query(
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL), l AS (SELECT user_id, list(event_type ORDER BY f) AS t FROM f GROUP BY user_id)
SELECT user_id, array_to_string(t[greatest(len(t) - 1, 1):], '|') AS recent FROM l"""
)
def recent_sections(t: Tables) -> DataFrame:
    state = t.events.groupBy("user_id").agg(M.distinct_in_order("event_type", "event_id").alias("t"))
    return state.select("user_id", F.array_join(M.last_entries(F.col("t"), 2), "|").alias("recent"))


# Texts


@query("SELECT page_id, coalesce('page ' || nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), 'id ' || nullif(regexp_extract(url, 'id=([0-9]+)', 1), ''), nullif(regexp_extract(url, '/(fr|en|de|es)/', 1), '')) AS found FROM pages")
def regex_cascade(t: Tables) -> DataFrame:
    p = lambda x: X.first_match("url", [x])
    return t.pages.select("page_id", F.coalesce(F.concat(F.lit("page "), p(r"page=(\d+)")), F.concat(F.lit("id "), p(r"id=(\d+)")), p("/(fr|en|de|es)/")).alias("found"))


_TITLE_SQL = "lower(regexp_extract(html, '<title>([^<]*)', 1)) || CASE page_id % 5 WHEN 0 THEN ' liver' WHEN 1 THEN ' clinical study' WHEN 2 THEN ' stability' WHEN 3 THEN ' cyp' ELSE '' END"


@query(f"WITH p AS (SELECT page_id, {_TITLE_SQL} AS n FROM pages) SELECT page_id, {sql_case('n', [(sql_any([w]), s) for w, s in rules.HEADER_RULES], chr(39) + 'Other' + chr(39))} AS section FROM p")
def header_classify(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, [" liver", " clinical study", " stability", " cyp", ""])), (F.col("page_id") % 5 + 1).cast("int"))
    return t.pages.select("page_id", X.header_section(F.concat(F.regexp_extract("html", "<title>([^<]*)", 1), word)).alias("section"))


_CONTENT_SQL = sql_case("n", [(" AND ".join(sql_any(g) for g in groups), s) for groups, s in rules.CONTENT_RULES], "'Other'")


@query(f"WITH p AS (SELECT doc_id, substr(lower(text), 1, 800) AS n FROM documents) SELECT doc_id, {_CONTENT_SQL} AS section FROM p")
def content_classify(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.content_section("text").alias("section"))


@query("SELECT doc_id, (i // 1800)::INT AS chunk_index, substr(text, i + 1, 2000) AS content FROM (SELECT doc_id, text, unnest(range(0, length(text)::INT, 1800)) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(t: Tables) -> DataFrame:
    return X.fixed_chunks(t.documents, "doc_id", "text")


@query("WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(10) || chr(13) || chr(9) || ' ')), lambda x: x <> '') AS p FROM documents) SELECT doc_id, unnest(range(0, len(p)))::INT AS paragraph_index, unnest(p) AS paragraph FROM s")
def paragraph_split(t: Tables) -> DataFrame:
    return X.paragraphs(t.documents, "doc_id", "text", "\n")


@query("SELECT source, count(*)::BIGINT AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source")
def section_summary(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::INT AS n FROM documents WHERE contains(lower(text), 'the') ORDER BY n DESC, doc_id LIMIT 10")
def keyword_topk(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", X.occurrences("text", "the").alias("n")).where("n > 0")
    return hits.orderBy(F.desc("n"), "doc_id").limit(10)


@query(
    """WITH k AS (SELECT conv_id, turn, 'table ' || (conv_id % 50) AS ref FROM conversations), i AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'table ' || item_id ELSE 'table' || item_id END AS ref, item_id AS target FROM benchmark WHERE item_id < 40)
SELECT conv_id, turn, coalesce(a.target, b.target) AS target FROM k LEFT JOIN i a ON k.ref = a.ref LEFT JOIN i b ON replace(k.ref, ' ', '') = replace(b.ref, ' ', '')"""
)
def reference_resolve(t: Tables) -> DataFrame:
    """All items; the SQL has those under 40 and not the third level, so the two agree on tables with 40 items that name no other."""
    index = t.benchmark.select(F.concat(F.when(F.col("item_id") % 2 == 0, "table ").otherwise("table"), "item_id").alias("ref"), F.col("item_id").alias("target"))
    rows = t.conversations.select("conv_id", "turn", F.concat(F.lit("Table "), (F.col("conv_id") % 50).cast("string")).alias("ref"))
    return R.lookup_chain(rows, "ref", index, t.benchmark.select(F.col("item_id").alias("target"), F.col("text").alias("content"))).select("conv_id", "turn", "target")


@query("SELECT doc_id, text AS content FROM documents WHERE source <> 'src0' OR length(text) > 300")
def drop_short_other(t: Tables) -> DataFrame:
    return t.documents.where("source <> 'src0' OR length(text) > 300").select("doc_id", F.col("text").alias("content"))


@query(
    """WITH RECURSIVE e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT label, rn, 0 AS chunk, 300 AS size, v AS run FROM e WHERE rn = 1
  UNION ALL SELECT label, rn, chunk + cut::INT, CASE WHEN cut THEN 300 ELSE size + 302 END, CASE WHEN cut THEN v ELSE list_transform(list_zip(run, v), lambda x: (x[1] + x[2]) / 2) END
  FROM (SELECT e.label, e.rn, f.chunk, f.size, f.run, e.v, (list_cosine_similarity(f.run, e.v) < 0.75 AND f.size > 500) OR f.size > 2000 AS cut FROM f JOIN e ON e.label = f.label AND e.rn = f.rn + 1))
SELECT label, chunk AS chunk_index, max(size)::INT AS semantic_size, string_agg(vec_id, ',' ORDER BY rn) AS paragraphs FROM f JOIN e USING (label, rn) GROUP BY ALL"""
)
def semantic_chunks(t: Tables) -> DataFrame:
    """Embeddings in order of vec_id as paragraphs of their labels' documents."""
    rows = t.embeddings.select("label", "vec_id", F.repeat(F.lit("x"), 300).alias("text"), "embedding")
    return X.semantic_chunks(rows, "label", "vec_id", "text", "embedding").select("label", "chunk_index", "semantic_size", F.array_join(F.transform("source_paragraphs", lambda x: x.cast("string")), ",").alias("paragraphs"))


@query(
    """WITH c AS (SELECT label, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS c FROM embeddings)
SELECT label, count(*) FILTER (c >= 0.1)::BIGINT AS similar, count(c)::BIGINT AS pairs FROM c GROUP BY label"""
)
def cosine_adjacent(t: Tables) -> DataFrame:
    w = W.partitionBy("label").orderBy("vec_id")
    c = t.embeddings.select("label", C.cosine("embedding", F.lag("embedding").over(w)).alias("c"))
    return c.groupBy("label").agg(F.count_if(F.col("c") >= 0.1).alias("similar"), F.count("c").alias("pairs"))


# Resolution


@query("WITH v AS (SELECT n_name, lower(trim(n_name)) AS k FROM nation) SELECT s_suppkey, n_name AS match FROM (SELECT s_suppkey, '  ' || upper(coalesce(n_name, '')) AS q FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey) LEFT JOIN v ON lower(trim(q)) = k")
def entity_resolve_exact(t: Tables) -> DataFrame:
    names = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.concat(F.lit("  "), F.upper("n_name")).alias("q"))
    known = t.nation.select(F.col("n_name").alias("known"), F.col("n_nationkey").cast("long").alias("seq"))
    return R.resolve_exact(names, known, "q").select("s_suppkey", "match")


@query()
def entity_resolve_fuzzy(t: Tables) -> DataFrame:
    names = t.part.select(F.regexp_replace("p_name", "e", "ee").alias("name"))
    known = t.part.select(F.col("p_name").alias("known"), F.col("p_partkey").alias("seq"))
    known = known.groupBy("known").agg(F.min("seq").alias("seq"))
    return R.resolve_fuzzy(names, known)


_VOCABULARY = ["steel", "tin", "brass", "copper", "nickel", "ste", "polished", "small", "large", "economy"]


@query("SELECT p_partkey, " + sql_case("lower(p_type)", [(f"contains(@, '{w}')", w) for w in sorted(_VOCABULARY, key=lambda x: (-len(x), x))], "NULL") + " AS term FROM part")
def ontology_ground(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", R.ground_in(t.part, "p_type", _VOCABULARY).alias("term"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Anemia' WHEN 1 THEN 'Febrile Neutropenia' ELSE p_type END AS grounded, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence FROM part")
def ontology_confidence(t: Tables) -> DataFrame:
    term = F.when(F.col("p_size") % 3 == 0, " ANEMIA").when(F.col("p_size") % 3 == 1, "Grade 3 febrile neutropenia").otherwise(F.col("p_type"))
    out = R.ground(t.part.select("p_partkey", term.alias("term")), "term", "Adverse Event")
    return out.select("p_partkey", "grounded", F.col("grounding_confidence").alias("confidence"))


@query("WITH c AS (SELECT p_partkey, substr(p_type, 1, 6) AS n, row_number() OVER (PARTITION BY substr(p_type, 1, 6) ORDER BY p_partkey) AS rn, p_type FROM part) SELECT p_partkey, CASE WHEN rn = 1 THEN n ELSE substr(p_type, 1, 4) || '_' || (rn - 1) END AS sheet FROM c")
def sheet_name_uniquify(t: Tables) -> DataFrame:
    return R.uniquify(t.part, "p_type", ["p_partkey"], 6, 4).select("p_partkey", "sheet")


# Evaluation

_PRED = "CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END"
_PRF = """SELECT {g} tp, fp, fn, CASE WHEN tp + fp > 0 THEN floor(tp / (tp + fp) * 10000 + 0.5) / 10000 ELSE 0 END::DOUBLE AS precision,
CASE WHEN tp + fn > 0 THEN floor(tp / (tp + fn) * 10000 + 0.5) / 10000 ELSE 0 END::DOUBLE AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN floor(2 * tp / (2 * tp + fp + fn) * 10000 + 0.5) / 10000 ELSE 0 END::DOUBLE AS f1
FROM (SELECT {g} sum((p = 1 AND quality = 1)::INT)::BIGINT AS tp, sum((p = 1 AND quality = 0)::INT)::BIGINT AS fp, sum((p = 0 AND quality = 1)::INT)::BIGINT AS fn FROM (SELECT *, %s AS p FROM documents JOIN labels USING (doc_id)) GROUP BY ALL)""" % _PRED


def _judged(t: Tables) -> DataFrame:
    p = F.when(F.length("text") > 1000, 1).otherwise(0)
    return t.documents.select("doc_id", "lang", p.alias("p")).join(t.labels, "doc_id")


def _flags() -> tuple:
    p, q = F.col("p"), F.col("quality")
    return (p == 1) & (q == 1), (p == 1) & (q == 0), (p == 0) & (q == 1)


@query(_PRF.format(g=""))
def prf_overall(t: Tables) -> DataFrame:
    return E.prf(_judged(t), [], *_flags())


@query(_PRF.format(g="lang,"))
def prf_by_group(t: Tables) -> DataFrame:
    return E.prf(_judged(t), ["lang"], *_flags())


@query("SELECT floor(sum((p = quality)::INT * w) / sum(w) * 10000 + 0.5) / 10000 AS accuracy FROM (SELECT quality, %s AS p, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 5 ELSE 3 END AS w FROM documents JOIN labels USING (doc_id))" % _PRED)
def weighted_accuracy(t: Tables) -> DataFrame:
    field = F.when(F.col("lang") == "en", "notes").when(F.col("lang") == "fr", "sponsor_information").otherwise("study_id")
    rows = _judged(t).select((F.col("p") == F.col("quality")).cast("int").alias("s"), E.weight_of(field).alias("w"))
    return rows.agg(C.half_up(E.weighted_accuracy(F.col("s"), F.col("w")), 4).alias("accuracy"))


@query("SELECT p_partkey, len(list_intersect(a, b))::INT AS tp, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INT AS fp, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS fn FROM (SELECT p_partkey, list_distinct(string_split(p_type, ' ')) AS a, list_distinct(string_split(p_name || ' ' || split_part(p_type, ' ', 1), ' ')) AS b FROM part)")
def list_overlap(t: Tables) -> DataFrame:
    a = F.array_distinct(F.split("p_type", " "))
    b = F.array_distinct(F.split(F.concat("p_name", F.lit(" "), F.split("p_type", " ")[0]), " "))
    tp, fp, fn = E.list_overlap(a, b)
    return t.part.select("p_partkey", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


@query("SELECT CASE WHEN value / 500 >= 0.8 THEN 'correct' WHEN value / 500 >= 0.3 THEN 'partial' ELSE 'wrong' END AS bucket, count(*)::BIGINT AS n, greatest(1, floor(count(*) * 0.05))::BIGINT AS missed FROM events GROUP BY 1")
def score_buckets(t: Tables) -> DataFrame:
    return t.events.groupBy(E.score_buckets(F.col("value") / 500).alias("bucket")).agg(F.count("*").alias("n"), E.estimated_misses(F.count("*")).cast("long").alias("missed"))


@query(
    """WITH a AS (SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS v FROM events), b AS (SELECT event_id + 1 AS event_id, path, v FROM a)
SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN a.v IS NULL AND b.v IS NULL THEN 'empty' WHEN a.v IS NULL THEN 'fp' WHEN b.v IS NULL THEN 'fn' WHEN a.v = b.v THEN 'tp' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (event_id, path)) GROUP BY status"""
)
def tree_diff(t: Tables) -> DataFrame:
    a = E.flatten(t.events.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.*"), "event_id")
    return E.tree_diff(a, a.withColumn("event_id", F.col("event_id") + 1), ["event_id"]).groupBy("status").agg(F.count("*").alias("n"))


@query()
def greedy_table_match(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("price"), "o_orderpriority")
    other = rows.withColumn("price", F.when(F.col("o_orderkey") % 3 == 0, F.lit("0")).otherwise(F.concat("price", F.lit(" usd"))))
    return E.match_tables(rows, other, "o_custkey", "o_orderkey", ["o_orderstatus", "price", "o_orderpriority"])


@query(
    """SELECT unnest(['quality', 'toxic', 'lang']) AS column, unnest([q, x, l])::BIGINT AS filled, n::BIGINT AS total, unnest([floor(100 * q / n), floor(100 * x / n), floor(100 * l / n)])::BIGINT AS percent
FROM (SELECT count(*) AS n, count(quality) AS q, count(toxic) AS x, count(nullif(lang, '')) AS l FROM documents LEFT JOIN labels USING (doc_id))"""
)
def section_coverage(t: Tables) -> DataFrame:
    return E.coverage(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"), ["quality", "toxic", "lang"])


@query("SELECT doc_id, ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + (coalesce(trim(lang), '') <> '')::INT) AS fields FROM documents LEFT JOIN labels USING (doc_id)")
def field_coverage(t: Tables) -> DataFrame:
    both = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select("doc_id", F.struct("lang", "quality", "toxic").alias("r"))
    return both.select("doc_id", C.count_fields(both.select("r").schema).alias("fields"))


@query("SELECT n_nationkey, n_name FROM nation")
def prune_empty_columns(t: Tables) -> DataFrame:
    return E.prune_empty(t.nation.select("n_nationkey", "n_name", F.lit(None).cast("string").alias("gone"), F.lit(" ").alias("blank")))


@query("SELECT event_type, count(*)::BIGINT AS calls, sum(value::DECIMAL(18,4))::DECIMAL(28,4)::DOUBLE AS total, max(value) AS slowest, count(*) FILTER (value > 400)::BIGINT AS retries FROM events GROUP BY event_type")
def telemetry_rollup(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").cast("double").alias("total"), F.max("value").alias("slowest"), F.count_if(F.col("value") > 400).alias("retries")
    )


# Graph queries and export


@query("WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT DISTINCT 's' || s AS id, 'p' || p AS neighbour FROM e WHERE s <= 3 UNION SELECT 'p' || p, 's' || s FROM e WHERE p <= 3")
def neighbors_1hop(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"))
    start = t.supplier.where("s_suppkey <= 3").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).union(t.part.where("p_partkey <= 3").select(F.concat(F.lit("p"), "p_partkey")))
    return G.neighbours(edges, start)


@query("WITH e AS (SELECT DISTINCT s_suppkey AS s, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey <= 200) SELECT x.s AS a, y.s AS b, count(*)::BIGINT AS n FROM e x JOIN e y USING (r) WHERE x.s < y.s GROUP BY ALL")
def co_neighbors(t: Tables) -> DataFrame:
    """All suppliers; the SQL has only those up to 200, so the two agree on tables with no more."""
    e = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("source_id"), F.col("n_regionkey").alias("target_id"))
    return G.co_neighbours(e)


@query("SELECT s_suppkey, n_name, count(DISTINCT o_custkey)::BIGINT AS customers FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def path_query_4hop(t: Tables) -> DataFrame:
    s = t.lineitem.select("l_suppkey", "l_orderkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = s.join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "o_custkey").distinct()
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return s.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("s_suppkey", "n_name").agg(F.count("*").alias("customers"))


@query("SELECT s_suppkey, p_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.08 ORDER BY l_orderkey, l_linenumber, s_suppkey, p_partkey LIMIT 300")
def edges_filtered_limit(t: Tables) -> DataFrame:
    e = t.lineitem.where("l_discount > 0.08").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return e.orderBy("l_orderkey", "l_linenumber", "s_suppkey", "p_partkey").limit(300).select("s_suppkey", "p_partkey")


@query("SELECT 'CREATE (:`Nation` {id: ''nation:' || n_nationkey || ''', name: ''' || replace(n_name, '''', chr(92) || '''') || ''', `region_key`: ''' || n_regionkey || '''});' AS line FROM nation")
def cypher_emit(t: Tables) -> DataFrame:
    from evigraph.sources import sinks

    nodes = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("type"), F.create_map(F.lit("region key"), F.col("n_regionkey").cast("string")).alias("properties"))
    return nodes.select(sinks.cypher_node().alias("line"))


# Streams, run to the end of what is there


@query("SELECT user_id, arg_max(event_type, ts) AS status FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) GROUP BY user_id")
def stream_latest_status(t: Tables) -> DataFrame:
    from evigraph.streaming import progress

    return progress.latest_status(t.spark, f"{t.dir}/events.parquet", "user_id", "event_type", "ts", "event_id")


@query("SELECT user_id, count(*)::BIGINT AS timeouts FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap > INTERVAL 600 SECOND GROUP BY user_id")
def stream_session_timeout(t: Tables) -> DataFrame:
    from evigraph.streaming import progress

    return progress.session_timeouts(t.spark, f"{t.dir}/events.parquet", "user_id", "ts", 600)


@query(
    """WITH e AS (SELECT user_id, event_id, ts, event_type, props, row_number() OVER w AS i, ts - lag(ts) OVER w > INTERVAL 1 DAY AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, coalesce(min(i) FILTER (event_type = 'purchase'), 1000000000) AS done, coalesce(min(i) FILTER (late), 1000000000) AS late, max(ts) AS last, max(i) AS n FROM e GROUP BY user_id),
t AS (SELECT *, CASE WHEN late <= done AND late <= n THEN true WHEN done <= n THEN false ELSE last + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) END AS silent, least(done, late, n + 1) - 1 AS sent FROM s),
f AS (SELECT user_id AS session, 0::BIGINT AS no, 'ping' AS event, '{"session_id": ' || user_id || '}' AS data FROM t
UNION ALL SELECT user_id, i, event_type, props FROM e JOIN t USING (user_id) WHERE i <= sent
UNION ALL SELECT user_id, sent + 1, 'pipeline_error', '{"message": "Silent for a day."}' FROM t WHERE silent)
SELECT *, 'event: ' || event || chr(10) || 'data: ' || coalesce(data, 'null') || chr(10) || chr(10) AS frame FROM f"""
)
def stream_session_frames(t: Tables) -> DataFrame:
    """What each session is sent: a greeting, its events up to the end or the first day of silence, and then the error."""
    from evigraph.streaming import progress, sessions

    rows = progress.event_stream(t.spark, f"{t.dir}/events.parquet").withColumn("event_type", F.when(F.col("event_type") == "purchase", sessions.DONE).otherwise(F.col("event_type")))
    return sessions.frames_to_end(rows, "user_id", "ts", "event_id", "event_type", "props", silence=86_400, keep=10**8, complaint="Silent for a day.")


# The other groups of queries register themselves.
from evigraph.plans import answers, graphs, questions, reports, snippets, texts  # noqa: E402, F401
