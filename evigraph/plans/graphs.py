"""Queries of the graph builders: a nation is a document of the strict graph, suppliers are signatures of the harmonized one."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators import builder as B
from evigraph.operators import graph as G
from evigraph.operators import harmonize as H
from evigraph.plans.catalogue import Tables, query

_TERMS = ["anemia", "Grade 3 Anemia", "All TEAEs", "Rash", "febrile neutropenia", "Odd finding", "Deaths", "Nausea and vomiting"]
_TERM_SQL = """(VALUES (0, 'anemia', 'Anemia', 1.0), (1, 'Grade 3 Anemia', 'Anemia', 0.8), (2, 'All TEAEs', NULL, NULL), (3, 'Rash', 'Rash', 1.0), (4, 'febrile neutropenia', 'Febrile Neutropenia', 1.0),
(5, 'Odd finding', 'Odd finding', 0.3), (6, 'Deaths', NULL, NULL), (7, 'Nausea and vomiting', 'Vomiting', 0.8)) t(k, term, grounded, conf)"""
_STATEMENTS = [
    ("Belix", "inhibits", "HDAC"),
    ("belix", "Observed in", "Anemia"),
    ("Belix", "caused by", "Renal toxicity"),
    ("Belix", "has_dose", "100 mg"),
    ("Belix", "causes", "Unheard of"),
    ("HDACs", "part of", "Belix"),
    ("Belix", "tested_in", "Study treatment arm"),
]
_KIND = "struct<subject:string,predicate:string,object:string,confidence:string>"


def _pick(values: list, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _records(t: Tables, statements: bool = False) -> DataFrame:
    """A record of each nation: its customers are adverse events, its region decides the rest."""
    event = F.struct(
        F.col("c_custkey").alias("o"), _pick(_TERMS, F.col("c_custkey")).alias("adverse_event_preferred_term"), F.when(F.col("c_custkey") % 3 == 0, "10%").alias("grade_3_4_ae_frequency"),
        F.lit("20%").alias("all_grades_frequency"), (F.col("c_custkey") % 2 == 0).alias("serious_adverse_event_flag"),
    )
    events = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(event)).alias("adverse_events"))
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    said = [F.when((n + i) % 2 == 0, F.struct(*[F.lit(v).alias(k) for k, v in zip(("subject", "predicate", "object"), s)], F.lit(None).cast("string").alias("confidence"))) for i, s in enumerate(_STATEMENTS)]
    said = F.array_compact(F.array(*said)) if statements else F.array().cast(f"array<{_KIND}>")
    text = lambda c: c.cast("string")
    return t.nation.join(events, "n_nationkey", "left").select(
        n.cast("long").alias("doc_id"),
        F.struct(F.when(n % 5 != 0, F.array(F.concat(F.lit("CLN-"), text(n)))).alias("study_identifiers"), F.concat(F.lit("Phase "), text(r)).alias("study_phase"), F.lit(None).cast("string").alias("study_status"), F.col("n_name").alias("sponsor_information")).alias("study_metadata"),
        F.struct("adverse_events").alias("safety_data"),
        F.struct(*[(F.when(r > i, F.concat(text(r), F.lit(" U/L"))) if i < 2 else F.lit("")).alias(f) for i, (_, f) in enumerate(B.BIOMARKERS)]).alias("pharmacokinetics"),
        F.struct(F.when(r == 1, F.array(F.lit("Rat"))).when(r > 1, F.array(F.lit("Rat"), F.lit("Dog"))).alias("toxicity_species")).alias("preclinical_toxicology"),
        F.struct(F.array(F.lit("hdac"), F.when(r == 2, "hdac1"), F.lit("Unlisted")).alias("molecular_targets")).alias("mechanism_of_action"),
        F.struct(said.alias("relationships")).alias("semantic_relationships"),
    )


_BASE = f"""d AS (SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 5 = 0 THEN 'unknown_study' ELSE 'CLN-' || n_nationkey END AS sid, n_regionkey AS r, n_name FROM nation),
a AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey, term, grounded, conf FROM customer JOIN {_TERM_SQL} ON c_custkey % 8 = k),
f AS (SELECT doc_id, grounded, arg_min(term, c_custkey) AS term, arg_min(conf, c_custkey) AS conf FROM a WHERE grounded IS NOT NULL GROUP BY ALL),
tg AS (SELECT doc_id, unnest(CASE WHEN r = 2 THEN ['HDAC', 'HDAC1', 'Unlisted'] ELSE ['HDAC', 'Unlisted'] END) AS t FROM d),
sp AS (SELECT doc_id, unnest(CASE WHEN r = 1 THEN ['Rat'] WHEN r > 1 THEN ['Rat', 'Dog'] ELSE [] END) AS s FROM d),
b AS (SELECT doc_id, n, r || ' U/L' AS v FROM d, (VALUES (0, 'ALP'), (1, 'ALT')) x(i, n) WHERE r > i)"""


@query(
    f"""WITH {_BASE}
SELECT doc_id, 'study:' || sid AS id, sid AS name, 'Clinical Study' AS type, 'Phase ' || r AS said, (SELECT arg_max(CASE WHEN c_custkey % 3 = 0 THEN '10%' ELSE '20%' END, c_custkey) FROM a WHERE a.doc_id = d.doc_id AND term = 'All TEAEs') AS sums FROM d
UNION ALL SELECT doc_id, 'drug:belix', 'Belix', 'Drug', 'Small Molecule', NULL FROM d
UNION ALL SELECT doc_id, 'ae:' || replace(lower(grounded), ' ', '_'), grounded, 'Adverse Event', term, NULL FROM f
UNION ALL SELECT doc_id, 'biomarker:' || lower(n), n, 'Biomarker', v, NULL FROM b
UNION ALL SELECT doc_id, 'animal_study:' || lower(s), s || ' Toxicity Study', 'Animal Study', s, NULL FROM sp
UNION ALL SELECT doc_id, 'target:' || lower(t), t, 'Target', CASE WHEN t = 'Unlisted' THEN '0.4' ELSE '1.0' END, NULL FROM tg"""
)
def strict_nodes(t: Tables) -> DataFrame:
    """Metadata, adverse events, biomarkers, animal studies and targets of each document."""
    p = F.col("properties")
    said = F.coalesce(p["phase"], p["original_term"], p["value"], p["species"], p["ontology_confidence"], p["type"])
    return B.build(_records(t), "Belix").nodes.select("doc_id", "id", "name", "type", said.alias("said"), p["All TEAEs"].alias("sums"))


@query(
    f"""WITH {_BASE}, e AS (SELECT a.doc_id, 'ae:' || replace(lower(grounded), ' ', '_') AS id, 'study:' || sid AS study FROM a JOIN d USING (doc_id) WHERE grounded IS NOT NULL), x AS (
SELECT doc_id, 'drug:belix' AS source_id, 'study:' || sid AS target_id, 'tested_in' AS type FROM d
UNION ALL SELECT doc_id, id, study, 'observed_in' FROM e UNION ALL SELECT doc_id, 'drug:belix', id, 'observed_in' FROM e
UNION ALL SELECT doc_id, 'biomarker:' || lower(n), 'study:' || sid, 'observed_in' FROM b JOIN d USING (doc_id)
UNION ALL SELECT doc_id, 'drug:belix', 'animal_study:' || lower(s), 'tested_in' FROM sp
UNION ALL SELECT doc_id, 'drug:belix', 'target:' || lower(t), 'associated_with' FROM tg)
SELECT *, count(*)::BIGINT AS n FROM x GROUP BY ALL"""
)
def strict_edges(t: Tables) -> DataFrame:
    return B.build(_records(t), "Belix").edges.groupBy("doc_id", "source_id", "target_id", "type").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT n_nationkey::BIGINT AS doc_id, v.* EXCLUDE (i) FROM nation, (VALUES (0, 'drug:belix', 'inhibits', 'target:hdac', 'associated_with'), (1, 'drug:belix', 'Observed in', 'ae:anemia', 'observed_in'),
(2, 'drug:belix', 'caused by', 'adverse_event:renal_toxicity', 'linked_to'), (5, 'target:hdac', 'part of', 'drug:belix', 'linked_to')) v(i, source_id, said, target_id, type) WHERE (n_nationkey + i) % 2 = 0)
SELECT * FROM s WHERE target_id <> 'ae:anemia' OR doc_id IN (SELECT c_nationkey FROM customer WHERE c_custkey % 8 < 2)"""
)
def statement_edges(t: Tables) -> DataFrame:
    """Statements over the names of their document: exact, by letters, new ones, numbers and parts of the study."""
    e = B.build(_records(t, True), "Belix").edges.where(F.col("properties")["source"] == B.STATEMENT_SOURCE)
    return e.select("doc_id", "source_id", F.col("properties")["original_predicate"].alias("said"), "target_id", "type")


@query(
    """SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 2 = 1 THEN '100 mg' END AS dose, CASE WHEN n_nationkey % 2 = 0 THEN 'Study treatment arm' END AS study_statistic FROM nation"""
)
def statement_properties(t: Tables) -> DataFrame:
    nodes = B.build(_records(t, True), "Belix").nodes.where("type IN ('Drug', 'Clinical Study')")
    return nodes.groupBy("doc_id").agg(F.max(F.col("properties")["dose"]).alias("dose"), F.max(F.col("properties")["study_statistic"]).alias("study_statistic"))


_SPELLINGS = ["Renal toxicity", "renal Toxicity", "Renal toxicities", "Hepatic pain", "Hepatic pains", "Unheard of", "HDACs", "hepatic pain"]


def _mentions(t: Tables) -> DataFrame:
    """Each customer is a statement of its nation: names that few letters part, and the doses and remarks said of them."""
    k = F.col("c_custkey")
    said = F.struct(k.alias("o"), _pick(_SPELLINGS, k).alias("subject"), F.when(k % 3 == 0, "has_dose").otherwise("causes").alias("predicate"), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" mg"))).when(k % 3 == 1, _pick(_SPELLINGS, F.floor(k / 8))).otherwise(F.concat(F.lit("Study treatment "), k)).alias("object"), F.lit(None).cast("string").alias("confidence"))
    rows = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(said)).alias("relationships"))
    return _records(t).drop("semantic_relationships").join(rows, "doc_id").withColumn("semantic_relationships", F.struct(F.transform("relationships", lambda r: r.dropFields("o")).alias("relationships"))).drop("relationships")


_MENTIONS = """s AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey AS k, list_value('Renal toxicity', 'renal Toxicity', 'Renal toxicities', 'Hepatic pain', 'Hepatic pains', 'Unheard of', 'HDACs', 'hepatic pain') AS w FROM customer),
m AS (SELECT doc_id, k, 0 AS side, w[k % 8 + 1] AS name FROM s WHERE k % 3 <> 2 UNION ALL SELECT doc_id, k, 1, w[(k // 8) % 8 + 1] FROM s WHERE k % 3 = 1),
n AS (SELECT *, CASE lower(name[1]) WHEN 'r' THEN 'r' WHEN 'u' THEN 'u' ELSE CASE WHEN name = 'HDACs' THEN 't' ELSE 'h' END END AS kin FROM m),
f AS (SELECT doc_id, kin, arg_min(name, k * 2 + side) AS lead, min(k * 2 + side) AS since FROM n WHERE name <> 'Renal toxicities' GROUP BY ALL),
g AS (SELECT n.doc_id, k, side, CASE n.kin WHEN 't' THEN 'target:hdac' WHEN 'u' THEN NULL ELSE CASE WHEN since <= k * 2 + side THEN 'adverse_event:' || replace(lower(lead), ' ', '_') END END AS id FROM n LEFT JOIN f ON f.doc_id = n.doc_id AND f.kin = n.kin)"""


@query(
    f"""WITH {_MENTIONS}
SELECT a.doc_id, a.id AS source_id, b.id AS target_id, count(*)::BIGINT AS n FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.k = b.k AND a.side = 0 AND b.side = 1
WHERE a.id IS NOT NULL AND b.id IS NOT NULL GROUP BY ALL"""
)
def names_in_turn(t: Tables) -> DataFrame:
    """New names of a document become known in the order of its statements, so of several spellings the first gives the node; one that
    names no kind of node is nothing until a spelling of it is known."""
    e = B.build(_mentions(t), "Belix").edges.where(F.col("properties")["source"] == B.STATEMENT_SOURCE)
    return e.groupBy("doc_id", "source_id", "target_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_MENTIONS}, d AS (SELECT doc_id, id, max(k) AS k FROM g WHERE side = 0 AND k % 3 = 0 AND id IS NOT NULL GROUP BY ALL), o AS (SELECT doc_id, string_agg('Study treatment ' || k, '; ' ORDER BY k) AS v FROM s WHERE k % 3 = 2 GROUP BY ALL)
SELECT doc_id, id, 'dose' AS key, k || ' mg' AS value FROM d
UNION ALL SELECT doc_id, 'study:' || CASE WHEN doc_id % 5 = 0 THEN 'unknown_study' ELSE 'CLN-' || doc_id END, 'study_statistic', v FROM o"""
)
def properties_in_turn(t: Tables) -> DataFrame:
    """Of numbers said of one node the last stays; remarks on the study are put one behind the other."""
    nodes = B.build(_mentions(t), "Belix").nodes.select("doc_id", "id", F.explode("properties").alias("key", "value"))
    return nodes.where("key IN ('dose', 'study_statistic')")


def _expression(t: Tables) -> DataFrame:
    genes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("symbol")) for i, g in enumerate(("HDAC", "egfr gene", "XYZ", "HDACs"))])).alias("g")
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("doc_id"), genes).select("doc_id", "g.*")
    n = F.col("doc_id") + F.col("i")
    return rows.where("i < 3").select("doc_id", "symbol", ((n - 12) / 4).alias("log2fc"), F.when(n % 3 == 0, 0.2).otherwise(0.01).alias("p_value"), F.lit(0.05).alias("padj"))


_OVERLAY = "SELECT n_nationkey::BIGINT AS doc_id, id, (n_nationkey + i - 12) / 4 AS fc FROM nation, (VALUES (0, 'target:hdac'), (1, 'target:egfr_gene')) v(i, id) WHERE (n_nationkey + i) % 3 <> 0"


@query(f"WITH o AS ({_OVERLAY}) SELECT doc_id, id, fc AS log2fc, abs(fc) > 1 AS linked FROM o")
def expression_overlay(t: Tables) -> DataFrame:
    """Significant genes as properties of their nodes; strong ones with an edge from the drug."""
    g = B.build(_records(t), "Belix", _expression(t))
    edges = g.edges.where(F.col("properties")["source"] == "Transcriptomics_Analysis").select("doc_id", F.col("target_id").alias("id"), F.lit(True).alias("linked"))
    nodes = g.nodes.select("doc_id", "id", F.col("properties")["log2fc"].cast("double").alias("log2fc")).where("log2fc IS NOT NULL")
    return nodes.join(edges, ["doc_id", "id"], "left").select("doc_id", "id", "log2fc", F.coalesce("linked", F.lit(False)).alias("linked"))


@query(
    """WITH g AS (SELECT n_nationkey::BIGINT AS doc_id, n_regionkey AS r, 'HDAC' || i AS gene FROM nation, range(1, 12) x(i))
SELECT doc_id, 'target:' || lower(gene) AS id, r = 2 AND gene = 'HDAC1' AS was_there, count(*) OVER (PARTITION BY doc_id)::BIGINT AS genes FROM g"""
)
def gene_places(t: Tables) -> DataFrame:
    """The eleven genes of each document with their places: those that were there and those added with an edge."""
    from pyspark.sql import Window as W

    g = B.enrich_genes(B.build(_records(t), "Belix"), "Belix")
    added = g.edges.where("type = 'inhibits'").select("doc_id", F.col("target_id").alias("id"), F.lit(False).alias("was_there"))
    placed = g.nodes.where(F.col("properties")["chromosome"].isNotNull()).select("doc_id", "id")
    return placed.join(added, ["doc_id", "id"], "left").select("doc_id", "id", F.coalesce("was_there", F.lit(True)).alias("was_there"), F.count("*").over(W.partitionBy("doc_id")).alias("genes"))


@lru_cache(maxsize=1)
def _region_names() -> list[str]:
    return ["Liver", " nan ", "Kidney", "Blood", ""]


def _harmonized(t: Tables) -> H.Harmonized:
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    meta = t.supplier.select(
        F.concat(F.lit("SIG_"), text(k)).alias("SignatureId"), F.concat(F.lit("Drug"), text(n)).alias("Perturbagen"), F.when(n % 3 != 0, F.concat(F.lit("HDAC|T"), text(n))).alias("GeneTargets"),
        F.concat(F.lit("CL"), text(n % 7)).alias("CellLine"), _pick(_region_names(), n % 7).alias("Tissue"), k.alias("row"),
        *[none.alias(c) for c in ("lincspertid", "perturbagenID", "pubChemID", "stitchID", "Concentration", "Time", "factor", "is_exemplar")],
    )
    expression = t.lineitem.select(F.concat(F.lit("SIG_"), text(F.col("l_suppkey") * 2)).alias("signatureID"), F.concat(F.lit("G"), text(F.col("l_partkey") % 500)).alias("Name_GeneSymbol"), F.col("l_extendedprice").alias("Value_LogDiffExp"), F.col("l_discount").alias("Significance_pvalue"))
    info = t.region.select(F.concat(F.lit("Region_"), text(F.col("r_regionkey") % 3)).alias("key"), F.col("r_name").alias("value"), F.col("r_regionkey").alias("row"))
    safety = t.nation.select(F.when(F.col("n_nationkey") % 6 != 0, F.col("n_name")).alias("term"), *[none.alias(c) for c in ("percent", "grade_3_4", "sae", "teae")], F.col("n_nationkey").alias("row"))
    return H.harmonize("Belix", meta, expression, info, safety)


_SIGNATURES = """s AS (SELECT s_suppkey AS k, 'SIG_' || s_suppkey AS sig, 'Drug' || s_nationkey AS drug, 'CL' || s_nationkey % 7 AS cl, ['liver', NULL, 'kidney', 'blood', NULL][(s_nationkey % 7) % 5 + 1] AS tissue, s_nationkey AS n FROM supplier),
g AS (SELECT 'SIG_' || l_suppkey * 2 AS sig, 'G' || l_partkey % 500 AS gene FROM lineitem WHERE l_suppkey * 2 IN (SELECT k FROM s)
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, 'G' || l_partkey % 500) <= 20),
m AS (SELECT arg_max(drug, k) AS drug FROM s)"""


@query(
    f"""WITH {_SIGNATURES}, x AS (SELECT drug AS id, 'Drug' AS type FROM s UNION SELECT sig, 'Transcriptomic_Signature' FROM s UNION SELECT cl, 'CellLine' FROM s UNION SELECT tissue, 'Tissue' FROM s
UNION SELECT 'Target_HDAC', 'Target' FROM s WHERE n % 3 <> 0 UNION SELECT 'Target_T' || n, 'Target' FROM s WHERE n % 3 <> 0 UNION SELECT 'AdverseEvent_' || replace(n_name, ' ', '_'), 'AdverseEvent' FROM nation WHERE n_nationkey % 6 <> 0 UNION SELECT gene, 'Biomarker' FROM g)
SELECT id, type, CASE WHEN id = (SELECT drug FROM m) THEN (SELECT arg_max(r_name, r_regionkey) FROM region WHERE r_regionkey % 3 = 0) END AS fact FROM x WHERE id IS NOT NULL"""
)
def harmonized_nodes(t: Tables) -> DataFrame:
    """Signature metadata, drug facts, adverse events and top genes as one graph."""
    return _harmonized(t).nodes.select("id", "type", F.col("properties")["Region_0"].alias("fact"))


@query(
    f"""WITH {_SIGNATURES} SELECT drug AS source, 'tested_in' AS relation, sig AS target FROM s UNION SELECT sig, 'observed_in', cl FROM s UNION SELECT cl, 'derived_from', tissue FROM s WHERE tissue IS NOT NULL
UNION SELECT drug, 'targets', unnest(['Target_HDAC', 'Target_T' || n]) FROM s WHERE n % 3 <> 0 UNION SELECT drug, 'causes', 'AdverseEvent_' || replace(n_name, ' ', '_') FROM m, nation WHERE n_nationkey % 6 <> 0 UNION SELECT sig, 'associated_with', gene FROM g"""
)
def harmonized_edges(t: Tables) -> DataFrame:
    return _harmonized(t).edges.select("source", "relation", "target")


@query("SELECT 'dangling' AS metric, 0::BIGINT AS value UNION ALL SELECT 'drugs', count(DISTINCT s_nationkey) FROM supplier")
def harmonized_validation(t: Tables) -> DataFrame:
    return H.validate(_harmonized(t)).where("metric IN ('dangling', 'drugs')")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)")
def anti_join_large_orders(t: Tables) -> DataFrame:
    return G.missing(t.customer, t.orders.where("o_orderstatus = 'F' AND o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(
    """WITH n AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey % 2 = 0 THEN 'Drug' WHEN n_regionkey = 1 THEN 'Target' ELSE 'Country' END AS type FROM nation)
SELECT s_suppkey, s.id AS source_id, t.id AS target_id, CASE WHEN s_suppkey % 3 = 0 THEN 'tested_in' ELSE 'linked_to' END AS type, s.type = 'Drug' AND t.type = 'Target' AND s_suppkey % 3 <> 0 AS allowed
FROM supplier JOIN n s ON s.id = s_nationkey AND s.type <> 'Country' JOIN n t ON t.id = s_suppkey % 25 AND t.type <> 'Country'"""
)
def gated_graph(t: Tables) -> DataFrame:
    """Nodes of allowed types, edges between them with allowed types, and whether a pair of types may have its edge."""
    r = F.col("n_regionkey")
    nodes = G.gate_nodes(t.nation.select(F.col("n_nationkey").alias("id"), F.when(r % 2 == 0, "Drug").when(r == 1, "Target").otherwise("Country").alias("type"), F.lit(0).alias("seq")))
    k = F.col("s_suppkey")
    edges = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("source_id"), (k % 25).cast("int").alias("target_id"), F.when(k % 3 == 0, "tested_in").otherwise("upregulates").alias("type"))
    allowed = t.spark.createDataFrame([("Drug", "Target", "linked_to"), ("Target", "Drug", "tested_in")][:1], "source_type string, target_type string, type string")
    return G.pairs_allowed(G.gate_edges(edges, nodes), nodes, allowed).select("s_suppkey", "source_id", "target_id", "type", "allowed")


_SEEN = ["anemia", "Nausea", "headache and FATIGUE", "nothing", "Vomiting; nausea"]
_BOUND = ["HDAC1", "egfr", "no target", "VEGF and HDAC6"]


@query(
    """WITH d AS (SELECT doc_id, doc_id % 5 AS e, doc_id % 4 AS b FROM documents), n AS (
SELECT doc_id, unnest(CASE e WHEN 0 THEN ['Anemia'] WHEN 1 THEN ['Nausea'] WHEN 2 THEN ['Headache', 'Fatigue'] WHEN 4 THEN ['Vomiting', 'Nausea'] ELSE [] END) AS name, 'Adverse Event' AS type, 'ae:' AS k FROM d
UNION ALL SELECT doc_id, unnest(CASE b WHEN 0 THEN ['HDAC1'] WHEN 1 THEN ['EGFR'] WHEN 3 THEN ['VEGF', 'HDAC6'] ELSE [] END), 'Target', 'target:' FROM d
UNION ALL SELECT doc_id, 'STAT', 'Target', 'target:' FROM documents WHERE regexp_matches(lower(text), '\\bstat\\b')
UNION ALL SELECT doc_id, 'Belix', 'Drug', 'drug:' FROM d UNION ALL SELECT doc_id, 'unknown_study', 'Clinical Study', 'study:' FROM d)
SELECT doc_id, k || lower(name) AS id, name, type, (CASE type WHEN 'Adverse Event' THEN 2 WHEN 'Target' THEN 1 WHEN 'Clinical Study' THEN 1 + count(*) FILTER (type = 'Adverse Event') OVER (PARTITION BY doc_id) ELSE count(*) OVER (PARTITION BY doc_id) - 1 END)::BIGINT AS links FROM n"""
)
def document_graph(t: Tables) -> DataFrame:
    """One run from texts to the graph: whole documents under two headings of findings, with the number of edges at each node."""
    from evigraph.operators import documents as D

    seen, bound = _pick(_SEEN, F.col("doc_id")), _pick(_BOUND, F.col("doc_id"))
    text = F.concat(F.lit("# Safety findings\nSeen: "), seen, F.lit(".\n## Mechanism of action\nIt binds "), bound, F.lit(".\n# Remarks\n"), F.coalesce("text", F.lit("")))
    out = D.to_graph(t.spark, t.documents.select("doc_id", text.alias("text")), "Belix")
    edges = out["graph.edges"]
    ends = edges.select("doc_id", F.col("source_id").alias("id")).union(edges.select("doc_id", "target_id")).groupBy("doc_id", "id").agg(F.count("*").alias("links"))
    return out["graph.nodes"].join(ends, ["doc_id", "id"], "left").select("doc_id", "id", "name", "type", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
