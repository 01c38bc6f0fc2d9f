"""Queries of operators on cells and short texts: each row takes one of a list of snippets by its key, and the SQL holds what is to
come of each, written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import cleaning as C
from evigraph.functions import text as X
from evigraph.operators import graph as G
from evigraph.operators import preclinical as P
from evigraph.operators import retrieval as Q
from evigraph.plans.catalogue import Tables, query


def picked(values: list) -> Column:
    """The snippet of a row of ``part``."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL: for each part, the row of ``rows`` that its key picks."""
    lit = lambda v: "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({i}, " + ", ".join(map(lit, r)) + ")" for i, r in enumerate(rows))
    return f"SELECT p_partkey, {columns} FROM part JOIN (VALUES {values}) AS v(i, {columns}) ON p_partkey % {len(rows)} = i"


# A value with the digits 10 counts as one in units of 10⁹, as it does in the source.
_ELIGIBLE = [
    "ANC ≥ 1.5 x 10^9/L; platelets >= 100,000/mm3; CrCl ≥ 45 mL/min; bilirubin ≤ 1.5 × ULN; ALT ≤ 2.5 x ULN",
    "absolute neutrophil count >= 1 x 10 and platelet count ≥ 75 × 10; creatinine clearance >= 60 mL/min; total bilirubin <= 2 times the ULN; transaminases ≤ 5 × ULN",
    "ANC ≥ 900/mm3, platelets >= 75,000/mm3 with adequate renal function of 50 mL/min; bilirubin ≤ 3 mg/dL",
    "no criteria",
]


@query(
    expected(
        "anc, platelets, crcl, bilirubin, alt_ast",
        [
            ("≥1.5 × 10⁹/L", "≥100000 × 10⁹/L", "≥45 mL/min", "≤1.5 × ULN", "≤2.5 × ULN"),
            ("≥1 × 10⁹/L", "≥75 × 10⁹/L", "≥60 mL/min", "≤2 × ULN", "≤5 × ULN"),
            ("≥900/mm³", "≥75000/mm³", "≥50 mL/min", "≤3 mg/dL", None),
            (None, None, None, None, None),
        ],
    )
)
def eligibility_cascades(t: Tables) -> DataFrame:
    fields = {"anc": "anc_threshold", "platelets": "platelet_threshold", "crcl": "creatinine_clearance", "bilirubin": "bilirubin_threshold", "alt_ast": "alt_ast_threshold"}
    rows = t.part.select("p_partkey", picked(_ELIGIBLE).alias("t"))
    return rows.select("p_partkey", *[X.extract_cascade("t", f"eligibility_{f}").alias(n) for n, f in fields.items()])


_KINETICS = [
    "The AUC rose from 21,057 to 31,358 ng·h/mL and mean Cmax was 32.5 μg/mL. It is metabolized by UGT1A1.",
    "AUC of 12.5 μg·h/mL; peak plasma concentration 7 ng/mL. 92.9% and 95.8% were bound to plasma protein.",
    "Vdss was 102 L and 94% bound to protein",
    "volume of distribution approaches total body water",
    "nothing",
]


@query(
    expected(
        "auc, cmax, binding, volume, pathway",
        [
            ("21,057 to 31,358 h·ng/mL", "32.5 μg/mL", None, None, "UGT1A1"),
            ("12.5 μg·h/mL", "7 μg/mL", "92.9-95.8%", None, None),
            (None, None, "94%", "102 L", None),
            (None, None, None, "Approaches total body water", None),
            (None, None, None, None, None),
        ],
    )
)
def kinetics_cascades(t: Tables) -> DataFrame:
    fields = {"auc": "auc_value", "cmax": "cmax_value", "binding": "plasma_protein_binding", "volume": "volume_of_distribution", "pathway": "metabolism_pathway"}
    rows = t.part.select("p_partkey", picked(_KINETICS).alias("t"))
    return rows.select("p_partkey", *[X.extract_cascade("t", f).alias(n) for n, f in fields.items()])


@query(expected("part_of", [("CLN-19 eligibility: age",), ("CLN-19 inclusion criteria ",), ("no study here",)]))
def study_window(t: Tables) -> DataFrame:
    texts = ["Intro. CLN-19 eligibility: ageTable 3 of CLN-20", "see CLN-19 inclusion criteria ## Next", "no study here"]
    return t.part.select("p_partkey", X.study_window(picked(texts), "CLN-19").alias("part_of"))


@query(expected("label", [("Pharmacokinetics",), ("Safety and Adverse Events",), ("Other",), ("Other",), ("Efficacy Outcomes",)]))
def router_labels(t: Tables) -> DataFrame:
    answers = ["The section is PHARMACOKINETICS.", "safety", "weather", "", " efficacy outcomes "]
    return t.part.select("p_partkey", X.fuzzy_label(picked(answers), ["Pharmacokinetics", "Safety and Adverse Events", "Efficacy Outcomes"]).alias("label"))


@query(expected("schemas", [("SafetyData,Contraindications,DrugInteractions",), ("Pharmacokinetics",), ("PreclinicalToxicology,Genotoxicity,Carcinogenicity,ReproductiveToxicity",), ("EligibilityCriteria",), ("",)]))
def section_schemas(t: Tables) -> DataFrame:
    names = ["Adverse events and safety", "PK parameters", "Animal toxicology", "Inclusion and exclusion", "Cover"]
    return t.part.select("p_partkey", F.array_join(X.schemas_for(picked(names)), ",").alias("schemas"))


@query(expected("refs, heads", [("table 3-1,section 2.1", ""), ("table 4", "table 4"), ("", "section 5.1"), ("section 2.2", "section 2.2"), ("", "")]))
def reference_keys(t: Tables) -> DataFrame:
    texts = ["see Table 3-1, Section 2.1 and table 3-1", "# Table 4\nrows", "## 5.1 Absorption", "### Section 2.2\n", "plain"]
    rows = t.part.select("p_partkey", picked(texts).alias("t"))
    return rows.select("p_partkey", F.array_join(X.references("t"), ",").alias("refs"), F.array_join(X.reference_heads("t"), ",").alias("heads"))


@query(expected("entities", [("CHEMICAL=belinol,cisplatin;DISEASE=anemia",), ("DISEASE=nausea",), ("",)]))
def named_terms(t: Tables) -> DataFrame:
    texts = ["Belinol with Cisplatin, belinol again: anemia", "Severe nausea", "belinolin anemias"]
    found = X.found_terms(t.part.select("p_partkey", picked(texts).alias("t")), "t", {"CHEMICAL": ["belinol", "cisplatin"], "DISEASE": ["anemia", "nausea"]})
    return found.select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries("entities"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ",")))), ";").alias("entities"))


@query(expected("parameter, cycle", [("ALT", "2"), ("White Blood Cells", "12"), ("Alanine Aminotransferase", "Recovery"), ("AST", ""), ("Cycle 3", "")]))
def parameter_cycles(t: Tables) -> DataFrame:
    parameter, cycle = C.parameter_cycle(picked(["ALT Cycle 2", " White Blood Cells  Cycle 12 (n=3)", "Recovery period", "AST", "Cycle 3"]))
    return t.part.select("p_partkey", parameter.alias("parameter"), cycle.alias("cycle"))


@query(expected("heading, deaths, rate, key", [("Study Phase", None, 0.25, "dose"), ("No. of Patients", 0, 1.0, "approved"), ("Cmax-Value", 7, 1.0, "weight")]))
def small_values(t: Tables) -> DataFrame:
    """Headings, negative counts, field rates and the property that a predicate with a number names."""
    return t.part.select(
        "p_partkey", C.pretty_header(picked(["study_phase", "n_patients", "CMAX-value"]), {"n_patients": "No. of Patients"}).alias("heading"), C.negative_to_null(picked([-1, 0, 7])).alias("deaths"),
        C.field_rate(picked([2, 9, 4]), picked([2, 2, 0])).alias("rate"), G.property_key(picked(["has_dose", "is_approved", "weight"])).alias("key"),
    )


@query(expected("ident", [("adverse_event:febrile_neutropenia",), ("target:hdac1",), ("clinical_study:nct_01",)]))
def node_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", G.node_id(picked(["Adverse Event", "Target", "Clinical Study"]), picked([" Febrile Neutropenia ", "HDAC1", "NCT 01"])).alias("ident"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a=1' WHEN 2 THEN 'a=1,b=' || n_name WHEN 3 THEN 'b=' || n_name ELSE '' END AS kept, (CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END)::INT AS not_found FROM nation")
def null_entries(t: Tables) -> DataFrame:
    """Entries of maps without a value, and leaves that are Not Found."""
    n = F.col("n_nationkey")
    m = F.create_map(F.lit("a"), F.when(n % 4 % 3 != 1, F.when(n % 2 == 0, "1")), F.lit("b"), F.when(n % 4 > 1, F.col("n_name")))
    leaf = t.nation.select("n_nationkey", C.drop_null_entries(m).alias("m"), F.struct(F.when(n % 2 == 0, C.NOT_FOUND).otherwise("x").alias("p"), F.when(n % 3 == 0, F.array(*[F.lit(C.NOT_FOUND)] * 2)).alias("q")).alias("s"))
    counted = C.count_not_found(leaf.select("s").schema)
    return leaf.select("n_nationkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kept"), counted.cast("int").alias("not_found"))


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: (x[1] + x[2]) / 2)), 6) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mean_vectors(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return both.select("vec_id", F.round(F.aggregate(C.mean_vector("v", "w"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_CHUNKS = ["# Table 1\nfirst, see Section 2.1", "## 2.1 Methods\nTable 1 and Table 3-2", "# Table 3-2\nsee table 9", "plain"]


def _chunks(t: Tables) -> DataFrame:
    """Four chunks for each order: the third and fourth reference nothing that is elsewhere."""
    rows = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(*map(F.lit, _CHUNKS))).alias("chunk_index", "content"))
    return rows.withColumn("section", F.when(F.col("chunk_index") == 3, "Other").otherwise("Safety"))


@query("SELECT o_orderkey AS doc_id, ref, target FROM orders, (VALUES ('table 1', 0), ('section 2.1', 1), ('table 3-2', 2)) v(ref, target)")
def reference_index(t: Tables) -> DataFrame:
    return Q.reference_index(_chunks(t)).select("doc_id", "ref", "target")


@query("SELECT o_orderkey AS doc_id, c AS chunk_index, target FROM orders, (VALUES (0, 1), (1, 0), (1, 2)) v(c, target)")
def reference_expand(t: Tables) -> DataFrame:
    return Q.expand_references(_chunks(t)).select("doc_id", "chunk_index", "target")


@query("SELECT o_orderkey AS doc_id, 'table 9' AS ref FROM orders")
def references_open(t: Tables) -> DataFrame:
    return Q.unresolved(_chunks(t)).select("doc_id", "ref")


@query("SELECT o_orderkey AS doc_id, 'Safety: 3 chunks (0-2)' || chr(10) || 'Other: 1 chunks (3-3)' AS summary FROM orders")
def section_lines(t: Tables) -> DataFrame:
    return Q.summary_text(_chunks(t)).select("doc_id", "summary")


@query("SELECT o_orderkey AS doc_id, c AS chunk_index FROM orders, (VALUES (1), (3)) v(c)")
def chunk_window(t: Tables) -> DataFrame:
    c = _chunks(t)
    return Q.adjacent(c, c.where("section = 'Other'").select("doc_id", (F.col("chunk_index") - 1).alias("chunk_index"))).select("doc_id", "chunk_index")


@query("SELECT o_orderkey AS doc_id, b AS block, level, title FROM orders, (VALUES (0, 0, ''), (1, 1, 'One'), (2, 3, 'Two  parts')) v(b, level, title)")
def header_blocks(t: Tables) -> DataFrame:
    text = F.lit("before\n#no heading\n# One\nx\n###  Two  parts \ny ## not one")
    return X.header_blocks(t.orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("t")), "doc_id", "t").select("doc_id", "block", "level", "title")


# Preclinical products: a part is an animal group


def _design(t: Tables) -> DataFrame:
    species, sex = F.when(F.col("p_partkey") % 2 == 0, "Rat").otherwise("Dog"), F.when(F.col("p_partkey") % 3 == 0, "M").otherwise("F")
    return t.part.select(species.alias("species"), sex.alias("sex"), F.col("p_partkey").cast("double").alias("dose"), "p_size", "p_partkey")


_GROUP = "CASE WHEN p_partkey % 2 = 0 THEN 'RAT' ELSE 'DOG' END || '_' || CASE WHEN p_partkey % 3 = 0 THEN 'M' ELSE 'F' END || '_' || p_partkey || 'MG'"


@query(
    f"""WITH g AS (SELECT 'AG_' || {_GROUP} AS node_id, p_partkey, p_size FROM part)
SELECT node_id, (p_partkey * CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 20 END)::DOUBLE AS per_area, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::INT AS n_terminal, e AS edge_type,
CASE e WHEN 'has_group' THEN 'Study_1' ELSE 'Drug_1' END AS source FROM g, (VALUES ('has_group'), ('administered_to')) v(e)"""
)
def animal_groups(t: Tables) -> DataFrame:
    n = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("-")
    nodes, edges = P.animal_groups(_design(t).withColumns({"group": F.lit("1"), "n_terminal": n, "n_recovery": n, "n_tk": n}), "Drug_1", "Study_1")
    return nodes.join(edges, nodes["node_id"] == edges["target"]).select("node_id", F.col("dose_mg_per_m2").cast("double").alias("per_area"), "n_terminal", "edge_type", "source")


@query(
    f"""WITH g AS (SELECT {_GROUP} AS g, p_size, day FROM part, (VALUES (1), (151)) v(day))
SELECT 'PK_' || g || '_D' || day AS node_id, 'AG_' || g AS source, CASE WHEN day = 151 THEN floor((p_size * 3 + 1) / (p_size * 2) * 100 + 0.5) / 100 END AS exposure_ratio, CASE WHEN day = 151 THEN 'Yes' ELSE 'No' END AS flag FROM g"""
)
def exposure_profiles(t: Tables) -> DataFrame:
    days = _design(t).select("species", "sex", F.col("dose").alias("dose_mg_per_kg"), F.explode(F.array(F.lit(1), F.lit(151))).alias("day"), "p_size")
    auc = F.when(F.col("day") == 1, F.col("p_size") * 2.0).otherwise(F.col("p_size") * 3.0 + 1)
    nodes, edges = P.exposure(days.select("species", "sex", "dose_mg_per_kg", "day", F.lit(1.0).alias("cmax"), auc.alias("auc")))
    return nodes.join(edges, nodes["node_id"] == edges["target"]).select("node_id", "source", F.col("exposure_ratio").cast("double").alias("exposure_ratio"), F.col("accumulation_flag").alias("flag"))


@query(
    f"""WITH m AS (SELECT {_GROUP} AS g, p_size, p_partkey % 4 AS k FROM part)
SELECT CASE k WHEN 0 THEN 'HEM_' || g || '_WBC_change_pct' WHEN 1 THEN 'CC_' || g || '_ALT_change_pct' ELSE 'OT_' || g || '_liver_necrosis_severity' END AS node_id,
CASE k WHEN 0 THEN 'Hematology_Event' WHEN 1 THEN 'Clinical_Chemistry_Event' ELSE 'Organ_Toxicity' END AS node_type, CASE k WHEN 0 THEN 'WBC' WHEN 1 THEN 'ALT' END AS parameter,
CASE WHEN k < 2 THEN CASE WHEN p_size > 20 THEN 'Yes' ELSE '' END END AS strong, CASE WHEN k = 2 THEN 'Liver Necrosis' END AS lesion, CASE WHEN k = 2 THEN p_size END::INT AS grade FROM m WHERE k < 3"""
)
def lab_events(t: Tables) -> DataFrame:
    metric = picked(["WBC_change_pct", "ALT_change_pct", "liver_necrosis_severity", "body_weight"])
    rows = _design(t).select("species", "sex", F.col("dose").alias("dose_mg_per_kg"), metric.alias("metric"), F.col("p_size").alias("value"))
    nodes, _ = P.lab_events(rows)
    return nodes.select("node_id", "node_type", "parameter", F.col("statistical_significance").alias("strong"), F.col("lesion_type").alias("lesion"), F.col("severity_grade").alias("grade"))


@query(f"SELECT 'MORT_' || {_GROUP} AS node_id, 'AG_' || {_GROUP} AS source, (p_size % 4)::INT AS deaths, floor((p_size % 4) / 30 * 100 * 10 + 0.5) / 10 AS percent FROM part WHERE p_size % 4 > 0")
def mortality(t: Tables) -> DataFrame:
    rows = _design(t).select("species", "sex", F.col("dose").alias("dose_mg_per_kg"), (F.col("p_size") % 4).cast("int").alias("deaths"), F.lit(30.0).alias("size"))
    nodes, edges = P.mortality(rows)
    return nodes.join(edges, nodes["node_id"] == edges["target"]).select("node_id", "source", F.col("mortality_count").alias("deaths"), F.col("mortality_percent").cast("double").alias("percent"))
