"""The preclinical graph from spreadsheets: typed nodes (node_id, node_type, further columns) and edges (source, target, edge_type).

Sheets come as tables with headings or as cells (sheet, row, col, value). Ids that the source drew at random are hashes of the
natural key here, so a second run gives the same graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions import cleaning as C
from evigraph.operators.graph import union_sparse


def group_id(species: Column, sex: Column, dose: Column) -> Column:
    return F.concat(F.lit("AG_"), F.upper(species), F.lit("_"), sex, F.lit("_"), dose.cast("int").cast("string"), F.lit("MG"))


def _tail(species: Column, sex: Column, dose: Column) -> Column:
    return F.concat(F.upper(species), F.lit("_"), sex, F.lit("_"), dose.cast("int").cast("string"), F.lit("MG"))



def _k() -> tuple[Column, Column, Column]:
    return F.col("species"), F.col("sex"), F.col("dose_mg_per_kg")


def _link(nodes: DataFrame, source: Column, edge_type: str, target: str = "node_id") -> DataFrame:
    return nodes.select(source.alias("source"), F.col(target).alias("target"), F.lit(edge_type).alias("edge_type"))


def animal_groups(design: DataFrame, drug_id: str, study_id: str) -> tuple[DataFrame, DataFrame]:
    """Groups of (species, group, sex, dose, n_terminal, n_recovery, n_tk); counts that are no number are 0."""
    rows = design.select(
        "species", "sex", F.col("dose").cast("double").alias("dose_mg_per_kg"), F.concat(F.upper("species"), F.lit("-G"), "group", F.lit("-"), "sex").alias("group_id"),
        *[C.safe_int(c).alias(c) for c in ("n_terminal", "n_recovery", "n_tk")],
    )
    nodes = rows.select(group_id(*_k()).alias("node_id"), F.lit("AnimalGroup").alias("node_type"), "group_id", "species", "sex", "dose_mg_per_kg", C.dose_per_area("dose_mg_per_kg", "species").alias("dose_mg_per_m2"), "n_terminal", "n_recovery", "n_tk")
    return nodes, _link(nodes, F.lit(study_id), "has_group").union(_link(nodes, F.lit(drug_id), "administered_to"))


def exposure(rows: DataFrame, late: int = 151, early: int = 1) -> tuple[DataFrame, DataFrame]:
    """Profiles of (species, sex, dose_mg_per_kg, day, cmax, auc), the late day with its ratio to the early one."""
    w = W.partitionBy("species", "sex", "dose_mg_per_kg")
    first = F.first(F.when(F.col("day") == early, F.col("auc")), ignorenulls=True).over(w.orderBy("day").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = rows.withColumn("_first", first)
    ratio = F.when((F.col("day") == late) & (F.col("_first") > 0), C.half_up(F.col("auc") / F.col("_first"), 2))
    nodes = out.select(
        F.concat(F.lit("PK_"), _tail(*_k()), F.lit("_D"), F.col("day").cast("string")).alias("node_id"), F.lit("PK_Profile").alias("node_type"), "species", "sex", "dose_mg_per_kg", "day",
        F.col("cmax").alias("Cmax"), F.col("auc").alias("AUC"), F.when(F.col("day") == late, "Yes").otherwise("No").alias("accumulation_flag"), ratio.alias("exposure_ratio"),
    )
    return nodes, _link(nodes, group_id(*_k()), "has_exposure")


def lab_events(rows: DataFrame, late: int = 151) -> tuple[DataFrame, DataFrame]:
    """Events of (species, sex, dose_mg_per_kg, metric, value): blood counts, liver enzymes and severities by the metric's name."""
    has = lambda *words: F.col("metric").rlike("|".join(words))
    plain = F.replace(F.replace(F.col("metric"), F.lit("_change_pct")), F.lit("_"), F.lit(" "))
    strong = F.when(F.abs(F.col("value").cast("double")) > 20, "Yes").otherwise("")
    late_pk = F.concat(F.lit("PK_"), _tail(*_k()), F.lit(f"_D{late}"))
    name = lambda p: F.concat(F.lit(p), _tail(*_k()), F.lit("_"), "metric").alias("node_id")
    base = ["species", "sex", "dose_mg_per_kg"]
    blood = rows.where(has("WBC", "RBC", "Platelet", "Hematocrit")).select(name("HEM_"), F.lit("Hematology_Event").alias("node_type"), *base, F.lit("Terminal").alias("cycle"), plain.alias("parameter"), F.col("value").cast("string").alias("percent_change"), strong.alias("statistical_significance"), F.lit("Not assessed").alias("recovery_flag"))
    chem = rows.where(has("ALT", "AST", "ALP")).select(name("CC_"), F.lit("Clinical_Chemistry_Event").alias("node_type"), *base, F.lit("Summary").alias("cycle"), plain.alias("parameter"), F.col("value").cast("string").alias("percent_change"), strong.alias("statistical_significance"), F.lit("Not assessed").alias("recovery_flag"))
    organ = C.title(F.replace(F.replace("metric", F.lit("_severity")), F.lit("_"), F.lit(" ")))
    tissue = rows.where(F.contains(F.lower("metric"), F.lit("severity"))).select(name("OT_"), F.lit("Organ_Toxicity").alias("node_type"), *base, F.split(organ, " ")[0].alias("organ"), organ.alias("lesion_type"), F.col("value").cast("int").alias("severity_grade"), F.lit(1).alias("incidence_count"), F.lit("No").alias("early_decedent_flag"), F.lit("Not assessed").alias("recovery_presence"))
    edges = [_link(blood, group_id(*_k()), "observed_hematology"), _link(blood, late_pk, "associated_with"), _link(chem, group_id(*_k()), "observed_chemistry"), _link(tissue, group_id(*_k()), "observed_pathology"), _link(tissue, late_pk, "associated_with")]
    return union_sparse(blood, chem, tissue), union_sparse(*edges)


def chemistry_matrix(cells: DataFrame, columns: list[tuple[int, int, str]], first_row: int = 3) -> tuple[DataFrame, DataFrame]:
    """Events of a matrix of parameters by dose and sex: ``columns`` lists (col, dose, sex). Blank cells and ND are no event."""
    spark = cells.sparkSession
    where = F.broadcast(spark.createDataFrame(columns, "col int, dose_mg_per_kg int, sex string"))
    heads = cells.where((F.col("col") == 0) & (F.col("row") >= first_row)).select("row", F.col("value").alias("head"))
    body = cells.where((F.col("row") >= first_row) & C.clean_value("value").isNotNull() & ~F.col("value").isin("None", "ND")).join(where, "col").join(heads, "row")
    parameter, cycle = C.parameter_cycle("head")
    number = C.marker_value("value")
    out = body.select(F.lit("Rat").alias("species"), "sex", "dose_mg_per_kg", cycle.alias("cycle"), parameter.alias("parameter"), F.coalesce(number.cast("string"), F.regexp_replace("value", r"\*", "")).alias("percent_change"), C.marker_label("value").alias("statistical_significance"))
    nodes = out.select(F.concat(F.lit("CC_"), _tail(*_k()), F.lit("_"), F.substring("parameter", 1, 3), F.lit("_"), "cycle").alias("node_id"), F.lit("Clinical_Chemistry_Event").alias("node_type"), "*", F.when(F.col("cycle") == "Recovery", "Yes").otherwise("No").alias("recovery_flag"))
    return nodes, _link(nodes, group_id(*_k()), "observed_chemistry")


def microscopic_findings(cells: DataFrame, species: str, columns: list[tuple[int, int, str]], sections: dict[int, str], late: int = 151) -> tuple[DataFrame, DataFrame]:
    """Findings of a sheet with banners: the section of a row is that of the last banner above it."""
    spark = cells.sparkSession
    where = F.broadcast(spark.createDataFrame(columns, "col int, dose_mg_per_kg int, sex string"))
    banner = F.create_map(*[x for r, s in sections.items() for x in (F.lit(r), F.lit(s))])
    w = W.partitionBy("sheet").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    heads = cells.where("col = 0").withColumn("section", F.last(banner[F.col("row")], ignorenulls=True).over(w))
    label = F.trim(F.regexp_replace("value", r"\s+", " "))
    heads = heads.where(~F.col("row").isin(list(sections)) & (F.col("row") >= min(sections)) & C.clean_value("value").isNotNull() & ~F.contains("value", F.lit("Number of Animals"))).select("sheet", "row", "section", label.alias("label"))
    organ, lesion = C.organ_lesion("label")
    rows = cells.join(where, "col").join(heads, ["sheet", "row"]).where(F.size(C.severity_pairs("value")) > 0)
    out = rows.select(
        F.lit(species).alias("species"), "sex", "dose_mg_per_kg", organ.alias("organ"), lesion.alias("lesion_type"), C.most_severe("value").alias("severity_grade"), C.incidence("value").alias("incidence_count"),
        F.when(F.col("section") == "Early Decedent", "Yes").otherwise("No").alias("early_decedent_flag"), F.when(F.col("section") == "Recovery", "Yes").otherwise("No").alias("recovery_presence"),
        F.substring(F.sha2(F.concat_ws(":", "sheet", F.col("row").cast("string"), F.col("col").cast("string")), 256), 1, 12).alias("_h"), "section",
    )
    ident = F.concat(F.lit("OT_"), _tail(*_k()), F.lit("_"), F.substring("organ", 1, 10), F.lit("_"), F.substring("section", 1, 4), F.lit("_"), "_h")
    nodes = out.select(ident.alias("node_id"), F.lit("Organ_Toxicity").alias("node_type"), *[c for c in out.columns if c not in ("_h", "section")])
    late_pk = F.concat(F.lit("PK_"), _tail(*_k()), F.lit(f"_D{late}"))
    return nodes, _link(nodes, group_id(*_k()), "observed_pathology").union(_link(nodes, late_pk, "associated_with"))


def mortality(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deaths of (species, sex, dose_mg_per_kg, deaths, size), for groups with any."""
    out = rows.where("deaths > 0")
    nodes = out.select(F.concat(F.lit("MORT_"), _tail(*_k())).alias("node_id"), F.lit("Mortality").alias("node_type"), "species", "sex", "dose_mg_per_kg", F.col("deaths").alias("mortality_count"), C.half_up(F.col("deaths") / F.col("size") * 100, 1).alias("mortality_percent"), F.lit("Yes").alias("early_termination_flag"))
    return nodes, _link(nodes, group_id(*_k()), "observed_mortality")
