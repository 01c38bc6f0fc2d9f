"""Reports of records and runs: the sheets of a dense workbook, the box of an evaluation, the lines of a run's telemetry.

All of it is rows, so the reports of a whole corpus are made at once; sorting and one document's text are left to the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.cleaning import pretty_header

# The sheets of grouped fields, each with its groups (heading, section of the record).
GROUPED_SHEETS = {
    "1. Study Overview": [("Study Metadata", "study_metadata"), ("Population", "population_characteristics"), ("Eligibility", "eligibility_criteria")],
    "2. Treatment & Dosing": [
        ("Dosing", "dosing_administration"), ("Treatment Mgmt", "treatment_management"), ("Special Populations", "special_populations"),
        ("Contraindications", "contraindications"), ("Formulation", "formulation_stability"),
    ],
    "3. Safety, Efficacy & MOA": [("Safety Data", "safety_data"), ("Efficacy Outcomes", "efficacy_outcomes"), ("Mechanism of Action", "mechanism_of_action")],
    "4. Preclinical & Interactions": [
        ("Genotoxicity", "genotoxicity"), ("Carcinogenicity", "carcinogenicity"), ("Reproductive Toxicity", "reproductive_toxicity"), ("Drug Interactions", "drug_interactions"),
    ],
}

# The sheets of tables: the table of the record and its columns in order.
TABLE_SHEETS = {
    "5. PK Matrix": ("pk_data_points", ["species", "gender", "dose_level", "route", "study_id", "cmax", "auc", "t_half", "clearance", "vd", "protein_binding", "tmax", "metabolism", "notes"]),
    "6. Animal Studies": ("animal_studies", ["species", "gender", "study_type", "dose_level", "route", "duration", "cmax", "auc", "t_half", "noael", "loael", "target_organs", "adverse_findings", "mortality", "reversibility", "study_id_reference"]),
    "7. Clinical Studies": ("clinical_studies", ["study_id", "study_phase", "patient_group", "n_patients", "indication", "dose_level", "gender", "orr", "cr_rate", "pr_rate", "median_pfs", "median_os", "median_dor", "pk_cmax", "pk_auc", "pk_t_half", "grade_3_4_rate", "top_aes", "discontinuation_rate", "notes"]),
    "8. Adverse Events": ("adverse_events", ["adverse_event_preferred_term", "adverse_event_patient_count", "adverse_event_percentage", "grade_3_4_ae_frequency", "treatment_emergent_ae_flag", "serious_adverse_event_flag"]),
}

# Texts of a value that is missing.
MISSING = ["", "Not Found", "[]", "{}"]


def has_value(c: Column) -> Column:
    return F.coalesce(~F.trim(c, F.lit(" \t\n\r\x0b\x0c")).isin(MISSING), F.lit(False))


def _cell(row: Column, col: Column | int, value: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(row.cast("int").alias("row"), lit(col).cast("int").alias("col"), lit(value).alias("value"))


def grouped_cells(facts: DataFrame, key: str, names: dict[str, str] | None = None) -> DataFrame:
    """(key, sheet, row, col, value): the grouped sheets of facts (key, section, field, seq, value).

    Row 0 is the heading; then comes each group that has a value: its heading in capitals, its fields by seq, a free row. Fields without
    a value, sections of no sheet, and the events, which have a sheet of their own, are left out, and so are sheets without a group. Equal
    facts are shown as often as they stand; a null key is a record.
    """
    plan = [(section, sheet, i, label) for sheet, groups in GROUPED_SHEETS.items() for i, (label, section) in enumerate(groups)]
    places = F.create_map(*[x for s, sheet, i, label in plan for x in (F.lit(s), F.struct(F.lit(sheet).alias("sheet"), F.lit(i).alias("place"), F.lit(label).alias("label")))])
    events = (F.col("section") == "safety_data") & (F.col("field") == "adverse_events")
    shown = facts.where(has_value(F.col("value")) & ~events & F.col("section").isin([s for s, *_ in plan]))
    rows = shown.select(F.col(f"`{key}`").alias("_key"), places[F.col("section")].alias("g"), "field", "seq", "value").select("_key", "g.*", "field", "seq", "value")
    sheet = W.partitionBy("_key", "sheet").orderBy("place", "seq", "field", "value")
    rows = rows.withColumn("_rn", F.row_number().over(sheet)).withColumn("_new", (F.col("place") != F.coalesce(F.lag("place").over(sheet), F.lit(-1))).cast("int"))
    rows = rows.withColumn("_at", F.col("_rn") + 2 * F.sum("_new").over(sheet.rowsBetween(W.unboundedPreceding, 0)) - 1)
    top = F.when(F.col("_rn") == 1, F.array(_cell(F.lit(0), 0, "Category / Field"), _cell(F.lit(0), 1, "Extracted Value")))
    banner = F.when(F.col("_new") == 1, F.array(_cell(F.col("_at") - 1, 0, F.upper("label"))))
    own = F.array(_cell(F.col("_at"), 0, pretty_header("field", names)), _cell(F.col("_at"), 1, F.col("value")))
    cells = F.flatten(F.array_compact(F.array(top, banner, own)))
    return rows.select("_key", "sheet", F.explode(cells).alias("c")).select(F.col("_key").alias(key), "sheet", "c.*")


def table_cells(tables: DataFrame, key: str) -> DataFrame:
    """(key, sheet, row, col, value): the sheets of tables (key, table, seq, column, value).

    Row 0 holds the headings of the columns that have a value in any row, in their fixed order; rows follow by seq, also those without a
    value, which have no cells. Of two values of one cell the greater text is shown. Tables without a value have no sheet.
    """
    sheets = F.create_map(*[F.lit(x) for sheet, (table, _) in TABLE_SHEETS.items() for x in (table, sheet)])
    places = F.create_map(*[F.lit(x) for table, cols in TABLE_SHEETS.values() for i, c in enumerate(cols) for x in (f"{table}.{c}", i)])
    at = F.concat("table", F.lit("."), "column")
    cells = tables.where(F.col("table").isin([t for t, _ in TABLE_SHEETS.values()]))
    cells = cells.select(F.col(f"`{key}`").alias("_key"), sheets[F.col("table")].alias("sheet"), "seq", F.col("column").alias("_name"), places[at].alias("place"), F.when(has_value(F.col("value")), F.col("value")).alias("value"))
    one = cells.groupBy("_key", "sheet", "seq", "place").agg(F.max("value").alias("value"), F.max("_name").alias("_name"))
    rows = one.withColumn("row", F.dense_rank().over(W.partitionBy("_key", "sheet").orderBy(F.col("seq").asc_nulls_last()))).where("place IS NOT NULL AND value IS NOT NULL")
    cols = rows.groupBy("_key", "sheet", "place").agg(F.max("_name").alias("_name"))
    cols = cols.withColumn("col", F.row_number().over(W.partitionBy("_key", "sheet").orderBy("place")) - 1)
    heads = cols.select("_key", "sheet", F.lit(0).alias("row"), "col", pretty_header("_name").alias("value"))
    named = cols.select(F.col("_key").alias("_k"), F.col("sheet").alias("_s"), F.col("place").alias("_p"), "col")
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("sheet") == F.col("_s")) & (F.col("place") == F.col("_p"))
    body = rows.join(named, same).select("_key", "sheet", "row", "col", "value")
    return heads.unionByName(body).withColumnRenamed("_key", key)


def sheet_widths(cells: DataFrame, key: str, most: int = 60) -> DataFrame:
    """(key, sheet, col, width): two more than the longest text of each column, at most ``most``."""
    return cells.groupBy(key, "sheet", "col").agg(F.least(F.max(F.coalesce(F.length("value"), F.lit(0))) + 2, F.lit(most)).alias("width"))


def write_sheets(cells: DataFrame, key: str, path: str) -> None:
    """The cells as JSON lines, a folder for each sheet, a record's cells together and in order."""
    cells.repartition("sheet", key).sortWithinPartitions("sheet", key, "row", "col").write.mode("overwrite").partitionBy("sheet").json(path)


def _number(c: Column | str) -> Column:
    """A rate as Python shows it: up to four decimals, one at least; ``N/A`` for none."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(F.round(text, 4).cast("decimal(12,4)").cast("string"), "0{1,3}$", ""), F.lit("N/A"))


def evaluation_box(scores: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line): the report of each run's evaluation.

    ``scores`` has a row a key: f1, weighted_accuracy, semantic_score, hallucination_rate, faithfulness, cell_accuracy, row_accuracy;
    ``sections`` (key, section, f1, weighted_accuracy) give lines by name. Rates of judged fields that are null are 0, others ``N/A``. Keys
    without scores have no report, a null key is a run.
    """
    rule = F.lit("+" + "-" * 58 + "+")
    value = lambda label, c: F.concat(F.lit(label), F.rpad(c, 34, " "), F.lit(" |"))
    judged = lambda c: _number(F.coalesce(F.col(c), F.lit(0.0)))
    top = [
        rule, F.lit("|" + " PRODUCTION EVALUATION REPORT ".center(58) + "|"), rule,
        value("| OVERALL F1 SCORE:      ", _number("f1")), value("| WEIGHTED ACCURACY:    ", _number("weighted_accuracy")),
        value("| SEMANTIC CONFORMANCE: ", _number("semantic_score")), value("| HALLUCINATION RATE:   ", judged("hallucination_rate")),
        value("| FAITHFULNESS SCORE:   ", judged("faithfulness")), rule, F.lit("| TABLE GRANULARITY:".ljust(59) + "|"),
        value("|   - Cell Accuracy:    ", _number("cell_accuracy")), value("|   - Row Accuracy:     ", _number("row_accuracy")), rule,
        F.lit("| SECTION BREAKDOWN (F1 | Weighted Acc):".ljust(59) + "|"),
    ]
    own = scores.select(F.col(f"`{key}`").alias("_key"), *[F.col(c) for c in ("f1", "weighted_accuracy", "semantic_score", "hallucination_rate", "faithfulness", "cell_accuracy", "row_accuracy")])
    fixed = own.select("_key", F.posexplode(F.array(*top)).alias("_line", "line")).select("_key", F.lit(0).alias("_part"), F.col("_line").cast("string").alias("_by"), "_line", "line")
    line = F.concat(F.lit("  "), F.rpad(F.substring("section", 1, 25), 25, "."), F.lit(" "), _number("f1"), F.lit(" | "), _number("weighted_accuracy"))
    part = sections.select(F.col(f"`{key}`").alias("_key"), "section", "f1", "weighted_accuracy").join(own.select(F.col("_key").alias("_k")).distinct(), F.col("_key").eqNullSafe(F.col("_k")), "left_semi")
    middle = part.select("_key", F.lit(1).alias("_part"), F.col("section").alias("_by"), F.lit(0).alias("_line"), F.concat(F.lit("| "), F.rpad(line, 56, " "), F.lit(" |")).alias("line"))
    end = own.select("_key", F.lit(2).alias("_part"), F.lit("").alias("_by"), F.lit(0).alias("_line"), rule.alias("line"))
    order = W.partitionBy("_key").orderBy("_part", "_line", "_by", "line")
    return fixed.unionByName(middle).unionByName(end).select(F.col("_key").alias(key), F.row_number().over(order).alias("line_no"), "line")


def telemetry_lines(chunks: DataFrame, totals: DataFrame, key: str = "run") -> DataFrame:
    """(key, place, line): a run's report as JSON lines: its totals at place -1, then each chunk (chunk_index, ...) at its index.

    ``totals`` is what ``records.run_totals`` gives. A run of millions of chunks is rows as any other, never one text."""
    meta = totals.select(F.col(key), F.lit(-1).cast("long").alias("place"), F.to_json(F.struct(*[F.col(c) for c in totals.columns])).alias("line"))
    own = [c for c in chunks.columns if c != key]
    return meta.unionByName(chunks.select(F.col(key), F.col("chunk_index").cast("long").alias("place"), F.to_json(F.struct(*[F.col(c) for c in own])).alias("line")))
