"""Dense sheets, evaluation boxes and telemetry lines, with missing values and empty tables."""

import json

from evigraph.operators import harmonize, report

FACTS = "doc string, section string, field string, seq int, value string"
TABLES = "doc string, `table` string, seq int, column string, value string"
SCORES = "run string, f1 double, weighted_accuracy double, semantic_score double, hallucination_rate double, faithfulness double, cell_accuracy double, row_accuracy double"


def sheet(cells, key, name):
    return {(r["row"], r["col"]): r["value"] for r in cells.collect() if r[0] == key and r["sheet"] == name}


def test_grouped_sheets(spark):
    rows = [
        ("d", "population_characteristics", "median_age", 1, "61"), ("d", "study_metadata", "study_phase", 2, "II"), ("d", "study_metadata", "sponsor", 1, "S"),
        ("d", "study_metadata", "indication", 3, " Not Found "), ("d", "study_metadata", "notes", 4, None), ("d", "safety_data", "adverse_events", 1, "a"),
        ("d", "no_such_section", "x", 1, "y"), ("d", None, "x", 1, "y"), (None, "genotoxicity", "in_vitro", None, "Negative"), ("e", "genotoxicity", "in_vitro", 1, "[]"),
    ]
    cells = report.grouped_cells(spark.createDataFrame(rows, FACTS), "doc", {"in_vitro": "In vitro (bacteria)"}).cache()
    assert sheet(cells, "d", "1. Study Overview") == {
        (0, 0): "Category / Field", (0, 1): "Extracted Value", (1, 0): "STUDY METADATA", (2, 0): "Sponsor", (2, 1): "S", (3, 0): "Study Phase", (3, 1): "II",
        (5, 0): "POPULATION", (6, 0): "Median Age", (6, 1): "61",
    }
    assert sheet(cells, None, "4. Preclinical & Interactions")[(2, 0)] == "In vitro (bacteria)"
    assert {(r["doc"], r["sheet"]) for r in cells.collect()} == {("d", "1. Study Overview"), (None, "4. Preclinical & Interactions")}
    widths = {(r["sheet"], r["col"]): r["width"] for r in report.sheet_widths(cells, "doc").collect()}
    assert widths[("1. Study Overview", 0)] == len("Category / Field") + 2
    assert report.grouped_cells(spark.createDataFrame([], FACTS), "doc").count() == 0


def test_table_sheets(spark):
    rows = [
        ("d", "animal_studies", 1, "route", "oral"), ("d", "animal_studies", 2, "species", None), ("d", "animal_studies", 3, "species", "Rat"), ("d", "animal_studies", 3, "noael", "{}"),
        ("d", "animal_studies", 3, "unlisted", "x"), ("d", "pk_data_points", 1, "auc", "Not Found"), (None, "pk_data_points", 1, "auc", "5"), (None, "pk_data_points", 1, "auc", "5"), ("d", "other", 1, "auc", "5"),
    ]
    cells = report.table_cells(spark.createDataFrame(rows, TABLES), "doc").cache()
    assert sheet(cells, "d", "6. Animal Studies") == {(0, 0): "Species", (0, 1): "Route", (1, 1): "oral", (3, 0): "Rat"}
    assert sheet(cells, None, "5. PK Matrix") == {(0, 0): "Auc", (1, 0): "5"}
    assert cells.count() == 6 and report.table_cells(spark.createDataFrame([], TABLES), "doc").count() == 0


def test_sheets_are_written(spark, tmp_path):
    cells = report.table_cells(spark.createDataFrame([("d", "pk_data_points", 1, "auc", "5")], TABLES), "doc")
    report.write_sheets(cells, "doc", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("sheet = '5. PK Matrix'").count() == 2


def test_box(spark):
    scores = spark.createDataFrame([("a", 0.85714, 1.0, 0.5, None, 0.25, None, 0.0001), (None, None, None, None, None, None, None, None)], SCORES)
    parts = spark.createDataFrame([("a", "safety_data", 0.5, 0.25), ("a", "efficacy", None, 1.0), ("gone", "x", 1.0, 1.0), ("a", "a_name_of_more_than_twenty_five_letters", 1.0, 1.0)], "run string, section string, f1 double, weighted_accuracy double")
    rows = report.evaluation_box(scores, parts, "run").collect()
    box = {r["line_no"]: r["line"] for r in rows if r["run"] == "a"}
    assert {r["run"] for r in rows} == {"a", None} and all(len(x) in (60, 61) for x in box.values())
    assert box[4] == f"| OVERALL F1 SCORE:      {0.8571:<34} |" and box[7] == f"| HALLUCINATION RATE:   {0.0:<34} |" and box[11].split()[4:5] == ["N/A"] and "0.0001" in box[12]
    assert [box[i].split()[1].rstrip(".") for i in (15, 16, 17)] == ["a_name_of_more_than_twent", "efficacy", "safety_data"] and "0.5 | 0.25" in box[17] and len(box) == 18
    assert report.evaluation_box(scores.limit(0), parts, "run").count() == 0


def test_telemetry(spark):
    from evigraph.operators.records import run_totals

    chunks = spark.createDataFrame([("r", 0, 3, 2, 5, 1, None, 0.5), ("r", 1, 1, 1, 2, 0, "late", 0.25)], "run string, chunk_index int, prompt_tokens int, completion_tokens int, total_tokens int, retry_count int, error string, latency_seconds double")
    lines = {r["place"]: json.loads(r["line"]) for r in report.telemetry_lines(chunks, run_totals(chunks)).collect()}
    assert lines[-1]["total_tokens"] == 7 and lines[-1]["errors"] == 1 and lines[1]["error"] == "late" and len(lines) == 3


def test_ampersand_in_sheet_names(spark):
    cells = spark.createDataFrame([("1. A & B", 1, "x", "v"), ("A & B", 1, "x", "w")], "sheet string, row int, column string, value string")
    assert {r["key"] for r in harmonize.tabular_properties(cells).collect()} == {"A_and_B_x", "A_&_B_x"}
