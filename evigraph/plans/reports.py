"""Queries of reports: dense sheets, evaluation boxes, telemetry lines, and the property keys of the two workbook layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import harmonize, report
from evigraph.operators import records as A
from evigraph.plans.catalogue import Tables, query

_SHEETS = """WITH f AS (SELECT c_custkey AS k, v.* FROM customer, LATERAL (VALUES ('1. Study Overview', 0, 'STUDY METADATA', 1, 'Study Id', c_custkey::VARCHAR), ('1. Study Overview', 0, 'STUDY METADATA', 2, 'Sponsor Name', c_name),
('1. Study Overview', 1, 'POPULATION', 1, 'Median Age', CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR END), ('2. Treatment & Dosing', 0, 'DOSING', 1, 'Starting Dose', CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::BIGINT::VARCHAR END),
('3. Safety, Efficacy & MOA', 0, 'SAFETY DATA', 2, 'Most Common Aes', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END)) v(sheet, place, label, seq, name, value)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, sheet ORDER BY place, seq) + 2 * dense_rank() OVER (PARTITION BY k, sheet ORDER BY place) - 1 AS pos, row_number() OVER (PARTITION BY k, sheet, place ORDER BY seq) AS n FROM f WHERE value IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
cells AS (SELECT k AS c_custkey, sheet, pos AS row, 0 AS col, name AS value FROM r UNION ALL SELECT k, sheet, pos, 1, value FROM r UNION ALL SELECT k, sheet, pos - 1, 0, label FROM r WHERE n = 1
UNION ALL SELECT DISTINCT k, sheet, 0, 0, 'Category / Field' FROM r UNION ALL SELECT DISTINCT k, sheet, 0, 1, 'Extracted Value' FROM r
UNION ALL SELECT o_custkey, '8. Adverse Events', pos, 0, o_orderpriority FROM o UNION ALL SELECT o_custkey, '8. Adverse Events', pos, 1, o_orderkey::VARCHAR FROM o WHERE o_orderstatus = 'F'
UNION ALL SELECT DISTINCT o_custkey, '8. Adverse Events', 0, 0, 'Adverse Event Preferred Term' FROM o UNION ALL SELECT DISTINCT o_custkey, '8. Adverse Events', 0, 1, 'Adverse Event Patient Count' FROM o WHERE o_orderstatus = 'F')
"""


def _cells(t: Tables) -> DataFrame:
    one = lambda section, field, seq, value: F.struct(F.lit(section).alias("section"), F.lit(field).alias("field"), F.lit(seq).alias("seq"), value.cast("string").alias("value"))
    facts = F.array(
        one("study_metadata", "study_id", 1, F.col("c_custkey")), one("study_metadata", "sponsor_name", 2, F.col("c_name")),
        one("population_characteristics", "median_age", 1, F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("Not Found")),
        one("dosing_administration", "starting_dose", 1, F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal"))),
        one("safety_data", "adverse_events", 1, F.col("c_name")), one("safety_data", "most_common_aes", 2, F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(" ")),
        one("genotoxicity", "in_vitro", 1, F.lit("[]")), one("unlisted", "field", 1, F.col("c_name")),
    )
    cell = lambda column, value: F.struct(F.lit(column).alias("column"), value.cast("string").alias("value"))
    rows = F.array(
        cell("adverse_event_preferred_term", F.col("o_orderpriority")), cell("adverse_event_patient_count", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).otherwise("Not Found")),
        cell("serious_adverse_event_flag", F.lit("{}")), cell("unlisted", F.col("o_orderstatus")),
    )
    tables = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("adverse_events").alias("table"), F.col("o_orderkey").alias("seq"), F.explode(rows).alias("c")).select("c_custkey", "table", "seq", "c.*")
    grouped = report.grouped_cells(t.customer.select("c_custkey", F.explode(facts).alias("f")).select("c_custkey", "f.*"), "c_custkey")
    return grouped.unionByName(report.table_cells(tables, "c_custkey"))


@query(_SHEETS + "SELECT c_custkey, sheet, row::INT AS row, col, value FROM cells")
def dense_sheets(t: Tables) -> DataFrame:
    return _cells(t)


@query(_SHEETS + "SELECT c_custkey, sheet, col, least(max(length(value)) + 2, 60)::INT AS width FROM cells GROUP BY ALL")
def dense_widths(t: Tables) -> DataFrame:
    return report.sheet_widths(_cells(t), "c_custkey")


_RATE = "CASE WHEN @ IS NULL THEN 'N/A' ELSE regexp_replace(round(@, 4)::DECIMAL(12, 4)::VARCHAR, '0{1,3}$', '') END"


def _rate(c: str) -> str:
    return _RATE.replace("@", c)


def _value(label: str, c: str) -> str:
    return f"'{label}' || rpad({_rate(c)}, 34, ' ') || ' |'"


@query(
    f"""WITH s AS (SELECT c_nationkey AS nation, avg((c_acctbal > 0)::INT) AS f1, avg((c_acctbal > 5000)::INT) AS wa, CASE WHEN c_nationkey % 2 = 0 THEN avg((c_custkey % 4 = 0)::INT) END AS h, max(CASE WHEN c_nationkey % 3 = 0 THEN 0.25 END) AS cells FROM customer GROUP BY c_nationkey),
p AS (SELECT c_nationkey AS nation, c_mktsegment AS section, avg((c_acctbal > 0)::INT) AS f1, avg((c_acctbal > 5000)::INT) AS wa FROM customer GROUP BY ALL),
l AS (SELECT nation, 0 AS part, i AS no, '' AS name, line FROM s, LATERAL (VALUES (0, '+' || repeat('-', 58) || '+'), (1, '|' || repeat(' ', 14) || ' PRODUCTION EVALUATION REPORT ' || repeat(' ', 14) || '|'), (2, '+' || repeat('-', 58) || '+'),
(3, {_value("| OVERALL F1 SCORE:      ", "f1")}), (4, {_value("| WEIGHTED ACCURACY:    ", "wa")}), (5, {_value("| SEMANTIC CONFORMANCE: ", "f1")}), (6, {_value("| HALLUCINATION RATE:   ", "coalesce(h, 0)")}), (7, {_value("| FAITHFULNESS SCORE:   ", "wa")}),
(8, '+' || repeat('-', 58) || '+'), (9, rpad('| TABLE GRANULARITY:', 59, ' ') || '|'), (10, {_value("|   - Cell Accuracy:    ", "cells")}), (11, {_value("|   - Row Accuracy:     ", "NULL::DOUBLE")}), (12, '+' || repeat('-', 58) || '+'),
(13, rpad('| SECTION BREAKDOWN (F1 | Weighted Acc):', 59, ' ') || '|')) v(i, line)
UNION ALL SELECT nation, 1, 0, section, '| ' || rpad('  ' || rpad(section[:25], 25, '.') || ' ' || {_rate("f1")} || ' | ' || {_rate("wa")}, 56, ' ') || ' |' FROM p UNION ALL SELECT nation, 2, 0, '', '+' || repeat('-', 58) || '+' FROM s)
SELECT nation, row_number() OVER (PARTITION BY nation ORDER BY part, no, name)::INT AS line_no, line FROM l"""
)
def evaluation_boxes(t: Tables) -> DataFrame:
    """The report of each nation's customers, with their segments as sections."""
    share = lambda c: F.avg(c.cast("int"))
    f1, wa = share(F.col("c_acctbal") > 0).alias("f1"), share(F.col("c_acctbal") > 5000).alias("weighted_accuracy")
    rows = t.customer.withColumn("nation", F.col("c_nationkey"))
    scores = rows.groupBy("nation").agg(f1, wa, share(F.col("c_custkey") % 4 == 0).alias("h")).select(
        "nation", "f1", "weighted_accuracy", F.col("f1").alias("semantic_score"), F.when(F.col("nation") % 2 == 0, F.col("h")).alias("hallucination_rate"),
        F.col("weighted_accuracy").alias("faithfulness"), F.when(F.col("nation") % 3 == 0, F.lit(0.25)).alias("cell_accuracy"), F.lit(None).cast("double").alias("row_accuracy"),
    )
    return report.evaluation_box(scores, rows.groupBy("nation", F.col("c_mktsegment").alias("section")).agg(f1, wa), "nation")


@query(
    """WITH t AS (SELECT user_id AS run, count(*) AS n, sum(event_id % 100)::BIGINT AS p, sum(event_id % 10)::BIGINT AS c, count(*) FILTER (event_type = 'error') AS e, (sum(event_id % 8) / 8)::DOUBLE AS l FROM events GROUP BY user_id)
SELECT run, -1::BIGINT AS place, '{"run":' || run || ',"chunks":' || n || ',"prompt_tokens":' || p || ',"completion_tokens":' || c || ',"total_tokens":' || (p + c) || ',"retries":0,"errors":' || e || ',"latency":' || l || '}' AS line FROM t
UNION ALL SELECT user_id, event_id, '{"chunk_index":' || event_id || ',"prompt_tokens":' || event_id % 100 || ',"completion_tokens":' || event_id % 10 || ',"total_tokens":' || (event_id % 100 + event_id % 10) || ',"retry_count":0'
|| CASE WHEN event_type = 'error' THEN ',"error":"error"' ELSE '' END || ',"latency_seconds":' || (event_id % 8 / 8)::DOUBLE || '}' FROM events"""
)
def telemetry_report(t: Tables) -> DataFrame:
    n = F.col("event_id")
    chunks = t.events.select(
        F.col("user_id").alias("run"), n.alias("chunk_index"), (n % 100).alias("prompt_tokens"), (n % 10).alias("completion_tokens"), (n % 100 + n % 10).alias("total_tokens"), F.lit(0).alias("retry_count"),
        F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"), (n % 8 / 8.0).cast("double").alias("latency_seconds"),
    )
    return report.telemetry_lines(chunks, A.run_totals(chunks))


@query(
    """SELECT replace(replace(p_brand || ' & ' || p_type || '_' || p_name, ' ', '_'), '&', 'and') AS key, p_size::VARCHAR AS value, p_partkey AS row FROM part"""
)
def legacy_keys(t: Tables) -> DataFrame:
    """The properties of a sheet of Category, Field and Value."""
    return harmonize.legacy_properties(t.part.select(F.concat("p_brand", F.lit(" & "), "p_type").alias("Category"), F.col("p_name").alias("Field"), F.col("p_size").cast("string").alias("Value"), F.col("p_partkey").alias("row")))


@query(
    """WITH s AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey || '. Study & ' || o_custkey ELSE 'Study & ' || o_custkey END AS sheet, o_custkey, min(o_orderkey) AS row, arg_min(o_orderpriority, o_orderkey) AS priority, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey)
SELECT CASE WHEN o_custkey % 2 = 0 THEN 'Study_and_' ELSE 'Study_&_' END || o_custkey || '_' || name AS key, value, row FROM (SELECT o_custkey, row, 'Order_Priority_now' AS name, priority AS value FROM s UNION ALL SELECT o_custkey, row, 'on_off', status FROM s WHERE status <> 'P')"""
)
def tabular_keys(t: Tables) -> DataFrame:
    """The properties of the first row of each sheet: a sheet a customer, a row an order."""
    sheet = F.concat(F.when(F.col("o_custkey") % 2 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(". "))).otherwise(""), F.lit("Study & "), F.col("o_custkey").cast("string"))
    cell = lambda column, value: F.struct(F.lit(column).alias("column"), value.alias("value"))
    cells = F.array(cell("Order Priority (now)", F.col("o_orderpriority")), cell("on/off", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus"))))
    return harmonize.tabular_properties(t.orders.select(sheet.alias("sheet"), F.col("o_orderkey").alias("row"), F.explode(cells).alias("c")).select("sheet", "row", "c.*"))
