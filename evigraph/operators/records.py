"""Answers about sections as fields of a document's record, judged answers as rates, run reports, and slices of matrices.

Answers are rows (doc_id, chunk_index, section, answer), the answer a JSON object with or without a fence around it.

Defined results: an answer that holds no JSON object gives no field; a field whose value is null gives none; equal rows count
once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions.cleaning import NOT_FOUND, lenient_json

TRIPLE = "subject:string,predicate:string,object:string,confidence:string"


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def asked_as(section: Column | str, modules: list[str]) -> Column:
    """The section whose questions a section gets, ``Other`` if there are none of it."""
    c = F.col(section) if isinstance(section, str) else section
    name = F.coalesce(_mapped(c, rules.SECTION_ALIASES), c)
    return F.when(name.isin(modules), name).otherwise(F.lit("Other"))


def _parsed(answers: DataFrame) -> DataFrame:
    fields = F.from_json(lenient_json("answer"), "map<string,string>")
    rows = answers.select("doc_id", "chunk_index", "section", F.explode(fields).alias("field", "value"))
    return rows.where("value IS NOT NULL").distinct()


def answer_fields(answers: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, key, field, silent, value): where each field of each chunk goes in the record. Nonclinical fields of
    other keys go there if an answer about the chunk says something of that key, else nowhere; a section without a key fills the
    record itself (key ''). Of several values in a chunk one that says something stays, then the least."""
    own = lambda f: _mapped(f, rules.NONCLINICAL_FIELDS)
    nonclinical = F.col("section") == "Nonclinical Toxicology"
    read = answers.select(
        "doc_id", "chunk_index", nonclinical.alias("nonclinical"), F.coalesce(_mapped(F.col("section"), rules.SECTION_KEYS), F.lit("")).alias("place"),
        F.map_entries(F.from_json(lenient_json("answer"), "map<string,string>")).alias("entries"),
    )
    full = F.transform(F.filter("entries", lambda e: e["value"] != NOT_FOUND), lambda e: own(e["key"]))
    read = read.withColumn("full", F.when(F.expr("nonclinical AND doc_id IS NOT NULL AND chunk_index IS NOT NULL"), F.array_compact(full)))
    # fields of a key of which the answer says something, without a value here: another answer about the chunk may have one
    named = F.array(*map(F.lit, rules.NONCLINICAL_FIELDS))
    lacking = F.filter(named, lambda f: F.array_contains("full", own(f)) & ~F.exists("entries", lambda e: e["key"] == f))
    lacking = F.transform(lacking, lambda f: F.struct(f.alias("key"), F.lit(None).cast("string").alias("value")))
    entries = F.when(F.size("full") > 0, F.concat("entries", lacking)).otherwise(F.col("entries"))
    rows = read.select("doc_id", "chunk_index", "nonclinical", "place", "full", F.inline(entries).alias("field", "value")).where("field <> 'semantic_relationships'")
    rows = rows.withColumn("own", F.when(F.col("nonclinical"), own(F.col("field"))))
    rows = rows.withColumn("goes", F.col("own").isNull() | F.coalesce(F.array_contains("full", F.col("own")), F.lit(False)))
    rows = rows.where("value IS NOT NULL OR own IS NOT NULL AND goes")
    # one exchange by field: a value that its own answer doesn't let in is let in by another one's mark
    silent = (F.trim("value") == "") | (F.col("value") == NOT_FOUND)
    said = F.struct(silent.alias("silent"), F.col("value").alias("value"))
    at = rows.groupBy("doc_id", F.coalesce("own", "place").alias("key"), "field", "chunk_index").agg(
        F.min(F.when(F.expr("goes AND value IS NOT NULL"), said)).alias("sure"), F.min(F.when(F.expr("NOT goes"), said)).alias("waits"), F.coalesce(F.bool_or(F.expr("goes AND value IS NULL")), F.lit(False)).alias("let_in")
    )
    best = F.least("sure", F.when(F.col("let_in"), F.col("waits")))
    return at.select("doc_id", "chunk_index", "key", "field", best.alias("best")).where("best IS NOT NULL").select("doc_id", "chunk_index", "key", "field", "best.*")


def record_fields(answers: DataFrame) -> DataFrame:
    """(doc_id, key, field, value): each field's first value that says something, else its first."""
    first = F.min(F.struct("silent", "chunk_index", "value"))
    return answer_fields(answers).groupBy("doc_id", "key", "field").agg(first.alias("first")).select("doc_id", "key", "field", "first.value")


def statements(answers: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, place, subject, predicate, object, confidence): an answer's statements, a list or an object with one."""
    rows = _parsed(answers).where("field = 'semantic_relationships'")
    found = F.coalesce(F.from_json("value", f"struct<relationships:array<struct<{TRIPLE}>>>")["relationships"], F.from_json("value", f"array<struct<{TRIPLE}>>"))
    return rows.select("doc_id", "chunk_index", F.posexplode(found).alias("place", "r")).select("doc_id", "chunk_index", "place", "r.*")


def judge_rates(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, hallucination_rate, faithfulness) of scores (key, task, score): the share of checked fields with score 0, and the
    mean score in whole percents; 0 and 1 where nothing was judged."""
    seen, zero = (F.count_if((F.col("task") == "hallucination") & c) for c in (F.col("score").isNotNull(), F.col("score") == 0))
    claims = F.count_if((F.col("task") == "faithfulness") & F.col("score").isNotNull())
    held = F.sum(F.when(F.col("task") == "faithfulness", F.floor(F.col("score") * 100)))
    return judged.groupBy(key).agg(
        F.when(seen > 0, F.round(zero / seen, 3)).otherwise(F.lit(0.0)).alias("hallucination_rate"), F.when(claims > 0, F.round(held / (claims * 100), 3)).otherwise(F.lit(1.0)).alias("faithfulness")
    )


def run_totals(chunks: DataFrame, key: str = "run") -> DataFrame:
    """(key, chunks, prompt_tokens, completion_tokens, total_tokens, retries, errors, latency) of a run's telemetry rows."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), *sums, F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"), F.count("error").alias("errors"), F.round(F.coalesce(F.sum("latency_seconds"), F.lit(0.0)), 3).alias("latency"))


def run_lines(totals: DataFrame, key: str = "run") -> DataFrame:
    """(key, summary): what a run's report says."""
    line = F.concat(F.lit("Run Summary ("), F.col(key).cast("string"), F.lit("):\n- Duration: "), F.col("latency").cast("string"), F.lit("s\n- Prompt Tokens: "), F.col("prompt_tokens").cast("string"))
    return totals.select(key, F.concat(line, F.lit("\n- Completion Tokens: "), F.col("completion_tokens").cast("string"), F.lit("\n- Total Tokens: "), F.col("total_tokens").cast("string")).alias("summary"))


def members(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """The rows whose value is one of the words, without case."""
    return df.where(F.lower(F.col(column).cast("string")).isin([w.lower() for w in words]))


def common_prefixes(a: DataFrame, left: str, b: DataFrame, right: str, sep: str = "_") -> DataFrame:
    """(prefix): what stands before the first ``sep`` in ids of both."""
    first = lambda df, c: df.where(F.col(c).isNotNull()).select(F.substring_index(F.col(c).cast("string"), sep, 1).alias("prefix"))
    return first(a, left).intersect(first(b, right))


def matrix_columns(cells: DataFrame, wanted: DataFrame, column: str, ident: str) -> DataFrame:
    """The cells (row, column, value) of a long matrix whose column is wanted; ids without a column give nothing."""
    ids = wanted.select(F.col(ident).alias(column)).distinct()
    return cells.join(ids, column, "left_semi")
