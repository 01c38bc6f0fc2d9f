"""The seam to outside services: layout, record answers, judging and chemistry.

A provider is a function of a DataFrame that adds columns. The defaults are rules, so every result can be had again offline; a
service is called from ``batched``, which runs in Arrow batches on the executors with retries and gives failures as rows.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions import text as X
from evigraph.functions.cleaning import numeric_equal
from evigraph.streaming.progress import shared_dir

# Answers of a layout service that say nothing.
NOISE = ["", "n/a", "none", "not found", "unknown", "null", "unselected", ":unselected:", ":selected:"]


def batched(df: DataFrame, call: Callable[[list[dict]], list[str]], size: int = 8, pause: float = 0.0, tries: int = 5, wait: float = 15.0) -> DataFrame:
    """``df`` with response and error: ``call`` gets lists of rows and gives texts. Rate errors wait longer each time."""
    names = df.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            answers, errors = [], []
            for rows in X.batches(iter(p.to_dict("records")), size):
                out, error = [None] * len(rows), None
                for n in range(tries):
                    try:
                        out, error = call(rows), None
                        break
                    except Exception as e:  # noqa: BLE001  a failed call is a row, not the end of the job
                        error = f"{type(e).__name__}: {e}"
                        if "429" not in str(e):
                            break
                        time.sleep(wait * (n + 1))
                answers += out
                errors += [error] * len(rows)
                time.sleep(pause)
            yield p.assign(response=answers, error=errors)[[*names, "response", "error"]]

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]))


@dataclass
class Driven:
    """What became of rows that a service was asked about: with response; refused for good (response null); failed to the end."""

    answered: DataFrame
    refused: DataFrame
    failed: DataFrame


# Fixed value: what an error says of a row that the service will never answer.
REFUSED = "content_filter"


def driven(df: DataFrame, call: Callable[[list[dict]], list[str]], root: str | None = None, size: int = 8, pause: float = 0.0, tries: int = 5, wait: float = 15.0, sleep: Callable[[float], None] = time.sleep) -> Driven:
    """Asks about all rows, then about those that failed, and so on, at most ``tries`` times, with longer and uneven waits between.

    Each time is a table in the folder, so a row that was answered is not asked about again, and a run that stopped goes on from its last
    table. A refused row is not asked about again either. A call that fails takes the rows of its batch with it."""
    spark, root = df.sparkSession, root or f"{shared_dir(df.sparkSession)}/asked-{uuid.uuid4().hex}"
    hadoop, parts, left = spark._jvm.org.apache.hadoop.fs, [], df
    for n in range(tries):
        at = hadoop.Path(f"{root}/try={n}/_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            if n:
                sleep(wait * n + random.uniform(0, wait / 3))
            batched(left, call, size, pause, tries=1, wait=0.0).write.mode("overwrite").parquet(f"{root}/try={n}")
        rows = spark.read.parquet(f"{root}/try={n}")
        parts.append(rows)
        left = rows.where(F.col("error").isNotNull() & ~F.contains("error", F.lit(REFUSED))).drop("response", "error")
        if left.isEmpty():
            break
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return Driven(every.where("error IS NULL").drop("error"), every.where(F.contains("error", F.lit(REFUSED))).drop("response"), left)


def chunks(docs: DataFrame, key: str, text: str, embed: Callable[[list[dict]], list[str]], root: str | None = None, **options) -> DataFrame:
    """(key, chunk_index, content): texts cut where their paragraphs change their subject; documents of which a paragraph has no vector
    after all tries are cut in windows of fixed size. ``embed`` gives a JSON list of numbers for each paragraph."""
    parts = X.paragraphs(docs, key, text)
    asked = driven(parts, embed, root, **options)
    lost = asked.failed.select(key).union(asked.refused.select(key)).distinct()
    whole = asked.answered.join(lost, key, "left_anti").withColumn("vector", F.from_json("response", "array<double>"))
    by_subject = X.semantic_chunks(whole, key, "paragraph_index", "paragraph", "vector").select(key, "chunk_index", "content")
    by_size = X.fixed_chunks(docs.join(lost, key, "left_semi"), key, text).select(key, "chunk_index", "content")
    return by_subject.unionByName(by_size)


def extract_fields(df: DataFrame, text: str = "content") -> DataFrame:
    """``df`` with the fields of the eligibility and pharmacokinetic cascades."""
    return df.withColumns({f: X.extract_cascade(text, f) for f in [*rules.CASCADES, *rules.RANGE_CASCADES]})


def judge(df: DataFrame, truth: str, found: str) -> DataFrame:
    """``df`` with score: 1 for values that are equal but for case, space and units, else 0."""
    return df.withColumn("score", numeric_equal(truth, found).cast("double"))


def drop_noise(answers: DataFrame, value: str = "value") -> DataFrame:
    """Answers of a layout service that say something."""
    return answers.where(F.col(value).isNotNull() & ~F.lower(F.trim(value)).isin(NOISE))


def entities(df: DataFrame, text: str = "content") -> DataFrame:
    """``df`` with the vocabulary terms that a text names, by category."""
    return X.found_terms(df, text, {"CHEMICAL": rules.KNOWN_TARGETS, "DISEASE": rules.KNOWN_EVENTS})


def route_by_labels(labels: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A router that takes the first label that stands in a block."""
    return lambda df: df.withColumn("section", X.fuzzy_label(F.substring("content", 1, 600), labels))
