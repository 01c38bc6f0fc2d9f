"""Progress events as streams. Each function runs over what is there and ends (availableNow); the queries are those of a live one."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only on a local master where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"evigraph-{os.getpid()}")
    return found


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The file, or the files of the folder, as a stream; a stream takes a single file only as a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


#: Timers and states of several columns need a state store that holds them on disk.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(df: DataFrame, mode: str) -> DataFrame:
    """As ``_run``, with the state store that timers need; the session's own choice is back when it ends."""
    conf, was = df.sparkSession.conf, df.sparkSession.conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ON_DISK)
    try:
        return _run(df, mode)
    finally:
        conf.set(STATE_STORE, was) if was else conf.unset(STATE_STORE)


def _run(df: DataFrame, mode: str) -> DataFrame:
    """The rows that a query has given when all of the input is read, from a table in the shared folder."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated epoch writes the same

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(df.schema.add("epoch", "long")).parquet(out)


def latest_status(spark: SparkSession, path: str, session: str, status: str, ts: str, tie: str) -> DataFrame:
    """(session, status): the last status of each session."""
    last = event_stream(spark, path).groupBy(session).agg(F.max(F.struct(ts, tie, status)).alias("_last"))
    rows = _run(last.select(session, F.col(f"_last.{status}").alias("status"), F.col(f"_last.{ts}").alias("_ts")), "update")
    return rows.groupBy(session).agg(F.max_by("status", F.struct("epoch", "_ts")).alias("status"))


def status_of(statuses: DataFrame, asked: DataFrame, session: str) -> DataFrame:
    """What a poll answers: the latest status, ``running`` for sessions without one."""
    return asked.join(statuses, session, "left").withColumn("status", F.coalesce("status", F.lit("running")))


def _folded_timeouts(session: str, ts: str, seconds: int):
    def fold(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = sorted(t for p in parts for t in p[ts])
        if state.exists:
            times = [pd.Timestamp(state.get[0]), *times]
        gaps = sum((b - a).total_seconds() > seconds for a, b in zip(times, times[1:]))
        state.update((max(times).to_pydatetime(),))
        if gaps:
            yield pd.DataFrame({session: [key[0]], "timeouts": [int(gaps)]})

    return fold


def session_timeouts(spark: SparkSession, path: str, session: str, ts: str, seconds: int) -> DataFrame:
    """(session, timeouts): how often a session was silent for more than ``seconds``. A session's state is one time."""
    stream = event_stream(spark, path).select(session, ts)
    kind = dict(stream.dtypes)[session]
    out = stream.groupBy(session).applyInPandasWithState(_folded_timeouts(session, ts, seconds), f"{session} {kind}, timeouts long", "at timestamp", "update", "NoTimeout")
    return _run(out, "update").groupBy(session).agg(F.sum("timeouts").alias("timeouts"))


def step_states(spark: SparkSession, path: str, keys: list[str], value: str, ts: str) -> DataFrame:
    """(keys, state, at): the latest state of each step of each session, as a client shows it."""
    last = event_stream(spark, path).groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("at"), F.col(value).alias("state"))).alias("_l"))
    rows = _run(last.select(*keys, "_l.state", "_l.at"), "update")
    return rows.groupBy(*keys).agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))


def to_frames(events: DataFrame) -> DataFrame:
    """(frame): server-sent events of (event, step, status, message, progress)."""
    return events.select(F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), F.to_json(F.struct("step", "status", "message", "progress")), F.lit("\n\n")).alias("frame"))
