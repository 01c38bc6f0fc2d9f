"""Steps whose results are tables kept by content: a run does what is not there yet, so it can be stopped and taken up again.

A step names what it needs (sources or other steps), and its key is a hash of its name, version and parameters and of the keys of what it needs; the
key of a source is a digest of its rows. Its tables lie under that key, so a step whose inputs are the same is read, one whose inputs or
version changed is done anew, and with it what depends on it and nothing else. A table counts once Spark has committed it; what a failed step left
is written over. Each start, end, reading and failure is a row of the progress table, which can be read as a stream.

Defined results: steps run after what they need, else in the given order; two equal sources (rows in any order, repeats counted) have one key; a step
that fails is reported and ends the run with its error; unknown names and circles are errors before anything runs.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.streaming.progress import shared_dir

PROGRESS = "session string, at timestamp, event string, step string, status string, message string, progress double"


@dataclass(frozen=True)
class Step:
    """``run`` gets the tables that it needs by name, and gives one table or, with ``outputs``, one for each of them (``step.output``)."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame | dict[str, DataFrame]]
    needs: tuple[str, ...]
    version: str = "1"
    parameters: dict = field(default_factory=dict)
    outputs: tuple[str, ...] = ()

    def tables(self) -> list[str]:
        return [f"{self.name}.{o}" for o in self.outputs] or [self.name]


def content_key(df: DataFrame) -> str:
    """A digest of a table's schema and rows, in any order: their number, and two sums of 64-bit hashes."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}) if df.columns else F.lit("")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), total("a"), total("b")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{n}|{a}|{b}".encode()).hexdigest()[:32]


def in_order(steps: list[Step], sources: list[str]) -> list[Step]:
    """The steps, each after what it needs."""
    made = {t: s.name for s in steps for t in s.tables()}
    names = [s.name for s in steps]
    if len(set(names)) < len(names) or set(made) & set(sources):
        raise ValueError("names of steps and sources must differ")
    for s in steps:
        for n in s.needs:
            if n not in made and n not in sources:
                raise ValueError(f"step {s.name} needs {n}, which is neither a source nor made by a step")
    out, done, left = [], set(), list(steps)
    while left:
        ready = next((s for s in left if all(n in sources or made[n] in done for n in s.needs)), None)
        if ready is None:
            raise ValueError("steps need each other: " + ", ".join(s.name for s in left))
        out.append(ready)
        done.add(ready.name)
        left.remove(ready)
    return out


class Flow:
    """Steps over a folder that keeps their tables and their progress."""

    def __init__(self, spark: SparkSession, steps: list[Step], root: str | None = None):
        self.spark, self.steps = spark, steps
        self.root = root or f"{shared_dir(spark)}/flow-{uuid.uuid4().hex}"

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _tell(self, run: str, step: str, status: str, message: str, share: float, on_step) -> None:
        kind = "pipeline_error" if status == "error" else "step_update"
        row = self.spark.createDataFrame([(kind, step, status, message, float(share))], "event string, step string, status string, message string, progress double")
        row.select(F.lit(run).alias("session"), F.lit(time.time()).cast("timestamp").alias("at"), "*").coalesce(1).write.mode("append").json(f"{self.root}/progress")
        if on_step:
            on_step(step, status, message, share)

    def progress(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).json(f"{self.root}/progress")

    def run(self, sources: dict[str, DataFrame], session: str | None = None, on_step: Callable[[str, str, str, float], None] | None = None) -> dict[str, DataFrame]:
        """The tables of all steps, and the sources, by name."""
        order = in_order(self.steps, list(sources))
        session = session or uuid.uuid4().hex
        keys, tables = {n: content_key(df) for n, df in sources.items()}, dict(sources)
        for i, s in enumerate(order):
            told = json.dumps([s.name, s.version, s.parameters, s.outputs, [(n, keys[n]) for n in s.needs]], sort_keys=True, default=str)
            key = hashlib.sha256(told.encode()).hexdigest()[:32]
            paths = {t: f"{self.root}/{s.name}/{key}/{t.removeprefix(s.name).removeprefix('.') or 'table'}" for t in s.tables()}
            share = 100 * (i + 1) / len(order)
            if all(self._there(p) for p in paths.values()):
                self._tell(session, s.name, "read", key, share, on_step)
            else:
                self._tell(session, s.name, "running", key, 100 * i / len(order), on_step)
                try:
                    made = s.run({n: tables[n] for n in s.needs})
                    made = {f"{s.name}.{o}": made[o] for o in s.outputs} if s.outputs else {s.name: made}
                    for t, df in made.items():
                        if not self._there(paths[t]):
                            df.write.mode("overwrite").parquet(paths[t])
                except Exception as e:
                    self._tell(session, s.name, "error", f"{type(e).__name__}: {e}"[:500], 100 * i / len(order), on_step)
                    raise
                self._tell(session, s.name, "complete", key, share, on_step)
            for t, p in paths.items():
                tables[t], keys[t] = self.spark.read.parquet(p), f"{key}/{t}"
        return tables
