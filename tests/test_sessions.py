"""Fan-out of events to sessions: against a plain loop, over parts, and with timers that fire without a row."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest

from evigraph.streaming import progress, sessions

KIND = "session string, ts timestamp, n long, event string, data string"
START = datetime(2024, 1, 1)


def plain(rows, silence):
    """The frames of each session, taken one by one; the silence after the last row counts if the table goes on long enough."""
    out, end = [], max(r[1] for r in rows)
    for s in sorted({r[0] for r in rows}):
        own, last, no = sorted(r for r in rows if r[0] == s), None, 1
        out.append((s, 0, "ping", json.dumps({"session_id": s})))
        for _, ts, _, event, data in own:
            if last is not None and ts - last > silence:
                out.append((s, no, "pipeline_error", json.dumps({"message": "late"})))
                break
            if event == sessions.DONE:
                break
            out.append((s, no, event, data))
            no, last = no + 1, ts
        else:
            if last + silence <= end:
                out.append((s, no, "pipeline_error", json.dumps({"message": "late"})))
    return sorted(out)


def table(seed):
    rnd = random.Random(seed)
    rows = []
    for s in range(25):
        at = START + timedelta(seconds=rnd.randrange(3000))
        for _ in range(rnd.randrange(1, 12)):
            rows.append((f"s{s}", at, len(rows), rnd.choice(["step_update", "metrics", "step_update", sessions.DONE]), rnd.choice([None, '{"a": 1}'])))
            at += timedelta(seconds=rnd.choice((0, 5, 60, 400, 700)))
    return rows


def stream(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.mark.parametrize("parts", [1, 4])
def test_frames_like_a_loop(spark, tmp_path, parts):
    rows = sorted(table(parts), key=lambda r: r[1])
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    got = sessions.frames_to_end(stream(spark, tmp_path / "in"), "session", "ts", "n", "event", "data", silence=600, keep=10**7, complaint="late")
    assert sorted((r["session"], r["no"], r["event"], r["data"]) for r in got.collect()) == plain(rows, timedelta(seconds=600))
    assert spark.conf.get(progress.STATE_STORE).endswith("HDFSBackedStateStoreProvider")


def test_silence_tells_without_a_row_and_no_state_stays(spark, tmp_path):
    """Two micro-batches: the first has the rows, the later ones none; the error comes of itself, once, and then the state is gone."""
    spark.createDataFrame([("a", START, 1, "step_update", "x"), ("b", START, 2, "step_update", "y"), ("b", START, 3, sessions.DONE, None), ("b", START, 4, "metrics", "z"), (None, START, 5, "metrics", "z")], KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    frames = sessions.fan_out(stream(spark, tmp_path / "in"), "session", "ts", "n", "event", "data", silence=2, keep=2, complaint="late")
    seen, was = [], spark.conf.get(progress.STATE_STORE)
    spark.conf.set(progress.STATE_STORE, progress.ON_DISK)

    def put(batch, epoch):
        seen.extend((epoch, r["session"], r["no"], r["event"]) for r in batch.collect())

    try:
        q = frames.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").foreachBatch(put).start()
        end = time.time() + 90
        while time.time() < end and (len(seen) < 5 or not q.lastProgress or q.lastProgress["stateOperators"][0]["numRowsTotal"] > 0):
            time.sleep(0.5)
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        q.stop()
    finally:
        spark.conf.set(progress.STATE_STORE, was)
    first = sorted(x[1:] for x in seen if x[0] == 0)
    assert first == [("a", 0, "ping"), ("a", 1, "step_update"), ("b", 0, "ping"), ("b", 1, "step_update")]
    assert [x[1:] for x in seen if x[0] > 0] == [("a", 2, "pipeline_error")]
    assert left == 0


def test_a_session_opens_anew_once_it_is_forgotten(spark, tmp_path):
    rows = [("a", START, 1, sessions.DONE, None), ("a", START + timedelta(seconds=5), 2, "metrics", "early"), ("a", START + timedelta(seconds=60), 3, "metrics", "x")]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = sessions.frames_to_end(stream(spark, tmp_path / "in"), "session", "ts", "n", "event", "data", silence=600, keep=30)
    assert sorted((r["no"], r["event"], r["data"]) for r in got.collect()) == [(0, "ping", '{"session_id": "a"}'), (0, "ping", '{"session_id": "a"}'), (1, "metrics", "x")]
