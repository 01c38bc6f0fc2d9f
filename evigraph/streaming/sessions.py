"""Events fanned out to sessions: a greeting first, nothing after the end, an error when a session falls silent, and no state that stays.

A session's state is one row: whether it is open, how many frames it was sent, and when it is due. A timer at that time either reports the
silence or, once a session is closed, forgets it. Timers run on processing time for a live stream, where silence is what passes
without a row, or on event time, where the watermark and the rows' own times tell it, so that a table read at once or in parts gives the same frames.

Defined results: rows of a micro-batch are taken by time and then by the other order columns; rows with a null session or time are left out; rows
of a closed session give nothing until it is forgotten, and then open it anew; equal rows are frames of their own; no rows give no frames.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evigraph.streaming.progress import run_to_end

#: The names of the frames that the fan-out itself sends, and of the row that ends a session.
PING, ERROR, DONE = "ping", "pipeline_error", "__done__"
STATE = "open boolean, sent long, due long"
FRAME = "no long, event string, data string"


def _ms(at: datetime) -> int:
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


class Fanout(StatefulProcessor):
    """Frames (session, no, event, data) of the rows (session, ts, order, event, data) of a session."""

    def __init__(self, silence_ms: int, keep_ms: int, event_time: bool, greeting: str, complaint: str):
        self.silence_ms, self.keep_ms, self.event_time, self.greeting, self.complaint = silence_ms, keep_ms, event_time, greeting, complaint

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def _put(self, opened: bool, sent: int, due: int, was: int | None) -> None:
        if was is not None and was != due:
            self.handle.deleteTimer(was)
        if was != due:
            self.handle.registerTimer(due)
        self.state.update((opened, sent, due))

    def _silent(self, no: int) -> tuple[int, str, str]:
        return no, ERROR, json.dumps({"message": self.complaint})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        opened, sent, due = self.state.get() if self.state.exists() else (True, 0, None)
        was, now = due, None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        out = []
        for ts, _, event, data in sorted(((r["ts"], r["order"], r["event"], r["data"]) for r in rows), key=lambda r: r[:2]):
            at = _ms(ts) if self.event_time else now
            if not opened and at >= due:  # its timer is yet to come
                opened, sent, due = True, 0, None
            if not opened:
                continue
            if due is not None and at > due:
                out.append(self._silent(sent))
                opened, due = False, due + self.keep_ms
                if at < due:
                    continue
                opened, sent = True, 0
            if not sent:
                out.append((0, PING, json.dumps({self.greeting: key[0]})))
                sent = 1
            if event == DONE:
                opened, due = False, at + self.keep_ms
                continue
            out.append((sent, event, data))
            sent, due = sent + 1, at + self.silence_ms
        self._put(opened, sent, due, was)
        for frame in out:
            yield Row(session=key[0], no=frame[0], event=frame[1], data=frame[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not self.state.exists():
            return
        opened, sent, now_due = self.state.get()
        if now_due != due:
            return
        if opened:
            number, event, data = self._silent(sent)
            self._put(False, sent + 1, due + self.keep_ms, None)
            yield Row(session=key[0], no=number, event=event, data=data)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def fan_out(
    events: DataFrame, session: str, ts: str, order: str, event: str, data: str, silence: int = 600, keep: int = 3600, event_time: bool = False, complaint: str = "Pipeline timed out after 10 minutes."
) -> DataFrame:
    """The frames (session, no, event, data) of a stream of events, as a stream. ``silence`` and ``keep`` (how long a closed session is
    remembered) are seconds; ``order`` breaks ties of ``ts``."""
    kind = dict(events.dtypes)[session]
    rows = events.where(F.col(session).isNotNull() & F.col(ts).isNotNull()).select(F.col(session).alias("session"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).alias("order"), F.col(event).alias("event"), F.col(data).cast("string").alias("data"))
    if event_time:
        rows = rows.withWatermark("ts", "0 seconds")
    work = Fanout(silence * 1000, keep * 1000, event_time, "session_id", complaint)
    return rows.groupBy("session").transformWithState(work, f"session {kind}, {FRAME}", "append", "EventTime" if event_time else "ProcessingTime")


def frames_to_end(events: DataFrame, *columns: str, **options) -> DataFrame:
    """The frames of a stream that ends, by event time, as a table with the text that goes over the wire."""
    frames = run_to_end(fan_out(events, *columns, event_time=True, **options), "append")
    return frames.drop("epoch").withColumn("frame", F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), F.coalesce("data", F.lit("null")), F.lit("\n\n")))
