"""Streams that come in pieces: frames, restored markers, throttled sinks, each with a little state for a key.

A piece is a row with a key and ``seq``; the pieces of a key come in order from one micro-batch to the
next. The state holds what the next piece may still change: the tail of a frame, half a marker, the
last state that a sink has not shown. All need the RocksDB state store, which they set.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import folds as G
from .runs import ROCKS

#: Milliseconds between two outputs of a run at least: what is shown, and what is stored.
SINKS = {"shown": 180, "stored": 2000}
#: Events after which a sink is brought up to date at once.
LAST_WORDS = ("done", "error", "closed")


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda e: e.seq)


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "none") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(key).transformWithState(processor, schema, "append" if mode == "none" else "update", mode)


# ---- frames -------------------------------------------------------------------------


def frames_of(tail: str, piece: str) -> tuple[list[str], str]:
    """The frames that a piece completes, and the new tail."""
    *whole, rest = (tail + piece).split("\n\n")
    return whole, rest


class Frames(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "tail string, k long")

    def handleInputRows(self, key, rows, timerValues):
        tail, k = self.open.get() or ("", 0)
        out, tail = frames_of(tail, "".join(e.text for e in _in_order(rows)))
        self.open.update((tail, k + len(out)))
        yield from (Row(run=key[0], k=k + i, payload=f.removeprefix("data: ")) for i, f in enumerate(out) if f.startswith("data: "))

    def close(self) -> None:
        pass


def frame_stream(pieces: DataFrame) -> DataFrame:
    """``(run, k, payload)`` of a stream of ``(run, seq, text)``: server-sent frames as soon as their blank line is there.

    ``k`` numbers all frames of a run, of which only those that begin with ``data: `` are told. A null piece is empty.
    """
    rows = pieces.select(F.col("run").cast("long").alias("run"), "seq", F.coalesce("text", F.lit("")).alias("text"))
    return _stateful(rows, "run", Frames(), "run long, k long, payload string")


# ---- restored markers ---------------------------------------------------------------


class Restored(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "fragments string, rest string")

    def handleInputRows(self, key, rows, timerValues):
        fragments, rest = self.held.get() or ("[]", "")
        told, stream = [], None
        for e in _in_order(rows):
            if e.fragments is not None:
                fragments = json.dumps([[f["marker"], f["content"], f["kind"]] for f in e.fragments])
                stream = None
            if stream is None:
                stream = G.StreamUnmasker(json.loads(fragments), rest)
            if text := stream.feed(e.text, bool(e.last)):
                told.append(Row(run=key[0], seq=e.seq, text=text))
            rest = stream.rest
        self.held.update((fragments, rest))
        yield from told

    def close(self) -> None:
        pass


def restored_stream(pieces: DataFrame) -> DataFrame:
    """``(run, seq, text)`` of a stream of ``(run, seq, text, last, fragments)``: markers in pieces put back.

    The fragments ``array<struct<marker, content, kind>>`` come with a run's first piece, ``last`` says that none
    follows. What is told, in the order of ``seq``, is together what restoring the whole text gives: halves of
    markers wait for the next piece, and lines with formulas for their end.
    """
    rows = pieces.select(F.col("run").cast("long").alias("run"), "seq", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("last", F.lit(False)).alias("last"), "fragments")
    return _stateful(rows, "run", Restored(), "run long, seq long, text string")


# ---- throttled sinks ----------------------------------------------------------------


class Throttle:
    """One run's sinks: ``{sink: (since, seq)}`` of what waits, ``at`` and ``seq`` in whatever clock is used."""

    def __init__(self, periods: dict[str, int], waiting: dict[str, tuple[int, int]]):
        self.periods, self.waiting = periods, waiting
        self.out: list[tuple[str, int, int]] = []

    def due(self, now: int) -> None:
        """Writes what has waited for its period."""
        for sink, (since, seq) in sorted(self.waiting.items()):
            if now >= since + self.periods[sink]:
                self.out.append((sink, since + self.periods[sink], seq))
                del self.waiting[sink]

    def take(self, seq: int, at: int, last: bool) -> None:
        self.due(at)
        for sink in self.periods:
            since = self.waiting.get(sink, (at, seq))[0]
            self.waiting[sink] = (since, seq)
            if last:
                self.out.append((sink, at, seq))
                del self.waiting[sink]


class Throttled(StatefulProcessor):
    def __init__(self, periods: dict[str, int], timed: bool):
        self.periods, self.timed = periods, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "sink string", "since long, seq long")

    def _told(self, run: int, sinks: Throttle, before: set[str]) -> list[Row]:
        for sink in before - sinks.waiting.keys():
            self.waiting.removeKey((sink,))
        for sink, waits in sinks.waiting.items():
            self.waiting.updateValue((sink,), waits)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for due in {since + self.periods[sink] for sink, (since, _) in sinks.waiting.items()}:
            self.handle.registerTimer(due)
        return [Row(run=run, sink=sink, at=at, seq=seq) for sink, at, seq in sinks.out]

    def _sinks(self) -> tuple[Throttle, set[str]]:
        held = {k[0]: (v[0], v[1]) for k, v in self.waiting.iterator()}
        return Throttle(self.periods, dict(held)), set(held)

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.timed else timerValues.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues):
        sinks, before = self._sinks()
        for e in _in_order(rows):
            sinks.take(int(e.seq), int(e.at) if self.timed else self._now(timerValues), bool(e.last))
        yield from self._told(key[0], sinks, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        sinks, before = self._sinks()
        sinks.due(max(expiredTimerInfo.getExpiryTimeInMs(), self._now(timerValues)))
        yield from self._told(key[0], sinks, before)

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame, periods: dict[str, int] | None = None, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """``(run, sink, at, seq)`` of a stream of ``(run, seq, ts, type)``: which event each sink shows, and when.

    A sink waits its period (milliseconds) from the first event that it has not shown and then shows the last one, so
    two outputs are a period apart at least; the run's last word is shown at once. Times are those
    of processing or, with ``event_time``, of the events' ``ts`` and the stream's watermark.
    """
    rows = events.select(F.col("run").cast("long").alias("run"), "seq", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("type").isin(*LAST_WORDS).alias("last"))
    rows = rows.withWatermark("ts", late) if event_time else rows
    return _stateful(rows, "run", Throttled(periods or SINKS, event_time), "run long, sink string, at long, seq long", "eventTime" if event_time else "processingTime")
