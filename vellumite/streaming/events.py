"""Tables of updates that a stream writes, frames, stalls, and windows of event time; :mod:`.runs` has the fold of a run's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import STALL

def write_updates(updates: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Writes the rows of each micro-batch into a folder of its own, so that a batch that is repeated replaces itself; the started query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def latest_updates(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of the last batch; minima and maxima only, which combine before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(key, "v.*")


def stalls(events: DataFrame, seconds: int = STALL) -> DataFrame:
    """``(run, seq, ts, gap)`` of events that come more than ``seconds`` after the one before."""
    seconds_of = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    gap = seconds_of - F.lag(seconds_of).over(Window.partitionBy("run").orderBy("ts", "seq"))
    return events.select("run", "seq", "ts", gap.alias("gap")).where(F.col("gap") > seconds)


def event_frames(pieces: DataFrame, id_col: str = "run", order: str = "seq", text_col: str = "text") -> DataFrame:
    """``(run, k, payload)``: server-sent frames put together from pieces; a frame ends with a blank line, the rest waits."""
    whole = pieces.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text_col))), lambda x: x[text_col]), "").alias("all"))
    parts = F.split("all", "\n\n")
    rows = whole.select(id_col, F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("k", "frame")).where(F.col("frame").startswith("data: "))
    return rows.select(id_col, "k", F.substring("frame", 7, 1 << 30).alias("payload"))


def sse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row as a frame."""
    return rows.select(*keys, F.concat(F.lit("data: "), F.to_json(F.struct(*(c for c in rows.columns if c not in keys))), F.lit("\n\n")).alias("frame"))


def tumbling(events: DataFrame, size: str, keys: list[str]) -> DataFrame:
    """Counts and sums of ``value`` by windows of event time; works on streams with a watermark too."""
    w = F.window("ts", size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str, keys: list[str]) -> DataFrame:
    w = F.window("ts", size, step)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_windows(events: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def throttled(events: DataFrame, keys: list[str], millis: int) -> DataFrame:
    """At most one event of each key in any slot of so many milliseconds: the last, as a throttled display shows. A stream gets the same by its trigger."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (millis * 1000))
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys, slot.alias("slot")).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("v")).select(*keys, "slot", "v.*")


def closed_windows(events: DataFrame, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by windows of event time over a stream that drops what comes later than ``late``; a window is told once, when it is closed."""
    kind = events.schema["ts"].dataType.simpleString()  # watermarks want instants
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast(kind).alias("start"), *keys, "n")


def write_closed(windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Appends closed windows to a table of files; the started query."""
    return windows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
