"""Queries over streams that come in pieces: frames, restored markers, throttled sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup
from ..session import shared_folder, written
from ..streaming import pieces
from ..streaming.events import write_closed, write_updates
from .library_queries import _RUNS, _run_view
from .views import Query, markup_view, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(run, sql: str | None = None) -> None:
    QUERIES[run.__name__] = run
    if sql:
        ORACLES[run.__name__] = sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)


def _all_of(rows: DataFrame, root: str) -> DataFrame:
    """What a stream appends until its input ends."""
    write_closed(rows, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/out")


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as frames, every frame cut in two anywhere, put together again; every ninth is a comment."""
    n = F.col("event_id")
    frame = F.concat(F.when(n % 9 == 0, F.lit(": ping ")).otherwise("data: "), F.lit('{"n":'), n.cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}\n\n'))
    cut = (n % (F.length(frame) + 1)).cast("int")
    halves = F.array(F.struct((2 * n).alias("seq"), F.substring(frame, F.lit(1), cut).alias("text")), F.struct((2 * n + 1).alias("seq"), F.substring(frame, cut + 1, F.length(frame)).alias("text")))
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("run"), F.inline(halves))
    return _all_of(pieces.frame_stream(rows), shared_folder(spark, "stream-frames"))


_add(stream_frames, """SELECT * FROM (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, CASE WHEN event_id % 9 <> 0 THEN '{"n":' || event_id || ',"type":"' || event_type || '"}' END AS payload FROM events) WHERE payload IS NOT NULL""")


def stream_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked texts in pieces of 200 characters, over two files, restored by a stream: what restoring the whole gives."""
    root = shared_folder(spark, "stream-restored")
    masked = written(markup_view(spark, sf_dir).select("doc_id", F.when(F.col("text").rlike(markup.MASK_SIGN), markup.mask(F.col("text"))).otherwise(F.struct("text", F.array().cast(markup.MASKED["fragments"].dataType).alias("fragments"))).alias("m")), root, "masked")
    count = F.greatest(F.lit(1), F.ceil(F.length("m.text") / 200)).cast("int")
    piece = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.cast("long").alias("seq"), F.substring(F.col("m.text"), k * 200 + 1, F.lit(200)).alias("text"), (k == count - 1).alias("last"), F.when(k == 0, F.col("m.fragments")).alias("fragments")))
    cut = masked.select(F.col("doc_id").alias("run"), F.inline(piece))
    for half in (0, 1):  # what comes first is written first
        cut.where((F.col("seq") >= 4) == bool(half)).write.parquet(f"{root}/pieces/half={half}")
    stream = spark.readStream.schema(cut.schema.add("half", "integer")).option("maxFilesPerTrigger", 64).parquet(f"{root}/pieces")
    out = _all_of(pieces.restored_stream(stream), root)
    whole = out.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "").alias("text"))
    both = masked.join(whole, masked["doc_id"] == whole["run"], "left")
    want = F.when(F.size("m.fragments") > 0, markup.unmask(F.col("m.text"), F.col("m.fragments"))).otherwise(F.col("m.text"))
    return both.select("doc_id", (F.coalesce("text", F.lit("")) == want).alias("same"))


_add(stream_restored, "SELECT doc_id, true AS same FROM documents")


def stream_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event of a user two sinks show and when: one at most every hour, the other every six, on the events' own time."""
    rows = _run_view(_events(spark, sf_dir)).select("run", "seq", "ts", "type")
    root = shared_folder(spark, "stream-throttled")
    out = pieces.throttled_stream(rows, {"shown": 3_600_000, "stored": 21_600_000}, event_time=True)
    write_updates(out, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema.add("batch", "long")).parquet(f"{root}/out").drop("batch")


_add(stream_throttled, f"""WITH RECURSIVE e AS MATERIALIZED (SELECT run, seq, epoch_us(ts) // 1000 AS ms, type IN ('done', 'error', 'closed') AS last, row_number() OVER (PARTITION BY run ORDER BY seq) AS i, max(epoch_us(ts) // 1000) OVER () AS w FROM {_RUNS}), p(sink, period) AS (VALUES ('shown', 3600000::BIGINT), ('stored', 21600000::BIGINT)),
  f(run, sink, period, i, since) AS (SELECT DISTINCT run, sink, period, 0::BIGINT, NULL::BIGINT FROM e, p UNION ALL SELECT f.run, f.sink, f.period, e.i, CASE WHEN last THEN NULL WHEN since IS NULL OR ms >= since + period THEN ms ELSE since END FROM f JOIN e ON e.run = f.run AND e.i = f.i + 1),
  g AS (SELECT f.*, e.seq, e.w, n.ms, n.last, n.seq AS next_seq FROM f LEFT JOIN e USING (run, i) LEFT JOIN e n ON n.run = f.run AND n.i = f.i + 1)
 SELECT run, sink, since + period AS at, seq FROM g WHERE since IS NOT NULL AND coalesce(ms, w) >= since + period UNION ALL SELECT run, sink, ms, next_seq FROM g WHERE last""")
