"""Job history, progress and their merge rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

TRANSIENT = ["uploading", "parsing", "translating"]


def infer_history(files: DataFrame, meta: DataFrame) -> DataFrame:
    """``(doc_id, status, progress, target_lang, file_name, updated_at)`` from the files ``(doc_id, name, mtime)`` of each job.

    A finished translation is complete, a partial one or a parsed text is parsed, anything else is parsing.
    """
    done = F.regexp_extract("name", r"^translation-(.+)\.md$", 1)
    done = F.when((done != "") & ~F.col("name").contains(".partial."), done)
    part = F.nullif(F.regexp_extract("name", r"^translation-(.+)\.partial\.md$", 1), F.lit(""))
    facts = files.groupBy("doc_id").agg(F.min(done).alias("done"), F.min(part).alias("part"), F.bool_or(F.col("name") == "full.md").alias("parsed"), F.max("mtime").alias("mtime"))
    rows = facts.join(meta, "doc_id", "left")
    status = F.when(F.col("done").isNotNull(), "completed").when(F.col("part").isNotNull() | F.col("parsed"), "parsed").otherwise("parsing")
    progress = F.when(status == "completed", 100).when(status == "parsed", 60).otherwise(30)
    return rows.select("doc_id", status.alias("status"), progress.alias("progress"), F.coalesce("done", "part").alias("target_lang"), F.coalesce("file_name", F.lit("Unknown.pdf")).alias("file_name"), F.coalesce("created_at", "mtime").alias("updated_at"))


def persisted_status(status: Column) -> Column:
    return F.when(status == "translating", "parsed").otherwise(status)


def merge_history(server: DataFrame, local: DataFrame) -> DataFrame:
    """Both sides ``(doc_id, status, updated_at)`` merged: the local row wins while it uploads or parses, or is newer and not translating."""
    s = server.select("doc_id", F.struct("status", "updated_at").alias("s"))
    mine = local.select("doc_id", F.struct("status", "updated_at").alias("l"))
    rows = s.join(mine, "doc_id", "full_outer")
    keeps = F.col("l").isNotNull() & (F.col("l.status").isin("uploading", "parsing") | ((F.col("l.updated_at") > F.col("s.updated_at")) & (F.col("l.status") != "translating")))
    only_local = F.struct(persisted_status(F.col("l.status")).alias("status"), F.col("l.updated_at").alias("updated_at"))
    pick = F.when(F.col("s").isNull(), only_local).when(keeps, F.col("l")).otherwise(F.col("s"))
    return rows.select("doc_id", pick.alias("p")).select("doc_id", "p.status", "p.updated_at")


def latest(rows: DataFrame, n: int = 20, order: str = "updated_at", tie: str = "doc_id") -> DataFrame:
    """The n newest rows; a report of a fixed length."""
    return rows.orderBy(F.desc(order), tie).limit(n)


def recovered_status(previous: Column, history: Column, has_source: Column, has_target: Column) -> Column:
    """What an interrupted job is after a restart."""
    by_text = F.when(has_target, "completed").when(has_source, "parsed")
    return F.when(~previous.isin(*TRANSIENT), previous).when(history == "completed", "completed").when(history == "error", F.coalesce(by_text, F.lit("error"))).otherwise(F.coalesce(by_text, F.lit("idle")))


def interrupted_message(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in P.INTERRUPTED.items() for x in pair)), status)


def control_state(parsed: Column, status: Column, finished: Column, resumable: Column) -> Column:
    return F.when(~parsed, "unparsed").when(status == "translating", "active").when(finished, "completed").when(resumable, "resumable").otherwise("untranslated")


def percentage(done: Column, total: Column) -> Column:
    """Whole percent; null of nothing."""
    return F.floor(done / F.nullif(total, F.lit(0)) * 100).cast("int")


def resume_decision(final: Column, partial: Column, valid: Column, done: Column, total: Column) -> Column:
    reason = F.when(final, "complete").when(~partial, "no_progress").when(~valid, "invalid").when(total.isNull(), "corrupted").otherwise("resumable")
    return F.struct(reason.alias("reason"), (reason == "resumable").alias("can_resume"), F.when(reason == "resumable", percentage(done, total)).alias("percentage"))


def rebuild_blocks(partial: DataFrame, progress: DataFrame) -> DataFrame:
    """Cuts the partial text ``(doc_id, text)`` by the lengths of its finished chunks ``(doc_id, idx, length)``, two units apart.

    Lengths and starts count UTF-16 units. A document's chunks meet its text as one array, so the text is joined once.
    """
    by = Window.partitionBy("doc_id").orderBy("idx")
    before = F.coalesce(F.sum(F.col("length") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = progress.withColumn("start", before.cast("int")).groupBy("doc_id").agg(F.collect_list(F.struct("idx", "start", "length")).alias("places"))
    rows = partial.join(places, "doc_id")
    cut = F.transform("places", lambda p: F.struct(p["idx"].alias("idx"), p["start"].alias("start"), X.u16_slice(F.col("text"), p["start"], p["length"]).alias("text")))
    return rows.select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.idx", "p.start", "p.text")


def merged_snapshot(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def best_markdown(files: DataFrame) -> DataFrame:
    """The primary Markdown file of each job by its name and depth; ties go to the shallower, shorter, lesser path."""
    path = F.lower(X.relative_path(F.col("path")))
    base = F.element_at(F.split(path, "/"), -1)
    depth = F.size(F.split(path, "/"))
    score = F.when(path == "full.md", 1000).otherwise(0) + F.when(base == "full.md", 900).otherwise(0) + F.when(base.contains("full"), 180).otherwise(0) + F.when(base.contains("translation"), 140).otherwise(0) + F.when(base.contains("content"), 80).otherwise(0)
    score = score - depth * 10 - F.length(path) / 100
    ranked = files.withColumn("score", score).withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.size(F.split("path", "/")), F.length("path"), "path")))
    return ranked.where("_rank = 1").select("doc_id", "path", "score")


def preferred_path(files: DataFrame, wanted: Column) -> DataFrame:
    ranked = files.where(wanted).withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.size(F.split("path", "/")), F.length("path"), "path")))
    return ranked.where("_rank = 1").drop("_rank")


def frames(blocks: DataFrame, gap: int = 24) -> DataFrame:
    """``(doc_id, idx, top, height, bottom)``: blocks below each other, a gap between them."""
    by = Window.partitionBy("doc_id").orderBy("idx")
    top = F.coalesce(F.sum(F.col("height") + gap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("top", top).select("doc_id", "idx", "top", "height", (F.col("top") + F.col("height")).alias("bottom"))


def visible(frame_rows: DataFrame, top: int, height: int) -> DataFrame:
    over = max(height, 480)
    return frame_rows.where((F.col("bottom") >= max(0, top - over)) & (F.col("top") <= top + height + over))
