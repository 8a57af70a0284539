"""Stored records as tables: caches, progress, sessions and what restores a document. Every change is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as Y
from ..functions import text as X

#: Tables that go together when a layer is cleared.
LAYERS = {"workspace": ["documents", "sessions", "conversations"], "knowledge": ["annotations", "glossary", "profiles"]}


def put(stored: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """The stored rows with the given ones in place of those of equal keys; of given rows that repeat a key the last by ``updated_at``."""
    rest = [c for c in given.columns if c != key]
    newest = given.groupBy(key).agg(F.max_by(F.struct(*rest), "updated_at").alias("v")).select(key, "v.*").select(given.columns)
    return stored.join(newest.select(key), key, "left_anti").unionByName(newest)


def drop(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The stored rows without those of the given keys; null keys drop nothing."""
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def cleared(tables: dict[str, DataFrame], layer: str) -> dict[str, DataFrame]:
    """The tables, those of a layer empty."""
    return {name: df.where("false") if name in LAYERS[layer] else df for name, df in tables.items()}


def cached(wanted: DataFrame, cache: DataFrame, key: str = "doc_id", meta_col: str = "meta") -> DataFrame:
    """``(key, has, meta)`` of the wanted keys; a meta text that is no JSON object is null, the entry counts all the same."""
    meta = F.try_parse_json(meta_col)
    held = cache.select(F.col(key).alias("_key"), F.when(F.schema_of_variant(meta).startswith("OBJECT"), F.col(meta_col)).alias("meta"), F.lit(True).alias("has"))
    return wanted.select(key).join(held, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("has", F.lit(False)).alias("has"), "meta")


# ---- progress of translations: (doc_id, language, source_hash, total) and chunks (doc_id, language, idx, text) --------


def started(plan: DataFrame, docs: DataFrame, language: Column) -> DataFrame:
    """``(doc_id, language, source_hash, total)`` of new runs: the hash of the source and the number of its planned chunks."""
    totals = plan.groupBy("doc_id").agg(F.count("*").alias("total"))
    return docs.join(totals, "doc_id").select("doc_id", language.alias("language"), F.md5("text").alias("source_hash"), "total")


def partial_texts(chunks: DataFrame) -> DataFrame:
    """``(doc_id, language, completed, text)``: the finished chunks in their order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return chunks.groupBy("doc_id", "language").agg(F.count("*").alias("completed"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def usable_progress(progress: DataFrame, chunks: DataFrame, docs: DataFrame, language: Column) -> DataFrame:
    """``(doc_id, valid, completed, total, percentage)`` of documents with progress in a language.

    It is valid while the source has the stored hash, if one is stored, and the language is the wanted one.
    """
    rows = progress.join(docs.select("doc_id", F.md5("text").alias("now"), language.alias("wanted")), "doc_id")
    valid = (F.col("source_hash").isNull() | (F.col("source_hash") == F.col("now"))) & (F.col("language") == F.col("wanted"))
    done = chunks.groupBy("doc_id", "language").agg(F.count("*").alias("completed"))
    rows = rows.join(done, ["doc_id", "language"], "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    return rows.select("doc_id", F.coalesce(valid, F.lit(False)).alias("valid"), "completed", "total", F.floor(F.col("completed") / F.nullif("total", F.lit(0)) * 100).cast("int").alias("percentage"))


def finished(progress: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final texts ``(doc_id, language, text)`` of runs whose chunks are all there, and the progress and chunks that remain open."""
    done = partial_texts(chunks).join(progress, ["doc_id", "language"]).where("completed >= total").select("doc_id", "language", "text")
    keys = ["doc_id", "language"]
    return done, progress.join(done, keys, "left_anti"), chunks.join(done, keys, "left_anti")


def planned_blocks(plan: DataFrame) -> DataFrame:
    """Empty blocks of planned chunks."""
    return plan.select("doc_id", "chunk_idx", "chunk_id", "title", "kind", F.lit("").alias("text"), F.lit("planned").alias("state"))


def whole_block(texts: DataFrame, title: str = "Document") -> DataFrame:
    """A text as the single block of its document; blank ones give none."""
    rows = texts.where(X.js_trim(F.col("text")) != "")
    return rows.select("doc_id", F.lit(0).alias("chunk_idx"), F.lit("full-document").alias("chunk_id"), F.lit(title).alias("title"), F.lit("text").alias("kind"), "text", F.lit("completed").alias("state"))


# ---- library ------------------------------------------------------------------------------------------------------------


def latest_session(sessions: DataFrame, scope: str = "scope") -> DataFrame:
    """The newest row of each scope."""
    rest = [c for c in sessions.columns if c != scope]
    return sessions.groupBy(scope).agg(F.max_by(F.struct(*rest), "updated_at").alias("v")).select(scope, "v.*")


def restored(history: DataFrame, snapshots: DataFrame, sessions: DataFrame, finals: DataFrame) -> DataFrame:
    """``(doc_id, status, file_name, language, markdown, progress)``: what opening a job brings back.

    A snapshot's values go before the session's, those before the history's; the text is the final translation's,
    else the snapshot's, else empty.
    """
    s = snapshots.select("doc_id", F.col("status").alias("s_status"), F.col("language").alias("s_language"), F.col("markdown").alias("s_markdown"))
    o = sessions.select("doc_id", F.col("language").alias("o_language"))
    f = finals.select("doc_id", F.col("text").alias("final"))
    rows = history.join(s, "doc_id", "left").join(o, "doc_id", "left").join(f, "doc_id", "left")
    status = F.coalesce("s_status", "status")
    markdown = F.coalesce(*(F.when(X.js_trim(F.col(c)) != "", F.col(c)) for c in ("final", "s_markdown")), F.lit(""))
    progress = F.when(status == "completed", 100).when(status == "parsed", 60).otherwise(30)
    return rows.select("doc_id", status.alias("status"), "file_name", F.coalesce("s_language", "o_language").alias("language"), markdown.alias("markdown"), progress.alias("progress"))


def selection_identity(doc: Column, start: Column, end: Column, text: Column) -> Column:
    """A name for a selection; equal for equal selections."""
    return F.when(doc.isNull(), "none").otherwise(F.concat_ws("::", doc.cast("string"), F.coalesce(start.cast("string"), F.lit("")), F.coalesce(end.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def in_natural_order(names: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``place``: the rank of each name among those of its key, numbers in it by value, cases and accents aside, then as written."""
    from pyspark.sql import Window

    return names.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(Y.natural_key(F.col(name)), name)))
