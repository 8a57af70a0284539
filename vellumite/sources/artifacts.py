"""Readers of uploads, archives, glossaries and metadata; all through Spark's own readers."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, path, content)``: files named by the SHA-256 of their bytes, each content once, at its least path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.sha2("content", 256).alias("doc_id"), "path")
    first = named.groupBy("doc_id").agg(F.min("path").alias("path"))  # contents of copies are not shuffled
    return files.select("path", "content").join(first, "path").select("doc_id", "path", "content")


def unparsed(found: DataFrame, parsed: DataFrame) -> DataFrame:
    """Uploads that have no parsed text yet."""
    return found.join(parsed.select("doc_id"), "doc_id", "left_anti")


def glossaries(spark: SparkSession, path: str) -> DataFrame:
    """``(source, target, category)`` of all CSV files of a folder, without headers; the category is the file's name.

    Rows without a source or target are dropped, further cells ignored.
    """
    rows = spark.read.schema("source string, target string").option("mode", "PERMISSIVE").csv(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.csv$", "")
    rows = rows.select(X.js_trim(F.col("source")).alias("source"), X.js_trim(F.col("target")).alias("target"), name.alias("category"))
    return rows.where("source <> '' and target <> ''")


def user_glossary(texts: DataFrame, compat: bool = False) -> DataFrame:
    """``(id, line_no, source, target, category, enabled)`` of glossary files given as texts ``(id, text)``.

    A first line with "source" in its first cell is a header. Quoted cells may hold commas; ``compat``
    splits at every comma and drops one quote at either end.
    """
    rows = texts.select("id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).withColumn("line", X.js_trim(F.col("line"))).where("line <> ''")
    if compat:
        cells = F.transform(F.split("line", ","), lambda c: F.regexp_replace(X.js_trim(c), '^"|"$', ""))
        rows = rows.select("id", "line_no", *(F.coalesce(F.get(cells, F.lit(k)), F.lit(d)).alias(c) for k, (c, d) in enumerate((("source", ""), ("target", ""), ("category", ""), ("on", "true")))))
    else:
        cell = F.from_csv("line", "source string, target string, category string, on string", {"escape": '"'})
        rows = rows.withColumn("c", cell).select("id", "line_no", *(F.coalesce(X.js_trim(F.col(f"c.{c}")), F.lit(d)).alias(c) for c, d in (("source", ""), ("target", ""), ("category", ""), ("on", "true"))))
    first = F.col("line_no") == F.min("line_no").over(Window.partitionBy("id"))
    header = first & F.lower("source").contains("source")
    kept = rows.withColumn("header", header).where("not header and source <> '' and target <> ''")
    return kept.select("id", "line_no", "source", "target", F.nullif("category", F.lit("")).alias("category"), (F.col("on") != "false").alias("enabled"))


def arxiv_entries(feeds: DataFrame) -> DataFrame:
    """``(id, arxiv_id, version, title, summary, authors, pdf_url)`` of the first entry of Atom feeds ``(id, xml)``."""
    entry = F.regexp_extract("xml", r"(?is)<entry>(.*?)</entry>", 1)
    rows = feeds.select("id", entry.alias("e")).where("e <> ''")
    one = lambda tag: X.squeeze(F.regexp_extract("e", rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    resolved = F.regexp_extract(one("id"), r"(?i)/abs/([^/?#]+)$", 1)
    authors = F.transform(F.regexp_extract_all("e", F.lit(r"(?is)<name>(.*?)</name>"), 1), X.squeeze)
    version = F.nullif(F.regexp_extract(resolved, r"(?i)(v\d+)$", 1), F.lit(""))
    return rows.select("id", F.regexp_replace(resolved, r"(?i)v\d+$", "").alias("arxiv_id"), version.alias("version"), one("title").alias("title"), one("summary").alias("summary"), authors.alias("authors"), F.concat(F.lit("https://arxiv.org/pdf/"), resolved, F.lit(".pdf")).alias("pdf_url"))


def archive_members(archives: DataFrame, most: int = 1 << 28) -> DataFrame:
    """``(doc_id, path, content, error)`` of the files in ZIP archives ``(doc_id, content)``; folders and system files are skipped.

    A null archive gives no rows; one that cannot be read, a member that cannot, and a member of over ``most``
    bytes (which a task must hold) give a row with the error and no content.
    """

    def members(raw: bytes):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                name = info.filename.replace("\\", "/").lstrip("/")
                if info.is_dir() or name.startswith("__MACOSX") or ".." in name.split("/"):
                    continue
                if info.file_size > most:
                    yield name, None, f"over {most} bytes"
                    continue
                try:
                    yield name, z.read(info), None
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                    yield name, None, str(e)

    def run(frames):
        for frame in frames:
            for doc_id, raw in zip(frame["doc_id"], frame["content"], strict=True):
                if raw is None:
                    continue
                try:
                    for name, content, error in members(raw):
                        yield pd.DataFrame({"doc_id": [doc_id], "path": [name], "content": [content], "error": [error]})
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame({"doc_id": [doc_id], "path": [None], "content": [None], "error": [str(e)]})

    return archives.select("doc_id", "content").mapInPandas(run, f"doc_id {archives.schema['doc_id'].dataType.simpleString()}, path string, content binary, error string")


def parser_options(conf: dict[str, str]) -> dict:
    """Typed options of the parser from text settings; formats are lower-case and distinct."""
    truth = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
    formats = [f.strip().lower() for f in conf.get("extra_formats", "html,latex").split(",") if f.strip()]
    flags = {k: truth[v.strip().lower()] for k, v in conf.items() if k in ("ocr", "formula", "table") and v.strip().lower() in truth}
    return {"model": conf.get("model", "vlm"), "extra_formats": list(dict.fromkeys(formats)), **flags}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of whole text files; a folder without any gives none."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def polish_sources(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``(doc_id, markdown, content_list, layout, prefix)`` of documents ``(doc_id, given)`` by their files ``(doc_id, path, text)``.

    Of the files of a name the one least deep counts, then the shortest path, then the least. Given Markdown goes
    before the file's; a JSON text that is none is null.
    """
    wanted = {"content_list": "content_list_v2.json", "layout": "layout.json", "markdown": "full.md"}
    base = F.element_at(F.split("path", "/"), -1)
    rank = F.struct(F.size(F.split("path", "/")), F.length("path"), "path")
    best = files.groupBy("doc_id").agg(*(F.min_by(F.when(base == name, F.col("text")), F.when(base == name, rank)).alias(f"_{c}") for c, name in wanted.items()))
    rows = docs.join(best, "doc_id", "left")
    sound = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.col(c))
    markdown = F.coalesce(F.nullif(X.js_trim(F.coalesce("given", F.lit(""))), F.lit("")), X.js_trim(F.coalesce("_markdown", F.lit(""))))
    return rows.select("doc_id", markdown.alias("markdown"), sound("_content_list").alias("content_list"), sound("_layout").alias("layout"), F.concat(F.lit("/api/media/"), F.col("doc_id").cast("string")).alias("prefix"))


def media_paths(asked: DataFrame, files: DataFrame) -> DataFrame:
    """``(asked, path, status)`` of asked paths below a root of files ``(path)``: 200, 403 for a way out of the root, 404.

    Parts ``.`` and ``..`` are resolved first. An ``original.pdf`` that is missing is served by the least file of its folder
    that ends with ``_origin.pdf``.
    """
    parts = F.filter(F.split(F.replace("asked", F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    state = F.struct(F.array().cast("array<string>").alias("held"), F.lit(False).alias("out"))
    step = lambda a, p: F.when(p != "..", F.struct(F.concat(a["held"], F.array(p)).alias("held"), a["out"].alias("out"))).otherwise(
        F.struct(F.slice(a["held"], F.lit(1), F.greatest(F.size(a["held"]) - 1, F.lit(0))).alias("held"), (a["out"] | (F.size(a["held"]) == 0)).alias("out")))
    rows = X.staged(asked, ["asked"], way=F.aggregate(parts, state, step))
    rows = rows.select("asked", F.array_join("way.held", "/").alias("full"), F.col("way.out").alias("out"))
    have = files.select(F.col("path").alias("full")).distinct().withColumn("there", F.lit(True))
    legacy = files.where(F.col("path").endswith("_origin.pdf")).groupBy(F.regexp_replace("path", "[^/]*$", "").alias("folder")).agg(F.min("path").alias("legacy"))
    folder = F.when(F.col("full").rlike("(^|/)original\\.pdf$"), F.regexp_replace("full", "[^/]*$", ""))
    met = rows.join(have, "full", "left").withColumn("folder", folder).join(legacy, "folder", "left")
    path = F.when(F.col("there"), F.col("full")).otherwise(F.col("legacy"))
    status = F.when(F.col("out"), 403).when(path.isNotNull(), 200).otherwise(404)
    return met.select("asked", F.when(status == 200, path).alias("path"), status.alias("status"))
