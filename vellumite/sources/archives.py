"""ZIP archives as tables: their directories first, then the members that are wanted, in parts.

An archive is never one cell. Its directory is read by ranges from the end of the file, a row for each
member; members are dealt by size over tasks, opened at their offset and inflated in parts of
``PART`` bytes, so one of many gigabytes is read in order with the memory of a part.
"""

from __future__ import annotations

import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import library, markup
from ..session import shared_folder, written

#: Bytes of a part at most, and of the members that one task reads, roughly.
PART, TASK = 8 << 20, 256 << 20
DIRECTORY = "doc_id {}, archive string, member string, path string, size long, error string"
PARTS = "doc_id {}, path string, part int, content binary, error string"
#: What a result says of an archive without Markdown and of one that cannot be read.
NO_MARKDOWN, NOT_READ = "No markdown file found in ZIP", "Result processing failed"
_BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError)


def _open(uri: str):
    """A file that can be read at any place, of any store that Arrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def directory(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(doc_id, archive, member, path, size, error)`` of the members of archives ``(doc_id, archive)``, the latter an URI.

    ``path`` is the member's name as a relative path. Folders, system files and ways out of the archive are left
    out. An archive that cannot be read has one row with the error; a null archive has none.
    """
    kind = archives.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, uri in zip(batch["doc_id"].to_pylist(), batch["archive"].to_pylist(), strict=True):
                if uri is None:
                    continue
                try:
                    with _open(uri) as file, zipfile.ZipFile(file) as z:
                        for info in z.infolist():
                            path = info.filename.replace("\\", "/").lstrip("/")
                            if path and not info.is_dir() and not path.startswith("__MACOSX") and ".." not in path.split("/"):
                                out.append((doc_id, uri, info.filename, path, info.file_size, None))
                except _BROKEN as e:
                    out.append((doc_id, uri, None, None, None, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch["doc_id"].type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "archive", "member", "path", "size", "error"])

    return archives.select("doc_id", "archive").mapInArrow(run, DIRECTORY.format(kind))


def parts(members: DataFrame, part: int = PART) -> DataFrame:
    """``(doc_id, path, part, content, error)`` of members out of :func:`directory`: each in parts of so many bytes, in order.

    A member that cannot be read to its end, its checksum included, has a last row with the error and no content.
    """
    kind = members.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for doc_id, uri, member, path in zip(*(batch[c].to_pylist() for c in ("doc_id", "archive", "member", "path")), strict=True):
                k, error, content = 0, None, b""
                row = lambda k, content, error: pa.RecordBatch.from_arrays([pa.array([doc_id], batch["doc_id"].type), pa.array([path]), pa.array([k], pa.int32()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["doc_id", "path", "part", "content", "error"])  # noqa: E731, B023
                try:
                    with _open(uri) as file, zipfile.ZipFile(file) as z, z.open(member) as stream:
                        while (content := stream.read(part)) or k == 0:
                            yield row(k, content, None)
                            k += 1
                except (KeyError, *_BROKEN) as e:
                    error = str(e)
                if error is not None:
                    yield row(k, None, error)

    return members.select("doc_id", "archive", "member", "path").mapInArrow(run, PARTS.format(kind))


def texts(members: DataFrame) -> DataFrame:
    """``(doc_id, path, text, error)`` of members that are UTF-8 texts; what is grouped are the parts of one."""
    held = parts(members).groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("part", "content")))).alias("held"), F.max("error").alias("error"))
    whole = F.aggregate("held", F.lit(b""), lambda a, p: F.concat(a, p["content"]))
    return held.select("doc_id", "path", F.when(F.col("error").isNull(), F.decode(whole, "UTF-8")).alias("text"), "error")


def entries(archives: DataFrame, root: str = "/api/media") -> DataFrame:
    """``(doc_id, state, error, path, markdown, layout)`` of parsed archives ``(doc_id, archive)``: what goes into the cache.

    The primary Markdown of an archive is the one that :func:`..operators.library.best_markdown` picks; only that member
    is inflated. Its relative images point below ``root`` and the document's id, its math is put for display. ``layout``
    is the address of the preferred layout file. An archive without Markdown and one that cannot be read have failed, one that is null is pending.
    """
    found = written(directory(archives), shared_folder(archives.sparkSession, "archives"), "directory")
    members = found.where("member is not null")
    best = library.best_markdown(members.where(F.lower("path").endswith(".md")).select("doc_id", "path")).select("doc_id", "path")
    chosen = members.join(best, ["doc_id", "path"]).dropDuplicates(["doc_id", "path"])
    read = texts(chosen.repartition("doc_id", "path"))
    base = F.concat(F.lit(f"{root}/"), F.col("doc_id").cast("string"))
    linked = F.when(F.col("text").rlike(r"(?i)!\[|<img"), markup.rewrite_assets(F.col("text"), F.col("path"), base)).otherwise(F.col("text"))
    shown = read.withColumn("linked", linked).withColumn("markdown", markup.guarded(F.col("linked"), markup.MATH_SIGN, markup.display_math))
    layout = library.preferred_path(members.select("doc_id", "path"), F.col("path").rlike("(^|/)layout\\.json$"))
    layout = layout.select("doc_id", F.concat(F.lit(f"{root}/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("path")).alias("layout"))
    asked = archives.groupBy("doc_id").agg(F.bool_and(F.col("archive").isNull()).alias("waits"))
    rows = asked.join(shown.select("doc_id", "path", "markdown", F.col("error").alias("unread")), "doc_id", "left")
    rows = rows.join(found.where("error is not null").select("doc_id", F.col("error").alias("broken")).distinct(), "doc_id", "left").join(layout, "doc_id", "left")
    error = F.when(F.coalesce("broken", "unread").isNotNull(), NOT_READ).when(F.col("path").isNull(), NO_MARKDOWN)
    return rows.select("doc_id", F.when(F.col("waits"), "pending").when(error.isNull(), "done").otherwise("failed").alias("state"), F.when(~F.col("waits"), error).alias("error"), "path", F.when(error.isNull(), F.col("markdown")).alias("markdown"), "layout")
