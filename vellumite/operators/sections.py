"""Lines, sections and size-bounded chunks of Markdown documents.

Order is data: every row has its ordinal. All windows are per document, so their
partitions are as large as one document and never as a source or a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

CHUNK = 5000
HEADING = rf"^#{{1,2}}{P.S}+(.+)"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, line)``, numbered from 0."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, section, title, start, length, content, is_reference)``: cut at headings of level 1 and 2.

    Text before the first heading has the title "Start". ``start`` and ``length`` count UTF-16 units.
    """
    by = Window.partitionBy(id_col).orderBy("line_no")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(docs, id_col, text_col).withColumn("heading", F.col("line").rlike(HEADING))
    rows = rows.withColumn("offset", F.coalesce(F.sum(X.u16_length(F.col("line")) + 1).over(before), F.lit(0)))
    rows = rows.withColumn("cut", (F.col("heading") & (F.col("line_no") > 0)).cast("int")).withColumn("section", F.sum("cut").over(by))
    name = X.js_trim(F.regexp_extract("line", HEADING, 1))
    out = rows.groupBy(id_col, "section").agg(
        F.min("offset").alias("start"),
        F.min_by(F.when(F.col("heading"), name).otherwise("Start"), "line_no").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    return out.select(id_col, "section", "title", "start", X.u16_length(F.col("content")).alias("length"), "content", X.is_reference_title(F.col("title")).alias("is_reference"))


def packed(sizes: Column, blank: Column, most: int) -> Column:
    """Runs of elements ``(first, count)``: a run is closed before it would exceed ``most`` in all.

    A run of blank elements only is never closed by itself, and left out if it is the last. Sizes
    count the separators behind elements.
    """
    elements = F.zip_with(sizes, blank, lambda n, b: F.struct(n.cast("long").alias("n"), b.alias("blank")))
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("solid"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        close = (acc["held"] + x["n"] > most) & acc["solid"]
        starts = F.when(close, F.concat(acc["starts"], F.array(acc["k"]))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), F.when(close, x["n"]).otherwise(acc["held"] + x["n"]).alias("held"), ((acc["solid"] & ~close) | ~x["blank"]).alias("solid"), (acc["k"] + 1).alias("k"))

    def finish(acc: Column) -> Column:
        runs = F.transform(acc["starts"], lambda s, i: F.struct(s.alias("first"), (F.coalesce(F.get(acc["starts"], i + 1), acc["k"]) - s).alias("count")))
        return F.slice(runs, F.lit(1), F.size(runs) - F.when(acc["solid"], 0).otherwise(1))

    return F.aggregate(elements, start, step, finish)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = CHUNK, clean: bool = True) -> DataFrame:
    """``(id, chunk_idx, chunk_id, kind, title, start, length, content)``: sections, the large ones packed from paragraphs.

    Only references are never packed. Repeated chunk ids get a number. Sizes count UTF-16 units.
    """
    src = docs.select(id_col, (X.dehyphenate(F.col(text_col)) if clean else F.col(text_col)).alias(text_col))
    cut = sections(src, id_col, text_col)
    large = (F.col("length") > most) & ~F.col("is_reference")
    paragraphs = F.split("content", f"\n{P.S}*\n")
    sizes = F.transform("paragraphs", lambda p: X.u16_length(p) + 2)
    blank = F.transform("paragraphs", lambda p: X.js_trim(p) == "")
    runs = cut.where(large).withColumn("paragraphs", paragraphs).withColumn("runs", packed(sizes, blank, most))
    parts = runs.select(id_col, "section", "title", "start", "paragraphs", F.posexplode("runs").alias("part", "run"))
    text = F.array_join(F.slice("paragraphs", F.col("run.first") + 1, F.col("run.count")), "\n\n")
    joined = parts.select(id_col, "section", "title", "start", "part", F.concat(text, F.lit("\n\n")).alias("content"))
    shift = F.coalesce(F.sum(X.u16_length(F.col("content"))).over(Window.partitionBy(id_col, "section").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = cut.where(~large).select(id_col, "section", F.lit(0).alias("part"), F.when(F.col("is_reference"), "references").otherwise("text").alias("kind"), "title", "start", "content", F.lit("chunk").alias("stem"), F.col("start").alias("base"))
    big = joined.select(id_col, "section", "part", F.lit("text").alias("kind"), F.concat("title", F.lit(" (cont.)")).alias("title"), (F.col("start") + shift).alias("start"), "content", F.lit("subchunk").alias("stem"), F.col("start").alias("base"))
    every = small.unionByName(big)
    idx = F.row_number().over(Window.partitionBy(id_col).orderBy("section", "part")) - 1
    sequence = F.when(F.col("stem") == "chunk", F.col("chunk_idx")).otherwise(F.col("part"))
    named = every.withColumn("chunk_idx", idx).withColumn("raw_id", F.concat_ws("-", "stem", "base", sequence))
    again = F.row_number().over(Window.partitionBy(id_col, "raw_id").orderBy("chunk_idx")) - 1
    named = named.withColumn("again", again)
    return named.select(id_col, "chunk_idx", F.when(F.col("again") == 0, F.col("raw_id")).otherwise(F.concat_ws("-", "raw_id", "again")).alias("chunk_id"), "kind", "title", "start", X.u16_length(F.col("content")).alias("length"), "content")


def line_kinds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line_no, line, trimmed, kind)`` of each line; the line is trimmed once for all rules."""
    rows = lines(docs, id_col, text_col).withColumn("trimmed", X.js_trim(F.col("line")))
    return rows.withColumn("kind", X.trimmed_kind(F.col("trimmed")))


def islands(df: DataFrame, keys: list[str], order: str, value: Column, name: str = "island") -> DataFrame:
    """Numbers the maximal runs of one value in the order of each key."""
    by = Window.partitionBy(*keys).orderBy(order)
    changed = (~value.eqNullSafe(F.lag(value).over(by))).cast("int")
    return df.withColumn("_changed", F.coalesce(changed, F.lit(1))).withColumn(name, F.sum("_changed").over(by)).drop("_changed")


def reassemble(parts: DataFrame, id_col: str, order: str, text: str) -> DataFrame:
    """``(id, text)``: the parts that are not blank in their order, a blank line between them."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return parts.where(X.js_trim(F.col(text)) != "").groupBy(id_col).agg(F.array_join(F.transform(held, lambda x: x["t"]), "\n\n").alias(text))


def paper_view(docs: DataFrame) -> DataFrame:
    """Documents with headings: a title, and a section heading before every fourth line, every seventh one "References".

    Stands in for parsed papers where the texts have no Markdown of their own.
    """
    body = F.transform(
        F.split(F.col("text"), "\n"),
        lambda line, k: F.when(k % 4 == 0, F.concat(F.when((F.col("doc_id") + k) % 7 == 0, F.lit("## References\n")).otherwise(F.concat(F.lit("## Section "), k.cast("string"), F.lit("\n"))), line)).otherwise(line),
    )
    return docs.select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.array_join(body, "\n\n")).alias("text"))
