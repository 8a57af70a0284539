"""What the structural rules leave open: residual issues, their windows, and the prompt for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .markup import _fold
from .sections import islands

#: Windows for a model in each document, and terms in a prompt, at most.
WINDOWS, TERMS = 3, 12
MESSAGES = {
    "figure-grouping": "Neighbouring subfigures are not gathered in one figure.",
    "media-interruption": "A paragraph still seems to go on behind figures or tables.",
    "unsupported-structure": "Only a part of the structure is known.",
}


def positions(blocks: DataFrame) -> DataFrame:
    """Adds ``place``, counted from 0 in each document, and the text of the heading above."""
    by = Window.partitionBy("doc_id").orderBy("ord")
    heading = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(by)
    return blocks.withColumn("place", F.row_number().over(by) - 1).withColumn("heading", heading)


def residual_issues(blocks: DataFrame, source: Column | None = None) -> DataFrame:
    """``(doc_id, issue_id, kind, heading, first, last, at)`` of merged blocks, by places.

    Figure runs with two captioned figures or more that stayed apart; paragraphs that a pair before
    left cut in two; and, if ``source`` says layout, the first three blocks.
    """
    rows = positions(blocks)
    loose = (F.col("kind") == "figure") & (F.col("raw_type") != "figure_group")
    runs = islands(rows, ["doc_id"], "ord", loose, "run").where(loose)
    captioned = (F.coalesce("subcaption", F.lit("")) != "") | (F.coalesce("group_caption", F.lit("")) != "")
    figures = runs.groupBy("doc_id", "run").agg(
        F.min_by("id", "ord").alias("first_id"), F.min_by("heading", "ord").alias("heading"), F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"), F.count_if(captioned).alias("c")
    ).where("n >= 2 and c >= 2")
    figures = figures.select("doc_id", F.concat(F.lit("figure-"), "first_id").alias("issue_id"), F.lit("figure-grouping").alias("kind"), "heading", "first", "last", F.col("first").alias("at"))
    media = F.col("kind").isin("figure", "table")
    behind = Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)  # read backwards, for frames that shrink are summed anew for each row
    after = F.last(F.when(~media, F.struct("place", "kind", "text")), ignorenulls=True).over(behind)
    pairs = rows.withColumn("next", after).where((F.col("kind") == "paragraph") & (F.col("next.kind") == "paragraph") & (F.col("next.place") > F.col("place") + 1) & X.continues_paragraph(F.col("text"), F.col("next.text")))
    interrupts = pairs.select("doc_id", F.concat(F.lit("interrupt-"), "id").alias("issue_id"), F.lit("media-interruption").alias("kind"), "heading", F.col("place").alias("first"), F.col("next.place").alias("last"), F.col("place").alias("at"))
    out = figures.unionByName(interrupts)
    if source is not None:
        partial = rows.where((source == "layout") & (F.col("place") < 3)).groupBy("doc_id").agg(F.max_by("heading", "place").alias("heading"), F.max("place").alias("last"))
        out = out.unionByName(partial.select("doc_id", F.lit("layout-fallback").alias("issue_id"), F.lit("unsupported-structure").alias("kind"), "heading", F.lit(0).alias("first"), "last", F.lit(1 << 30).alias("at")))
    return out


def issue_windows(blocks: DataFrame, issues: DataFrame) -> DataFrame:
    """``(doc_id, issue_id, kind, heading, current, context, block_ids, at)``: the Markdown of each issue, and with a block more on either side."""
    rows = positions(blocks).select("doc_id", "place", "id", X.js_trim(F.col("markdown")).alias("markdown"))
    near = issues.join(rows, "doc_id").where("place between first - 1 and last + 1")
    inside = F.col("place").between(F.col("first"), F.col("last"))
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep & (F.col("markdown") != ""), F.struct("place", "markdown")))), lambda x: x["markdown"]), "\n\n")
    ids = F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("place", "id")))), lambda x: x["id"])
    out = near.groupBy("doc_id", "issue_id", "kind", "heading", "at").agg(joined(inside).alias("current"), joined(F.lit(True)).alias("context"), ids.alias("block_ids"))
    return out.where("current <> ''")


def _apart(windows) -> list[bool]:
    used: set[str] = set()
    out = []
    for ids in windows:
        free = used.isdisjoint(ids)
        used.update(ids if free else ())
        out.append(free)
    return out


_keep_apart = _fold(T.ArrayType(T.BooleanType()), _apart)


def first_windows(windows: DataFrame, n: int = WINDOWS) -> DataFrame:
    """The first n windows of each document that share no block with an earlier one; the n bounds a model's work."""
    held = F.array_sort(F.collect_list(F.struct("at", "issue_id", "kind", "heading", "current", "context", "block_ids")))
    rows = windows.groupBy("doc_id").agg(held.alias("w"))
    rows = rows.withColumn("keep", _keep_apart(F.transform("w", lambda x: x["block_ids"])))
    kept = F.slice(F.filter(F.arrays_zip("w", "keep"), lambda x: x["keep"]), 1, n)
    return rows.select("doc_id", F.posexplode(kept).alias("k", "x")).select("doc_id", "k", "x.w.*")


def model_gate(issues: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc_id, use_model, reason)`` of documents with issues: a model helps where a window is."""
    first = issues.groupBy("doc_id").agg(F.min_by("kind", "at").alias("reason"))
    have = windows.select("doc_id").distinct().withColumn("use_model", F.lit(True))
    rows = first.join(have, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("use_model", F.lit(False)).alias("use_model"), F.when(F.col("use_model"), F.col("reason")).otherwise("no-issue-windows").alias("reason"))


def prompt(kind: Column, heading: Column, current: Column, context: Column, terms: Column | None = None, language: Column | None = None) -> Column:
    """What a model is asked for a window; empty parts are left out."""
    listed = F.array_join(F.transform(F.slice(terms, 1, TERMS), lambda t: F.concat(F.lit("- "), t["source"], F.lit(" => "), t["target"])), "\n") if terms is not None else F.lit("")
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), c))
    return F.concat_ws(
        "\n\n", F.lit("Repair the structure of this Markdown window and nothing else. Keep formulas, tables, code, citations and numbers. Return the fragment alone."), F.concat(F.lit("Issue: "), kind),
        F.concat(F.lit("Section: "), F.coalesce(heading, F.lit("unknown"))), part("Language", language if language is not None else F.lit("")), part("Terms", listed), part("Window", current), part("Context", context),
    )


def summary(issues: Column, n_residual: Column) -> Column:
    """Messages of a polish run: one for each kind of repair, and one for what is left."""
    repairs = F.transform(F.array_distinct(issues), lambda i: F.concat(F.lit("Repaired: "), F.replace(i, F.lit("-"), F.lit(" "))))
    none = F.array(F.lit("Nothing needed repair."))
    left = F.when(n_residual > 0, F.array(F.concat(F.lit("Open structures: "), n_residual.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.when(F.size(issues) > 0, repairs).otherwise(none), left)


def joined_blocks(blocks: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the Markdown of the blocks that are not blank, trimmed, a blank line between them."""
    text = X.js_trim(F.col("markdown"))
    held = F.array_sort(F.collect_list(F.when(text != "", F.struct("ord", text.alias("t")))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(held, lambda x: x["t"]), "\n\n").alias("text"))


def repaired_windows(texts: DataFrame, repairs: DataFrame) -> DataFrame:
    """Texts ``(doc_id, text)`` with the answers ``(doc_id, k, current, answer)`` for their windows put in, in the order of ``k``.

    An answer is cleaned of what models add; blank ones change nothing. A window goes in where it first occurs.
    """
    given = repairs.select("doc_id", F.struct("k", "current", X.sanitize_output(F.col("answer")).alias("answer")).alias("r")).where("r.answer <> ''")
    held = given.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))

    def put(text: Column, r: Column) -> Column:
        at = F.position(r["current"], text)
        out = F.concat(F.substring(text, F.lit(1), at - 1), r["answer"], F.substring(text, at + F.length(r["current"]), F.length(text)))
        return F.when((at == 0) | (X.js_trim(r["current"]) == ""), text).otherwise(out)

    rows = texts.join(held, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("rs").isNull(), F.col("text")).otherwise(F.aggregate("rs", F.col("text"), put)).alias("text"))


def on_load(raw: Column, polished: Column) -> Column:
    """What is shown of a text that is polished on load: the raw text, and the polished one if it differs."""
    return F.struct(raw.alias("raw"), F.when(~polished.eqNullSafe(raw), polished).alias("polished"))
