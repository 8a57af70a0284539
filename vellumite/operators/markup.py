"""The folds of :mod:`vellumite.functions.folds` as Arrow UDFs and table functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import folds as G
from ..functions import patterns as P

_FRAGMENTS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("marker", "content", "kind")]))
MASKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("fragments", _FRAGMENTS)])
BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))
POLISHED = T.StructType([T.StructField("text", T.StringType()), T.StructField("issues", T.ArrayType(T.StringType()))])


def _fold(result: T.DataType, one: Callable) -> Callable[..., Column]:
    """A Column function from a function of values; a null in the first column stays null."""

    def series(first: pd.Series, *rest: pd.Series):
        out = [None if x is None else one(x, *(r.iloc[k] for r in rest)) for k, x in enumerate(first)]
        if isinstance(result, T.StructType):
            return pd.DataFrame([dict.fromkeys(result.names) if x is None else dict(zip(result.names, x, strict=True)) for x in out], columns=result.names)
        return pd.Series(out, dtype=object)

    kind = pd.DataFrame if isinstance(result, T.StructType) else pd.Series

    def one_column(a: pd.Series) -> kind:
        return series(a)

    def two_columns(a: pd.Series, b: pd.Series) -> kind:
        return series(a, b)

    def three_columns(a: pd.Series, b: pd.Series, c: pd.Series) -> kind:
        return series(a, b, c)

    def call(*columns: Column) -> Column:
        shape = (one_column, two_columns, three_columns)[len(columns) - 1]
        shape.__annotations__ = {**dict.fromkeys("abc"[: len(columns)], pd.Series), "return": kind}
        return F.pandas_udf(shape, result)(*columns)

    return call


def _fragment_rows(masked: G.Masked):
    return masked.text, [dict(zip(("marker", "content", "kind"), f, strict=True)) for f in masked.fragments]


def _terms(rows) -> list[G.Term]:
    return [(r["source"], r["target"], r.get("category")) for r in (rows if rows is not None else [])]


split_blocks = _fold(BLOCKS, lambda t: [{"kind": b.kind, "text": b.text} for b in G.split_blocks(t)])
repaired_blocks = _fold(BLOCKS, lambda t: [{"kind": b.kind, "text": b.text} for b in G.split_blocks(G.repair_tables(t))])
draft_paragraphs = _fold(T.ArrayType(T.StringType()), G.draft_paragraphs)
repair_tables = _fold(T.StringType(), G.repair_tables)
decode_escaped_tables = _fold(T.StringType(), G.decode_escaped_tables)
display_math = _fold(T.StringType(), G.display_math)
mask = _fold(MASKED, lambda t: _fragment_rows(G.mask(t)))
unmask = _fold(T.StringType(), lambda t, f: G.unmask(t, [(x["marker"], x["content"], x["kind"]) for x in f]))
lock_terms = _fold(MASKED, lambda t, terms: _fragment_rows(G.lock_terms(t, _terms(terms))))
correct_terms = _fold(T.StringType(), lambda t, terms: G.correct_terms(t, _terms(terms)))
polish = _fold(POLISHED, lambda t: G.polish(t))
polish_deep = _fold(POLISHED, lambda t: G.polish(t, deep=True))
rendered_ids = _fold(T.ArrayType(T.StringType()), lambda blocks: G.rendered_ids([(b["kind"], b["text"]) for b in blocks]))
rewrite_assets = _fold(T.StringType(), G.rewrite_assets)


def guarded(text: Column, sign: str, change: Callable[[Column], Column]) -> Column:
    """Applies a fold only where the text shows a sign that it may matter; other rows send a null to Python."""
    may = text.rlike(sign)
    return F.when(may, change(F.when(may, text))).otherwise(text)


MASK_SIGN = r"(?i)[`$|\\]|<table"
TABLE_SIGN, MATH_SIGN, ESCAPED_SIGN = "<table", r"[\\$]", "&lt;|\"<table"


def layout_walk(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, ordinal, kind, text)`` of captions, texts and titles in layout trees of any depth; what is no JSON has none."""
    import json

    items = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))

    def one(raw):
        try:
            return [{"kind": k, "text": t} for k, t in G.walk_layout(json.loads(raw))]
        except (ValueError, RecursionError):
            return []

    walked = _fold(items, one)(F.col(json_col))
    return df.select(F.col(id_col), F.posexplode(walked).alias("ordinal", "item")).select(id_col, "ordinal", "item.kind", "item.text")


def layout_structure(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``(id, ordinal, block_id, kind, raw_type, text, markdown, heading_level, caption, group_caption)``: the blocks of a layout alone, where no content list is.

    Titles are headings of level 2, captions stand for their image or table; all blocks count as of the first page.
    """
    rows = layout_walk(df, id_col, json_col)
    kind = F.element_at(F.create_map(*(F.lit(x) for p in P.LAYOUT_KINDS.items() for x in p)), F.col("kind"))
    title, caption = F.col("kind") == "title", F.col("kind").isin("image_caption", "table_caption")
    return rows.select(
        id_col, "ordinal", F.concat(F.lit("pp-0-"), F.col("ordinal").cast("string")).alias("block_id"), kind.alias("kind"), F.col("kind").alias("raw_type"), "text",
        F.when(title, F.concat(F.lit("## "), "text")).otherwise(F.col("text")).alias("markdown"), F.when(title, 2).alias("heading_level"),
        F.when(caption, F.col("text")).alias("caption"), F.when(F.col("kind") == "image_caption", F.col("text")).alias("group_caption"),
    )


def allowed_tag(name: Column) -> Column:
    """May a rendered document hold this tag; other ones are shown as text."""
    return F.lower(name).isin(*P.ALLOWED_TAGS)


def tags(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, tag, n, allowed)``: the tag names of a page, how often each occurs and whether it may be rendered."""
    found = F.explode(F.regexp_extract_all(html_col, F.lit(P.TAG_NAME), 1))
    rows = df.select(F.col(id_col), found.alias("raw"))
    counted = rows.groupBy(id_col, F.lower("raw").alias("tag")).agg(F.count("*").alias("n"))
    return counted.withColumn("allowed", allowed_tag(F.col("tag")))
