"""Semantic blocks of parsed documents: reading payloads, merging, naming.

Raw blocks are rows ``(doc_id, ord, id, kind, raw_type, page, text, markdown, level, bbox,
caption, subcaption, group_caption, asset)`` whatever they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from . import markup
from .sections import islands

RAW = ["doc_id", "ord", "id", "kind", "raw_type", "page", "text", "markdown", "level", "bbox", "caption", "subcaption", "group_caption", "asset"]
INLINE = "array<struct<type:string,content:string>>"
CONTENT_LIST = (
    "array<array<struct<type:string,bbox:array<double>,content:struct<"
    f"level:double,title_content:{INLINE},paragraph_content:{INLINE},page_aside_text_content:{INLINE},page_footnote_content:{INLINE},"
    f"list_items:array<struct<item_content:{INLINE}>>,math_content:string,code_content:{INLINE},code_caption:{INLINE},code_language:string,"
    f"image_caption:{INLINE},image_source:struct<path:string>,table_caption:{INLINE},html:string>>>>"
)
_SPANS = "array<struct<spans:array<struct<content:string,image_path:string>>>>"
LAYOUT = f"struct<pdf_info:array<struct<page_idx:int,page_size:array<double>,para_blocks:array<struct<type:string,bbox:array<double>,lines:{_SPANS},blocks:array<struct<type:string,lines:{_SPANS}>>>>>>>"


def bbox(values: Column) -> Column:
    """The first four numbers, or null if there are fewer or any is none."""
    four = F.slice(values, 1, 4)
    sound = (F.size(values) >= 4) & F.forall(four, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, four)


def inline_text(nodes: Column) -> Column:
    """The text of inline nodes, equations between dollars."""
    one = lambda n: F.when(n["type"] == "equation_inline", F.concat(F.lit("$"), X.js_trim(n["content"]), F.lit("$"))).otherwise(n["content"])
    joined = F.array_join(F.transform(F.filter(F.coalesce(nodes, F.array().cast(INLINE)), lambda n: F.coalesce(n["content"], F.lit("")) != ""), one), "")
    return X.js_trim(F.regexp_replace(F.regexp_replace(joined, "[ \t]+\n", "\n"), f"{P.S}{{2,}}", " "))


def span_text(lines: Column) -> Column:
    texts = F.flatten(F.transform(F.coalesce(lines, F.array().cast(_SPANS)), lambda x: F.transform(F.coalesce(x["spans"], F.array().cast("array<struct<content:string,image_path:string>>")), lambda s: s["content"])))
    return X.squeeze(F.array_join(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), " "))


def span_image(lines: Column) -> Column:
    paths = F.flatten(F.transform(F.coalesce(lines, F.array().cast(_SPANS)), lambda x: F.transform(F.coalesce(x["spans"], F.array().cast("array<struct<content:string,image_path:string>>")), lambda s: s["image_path"])))
    return F.get(F.filter(paths, lambda p: X.js_trim(F.coalesce(p, F.lit(""))) != ""), F.lit(0))


def _figure_markdown(asset: Column, caption: Column) -> Column:
    return X.js_trim(F.concat(F.when(asset != "", F.concat(F.lit("![]("), asset, F.lit(")"))).otherwise(""), F.when(caption != "", F.concat(F.lit("\n\n"), caption)).otherwise("")))


def from_content_list(df: DataFrame, json_col: str = "content_list", prefix: Column | None = None) -> DataFrame:
    """Raw blocks of content lists (JSON: pages of items), of texts of any length. Furniture and empty items only use up an ordinal."""
    pages = F.from_json(json_col, CONTENT_LIST, {"maxStringLen": str((1 << 31) - 1)})
    paged = F.transform(pages, lambda p, k: F.transform(F.filter(F.coalesce(p, F.array().cast(CONTENT_LIST[6:-1])), lambda i: i.isNotNull()), lambda i: F.struct(k.alias("page"), i.alias("item"))))
    items = df.select("doc_id", F.posexplode(F.flatten(paged)).alias("ord", "x")).select("doc_id", "ord", "x.page", "x.item")
    c, kind = F.col("item.content"), F.coalesce(F.col("item.type"), F.lit("unknown"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.nullif(c["level"].cast("int"), F.lit(0)), F.lit(1))))
    entries = F.transform(c["list_items"], lambda i: X.js_trim(F.regexp_replace(inline_text(i["item_content"]), rf"^[•\-*]{P.S}*", "")))
    listed = F.array_join(F.transform(F.filter(entries, lambda e: e != ""), lambda e: F.concat(F.lit("- "), e)), "\n")
    math, code = X.js_trim(F.coalesce(c["math_content"], F.lit(""))), inline_text(c["code_content"])
    nodes = F.when(kind == "image", c["image_caption"]).when(kind == "table", c["table_caption"]).when(kind == "code", c["code_caption"])
    caption = F.when(kind.isin("image", "table", "code"), inline_text(nodes))
    asset = X.asset_path(F.coalesce(c["image_source"]["path"], F.lit("")), prefix if prefix is not None else F.lit(""))
    html = X.js_trim(F.coalesce(c["html"], F.lit("")))
    plain = inline_text(F.when(kind == "paragraph", c["paragraph_content"]).when(kind == "page_aside_text", c["page_aside_text_content"]).otherwise(c["page_footnote_content"]))
    title = inline_text(c["title_content"])
    parts = {"kind": kind, "level": level, "listed": listed, "math": math, "code": code, "caption": caption, "asset": asset, "html": html, "plain": plain, "title": title, "language": X.js_trim(F.coalesce(c["code_language"], F.lit(""))), "bbox": bbox(F.col("item.bbox"))}
    items = X.staged(items.where(~kind.isin("page_number", "page_footer", "header", "footer")), ["doc_id", "ord", "page"], **parts)
    kind, level, listed, math, code, caption, asset, html, plain, title, language = map(F.col, list(parts)[:-1])
    own, group = X.split_caption(caption)
    text = F.when(kind == "title", title).when(kind == "list", F.regexp_replace(listed, "(^|\n)- ", "$1")).when(kind == "equation_interline", math).when(kind == "code", code).when(kind.isin("image", "table"), caption).otherwise(plain)
    markdown = (
        F.when(kind.isin("title", "equation_interline") & (text == ""), "")
        .when(kind == "title", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title))
        .when(kind == "list", listed)
        .when(kind == "equation_interline", F.concat(F.lit("$$\n"), math, F.lit("\n$$")))
        .when(kind == "code", F.concat(F.when(caption != "", F.concat(caption, F.lit("\n\n"))).otherwise(""), F.lit("```"), language, F.lit("\n"), code, F.lit("\n```")))
        .when(kind == "image", _figure_markdown(asset, caption))
        .when(kind == "table", F.array_join(F.filter(F.array(caption, html), lambda x: x != ""), "\n\n"))
        .otherwise(plain)
    )
    known = {"title": "heading", "paragraph": "paragraph", "page_aside_text": "paragraph", "page_footnote": "footnote", "list": "list", "equation_interline": "equation", "code": "code", "image": "figure", "table": "table"}
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in known.items() for x in p)), kind), F.lit("other"))
    out = items.select(
        "doc_id", "ord", F.concat_ws("-", F.lit("cl"), "page", "ord").alias("id"), named.alias("kind"), kind.alias("raw_type"), "page", text.alias("text"), markdown.alias("markdown"),
        F.when(kind == "title", level).alias("level"), "bbox", caption.alias("caption"), F.when(kind == "image", own).alias("subcaption"), F.when(kind == "image", group).alias("group_caption"),
        F.when((kind == "image") & (asset != ""), asset).alias("asset"),
    )
    return X.staged(out, [], **{c: F.col(c) for c in RAW}).where((F.col("markdown") != "") | F.col("raw_type").isin("image"))


def from_layout(df: DataFrame, json_col: str = "layout", prefix: Column | None = None) -> DataFrame:
    """Raw blocks of layout payloads; captions come from nested blocks, caption-like text becomes media."""
    pages = F.explode(F.from_json(json_col, LAYOUT)["pdf_info"])
    blocks = df.select("doc_id", pages.alias("p")).select("doc_id", F.coalesce(F.col("p.page_idx"), F.lit(0)).alias("page"), F.posexplode("p.para_blocks").alias("pos", "b"))
    blocks = blocks.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1)
    kind, nested = F.coalesce(F.col("b.type"), F.lit("unknown")), F.coalesce(F.col("b.blocks"), F.array().cast(f"array<struct<type:string,lines:{_SPANS}>>"))
    child = lambda name: F.get(F.filter(nested, lambda x: x["type"] == name), F.lit(0))["lines"]
    own_text = span_text(F.col("b.lines"))
    caption = F.when(kind == "image", span_text(child("image_caption"))).when(kind == "table", span_text(child("table_caption")))
    like_figure, like_table = (kind == "text") & own_text.rlike(P.FIGURE_CAPTION), (kind == "text") & own_text.rlike(P.TABLE_CAPTION)
    caption = F.coalesce(caption, F.when(like_figure | like_table, own_text))
    asset = F.when(kind == "image", X.asset_path(F.coalesce(span_image(child("image_body")), span_image(F.col("b.lines")), F.lit("")), prefix if prefix is not None else F.lit("")))
    sub, group = X.split_caption(caption)
    named = (
        F.when(kind == "title", "heading").when((kind == "image") | like_figure, "figure").when((kind == "table") | like_table, "table")
        .when(kind.isin("interline_equation", "equation"), "equation").when(kind == "list", "list").when(kind == "page_footnote", "footnote").when(kind == "text", "paragraph").otherwise("other")
    )
    text = F.when(kind.isin("image", "table"), caption).otherwise(own_text)
    markdown = (
        F.when(kind == "title", F.concat(F.lit("## "), own_text)).when(kind == "image", _figure_markdown(asset, caption)).when(named == "equation", F.concat(F.lit("$$\n"), own_text, F.lit("\n$$")))
        .when(kind == "list", F.concat(F.lit("- "), own_text)).otherwise(text)
    )
    raw = F.when(like_figure, "image_caption").when(like_table, "table_caption").otherwise(kind)
    out = blocks.select(
        "doc_id", "ord", F.concat_ws("-", F.lit("layout"), "page", "ord").alias("id"), named.alias("kind"), raw.alias("raw_type"), "page", text.alias("text"), markdown.alias("markdown"), F.when(kind == "title", 2).alias("level"),
        bbox(F.col("b.bbox")).alias("bbox"), caption.alias("caption"), F.when(kind == "image", sub).alias("subcaption"), F.when(like_figure, own_text).when(kind == "image", group).alias("group_caption"), F.when(asset != "", asset).alias("asset"),
    )
    return out.where(~kind_furniture(F.col("raw_type")) & ((F.col("text") != "") | F.col("raw_type").isin("image", "table")))


def kind_furniture(raw_type: Column) -> Column:
    return raw_type.isin("header", "footer", "page_number", "discarded")


def from_markdown(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Raw blocks of Markdown: the fold into blocks, then a mapping of each kind."""
    rows = docs.select("doc_id", F.posexplode(markup.repaired_blocks(F.col(text_col))).alias("pos", "b")).where(X.js_trim(F.col("b.text")) != "")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    kind, raw = F.col("b.kind"), F.col("b.text")
    whole = X.js_trim(raw)
    title, level = X.js_trim(F.regexp_extract(whole, rf"(?s)^(#{{1,6}}){P.S}+(.+)$", 2)), F.length(F.regexp_extract(whole, "^(#{1,6})", 1))
    held = F.filter(F.transform(F.split(raw, "\n"), X.js_trim), lambda x: x != "")
    image = F.get(F.filter(held, lambda x: x.rlike(P.IMAGE_LINE)), F.lit(0))
    figure_caption = X.js_trim(F.array_join(F.filter(held, lambda x: ~x.rlike(P.IMAGE_LINE)), " "))
    table_caption = F.coalesce(F.get(F.filter(held, lambda x: x.rlike(P.TABLE_CAPTION)), F.lit(0)), F.lit(""))
    caption = F.when(kind == "figure", figure_caption).when(kind == "table", table_caption)
    sub, group = X.split_caption(caption)
    squeezed = X.squeeze(raw)
    text = (
        F.when(kind == "heading", F.coalesce(F.nullif(title, F.lit("")), whole)).when(kind == "figure", F.coalesce(F.nullif(figure_caption, F.lit("")), squeezed)).when(kind == "table", table_caption)
        .when(kind == "list", X.squeeze(F.regexp_replace(raw, rf"(?m)^[-*+]{P.S}+", ""))).when(kind.isin("code", "math"), whole).otherwise(squeezed)
    )
    named = F.when(kind == "math", "equation").when(kind == "quote", "other").when(kind == "html", "paragraph").otherwise(kind)
    asset = F.when(kind == "figure", F.nullif(F.regexp_extract(F.coalesce(image, F.lit("")), P.IMAGE_LINE, 2), F.lit("")))
    return rows.select(
        "doc_id", "ord", F.concat_ws("-", F.lit("md"), "ord").alias("id"), named.alias("kind"), F.when(kind == "math", "equation").otherwise(kind).alias("raw_type"), F.lit(0).alias("page"), text.alias("text"),
        F.when(kind == "paragraph", squeezed).otherwise(whole).alias("markdown"), F.when(kind == "heading", F.when(title != "", level).otherwise(2)).alias("level"), F.lit(None).cast("array<double>").alias("bbox"),
        caption.alias("caption"), F.when(kind == "figure", sub).alias("subcaption"), F.when(kind == "figure", group).alias("group_caption"), asset.alias("asset"),
    )


def union_bbox(box: str) -> Column:
    parts = [F.min(F.col(box)[0]), F.min(F.col(box)[1]), F.max(F.col(box)[2]), F.max(F.col(box)[3])]
    return F.when(F.count(box) > 0, F.array(*parts))


def group_figures(blocks: DataFrame) -> DataFrame:
    """Runs of two figures or more with a group caption, or two captions of their own, become one block with children."""
    runs = islands(blocks, ["doc_id"], "ord", F.col("kind") == "figure", "run")
    by = Window.partitionBy("doc_id", "run")
    total = F.min_by(F.when(F.coalesce("group_caption", F.lit("")) != "", F.col("group_caption")), F.when(F.coalesce("group_caption", F.lit("")) != "", F.col("ord"))).over(by)
    subs = F.sum((F.coalesce("subcaption", F.lit("")) != "").cast("int")).over(by)
    marked = runs.withColumn("total", total).withColumn("grouped", (F.col("kind") == "figure") & (F.count("*").over(by) >= 2) & (F.col("total").isNotNull() | (subs >= 2)))
    single = marked.where("not grouped").select(*RAW, F.lit(None).cast("array<string>").alias("children"), F.array("id").alias("source_refs"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"])
    text = F.coalesce(F.first("total"), X.js_trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce(F.nullif("subcaption", F.lit("")), "caption", F.lit("")).alias("v")))), lambda x: x["v"]), " ")))
    group = marked.where("grouped").groupBy("doc_id", "run").agg(
        F.min("ord").alias("ord"), F.concat(F.min_by("id", "ord"), F.lit("-group")).alias("id"), F.lit("figure").alias("kind"), F.lit("figure_group").alias("raw_type"), F.min_by("page", "ord").alias("page"), text.alias("text"),
        F.array_join(F.filter(ordered("markdown"), lambda m: m != ""), "\n\n").alias("markdown"), F.lit(None).cast("int").alias("level"), union_bbox("bbox").alias("bbox"), F.coalesce(F.first("total"), F.lit("")).alias("caption"),
        F.lit(None).cast("string").alias("subcaption"), F.coalesce(F.first("total"), F.lit("")).alias("group_caption"), F.lit(None).cast("string").alias("asset"), ordered("id").alias("children"), ordered("id").alias("source_refs"),
    )
    return single.unionByName(group.drop("run"))


def merge_interrupted(blocks: DataFrame) -> DataFrame:
    """A paragraph that figures or tables cut in two becomes one, placed before them.

    The pairs of a document may not chain: of pairs that share a paragraph, every second one counts.
    """
    by = Window.partitionBy("doc_id").orderBy("ord")
    media = F.col("kind").isin("figure", "table")
    rows = blocks.withColumn("place", F.row_number().over(by)).withColumn("solid", F.when(~media, F.struct("place", "kind", "text", "id")))
    behind = Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)  # read backwards, for frames that shrink are summed anew for each row
    rows = rows.withColumn("next", F.last("solid", ignorenulls=True).over(behind))
    pair = (F.col("kind") == "paragraph") & (F.col("next.kind") == "paragraph") & (F.col("next.place") > F.col("place") + 1) & X.continues_paragraph(F.col("text"), F.col("next.text"))
    rows = rows.withColumn("pair", F.coalesce(pair, F.lit(False)))
    solids = rows.where(~media).withColumn("prev_pair", F.coalesce(F.lag("pair").over(by), F.lit(False)))
    solids = islands(solids, ["doc_id"], "ord", F.col("pair"), "chain")
    nth = F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("ord"))
    solids = solids.withColumn("joins", F.col("pair") & (nth % 2 == 1)).withColumn("gone", F.coalesce(F.lag("joins").over(by), F.lit(False)))
    tail = solids.where("gone").select("doc_id", F.col("id").alias("tail_id"), F.col("markdown").alias("tail_markdown"), F.col("bbox").alias("tail_bbox"), F.col("source_refs").alias("tail_refs"))
    flags = solids.select("doc_id", "id", "joins", "gone", F.when(F.col("joins"), F.col("next.id")).alias("tail_id"), F.when(F.col("joins"), F.col("next.text")).alias("tail_text"))
    out = rows.drop("pair", "solid", "next").join(flags, ["doc_id", "id"], "left").where(~F.coalesce("gone", F.lit(False))).join(tail, ["doc_id", "tail_id"], "left")
    glue = lambda a, b: F.when(F.col("tail_id").isNotNull(), X.js_trim(F.regexp_replace(F.concat(a, F.lit(" "), b), f"{P.S}{{2,}}", " "))).otherwise(a)
    box = F.when(F.col("bbox").isNull(), F.col("tail_bbox")).when(F.col("tail_bbox").isNull(), F.col("bbox")).otherwise(
        F.array(F.least(F.col("bbox")[0], F.col("tail_bbox")[0]), F.least(F.col("bbox")[1], F.col("tail_bbox")[1]), F.greatest(F.col("bbox")[2], F.col("tail_bbox")[2]), F.greatest(F.col("bbox")[3], F.col("tail_bbox")[3]))
    )
    refs = F.when(F.col("tail_refs").isNotNull(), F.concat("source_refs", "tail_refs")).otherwise(F.col("source_refs"))
    return out.select(*(c for c in RAW if c not in ("text", "markdown", "bbox")), glue(F.col("text"), F.col("tail_text")).alias("text"), glue(F.col("markdown"), F.col("tail_markdown")).alias("markdown"), box.alias("bbox"), "children", refs.alias("source_refs"))


def semantic_type(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in P.SEMANTIC_TYPES.items() for x in p)), kind), F.lit("text"))


def assign_ids(blocks: DataFrame) -> DataFrame:
    """Adds ``raw_section, section, order_in_section, semantic_type, semantic_id``.

    Blocks before the first heading are in section 0 as the first heading's are, so ids may repeat;
    ``raw_section`` is -1 there.
    """
    by = Window.partitionBy("doc_id").orderBy("ord")
    raw = F.sum((F.col("kind") == "heading").cast("int")).over(by) - 1
    rows = blocks.withColumn("raw_section", raw).withColumn("section", F.greatest("raw_section", F.lit(0))).withColumn("semantic_type", semantic_type(F.col("kind")))
    inside = Window.partitionBy("doc_id", "raw_section").orderBy("ord")
    typed = Window.partitionBy("doc_id", "raw_section", "semantic_type").orderBy("ord")
    rows = rows.withColumn("order_in_section", F.row_number().over(inside) - 1)
    number = F.when(F.col("semantic_type") == "title", 0).otherwise(F.row_number().over(typed) - 1)
    return rows.withColumn("semantic_id", F.concat_ws("-", F.lit("sec"), "section", "semantic_type", number))


def toc(named: DataFrame) -> DataFrame:
    """``(doc_id, ordinal, level, text, semantic_id)`` of the headings."""
    by = Window.partitionBy("doc_id").orderBy("ord")
    return named.where("kind = 'heading'").select("doc_id", (F.row_number().over(by) - 1).alias("ordinal"), F.coalesce("level", F.lit(2)).alias("level"), "text", "semantic_id")


def anchors(named: DataFrame) -> DataFrame:
    return named.where("bbox is not null").select("doc_id", F.concat("id", F.lit(":anchor:0")).alias("anchor_id"), "semantic_id", F.col("id").alias("block_id"), "page", "bbox", "kind", "raw_type")


def page_sizes(layouts: DataFrame, json_col: str = "layout") -> DataFrame:
    """``(doc_id, page, width, height)``; of a page given twice the later one."""
    rows = layouts.select("doc_id", F.posexplode(F.from_json(json_col, LAYOUT)["pdf_info"]).alias("pos", "p")).select("doc_id", "pos", F.col("p.page_idx").alias("page"), F.col("p.page_size").alias("size"))
    sound = F.col("page").isNotNull() & (F.size("size") >= 2) & F.forall(F.slice("size", 1, 2), lambda x: x.isNotNull() & ~F.isnan(x))
    return rows.where(sound).groupBy("doc_id", "page").agg(F.max_by(F.col("size")[0], "pos").alias("width"), F.max_by(F.col("size")[1], "pos").alias("height"))


def inferred_page_sizes(anchor_rows: DataFrame) -> DataFrame:
    edge = lambda k: F.greatest(F.lit(0.0), F.max(F.col("bbox")[k]) + 24)
    return anchor_rows.groupBy("doc_id", "page").agg(edge(2).alias("width"), edge(3).alias("height"))


def percent_boxes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes in percent of their pages; a page without a size is 612 by 792."""
    joined = rows.join(sizes, ["doc_id", "page"], "left")
    w, h = F.coalesce("width", F.lit(612.0)), F.coalesce("height", F.lit(792.0))
    b = F.col("bbox")
    return joined.withColumns({"left": b[0] / w * 100, "top": b[1] / h * 100, "w": (b[2] - b[0]) / w * 100, "h": (b[3] - b[1]) / h * 100})


def project(payloads: DataFrame, prefix: Column | None = None) -> dict[str, DataFrame]:
    """Blocks, anchors, table of contents and page sizes of documents ``(doc_id, content_list, layout, text)``.

    The content list decides if there is one, then the layout, then the Markdown.
    """
    has_list, has_layout = F.col("content_list").isNotNull(), F.col("layout").isNotNull()
    raw = from_content_list(payloads.where(has_list), prefix=prefix).unionByName(from_layout(payloads.where(~has_list & has_layout), prefix=prefix)).unionByName(from_markdown(payloads.where(~has_list & ~has_layout)))
    blocks = assign_ids(merge_interrupted(group_figures(raw)))
    given = page_sizes(payloads.where(has_layout))
    found = anchors(blocks)
    inferred = inferred_page_sizes(found).join(given.select("doc_id").distinct(), "doc_id", "left_anti")
    source = F.when(has_list, "content-list-v2").when(has_layout, "layout").otherwise("markdown")
    facts = payloads.select("doc_id", source.alias("source"), (~has_list & ~has_layout).alias("low_fidelity"))
    return {"blocks": blocks, "anchors": found, "toc": toc(blocks), "page_sizes": given.unionByName(inferred), "documents": facts}


def first_pages(named: DataFrame) -> DataFrame:
    """``(doc_id, semantic_id, page)``: the page of the first anchor of a semantic id, of ids without one that of the first block."""
    boxed = F.min_by("page", F.when(F.col("bbox").isNotNull(), F.col("ord")))
    return named.groupBy("doc_id", "semantic_id").agg(F.coalesce(boxed, F.min_by("page", "ord")).alias("page"))


def polish_ordinals(items: DataFrame) -> DataFrame:
    """The items of content lists ``(doc_id, page, pos, raw_type, text)`` numbered as polishing does: what is dropped uses up no number."""
    kept = items.where(~F.col("raw_type").isin("page_number", "page_footer") & (X.js_trim(F.coalesce("text", F.lit(""))) != ""))
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1
    return kept.withColumn("ord", ord_).withColumn("id", F.concat_ws("-", F.lit("pp"), "page", "ord"))
