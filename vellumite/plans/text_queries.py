"""Queries over whole texts: normalisation, classification, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import markup, sections
from .views import MARKUP_SQL, Query, digest, lit, markup_view, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_W, _NW = P.S, P.NS


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, {lit(rf'^{_W}+|{_W}+$')}, '', 'g')"


def steps_sql(c: str, steps: list[tuple[str, str]]) -> str:
    for pattern, put in steps:
        c = f"regexp_replace({c}, {lit(pattern)}, {lit(put)}, 'g')"
    return c


def _register(name: str, column, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = column(F.col("text"))
        return markup_view(spark, sf_dir).select("doc_id", F.length(out).alias("n_chars"), digest(out))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, length(o) AS n_chars, md5(o) AS digest FROM (SELECT doc_id, {sql} AS o FROM {MARKUP_SQL})"


_HAN, _IN, _CL, _OP = r"\p{Han}", "[ \t ]+", "，。！？；：、）》】〉", "（《【〈「『"
_COLLAPSED = trim_sql(steps_sql("text", [("\n{3,}", "\n\n")]))
_register("newlines", X.normalize_newlines, steps_sql("text", [("\r\n?", "\n")]))
_register("trimmed", X.js_trim, trim_sql("text"))
_register("squeeze_ws", X.squeeze, trim_sql(steps_sql("text", [(f"{_W}+", " ")])))
_register("dehyphenate", X.dehyphenate, steps_sql("text", [(rf"([A-Za-z0-9_]+)-{_W}*\n{_W}*([A-Za-z0-9_]+)", r"\1\2")]))
_register("heading_spacing", X.heading_spacing, steps_sql("text", [(rf"(?m)^(#{{1,6}})([^{P.WS}#])", r"\1 \2")]))
_register("list_spacing", X.list_spacing, steps_sql("text", [(rf"(?m)^({_W}*[-*+])({_NW})", r"\1 \2"), (rf"(?m)^({_W}*\d+[.)])({_NW})", r"\1 \2")]))
_register("collapse_blank", X.collapse_blank_lines, _COLLAPSED)
_joined = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim_sql('x')}), lambda x: x <> ''), ' ')"
_register("join_lines", X.join_lines, trim_sql(steps_sql(_joined, [(f"{_W}{{2,}}", " ")])))
_han = [(f"({_HAN}){_IN}({_HAN})", r"\1\2"), (f"({_HAN}){_IN}([{_CL}])", r"\1\2"), (f"([{_OP}]){_IN}({_HAN})", r"\1\2"), (f"({_HAN}){_IN}([{_OP}])", r"\1\2"), (f"([{_CL}]){_IN}({_HAN})", r"\1\2"), (f"{_IN}([，。！？；：、])", r"\1")]
_register("chinese_spacing", X.chinese_spacing, steps_sql("text", _han))
_register("typography", lambda c: X.typography(c, F.when(F.col("doc_id") % 2 == 0, " Chinese ").otherwise("French")), f"CASE WHEN doc_id % 2 = 0 THEN {steps_sql('text', _han)} ELSE text END")
_register("escape_pattern", X.escape_pattern, steps_sql("text", [(r"([.*+?^${}()|\[\]\\])", r"\\\1")]))
_register("escape_attribute", X.escape_attribute, "replace(replace(replace(replace(text, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')")
_register("decode_attribute", X.decode_attribute, "replace(replace(replace(replace(text, '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')")
_register("preview", lambda c: X.preview(c, 120), f"CASE WHEN length({trim_sql('text')}) <= 120 THEN {trim_sql('text')} ELSE {steps_sql(f'left({trim_sql("text")}, 120)', [(f'{_W}+$', '')])} || '...' END")
_register("transition_name", X.transition_name, steps_sql("text", [("[^a-zA-Z0-9_-]", "-")]))
_window = "substr(text, 11, 20)"
_register(
    "replace_first", lambda c: X.replace_first(c, F.substring(c, 11, 20), F.lit("<<repaired>>")),
    f"CASE WHEN {trim_sql(_window)} = '' THEN text ELSE left(text, strpos(text, {_window}) - 1) || '<<repaired>>' || substr(text, strpos(text, {_window}) + length({_window})) END",
)
_register("context_window", lambda c: X.anchor_window(c, F.lit(50), F.lit(90), 40), "substr(text, 11, least(length(text), 130) - 10)")
_fence = "regexp_extract(t, '(?is)```(?:markdown|md)?" + _W + "*(.*?)```', 1)"
_bare = trim_sql(steps_sql("t", [(rf"(?i)^Here is the repaired markdown:{_W}*", ""), (rf"(?i)^Repaired markdown:{_W}*", "")]))
_register("sanitize_output", X.sanitize_output, f"(SELECT coalesce(nullif({trim_sql(_fence)}, ''), nullif({trim_sql('regexp_extract(t, ' + lit('(?is)<(?:answer|result|markdown)>' + _W + '*(.*?)</(?:answer|result|markdown)>') + ', 1)')}, ''), {_bare}) FROM (SELECT {trim_sql('text')} AS t))")


def _kind_sql(t: str) -> str:
    like = lambda p: f"regexp_matches({t}, {lit(p)})"
    rules = [
        (f"{t} = ''", "blank"), (like(P.HEADING_LINE), "heading"), (like(P.FENCE_LINE), "code"), (like(P.LIST_LINE), "list"), (like(P.QUOTE_LINE), "quote"),
        (f"{like(P.IMAGE_LINE)} OR {like(P.FIGURE_CAPTION)} OR {like(P.SUBFIGURE_CAPTION)}", "figure"), (f"{like(P.TABLE_CAPTION)} OR {like(P.TABLE_OPEN)}", "table"), (like(P.FIGURE_TAG), "figure"),
        (like(P.TABLE_TAG_START), "table"), (like(P.MATH_START), "math"), (like(P.HTML_START), "html"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k in rules) + " ELSE 'paragraph' END"


_LINES_SQL = f"(SELECT doc_id, k - 1 AS line_no, l[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {MARKUP_SQL}), unnest(range(1, len(l) + 1)) AS u(k))"


def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.line_kinds(markup_view(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


QUERIES["line_classify"] = line_classify
ORACLES["line_classify"] = f"SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, {_kind_sql('t')} AS kind FROM (SELECT doc_id, {trim_sql('line')} AS t FROM {_LINES_SQL})) GROUP BY ALL"


def block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.line_kinds(markup_view(spark, sf_dir))
    runs = sections.islands(rows.select("doc_id", "line_no", "kind"), ["doc_id"], "line_no", F.col("kind"))
    return runs.groupBy("doc_id", "island", "kind").agg(F.min("line_no").cast("long").alias("first_line"), F.count("*").alias("n"))


QUERIES["block_islands"] = block_islands
ORACLES["block_islands"] = f"""SELECT doc_id, island, kind, min(line_no) AS first_line, count(*) AS n FROM (
  SELECT *, sum(changed) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (
    SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS changed FROM (
      SELECT doc_id, line_no, {_kind_sql('t')} AS kind FROM (SELECT doc_id, line_no, {trim_sql('line')} AS t FROM {_LINES_SQL})))) GROUP BY ALL"""


def line_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_view(spark, sf_dir).select("doc_id", X.line_estimate(F.col("text")).cast("int").alias("n_lines"))


QUERIES["line_estimate"] = line_estimate
ORACLES["line_estimate"] = f"SELECT doc_id, greatest(len(string_split_regex(text, '\\r?\\n')), ceil(length(text) / 30)::INT, 1)::INT AS n_lines FROM {MARKUP_SQL}"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.lines(markup_view(spark, sf_dir))
    own, group = X.split_caption(F.col("line"))
    image = X.image_to_html(F.col("line"))
    return rows.select("doc_id", "line_no", "line", own.alias("own"), group.alias("grp"), image.alias("image"), X.looks_like_inline_math(F.col("line")).alias("inline_math"), X.is_reference_title(F.col("line")).alias("reference"))


def line_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).where("own <> '' or grp <> ''").select("doc_id", F.col("line_no").cast("long").alias("line_no"), digest(F.col("own"), "own"), digest(F.col("grp"), "grp"))


_cap = "regexp_extract(t, " + lit("(?is)^(.*?)" + P.GROUP_CAPTION[4:]) + ", 1)"
_inner = f"(regexp_matches(t, {lit(P.GROUP_CAPTION)}) AND length({_cap}) > 0)"
_sub, _fig = f"regexp_matches(t, {lit(P.SUBFIGURE_CAPTION)})", f"regexp_matches(t, {lit(P.FIGURE_CAPTION)})"
QUERIES["line_captions"] = line_captions
ORACLES["line_captions"] = f"""SELECT doc_id, line_no, md5(own) AS own, md5(grp) AS grp FROM (SELECT doc_id, line_no,
  CASE WHEN {_inner} THEN {trim_sql(_cap)} WHEN {_sub} THEN t WHEN {_fig} THEN '' ELSE t END AS own,
  CASE WHEN {_inner} THEN {trim_sql(f'substr(t, length({_cap}) + 1)')} WHEN {_sub} THEN '' WHEN {_fig} THEN t ELSE '' END AS grp
  FROM (SELECT doc_id, line_no, {trim_sql('line')} AS t FROM {_LINES_SQL})) WHERE own <> '' OR grp <> ''"""


def image_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).where("image is not null").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "image")


def _esc(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"


_img = lambda k: _esc(f"regexp_extract(t, {lit(P.IMAGE_LINE)}, {k})")
QUERIES["image_html"] = image_html
ORACLES["image_html"] = f"""SELECT doc_id, line_no, '<img src="' || {_img(2)} || '" alt="' || {_img(1)} || '"' || CASE WHEN {_img(3)} <> '' THEN ' title="' || {_img(3)} || '"' ELSE '' END || ' />' AS image
  FROM (SELECT doc_id, line_no, {trim_sql('line')} AS t FROM {_LINES_SQL}) WHERE regexp_matches(t, {lit(P.IMAGE_LINE)})"""


def inline_math_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).groupBy("doc_id").agg(F.count_if("inline_math").alias("n_math"), F.count_if("reference").alias("n_reference"))


_math = f"""CASE WHEN t = '' OR t <> line THEN false WHEN regexp_matches(t, '^\\d+(?:[.,]\\d+)?$') THEN false WHEN regexp_matches(t, '^[A-Za-z]$') THEN true
  WHEN regexp_matches(t, '^[A-Za-z0-9_]+$') AND length(t) > 4 THEN false WHEN regexp_matches(t, {lit(_W)}) AND NOT regexp_matches(t, '[=<>+\\-*/_^\\\\()\\[\\]{{}}]') THEN false
  ELSE regexp_matches(t, '\\\\[a-zA-Z]+|[_^{{}}=<>+\\-*/()\\[\\]]|\\d[A-Za-z]|[A-Za-z]\\d') END"""
_ref = " OR ".join(f"contains(lower(line), {lit(w)})" for w in P.REFERENCE_WORDS)
QUERIES["inline_math_lines"] = inline_math_lines
ORACLES["inline_math_lines"] = f"SELECT doc_id, count(*) FILTER ({_math}) AS n_math, count(*) FILTER ({_ref}) AS n_reference FROM (SELECT doc_id, line, {trim_sql('line')} AS t FROM {_LINES_SQL}) GROUP BY doc_id"


def paragraph_continues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring lines of which the second goes on with the first."""
    rows = sections.lines(markup_view(spark, sf_dir))
    after = rows.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("line").alias("next"))
    return rows.join(after, ["doc_id", "line_no"]).where(X.continues_paragraph(F.col("line"), F.col("next"))).groupBy("doc_id").agg(F.count("*").alias("n"))


QUERIES["paragraph_continues"] = paragraph_continues
ORACLES["paragraph_continues"] = f"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {trim_sql('line')} AS a, {trim_sql('nxt')} AS b FROM (
  SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM {_LINES_SQL}) WHERE nxt IS NOT NULL)
  WHERE a <> '' AND length(b) >= 2 AND NOT regexp_matches(a, {lit(P.SENTENCE_END)}) AND regexp_matches(b, {lit(P.CONTINUATION_START)}) GROUP BY doc_id"""


def mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of each kind in each text."""
    masked = markup_view(spark, sf_dir).where(F.col("text").rlike(markup.MASK_SIGN)).select("doc_id", markup.mask(F.col("text")).alias("m"))
    return masked.select("doc_id", F.explode("m.fragments").alias("f")).groupBy("doc_id", F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("f.content")).alias("n_chars"))


def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markup_view(spark, sf_dir).withColumn("text", X.normalize_newlines(F.col("text")))
    masked = rows.withColumn("m", markup.mask(F.col("text")))
    back = markup.unmask(F.col("m.text"), F.col("m.fragments"))
    return masked.select("doc_id", (back == X.separate_inline_math(F.col("text"))).alias("same"))


def html_table_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.col("text"), F.lit(f"({P.HTML_TABLE})"), 1)
    return markup_view(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_tables"), F.size(F.regexp_extract_all(F.col("text"), F.lit(r"(?s)(\$\$.+?\$\$)"), 1)).cast("long").alias("n_display"))


QUERIES |= {"mask_counts": mask_counts, "mask_roundtrip": mask_roundtrip, "html_table_fragments": html_table_fragments}
ORACLES["mask_roundtrip"] = "SELECT doc_id, true AS same FROM documents"
ORACLES["html_table_fragments"] = f"SELECT doc_id, len(regexp_extract_all(text, {lit(P.HTML_TABLE)})) AS n_tables, len(regexp_extract_all(text, '(?s)\\$\\$.+?\\$\\$')) AS n_display FROM {MARKUP_SQL}"


def _folded(name: str, fold, sign: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = markup.guarded(F.col("text"), sign, fold)
        return markup_view(spark, sf_dir).select("doc_id", digest(out), (out != F.col("text")).alias("changed"))

    QUERIES[name] = run


_folded("repair_tables", markup.repair_tables, markup.TABLE_SIGN)
_folded("escaped_tables", markup.decode_escaped_tables, markup.ESCAPED_SIGN)
_folded("display_math", markup.display_math, markup.MATH_SIGN)


def polish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_view(spark, sf_dir).select("doc_id", markup.polish(F.col("text")).alias("p")).select("doc_id", digest(F.col("p.text")), F.array_join("p.issues", ",").alias("issues"))


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = markup_view(spark, sf_dir).select("doc_id", F.explode(markup.split_blocks(F.col("text"))).alias("b"))
    return blocks.groupBy("doc_id", F.col("b.kind").alias("kind")).agg(F.count("*").alias("n"))


def draft_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live layout of drafts: paragraphs, their heights and the block's stage."""
    rows = markup_view(spark, sf_dir).select("doc_id", F.posexplode(markup.draft_paragraphs(F.col("text"))).alias("k", "paragraph"))
    rows = rows.withColumn("n", X.line_estimate(F.col("paragraph")))
    height = F.greatest(F.lit(96), 32 + 24 + F.sum(F.col("n") * 28) + 14 * (F.count("*") - 1))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum("n").alias("n_lines"), height.cast("long").alias("height"))


QUERIES |= {"polish": polish, "block_kinds": block_kinds, "draft_paragraphs": draft_paragraphs}


def html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tags(table(spark, sf_dir, "pages"), "page_id", "html")


QUERIES["html_tags"] = html_tags
ORACLES["html_tags"] = """SELECT page_id, tag, count(*) AS n, tag IN ('a', 'abbr', 'b', 'blockquote', 'br', 'caption', 'cite', 'code', 'col', 'colgroup', 'dd', 'del', 'details', 'dfn', 'div', 'dl', 'dt', 'em', 'figcaption', 'figure',
  'hr', 'i', 'img', 'input', 'ins', 'kbd', 'li', 'mark', 'ol', 'p', 'pre', 'q', 'rp', 'rt', 'ruby', 's', 'samp', 'small', 'span', 'strike', 'strong', 'sub', 'summary', 'sup', 'table', 'tbody', 'td', 'tfoot', 'th', 'thead', 'time', 'tr', 'tt',
  'ul', 'var', 'wbr') AS allowed FROM (SELECT page_id, lower(u) AS tag FROM (SELECT page_id, unnest(regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9:_-]*)', 1)) AS u FROM pages)) GROUP BY page_id, tag"""


def html_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their tables closed and their assets below an address."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit("\n<table><tr><td>open\n\n")).alias("html"))
    repaired = markup.guarded(F.col("html"), markup.TABLE_SIGN, markup.repair_tables)
    return pages.select("page_id", digest(repaired), digest(markup.rewrite_assets(repaired, F.lit("docs/full.md"), F.lit("/media/x")), "assets"))


QUERIES["html_repair"] = html_repair


def u16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.u16_length(F.col("text")).alias("units"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


QUERIES["u16_lengths"] = u16_lengths
ORACLES["u16_lengths"] = r"SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::INT AS units, sha256(text) AS sha256, md5(text) AS md5 FROM documents"

