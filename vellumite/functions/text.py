"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

HAN = r"\p{IsHan}"
_INLINE = "[ \t\u00a0]+"
_CLOSE, _OPEN = "，。！？；：、）》】〉", "（《【〈「『"


def staged(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones, evaluated once a row: the generator is a boundary that no projection or filter is moved across."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def js_trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(P.SPACES))


#: Small letters whose capitals are several, and the one letter that stands for these.
_ONE_CAPITAL = [("ß", "ẞ")] + [(c, c.title()) for c in map(chr, range(0x1F80, 0x1FFD)) if len(c.upper()) > 1 and len(c.title()) == 1 and c != c.title()]


def simple_upper(text: Column) -> Column:
    """Capitals letter by letter, so that no text gets longer: "ß" gives "ẞ"; letters without a capital of one letter stay."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, *map("".join, zip(*_ONE_CAPITAL, strict=True))))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def u16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character beyond U+FFFF counts twice."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def u16_slice(text: Column, start: Column, length: Column) -> Column:
    """The part of a text from ``start`` (counted from 0) on, both in UTF-16 units."""
    units = F.substring(F.encode(text, "UTF-16BE"), (start * 2 + 1).cast("int"), (length * 2).cast("int"))
    return F.when(F.octet_length(text) == F.length(text), F.substring(text, (start + 1).cast("int"), length.cast("int"))).otherwise(F.decode(units, "UTF-16BE"))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def squeeze(text: Column) -> Column:
    return js_trim(F.regexp_replace(text, f"{P.S}+", " "))


def dehyphenate(text: Column) -> Column:
    """Joins a word that a line end divides after a hyphen. A word is read from its beginning alone, blanks up to the first line end."""
    return F.regexp_replace(text, rf"(?<![A-Za-z0-9_])([A-Za-z0-9_]++)-[{P.WS}&&[^\n]]*+\n{P.S}*+([A-Za-z0-9_]+)", "$1$2")


def heading_spacing(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?m)^(#{{1,6}})([^{P.WS}#])", "$1 $2")


def list_spacing(text: Column) -> Column:
    """A space behind list markers at line starts; bold text and decimals are markers to it as well."""
    indent = rf"[{P.WS}&&[^\n\r\u2028\u2029]]*+"  # lines before a marker's own need not be read again
    bullets = F.regexp_replace(text, rf"(?m)^({indent}[-*+])({P.NS})", "$1 $2")
    return F.regexp_replace(bullets, rf"(?m)^({indent}\d++[.)])({P.NS})", "$1 $2")


def collapse_blank_lines(text: Column) -> Column:
    return js_trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def join_lines(text: Column) -> Column:
    """The lines of a paragraph, trimmed, in one."""
    lines = F.filter(F.transform(F.split(text, "\n"), js_trim), lambda x: x != "")
    return js_trim(F.regexp_replace(F.array_join(lines, " "), f"{P.S}{{2,}}", " "))


def chinese_spacing(text: Column) -> Column:
    """Drops blanks between Han characters, CJK punctuation and brackets."""
    steps = [(f"({HAN}){_INLINE}({HAN})", "$1$2"), (f"({HAN}){_INLINE}([{_CLOSE}])", "$1$2"), (f"([{_OPEN}]){_INLINE}({HAN})", "$1$2"), (f"({HAN}){_INLINE}([{_OPEN}])", "$1$2"), (f"([{_CLOSE}]){_INLINE}({HAN})", "$1$2"), (f"(?<![ \t\u00a0]){_INLINE}+([，。！？；：、])", "$1")]
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)


def typography(text: Column, language: Column) -> Column:
    return F.when(F.lower(js_trim(language)).isin("chinese", "zh"), chinese_spacing(text)).otherwise(text)


def escape_pattern(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_attribute(text: Column) -> Column:
    pairs = [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def decode_attribute(text: Column) -> Column:
    pairs = [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def image_to_html(line: Column) -> Column:
    """An img tag for a line that is a Markdown image and nothing else, else null."""
    trimmed = js_trim(line)
    part = lambda k: escape_attribute(F.regexp_extract(trimmed, P.IMAGE_LINE, k))
    title = F.when(part(3) != "", F.concat(F.lit(' title="'), part(3), F.lit('"'))).otherwise("")
    return F.when(trimmed.rlike(P.IMAGE_LINE), F.concat(F.lit('<img src="'), part(2), F.lit('" alt="'), part(1), F.lit('"'), title, F.lit(" />")))


def sanitize_output(text: Column) -> Column:
    """What a model's answer holds: the first fenced block, else a tagged one, else all but a lead-in."""
    trimmed = js_trim(text)
    fenced = js_trim(F.regexp_extract(trimmed, rf"(?is)```(?:markdown|md)?{P.S}*(.*?)```", 1))
    tagged = js_trim(F.regexp_extract(trimmed, rf"(?is)<(?:answer|result|markdown)>{P.S}*(.*?)</(?:answer|result|markdown)>", 1))
    bare = js_trim(F.regexp_replace(F.regexp_replace(trimmed, rf"(?i)^Here is the repaired markdown:{P.S}*", ""), rf"(?i)^Repaired markdown:{P.S}*", ""))
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(tagged, F.lit("")), bare)


def replace_first(text: Column, window: Column, repaired: Column) -> Column:
    """The first exact occurrence of a window that is not blank, replaced."""
    at = F.locate(window, text) if isinstance(window, str) else F.expr("0") + F.position(window, text)
    out = F.concat(F.substring(text, F.lit(1), at - 1), repaired, F.substring(text, at + F.length(window), F.length(text)))
    return F.when((js_trim(window) == "") | (at == 0), text).otherwise(out)


def separate_inline_math(text: Column) -> Column:
    """A space between pieces of inline math that touch."""
    return F.regexp_replace(text, r"(\$[^$\n]+\$)(?=\$[^$\n]+\$)", "$1 ")


def looks_like_inline_math(content: Column) -> Column:
    return F.coalesce(*(F.when(content.rlike(p), verdict) for p, verdict in P.INLINE_MATH), F.lit(False))


def relative_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")


def asset_path(path: Column, prefix: Column) -> Column:
    """An asset's path below a prefix; addresses and absolute paths stay as they are."""
    trimmed = F.replace(js_trim(path), F.lit("\\"), F.lit("/"))
    below = F.regexp_replace(F.regexp_replace(trimmed, r"^\.?/", ""), "^/+", "")
    root = F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", "")
    joined = F.when(root != "", F.concat_ws("/", root, below)).otherwise(below)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "").when(trimmed.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//") | trimmed.startswith("/"), trimmed).otherwise(joined)


def format_bytes(n: Column) -> Column:
    out = F.lit(P.NO_SIZE)
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        value = n / float(1024**k)
        text = F.concat(F.when(value >= 100, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value)), F.lit(f" {unit}"))
        fits = n.isNotNull() if k == 3 else n < 1024 ** (k + 1)
        out = F.when(fits, text).otherwise(out)
    return out


def preview(text: Column, most: int) -> Column:
    trimmed = js_trim(F.coalesce(text, F.lit("")))
    cut = F.regexp_replace(F.substring(trimmed, 1, most), rf"{P.S}+\z", "")
    return F.when(F.length(trimmed) <= most, trimmed).otherwise(F.concat(cut, F.lit("...")))


def _lookup(key: Column, table: dict[str, str], other: Column) -> Column:
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.element_at(entries, key), other)


def block_label(block_id: Column) -> Column:
    """``sec-S-type-N`` in words, counted from one."""
    pattern = r"(?i)^sec-(\d+)-([a-z]+)-(\d+)$"
    part = lambda k: F.regexp_extract(block_id, pattern, k)
    kind = F.lower(part(2))
    name = _lookup(kind, P.BLOCK_LABELS, F.lit("片段"))
    section = (part(1).cast("long") + 1).cast("string")
    full = F.when(kind == "title", F.concat(name, section)).otherwise(F.concat(name, section, F.lit("-"), (part(3).cast("long") + 1).cast("string")))
    return F.when(F.coalesce(block_id, F.lit("")) == "", "片段").when(~block_id.rlike(pattern), block_id).otherwise(full)


def status_label(status: Column) -> Column:
    return _lookup(status, P.STATUS_LABELS, status)


def prompt_label(action: Column, question: Column) -> Column:
    asked = js_trim(F.coalesce(question, F.lit("")))
    qa = F.when(asked != "", F.concat(F.lit(P.QUESTION_LABEL_WITH), asked)).otherwise(P.QUESTION_LABEL)
    return F.when(action == "qa", qa).otherwise(_lookup(action, P.PROMPT_LABELS, F.lit(P.OTHER_LABEL)))


def document_key(file_hash: Column, language: Column, tab: Column) -> Column:
    return F.when(tab == "translation", F.concat_ws("::", file_hash, F.lit("translation"), language)).otherwise(F.concat_ws("::", file_hash, F.lit("source")))


def translation_phase(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    return reduce(lambda c, p: F.when(lowered.contains(p[0]), p[1]).otherwise(c), reversed(P.PHASES), F.lit("preparing"))


def localized_status(message: Column, concurrency: Column) -> Column:
    tail = lambda head: F.substring(message, len(head) + 1, 1 << 30)
    lanes = F.when(concurrency > 1, F.concat(F.lit(P.STATUS_LANES[0]), concurrency.cast("string"), F.lit(P.STATUS_LANES[1]))).otherwise(P.STATUS_TRANSLATING)
    batch = F.concat(F.lit(P.STATUS_BATCH[0]), F.regexp_replace(tail("Parallel batch "), "^(.*?) agents", P.STATUS_BATCH[1]))
    said = [(head, F.lit(put)) for head, put in P.STATUS_MESSAGES] + [(head, F.concat(F.lit(put), tail(head))) for head, put in P.STATUS_BEGINS]
    said += [("Translating: ", F.concat(lanes, F.lit(" · "), tail("Translating: "))), ("Parallel batch ", batch)]
    known = F.coalesce(*(F.when(message.startswith(head), put) for head, put in said), F.when(message == "Completed", P.STATUS_DONE), message)
    return F.when(js_trim(F.coalesce(message, F.lit(""))) == "", P.STATUS_WAITING).otherwise(known)


def transition_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_-]", "-")


def language_code(language: Column) -> Column:
    return _lookup(F.lower(js_trim(language)), P.LANGUAGE_CODES, F.upper(js_trim(language)))


def translate_endpoint(base_url: Column, official: Column) -> Column:
    """The translate address of a service: the suffix of the mode in place of the other one."""
    clean = F.regexp_replace(base_url, "/+$", "")
    stem = F.regexp_replace(clean, "(?i)(?:/v2)?/translate$", "")
    free = F.when(F.lower(clean).endswith("/translate") & ~F.lower(clean).endswith("/v2/translate"), clean).otherwise(F.concat(stem, F.lit("/translate")))
    return F.when(official, F.when(F.lower(clean).endswith("/v2/translate"), clean).otherwise(F.concat(stem, F.lit("/v2/translate")))).otherwise(free)


def arxiv_id(text: Column) -> tuple[Column, Column]:
    """The identifier and, or null, the version that an input names."""
    bare = F.regexp_replace(js_trim(text), "(?i)^arxiv:", "")
    page = F.regexp_extract(bare, r"(?i)arxiv\.org/abs/([^/?#]+)", 1)
    file = F.regexp_extract(bare, r"(?i)arxiv\.org/pdf/([^/?#]+?)(?:\.pdf)?$", 1)
    found = F.regexp_replace(F.coalesce(F.nullif(page, F.lit("")), F.nullif(file, F.lit("")), bare), r"(?i)\.pdf$", "")
    version = F.regexp_extract(found, r"(?i)^.*?(v\d+)$", 1)
    return F.regexp_replace(found, r"(?i)^(.*?)v\d+$", "$1"), F.nullif(version, F.lit(""))


def safe_file_name(title: Column, ident: Column) -> Column:
    """A PDF name from a title of at most 80 characters, else from the identifier."""
    clean = squeeze(F.regexp_replace(F.coalesce(title, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]+', " "))
    fallback = F.regexp_replace(ident, r"[^A-Za-z0-9_.-]+", "_")
    return F.concat(F.when(clean != "", F.substring(clean, 1, 80)).otherwise(fallback), F.lit(".pdf"))


def block_kind(text: Column) -> Column:
    """The kind of a block or line by the first rule that fits.

    The rules look at a trimmed text again and again: callers with many lines make it a column of its own
    and use :func:`trimmed_kind`.
    """
    return trimmed_kind(js_trim(text))


def trimmed_kind(t: Column) -> Column:
    """The same of a text without white space at its ends; its first character decides for most."""
    rules = [
        (t == "", "blank"), (~F.substring(t, 1, 1).isin(*P.KIND_BEGINS), "paragraph"), (t.rlike(P.HEADING_LINE), "heading"), (t.rlike(P.FENCE_LINE), "code"), (t.rlike(P.LIST_LINE), "list"), (t.rlike(P.QUOTE_LINE), "quote"),
        (t.rlike(P.IMAGE_LINE) | t.rlike(P.FIGURE_CAPTION) | t.rlike(P.SUBFIGURE_CAPTION), "figure"), (t.rlike(P.TABLE_CAPTION) | t.rlike(P.TABLE_OPEN), "table"), (t.rlike(P.FIGURE_TAG), "figure"),
        (t.rlike(P.TABLE_TAG_START), "table"), (t.rlike(P.MATH_START), "math"), (t.rlike(P.HTML_START), "html"),
    ]
    return reduce(lambda c, r: F.when(r[0], r[1]).otherwise(c), reversed(rules), F.lit("paragraph"))


def is_reference_title(title: Column) -> Column:
    """By substring, so a title with "preferences" counts too."""
    lowered = F.lower(title)
    return reduce(lambda c, w: c | lowered.contains(w), P.REFERENCE_WORDS, F.lit(False))


def split_caption(caption: Column) -> tuple[Column, Column]:
    """The parts of a caption for a subfigure and for its group."""
    t = js_trim(F.coalesce(caption, F.lit("")))
    at = F.length(F.regexp_extract(t, rf"(?is)^(.*?){P.GROUP_CAPTION[4:]}", 1))
    inner = t.rlike(P.GROUP_CAPTION) & (at > 0)
    own = F.when(inner, js_trim(F.substring(t, F.lit(1), at))).when(t.rlike(P.SUBFIGURE_CAPTION), t).when(t.rlike(P.FIGURE_CAPTION), "").otherwise(t)
    group = F.when(inner, js_trim(F.substring(t, at + 1, F.length(t)))).when(t.rlike(P.SUBFIGURE_CAPTION), "").when(t.rlike(P.FIGURE_CAPTION), t).otherwise("")
    return own, group


def continues_paragraph(left: Column, right: Column) -> Column:
    a, b = js_trim(left), js_trim(right)
    return (a != "") & (F.length(b) >= 2) & ~a.rlike(P.SENTENCE_END) & b.rlike(P.CONTINUATION_START)


def locks_term(source: Column, category: Column) -> Column:
    """Is a glossary term kept letter for letter: names, acronyms, codes."""
    t = js_trim(source)
    return (t != "") & (F.lower(F.coalesce(category, F.lit(""))).rlike(P.LOCKED_CATEGORY) | t.rlike("(?s)" + "|".join(P.LOCKED_SOURCES)))


def line_estimate(text: Column, width: int = 30) -> Column:
    return F.greatest(F.size(F.split(text, "\r?\n")), F.ceil(F.length(text) / width).cast("int"), F.lit(1))


def anchor_window(text: Column, start: Column, end: Column, radius: int) -> Column:
    low = F.greatest(F.lit(0), start - radius)
    return F.substring(text, low + 1, F.least(F.length(text), end + radius) - low)
