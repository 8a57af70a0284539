"""What services send and want to be sent: answers read tolerantly, requests built from what is there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as X


def _text_at(value: Column, path: str) -> Column:
    """The string at a path of a VARIANT; null for anything that is no string."""
    there = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(there) == "STRING", F.try_variant_get(value, path, "string"))


def message_text(content: Column) -> Column:
    """The text of a chat message's content given as JSON: a string, or the text parts of a list joined; else empty."""
    value = F.try_parse_json(content)
    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda p: F.coalesce(_text_at(p, "$"), F.when(_text_at(p, "$.type") == "text", _text_at(p, "$.text")), F.lit("")))
    return F.coalesce(_text_at(value, "$"), F.array_join(parts, ""), F.lit(""))


def translation_text(answer: Column) -> Column:
    """The translation in a service's JSON answer, the first of its three places that is not blank; else null."""
    value = F.try_parse_json(answer)
    found = [_text_at(value, p) for p in ("$.data", "$.translation", "$.translations[0].text")]
    return F.coalesce(*(F.when(X.js_trim(t) != "", t) for t in found))


def translation_request(text: Column, target: Column, official: Column, source: Column, glossary: Column) -> Column:
    """The body of a translation request; an official service gets source and glossary where they are set.

    A glossary without a source language is an error there.
    """
    source_code = F.when(X.js_trim(F.coalesce(source, F.lit(""))) != "", X.language_code(source))
    named = F.nullif(X.js_trim(F.coalesce(glossary, F.lit(""))), F.lit(""))
    full = F.to_json(F.struct(F.array(text).alias("text"), X.language_code(target).alias("target_lang"), source_code.alias("source_lang"), named.alias("glossary_id")))
    plain = F.to_json(F.struct(text.alias("text"), F.lit("AUTO").alias("source_lang"), X.language_code(target).alias("target_lang")))
    bad = F.raise_error(F.lit("a glossary needs a source language"))
    return F.when(official & named.isNotNull() & source_code.isNull(), bad).when(official, full).otherwise(plain)


def parser_entry(name: Column, data_id: Column, ocr: Column, pages: Column) -> Column:
    """A file of a parser's batch as JSON; what is not set is left out."""
    given = lambda c: F.nullif(X.js_trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.to_json(F.struct(name.alias("name"), given(data_id).alias("data_id"), ocr.alias("is_ocr"), given(pages).alias("page_ranges")))


def profile_error(kind: Column, name: Column, url: Column, model: Column, source: Column, glossary: Column, capabilities: Column) -> Column:
    """What a provider profile lacks: required, source or capabilities; null for a sound one."""
    blank = lambda c: X.js_trim(F.coalesce(c, F.lit(""))) == ""
    plain = F.coalesce(kind, F.lit("")) == "deeplx"
    return (
        F.when(blank(name) | blank(url) | blank(model), "required").when(plain & ~blank(glossary) & blank(source), "source")
        .when(~plain & (F.coalesce(F.size(capabilities), F.lit(0)) < 1), "capabilities")
    )


def saved_profile(kind: Column, url: Column, capabilities: Column) -> Column:
    """The parts of a profile that saving changes: its address without slashes at the end, and what it can do."""
    return F.struct(F.regexp_replace(X.js_trim(url), "/+$", "").alias("url"), F.when(kind == "deeplx", F.array(F.lit("translate"))).otherwise(capabilities).alias("capabilities"))


def streams_in_pieces(kind: Column) -> Column:
    """Does a provider send a translation piece by piece; plain translation services do not."""
    return F.coalesce(kind, F.lit("")) != "deeplx"


def template_url(url: Column, key: Column) -> Column:
    """An address with its key put in; one that asks for a key and gets none is an error."""
    mark, given = "{{apiKey}}", X.js_trim(F.coalesce(key, F.lit("")))
    filled = F.replace(X.js_trim(url), F.lit(mark), F.url_encode(given))
    return F.when(url.contains(mark) & (given == ""), F.raise_error(F.lit("the address needs a key"))).otherwise(F.regexp_replace(filled, "/+$", ""))


def stream_unsupported(status: Column, message: Column) -> Column:
    """Does an error say that a service cannot stream, so that a whole answer should be asked for."""
    low = F.lower(F.coalesce(message, F.lit("")))
    said = low.rlike("unsupported|not support|invalid|disabled")
    return (F.coalesce(status, F.lit(0)).isin(0, 400, 404, 405, 422, 501)) & low.contains("stream") & said


def heading_gap(piece: Column) -> Column:
    """A blank line before headings within a piece of a stream, in place of the blanks after the character before.

    Blanks are read once, from that character; where there is none, or it was taken with the heading before, the first of them is kept.
    """
    first = rf"\G(\n*+[{P.WS}&&[^\n]])|([^{P.WS}])"
    return F.regexp_replace(piece, rf"(?:{first}){P.S}*+(#{{1,6}}{P.S})", "$1$2\n\n$3")


def natural_key(name: Column) -> Column:
    """A key by which numbers in names sort by value, cases and accents aside."""
    parts = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 24, "0")).otherwise(p))
    return F.collate(F.array_join(parts, ""), "UNICODE_CI_AI")


def parse_progress(percentage: Column) -> Column:
    """The progress of a job while its parser runs: 30 to 70."""
    return 30 + percentage * 0.4


def storage_ratio(usage: Column, quota: Column) -> Column:
    """Used share of the quota; null where either is missing or nothing."""
    return F.nullif(usage, F.lit(0)) / F.nullif(quota, F.lit(0))
