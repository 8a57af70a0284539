"""Quotes, anchors, conversations and their exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def resolve_anchor(text: Column, exact: Column, start: Column, end: Column) -> Column:
    """``struct(start, end)`` of a quote: its position while the text there is the quote, else its first occurrence, else null."""
    wanted = X.js_trim(F.coalesce(exact, F.lit("")))
    there = F.substring(text, start + 1, end - start)
    fits = start.isNotNull() & (end > start) & (end <= F.length(text)) & ((wanted == "") | (X.js_trim(there) == wanted))
    at = F.position(wanted, text)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.when(fits, span(start, end)).when((wanted != "") & (at > 0), span(at - 1, at - 1 + F.length(wanted)))


def snapshot(text: Column, start: Column, end: Column, edge: int = 40, radius: int = 1200) -> Column:
    """A selection with what stands around it."""
    return F.struct(
        F.substring(text, start + 1, end - start).alias("exact"), F.substring(text, F.greatest(F.lit(0), start - edge) + 1, F.least(start, F.lit(edge))).alias("prefix"),
        F.substring(text, end + 1, F.lit(edge)).alias("suffix"), X.anchor_window(text, start, end, radius).alias("context"),
    )


#: Bits of the filter of quotes' keys (8 MB) and bytes of texts hashed at once.
KEY_BITS, PORTION = 1 << 26, 1 << 20


def _window_keys(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on."""
    part, width = data.astype(np.uint64) + np.uint64(1), 1
    whole, held = None, 0
    while True:
        power = np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64))
        if gram & width:
            n = len(data) - held - width + 1
            if n <= 0:
                return np.zeros(0, np.int64)
            whole, held = part if whole is None else whole[:n] * power + part[held : held + n], held + width
        if 2 * width > gram:
            break
        part, width = part[:-width] * power + part[width:], 2 * width
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (whole ^ (whole >> np.uint64(29))).view(np.int64)


def _first_keys(gram: int):
    """Of rows (quote_id, quote): the key of each quote's first bytes."""

    def run(batches):
        for batch in batches:
            keys = [int(_window_keys(np.frombuffer(q.encode()[:gram], np.uint8), gram)[0]) for q in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["quote_id", "quote", "key"])

    return run


def _held_keys(gram: int, filled):
    """Of rows (id, text): the texts with keys that pass the filter, each key once, whatever stands before its place."""

    def run(batches):
        bits = np.frombuffer(filled.value, np.uint8)
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            found: list[list[int]] = []
            i = 0
            while i < len(raw):
                j, size = i, 0
                while j < len(raw) and (j == i or size + len(raw[j]) <= PORTION):
                    size += len(raw[j])
                    j += 1
                length = np.array([len(x) for x in raw[i:j]])
                key = _window_keys(np.frombuffer(b"".join(raw[i:j]), np.uint8), gram)
                place = key & (KEY_BITS - 1)
                at = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                end = np.cumsum(length)
                owner = np.searchsorted(end, at, "right")
                inside = at + gram <= end[owner]
                keys: list[set[int]] = [set() for _ in range(j - i)]
                for o, k in zip(owner[inside].tolist(), key[at[inside]].tolist(), strict=True):
                    keys[o].add(k)
                found += [sorted(k) for k in keys]
                i = j
            some = np.flatnonzero([len(k) > 0 for k in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), pa.array([found[k] for k in some], pa.list_(pa.int64()))], names=["id", "text", "keys"])

    return run


#: Bytes of the keys by which quotes are found: each quote goes by the longest that it has.
GRAMS = (24, 8, 3, 1)


def quotes_in(texts: DataFrame, quotes: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """``(id, quote_id, start)``: the first place of each quote that a text contains.

    Quotes are taken in classes by length, each with keys of its own length; a class without quotes
    costs nothing. No text meets all quotes.
    """
    size = F.length("quote")
    q, out = quotes.where("quote <> ''").select("quote_id", "quote"), None
    counts = q.agg(*(F.count_if((size >= g) & (size < above)).alias(str(g)) for g, above in zip(grams, (1 << 31, *grams), strict=False))).head()
    for g, above in zip(grams, (1 << 31, *grams), strict=False):
        if counts[str(g)]:
            found = _quotes_of_a_length(texts, q.where((size >= g) & (size < above)), id_col, text_col, g)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.where("false").crossJoin(q.where("false")).select(id_col, "quote_id", F.lit(0).alias("start"))


def _quotes_of_a_length(texts: DataFrame, q: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """``(id, quote_id, start)`` of quotes of ``gram`` characters or more.

    A contained quote shares its first ``gram`` bytes with some place of the text, whatever stands before
    it. All places are hashed; those whose hash passes a filter of the quotes' (of a fixed size) are joined
    with them by equality and the containment is checked after.
    """
    keyed = q.mapInArrow(_first_keys(gram), f"quote_id {q.schema['quote_id'].dataType.simpleString()}, quote string, key long")
    place = F.pmod("key", F.lit(KEY_BITS)) + 1
    chunks = keyed.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    filled = bytearray(KEY_BITS // 8)
    for row in chunks.toLocalIterator():  # KEY_BITS / 32768 rows of 4 KB at most
        filled[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
    bits = texts.sparkSession.sparkContext.broadcast(bytes(filled))
    src = texts.select(texts[id_col].alias("id"), texts[text_col].alias("text"))
    held = src.mapInArrow(_held_keys(gram, bits), f"id {src.schema['id'].dataType.simpleString()}, text string, keys array<bigint>")
    pairs = held.select("id", "text", F.explode("keys").alias("key")).join(keyed, "key")
    return pairs.withColumn("start", F.position(F.col("quote"), F.col("text")) - 1).where("start >= 0").select(F.col("id").alias(id_col), "quote_id", "start")


def split_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), X.js_trim), lambda t: t != "")


def notes_markdown(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations ``(ord, date, selected, note, tags)`` of each key as Markdown, newest order as given by ``ord``."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\n\nTags: "), F.array_join("tags", ", "))).otherwise("")
    note = F.coalesce(F.nullif(X.js_trim(F.coalesce("note", F.lit(""))), F.lit("")), F.lit("_Empty note_"))
    entry = F.concat(F.lit("### "), "date", F.lit("\n\n> "), "selected", F.lit("\n\n"), note, tags)
    held = F.array_sort(F.collect_list(F.struct("ord", entry.alias("entry"))))
    return notes.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["entry"]), "\n\n").alias("markdown"))


def export_sections(mode: Column, source: Column, target: Column, notes: Column) -> Column:
    """The parts of an export: translation, source and translation, notes, or all."""
    part = lambda c, empty: F.coalesce(F.nullif(X.js_trim(F.coalesce(c, F.lit(""))), F.lit("")), F.lit(empty))
    translated, original, noted = part(target, "_No translation_"), part(source, "_No source_"), part(notes, "_No annotations_")
    both = F.concat(F.lit("# Source\n\n"), original, F.lit("\n\n---\n\n# Translation\n\n"), translated)
    return F.when(mode == "translation", translated).when(mode == "notes", noted).when(mode == "bilingual", both).otherwise(F.concat(both, F.lit("\n\n---\n\n# Notes\n\n"), noted))


def sessions(turns: DataFrame) -> DataFrame:
    """``(session, n, latest)`` of conversation rows ``(session, at)``, newest first by ``latest``."""
    return turns.groupBy(F.coalesce("session", F.lit("legacy-session")).alias("session")).agg(F.count("*").alias("n"), F.max("at").alias("latest"))


def last_turns(turns: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:
    ranked = turns.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.where(F.col("_back") <= n).drop("_back")


ACTIONS = {"explain": "Explain the terms in the selection.", "summarize": "Summarise the content.", "rewrite": "Rewrite the selection in a clearer style.", "extract": "List the key facts.", "qa": "Answer the question."}


def assist_prompt(action: Column, terms: Column, document: Column, history: Column, question: Column, selection: Column, most: int = 12_000) -> Column:
    """The prompt of an assistant call; parts that are empty are left out."""
    task = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ACTIONS.items() for x in p)), action), F.lit(ACTIONS["qa"]))
    part = lambda title, c: F.when(X.js_trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"## {title}\n"), c))
    return F.concat_ws("\n\n", task, part("Glossary", terms), part("Document", F.substring(document, 1, most)), part("History", history), part("Question", question), part("Selection", selection))


def search(notes: DataFrame, keyword: str) -> DataFrame:
    """Annotations ``(selected, note, tags, language)`` that have the keyword in any case in their text, note, tags or side; a blank one keeps all."""
    word = keyword.strip().lower()
    side = F.when(F.coalesce("language", F.lit("")) != "", "translation").otherwise("source")
    text = F.lower(F.concat_ws(" ", F.coalesce("selected", F.lit("")), F.coalesce("note", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), side))
    return notes.where(text.contains(word)) if word else notes


def on_page(anchors: DataFrame, number: int) -> DataFrame:
    """Anchors on a page counted from 1."""
    return anchors.where(F.col("page") == number - 1)


def highlights(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations with a range, numbered from the last in the text to the first, so that marking one moves none of the others."""
    last_first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("end"), "note_id")) - 1
    return notes.where("start is not null and end > start").withColumn("place", last_first)


def localised(notes: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, note_id, block_idx)``: the first block whose text contains what a note quotes.

    Notes meet the blocks of their own keys alone, in one join by these; each different quote once. Blocks are sent
    once, whatever the number of notes. Notes without a quote are in no block.
    """
    quote = F.coalesce(F.nullif(X.js_trim(F.coalesce("exact", F.lit(""))), F.lit("")), X.js_trim(F.coalesce("selected", F.lit(""))))
    asked = notes.select(*keys, "note_id", quote.alias("quote")).where("quote <> ''")
    held = blocks.select(*keys, "block_idx", "text").join(asked.select(*keys, "quote").distinct(), keys).where(F.col("text").contains(F.col("quote")))
    placed = held.groupBy(*keys, "quote").agg(F.min("block_idx").alias("block_idx"))
    return asked.join(placed, [*keys, "quote"]).select(*keys, "note_id", "block_idx")


def conversation_rows(asked: DataFrame, language: Column) -> DataFrame:
    """Records of assistant calls ``(…, prompt, selection, tab, response)``: their scope, and the language where a translation was asked about."""
    chosen = F.col("selection").isNotNull()
    return asked.withColumns({"scope": F.when(chosen, "selection").otherwise("document"), "language": F.when(F.col("tab") == "translation", language), "selection": F.nullif("selection", F.lit("")), "response": F.coalesce("response", F.lit(""))})
