"""The translation of documents: plan, context, service, restoration, progress.

The service is a :class:`Translator` of its own; nothing here opens a connection. The
stub is a pure expression, so plans can be tested to the letter.
"""

from __future__ import annotations

import string
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds as G
from ..functions import text as X
from ..operators import sections

CONTEXT = 500


class Translator(Protocol):
    """Translates one chunk; ``context`` is the tail of the translation before it."""

    def translate(self, text: str, context: str, language: str) -> str: ...


class Retrying:
    """Tries again after failures that may pass; a rate limit fails at once.

    A retry starts the chunk anew, so no piece is ever repeated.
    """

    def __init__(self, inner: Translator, tries: int = 6, longest: float = 15.0, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.tries, self.longest, self.sleep = inner, tries, longest, sleep

    def translate(self, text: str, context: str, language: str) -> str:
        for k in range(self.tries):
            try:
                return self.inner.translate(text, context, language)
            except Exception as e:
                if k + 1 == self.tries or getattr(e, "status", None) == 429:
                    raise
                self.sleep(min(2.0 * 2**k, self.longest))
        raise AssertionError


class Stub:
    """Upper case between the markers."""

    def translate(self, text: str, context: str, language: str) -> str:
        return G.between_markers(text, str.upper)


def translated_expression(text: Column, language: Column) -> Column:
    """A stub as an expression, for chunks without markup: a-z to A-Z."""
    return X.typography(F.translate(text, string.ascii_lowercase, string.ascii_uppercase), language)


def translate(docs: DataFrame, translator: Translator, language: str, terms: list[G.Term] | DataFrame = (), done: DataFrame | None = None, most: int = sections.CHUNK, lanes: int = 1) -> DataFrame:
    """``(doc_id, chunk_idx, chunk_id, kind, title, state, text)`` of every chunk of ``(doc_id, text)``.

    References stay as they are. Chunks in ``done`` (doc_id, chunk_idx, text) are cached: they are not
    sent again. Documents run in parallel, the chunks of one in order, since each sees the tail of the
    one before; terms are locked before and corrected after: a list that the caller bounds for every chunk, or a table
    ``(doc_id, chunk_idx, terms)`` with those of each chunk, as :func:`..operators.glossary.chunk_terms` finds them. With several
    ``lanes`` the chunks of a batch all see the last one of the batch before.
    """
    plan = sections.chunks(docs, most=most)
    have = done.select("doc_id", "chunk_idx", F.col("text").alias("cached")) if done is not None else None
    rows = plan.join(have, ["doc_id", "chunk_idx"], "left") if have is not None else plan.withColumn("cached", F.lit(None).cast("string"))
    everywhere = [] if isinstance(terms, DataFrame) else list(terms)

    def one(text: str, kind: str, context: str, kept: list[G.Term]) -> str:
        if kind == "references":
            return text
        masked = G.mask(text)
        locked = G.lock_terms(masked.text, kept)
        out = translator.translate(locked.text, context, language)
        out = G.correct_terms(G.unmask(out, locked.fragments), kept)
        return G.unmask(out, masked.fragments)

    def run(rows: pd.DataFrame, held: dict) -> pd.DataFrame:
        rows, context, begun = rows.sort_values("chunk_idx"), "", 0
        texts, states = [], []
        for k, r in enumerate(rows.itertuples(index=False)):
            cached = not pd.isna(r.cached)
            if cached or (k - begun) % lanes == 0:
                context, begun = (texts[-1] if texts else ""), k + cached
            texts.append(r.cached if cached else one(r.content, r.kind, context[-CONTEXT:], everywhere + [(t["source"], t["target"], t["category"]) for t in held.get(r.chunk_idx, ())]))
            states.append("cached" if cached else "completed")
        return rows[["doc_id", "chunk_idx", "chunk_id", "kind", "title"]].assign(state=states, text=texts)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_idx int, chunk_id string, kind string, title string, state string, text string"
    by_doc = rows.select("doc_id", "chunk_idx", "chunk_id", "kind", "title", "content", "cached").groupBy("doc_id")

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        return run(rows, {})

    def with_terms(rows: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        return run(rows, {k: t for k, t in zip(terms["chunk_idx"], terms["terms"], strict=True) if t is not None})

    # terms meet the chunks in their document, where these are already: no chunk is sent again for them
    out = by_doc.cogroup(terms.select("doc_id", "chunk_idx", "terms").groupBy("doc_id")).applyInPandas(with_terms, schema) if isinstance(terms, DataFrame) else by_doc.applyInPandas(alone, schema)
    return out.withColumn("text", X.typography(F.col("text"), F.lit(language)))


def target_markdown(blocks: DataFrame) -> DataFrame:
    return sections.reassemble(blocks, "doc_id", "chunk_idx", "text")


def previous_tail(blocks: DataFrame, n: int = CONTEXT) -> DataFrame:
    """Adds ``context``: the last n characters of the block before."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("chunk_idx"))
    return blocks.withColumn("context", F.coalesce(F.right(before, F.lit(n)), F.lit("")))


def model_catalog(remote: DataFrame, defaults: DataFrame) -> DataFrame:
    """``(provider, model)``: what a provider lists and its default, each once."""
    return remote.select("provider", "model").union(defaults.select("provider", "model")).where("model is not null").distinct()


def usable_profiles(profiles: DataFrame, capability: str) -> DataFrame:
    """Profiles that can do a task; plain translation services only translate."""
    fits = F.array_contains("capabilities", capability)
    return profiles.where(fits & ((F.col("kind") != "deeplx") | F.lit(capability == "translate")))


def lanes_of(requested: int | None, in_pieces: bool, default: int = 2) -> int:
    """How many chunks are translated at once: 1 to 4, and one after the other where a provider streams."""
    return 1 if in_pieces else max(1, min(4, int(requested or default)))


def events(blocks: DataFrame, lanes: int = 1, keep: bool = True) -> DataFrame:
    """``(doc_id, seq, type, chunk, text, percentage, state, message)``: the events that a translation of these blocks sends.

    ``blocks`` are those of :func:`translate`. The plan comes first, an event for each chunk; the first chunks that are
    cached are hydrated, an event for each; the others are started, told in pieces of one and completed, in batches where
    there are several lanes. Without ``keep`` nothing is resumed, as where no progress is stored. Folding the events
    gives the blocks again. Every event follows from its own chunk and its document's counts, so the
    blocks are shuffled once, by document.
    """
    of_doc = Window.partitionBy("doc_id")
    fresh = F.min(F.when(F.lit(not keep) | (F.col("state") != "cached"), F.col("chunk_idx"))).over(of_doc)
    rows = blocks.withColumn("total", F.count("*").over(of_doc)).withColumn("first", F.coalesce(fresh, F.col("total"))).withColumn("lead", F.col("chunk_idx") == F.min("chunk_idx").over(of_doc))
    null = F.lit(None)

    def event(place: list, kind: str, chunk: Column = null, text: Column = null, percentage: Column = null, state: Column = null, message: Column = null) -> Column:
        at = F.array(*(p if isinstance(p, Column) else F.lit(p) for p in place)).cast("array<long>")
        said = {"chunk": chunk, "text": text, "state": state, "message": message}
        return F.struct(at.alias("place"), F.lit(kind).alias("type"), *(c.cast("string").alias(n) for n, c in said.items()), percentage.cast("int").alias("percentage"))

    status = lambda place, text: event(place, "status", message=text)
    percent = lambda done: F.floor(done / F.col("total") * 100)
    none = F.array().cast("array<struct<place:array<bigint>,type:string,chunk:string,text:string,state:string,message:string,percentage:int>>")
    resumed, batches = F.col("first") > 0, F.ceil((F.col("total") - F.col("first")) / lanes)
    numbers = F.when(batches > 0, F.sequence(F.lit(0).cast("long"), batches - 1)).otherwise(F.array().cast("array<bigint>"))
    agents = lambda b: F.least(F.lit(lanes), F.col("total") - F.col("first") - b * lanes).cast("string")
    told = F.transform(numbers, lambda b: status([b, 0, 0, 0], F.concat(F.lit("Parallel batch "), (b + 1).cast("string"), F.lit("/"), batches.cast("string"), F.lit(" · "), agents(b), F.lit(" agents"))))
    head = [status([-1, 0, 0, 0], F.lit("Chunking document...")), event([-1, 1, 0, 0], "run_started", message=F.when(resumed, "resume").otherwise("fresh")), event([-1, 4, 0, 0], "progress", percentage=percent(F.col("first")))]
    resume = F.array(status([-1, 2, 0, 0], F.concat(F.lit("Resuming from chunk "), F.col("first").cast("string"), F.lit("..."))))
    last = F.array(event([1 << 40, 0, 0, 0], "done", message=F.lit("Translation complete.")))
    of_run = F.concat(F.array(*head), F.when(resumed, resume).otherwise(none), told if lanes > 1 else none, last)

    chunk, k = F.col("chunk_id"), F.col("chunk_idx")
    batch, title = F.floor((k - F.col("first")) / lanes), F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("chunk "), (k + 1).cast("string")))
    planned = F.array(event([-1, 1, k + 1, 0], "chunk_planned", chunk))
    hydrated = F.array(event([-1, 3, k, 0], "hydrate_blocks", chunk, F.col("text"), state=F.lit("cached")))
    begin = [event([batch, 1, k, 0], "chunk_started", chunk)]
    if lanes == 1:
        what = F.when(F.col("kind") == "references", "Skipping reference section").otherwise(F.concat(F.lit("Translating: "), title))
        begin += [status([batch, 1, k, 1], F.concat(F.lit("Refining: "), title)), status([batch, 1, k, 2], what)]
    result = [event([batch, 2, k, 0], "chunk", chunk, F.col("text")), event([batch, 2, k, 1], "chunk_completed", chunk, state=F.col("state")), event([batch, 2, k, 2], "progress", percentage=percent(k + 1))]
    mine = F.concat(planned, F.when(k < F.col("first"), hydrated).otherwise(F.array(*begin, *result)), F.when(F.col("lead"), of_run).otherwise(none))
    every = rows.select("doc_id", F.inline(mine))
    seq = F.row_number().over(of_doc.orderBy("place", "chunk")) - 1
    return every.withColumn("seq", seq).select("doc_id", "seq", "type", "chunk", "text", "percentage", "state", "message")


def prompt(text: Column, terms: Column, context: Column, language: Column) -> Column:
    """What a model is asked for a chunk; ``terms`` is a table of them and may be empty, as may the context."""
    tagged = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<{tag}>\n"), c, F.lit(f"\n</{tag}>")))
    task = F.concat(F.lit("Translate the academic text into "), language, F.lit(". Keep Markdown, HTML and every marker between @@ as they are. Return the translation alone."))
    return F.concat_ws("\n\n", task, tagged("glossary", terms), tagged("context", context), tagged("source_text", text))
