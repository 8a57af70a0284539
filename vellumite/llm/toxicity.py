"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to
Latin, digits and signs that stand for letters to those letters, drops zero-width
characters and turns other marks into spaces. The lexicon holds beginnings of words
and is learned from labelled documents: each beginning that toxic documents have far
more often than others, weighted by its log odds. Words that match but occur in
documents labelled clean are exceptions, as are phrases that the caller names.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Workspace, only, small_batches, trimmed

#: Labelled documents of each kind that the lexicon is learned from, at most.
FIT_ROWS = 4000
#: Letters of a beginning, at least and at most.
SHORTEST, LONGEST = 3, 12
#: Entries of the lexicon and of the learned exceptions, at most.
ENTRIES, EXCEPTIONS = 2000, 5000
#: Score from which a document is predicted toxic.
TOXIC = 0.7

# Look-alikes: each string of the first column reads as the letter of the second.
LOOK_ALIKES = [
    ("аαɑ", "a"), ("вƅЬ", "b"), ("сϲⅽ", "c"), ("ԁⅾ", "d"), ("еєε", "e"), ("ɡցq", "g"), ("һհ", "h"), ("іιıїӏ", "i"), ("јϳ", "j"), ("кκ", "k"), ("ⅼ", "l"), ("мⅿ", "m"),
    ("пո", "n"), ("оοσօ", "o"), ("рρ", "p"), ("ѕꜱ", "s"), ("тτ", "t"), ("υսц", "u"), ("νѵⅴ", "v"), ("ѡωԝ", "w"), ("хχⅹ", "x"), ("уγү", "y"), ("ᴢ", "z"),
]
# Digits and signs that stand for letters; i and l are one letter in folded text.
SUBSTITUTES = [("0", "o"), ("1!|l", "i"), ("3", "e"), ("4@", "a"), ("5$", "s"), ("7+", "t"), ("8", "b"), ("9", "g")]
ZERO_WIDTH = "​‌‍⁠﻿­"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    out |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)} | {0xFF10 + k: chr(48 + k) for k in range(10)}
    out |= {ord(x): letter for some, letter in LOOK_ALIKES for x in some if x.isalpha() and ord(x) > 127}
    out |= {ord(x): letter for some, letter in SUBSTITUTES for x in some}
    out |= {k: "i" if v == "l" else v for k, v in out.items() if v}
    out |= {ord(x): None for x in ZERO_WIDTH} | {ord(x): " " for x in " –—‘’“”…«»¿¡"}
    return out


_FOLD = _table()
#: Marks at the end of a word are marks, whatever letter they may stand for.
_MARKS, _AFTER = re.compile(r"[!|+$@]++"), re.compile(r"\s|[.,;:?\"')\]]|\Z")


def _end_marks(run: re.Match) -> str:
    """A run of marks, each read once: all of them go at a word's end, else those before the last ``!``."""
    marks = run.group()
    if _AFTER.match(run.string, run.end()):
        return " "
    cut = marks.rfind("!")
    return f" {marks[cut:]}" if cut > 0 else marks


def fold(text: str) -> str:
    """The text in folded letters, words separated by blanks and a blank at either end."""
    return f" {_MARKS.sub(_end_marks, text).lower().translate(_FOLD)} "


@dataclass
class Lexicon:
    """Beginnings and their weights, exceptions, and the logistic curve of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)
    _machine: object = None

    def __getstate__(self):
        return (self.weights, self.exceptions, self.curve)

    def __setstate__(self, state):
        self.weights, self.exceptions, self.curve = state
        self._machine = None

    def machine(self):
        import ahocorasick

        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(f" {entry}", (len(entry), weight, False))
            for phrase in self.exceptions:
                self._machine.add_word(f" {phrase} ", (len(phrase), 0.0, True))
            self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the matches, the heaviest of each word, without those in an exception."""
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if not self.weights:
            return []
        for end, (length, weight, exception) in self.machine().iter(folded):
            if exception:
                spared.append((end - length, end))
            else:
                start = end - length + 1
                if start not in found or weight > found[start][1]:
                    found[start] = (end + 1, weight)
        if spared:
            begins = [a for a, _ in sorted(spared)]
            reach = list(itertools.accumulate((b for _, b in sorted(spared)), max))  # the furthest end of the exceptions so far
            furthest = lambda s: reach[k - 1] if (k := bisect.bisect_right(begins, s)) else -1
            found = {s: x for s, x in found.items() if x[0] > furthest(s) + 1}
        return [(s, e, w) for s, (e, w) in found.items()]

    def features(self, text: str) -> tuple[float, float, float]:
        """Weight of the hits, the same for a hundred words, and their number, the first two as logarithms."""
        folded = fold(text)
        hits = self.hits(folded)
        if not hits:
            return (0.0, 0.0, 0.0)
        weight = sum(w for _, _, w in hits)
        words = max(1, len(folded.split()))
        return (math.log1p(weight), math.log1p(100 * weight / max(words, 20)), min(len(hits), 4.0))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + rows @ np.array(self.curve[1:]))))


def _beginnings(folded: str) -> set[str]:
    return {w[:n] for w in set(folded.split()) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _sketch(batch_text: pa.Array) -> np.ndarray:
    """The least shingle hash of each text: near copies mostly share it."""
    data, offsets = K.flat(batch_text)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, j in K.portions(offsets, 1 << 20):
        owner, value = K.shingles(K.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], 3)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        out[i + owner[first]] = value[first]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (weight * p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from at most ``fit_rows`` labelled documents of each kind.

    The samples are the labels of the least hashes of ids, so reruns agree however the tables are
    partitioned; ids may be of any type. An id with both labels counts as toxic; of several documents of one
    labelled id the one of the least text counts. The sample is written once and every pass reads
    that. Near copies count once, by a min-hash. A beginning enters if chance alone would hardly put it
    into so many of the toxic documents; of two of which one begins the other, the more telling one stays.
    """
    marks = only(labels, id=id_col, toxic=toxic_col).where("id is not null and toxic is not null").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}  # two rows
    if not counts:
        return Lexicon()
    least = lambda kind: marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    sample = only(docs, id=id_col, text=text_col).where("text is not null").join(F.broadcast(least(1).unionByName(least(0))), "id")
    ws = Workspace(docs.sparkSession, "toxicity")

    @trimmed
    def sketch(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sketch(batch.column(1)).view(np.int64))], names=["id", "text", "toxic", "sketch"])

    one = ws.table(sample.groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")), "sample")  # 2 * fit_rows rows at most
    sketched = ws.table(one.mapInArrow(sketch, f"id {one.schema['id'].dataType.simpleString()}, text string, toxic int, sketch long"), "sketched")
    chosen = sketched.groupBy("sketch", "toxic").agg(F.min("id").alias("id"))
    sample = ws.table(sketched.join(chosen, ["sketch", "toxic", "id"]).select("id", "text", "toxic"), "chosen")

    @trimmed
    def toxic_ones(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update(_beginnings(fold(text)))
        yield pa.RecordBatch.from_pydict({"entry": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    candidates = sample.where("toxic = 1").mapInArrow(toxic_ones, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).where("n >= 3")
    # what chance would do: the share of toxic documents among those that have the entry
    top = candidates.orderBy(F.desc("n"), "entry").limit(20 * ENTRIES)
    table = top.toPandas()
    toxic_count = dict(zip(table["entry"], table["n"].astype(int), strict=True))
    spread = docs.sparkSession.sparkContext.broadcast(frozenset(toxic_count))

    @trimmed
    def clean_ones(batches):
        seen: Counter[str] = Counter()
        n = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n[toxic] += 1
                if not toxic:
                    seen.update(_beginnings(fold(text)) & spread.value)
        seen.update({"\0clean": n[0], "\0toxic": n[1]})
        yield pa.RecordBatch.from_pydict({"entry": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    clean = dict(sample.mapInArrow(clean_ones, "entry string, n long").groupBy("entry").agg(F.sum("n")).toPandas().itertuples(index=False))
    n_clean, n_toxic = int(clean.pop("\0clean", 0)), int(clean.pop("\0toxic", 0))
    if not n_clean or not n_toxic:
        return Lexicon(curve=(math.log((n_toxic + 0.5) / (n_clean + 0.5)), 0.0, 0.0, 0.0))
    p = n_toxic / (n_toxic + n_clean)
    rated = []
    for entry, t in toxic_count.items():
        c = int(clean.get(entry, 0))
        odds = math.log((t + 0.5) / (n_toxic - t + 0.5)) - math.log((c + 0.5) / (n_clean - c + 0.5))
        # log of the chance, by the bound of Chernoff, of so many toxic ones among t + c
        q = t / (t + c)
        chance = -(t + c) * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)) if q > p else 0.0
        if odds > 2 and q > 0.9 and chance < -math.log(20.0 * max(50, len(toxic_count)) ** 0.5):
            rated.append((round(chance, 6), -len(entry), entry, odds))
    lexicon = Lexicon()
    for _, _, entry, odds in sorted(rated):
        if len(lexicon.weights) >= ENTRIES:
            break
        if not any(entry.startswith(x) or x.startswith(entry) for x in lexicon.weights):
            lexicon.weights[entry] = odds
    learned = docs.sparkSession.sparkContext.broadcast(lexicon)

    @trimmed
    def matched(batches):
        seen: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                folded = fold(text)
                seen.update({(folded[s : folded.index(" ", s)], toxic) for s, _, _ in learned.value.hits(folded)})
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in seen], pa.string()), "toxic": pa.array([t for _, t in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    words = sample.mapInArrow(matched, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    spared = words.where("c >= 1 and c > t").orderBy(F.desc("c"), "word").limit(EXCEPTIONS).toPandas()["word"]
    lexicon.exceptions = {*spared, *(fold(x).strip() for x in exceptions)} - {""}
    lexicon._machine = None
    final = docs.sparkSession.sparkContext.broadcast(lexicon)

    @trimmed
    def traits(batches):
        for batch in batches:
            rows = [final.value.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(2), "x": pa.array([list(r) for r in rows], pa.list_(pa.float64()))})

    seen = sample.mapInArrow(traits, "toxic int, x array<double>").toPandas()
    x, y = np.array(seen["x"].tolist(), float).reshape(-1, 3), seen["toxic"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    # as often as among all labelled documents, whatever the sample took of each kind
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum())) * len(y) / (counts[0] + counts[1])
    lexicon.curve = tuple(float(v) for v in _logistic(x[order], y[order], weight[order]))
    return lexicon


def toxicity(docs: DataFrame, labels: DataFrame | None = None, lexicon: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """``(id, held_out, score, predicted)`` of each document.

    Rows with crc32(id as text) mod ``folds`` = ``held_out`` are held out: their labels are never
    read. A null or empty text has no hits and gets the score of such; a null id is not held out.
    The score depends on the text alone.
    """
    if lexicon is None:
        mine = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held_out
        lexicon = fit(docs, labels.where(mine), id_col, text_col) if labels is not None else Lexicon()
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    @trimmed
    def run(batches):
        for batch in batches:
            rows = np.array([model.value.features(t) if t else (0.0, 0.0, 0.0) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            score = model.value.score(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= TOXIC).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    src = only(docs, id=id_col, text=text_col)
    src = src.withColumn("held_out", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == held_out, F.lit(False)))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
