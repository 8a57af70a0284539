"""Quality rules: hard limits on counts, then an isolation forest on rule statistics.

Every document gets a row of statistics. Trees of random splits are grown on all rows
labelled good, level by level: a pass over the rows gives the size and range of each
node of a level, and the driver draws their splits. A document that the splits isolate
after few steps is unlike the good ones. The limit on that score is set from all labelled
rows of both kinds. The forest is a few arrays of fixed size that travel with the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import Workspace, key_filter, only, small_batches, split_by_keys, trimmed

PORTION = 1 << 20
#: Base rules: fewer words, or a larger share (in percent) of words in repeated three-word windows, fail.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Trees, and the number of rows that steps are counted for: a node's size is its share of all good rows times ``SAMPLE``.
TREES, SAMPLE = 128, 256
#: Good rows without which there is no forest.
FEWEST = 20
#: Share of good rows beyond the ordinary span of a statistic, at either end.
TAIL = 0.005
#: A lost good row counts as so many kept bad ones where the limit is set.
GOOD_WEIGHT = 10

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["symbol_share", "word_length", "upper_share", "shout_share", "dup_line_share", "repeat_share", "distinct_share", "short_share", "lone_share"]

_SYMBOL, _UPPER, _LOWERS, _SHOUT = (np.zeros(256, np.int64) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[65:91] = 1
_LOWERS[97:123] = 1
_SHOUT[list(b"!?")] = 1


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (owner, value): is there an equal one; is there an earlier equal one."""
    n = len(owner)
    order = np.lexsort((np.arange(n), value, owner))
    o, v = owner[order], value[order]
    same = np.zeros(n + 1, bool)
    same[1:n] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    again, earlier = np.zeros(n, bool), np.zeros(n, bool)
    again[order] = same[:n] | same[1:]
    earlier[order] = same[:n]
    return again, earlier


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts (n x 5, whole numbers) and statistics (n x 9) of texts in one buffer."""
    n = len(offsets) - 1
    starts, ends, text = K.words(data, offsets)
    n_words = np.bincount(text, minlength=n)
    point = ((data & 0xC0) != 0x80).astype(np.int64)
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(point)])
    length = upto[ends] - upto[starts]
    word_chars = np.bincount(text, weights=length, minlength=n).astype(np.int64)
    word = K.hashes(data, starts, ends)

    line_end = data == 10
    cut = np.flatnonzero(line_end)
    line_starts = np.sort(np.concatenate([offsets[:-1], cut + 1]))
    line_ends = np.sort(np.concatenate([offsets[1:], cut]))
    line_text = np.repeat(np.arange(n), _per_text(line_end, offsets) + 1)
    inside = np.concatenate([np.zeros(1, np.int64), np.cumsum(~K.SEPARATOR[data])])
    filled = inside[line_ends] > inside[line_starts]
    line_starts, line_ends, line_text = line_starts[filled], line_ends[filled], line_text[filled]
    _, earlier = _repeats(line_text, K.hashes(data, line_starts, line_ends))
    n_lines = np.bincount(line_text, minlength=n)
    n_dup_lines = np.bincount(line_text[earlier], minlength=n)

    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        whole = np.flatnonzero(text[2:] == text[:-2])
        window = K.mix(word[whole] * np.uint64(3) + K.mix(word[whole + 1]) * np.uint64(5) + K.mix(K.mix(word[whole + 2])) * np.uint64(7))
        again, _ = _repeats(text[whole], window)
        for k in range(3):
            covered[whole[again] + k] = True
    n_repeat = np.bincount(text[covered], minlength=n)
    _, known = _repeats(text, word)

    counts = np.stack([n_words, word_chars, _per_text(_SYMBOL[data], offsets), n_dup_lines, n_repeat], 1).astype(np.int64)
    chars = np.maximum(1, _per_text(point, offsets))
    some = np.maximum(1, n_words)
    cased = np.maximum(1, _per_text(_UPPER[data] + _LOWERS[data], offsets))
    lone = (length == 1) & (_SYMBOL[data[starts]] > 0) if len(starts) else np.zeros(0, bool)
    stats = np.stack(
        [
            np.log1p(1000 * counts[:, 2] / chars), word_chars / some, _per_text(_UPPER[data], offsets) / cased,
            np.log1p(1000 * _per_text(_SHOUT[data], offsets) / chars), n_dup_lines / np.maximum(1, n_lines), n_repeat / some,
            # shorter texts repeat fewer words: the share is compared with that of as many words
            (n_words - np.bincount(text[known], minlength=n)) / some ** 0.85,
            np.bincount(text[length <= 3], minlength=n) / some, np.bincount(text[lone], minlength=n) / some,
        ],
        1,
    )
    return counts, stats


@dataclass
class Forest:
    """Trees as arrays: the statistic and value of each split, and the steps down to each leaf.

    A statistic is taken as its excess: how far it lies outside the span of all but ``TAIL`` of the
    good rows at either end, in units of that span. Ordinary documents are then all alike, and
    random splits cut off only what exceeds some rule.
    """

    low: np.ndarray
    high: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    steps: np.ndarray
    depth: int
    limit: float = 1.0

    @staticmethod
    def _expected(n):
        """Mean steps of an unsuccessful search among n rows."""
        n = np.maximum(n, 1.0)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))

    def excess(self, stats: np.ndarray) -> np.ndarray:
        span = self.high - self.low + 0.05
        return np.minimum(np.maximum(0, np.maximum(stats - self.high, self.low - stats)) / span, 4.0)

    @classmethod
    def bare(cls, low: np.ndarray, high: np.ndarray) -> Forest:
        """Trees without splits; each is stored as a complete binary tree."""
        depth = max(1, int(np.ceil(np.log2(SAMPLE))))
        nodes = (2 << depth) - 1
        return cls(low, high, np.full((TREES, nodes), -1, np.int16), np.zeros((TREES, nodes)), np.zeros((TREES, nodes)), depth)

    def walk(self, tree: int, rows: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row of excesses after so many levels, or the leaf where it stopped before."""
        feature, value = self.feature[tree], self.value[tree]
        node, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(levels):
            f = feature[node]
            down = 2 * node + 1 + (rows[every, np.maximum(f, 0)] > value[node])
            node = np.where(f >= 0, down, node)
        return node

    def split(self, level: int, tree: np.ndarray, node: np.ndarray, size: np.ndarray, feature: np.ndarray, value: np.ndarray) -> None:
        """Nodes of a level, given by the rows in them, become leaves or get their splits."""
        leaf = (size < 2) | (level == self.depth)
        self.steps[tree[leaf], node[leaf]] = level + self._expected(size[leaf])
        t, k = tree[~leaf], node[~leaf]
        self.feature[t, k], self.value[t, k] = feature[~leaf], value[~leaf]
        for child in (2 * k + 1, 2 * k + 2):
            self.steps[t, child] = level + 1  # unless rows are found there

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean steps / expected steps) of rows of excesses."""
        total = np.zeros(len(rows))
        for tree, steps in enumerate(self.steps):
            total += steps[self.walk(tree, rows, self.depth)]
        return 2.0 ** (-total / len(self.steps) / self._expected(float(SAMPLE)))

    def score(self, stats: np.ndarray) -> np.ndarray:
        """2 ** (-mean steps / expected steps): the higher, the sooner a row is cut off."""
        rows, back = np.unique(self.excess(stats), axis=0, return_inverse=True)
        return self.anomaly(rows)[back.ravel()]


def _measured(batch: pa.RecordBatch, column: int):
    data, offsets = K.flat(batch.column(column))
    for i, j in K.portions(offsets, PORTION):
        yield i, j, *measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def base_fails(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel(), pa.float64()))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _statistics(src: DataFrame) -> DataFrame:
    """``(id, counts, base_failed, stats)`` of each row ``(id, text)``."""

    @trimmed
    def run(batches):
        for batch in batches:
            for i, j, counts, stats in _measured(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c) for c in counts.T), pa.array(base_fails(counts)), _lists(stats)], names=["id", *COUNTS, "base_failed", "stats"])

    small_batches(src.sparkSession)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, stats array<double>")


def _marks(labels: DataFrame, id_col: str, quality_col: str = "quality") -> DataFrame:
    """``(id, good)``: a row for each labelled id; one with both labels is not good."""
    return only(labels, id=id_col, good=quality_col).where("id is not null and good is not null").groupBy("id").agg(F.min((F.col("good").cast("int") != 0).cast("int")).alias("good"))


def _in_order(ws: Workspace, df: DataFrame, *sums: str) -> DataFrame:
    """``(key, next, sums, sums up to it)`` of distinct keys in ascending order; ``next`` is the key after.

    Keys are dealt by ranges and summed within them; only a row for each range is in one place.
    """
    dealt = ws.table(df.groupBy("key").agg(*(F.sum(c).alias(c) for c in sums)).repartitionByRange("key").withColumn("part", F.spark_partition_id()), "in-order")
    parts, order = dealt.groupBy("part").agg(F.min("key").alias("first"), *(F.sum(c).alias(c) for c in sums)), Window.orderBy("part")
    parts = parts.select("part", F.lead("first").over(order).alias("after"), *((F.sum(c).over(order) - F.col(c)).alias(f"{c}_before") for c in sums))
    inside = Window.partitionBy("part").orderBy("key")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.select("part", "key", F.lead("key").over(inside).alias("beside"), *sums, *(F.sum(c).over(upto).alias(f"{c}_upto") for c in sums))
    rows = rows.join(F.broadcast(parts), "part").withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"{c}_before") for c in sums})
    return rows.select("key", F.coalesce("beside", "after").alias("next"), *sums, *(f"{c}_upto" for c in sums))


def _spans(ws: Workspace, good: DataFrame, n: int) -> np.ndarray:
    """The quantiles ``TAIL`` and 1 - ``TAIL`` of each statistic over all n rows, exact, between ranks in proportion."""
    each = good.select(F.posexplode("stats").alias("feature", "value")).select(F.struct("feature", "value").alias("key"), F.lit(1).cast("long").alias("n"))
    at = np.array([[TAIL], [1 - TAIL]]) * (n - 1)
    below = np.floor(at).astype(np.int64)
    ranks = np.stack([below, np.minimum(below + 1, n - 1)]) + n * np.arange(len(STATISTICS))  # n places for each statistic
    hit = F.exists(F.array(*(F.lit(int(r)) for r in np.unique(ranks))), lambda r: (r < F.col("n_upto")) & (r >= F.col("n_upto") - F.col("n")))
    found = _in_order(ws, each, "n").where(hit).select("n_upto", "key.value").toPandas().sort_values("n_upto")  # four rows for each statistic at most
    lower, upper = found["value"].to_numpy()[np.searchsorted(found["n_upto"].to_numpy(), ranks, "right")]
    return lower + (upper - lower) * (at - below)


def _tally(rows: DataFrame, forest: Forest, level: int, choice: np.ndarray) -> DataFrame:
    """``(place, n, least, most)``: the number of rows in each node of a level, and the range of the statistic that it may split."""
    first = (1 << level) - 1

    @trimmed
    def run(batches):
        n, least, most = np.zeros(TREES << level, np.int64), np.full(TREES << level, np.inf), np.full(TREES << level, -np.inf)
        for batch in batches:
            x, good = _rows(batch.column(0)), batch.column(1).to_numpy()
            for tree in range(TREES):
                node = forest.walk(tree, x, level)
                here = np.flatnonzero(node >= first)
                place, value = (tree << level) + node[here] - first, x[here, choice[tree, node[here]]]
                np.add.at(n, place, good[here])
                np.minimum.at(least, place, value)
                np.maximum.at(most, place, value)
        place = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"place": place, "n": n[place], "least": least[place], "most": most[place]})

    counted = rows.select("excess", "good").mapInArrow(run, "place long, n long, least double, most double")
    return counted.groupBy("place").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _grow(rows: DataFrame, n: int, low: np.ndarray, high: np.ndarray, seed: int = 7) -> Forest:
    """Trees of random splits on all n good rows, a level in each pass; only nodes reach the driver."""
    rng = np.random.default_rng(seed)
    forest = Forest.bare(low, high)
    choice, share = rng.integers(len(STATISTICS), size=forest.feature.shape), rng.random(forest.feature.shape)
    for level in range(forest.depth + 1):
        found = _tally(rows, forest, level, choice).toPandas()  # TREES << level rows at most
        tree, node = found["place"].to_numpy() >> level, (found["place"].to_numpy() & ((1 << level) - 1)) + (1 << level) - 1
        least = found["least"].to_numpy()
        # over the rule's range as well as the rows', so that what lies outside is cut off
        value = least + share[tree, node] * (np.maximum(found["most"].to_numpy(), 1.0) - least)
        forest.split(level, tree, node, found["n"].to_numpy() * (SAMPLE / n), choice[tree, node], value)
    return forest


def _limit(ws: Workspace, scored: DataFrame) -> float:
    """The score between rows ``(key, good, bad)`` that costs least, in the middle of the widest gap of such."""
    n_good, n_bad = scored.agg(F.sum("good"), F.sum("bad")).first()
    cost = GOOD_WEIGHT * (n_good - F.col("good_upto")) / max(1, n_good) + F.col("bad_upto") / max(1, n_bad)
    levels = _in_order(ws, scored, "good", "bad").select("key", F.coalesce("next", F.lit(1.0)).alias("next"), cost.alias("cost"))
    least = levels.agg(F.min("cost")).first()[0]
    best = levels.where(F.col("cost") <= least + 1e-12).orderBy(F.desc(F.col("next") - F.col("key")), "key").first()
    return (best.key + best.next) / 2


def _fit(ws: Workspace, measured: DataFrame, marks: DataFrame) -> Forest | None:
    known = measured.where("id is not null and not base_failed").groupBy("id").agg(F.min("stats").alias("stats"))
    labelled = ws.table(known.join(marks, "id").select("stats", "good"), "labelled")
    good = labelled.where("good = 1")
    n = good.count()
    if n < FEWEST:
        return None
    low, high = _spans(ws, good, n)
    bare = Forest.bare(low, high)

    @trimmed
    def outside(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_lists(bare.excess(_rows(batch.column(0)))), batch.column(1)], names=["excess", "good"])

    small_batches(labelled.sparkSession)
    rows = labelled.mapInArrow(outside, "excess array<double>, good int").groupBy("excess").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    rows = ws.table(rows, "excesses")
    forest = _grow(rows.where("good > 0"), n, low, high)

    @trimmed
    def scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.anomaly(_rows(batch.column(0)))), batch.column(1), batch.column(2)], names=["key", "good", "bad"])

    forest.limit = _limit(ws, ws.table(rows.mapInArrow(scores, "key double, good long, bad long"), "scored"))
    return forest


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", fit_rows: int | None = None) -> Forest | None:
    """A forest and its limit from all labelled documents that pass the base rules; None with fewer than ``FEWEST`` good ones.

    An id with both labels counts as not good; of several documents of one labelled id the one of the
    least statistics counts. The result does not depend on how the tables are partitioned. Ids may be of any
    type that both tables share. A caller may bound the labels by ``fit_rows``, those of the least hashes of ids.
    """
    ws = Workspace(docs.sparkSession, "quality")
    src, marks = only(docs, id=id_col, text=text_col), _marks(labels, id_col, quality_col)
    if fit_rows is not None:
        marks = marks.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    marks = ws.table(marks, "marks")
    if src.schema["id"].dataType == marks.schema["id"].dataType:  # equal ids have equal hashes: texts without labels need not be read
        src = split_by_keys(src, "id", ws.table(key_filter(marks), "filter"))[1]
    return _fit(ws, _statistics(src), marks)


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly)``.

    Words are runs of bytes other than space and 0x09-0x0D; a null text has none. ``base_failed`` is the
    verdict of the base rules, which also rejects null and empty texts; ``kept`` asks the forest besides.
    Without a forest and without enough labels the base rules decide alone and ``anomaly`` is null. Ids
    pass through as they are, one row for each row.
    """
    rows = _statistics(only(docs, id=id_col, text=text_col))
    if forest is None and labels is not None:
        ws = Workspace(docs.sparkSession, "quality")
        rows = ws.table(rows, "statistics")  # each text is measured once
        forest = _fit(ws, rows, _marks(labels, id_col))
    if forest is None:
        return rows.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed")).alias("kept"), F.lit(None).cast("double").alias("anomaly"))

    @trimmed
    def run(batches):
        for batch in batches:
            *own, failed, stats = batch.columns
            score = forest.score(_rows(stats))
            kept = ~failed.to_numpy(zero_copy_only=False) & (score <= forest.limit)
            yield pa.RecordBatch.from_arrays([*own, failed, pa.array(kept), pa.array(score)], names=["id", *COUNTS, "base_failed", "kept", "anomaly"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, anomaly double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that :func:`quality_rules` keeps; no text is shuffled."""
    if forest is None and labels is not None:
        forest = fit(docs, labels, id_col, text_col)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    @trimmed
    def run(batches):
        for batch in batches:
            for i, j, counts, stats in _measured(batch, at):
                kept = ~base_fails(counts)
                if forest:
                    kept &= forest.score(stats) <= forest.limit
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
