"""Fitted models: the same in every run however tables are dealt, ids of any type, and scored against slow readings of the method."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumite.llm import kernels as K
from vellumite.llm import quality, toxicity
from vellumite.llm.mixing import mix_sources, schedule, source_targets

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_forest_is_the_same_however_labels_are_dealt(tables):
    docs, labels = tables
    rows = labels.count() * 3 // 4  # a bound below the number of labels
    a, b = (quality.fit(d, x, fit_rows=rows) for d, x in ((docs, labels), (docs.repartition(5), labels.repartition(7).orderBy(F.desc("doc_id")))))
    assert a.limit == b.limit and all((getattr(a, k) == getattr(b, k)).all() for k in ("low", "high", "feature", "value", "steps"))


def test_text_ids(spark, tables):
    docs, labels = tables
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    good = quality.quality_rules(*named).collect()
    assert len(good) == docs.count() and all(r.doc_id.startswith("d") for r in good) and any(r.anomaly is not None for r in good)
    scored = toxicity.toxicity(*named).collect()
    assert len(scored) == docs.count() and {r.held_out for r in scored} == {True, False} and any(r.predicted for r in scored)


def test_forest_by_walking_each_tree(tables):
    docs, labels = tables
    forest = quality.fit(docs, labels)
    rng = np.random.default_rng(3)
    stats = rng.uniform(0, 1, (40, len(quality.STATISTICS)))

    def steps(tree, x):
        node = 0
        while forest.feature[tree, node] >= 0:
            node = 2 * node + (2 if x[forest.feature[tree, node]] > forest.value[tree, node] else 1)
        return forest.steps[tree, node]

    whole = 2 * (math.log(quality.SAMPLE - 1) + 0.5772156649) - 2 * (quality.SAMPLE - 1) / quality.SAMPLE
    for row, got in zip(stats, forest.score(stats), strict=True):
        span = [h - low + 0.05 for low, h in zip(forest.low, forest.high, strict=True)]
        x = [min(4.0, max(0.0, v - h, low - v) / s) for v, low, h, s in zip(row, forest.low, forest.high, span, strict=True)]
        mean = sum(steps(t, x) for t in range(quality.TREES)) / quality.TREES
        assert got == pytest.approx(2 ** (-mean / whole), rel=1e-9)


def test_forest_from_every_label(spark):
    """Spans, splits, steps and limit against a slow reading of all of 9,000 labelled rows."""

    def text(i):
        words = [f"w{i}x{k}" for k in range(60)]
        marks = i % 23 if i % 30 == 0 else i % 7 if i % 50 == 1 else 0
        return " ".join([w.upper() if k < i % 41 else w for k, w in enumerate(words)] + ["#"] * marks)

    texts = [text(i) for i in range(9000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 30 != 0)) for i in range(9000)], "doc_id int, quality int")  # ids of another type
    forest = quality.fit(docs, labels)
    counts, stats = quality.measure(*K.flat(pa.array(texts)))
    good = np.arange(9000) % 30 != 0
    assert not quality.base_fails(counts).any()
    low, high = np.quantile(stats[good], [quality.TAIL, 1 - quality.TAIL], axis=0)
    assert forest.low == pytest.approx(low, rel=1e-12) and forest.high == pytest.approx(high, rel=1e-12)
    rows = forest.excess(stats[good])

    def expected(n):
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n > 1)

    for tree in range(0, quality.TREES, 8):
        held = {0: rows}
        while held:
            node, x = held.popitem()
            level, size, f, v = int(math.log2(node + 1)), len(x) * quality.SAMPLE / len(rows), forest.feature[tree, node], forest.value[tree, node]
            if level == forest.depth or size < 2:
                assert f == -1 and forest.steps[tree, node] == pytest.approx(level + expected(size), rel=1e-9)
                continue
            assert x[:, f].min() <= v <= max(1.0, x[:, f].max())
            for child, part in ((2 * node + 1, x[x[:, f] <= v]), (2 * node + 2, x[x[:, f] > v])):
                if len(part):
                    held[child] = part
                else:
                    assert forest.feature[tree, child] == -1 and forest.steps[tree, child] == level + 1
    score = forest.score(stats)
    levels = np.append(np.unique(score), 1.0)
    cost = [quality.GOOD_WEIGHT * np.mean(score[good] > x) + np.mean(score[~good] <= x) for x in levels[:-1]]
    gaps = [(b - a, (a + b) / 2) for a, b, c in zip(levels[:-1], levels[1:], cost, strict=True) if c <= min(cost) + 1e-9]
    assert forest.limit == pytest.approx(max(gaps)[1], rel=1e-12)


def test_kept_rows_are_those_of_the_verdict(tables):
    docs, labels = tables
    kept = sorted(r.doc_id for r in quality.quality_rules(docs, labels).where("kept").collect())
    assert sorted(r.doc_id for r in quality.keep_good(docs, labels).collect()) == kept and kept


def test_lexicon_is_the_same_however_labels_are_dealt(tables):
    docs, labels = tables
    a, b = (toxicity.fit(d, x, fit_rows=150) for d, x in ((docs, labels), (docs.repartition(5), labels.repartition(7).orderBy(F.desc("doc_id")))))
    assert a.weights == b.weights and a.exceptions == b.exceptions and a.curve == pytest.approx(b.curve, rel=1e-9) and a.weights


def test_scores_by_looking_at_each_word(tables):
    docs, labels = tables
    lexicon = toxicity.fit(docs, labels)
    for row in docs.limit(300).collect():
        words = toxicity.fold(row.text or "").split()
        spans = [(k, k + len(p.split())) for p in lexicon.exceptions for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        hits = [max(w for e, w in lexicon.weights.items() if word.startswith(e)) for k, word in enumerate(words) if any(word.startswith(e) for e in lexicon.weights) and not any(a <= k < b for a, b in spans)]
        weight = sum(hits)
        expected = (math.log1p(weight), math.log1p(100 * weight / max(len(words), 20)), min(len(hits), 4.0)) if hits else (0.0, 0.0, 0.0)
        assert lexicon.features(row.text or "") == pytest.approx(expected, rel=1e-9)


def test_taken_words_by_walking_the_order(spark):
    """Each document's share is what the blocks of its source's slots cover of its places in the shuffled order."""
    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mix_sources(df).collect()}
    sizes = df.select("source", F.lit(0).alias("x")).join(df, "source").select("source").distinct().join(df.groupBy("source").agg(F.sum(F.length("text") / 2).cast("long").alias("size")), "source")
    targets = {r.source: r for r in source_targets(sizes).collect()}
    plan = schedule(source_targets(sizes)).groupBy("number").agg(F.min("block_start").alias("a"), F.max("block_end").alias("b"), F.sum(F.col("block_end") - F.col("block_start")).alias("n")).collect()
    for r in plan:  # blocks tile the words from 0 to the target
        assert r.a == 0 and r.n == r.b
    for source, t in targets.items():
        mine = [got[i] for i, _, s in rows if s == source]
        whole, rest = divmod(math.floor(t.target + 1e-6), t.source_size)
        extra = [r.taken - whole * r.size for r in mine]
        assert sum(r.taken for r in mine) == math.floor(t.target + 1e-6)
        assert all(0 <= e <= r.size for e, r in zip(extra, mine, strict=True)) and sum(extra) == rest
        assert sum(0 < e < r.size for e, r in zip(extra, mine, strict=True)) <= 1  # the last one of the round is cut
