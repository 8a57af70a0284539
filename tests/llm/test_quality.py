import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vellumite.llm import kernels as K
from vellumite.llm.quality import keep_good, measure, quality_rules

from . import messy


def counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + m for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for m in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_counts_match_brute_force(spark, sf_dir):
    texts = [r[1] for r in messy.documents()] + ["a b c a b c", "x\n\nx\r\nx\n x\nx", "# $ <p> | a", "a b a b a b a"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    data, offsets = K.flat(pa.array(texts, pa.string()))
    got, stats = measure(data, offsets)
    assert [tuple(r) for r in got.tolist()] == [counts(t) for t in texts]
    assert np.isfinite(stats).all()


def test_labelled_documents(spark, sf_dir):
    """Trained on labels, the verdict is right for nearly all labelled rows, and clean ones stay."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert len(good) > 100 and sum(good) >= 0.99 * len(good)
    assert len(bad) > 10 and sum(bad) <= 0.1 * len(bad)


def test_held_out_labels(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95


def test_messy_rows_without_enough_labels(spark):
    rows = messy.documents()
    df = spark.createDataFrame(rows, messy.SCHEMA)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 1)], "doc_id long, quality int")
    got = quality_rules(df, labels).collect()
    assert Counter((r.doc_id, *r[1:6]) for r in got) == Counter((r[0], *counts(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed) and r.anomaly is None
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], messy.SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules(empty, labels).collect() == [] and keep_good(empty, labels).collect() == []


def test_verdict_is_the_same_each_time(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = (quality_rules(d, labels).select("doc_id", "kept", F.round("anomaly", 9)).orderBy("doc_id").collect() for d in (docs, docs.repartition(5)))
    assert a == b
