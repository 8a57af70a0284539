import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from vellumite.llm import kernels as K
from vellumite.llm.ngram_jaccard import PartEnum, ngram_jaccard_join, ngram_jaccard_links, sketches

from . import messy


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, num=80, den=100):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return Counter([(i, len(s), root(i)) for i, s in sets] + [(i, len(shingle_set(t)), None) for i, t in rows if i is None])


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_messy_rows_match_brute_force(spark):
    rows = messy.documents()
    df = spark.createDataFrame(rows, messy.SCHEMA)
    assert got(ngram_jaccard_join(df)) == brute([r[:2] for r in rows])


def test_chains_and_edits_match_brute_force(spark):
    rng = random.Random(5)
    rows, base = [], messy.words(9, 160)
    for i in range(160):
        if i % 20 == 0:
            base = messy.words(100 + i, rng.randint(5, 250))
        edited = list(base)
        for _ in range(rng.randint(0, 4)):
            edited[rng.randrange(len(edited))] = f"w{rng.randint(0, 9)}"
        if rng.random() < 0.5:
            base = edited
        rows.append((1000 - i, " ".join(edited)))
    assert got(ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], messy.SCHEMA)).collect() == []


def test_table_of_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(ngram_jaccard_join(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_similar_sets_share_a_signature():
    """The guarantee itself: sets at exactly the threshold, of many sizes."""
    rng, scheme = np.random.default_rng(1), PartEnum(80, 100)
    for size in [5, 6, 9, 10, 20, 31, 32, 45, 63, 64, 100, 127, 128, 129, 200, 255, 256, 300, 511, 600, 1500]:
        for _ in range(20):
            union = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            apart = size * 20 // 100
            cut = int(rng.integers(0, apart + 1))
            a, b = np.unique(union[cut:]), np.unique(np.r_[union[:cut], union[apart:]])
            owner = np.repeat([0, 1], [len(a), len(b)])
            sig, who = scheme.signatures(owner, np.r_[a, b], 2)
            same = len(a) == len(b) and (a == b).all()
            assert same or np.intersect1d(sig[who == 0], sig[who == 1]).size, (size, cut)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        a, b = x[:150], x[30:180]
        s = sketches(np.repeat([0, 1], 150), np.r_[a, b], np.array([150, 150]))
        bits = np.bitwise_count(np.frombuffer(s[0], np.uint8) ^ np.frombuffer(s[1], np.uint8)).sum()
        assert bits <= 60


def test_words_match_the_pattern():
    texts = ["", " a  b\tc\n", "x", " y\x1cz \x0b w", "é è" * 9]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])]
    s, e, t = K.words(data, offsets)
    assert [(int(k), bytes(data[i:j])) for i, j, k in zip(s, e, t, strict=True)] == [(k, m) for k, r in enumerate(raw) for m in re.findall(rb"[^\x20\x09-\x0d]+", r)]


def test_threshold_is_checked():
    with pytest.raises(ValueError):
        PartEnum(40, 100)


def test_every_link_is_counted(spark, monkeypatch):
    """Near copies of one text, far more than a component needs, in many blocks; copies and a repeated id count."""
    from vellumite.llm import ngram_jaccard as J

    monkeypatch.setattr(J, "LINK_CLASSES", 16)
    monkeypatch.setattr(J, "COLUMNS", 64)
    rng, base = random.Random(8), messy.words(7, 120)
    rows = []
    for i in range(120):
        edited = list(base)
        for _ in range(rng.randint(0, 5)):
            edited[rng.randrange(len(edited))] = f"w{rng.randint(0, 9)}"
        rows.append((i, " ".join(edited)))
    rows += [(200, rows[3][1]), (201, rows[3][1].upper()), (3, rows[9][1]), (3, " ".join(messy.words(6, 50))), (202, None), (203, " "), (None, rows[3][1])]
    sets = [(i, shingle_set(t)) for i, t in rows]
    similar = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    expected = Counter((i, len(a), None if i is None else sum(similar(a, b) for k, (j, b) in enumerate(sets) if j is not None and k != m)) for m, (i, a) in enumerate(sets))
    out = ngram_jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in out) == expected
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows)


def test_links_match_the_sql(spark, sf_dir):
    from vellumite.llm import oracles, queries

    from ..compare import duck
    from ..compare import rows as table

    name = "op1_ngram_jaccard_links"
    assert table(queries.QUERIES[name](spark, sf_dir).toPandas()) == table(duck(sf_dir).execute(oracles.ORACLES[name]).df())
