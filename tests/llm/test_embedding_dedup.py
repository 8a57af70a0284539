from collections import Counter

import numpy as np
import pytest

from vellumite.llm import embedding_dedup
from vellumite.llm.embedding_dedup import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vec string, cell int"


def brute(rows, threshold=0.98):
    units = []
    for i, v, label, *_ in rows:
        ok = i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / np.abs(np.array(v, float)).max() if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    near = [[b for b in range(len(rows)) if a != b and units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold] for a in range(len(rows))]
    out = Counter()
    for a, r in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            same = [b for b in range(len(rows)) if rows[b][0] == rows[x][0] and r[0] is not None]
            for b in near[x] + same:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = None if r[0] is None else min(rows[b][0] for b in seen)
        out[(r[0], len(near[a]), least, r[0] == least)] += 1
    return out


def got(spark, rows):
    return Counter(tuple(r) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect())


def vectors(seed, n, d=16, groups=5, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d))
    return [(centers[k % groups] + spread * rng.normal(size=d)).tolist() if k % 3 else rng.normal(size=d).tolist() for k in range(n)]


def test_many_cells_and_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SPREAD", 1)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    for spread in (0.02, 0.08, 0.15):
        rows = [(1000 - k, v, k % 2, "x", "y", 0) for k, v in enumerate(vectors(3, 300, spread=spread))]
        assert got(spark, rows) == brute(rows)


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 3.0], 1), (10, [nan, 1.0, 2.0], 1), (11, [inf, 1.0, 1.0], 1),
        (12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (None, v, 1), (2, v, 1), (14, [1e-300, 2e-300, 3e-300], 1), (15, [1e300, 2e300, 3e300], 1), (16, [-1.0, -2.0, -3.0], 1),
    ]
    rows = [(*r, None, "z", 1) for r in rows]
    assert got(spark, rows) == brute(rows)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    rows += [(10_000 + i, [x * 1.001 for x in v[:-1]] + [v[-1] * 1.05], label) for i, v, label in rows[:60]]
    copied = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    expected = brute([(r.vec_id, list(r.embedding), r.label) for r in copied.collect()])
    assert Counter(tuple(r) for r in near_duplicate_vectors(copied).collect()) == expected


def test_empty_table(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_several_cells_as_shipped(spark, tmp_path):
    """With the constants as they are: more than one cell, guests a small multiple, nothing lost."""
    rows = [(k, v, k % 2) for k, v in enumerate(vectors(8, 1200, d=24, groups=150, spread=0.02))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = []

    class Watched(embedding_dedup.Workspace):
        def table(self, frame, name):
            out = super().table(frame, name)
            if name == "cells":
                seen.append((out.select("label", "cell").distinct().count(), out.count()))
            return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(embedding_dedup, "Workspace", Watched)
        assert Counter(tuple(r) for r in near_duplicate_vectors(df).collect()) == brute(rows)
    (cells, placed) = seen[0]
    assert cells >= 6 and placed < 4 * len(rows), seen
