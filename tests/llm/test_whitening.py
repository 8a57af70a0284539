import math

import numpy as np
import pytest

from vellumite.llm import whitening
from vellumite.llm.whitening import subspace_iteration, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, id string, x array<long>, component int, dim int"


def usable(rows):
    return [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, k=16):
    """Whole numbers by Python, eigenvectors by LAPACK, one length after the other."""
    out = {}
    for d in {len(v) for _, v in usable(rows)}:
        some = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in usable(rows) if len(v) == d]
        fit = sorted({x for _, x in some})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        exact = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
        e, c = np.linalg.eigh(exact.T @ exact / n)
        out[d] = (n, sums, e[::-1][:k], c[:, ::-1][:, :k], np.trace(exact.T @ exact / n), some)
    return out


def check(spark, rows, k=16):
    found = whiten(spark.createDataFrame(rows, SCHEMA), components=k).collect()
    assert [f for f in whiten(spark.createDataFrame([], SCHEMA)).columns] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    total = 0
    for n, sums, e, c, trace, some in brute(rows, k).values():
        there = e > 1e-9 * max(e[0], 1e-300)
        for j in np.flatnonzero(there):
            mine = [r for r in found if r.n == n and r.component == j + 1 and r.vec_id in {i for i, _ in some}]
            want = sorted(((-1 if i is None else i), sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), sum((n * a - s) / n * b for a, s, b in zip(x, sums, c[:, j], strict=True)) / math.sqrt(e[j])) for i, x in some)
            have = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened) for r in mine)
            assert [w[:2] for w in want] == [h[:2] for h in have]
            side = np.sign(sum(w[2] * h[2] for w, h in zip(want, have, strict=True)))
            assert max(abs(w[2] - side * h[2]) for w, h in zip(want, have, strict=True)) < 1e-6
            assert all(abs(r.explained * trace / e[j] - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine)
            total += len(mine)
    assert total == len(found)
    return found


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in v], i % 3, "clash", [1], 5, 9) for i, v in enumerate(rng.normal(size=(n, d)) * np.linspace(1, 3, d))]


def test_against_lapack(spark):
    check(spark, vectors(300, 40))
    check(spark, vectors(50, 5))


def test_messy_rows(spark):
    rows = vectors(60, 6)
    rows += [(100, None, 1, None, None, None, None), (101, [], None, None, None, None, None), (102, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1, None, None, None, None), (103, [float("nan")] * 6, 1, None, None, None, None), (104, [float("inf")] + [0.0] * 5, 1, None, None, None, None)]
    rows += [rows[3], rows[3], (None, [0.25] * 6, None, None, None, None, None), (200, rows[4][1], 2, None, None, None, None)]
    rows += [(300 + i, [float(i), float(i * i % 7), 1.0], 0, None, None, None, None) for i in range(9)]  # a length of its own, one entry constant
    found = check(spark, rows)
    assert sum(r.vec_id == 3 for r in found) == 3 * 6 and {r.component for r in found if r.vec_id is not None and r.vec_id >= 300} == {1, 2}


def test_nothing_to_whiten(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, None, None, None, None), (2, [1.0, 2.0], 0, None, None, None, None)], SCHEMA)).count() == 0


def test_huge_entries(spark):
    rows = [(i, [1e300 * (i % 3), float(i)], 0, None, None, None, None) for i in range(9)]
    found = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in found} == set(range(9)) and all(r.deviation is None for r in found if r.vec_id % 3 == 0)


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([(f"v{i}", v) for i, v, *_ in vectors(20, 3)], "name string, v array<float>")
    found = whiten(df, "name", "v").collect()
    assert len(found) == 60 and all(r.name.startswith("v") for r in found)


@pytest.mark.parametrize(("d", "block", "widest"), [(64, 8, 1024), (150, 8, 64), (90, 90, 90), (40, 16, 48)])
def test_iteration_takes_blocks_only(d, block, widest):
    """Never more than a block of products at once; eigenvectors as LAPACK has them."""
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d)) * np.linspace(1, 2, d)
    v = a @ a.T
    widths = []
    e, c, left = subspace_iteration(lambda q: widths.append(q.shape[1]) or v @ q, d, 6, block, widest)
    want, axes = np.linalg.eigh(v)
    assert max(widths) <= max(block, 6) and len(widths) > (block < d)
    assert np.allclose(e, want[::-1][:6], rtol=1e-11) and (np.abs(np.einsum("ij,ij->j", c, axes[:, ::-1][:, :6])) > 1 - 1e-10).all()
    assert (left < whitening.ROUNDING * e[0]).all()


@pytest.mark.parametrize("v", [np.eye(70), np.diag([5.0] * 3 + [0.0] * 67), np.zeros((70, 70))])
def test_iteration_on_equal_eigenvalues(v):
    e, c, _ = subspace_iteration(lambda q: v @ q, 70, 4, 8, 64)
    assert np.allclose(e, sorted(np.diag(v))[::-1][:4]) and np.allclose(c.T @ c, np.eye(4))


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label, None, None, None, None) for r in df.select("vec_id", "embedding", "label").collect()]
    check(spark, rows)
