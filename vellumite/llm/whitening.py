"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed from the rows. Each Spark pass takes a block Q of directions
and computes ``X'(XQ)`` on the centred rows of the fit list: every task multiplies its rows in
double precision and sends one small matrix, groups of about the root of the number of tasks
are added on executors, and the driver adds what the groups give, whose size depends on the
dimension alone. A block is the residuals of the best Ritz vectors, made orthonormal by QR to
all blocks before; Rayleigh-Ritz on the subspace so far gives the next ones, until the
residuals certify every component. The subspace is cut back to its best half when it is wider
than ``WIDEST``, so the driver holds dimension times ``WIDEST`` numbers at most.

Entries are integers, so counts, sums and deviations are exact: sums go over the network in
two halves and are put together as whole numbers, and rows are centred by the whole part of
the mean first, which loses nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace, only, trimmed, trimmed_group

#: An entry c stands for ``floor(SCALE * c) + SHIFT``, held within ``+-MOST`` before the shift.
SCALE, SHIFT, MOST = 64.0, 1_000_000, 1 << 62
#: Directions of one pass at most, columns of the subspace at most, residual of a component against the largest eigenvalue.
BLOCK, WIDEST, SURE = 32, 1024, 1e-13
#: A residual that no pass makes smaller any more is taken as rounding if it is below this.
ROUNDING = 1e-10
_LOW = (1 << 31) - 1


def _grids(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(rows, x)`` for each length of the usable vectors of a batch: whole numbers, a row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return []
    offsets = column.offsets.to_numpy().astype(np.int64)
    entries = column.values.cast(pa.float64(), safe=False)
    c = entries.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(c)  # a null is NaN here
    spoilt = np.concatenate([[0], np.cumsum(bad)])
    begin, end = offsets[:-1], offsets[1:]
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (spoilt[end] == spoilt[begin]) & (end > begin)
    out = []
    for d in np.unique((end - begin)[ok]):
        rows = np.flatnonzero(ok & (end - begin == d))
        x = np.floor(SCALE * c[begin[rows][:, None] + np.arange(d)])
        out.append((rows, np.clip(x, -float(MOST), float(MOST)).astype(np.int64) + SHIFT))
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


@trimmed
def _whole(batches):
    for batch in batches:
        for _, x in _grids(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), _lists(x)], names=["dim", "x"])


def _rows(batch, d: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    """Of each task: the sums of the entries' high and low parts by place, and its number of rows."""

    def run(batches):
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x = _rows(batch, d)
            high, low, n = high + (x >> 31).sum(0), low + (x & _LOW).sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array(np.full(d, n))], names=["place", "high", "low", "n"])

    return run


def _centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x - S / n; the whole part of the mean goes exactly."""
    return (x - whole).astype(np.float64) - part


def _products(d: int, whole: np.ndarray, part: np.ndarray, q: np.ndarray, inner: bool):
    """Of each task: ``X'(XQ)``, or ``(XQ)'(XQ)`` if ``inner``, and the squares of its rows."""

    def run(batches):
        from pyspark import TaskContext

        total, squares, some = np.zeros((q.shape[1] if inner else d, q.shape[1])), 0.0, False
        for batch in batches:
            x = _centred(_rows(batch, d), whole, part)
            y = x @ q
            total, squares, some = total + (y if inner else x).T @ y, squares + float(np.einsum("ij,ij->", x, x)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([np.append(total.ravel(), squares).tobytes()], pa.binary())], names=["task", "sums"])

    return run


@trimmed_group
def _added(table: pa.Table) -> pa.Table:
    """The matrices of some tasks, added in the tasks' order."""
    order = np.argsort(table["task"].to_numpy(), kind="stable")
    total = sum(np.frombuffer(table["sums"][int(i)].as_py(), np.float64) for i in order)
    return pa.table({"task": pa.array([int(table["task"].to_numpy().min())]), "sums": pa.array([total.tobytes()], pa.binary())})


class _Fit:
    """The fit list of one dimension, and what is read off it."""

    def __init__(self, fit: DataFrame, d: int):
        self.d, self.rows = d, fit.where(F.col("dim") == d).select("x")
        sums = self.rows.mapInArrow(trimmed(_sums(d)), "place long, high long, low long, n long").groupBy("place")
        sums = sums.agg(F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low"), F.sum("n").alias("n")).orderBy("place").collect()  # a row for each place
        self.n = sums[0]["n"]
        self.sums = [(int(r["high"]) << 31) + int(r["low"]) for r in sums]
        middle = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        self.whole = np.array(middle, np.int64)
        self.part = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, middle, strict=True)])
        self.groups = max(1, math.isqrt(self.rows.rdd.getNumPartitions()))
        self.passes = 0

    def product(self, q: np.ndarray, inner: bool = False) -> tuple[np.ndarray, float]:
        """Covariance times q (``inner``: q' times that), and the trace of the covariance."""
        self.passes += 1
        sent = self.rows.mapInArrow(trimmed(_products(self.d, self.whole, self.part, q, inner)), "task long, sums binary")
        added = sent.groupBy(F.pmod("task", F.lit(self.groups)).alias("g")).applyInArrow(_added, "task long, sums binary").toArrow().sort_by("task")
        total = sum(np.frombuffer(x, np.float64) for x in added["sums"].to_pylist()) / self.n
        return total[:-1].reshape(-1, q.shape[1]), float(total[-1])


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The directions of ``new`` that the basis lacks, by QR, twice against rounding."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        new = q[:, np.abs(np.diag(r)) > 1e-12] if new.shape[1] else new
    return new


def subspace_iteration(product, d: int, k: int, block: int = BLOCK, widest: int = WIDEST, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(e, C, residuals)``: the k largest eigenvalues, falling, and unit eigenvectors of a symmetric d x d matrix.

    ``product(Q)`` gives the matrix times Q. Raises if the residuals come to rest above rounding.
    """
    k, block = min(k, d), min(d, max(block, k))
    widest = min(d, max(widest, 4 * block))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0] if block < d else np.eye(d)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    least, idle = np.inf, 0
    while True:
        basis, image = np.hstack([basis, q]), np.hstack([image, product(q)])
        small = basis.T @ image
        e, s = np.linalg.eigh((small + small.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        ritz, moved = basis @ s, image @ s
        left = moved - ritz * e
        found = np.linalg.norm(left[:, :k], axis=0)
        worst, top = float(found.max()), max(float(np.abs(e).max()), np.finfo(float).tiny)
        idle = 0 if worst < 0.5 * least else idle + 1
        least = min(least, worst)
        if worst <= SURE * top or basis.shape[1] == d or idle >= 8 and worst <= ROUNDING * top:
            return e[:k], ritz[:, :k] / np.linalg.norm(ritz[:, :k], axis=0), found
        if idle >= 200:
            raise ArithmeticError(f"the residuals came to rest at {worst / top:.1e} of the largest eigenvalue")
        if basis.shape[1] + block > widest < d:
            basis, image = ritz[:, : widest // 2], moved[:, : widest // 2]
        q = _orthonormal(left[:, :block], basis)
        if not q.shape[1]:  # the subspace is invariant: go on with directions outside it
            q = _orthonormal(np.random.default_rng(seed + basis.shape[1]).standard_normal((d, block)), basis)
        q = q[:, : d - basis.shape[1]]


def _model(fit: _Fit, k: int) -> dict:
    """Components, eigenvalues, trace and the error of the whitened covariance."""
    trace = 0.0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal trace
        out, trace = fit.product(q)
        return out

    e, c, _ = subspace_iteration(product, fit.d, k)
    there = e > 16 * fit.d * np.finfo(float).eps * max(e[0], 0)
    e, c = e[there], c[:, there]
    error = float(np.abs(fit.product(c / np.sqrt(e), inner=True)[0] - np.eye(len(e))).max()) if len(e) else 0.0
    return {"n": fit.n, "sums": fit.sums, "whole": fit.whole, "part": fit.part, "e": e, "to": c / np.sqrt(e), "explained": e / trace if trace > 0 else e, "error": error}


def _deviations(x: np.ndarray, m: dict) -> pa.Array:
    """Sums of squares of n x - S as exact longs; null where one is beyond a long."""
    n, wide = m["n"], max(map(abs, m["sums"]))
    if n * int(np.abs(x).max(initial=0)) + wide < 1 << 62:
        away = n * x - np.array(m["sums"], np.int64)
        if int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return pa.array((away * away).sum(1))
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, m["sums"], strict=True)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _whitened(models: dict[int, dict], id_type: pa.DataType):
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    @trimmed
    def run(batches):
        for batch in batches:
            for rows, x in _grids(batch.column(1)):
                m = models[x.shape[1]]
                k = len(m["e"])
                if not k:
                    continue
                for i in range(0, len(rows), 1 + 65536 // k):
                    some, part = rows[i : i + 1 + 65536 // k], x[i : i + 1 + 65536 // k]
                    y = _centred(part, m["whole"], m["part"]) @ m["to"]
                    again = pa.array(np.repeat(np.arange(len(some)), k))
                    ids = batch.column(0).take(pa.array(np.repeat(some, k))).cast(id_type)
                    columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))), pa.array(np.full(len(some) * k, m["n"])), _deviations(part, m).take(again), pa.array(y.ravel()), pa.array(np.tile(m["explained"], len(some))), pa.array(np.full(len(some) * k, m["error"]))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Rows go whose vector is null, empty or holds null or non-finite entries. An entry c becomes the
    whole number ``x = floor(64 c) + 1000000`` (before the shift at most 2^62 either way); the fit
    list holds each different x vector once: n of them, with sums S. ``component`` counts from 1 by
    falling eigenvalue of their covariance (divisor n), ``deviation`` is the sum of ``(n x - S)^2``,
    exact (null beyond a long), ``whitened`` the centred row along the component over the root of
    its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error`` the largest
    entry of the whitened covariance of the fit list minus the identity.

    Vectors of another length are another space with a fit list and components of its own. Components
    whose eigenvalue is zero but for rounding have no rows, so a single vector or equal ones give none;
    an empty table gives none. Repeated rows and null ids get rows like all others; further columns
    of the input are ignored.
    """
    ws = Workspace(vectors.sparkSession, "whitening")
    src = only(vectors, id=id_col, vec=vector_col)
    fit = ws.table(src.select("vec").mapInArrow(_whole, "dim int, x array<bigint>").distinct(), "fit")
    lengths = [r["dim"] for r in fit.select("dim").distinct().collect()]  # as many as there are lengths of vectors
    models = {d: _model(_Fit(fit, d), components) for d in lengths}
    kind = src.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return src.mapInArrow(_whitened(models, to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)
