"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors of one label and dimension get centroids of their own, fitted on a sample, and go
to the cell of the nearest one. Two unit vectors with a cosine of t or more that lie on
different sides of a plane through the origin are each at most ``sqrt(1 - t t)`` away from
it. A vector is therefore also shown, as a guest, to every cell of a lesser number whose border
with its own is that near: a pair meets in one cell, that of the lesser number, where one of the two is at home,
and no link is lost, whatever the centroids are. There are about ``sqrt(n) / 8`` cells to n vectors, so the rows
placed and the products both grow slower than the square. Cells are compared in blocks, so
a large cell is many tasks. Equal vectors count as one with a multiplicity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import Workspace, trimmed, trimmed_group

#: From so many vectors on a label has cells, of about ``SPREAD * sqrt(n)`` vectors each.
FEW, SPREAD = 48, 8
#: Vectors to fit a centroid on, and in all for one label and dimension at most; the bound is on the sample, cells beyond it get larger.
FIT_EACH, FIT_ROWS = 16, 1 << 16
#: Vectors that are placed at once, bytes and vectors on either side of a blocked product at most.
PLACED, BLOCK_BYTES, BLOCK = 4096, 32 << 20, 8192


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[i : i + PLACED] @ centroids.T, 1) for i in range(0, len(x), PLACED)])
        total = np.zeros_like(centroids)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        centroids = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], centroids)
    return np.unique(centroids, axis=0)


@trimmed
def _unit(batches):
    """Packs each usable vector as unit doubles; null for those that link with nothing."""
    for batch in batches:
        column = batch.column(1)
        column = column.cast(pa.list_(pa.float64())) if not pa.types.is_large_list(column.type) else column.cast(pa.large_list(pa.float64()))
        out, dim = [], []
        labelled = batch.column(2).is_valid().to_pylist()
        for x, ok in zip(column, labelled, strict=True):
            v = x.values if ok and x.is_valid else None
            v = v.to_numpy() if v is not None and len(v) and not v.null_count else None
            top = np.abs(v).max() if v is not None else 0
            if not (np.isfinite(top) and top > 0):
                out.append(None)
                dim.append(0)
                continue
            v = v / top  # so that the squares neither vanish nor overflow
            out.append((v / np.linalg.norm(v)).tobytes())
            dim.append(len(v))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(dim, pa.int32()), pa.array(out, pa.binary())], names=["id", "label", "dim", "vec"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _fitted(label_kind: pa.DataType):
    """Of a sample of one label and dimension: its centroids."""

    @trimmed_group
    def run(table: pa.Table) -> pa.Table:
        dim, cells = table["dim"][0].as_py(), table["cells"][0].as_py()
        order = np.argsort(table["mark"].to_numpy(), kind="stable")[: max(FEW, min(FIT_ROWS, FIT_EACH * cells))]
        sample = _matrix(table["vec"].take(pa.array(order)), dim)
        centroids = spherical_kmeans(sample[np.lexsort(sample.T)], cells)
        return pa.table({"label": pa.array([table["label"][0].as_py()], label_kind), "dim": pa.array([dim], pa.int32()), "centroids": pa.array([centroids.tobytes()], pa.binary())})

    return run


def _placed(reach: float):
    """The vectors of a group in their own cells and, as guests, in those of lesser numbers whose border is near."""

    def run(some: pa.Table, model: pa.Table) -> pa.Table:
        some = some.combine_chunks()
        names = ["label", "dim", "cls", "id", "copies", "vec"]
        if not some.num_rows:
            return some.select(names).append_column("cell", pa.array([], pa.int32())).append_column("home", pa.array([], pa.bool_()))
        dim = some["dim"][0].as_py()
        centroids = np.frombuffer(model["centroids"][0].as_py(), np.float64).reshape(-1, dim)
        near = _matrix(some["vec"], dim) @ centroids.T
        best = np.argmax(near, 1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
        row, cell = np.nonzero((near[np.arange(len(near)), best][:, None] - near <= (reach + 1e-9) * apart[best] + 1e-12) & (np.arange(len(centroids)) <= best[:, None]))
        out = some.select(names).take(pa.array(row))
        return out.append_column("cell", pa.array(cell.astype(np.int32))).append_column("home", pa.array(cell == best[row]))

    return run


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of a and b; the least number is the root."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _compared(threshold: float):
    @trimmed_group
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table["dim"][0].as_py()
        ids, cls, copies = (table[c].to_numpy() for c in ("id", "cls", "copies"))
        order = np.argsort(ids, kind="stable")
        ids, cls, copies = ids[order], cls[order], copies[order]
        x = _matrix(table["vec"], dim)[order]
        left, right = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)[order]) for c in ("is_left", "is_right"))
        guest = ~table["home"].to_numpy(zero_copy_only=False)[order][right]  # at home a vector counts its links itself
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        for i in range(0, len(left), 256):
            rows = left[i : i + 256]
            hit = x[rows] @ x[right].T >= threshold
            hit &= cls[rows][:, None] != cls[right]
            links[rows] += hit @ copies[right]
            links[right[guest]] += copies[rows] @ hit[:, guest]
            a, b = np.nonzero(hit)
            root = _unite(root, rows[a], right[b])
        some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"cls": pa.array(cls[some]), "links": pa.array(links[some]), "a": pa.array(ids[some]), "b": pa.array(ids[root][some])})

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98) -> DataFrame:
    """``(id, n_links, component_id, kept)``: one row for each vector.

    Vectors are compared if their labels are equal and not null and they have the same dimension
    (without ``label_col``, all of one dimension), by cosine in double precision; ``n_links`` counts
    the other vectors at ``threshold`` or more, ``component_id`` is the least id reachable by links
    and ``kept`` says whether it is the vector's own. Null, empty and zero vectors and those with
    null or non-finite components link with nothing. Rows of a repeated id count as vectors of their
    own with that id. A null id links with nothing, has a null component and is kept.
    """
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession, "near-duplicate-vectors")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), label.alias("label"))
    packed = ws.table(src.mapInArrow(_unit, "id long, label string, dim int, vec binary"), "vectors")
    usable = packed.where("vec is not null and id is not null")
    classes = ws.table(usable.groupBy("label", "dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("cls", F.monotonically_increasing_id()), "classes")

    # centroids of each label with enough vectors, from the least hashes among its vectors
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("cells", F.greatest(F.lit(2), F.least(F.ceil(F.sqrt("n") / SPREAD), F.lit(FIT_ROWS // FIT_EACH))).cast("int"))
    sizes = ws.table(sizes.where(F.col("n") >= FEW).withColumn("parts", F.ceil(F.col("n") / PLACED).cast("int")), "sizes")
    known_sizes = classes.join(sizes, ["label", "dim"])
    mark = F.xxhash64("vec") / 2.0**64 + 0.5
    share = F.greatest(F.lit(FEW), F.least(F.lit(FIT_ROWS), F.col("cells") * FIT_EACH)) * 1.5 / F.col("n")
    sample = known_sizes.withColumn("mark", mark).where(F.col("mark") <= share + 16 / F.col("n"))
    model = ws.table(sample.select("label", "dim", "cells", "mark", "vec").groupBy("label", "dim").applyInArrow(_fitted(pa.string()), "label string, dim int, centroids binary"), "centroids")
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    dealt = known_sizes.withColumn("part", part).groupBy("label", "dim", "part")
    models = model.join(sizes, ["label", "dim"]).select("label", "dim", "centroids", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).groupBy("label", "dim", "part")
    shape = "label string, dim int, cls long, id long, copies long, vec binary, cell int, home boolean"
    in_cells = dealt.cogroup(models).applyInArrow(_placed(math.sqrt(1 - min(1.0, threshold) ** 2) if threshold > 0 else 1.0), shape)
    few = classes.join(sizes.select("label", "dim"), ["label", "dim"], "left_anti").select("label", "dim", "cls", "id", "copies", "vec", F.lit(0).alias("cell"), F.lit(True).alias("home"))
    placed = ws.table(in_cells.unionByName(few), "cells")
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(BLOCK_BYTES / (8 * F.col("dim")))))
    blocks = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("held")).select("label", "dim", "cell", F.ceil(F.col("held") / most).cast("int").alias("blocks"))
    rows = placed.join(blocks, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    meet = F.expr(
        "flatten(transform(sequence(0, blocks - 1), k -> case when k = block then array(struct(block as i, block as j, home as is_left, true as is_right)) "
        "when home then array(struct(block as i, k as j, true as is_left, false as is_right), struct(k as i, block as j, false as is_left, true as is_right)) "
        "else array(struct(k as i, block as j, false as is_left, true as is_right)) end))"
    )
    dealt = rows.select("label", "dim", "cell", "cls", "id", "copies", "vec", "home", F.inline(meet))
    found = ws.table(dealt.groupBy("label", "dim", "cell", "i", "j").applyInArrow(_compared(threshold), "cls long, links long, a long, b long"), "links")
    comp = components(ws, found.where("a <> b").select("a", "b"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(links, "cls", "left").select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("vec").alias("v"), F.col("id").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = known.join(comp, known["least"] == comp["vertex"], "left").select("l", "d", "v", "n_links", F.coalesce("component", "least").alias("component"))
    usable_id = F.when(F.col("id").isNotNull(), F.col("vec"))
    out = packed.withColumn("vec", usable_id).join(known, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("vec") == F.col("v")), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
