"""Connected components by contraction.

Each round every vertex hooks onto its least neighbour, pointer jumping flattens
the trees, and the edges between the roots form the next, at most half as large
graph. Only minima are aggregated, which combine before the shuffle, so a vertex
with very many edges costs no more than the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, component)`` for each vertex that has an edge; the component is its least vertex.

    Nulls, loops and repeated edges are ignored; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    e = ws.table(edges.where(x < y).select(x.alias("u"), y.alias("v")).union(edges.where(x > y).select(y.alias("u"), x.alias("v"))).distinct(), "edges")
    found = None
    while not e.isEmpty():
        least = e.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("p"))
        parent = ws.table(least.unionByName(e.select(F.col("u").alias("x"), F.col("u").alias("p"))).groupBy("x").agg(F.min("p").alias("p")), "parent")
        while True:
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            jumped = ws.table(parent.join(up, "p").select("x", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parent")
            parent = jumped.select("x", "p")
            if jumped.where("moved").isEmpty():
                break
        of_u = parent.select(F.col("x").alias("u"), F.col("p").alias("pu"))
        of_v = parent.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        rest = e.join(of_u, "u").join(of_v, "v").where("pu <> pv")
        e = ws.table(rest.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if found is None:
            found = parent.select(F.col("x").alias("vertex"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("x").alias("component"), F.col("p").alias("next"))
            found = found.join(step, "component", "left").select("vertex", F.coalesce("next", "component").alias("component"))
    if found is None:
        found = e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return ws.table(found, "components")
