"""A trie of conversations: what turns they share, and what is saved if shared turns are kept once.

Each turn becomes a digest and a number of words; no text is moved. The turns are dealt by ranges
of their order, so that a conversation may be larger than a task, and numbered from counts of the
pieces. The sequence of the first d turns is known by the exclusive or of d digests that each hold
their place. Conversations with the same turns are one from then on, with a multiplicity.

The sums over subtrees take a heavy-path decomposition: the child with the most conversations
(of equals, that of the least id) carries on its parent's path, every other child begins one.
A path goes down along one conversation, so its top is the last light node before, a running
maximum. A node keeps at most half of the conversations when a light edge is taken, so there
are at most log2 of them from any node to the root. Round by round, from the deepest paths up,
each path is an array whose values are summed from its end, and its total is added to the
parent of its top.

Conversations and paths of any length are cut in stretches of ``STRETCH`` turns: running sums are
made within a stretch and carried from one to the next, a row for each.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, only, trimmed

#: Turns of a conversation or nodes of a path that are added up in one group.
STRETCH = 1024
#: Bits of the conversation ids that are listed in one group.
LISTED = 8
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "x", "y"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def _digest(text: Column) -> tuple[Column, Column]:
    """120 bits of a strong digest, as two longs."""
    strong = F.sha2(text, 256)
    return tuple(F.conv(F.substring(strong, k, 15), 16, 10).cast("long") for k in (1, 16))


def _numbered(ws: Workspace, turns: DataFrame) -> DataFrame:
    """The turns with ``idx``, from 1 in each conversation."""
    order = [F.asc_nulls_first("turn"), F.asc("tx"), F.asc("ty")]
    dealt = ws.table(turns.repartitionByRange(F.asc("conv"), *order).withColumn("piece", F.spark_partition_id()), "dealt")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = dealt.groupBy("conv", "piece").agg(F.count("*").alias("n")).select("conv", "piece", before.alias("before")).where("before > 0")
    local = F.row_number().over(Window.partitionBy("conv", "piece").orderBy(*order))
    return dealt.withColumn("local", local).join(pieces, ["conv", "piece"], "left").select("conv", (F.col("local") + F.coalesce("before", F.lit(0))).alias("idx"), "tx", "ty", "words")


def _rebuilt(ws: Workspace, ranked: DataFrame, shared: int, family: int) -> tuple[DataFrame, DataFrame]:
    """``(conv, size)`` of each conversation, and the turns of all: ``(conv, depth, tx, ty, words, last)``."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(shared))
    sizes = ranked.groupBy("conv").agg(F.max("idx").alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    sizes = ws.table(sizes, "sizes")
    lent = sizes.where(F.col("conv") == F.col("base")).select("base", F.col("n").alias("there"))
    plans = sizes.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    plans = ws.table(plans.select("conv", "base", "n", "h", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")), "plans")
    own = ranked.join(plans.select("conv", "h", "lent", "size"), "conv").where("idx > h").withColumn("depth", F.col("idx") - F.col("h") + F.col("lent"))
    heads = ranked.where(F.col("idx") < shared).withColumnRenamed("conv", "base")
    taken = plans.where("h > 0").select("conv", "base", "h", "size").join(heads, "base").where("idx <= h").withColumn("depth", F.col("idx"))
    columns = ["conv", F.col("depth").cast("long").alias("depth"), "tx", "ty", "words", (F.col("depth") == F.col("size")).alias("last")]
    return plans.select("conv", "size"), own.select(*columns).unionByName(taken.select(*columns))


def _prefixes(ws: Workspace, turns: DataFrame) -> DataFrame:
    """The turns with the digest ``(x, y)`` of all up to each one, and that of the one before it."""
    placed = turns.withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH)).withColumn("px", F.xxhash64("depth", "tx", "ty")).withColumn("py", F.xxhash64("ty", F.lit(1), "tx", "depth"))
    placed = ws.table(placed, "rebuilt")
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("conv", "stretch").agg(F.bit_xor("px").alias("tx_"), F.bit_xor("py").alias("ty_"))
    carried = totals.select("conv", "stretch", F.bit_xor("tx_").over(before).alias("cx"), F.bit_xor("ty_").over(before).alias("cy")).where("stretch > 0")
    here = Window.partitionBy("conv", "stretch").orderBy("depth")
    run = placed.withColumn("lx", F.bit_xor("px").over(here)).withColumn("ly", F.bit_xor("py").over(here)).join(carried, ["conv", "stretch"], "left")
    x, y = (F.col(a).bitwiseXOR(F.coalesce(b, F.lit(0))) for a, b in (("lx", "cx"), ("ly", "cy")))
    run = run.withColumn("x", x).withColumn("y", y)
    return ws.table(run.select("conv", "depth", "tx", "ty", "words", "last", "x", "y", F.col("x").bitwiseXOR(F.col("px")).alias("up_x"), F.col("y").bitwiseXOR(F.col("py")).alias("up_y")), "prefixes")


@trimmed
def _hashed(batches):
    """The SHA-256 of each node's lists, which come one after the other; any number of rows to a node."""
    node, state, out = None, None, []

    def table():
        depth, x, y, digest = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(digest)], names=[*_NODE, "ends"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield table()
            out = []
    if node is not None:
        out.append((*node, state.hexdigest()))
        yield table()


def _ends(ends: DataFrame) -> DataFrame:
    """``(depth, x, y, ends)``: the digest of the ids that end at a node; ids are put in order by ranges of their value."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    lists = ends.groupBy(*_NODE, F.shiftright("conv", LISTED).alias("range")).agg(ids.alias("ids"))
    return lists.repartition(*_NODE).sortWithinPartitions(*_NODE, "range").select(*_NODE, "ids").mapInArrow(_hashed, "depth long, x long, y long, ends string")


def _nodes(kept: DataFrame) -> DataFrame:
    """``(depth, x, y, n_convs, node, words, up_x, up_y)``: every node but the root."""
    one = ["tx", "ty", "up_x", "up_y"]
    nodes = kept.groupBy(*_NODE).agg(F.sum("copies").alias("n_convs"), F.min("conv").alias("node"), F.min("words").alias("words"), *(f(c).alias(f"{c}_{n}") for c in one for f, n in ((F.min, "a"), (F.max, "z"))))
    same = F.lit(True)
    for c in one:
        same = same & (F.col(f"{c}_a") == F.col(f"{c}_z"))
    sure = F.when(same, F.col("up_x_a")).otherwise(F.raise_error(F.lit("two sequences of turns have one digest")).cast("long"))
    return nodes.select(*_NODE, "n_convs", "node", "words", sure.alias("up_x"), F.col("up_y_a").alias("up_y"))


def _paths(ws: Workspace, kept: DataFrame, nodes: DataFrame, root: int) -> DataFrame:
    """Every node but the root with its parent, the top of its path and the number of light edges above."""
    met = kept.select("conv", *_NODE).join(nodes, _NODE).withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH))
    met = ws.table(met, "met")
    top_depth, top = F.when(F.col("light"), F.col("depth")), F.when(F.col("light"), F.col("node"))
    here = Window.partitionBy("conv", "stretch").orderBy("depth")
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = met.groupBy("conv", "stretch").agg(F.max(top_depth).alias("d"), F.max_by("node", top_depth).alias("t"), F.sum(F.col("light").cast("long")).alias("l"), F.max_by("node", "depth").alias("n"))
    totals = totals.withColumn("t", F.when(F.col("d").isNotNull(), F.col("t")))
    carried = totals.select("conv", "stretch", F.max("d").over(before).alias("c_depth"), F.last("t", True).over(before).alias("c_top"), F.sum("l").over(before).alias("c_level"), F.last("n").over(before).alias("c_up")).where("stretch > 0")
    run = met.withColumns({"l_depth": F.max(top_depth).over(here), "l_top": F.last(top, True).over(here), "l_level": F.sum(F.col("light").cast("long")).over(here), "l_up": F.lag("node").over(here)})
    run = run.where(F.col("conv") == F.col("node")).join(carried, ["conv", "stretch"], "left")
    return run.select(
        F.col("node").alias("conv_id"), "depth", F.coalesce("l_up", "c_up", F.lit(root)).alias("parent_conv_id"), "n_convs", "n_children", "words", "ends",
        F.coalesce("l_top", "c_top", F.lit(root)).alias("top"), F.coalesce("l_depth", "c_depth", F.lit(0)).cast("long").alias("top_depth"), (F.col("l_level") + F.coalesce("c_level", F.lit(0))).cast("int").alias("level"),
    )


def _summed(ws: Workspace, paths: DataFrame) -> DataFrame:
    """Subtree sums, one level of paths after the other, the deepest first."""
    levels = paths.agg(F.max("level")).first()[0]
    done, attached = [], None
    sums = ("n_leaves", "saved_tokens")
    for level in range(levels, -1, -1):
        now = paths.where(F.col("level") == level).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")).withColumn("stretch", F.floor(F.col("depth") / STRETCH))
        if attached is not None:
            now = now.join(attached, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in sums})
        path = ["top", "top_depth"]
        now = ws.table(now, f"level-{level}")
        here = Window.partitionBy(*path, "stretch").orderBy(F.desc("depth"))
        later = Window.partitionBy(*path).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
        totals = now.groupBy(*path, "stretch").agg(*(F.sum(c).alias(c) for c in sums))
        carried = totals.select(*path, "stretch", *(F.sum(c).over(later).alias(f"c_{c}") for c in sums)).where(F.col(f"c_{sums[0]}").isNotNull())
        found = now.withColumns({c: F.sum(c).over(here) for c in sums}).join(carried, [*path, "stretch"], "left").withColumns({c: F.col(c) + F.coalesce(f"c_{c}", F.lit(0)) for c in sums})
        found = ws.table(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, "ends", *path), f"sums-{level}")
        done.append(found)
        tops = found.where((F.col("depth") == F.col("top_depth")) & (F.col("depth") > 0))
        attached = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared: int = 4, family: int = 20) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: a row for each node.

    A conversation's turns go by ``turn``, nulls first, rows of one turn by the digest of role and
    text; a null role or text is empty. It is rebuilt first: ``h = crc32(id) % shared`` turns of the
    conversation ``id - id % family`` (all if it has fewer, none if there is none), then its own after
    its first h. ``shared=1`` takes them as they are. A node is a sequence of the first d rebuilt turns,
    the root (d = 0) that of none; its members begin with it. ``conv_id`` is the least member,
    ``parent_conv_id`` that of the parent (null for the root), ``n_convs`` counts members, ``n_children``
    children, ``n_leaves`` the childless nodes of the subtree, itself included, ``saved_tokens`` sums
    ``(n_convs - 1) * words of the last text`` over it; ``ends_sha256`` is the SHA-256 of the ids of the
    members with exactly d turns, ascending, joined by commas.

    Rows without a conversation id are left out; an empty table has no node, not even the root. Repeated
    rows are turns of their own. Further columns are ignored. Should two sequences ever share a digest
    of 128 bits, the query fails rather than count them as one.
    """
    ws = Workspace(turns.sparkSession, "conversation-trie")
    src = only(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tx, ty = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    ranked = _numbered(ws, ws.table(src.select(F.col("conv").cast("long").alias("conv"), "turn", tx.alias("tx"), ty.alias("ty"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")), "turns"))
    sizes, rebuilt = _rebuilt(ws, ws.table(ranked, "ranked"), shared, family)
    prefixes = _prefixes(ws, rebuilt)

    zero = F.lit(0).cast("long")
    ends = ws.table(prefixes.where("last").select("conv", *_NODE).unionByName(sizes.where("size = 0").select("conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"))), "ends")
    same = ends.groupBy(*_NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("copies")).select("conv", "copies")
    kept = ws.table(prefixes.join(ws.table(same, "same"), "conv"), "kept")
    total = sizes.agg(F.count("*").alias("n"), F.min("conv").alias("least")).first()
    digests = _ends(ends)

    nodes = ws.table(_nodes(kept), "nodes")
    largest = F.max_by(F.struct("x", "y"), F.struct("n_convs", -F.col("node")))
    families = ws.table(nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count("*").alias("n_children"), largest.alias("heavy")), "families")
    heavy = families.select((F.col("depth") + 1).alias("depth"), F.col("heavy.x").alias("x"), F.col("heavy.y").alias("y"), F.lit(False).alias("light"))
    known = families.select(*_NODE, "n_children")
    digests = ws.table(digests, "digests")
    nodes = nodes.join(known, _NODE, "left").join(heavy, _NODE, "left").join(digests, _NODE, "left")
    nodes = ws.table(nodes.select(*_NODE, "n_convs", "node", "words", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("light", F.lit(True)).alias("light"), "ends"), "counted")

    root = known.where("depth = 0").select("n_children", F.lit(None).cast("string").alias("ends")).unionByName(digests.where("depth = 0").select(zero.alias("n_children"), "ends"))
    root = root.agg(F.coalesce(F.max("n_children"), zero).alias("n_children"), F.max("ends").alias("ends"))
    least = F.lit(total["least"]).cast("long")
    root = root.select(least.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n_convs"), "n_children", zero.alias("words"), "ends", least.alias("top"), zero.alias("top_depth"), F.lit(0).alias("level"))
    paths = ws.table(root.where(F.lit(total["n"] > 0)).unionByName(_paths(ws, kept, nodes, total["least"] or 0)), "paths")
    out = _summed(ws, paths) if total["n"] else paths.withColumns({"n_leaves": zero, "saved_tokens": zero})
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"))
