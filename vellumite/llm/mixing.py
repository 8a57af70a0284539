"""Mixes sources to target weights by a low-discrepancy schedule; DataFrame functions only.

The golden-ratio points ``frac(t / phi)`` of the slots t are mapped through the
cumulated targets to sources, so every stretch of the schedule holds each source near
its share. Slots are ranked per source. A source's documents are put into a shuffled
order and its words cut into blocks of equal size, one for each of its slots; a target
over the source's size goes around again. Documents and slots meet in a join on
(source, block), and a document's share is the overlap.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace, only, row_digest

WORD = r"[^\x20\x09-\x0D]+"
#: Slots of a schedule at most: it bounds the schedule, not the documents.
SLOTS = 1 << 17
#: Points are whole numbers below this; the odd multiplier next to it over phi makes them golden-ratio points.
POINTS, GOLDEN = 1 << 32, 2654435769
#: Strips of the points, by which slots and sources are joined.
STRIPS = 1 << 10

def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, number, source_size, weight, target)``: one row for each source, numbered by code point, null last.

    The sources share all words by weight; a target stops at ``most`` times the source's size and the
    excess is shared again by weight. That is the level L at which the targets ``min(most * size, L * weight)``
    add up, and with the sources in ascending order of ``most * size / weight`` those at their limit come first.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*map(F.lit, weights))
    named = totals.withColumn("number", number).withColumn("weight", F.element_at(cycle, ((F.col("number") - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * most
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    every = Window.partitionBy()
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = named.withColumn("limited", F.sum(limit).over(up_to)).withColumn("weights", F.sum("weight").over(up_to))
    left = F.sum("source_size").over(every) - F.col("limited") + limit
    level = left / (F.sum("weight").over(every) - F.col("weights") + F.col("weight"))
    # the first source whose limit the level does not reach, with the sources before it at their limits
    open_level = F.when(level * F.col("weight") <= limit, level)
    swept = swept.withColumn("open_level", open_level).withColumn("place", F.row_number().over(order))
    final = swept.withColumn("level", F.min_by("open_level", F.when(F.col("open_level").isNotNull(), F.col("place"))).over(every))
    target = F.least(limit.cast("double"), F.coalesce(F.col("level") * F.col("weight"), limit.cast("double")))
    return final.select("source", "number", "source_size", "weight", target.alias("target"))


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(slot, number, rank, block_start, block_end)``: the source of each slot and the words it takes.

    Words are counted along the source's shuffled order, going around where the target is over its
    size. Blocks of a source are equal but for rounding. A source that gets no slot by its share but
    has a target gets one at the end, so that its words are in the mix.
    """
    spark = targets.sparkSession
    order = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    total = F.sum("target").over(every)
    high = F.when(F.sum("target").over(order) >= total, F.lit(POINTS)).otherwise(F.floor(F.sum("target").over(order) / total * POINTS))
    edges = targets.where("target > 0").select("number", F.floor(F.col("target") + 1e-6).alias("words"), high.cast("long").alias("high"), F.row_number().over(Window.orderBy("number")).alias("place"))
    edges = edges.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("number")), F.lit(0)))
    width = POINTS // STRIPS
    strips = edges.where("high > low").select("number", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("strip"))
    point = (F.col("id") * GOLDEN) % POINTS
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.floor(point / width).alias("strip"))
    dealt = points.join(strips, "strip").where("point >= low and point < high").select("slot", "number")
    missed = edges.where("words > 0").join(dealt.select("number").distinct(), "number", "left_anti").select((F.lit(slots) + F.col("place")).cast("long").alias("slot"), "number")
    ranked = dealt.unionByName(missed).withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy("slot")) - 1)
    counts = ranked.groupBy("number").agg(F.count("*").alias("of"))
    cut = lambda r: F.expr(f"words div of * ({r}) + (words % of) * ({r}) div of")  # noqa: E731  words * r / of, without overflow
    return ranked.join(counts, "number").join(edges.select("number", "words"), "number").select("slot", "number", "rank", cut("rank").alias("block_start"), cut("rank + 1").alias("block_end"), "of", "words")


def _mixed(src: DataFrame, weights: tuple[int, ...], most: int, slots: int, seed: int) -> DataFrame:
    """Of rows (id, text, source, hash): ``(id, source, hash, size, source_size, target, taken, first_slot)``; ``hash`` may be any key.

    A source's order is cut into as many chunks as a chunk holds documents of all sources, so neither the
    sums within chunks nor those over chunks grow with more than the root of the number of documents.
    """
    ws = Workspace(src.sparkSession, "mixing")
    sizes = ws.table(src.select("id", "source", "hash", word_count(F.col("text")).alias("size")), "sizes")
    targets = ws.table(source_targets(sizes, weights, most), "targets")
    plan = ws.table(schedule(targets, slots), "schedule")
    of = plan.groupBy("number").agg(F.first("of").alias("of"), F.first("words").alias("words"))
    known = targets.join(of, "number", "left")
    chunks = max(1, math.isqrt(sizes.count()))
    key = F.xxhash64("id", F.lit(seed))
    rows = sizes.join(known.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rows = rows.withColumn("key", key).withColumn("chunk", F.pmod(F.shiftright("key", 20), F.lit(chunks)))
    sums = rows.groupBy("number", "chunk").agg(F.sum("size").alias("held"))
    before = sums.select("number", "chunk", (F.sum("held").over(Window.partitionBy("number").orderBy("chunk")) - F.col("held")).alias("before"))
    within = Window.partitionBy("number", "chunk").orderBy("key", "id", "hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(before, ["number", "chunk"])
    start = F.col("before") + F.col("upto") - F.col("size")
    placed = placed.select("id", "source", "hash", "size", "source_size", "target", "number", "of", "words", start.alias("start"))
    uid = uuid.uuid4().hex[:6]
    placed = ws.table(placed.withColumn("row", F.monotonically_increasing_id()), f"placed{uid}")
    active = placed.where("size > 0 and words > 0 and start < words")
    rounds = active.select("row", "number", "size", "of", "words", F.explode(F.expr("transform(sequence(0L, (words - start - 1) div source_size), k -> start + k * source_size)")).alias("begin"))
    # the block of word w is the largest r with cut(r) <= w; the quotient is at most one off
    first, last = F.expr("greatest(0L, cast(floor(begin / words * of) as bigint) - 1)"), F.expr("least(of - 1, cast(floor(least(begin + size, words) / words * of) as bigint) + 1)")
    pieces = rounds.select("row", "number", "begin", F.least(F.col("begin") + F.col("size"), "words").alias("finish"), F.explode(F.sequence(first, last)).alias("rank"))
    met = pieces.join(plan.select("number", "rank", "slot", "block_start", "block_end"), ["number", "rank"])
    overlap = F.greatest(F.lit(0), F.least("finish", "block_end") - F.greatest("begin", "block_start"))
    taken = met.select("row", "slot", overlap.alias("words")).where("words > 0").groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = placed.join(taken, "row", "left")
    return out.select("id", "source", "hash", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, slots: int = SLOTS, seed: int = 17) -> DataFrame:
    """``(id, size, source_size, target, taken, first_slot)``: the words that the mix takes of each document, and the schedule's first slot for them.

    Size is the number of words, 0 for a null text. A null source is a source of its own, the last.
    ``taken`` counts repeats; a source's taken words add up to its target rounded down, and no
    document is taken over ``most`` times. The order is a hash of the id, so reruns agree; rows of an
    equal id and size are interchangeable. Documents without words take nothing and have no slot.
    """
    src = only(docs, id=id_col, text=text_col, source=source_col).withColumn("hash", F.xxhash64("text"))
    return _mixed(src, weights, most, slots, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_slot")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None, slot_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, slots: int = SLOTS, seed: int = 17) -> DataFrame:
    """The mix itself: each row, all columns, as often as :func:`mix_sources` takes it.

    A row of ``size`` words of which ``taken`` are taken appears ``taken div size`` times whole and,
    if words remain, once with its first ``taken % size`` words. Rows are told apart by two hashes of all
    their columns; only rows that are equal in every column are taken together. ``chars_col`` gets the number of
    characters; ``slot_col`` is a further column with the row's first slot, by which the mix can be ordered.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), row_digest(docs).alias("hash"))
    rows = _mixed(keyed.select("id", "text", "source", "hash"), weights, most, slots, seed).where("taken > 0")
    takes = rows.groupBy(F.col("hash.x").alias("x"), F.col("hash.y").alias("y")).agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.min("first_slot").alias("slot"), F.count("*").alias("of"))
    takes = Workspace(docs.sparkSession, "mix-documents").table(takes, "takes")
    own = keyed.select("doc", F.col("hash.x").alias("x"), F.col("hash.y").alias("y"))
    if not takes.where("of > 1").isEmpty():
        own = own.dropDuplicates(["x", "y"])  # of rows equal in all columns
    met = own.join(takes, ["x", "y"])
    rest = F.col("taken") % F.col("size")
    times = F.expr("array_repeat(0L, cast(taken div size as int))")
    met = met.withColumn("words", F.explode(F.concat(times, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))
    # cut behind each word: a piece is a word and what separates it from the one before
    text = F.col("doc").getField(text_col)
    first = F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("words").cast("int")), "")
    met = met.withColumn("new", F.when(F.col("words") > 0, first).otherwise(text))
    fields = {text_col: F.col("new")} | ({chars_col: F.length("new").cast(docs.schema[chars_col].dataType)} if chars_col else {})
    return met.select(*(fields.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns), *([F.col("slot").alias(slot_col)] if slot_col else []))
