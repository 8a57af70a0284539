"""Similarity join of documents on word shingles by PartEnum signatures.

Two sets with Jaccard similarity of g or more differ in at most
``(|r| + |s|) (1 - g) / (1 + g)`` elements. Sets are put into size bands; within a
band, and across each border of two bands, that bound is one number k. The feature
domain is hashed into ``n1`` partitions, each again into ``n2``; one of the ``n1``
holds at most ``k2`` of the differences, so two similar sets agree on at least one
of its subsets of ``n2 - k2`` partitions. The content of such a subset is a
signature. Nothing is sampled: similar sets share a signature always.

Signatures of nothing would join everything, so they are left out. A set with so
many of them that the guarantee needs one is joined with its like through its
smallest elements (the prefix that two similar sets cannot both miss).

Equal sets count as one class from the start. Classes that share a signature are
tested by folded parity sketches, which never reject a similar pair, and what
passes is verified on the sets themselves. Of pairs within one component only as many
are verified as it takes to find the components; for the links themselves all classes of
a component meet in blocks, where every pair is counted exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .store import FILTER_BITS, Workspace, key_filter, only, row_digest, split_by_keys, trimmed, trimmed_group

PORTION = 1 << 20
#: A larger group of classes is dealt to tasks as pairs of blocks of this size.
BLOCK = 2048
#: Pairs of a group that are tested at once.
PAIRS = 250_000
#: One in so many groups takes part in the first round.
EARLY = 16
#: Classes and elements of a block in which the classes of one component meet, on average.
LINK_CLASSES, LINK_ELEMENTS = 256, 1 << 20
#: Elements counted at once for the pairs of two blocks.
COLUMNS = 4096


class PartEnum:
    """Sizes and subset schemes for a similarity of ``num / den`` (0.5 at least)."""

    def __init__(self, num: int = 80, den: int = 100):
        if not den // 2 < num <= den:
            raise ValueError("the similarity must be over 0.5 and at most 1")
        self.num, self.den = num, den

    def differences(self, a, b):
        """The most elements in which two sets of these sizes may differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def instances(self, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """Number, sets that take part and k of each instance: even numbers are bands, odd ones the borders above them."""
        if not len(size):
            return
        for band in range(int(size.max()).bit_length()):
            low, high = 1 << band, (2 << band) - 1
            yield 2 * band, np.flatnonzero((size >= low) & (size <= high)), int(self.differences(high, high))
            top = high * self.den // self.num
            bottom = -(-(high + 1) * self.num // self.den)
            yield 2 * band + 1, np.flatnonzero((size >= bottom) & (size <= top)), int(self.differences(high, top))

    @staticmethod
    def scheme(k: int) -> tuple[int, int, int]:
        """n1, n2 and k2: a signature is two of three partitions, which are rarely both empty; some more of the n1 than the bound asks for make up for those that are."""
        n2, k2 = 3, 1
        spare = 1 + k // 12 if k else 0
        return k // (k2 + 1) + 1 + spare, n2, k2

    def signatures(self, owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures and the sets they belong to, for sets given as sorted distinct (owner, value)."""
        size = np.bincount(owner, minlength=n)
        end = np.cumsum(size)
        place, content = K.mix(value + np.uint64(7)), K.mix(value + np.uint64(11))
        sets, out = [], []
        for instance, who, k in self.instances(size):
            if not len(who) or k == 0:
                continue
            n1, n2, k2 = self.scheme(k)
            length = size[who]
            at = np.repeat((end - size)[who] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            mine = np.repeat(np.arange(len(who)), length)
            cell = mine * (n1 * n2) + ((place[at] + np.uint64(instance)) % np.uint64(n1 * n2)).astype(np.int64)
            total = np.zeros(len(who) * n1 * n2, np.uint64)
            np.add.at(total, cell, content[at])
            count = np.bincount(cell, minlength=len(total)).reshape(-1, n2)
            total = total.reshape(-1, n2)
            subsets = list(itertools.combinations(range(n2), n2 - k2))
            filled = np.stack([count[:, s].sum(1) > 0 for s in subsets], 1)
            tag = K.mix((np.arange(n1)[:, None] * len(subsets) + np.arange(len(subsets))).astype(np.uint64) + np.uint64(instance << 40))
            named = K.mix(np.stack([total[:, s].sum(1, dtype=np.uint64) for s in subsets], 1) + np.tile(tag, (len(who), 1)))
            keep = filled.ravel()
            out.append(named.ravel()[keep])
            sets.append(np.repeat(who, n1 * len(subsets))[keep])
            poor = (~filled.all(1)).reshape(len(who), n1).sum(1) >= n1 - k // (k2 + 1)
            if poor.any():
                prefix = length - -(-length * self.num // self.den) + 1
                order = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
                take = np.repeat(poor, length) & (order < np.repeat(prefix, length))
                out.append(K.mix(value[at[take]] ^ np.uint64((instance + 1) * 0x5851F42D4C957F2D % (1 << 64))))
                sets.append(who[mine[take]])
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(sets)


def sketches(owner: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """One parity bit per hashed element and set; two sketches differ in no more bits than the sets in elements."""
    width = np.maximum(64, 2 << np.ceil(np.log2(size + 1)).astype(np.int64))
    start = np.cumsum(width) - width
    bit = start[owner] + (K.mix(value + np.uint64(23)) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(bit, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[s // 8 : (s + w) // 8] for s, w in zip(start, width, strict=True)]


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of portions of a batch (id, text, …): their rows, owner, value and size of the shingle sets."""
    data, offsets = K.flat(batch.column(1))
    for i, j in K.portions(offsets, PORTION):
        part = K.LOWER[data[offsets[i] : offsets[j]]]
        owner, value = K.shingles(part, offsets[i : j + 1] - offsets[i], n)
        yield batch.slice(i, j - i), owner, value, np.bincount(owner, minlength=j - i)


def _classes(owner, value, size) -> np.ndarray:
    """A signed 64-bit name for each distinct set."""
    return K.mix(K.sums(owner, K.mix(value), len(size)) ^ K.mix(size.astype(np.uint64))).view(np.int64)


def _profiles(n: int):
    @trimmed
    def run(batches):
        for batch in batches:
            for rows, owner, value, size in _sets(batch, n):
                cls = _classes(owner, value, size)
                sketch = sketches(owner, value, size)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size.astype(np.int64)), pa.array(cls), pa.array(sketch, pa.binary()), *rows.columns[2:]], names=["id", "n", "cls", "sketch", *rows.schema.names[2:]])

    return run


def _signature_blobs(n: int, scheme: PartEnum, bits: int):
    def cut(sig, cls):
        order = np.argsort(sig, kind="stable")
        sig, cls = sig[order], cls[order]
        bucket = (sig >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(sig), np.int32)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        rows = [(int(bucket[i]), sig[i:j].tobytes(), cls[i:j].tobytes()) for i, j in itertools.pairwise(edge)]
        return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "sig": pa.array([r[1] for r in rows], pa.binary()), "cls": pa.array([r[2] for r in rows], pa.binary())})

    @trimmed
    def run(batches):
        seen, sigs, owners, held = np.zeros(0, np.int64), [], [], 0
        for batch in batches:
            for _, owner, value, size in _sets(batch, n):
                cls = _classes(owner, value, size)
                fresh = np.zeros(len(cls), bool)
                fresh[np.unique(cls, return_index=True)[1]] = True
                fresh &= ~np.isin(cls, seen) & (size > 0)
                seen = np.union1d(seen, cls[fresh])
                keep = fresh[owner]
                sig, who = scheme.signatures((np.cumsum(fresh) - 1)[owner[keep]], value[keep], int(fresh.sum()))
                sigs.append(sig)
                owners.append(cls[fresh][who])
                held += len(sig)
                if held > 1_000_000:
                    yield cut(np.concatenate(sigs), np.concatenate(owners))
                    sigs, owners, held = [], [], 0
        if held:
            yield cut(np.concatenate(sigs), np.concatenate(owners))

    return run


def _groups(table: pa.Table, bits: int) -> pa.Table:
    """Of one bucket: the distinct groups of classes that share a signature."""
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint64)
    cls = np.frombuffer(b"".join(table["cls"].to_pylist()), np.int64)
    order = np.argsort(sig, kind="stable")
    sig, cls = sig[order], cls[order]
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True])
    count = np.diff(edge)
    many = np.repeat(count > 1, count)
    sig, cls = sig[many], cls[many]
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])][: len(sig)]
    sig, cls = sig[keep], cls[keep]
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1], True]) if len(sig) else np.zeros(1, np.int64)
    count = np.diff(edge)
    group = np.repeat(np.arange(len(count)), count)
    name = K.mix(K.sums(group, K.mix(cls.view(np.uint64)), len(count)) + count.astype(np.uint64))
    first = np.zeros(len(count), bool)
    first[np.unique(name, return_index=True)[1]] = True
    first &= count > 1
    gid, member = [np.repeat(name, count)[first[group]]], [cls[first[group]]]
    large = np.flatnonzero(first & (count > 2 * BLOCK))
    if len(large):
        small = ~np.isin(gid[0], name[large])
        gid, member = [gid[0][small]], [member[0][small]]
        for g in large:
            whole = cls[edge[g] : edge[g + 1]]
            blocks = [whole[i : i + BLOCK] for i in range(0, len(whole), BLOCK)]
            for i, j in itertools.combinations(range(len(blocks)), 2):
                both = np.concatenate([blocks[i], blocks[j]])
                gid.append(np.full(len(both), K.mix(np.array([name[g] + np.uint64(i * len(blocks) + j)]))[0]))
                member.append(both)
    gid, member = np.concatenate(gid), np.concatenate(member)
    # packed by the name of the group, for the step that drops groups which other buckets found too
    order = np.argsort(gid, kind="stable")
    gid, member = gid[order], member[order]
    part = (gid >> np.uint64(64 - bits)).astype(np.int32)
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    rows = [(int(part[i]), gid[i:j].tobytes(), member[i:j].tobytes()) for i, j in itertools.pairwise(edge)]
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "gid": pa.array([r[1] for r in rows], pa.binary()), "cls": pa.array([r[2] for r in rows], pa.binary())})


@trimmed_group
def _distinct_groups(table: pa.Table) -> pa.Table:
    """Each group once: near copies share very many signatures, in very many buckets."""
    gid = np.frombuffer(b"".join(table["gid"].to_pylist()), np.int64)
    cls = np.frombuffer(b"".join(table["cls"].to_pylist()), np.int64)
    order = np.lexsort((cls, gid))
    gid, cls = gid[order], cls[order]
    keep = np.r_[True, (gid[1:] != gid[:-1]) | (cls[1:] != cls[:-1])][: len(gid)]
    return pa.table({"gid": gid[keep], "cls": cls[keep]})


def _halved(sketch: np.ndarray) -> np.ndarray:
    half = sketch.shape[1] // 2
    return sketch[:, :half] ^ sketch[:, half:]


def _tested(scheme: PartEnum, size, sketch, comp, left, right) -> np.ndarray:
    """Which pairs may be similar, by their sizes and sketches, and are not yet in one component."""
    small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    may = (small * scheme.den >= large * scheme.num) & (comp[left] != comp[right])
    at = np.flatnonzero(may)
    width = np.array([len(x) for x in sketch], np.int64)
    rows: dict[int, np.ndarray] = {}
    index = np.zeros(len(sketch), np.int64)
    for w in np.unique(width):
        who = np.flatnonzero(width == w)
        index[who] = np.arange(len(who))
        rows[int(w)] = np.frombuffer(b"".join(sketch[i] for i in who), np.uint64).reshape(len(who), -1)
    wa, wb = width[left[at]], width[right[at]]
    for w in np.unique(np.maximum(wa, wb)):
        for v in (w, w // 2):
            pick = at[(np.maximum(wa, wb) == w) & (np.minimum(wa, wb) == v)]
            step = max(1, (16 << 20) // int(w))
            for s in range(0, len(pick), step):
                p = pick[s : s + step]
                a, b = left[p], right[p]
                swap = width[a] > width[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                big = rows[int(w)][index[b]]
                big = big if v == w else _halved(big)
                apart = np.bitwise_count(rows[int(v)][index[a]] ^ big).sum(1)
                may[p] = apart <= scheme.differences(size[a], size[b])
    return may


def _rows_of_pairs(g: int) -> Iterator[tuple[int, int]]:
    """Ranges of the members of a group of g, each with no more than PAIRS earlier partners in all, if one member has no more."""
    low = 1
    while low < g:
        high = min(g, max(low + 1, int((low * low + 2 * PAIRS) ** 0.5)))
        yield low, high
        low = high


def _pairs(scheme: PartEnum, few: bool):
    """Pairs to verify in each group; few: of each member the first and last earlier partner, of two components one pair."""

    def work(gid, cls, size, comp, sketch):
        order = np.lexsort((cls, size, gid))
        gid, cls, size, comp = gid[order], cls[order], size[order], comp[order]
        sketch = [sketch[i] for i in order]
        same = np.r_[False, (gid[1:] == gid[:-1]) & (cls[1:] == cls[:-1])]
        keep = np.flatnonzero(~same)
        gid, cls, size, comp, sketch = gid[keep], cls[keep], size[keep], comp[keep], [sketch[i] for i in keep]
        edge = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1], True])
        count = np.diff(edge)
        found_a, found_b = [], []
        for g in np.unique(count):
            starts = edge[:-1][count == g]
            for low, high in _rows_of_pairs(int(g)):
                hi = np.repeat(np.arange(low, high), np.arange(low, high))
                lo = np.arange(len(hi)) - np.repeat(np.cumsum(np.arange(low, high)) - np.arange(low, high), np.arange(low, high))
                step = max(1, PAIRS // max(1, len(hi)))
                for s in range(0, len(starts), step):
                    some = starts[s : s + step]
                    left, right = (some[:, None] + lo).ravel(), (some[:, None] + hi).ravel()
                    ok = _tested(scheme, size, sketch, comp, left, right)
                    left, right = left[ok], right[ok]
                    if few and len(left):
                        new = np.r_[True, right[1:] != right[:-1]]
                        end = np.r_[new[1:], True]
                        left, right = left[new | end], right[new | end]
                        one, two = np.minimum(comp[left], comp[right]), np.maximum(comp[left], comp[right])
                        group = np.searchsorted(edge, right, "right")
                        order = np.lexsort((two, one, group))
                        same = (np.diff(group[order]) == 0) & (np.diff(one[order]) == 0) & (np.diff(two[order]) == 0)
                        pick = order[np.r_[True, ~same]]
                        left, right = left[pick], right[pick]
                    found_a.append(cls[left])
                    found_b.append(cls[right])
        a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    @trimmed
    def run(batches):
        kept: list[pa.RecordBatch] = []
        held = 0

        def flush(rows):
            t = pa.Table.from_batches(rows)
            return work(*(t[c].to_numpy() for c in ("gid", "cls", "n", "comp")), t["sketch"].to_pylist())

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            held += batch.nbytes
            if held < 8 << 20:
                continue
            gid = batch["gid"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])[-1])
            if cut:
                yield flush([*kept[:-1], batch.slice(0, cut)])
                kept = [batch.slice(cut)]
                held = kept[0].nbytes
        if kept:
            yield flush(kept)

    return run


def _picked_sets(n: int, chosen, width: int):
    """The shingle sets, six bytes an element, and their names, of the documents whose bit is set."""

    @trimmed
    def run(batches):
        bits = np.frombuffer(chosen.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy().astype(np.int64) - 1
            some = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            for _, owner, value, size in _sets(some, n):
                raw = np.ascontiguousarray(value).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                end = np.cumsum(size) * width
                yield pa.RecordBatch.from_pydict({"cls": pa.array(_classes(owner, value, size)), "items": pa.array([raw[e - s * width : e] for e, s in zip(end, size, strict=True)], pa.binary())})

    return run


def _items(raw: bytes, width: int) -> np.ndarray:
    padded = np.zeros((len(raw) // width, 8), np.uint8)
    padded[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return padded.view(np.uint64).ravel()


def _verified(scheme: PartEnum, width: int):
    @trimmed
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch["items_a"].to_pylist(), batch["items_b"].to_pylist(), strict=True):
                p, q = _items(x, width), _items(y, width)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                linked.append(scheme.den * both >= scheme.num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "linked": pa.array(linked, pa.bool_())})

    return run


def _picked(ws: Workspace, docs: DataFrame, ids: DataFrame, n: int, width: int) -> DataFrame:
    """``(cls, items)`` of the documents of these ids, and of few others."""
    position = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    chosen = bytearray(FILTER_BITS // 8)
    for row in key_filter(ids).toLocalIterator():  # FILTER_BITS / 32768 rows of 4 KB at most
        chosen[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
    bits = ws.spark.sparkContext.broadcast(bytes(chosen))
    return ws.table(docs.select("id", "text", position.alias("p")).mapInArrow(_picked_sets(n, bits, width), "cls long, items binary"), "sets")


def _links(ws: Workspace, docs: DataFrame, pairs: DataFrame, classes: DataFrame, scheme: PartEnum, n: int) -> DataFrame:
    """``(a, b, linked)``: each pair of classes verified on the sets."""
    width = 6
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))
    picked = _picked(ws, docs, ends.join(classes.select("cls", "rep"), "cls").select("rep"), n, width)
    of_a = picked.select(F.col("cls").alias("a"), F.col("items").alias("items_a"))
    of_b = picked.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
    out = ws.table(pairs.join(of_a, "a").join(of_b, "b").mapInArrow(_verified(scheme, width), "a long, b long, linked boolean"), "links")
    ws.drop(picked)
    return out


def _common(owner: np.ndarray, value: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``, for sets given as (owner, value)."""
    _, code, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[code]
    owner, code = owner[keep], (np.cumsum(shared) - 1)[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(left), len(right)), np.float32)
    n, codes = int(max(left[-1], right[-1])) + 1, int(shared.sum())
    for c in range(0, codes, COLUMNS):
        a, b = np.searchsorted(code, [c, c + COLUMNS])
        has = np.zeros((n, min(COLUMNS, codes - c)), np.float32)
        has[owner[a:b], code[a:b] - c] = 1
        total += has[left] @ has[right].T
    return total.astype(np.int64)


def _linked(scheme: PartEnum, width: int):
    """Every pair of similar classes of rows (component, low, high, block, cls, items), of which a group is two blocks of a component or one."""

    def work(t: pa.Table) -> pa.RecordBatch:
        component, low, high, block, cls = (t[c].to_numpy() for c in ("component", "low", "high", "block", "cls"))
        items = t["items"].to_pylist()
        edge = np.flatnonzero(np.r_[True, (component[1:] != component[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), True])
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in itertools.pairwise(edge):
            at = i + np.sort(np.unique(cls[i:j], return_index=True)[1])  # documents of a repeated id may bring a class twice
            left, right = np.flatnonzero(block[at] == low[i]), np.flatnonzero(block[at] == high[i])
            if not len(left) or not len(right):
                continue
            sets = [items[k] for k in at]
            size = np.array([len(x) // width for x in sets])
            both = _common(np.repeat(np.arange(len(at)), size), _items(b"".join(sets), width), left, right)
            similar = scheme.den * both >= scheme.num * (size[left][:, None] + size[right] - both)
            if low[i] == high[i]:
                similar = np.triu(similar, 1)
            x, y = np.nonzero(similar)
            found_a.append(cls[at[left[x]]])
            found_b.append(cls[at[right[y]]])
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(found_a)), "b": pa.array(np.concatenate(found_b))})

    @trimmed
    def run(batches):
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch[c].to_numpy() for c in ("component", "low", "high")], 1)
            fresh = np.r_[last is not None and (names[0] != last).any(), (names[1:] != names[:-1]).any(1)]
            last = names[-1]
            if fresh.any():
                cut = int(np.flatnonzero(fresh)[-1])
                yield work(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
                batch = batch.slice(cut)
            kept.append(batch)
        if kept:
            yield work(pa.Table.from_batches(kept))

    return run


def _class_links(ws: Workspace, docs: DataFrame, classes: DataFrame, scheme: PartEnum, n: int) -> DataFrame:
    """``(a, b)``: each pair of similar classes once. Similar classes are in one component, so none is missed."""
    width = 6
    held = classes.groupBy("component").agg(F.count("*").alias("of"), F.sum("n").alias("held")).where("of > 1")
    blocks = F.greatest(F.ceil(F.col("of") / LINK_CLASSES), F.ceil(F.col("held") / LINK_ELEMENTS))
    dealt = classes.join(held.select("component", blocks.alias("blocks")), "component")
    dealt = ws.table(dealt.select("cls", "rep", "component", "blocks", F.pmod(F.xxhash64("cls"), "blocks").alias("block")), "dealt")
    picked = _picked(ws, docs, dealt.select("rep"), n, width)
    rows = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("cls", "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block").join(picked, "cls")
    key = ["component", "low", "high"]
    dealt_rows = rows.repartition(*key).sortWithinPartitions(*key).select(*key, "block", "cls", "items")
    out = ws.table(dealt_rows.mapInArrow(_linked(scheme, width), "a long, b long"), "class_links")
    ws.drop(picked)
    return out


def _matched(ws: Workspace, src: DataFrame, scheme: PartEnum, n: int) -> tuple[DataFrame, DataFrame]:
    """``(id, n, cls)`` of each row, and ``(cls, rep, n, copies, component)`` of each class; components are named by a class."""
    further = "".join(f", {c} binary" for c in src.columns[2:])
    profile = ws.table(src.mapInArrow(_profiles(n), f"id long, n long, cls long, sketch binary{further}"), "profile")
    known = profile.where("n > 0 and id is not null")
    classes = ws.table(known.groupBy("cls").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.count("*").alias("copies")), "classes")
    total = profile.agg(F.sum("n")).head()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, total) * 0.6 / 400_000 + 1)))  # a bucket does not grow with the corpus
    blobs = src.where("id is not null").select("id", "text").mapInArrow(_signature_blobs(n, scheme, bits), "bucket int, sig binary, cls binary")
    packed = blobs.groupBy("bucket").applyInArrow(trimmed_group(lambda bucket: _groups(bucket, bits)), "part int, gid binary, cls binary")
    groups = ws.table(packed.groupBy("part").applyInArrow(_distinct_groups, "gid long, cls long"), "groups")
    ws.release()
    members = groups.join(classes, "cls").select("gid", "cls", "n", "sketch")

    def candidates(some: DataFrame, few: bool) -> DataFrame:
        rows = some.withColumn("comp", F.col("cls")) if comp is None else some.join(comp, some.cls == comp.vertex, "left").select("gid", "cls", "n", "sketch", F.coalesce("component", "cls").alias("comp"))
        pairs = rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(_pairs(scheme, few), "a long, b long").distinct()
        return ws.table(pairs if links is None else pairs.join(links.select("a", "b"), ["a", "b"], "left_anti"), "pairs")

    # Copies of one text share nearly all their groups: a part of the groups joins them, then only
    # pairs across components are left, of which the last round verifies every one.
    comp = links = None
    for some, few in ((members.where(F.pmod("gid", F.lit(EARLY)) == 0), True), (members, True), (members, False)):
        pairs = candidates(some, few)
        if links is None or not pairs.isEmpty():
            found = _links(ws, src, pairs, classes, scheme, n)
            links = found if links is None else links.unionByName(found)
            comp = components(ws, links.where("linked"))
    ws.release()
    named = classes.join(comp, classes.cls == comp.vertex, "left").select("cls", "rep", "n", "copies", F.coalesce("component", "cls").alias("component"))
    return profile.select("id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls"), *src.columns[2:]), ws.table(named, "named")


def _named(ws: Workspace, profile: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``profile`` with their class's columns and ``head``, the least id of the component, to which a repeated id belongs as a whole."""
    heads = classes.groupBy("component").agg(F.min("rep").alias("head"))
    classes = ws.table(classes.drop("n").join(heads, "component"), "heads")
    known = profile.where("cls is not null and id is not null")
    torn = ws.table(known.groupBy("id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x < y").select("id"), "torn")
    if not torn.isEmpty():
        rows = ws.table(known.join(torn, "id").join(classes, "cls").select("id", "head").distinct(), "rows")
        united = components(ws, rows.join(rows.groupBy("id").agg(F.min("head").alias("a")), "id").select("a", F.col("head").alias("b")))
        classes = classes.join(united, classes["head"] == united["vertex"], "left").select("cls", "rep", "copies", F.coalesce(united["component"], "head").alias("head"))
    return profile.join(classes, "cls", "left")


def _columns(id_col: str) -> list:
    known = F.col("id").isNotNull()
    return [
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("head", "id")).alias("component_id"),
        F.when(known, F.coalesce("rep", "id")).alias("class_id"),
        F.when(known, F.coalesce("copies", F.lit(1))).cast("long").alias("copies"),
    ]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``num / den`` or more.

    Returns ``(id, n_shingles, component_id, class_id, copies)`` with the name of the id column kept:
    ``class_id`` is the least id among documents of an equal set, ``copies`` their number. For the
    links themselves see :func:`ngram_jaccard_links`.

    Words are runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased. A text of
    fewer than n words is one shingle; null and empty texts have none and link with nothing. Ids
    must be whole numbers; rows of a repeated id count as documents of their own with that id, and
    a null id makes a row of its own component (null). Long texts are processed whole.
    """
    ws, scheme = Workspace(docs.sparkSession, "ngram-jaccard"), PartEnum(num, den)
    profile, classes = _matched(ws, _source(docs, id_col, text_col), scheme, n)
    return _named(ws, profile, classes).select(*_columns(id_col))


def ngram_jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of :func:`ngram_jaccard_join` with ``n_links``: how many other documents each one is similar to.

    Every pair of different sets is verified, and each counts with all its copies, as the copies of the
    document's own set do. Null for a null id, which is in no join.
    """
    ws, scheme = Workspace(docs.sparkSession, "ngram-jaccard-links"), PartEnum(num, den)
    src = _source(docs, id_col, text_col)
    profile, classes = _matched(ws, src, scheme, n)
    pairs = _class_links(ws, src, classes, scheme, n)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("cls").alias("b"), F.col("copies").alias("of_b")), "b").groupBy("a").agg(F.sum("of_b").alias("others"))
    rows = _named(ws, profile, classes).join(others.withColumnRenamed("a", "cls"), "cls", "left")
    n_links = F.when(F.col("id").isNotNull(), F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).cast("long")
    return rows.select(*_columns(id_col), n_links.alias("n_links"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows, all columns, that are no near copies of a row that stays: of each group of linked rows one.

    Rows, not ids, are grouped: rows that repeat an id with texts of their own are decided each by its own
    text, so nothing goes that has no near copy which stays. Of a group the row of the least id stays,
    of several rows of that id the one of the least MD5 of the text, of rows equal in both the one of the
    least hash of all columns. A row without an id or without words is in no group and stays. Ids must be
    whole numbers.
    """
    ws = Workspace(docs.sparkSession, "one-of-each-group")
    mark = F.unhex(F.md5(F.col(text_col)))
    src = _source(docs, id_col, text_col).withColumn("mark", F.unhex(F.md5("text")))
    profile, classes = _matched(ws, src, PartEnum(num, den), n)
    rows = profile.where("cls is not null and id is not null").join(classes.select("cls", "component"), "cls").select("component", F.struct("id", "mark").alias("row"))
    first = rows.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("of")).where("of > 1")
    # whether the rows of an id and text stay; where such rows repeat and stay, one of them does
    decided = rows.join(first, "component").groupBy("row").agg(F.bool_or(F.col("row") == F.col("first")).alias("stays"), F.count("*").alias("times"))
    decided = ws.table(decided.where("not stays or times > 1").select("row.id", "row.mark", "stays"), "decided")
    # rows that surely are no copies pass by
    ident = F.col(id_col).cast("long")
    apart, met = split_by_keys(docs, ident, ws.table(key_filter(decided.select("id")), "filter"))
    names = decided.select(F.col("id").alias("_row_id"), F.col("mark").alias("_row_mark"), F.col("stays").alias("_row_stays"))
    met = met.join(names, (ident == F.col("_row_id")) & (mark == F.col("_row_mark")), "left")
    out = apart.unionByName(met.where("_row_stays is null").select(docs.columns))
    if decided.where("stays").isEmpty():
        return out
    again = met.where("_row_stays").groupBy("_row_id", "_row_mark").agg(F.min_by(F.struct(*docs.columns), row_digest(docs)).alias("row"))
    return out.unionByName(again.select("row.*"))
