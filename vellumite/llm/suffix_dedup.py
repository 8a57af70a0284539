"""Exact removal of repeated passages by blockwise suffix sorting.

A passage repeats if a string of ``length`` bytes starts at two places or more. The
suffixes that may tell are put into buckets by content: of the q-grams in the first
``length`` bytes of a suffix, the one of least hash is its anchor, and equal strings have
equal anchors at equal offsets. Anchors that occur once need no more work. Those that
recur send the stretch of text whose suffixes they own to the bucket of the anchor.

Each bucket is sorted by itself. The suffixes at the places of a difference cover
modulo 13 are ranked first, by doubling: a rank stands for as many bytes as ``length``
allows. The suffixes are then put into the order of their first ``length`` bytes: by the
first eight, then by the rank of the cover place at most five bytes on, then by the few
bytes that the rank leaves at the end. Ties of any length end there, and no bucket needs
the text of another: ranks over the whole corpus would be a sort of all of it, ranks of
one bucket are bounded by it. Neighbours that are equal in that order are the repeated
strings. A stretch that a task meets more than once is sent once: all its suffixes repeat,
so its places need no sorting, and an anchor that everybody has stays a small bucket.

Equal texts are found by their hash and need no suffixes at all; texts of one hash that
differ in a second one get another hash.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from . import kernels as K
from .store import Workspace, key_filter, only, split_by_keys, trimmed, trimmed_group

LENGTH = 200
#: Bytes of an anchor, and of a repeated string at least.
QGRAM, SHORTEST = 32, 40
#: Hashes that are tried to name the texts, until no two texts share one.
SEEDS = 32
PORTION = 1 << 20
#: The difference cover modulo 13: every residue is a difference of two of these.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Bytes of text to aim at in a bucket, and held in a task before they are sent.
BUCKET, HELD = 2 << 20, 8 << 20
#: Bits of the filter of recurring anchors at most: 32 MB.
FILTER_BITS = 1 << 28


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Text, first suffix, number of suffixes, anchor place and hash of the stretches of texts."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.view(np.uint64)
    word = K.mix(K.at8(data)[:n])
    grams = n - QGRAM + 1
    h = np.zeros(grams, np.uint64)
    for k in range(QGRAM // 8):
        h += word[8 * k : 8 * k + grams] * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x51ED270B)
    h ^= h >> np.uint64(29)
    # the hash above, the place below: a minimum is the leftmost of the least hash
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    span, reach = length - QGRAM + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: n - length + 1], least[span - reach : span - reach + n - length + 1])
    place = (least[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    whole = np.arange(n - length + 1) + length <= offsets[1:][text]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.r_[new[1:] | ~whole[1:], True] & whole) + 1
    return text[first], first, stop - first, place[first], K.mix(h[place[first]])


def _fresh_texts(batches, seen_most: int = 4_000_000):
    """Portions of the texts not yet met in this task: keys, data, offsets."""
    seen: set[int] = set()
    for batch in batches:
        keys = batch.column(1).to_numpy()
        new = np.zeros(len(keys), bool)
        for r, key in enumerate(keys.tolist()):
            if key not in seen:
                seen.add(key)
                new[r] = True
        if len(seen) > seen_most:
            seen.clear()
        some = batch.filter(pa.array(new))
        data, offsets = K.flat(some.column(0))
        keys = some.column(1).to_numpy()
        for i, j in K.portions(offsets, PORTION):
            yield keys[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _counted(length: int, bits: int):
    """Distinct anchors of a task, by bucket, those met twice apart."""

    def cut(parts):
        key, count = np.unique(np.concatenate(parts), return_counts=True)
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        rows = [(int(bucket[i]), key[i:j][count[i:j] == 1].tobytes(), key[i:j][count[i:j] > 1].tobytes()) for i, j in itertools.pairwise(edge)]
        return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "once": pa.array([r[1] for r in rows], pa.binary()), "more": pa.array([r[2] for r in rows], pa.binary())})

    @trimmed
    def run(batches):
        parts, held = [], 0
        for _, data, offsets in _fresh_texts(batches):
            parts.append(_anchors(data, offsets, length)[4])
            held += len(parts[-1])
            if held > 1_000_000:
                yield cut(parts)
                parts, held = [], 0
        if held:
            yield cut(parts)

    return run


def _recurring(bits: int, filter_bits: int):
    """Of a bucket: its slice of the filter, with the bits of the anchors that recur, and their number."""

    @trimmed_group
    def run(table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table["once"].to_pylist()), np.uint64)
        more = np.frombuffer(b"".join(table["more"].to_pylist()), np.uint64)
        key, count = np.unique(np.concatenate([once, more, more]), return_counts=True)
        again = key[count > 1]
        slice_bits = filter_bits >> bits
        at = (again >> np.uint64(64 - int(math.log2(filter_bits)))).astype(np.int64) & (slice_bits - 1)
        marks = np.zeros(slice_bits, np.uint8)
        marks[at] = 1
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary()), "n": pa.array([int(count[count > 1].sum())], pa.int64())})

    return run


_STRETCH = "bucket int, anchor binary, shift binary, owned binary, name binary, bytes binary, of binary, text binary, start binary, sure_text binary, sure_start binary, sure_end binary"


def _stretches(length: int, shared, filter_bits: int, bits: int):
    """The stretches of recurring anchors by bucket, each once with its first place; of those met twice, the places too, by text, as runs that are sure."""

    def cut(parts):
        anchor, shift, owned, name, text, start, raw = (np.concatenate([p[k] for p in parts]) if k < 6 else [x for p in parts for x in p[6]] for k in range(7))
        # a stretch is named by the hash of its bytes, its anchor and where that lies
        _, one, of = np.unique(name, return_index=True, return_inverse=True)
        bucket = (anchor[one] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = place[of]
        one, bucket = one[order], bucket[order]
        by = np.argsort(of, kind="stable")
        of, text, start = of[by], text[by], start[by]
        sure = np.bincount(of)[of] > 1
        length_of = owned[one].astype(np.int64) + length - 1
        sure_text, sure_start, sure_end = text[sure], start[sure], (start + length_of[of])[sure]
        first = np.r_[True, of[1:] != of[:-1]]
        of, text, start = of[first], text[first], start[first]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        out = []
        for i, j in itertools.pairwise(edge):
            some = one[i:j]
            a, b = np.searchsorted(of, [i, j])
            out.append((int(bucket[i]), *(x[some].tobytes() for x in (anchor, shift, owned, name)), b"".join(raw[k] for k in some), (of[a:b] - i).astype(np.int32).tobytes(), text[a:b].tobytes(), start[a:b].tobytes(), b"", b"", b""))
        if len(sure_text):
            spread = (K.mix(sure_text.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sure_text), np.int64)
            order = np.argsort(spread, kind="stable")
            sure_text, sure_start, sure_end, spread = sure_text[order], sure_start[order], sure_end[order], spread[order]
            for i, j in itertools.pairwise(np.flatnonzero(np.r_[True, spread[1:] != spread[:-1], True])):
                out.append((int(spread[i]), *[b""] * 8, *(x[i:j].astype(np.int64).tobytes() for x in (sure_text, sure_start, sure_end))))
        names = [x.split()[0] for x in _STRETCH.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 0 else pa.binary()) for k in range(len(names))], names=names)

    @trimmed
    def run(batches):
        marks = np.frombuffer(shared.value, np.uint8)
        top = np.uint64(64 - int(math.log2(filter_bits)))
        parts, held = [], 0
        for keys, data, offsets in _fresh_texts(batches):
            text, first, owned, place, anchor = _anchors(data, offsets, length)
            at = (anchor >> top).astype(np.int64)
            keep = np.flatnonzero(marks[at >> 3] >> (at & 7) & 1)
            if not len(keep):
                continue
            text, first, owned, place, anchor = (x[keep] for x in (text, first, owned, place, anchor))
            stop = first + owned + length - 1
            name = K.mix(K.hashes(data, first, stop, seed=3) ^ K.mix(anchor + (place - first).astype(np.uint64)))
            whole = data.tobytes()
            raw = [whole[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
            parts.append((anchor, (place - first).astype(np.int32), owned.astype(np.int32), name, keys[text], first - offsets[text], raw))
            held += int((stop - first).sum())
            if held > HELD:
                yield cut(parts)
                parts, held = [], 0
        if parts:
            yield cut(parts)

    return run


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers below 2^32, in the order of the pairs."""
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]


def _ranked(length: int) -> int:
    """The bytes that a cover rank stands for: a multiple of 13 that ends within ``length`` from any cover place at most five bytes on."""
    return (length - 5) // MODULUS * MODULUS


def _cover_ranks(text: np.ndarray, cover: np.ndarray, length: int) -> np.ndarray:
    """At each cover place, the rank of its next ``_ranked(length)`` bytes among those of all cover places.

    ``cover`` ascends; the place 13 bytes on is one too, as far as the text goes on. Beyond the end
    come zeros, so only places with that many bytes left get ranks that mean what they say.
    """
    goal = _ranked(length)
    n = len(text) + goal + 64
    view = K.at8(np.concatenate([text, np.zeros(goal + 64, np.uint8)])).byteswap()
    rank = np.zeros(n, np.int64)
    head = np.unique(view[cover], return_inverse=True)[1]
    tail = np.unique(view[cover + 5], return_inverse=True)[1]
    rank[cover] = _paired(head, tail)
    held = MODULUS
    while held < goal:
        step = min(held, goal - held)  # the last two may overlap
        rank[cover] = _paired(rank[cover], rank[np.minimum(cover + step, n - 1)])
        held += step
    return rank


def sorted_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, residue: np.ndarray, cover: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of (group, first ``length`` bytes), and which of them equals the one before it there.

    Suffixes of one group have one residue modulo 13 relative to the cover, so one shift leads each to it.
    """
    rank = _cover_ranks(text, cover, length)
    shift = np.array([min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)])[residue]
    view = K.at8(text).byteswap()
    # what a rank leaves at the end: at most 17 bytes, whole words of which the last ends with the string
    ends = [view[start + length - 8 * k] for k in range(-(-(length - _ranked(length)) // 8), 0, -1)]
    keys = [group, view[start], rank[start + shift], *ends]
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(start), bool)
    same[1:] = np.logical_and.reduce([key[order[1:]] == key[order[:-1]] for key in keys])
    return order, same


def repeated_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, residue: np.ndarray, cover: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes share their first ``length`` bytes with another of their group: those with an equal neighbour in their order."""
    order, same = sorted_suffixes(text, start, group, residue, cover, length)
    again = np.zeros(len(start), bool)
    again[order] = same | np.r_[same[1:], False]
    return again


def _sorted_bucket(length: int, text_bits: int):
    @trimmed_group
    def run(table: pa.Table) -> pa.Table:
        col = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        anchor, shift, owned, name = col("anchor", np.uint64), col("shift", np.int32).astype(np.int64), col("owned", np.int32).astype(np.int64), col("name", np.uint64)
        size = np.array([len(x) // 8 for x in table["anchor"].to_pylist()])
        places = np.array([len(x) // 4 for x in table["of"].to_pylist()])
        of = col("of", np.int32).astype(np.int64) + np.repeat(np.cumsum(size) - size, places)
        key, start = col("text", np.int64), col("start", np.int64)
        data = col("bytes", np.uint8)
        _, one, back = np.unique(name, return_index=True, return_inverse=True)
        of = back[of]
        many = np.bincount(of, minlength=len(one)) > 1  # met by several tasks
        begin = (np.cumsum(owned + length - 1) - (owned + length - 1))[one]
        anchor, shift, owned = anchor[one], shift[one], owned[one]
        # an anchor of one stretch in one place recurs nowhere: it passed the filter by chance
        _, same = np.unique(anchor, return_inverse=True)
        live = (np.bincount(same)[same] > 1) | many
        # the kept stretches follow each other with their anchors at multiples of 13
        keep = np.flatnonzero(live)
        spans = owned[keep] + length - 1
        room = (spans + 2 * MODULUS) // MODULUS * MODULUS
        base = np.cumsum(room) - room
        lead = (-shift[keep]) % MODULUS
        new = base + lead
        text = np.zeros(int(room.sum()) + MODULUS, np.uint8)
        inner = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        text[np.repeat(new, spans) + inner] = data[np.repeat(begin[keep], spans) + inner]
        cover = np.flatnonzero(np.isin(np.arange(len(text)) % MODULUS, COVER))
        count = owned[keep]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        suffix = np.repeat(new, count) + step
        ahead = np.repeat(shift[keep], count) - step
        group = np.unique(_paired(np.repeat(same[keep], count), ahead), return_inverse=True)[1] if len(suffix) else suffix
        again = repeated_suffixes(text, suffix, group, suffix % MODULUS, cover, length) if len(suffix) else np.zeros(0, bool)
        again |= np.repeat(many[keep], count)
        owner = np.repeat(np.arange(len(keep)), count)
        edge = np.r_[True, (again[1:] != again[:-1]) | (owner[1:] != owner[:-1])] if len(again) else np.zeros(0, bool)
        at = np.flatnonzero(edge)
        stop = np.r_[at[1:], len(again)] if len(at) else at
        hit = again[at]
        at, stop = at[hit], stop[hit]
        run_owner, run_start = keep[owner[at]], step[at]
        run_end = run_start + (stop - at) + length - 1
        # each place of a stretch gets its runs
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=len(one))
        first = np.cumsum(count) - count
        reps = count[run_owner]
        spot = order[np.repeat(first[run_owner], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        keys = np.concatenate([key[spot], col("sure_text", np.int64)])
        starts = np.concatenate([start[spot] + np.repeat(run_start, reps), col("sure_start", np.int64)])
        ends = np.concatenate([start[spot] + np.repeat(run_end, reps), col("sure_end", np.int64)])
        bucket = (K.mix(keys.view(np.uint64)) >> np.uint64(64 - text_bits)).astype(np.int64)
        order = np.lexsort((starts, keys, bucket))
        keys, starts, ends, bucket = keys[order], starts[order], ends[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
        rows = [(int(bucket[i]), keys[i:j].tobytes(), starts[i:j].tobytes(), ends[i:j].tobytes()) for i, j in itertools.pairwise(cut)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), **{c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate(("text", "start", "end"), 1)}})

    return run


@trimmed_group
def _merged(table: pa.Table) -> pa.Table:
    """The maximal runs of each text."""
    key, start, end = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("text", "start", "end"))
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    text = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    # ends so far in a text: a shift by the text keeps a running maximum from crossing over
    wide = int(end.max()) + 1
    upto = np.maximum.accumulate(end + text * wide) - text * wide
    new = np.ones(len(key), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > upto[:-1])
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(key)] - 1
    spans = np.stack([start[at], upto[last]], 1)
    owner = key[at]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
    return pa.table({
        "key": pa.array(owner[edge[:-1]]), "n_spans": pa.array(np.diff(edge)), "n_removed": pa.array(np.add.reduceat(spans[:, 1] - spans[:, 0], edge[:-1])),
        "spans": pa.array([spans[i:j].astype("<i8").tobytes() for i, j in itertools.pairwise(edge)], pa.binary()),
    })


def _outside(text: str | None, spans: bytes | None) -> bytes | None:
    if text is None or spans is None:
        return None
    raw = text.encode()
    cut = np.frombuffer(spans, "<i8").reshape(-1, 2)
    return b"".join(raw[a:b] for a, b in zip([0, *cut[:, 1].tolist()], [*cut[:, 0].tolist(), len(raw)], strict=True))


@F.pandas_udf(BinaryType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The bytes of a text outside its spans."""
    return text.combine(spans, _outside)


@F.pandas_udf(StringType())
def _text_without(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The whole characters of a text outside its spans."""

    def one(t, s):
        raw = _outside(t, s)
        return None if raw is None else raw.decode(errors="ignore")

    return text.combine(spans, one)


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, ws: Workspace | None = None, key: Column | None = None) -> DataFrame:
    """``(key, n_spans, n_removed, spans)`` of the distinct texts with repeated passages.

    ``key`` is xxhash64 of the text, or what is given; ``spans`` packs the maximal runs as pairs of little-endian
    64-bit byte offsets. Copies of one text are not counted against each other here.
    """
    if length < SHORTEST:
        raise ValueError(f"repeated strings must have {SHORTEST} bytes or more")
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "suffix-dedup")
    key = F.xxhash64(text_col) if key is None else key
    src = docs.select(F.col(text_col).alias("text"), key.alias("key")).where(F.octet_length("text") >= length)
    total = src.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # buckets of a size: their number alone grows, the filter's slices get shorter
    bits = min(int(math.log2(FILTER_BITS)) - 6, max(4, math.ceil(math.log2(total / 80 / 500_000 + 1))))
    filter_bits = min(FILTER_BITS, max(1 << 20, 1 << math.ceil(math.log2(total / 40 + 1))))
    slices = src.mapInArrow(_counted(length, bits), "bucket int, once binary, more binary").groupBy("bucket").applyInArrow(_recurring(bits, filter_bits), "bucket int, bits binary, n long")
    marks, again = bytearray(filter_bits // 8), 0
    size = len(marks) >> bits
    for r in ws.table(slices, "filter").toLocalIterator():  # FILTER_BITS in all
        marks[r.bucket * size : (r.bucket + 1) * size] = r.bits
        again += r.n
    shared = spark.sparkContext.broadcast(bytes(marks))
    bits = max(3, math.ceil(math.log2(again * 280 / BUCKET + 1)))
    text_bits = max(3, math.ceil(math.log2(again / 200_000 + 1)))
    sent = src.mapInArrow(_stretches(length, shared, filter_bits, bits), _STRETCH)
    runs = sent.groupBy("bucket").applyInArrow(_sorted_bucket(length, text_bits), "bucket int, text binary, start binary, end binary")
    return ws.table(runs.groupBy("bucket").applyInArrow(_merged, "key long, n_spans long, n_removed long, spans binary"), "spans")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)``: each text without its repeated passages.

    Every byte goes that is covered by a string of ``length`` bytes which also starts anywhere else,
    in the same text or another; all copies go, the first too. Strings are judged on the input.
    Texts are UTF-8 bytes, a null is empty, texts shorter than ``length`` lose nothing and ``kept``
    holds the remaining bytes, which may end within a character. Rows of a repeated id or text are
    documents of their own, so a text that occurs twice goes as a whole.
    """
    src = only(docs, id=id_col, text=text_col)
    rows = _facts(src, "text", length)
    size = F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long")
    whole = F.coalesce("copied", F.lit(False))
    part = ~whole & F.col("spans").isNotNull()
    kept = F.when(whole, F.lit(b"")).when(part, _without(F.when(part, F.col("doc.text")), F.when(part, F.col("spans")))).otherwise(F.coalesce(F.col("doc.text").cast("binary"), F.lit(b"")))
    return rows.select(
        F.col("doc.id").alias(id_col), size.alias("n_bytes"), F.when(whole, size).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), kept.alias("kept"),
    )


def _facts(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """``(doc, copied, n_spans, n_removed, spans)``: each row as a struct beside what its text repeats."""
    ws = Workspace(docs.sparkSession, "suffix-dedup")
    text = F.col(text_col)
    long = docs.where(F.octet_length(text) >= length)
    for seed in range(SEEDS):
        key = F.xxhash64(F.lit(seed), text)
        names = long.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(F.xxhash64(F.lit(-1 - seed), text)).alias("low"), F.max(F.xxhash64(F.lit(-1 - seed), text)).alias("high"))
        copies = ws.table(names.where("n > 1"), "copies")
        if copies.where("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("texts that differ have equal hashes under every seed")
    spans = repeated_spans(docs, text_col, length, ws, key)
    ws.release()
    keyed = docs.select(F.struct("*").alias("doc"), F.when(F.octet_length(text) >= length, key).alias("key"))
    facts = ws.table(spans.join(copies.select("key", F.lit(True).alias("copied")), "key", "full"), "facts")
    ws.release()
    clean, others = split_by_keys(keyed, "key", ws.table(key_filter(facts.select("key")), "filter"))
    met = others.join(facts, "key", "left")
    return met.unionByName(clean, allowMissingColumns=True)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, chars_col: str | None = None) -> DataFrame:
    """The rows, all columns, with the texts that :func:`suffix_dedup` leaves.

    A character that is cut in two goes as a whole; ``chars_col`` gets the new number of characters.
    A null text stays null, a text of which nothing is left becomes empty.
    """
    rows = _facts(docs, text_col, length)
    old = F.col("doc").getField(text_col)
    part = ~F.coalesce("copied", F.lit(False)) & F.col("spans").isNotNull()
    new = F.when(F.col("copied"), F.lit("")).when(part, _text_without(F.when(part, old), F.when(part, F.col("spans")))).otherwise(old)
    out = rows.withColumn("new", new)
    fields = {text_col: F.col("new")} | ({chars_col: F.length("new").cast(docs.schema[chars_col].dataType)} if chars_col else {})
    return out.select(*(fields.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
