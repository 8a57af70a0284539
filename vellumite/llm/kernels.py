"""Vectorised byte kernels shared by the text operators.

Every kernel works on one flat ``uint8`` buffer that holds many texts and on the
offsets that delimit them, so the cost per byte is a few numpy passes and no
Python object is made per text or per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ``[\x20\x09-\x0D]`` separates words.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BYTES_KEPT = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit values (the SplitMix64 finaliser)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def portions(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text makes a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets) > 0)
    first[offsets[filled]] = inside[offsets[filled]]
    last[offsets[filled + 1] - 1] = inside[offsets[filled + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def at8(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes that start at each position, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step."""
    length = (ends - starts).astype(np.int64)
    out = mix(length.astype(np.uint64) + np.uint64(seed))
    view = at8(data)
    alive, place = np.arange(len(starts)), starts.copy()
    left = length
    while len(alive):
        alive, place, left = (alive, place, left) if left.all() else (alive[left > 0], place[left > 0], left[left > 0])
        out[alive] = mix(out[alive] ^ (view[place] & _BYTES_KEPT[np.minimum(left, 8)]))
        more = left > 8
        alive, place, left = alive[more], place[more] + 8, left[more] - 8
    return out


_SHINGLE = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text number, hash of ``n`` successive words); a text of fewer words gives one of all."""
    starts, ends, text = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = hashes(data, starts, ends)
    count = np.bincount(text, minlength=len(offsets) - 1)
    begin = np.cumsum(count) - count
    total = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for k in range(n):
        odd = mix(np.array([k + 1], np.uint64) * _SHINGLE[k % 5])[0] | np.uint64(1)
        total += word[k : k + len(total)] * odd
    whole = text[: len(total)] == text[n - 1 : n - 1 + len(total)] if len(total) else np.zeros(0, bool)
    owner, value = [text[: len(total)][whole]], [mix(total[whole])]
    for m in range(1, n):
        few = np.flatnonzero(count == m)
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for k in range(m):
                odd = mix(np.array([k + 1], np.uint64) * _SHINGLE[k % 5])[0] | np.uint64(1)
                short += word[begin[few] + k] * odd
            owner.append(few)
            value.append(mix(short + np.uint64(m)))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner)) if len(owner) else np.zeros(0, np.int64)
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]


def sums(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of the values of each of n owners; owners ascend."""
    count = np.bincount(owner, minlength=n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    end = np.cumsum(count)
    return total[end] - total[end - count]
