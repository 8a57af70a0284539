"""Splits UTF-8 text as the byte-level pattern does, without a regular expression.

The pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its matches tile a text, so the positions where matches start say everything. They
follow from runs of one character class: a run takes a space before it along, the
last character of a run of white space before other text stands alone, and a lone
apostrophe takes a contraction out of the letters behind it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

from . import kernels as K

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for first, last in ((0, 0xD800), (0xE000, 0x110000)):
            for m in regex.finditer(pattern, "".join(map(chr, range(first, last)))):
                out[first + m.start() : first + m.end()] = kind
    out[WHITE_SPACE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    point = lead.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        some = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[some] & mask
        for k in range(1, more + 1):
            value = (value << 6) | (padded[at[some] + k] & 0x3F)
        point[some] = value
    return at, point


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and text number of every match in the texts."""
    empty = np.zeros(0, np.int64)
    if not len(data):
        return empty, empty, empty
    at, point = code_points(data)
    kind = classes()[point]
    n = len(at)
    opens = np.zeros(n + 1, bool)  # a text starts here
    filled = offsets[:-1][np.diff(offsets) > 0]
    opens[np.searchsorted(at, filled)] = True
    opens[n] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = run.copy()
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (point[:-1] == 0x20) & ~opens[1:n]
    starts &= ~(run & (kind != SPACE) & after_blank)
    closes = np.zeros(n, bool)  # the last character of a run that more text follows
    closes[:-1] = run[1:] & ~opens[1:n]
    starts |= closes & (kind == SPACE)
    ends = np.r_[run[1:], True]
    mark = np.flatnonzero((point == 0x27) & run & ends & closes & ~after_blank)
    if len(mark):
        mark = mark[kind[mark + 1] == LETTER]
        wide = np.concatenate([point, np.zeros(3, np.int32)])
        shut = np.concatenate([opens, np.ones(2, bool)])
        one, two = wide[mark + 1], np.where(shut[mark + 2], 0, wide[mark + 2])
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for pair in ("re", "ve", "ll"):
            length[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
        mark, length = mark[length > 0], length[length > 0]
        starts[mark + 1] = False
        beyond = mark + length
        inside = beyond < n
        inside[inside] &= ~opens[beyond[inside]] & (kind[beyond[inside]] == LETTER)
        starts[beyond[inside]] = True
    begin = at[starts]
    end = np.r_[begin[1:], len(data)]
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


class Memo:
    """Token ids of the pre-tokens met so far, by their hash.

    ``encode`` maps a list of byte strings to lists of ids. The memo starts anew
    beyond ``most`` entries, which bounds its memory and changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and how many each text has."""
        begin, end, text = split(data, offsets)
        n = len(offsets) - 1
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        key, first, back = np.unique(K.hashes(data, begin, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        inside = place < len(self.key)
        known[inside] = self.key[place[inside]] == key[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            if len(self.key) + len(fresh) > self.most and len(self.key):
                self.clear()
                return self(data, offsets)
            raw = data.tobytes()
            lists = self.encode([raw[a:b] for a, b in zip(begin[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)])
            length = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for y in lists for x in y), np.uint32, int(length.sum()))
            start = len(self.ids) + np.cumsum(length) - length
            self.ids = np.concatenate([self.ids, flat])
            joined = np.concatenate([self.key, key[fresh]])
            order = np.argsort(joined, kind="stable")
            self.key = joined[order]
            self.start = np.concatenate([self.start, start])[order]
            self.length = np.concatenate([self.length, length])[order]
            place = np.searchsorted(self.key, key)
        entry = place[back]
        length = self.length[entry]
        shift = self.start[entry] - (np.cumsum(length) - length)
        ids = self.ids[np.repeat(shift, length) + np.arange(length.sum())]
        return ids, np.bincount(text, weights=length, minlength=n).astype(np.int64)
