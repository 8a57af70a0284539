import hashlib
import random
import re
import zlib

import pytest

from vellumite.llm import conversation_trie
from vellumite.llm.conversation_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, x string, conv string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, shared=4, family=20):
    """Every sequence as a tuple, every subtree by looking at all nodes."""
    turns = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda a: a[0])] for c, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % shared
        whole[c] = tuple(turns.get(c - c % family, [])[:h] + turns[c][h:])
    members = {}
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members.setdefault(w[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = {n for n in below if len(n) == len(node) + 1}
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    out = prefix_trie(spark.createDataFrame(rows, SCHEMA), **how)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def talk(c, texts):
    return [(c, t, "user" if t % 2 == 0 else "assistant", x, 7, "clash", "clash") for t, x in enumerate(texts)]


def branching(seed, n, spread=2, most=6):
    rng = random.Random(seed)
    return [r for c in range(n) for r in talk(c, [f"{'word ' * rng.randrange(3)}t{rng.randrange(spread)}" for _ in range(rng.randrange(1, most))])]


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 60, 2), (2, 45, 1), (3, 50, 9)])
def test_random_talks(spark, seed, n, spread):
    rows = branching(seed, n, spread)
    assert got(spark, rows) == brute(rows)


def test_messy_rows(spark):
    rows = branching(4, 30)
    rows += talk(40, ["a b", None, "", " \n "]) + talk(41, ["x " * 30_000, "y"]) + talk(43, ["only"]) + talk(100_007, ["kein Anfang", "zwei", "drei", "vier"])
    rows += [(None, 0, "user", "lost", None, None, None), (44, None, None, None, None, None, None), (44, 5, "user", "late", None, None, None), (44, 2, "system", "é 日本", None, None, None)]
    rows += [(45, 1, "user", "twice", None, None, None)] * 2 + [(45, 3, None, "end", None, None, None)]
    assert got(spark, rows) == brute(rows)


def test_ties_go_one_way(spark):
    rows = [(60, 0, "user", x, None, None, None) for x in "abc"]
    first = got(spark, rows, shared=1)
    assert first == got(spark, rows[::-1], shared=1) and [r[1] for r in sorted(first)] == [0, 1, 2, 3]


def test_no_rows(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "x", None, None, None)]) == []


def test_turnless_only(spark):
    rows = [(c, 0, "user", "short", None, None, None) for c in range(21, 40)]  # no conversation 20 to begin with
    assert got(spark, rows) == brute(rows)


def test_long_talks_in_stretches(spark, monkeypatch):
    """Conversations and paths over many stretches, lists of ids over many ranges, equal to the plain reading."""
    monkeypatch.setattr(conversation_trie, "STRETCH", 4)
    monkeypatch.setattr(conversation_trie, "LISTED", 2)
    rng = random.Random(5)
    base = [f"say {k}" for k in range(40)]
    rows = [r for c in range(24) for r in talk(c, base[: rng.randrange(1, 40)] + [f"own {c}"] * rng.randrange(3))]
    rows += [r for c in range(30, 70) for r in talk(c, base[:9])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, shared=1) == brute(rows, shared=1)


def test_a_trie_of_many_levels(spark):
    """Light edges below light edges: every bit of the number is a turn."""
    rows = [r for c in range(32) for r in talk(c, [f"{b} words" for b in f"{c:05b}"])]
    assert got(spark, rows, shared=1) == brute(rows, shared=1)
