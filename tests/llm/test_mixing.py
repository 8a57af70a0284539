import re
from collections import defaultdict
from fractions import Fraction

import pytest

from vellumite.llm.mixing import mix_sources, schedule, source_targets

from . import messy


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, the excess over the limit shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(order)}
    out, open_, left = {}, set(order), Fraction(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def check(rows, df):
    got = mix_sources(df).collect()
    again = mix_sources(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    goal = targets(dict(size))
    assert sorted(r.size for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows)
    by = defaultdict(list)
    for i, _, s in rows:
        by[i].append(s)
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size
        if len(set(by[r.doc_id])) == 1:
            s = by[r.doc_id][0]
            assert r.source_size == size[s] and r.target == pytest.approx(float(goal[s]), rel=1e-9)
            taken[s] += r.taken
        else:
            taken[None] += 0
    for s, t in goal.items():
        if all(len(set(by[i])) == 1 for i, _, x in rows if x == s):
            assert abs(taken[s] - float(t)) <= 1, s


def test_messy_rows(spark):
    rows = messy.documents()
    check([(r[0], r[1], r[3]) for r in rows], spark.createDataFrame(rows, messy.SCHEMA))


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r.doc_id, r.text, r.source) for r in df.collect()], df)


def test_one_hot_source_and_tiny_ones(spark):
    rows = [(i, "w " * (i % 50 + 1), "big") for i in range(400)] + [(1000 + i, "v " * i, f"s{i}") for i in range(6)]
    check(rows, spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).collect() == []
    got = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in got) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def test_schedule_is_even_at_every_prefix(spark):
    sizes = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate([("a", 1000), ("b", 5000), ("c", 4000)])], "id long, source string, size long")
    plan = schedule(source_targets(sizes), slots=4096).orderBy("slot").collect()
    share = {r.number: r.target / 10000 for r in source_targets(sizes).collect()}
    seen = defaultdict(int)
    for k, r in enumerate(plan, 1):
        seen[r.number] += 1
        assert all(abs(seen[n] - k * s) < 8 for n, s in share.items())
