"""The pipeline's stages on rows that repeat ids, texts and whole rows, compared as whole rows."""

import itertools
from collections import Counter

from vellumite.llm.mixing import mix_documents, mix_sources
from vellumite.llm.ngram_jaccard import one_of_each_group

from . import messy
from .test_ngram_jaccard import shingle_set
from .test_pipeline import words

SCHEMA = "doc_id long, text string, lang string, source string, taken int"


def rows():
    base = messy.words(3, 60)
    near = " ".join([*base[:30], "other", *base[31:]])
    base = " ".join(base)
    far, apart = " ".join(messy.words(4, 60)), " ".join(messy.words(5, 60))
    return [
        (1, far, "a", "s", 1), (1, apart, "b", "s", 2),  # one id, two texts
        (1, "a b c", "L1", "s", 3), (1, "a b c", "L2", "s", 3),  # one id and text, two languages
        (5, base, "a", "t", 4), (5, near, "a", "t", 5), (6, base, "a", None, 6), (7, base, "a", "t", 7), (7, far + " x", "a", "t", 8),
        (9, apart, "c", "t", None), (9, apart, "c", "t", None),  # a whole row twice
        (None, base, "a", "t", 1), (3, None, "a", "t", 1), (3, None, "a", "t", 1), (3, "", None, "t", None),
    ]


def test_one_row_of_each_group_stays(spark):
    data = rows()
    sets = [shingle_set(r[1]) if r[0] is not None else frozenset() for r in data]
    group = list(range(len(data)))
    for i, j in itertools.combinations(range(len(data)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    got = Counter(map(tuple, one_of_each_group(spark.createDataFrame(data, SCHEMA)).collect()))
    assert got - Counter(data) == Counter()
    left = got.copy()
    for g in set(group):
        members = [data[i] for i in range(len(data)) if group[i] == g]
        if len(members) == 1:
            assert left[members[0]] > 0
            left[members[0]] -= 1
            continue
        least = [m for m in members if m[0] == min(x[0] for x in members)]
        stay = [m for m in least if left[m] > 0]
        assert stay
        left[stay[0]] -= 1
    assert sum(left.values()) == 0


def test_one_of_each_group_agrees_however_rows_are_dealt(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = (Counter(map(tuple, one_of_each_group(d).collect())) for d in (df, df.repartition(7)))
    assert a == b


def test_int_ids_are_matched(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "other")], "doc_id int, text string")
    assert sorted(r.doc_id for r in one_of_each_group(df).collect()) == [1, 3]


def test_mix_keeps_every_row_apart(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    mixed = mix_documents(df, slot_col="slot").collect()
    facts = mix_sources(df.where("taken is not null or doc_id is not null")).collect()
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in facts)
    assert all(r.slot is not None for r in mixed) and all((r.first_slot is None) == (r.taken == 0) for r in facts)
    copies = Counter(data)
    for row, n in copies.items():
        of = [r for r in mixed if (r.doc_id, r.lang, r.source, r.taken) == (row[0], row[2], row[3], row[4]) and row[1] and row[1].startswith(r.text) and words(r.text)]
        size = len(words(row[1]))
        assert sum(len(words(r.text)) for r in of) <= 3 * size * n
    assert {"L1", "L2"} <= {r.lang for r in mixed}  # the source's target is above its size: each row is in the mix
