import random
import re
import time
import zlib

import numpy as np
import pytest

from vellumite.llm import toxicity as scorer
from vellumite.llm.toxicity import Lexicon, fit, fold, toxicity

from . import messy


def test_folding():
    assert fold("1d10t! SCUM, ｔｒａｓｈ") == fold("idiot  scum  trash")
    assert fold("sсum mоrоn") == fold("scum moron")  # Cyrillic look-alikes
    assert fold("l0s​er") == fold("loser") and fold("stup1d!!").split() == fold("stupid").split()


def test_exceptions_and_length():
    lexicon = Lexicon({"trash": 5.0}, {"trash can"}, (-3.0, 1.0, 1.0, 0.0))
    assert lexicon.features("a trash can here") == (0.0, 0.0, 0.0)
    assert lexicon.features("trash, can you")[0] > 0  # a mark ends a phrase
    short, long = lexicon.features("trash talk")[1], lexicon.features("trash " + "word " * 500)[1]
    assert short > long > 0
    assert lexicon.features("trashy")[0] > 0 and lexicon.features("untrash")[0] == 0


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return toxicity(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    mine = scored[scored.held_out & scored.toxic.notna()]
    assert len(mine) > 500
    toxic, clean = mine[mine.toxic == 1], mine[mine.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01


def test_rows_and_folds(scored):
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scored.doc_id]).all()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.7)).all()


def test_held_out_labels_are_never_read(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = (toxicity(docs, x).select("doc_id", "score").toPandas().set_index("doc_id").score.sort_index() for x in (labels, flipped))
    assert np.allclose(a, b)


def test_obfuscated_words_are_found(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    lexicon = fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    plain, odd = lexicon.features("you idiot and scum"), lexicon.features("you 1d1оt and ѕcum")
    assert plain == odd and plain[0] > 0


def test_messy_rows(spark):
    rows = messy.documents()
    df = spark.createDataFrame(rows, messy.SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (7, None), (14, 0)], "doc_id long, toxic int")
    for labels in (none, some, None):
        got = toxicity(df, labels).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity(spark.createDataFrame([], messy.SCHEMA), some).collect() == []


def test_long_runs_of_marks_and_many_hits():
    """Runs of 10^6 marks are read once; 10^5 hits and as many exceptions meet by their places."""
    lexicon = Lexicon({"bad": 1.0, "dumb": 2.0}, {"not bad"}, (-1.0, 1.0, 0.0, 0.0))
    for mark in "$+|@!":
        began = time.time()
        lexicon.features(mark * 1_000_000 + "a " + mark * 1_000_000 + " x" + f"a{mark}" * 300_000)
        assert time.time() - began < 5
    began = time.time()
    folded = fold("not bad bad dumb " * 50_000)
    assert len(lexicon.hits(folded)) == 100_000 and time.time() - began < 5


def test_marks_and_exceptions_as_read_one_by_one():
    marks = re.compile(r"[!|+$@]+(?=\s|[.,;:?!\"')\]]|\Z)")
    rng = random.Random(3)
    lexicon = Lexicon({"ab": 1.0, "b": 2.0, "ca": 1.5}, {"a b", "ca ab", "b"}, (0.0, 1.0, 0.0, 0.0))
    for _ in range(3000):
        text = "".join(rng.choice("ab!$+ .)c") for _ in range(rng.randrange(14)))
        assert fold(text) == f" {marks.sub(' ', text).lower().translate(scorer._FOLD)} "
        folded, spared, found = fold(text), [], {}
        for end, (length, weight, exception) in lexicon.machine().iter(folded):
            if exception:
                spared.append((end - length, end))
            elif end - length + 1 not in found or weight > found[end - length + 1][1]:
                found[end - length + 1] = (end + 1, weight)
        want = sorted((s, e, w) for s, (e, w) in found.items() if not any(a <= s and e <= b + 1 for a, b in spared))
        assert sorted(lexicon.hits(folded)) == want
