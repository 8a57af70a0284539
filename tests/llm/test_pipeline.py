import re
from collections import Counter

import corpus_pipeline as P
from vellumite.llm.mixing import mix_documents, mix_sources
from vellumite.llm.ngram_jaccard import one_of_each_group
from vellumite.llm.store import key_filter, split_by_keys

from . import messy
from .test_ngram_jaccard import brute as groups
from .test_suffix_dedup import brute as marks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_stages_in_a_row(spark, sf_dir, tmp_path):
    docs, frames = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(docs)
        if k < len(P.STAGES) - 1:
            assert docs.columns == COLUMNS
    good, one, left, mixed, tokens = (f.collect() for f in frames)
    assert Counter(r.doc_id for r in one) == Counter(i for i, _, c in groups([(r.doc_id, r.text) for r in good]) if i == c)
    import numpy as np

    expected = {r.doc_id: bytes(np.frombuffer(raw, np.uint8)[~gone]).decode(errors="ignore") for r, (raw, gone) in zip(one, marks([r.text for r in one]), strict=True)}
    assert {r.doc_id: r.text for r in left} == expected and all(r.n_chars == len(r.text) for r in left)
    taken = {r.doc_id: r.taken for r in mix_sources(frames[2]).collect()}
    got = Counter()
    for r in mixed:
        got[r.doc_id] += len(words(r.text))
        assert expected[r.doc_id].startswith(r.text)
    assert got == Counter({i: n for i, n in taken.items() if n})
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed)


def test_run_is_repeatable(spark, sf_dir):
    a, b = (sorted(map(tuple, P.run(spark, sf_dir).collect())) for _ in range(2))
    assert a == b and a


def test_stage_functions_take_messy_rows(spark):
    rows = messy.documents()
    df = spark.createDataFrame(rows, messy.SCHEMA).selectExpr("*", "1 as bits", "2 as bucket", "3 as hit", "4 as component_id", "5 as taken", "6 as size")
    one = one_of_each_group(df)
    assert one.columns == df.columns
    ids = [r.doc_id for r in one.collect()]
    expected = {i for i, _, c in groups([r[:2] for r in rows]) if i == c and i is not None}
    assert sorted(x for x in ids if x is not None) == sorted(expected) and ids.count(None) == 1
    out = mix_documents(df)
    taken = sum(r.taken for r in mix_sources(df).collect())
    assert out.columns == df.columns and sum(len(words(r.text)) for r in out.collect()) == taken


def test_key_filter_loses_nothing(spark):
    keys = spark.range(0, 5000, 3).selectExpr("id as key")
    rows = spark.range(6000).selectExpr("case when id < 5990 then id end as key", "id as bits")
    outside, inside = split_by_keys(rows, "key", key_filter(keys, 1 << 16), 1 << 16)
    assert outside.count() + inside.count() == 6000 and outside.join(keys, "key", "left_semi").count() == 0
    assert inside.count() < 2600


def test_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
