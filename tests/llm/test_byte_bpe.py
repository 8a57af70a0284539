import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumite.llm import byte_bpe as B
from vellumite.llm import kernels as K
from vellumite.llm.queries import tokenizer_file

from . import messy

PATH = tokenizer_file("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def encode(texts):
    data, offsets = K.flat(pa.array(texts, pa.string()))
    ids, count = B.load(PATH).memo(data, offsets)
    ends = np.r_[0, np.cumsum(count)]
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_every_character(library):
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(0x1, 0x30000, 1) if not 0xD800 <= c < 0xE000]
    assert encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_random_mixtures(library):
    rng = random.Random(3)
    parts = ["'", "s", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "\xa0", "é", "日本", "1", "!", "..", "　", "\x1c", "\x85", "😀", "B", "́", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(5000)]
    assert encode(texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), max_size=5))
def test_any_text(texts):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.load(PATH).ranks, special_tokens={})
    ids = encode(texts)
    assert ids == [own.encode_ordinary(t) for t in texts]
    assert [B.load(PATH).decode(np.array(i, np.int64)).tobytes().decode() for i in ids] == texts


def test_queries_and_round_trip(spark, library):
    rows = messy.documents()
    df = spark.createDataFrame(rows, messy.SCHEMA)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.byte_bpe_digests(df, PATH).collect()))
    ids = [library.encode_ordinary(r[1] or "") for r in rows]
    assert got == sorted((r[0] is None, r[0] or 0, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, i in zip(rows, ids, strict=True))
    back = B.byte_bpe_decode(B.byte_bpe_encode(df, PATH), PATH)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r[1] or "").encode() for r in rows)


def test_empty_table(spark):
    assert B.byte_bpe_digests(spark.createDataFrame([], messy.SCHEMA), PATH).collect() == []


def test_small_memo_changes_nothing():
    bpe = B.load(PATH)
    memo = B.Memo(bpe.encode_pretokens, most=5)
    texts = [" ".join(messy.words(k, 20)) for k in range(8)]
    data, offsets = K.flat(pa.array(texts))
    for i, j in K.portions(offsets, 100):
        ids, _ = memo(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        assert bpe.decode(ids).tobytes() == data[offsets[i] : offsets[j]].tobytes()
