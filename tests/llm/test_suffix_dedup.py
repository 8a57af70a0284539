import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vellumite.llm.suffix_dedup import COVER, MODULUS, remove_repeats, sorted_suffixes, suffix_dedup

from . import messy


def brute(texts, length=200):
    """For each text: its bytes' marks of removal."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((r, gone))
    return out


def rows_of(ids, texts, length=200):
    out = Counter()
    for i, (r, gone) in zip(ids, brute(texts, length), strict=True):
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out[(i, len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


def got(df, length=200):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup(df, length=length).collect())


def test_messy_rows(spark):
    rows = messy.documents()
    assert got(spark.createDataFrame(rows, messy.SCHEMA)) == rows_of([r[0] for r in rows], [r[1] for r in rows])


def planted():
    rng = random.Random(8)
    passages = [" ".join(messy.words(50 + k, 60))[:n] for k, n in enumerate([199, 200, 201, 202, 230, 400, 333])]
    texts = []
    for k in range(60):
        parts = [" ".join(messy.words(1000 + k, rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), " ".join(messy.words(2000 + rng.randint(0, 10**6), rng.randint(0, 30)))]
        texts.append(rng.choice(["", " "]).join(parts))
    texts += ["ab" * 400, "ab" * 150, "abc" * 300, "z" * 199, "z" * 200, "z" * 201, passages[4][10:] + passages[4][:25], "é" * 150, "xé" * 200]
    return list(enumerate(texts))


@pytest.mark.parametrize("length", [200, 40, 64, 197, 231, 390])
def test_planted_passages(spark, length):
    """Passages of lengths around the limit, overlaps, repeats within one text and periodic texts, by strings of several lengths."""
    rows = planted()
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), length) == rows_of(*zip(*rows, strict=True), length)


def test_suffixes_come_in_order():
    """The order of a bucket is that of the first ``length`` bytes, ties found by cover ranks."""
    rng = np.random.default_rng(4)
    for length in (40, 64, 199, 200, 201, 390):
        part = rng.integers(97, 99, 4000).astype(np.uint8)
        text = np.zeros(16 * MODULUS * 400, np.uint8)
        text[:4000], text[4004:8004] = part, part  # 4004 is a multiple of 13: equal suffixes have equal residues
        cover = np.flatnonzero(np.isin(np.arange(len(text)) % MODULUS, COVER))
        start = rng.permutation(np.r_[np.arange(0, 3400), np.arange(4004, 7400)])
        order, same = sorted_suffixes(text, start, start % MODULUS, start % MODULUS, cover, length)
        raw = text.tobytes()
        keys = [(int(start[i] % MODULUS), raw[start[i] : start[i] + length]) for i in order]
        assert keys == sorted(keys) and same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:], strict=False))]


def test_a_passage_that_everybody_has(spark):
    passage = " ".join(messy.words(77, 90))
    rows = [(i, f"{' '.join(messy.words(i, 5))} {passage if i % 3 else ''} {' '.join(messy.words(9000 + i, 5))}") for i in range(400)] + [(1000, passage[3:]), (1001, passage * 2)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == rows_of(*zip(*rows, strict=True))


def test_texts_of_equal_hash_get_other_names(spark, monkeypatch):
    """Under a hash that all texts share, another one is tried; no text is taken for a copy of another."""
    from vellumite.llm import suffix_dedup as module

    real, rows = module.F.xxhash64, planted()
    monkeypatch.setattr(module.F, "xxhash64", lambda *c: real(module.F.lit(7)) if len(c) == 2 and "0" == str(c[0]._jc.toString()) else real(*c))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == rows_of(*zip(*rows, strict=True))


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(df) == rows_of(*zip(*rows, strict=True))


def test_texts_keep_whole_characters_and_columns(spark):
    passage = "é" + " ".join(messy.words(7, 70))
    rows = [(1, "aé" + passage + "ü end", "x", 0), (2, "bé" + passage + "ö tail", None, 0), (3, None, "y", 0), (4, "short", "z", 0), (5, passage, "w", 0), (6, passage, "w", 0)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key string, n_chars long"), chars_col="n_chars")
    got_rows = {r.doc_id: r for r in out.collect()}
    expected = {i: bytes(np.frombuffer(r, np.uint8)[~g]).decode(errors="ignore") for (i, *_), (r, g) in zip(rows, brute([t for _, t, *_ in rows]), strict=True)}
    assert {i: r.text or "" for i, r in got_rows.items()} == expected
    assert got_rows[3].text is None and got_rows[2].key is None and all(r.n_chars == len(r.text) for r in got_rows.values() if r.text is not None)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], messy.SCHEMA)).collect() == []


def test_cover_is_a_difference_cover():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))
    assert max(min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)) == 5


def test_length_is_checked(spark):
    with pytest.raises(ValueError):
        suffix_dedup(spark.createDataFrame([], messy.SCHEMA), length=39)
