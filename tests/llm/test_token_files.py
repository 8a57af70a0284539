import zlib
from collections import Counter

import numpy as np
import pytest

from vellumite.llm.queries import tokenizer_file
from vellumite.llm.token_files import TokenFile, token_files_round_trip, write_token_files

from . import messy

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return Counter(out)


def test_messy_rows(spark, library):
    rows = [*messy.documents(), (77, "<|endoftext|> it's 'll x", *[None] * 8)]
    got = token_files_round_trip(spark.createDataFrame(rows, messy.SCHEMA), PATH).collect()
    assert Counter(tuple(r) for r in got) == expected(library, [r[:2] for r in rows])


def test_special_tokens_as_plain_text(spark):
    from tokenizers import Tokenizer

    rows = [(1, "<|endoftext|> it's 'll x"), (2, "a<|endoftext|>")]
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    got = token_files_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH, special=False).collect()
    assert Counter(tuple(r) for r in got) == expected(plain, rows)


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    from vellumite.llm.token_files import Tokenizer

    parts = json.load(open(PATH))
    parts["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(parts))
    with pytest.raises(ValueError, match="prefix space"):
        Tokenizer(str(tmp_path / "t.json"), True)


def test_whole_table(spark, sf_dir, library):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = token_files_round_trip(df, PATH).collect()
    assert Counter(tuple(r) for r in got) == expected(library, [(r.doc_id, r.text) for r in df.collect()])


def test_sequences_are_equal_and_masked(spark, tmp_path):
    root = f"file://{tmp_path}/tokens"
    index = write_token_files(spark.createDataFrame(messy.documents(), messy.SCHEMA).coalesce(1), PATH, root, length=64).collect()
    for name in {r.file for r in index}:
        file, total = TokenFile(root, name), sum(r.n_tokens for r in index if r.file == name)
        seen = 0
        while seen < total:
            ids, mask = file.sequence(seen // 64)
            assert not ids.flags.owndata and not mask.flags.owndata and ids.dtype == np.uint16 and mask.dtype == np.uint8
            assert len(ids) == len(mask) == 64 and mask.tolist() == [1] * min(64, total - seen) + [0] * max(0, seen + 64 - total)
            seen += 64


def test_masks_where_the_last_batch_is_padded(tmp_path):
    import pyarrow as pa

    from vellumite.llm.token_files import SEQUENCES, _Writer

    for total in (1, 8, 8 * SEQUENCES, 8 * SEQUENCES * 2 + 11):
        writer = _Writer(f"file://{tmp_path}/files", f"{total}", pa.uint16(), 8)
        writer.append(np.arange(total) % 60000)
        writer.close()
        file, ids, mask = TokenFile(f"file://{tmp_path}", f"{total}"), [], []
        for s in range(-(-total // 8)):
            x, y = file.sequence(s)
            ids.extend(x.tolist())
            mask.extend(y.tolist())
        assert mask == [1] * total + [0] * (-total % 8) and ids == [i % 60000 for i in range(total)] + [0] * (-total % 8)


def test_empty_table(spark):
    assert token_files_round_trip(spark.createDataFrame([], messy.SCHEMA), PATH).collect() == []


def test_special_tokens_as_the_unmodified_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from vellumite.llm import queries

    mark = "<|endoftext|>"
    texts = [mark, f"a {mark} b", f"{mark}{mark}x", f"it's{mark}'ll\n {mark} ", "<|endoftext", "|>", "plain words", None, f"é{mark}日本語"]
    rows = [*messy.documents(), *((100 + k, t, *[None] * 8) for k, t in enumerate(texts))]
    spark.createDataFrame(rows, messy.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_token_files(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == expected(Tokenizer.from_file(PATH), [r[:2] for r in rows])
