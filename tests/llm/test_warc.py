import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumite.llm.warc import archive_round_trip, full_payloads, read_facts, read_records, write_archive

SCHEMA = "page_id long, url string, html string, id string, payload string, address string"
ROWS = [
    (1, "http://a/", "<p>one</p>", "x", "x", "x"), (2, None, "<p>one</p>", None, None, None), (3, "http://c/\r\nX: y", "<p>three é</p>", "x", "x", "x"), (4, "http://d/", None, "x", "x", "x"),
    (5, "http://e/", "", "x", "x", "x"), (9, "http://f/", "<p>one</p>", "x", "x", "x"), (-7, "http://g/", "y" * 200_000, "x", "x", "x"),
    (None, "http://h/", "<p>one</p>", "x", "x", "x"), (None, None, "only here", "x", "x", "x"), (12, "http://i/", "twice", "x", "x", "x"), (12, "http://i/", "twice", "x", "x", "x"),
]


def expected(rows):
    most = {}
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        most[body] = max(most.get(body, i) if most.get(body, i) is not None else i, i) if i is not None and most.get(body) is not None else (i if most.get(body) is None else most[body])
    out = Counter()
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        revisit = i != most[body]
        out[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", most[body] if revisit else None)] += 1
    return out


def test_round_trip(spark):
    got = archive_round_trip(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == expected(ROWS)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 100000", "url", "html").where("page_id % 130000 < 100010"))
    got = archive_round_trip(pages).collect()
    assert Counter(tuple(r) for r in got) == expected([tuple(r) for r in pages.collect()])


def test_records_and_storage(spark, tmp_path):
    root = f"file://{tmp_path}/archive"
    write_archive(spark.createDataFrame(ROWS, SCHEMA), root)
    payloads = [r.payload for r in spark.read.parquet(f"{root}/payloads").collect()]
    assert len(payloads) == len(set(map(bytes, payloads))) == len({(r[2] or "") for r in ROWS})
    for r in full_payloads(read_records(spark, root)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert len(rest) - 4 == r.declared_length
        assert r.declared_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        if r.record_type == "response":
            assert rest.partition(b"\r\n\r\n")[2][:-4] == bytes(r.payload)
        assert head.count(b"\r\n") == head.count(b"\n")


def test_small_payloads_are_responses(spark):
    got = archive_round_trip(spark.createDataFrame(ROWS, SCHEMA), min_bytes=100)
    assert {r.record_type for r in got.collect()} == {"response"}


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_text_ids(spark):
    rows = [("a/b é", "http://a/", "same"), ("b>c", "http://a/", "same"), (None, "http://a/", "same"), ("12x", None, "é"), ("", None, None)]
    got = archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {("a/b é", "revisit", "b>c"), ("b>c", "response", None), (None, "revisit", "b>c"), ("12x", "response", None), (None, "response", None)}


def test_broken_archive_is_an_error(spark, tmp_path):
    import pytest

    root = f"file://{tmp_path}/archive"
    write_archive(spark.createDataFrame(ROWS, SCHEMA), root)
    wrong = spark.read.parquet(f"{root}/payloads").selectExpr("address", "concat(payload, cast('x' as binary)) as payload").collect()
    spark.createDataFrame(wrong, "address binary, payload binary").write.mode("overwrite").parquet(f"{root}/payloads")
    with pytest.raises(Exception, match="differs from its address"):
        read_records(spark, root).collect()


@pytest.mark.parametrize("kind", ["response", "revisit"])
@pytest.mark.parametrize(("old", "new"), [(r"\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: \d+", "\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 999999"), (r"(?s)(utf-8\r\nContent-Length: \d+)", "$10"), (r"\r\nContent-Length: \d+\r\n\r\nHTTP", "\r\n\r\nHTTP")])
def test_another_length_is_an_error(spark, tmp_path, kind, old, new):
    """Too long, too short or none, of the block or of the HTTP entity, in records of either kind."""
    write_archive(spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string"), f"{tmp_path}/a")
    heads = spark.read.parquet(f"{tmp_path}/a/headers").withColumn("header", F.col("header").cast("string"))
    changed = F.when(F.col("header").contains(f"WARC-Type: {kind}"), F.regexp_replace("header", old, new)).otherwise(F.col("header"))
    heads.select("address", changed.cast("binary").alias("header")).write.parquet(f"{tmp_path}/b/headers")
    spark.read.parquet(f"{tmp_path}/a/payloads").write.parquet(f"{tmp_path}/b/payloads")
    assert len(read_facts(spark, f"{tmp_path}/a").collect()) == 2
    with pytest.raises(Exception, match="another digest or length"):
        read_facts(spark, f"{tmp_path}/b").collect()
