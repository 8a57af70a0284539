"""WARC records in a content-addressed archive.

An archive is two tables. ``payloads`` holds the bytes of each distinct payload once
under its SHA-256; ``headers`` holds the exact header bytes of every record and the
address of its payload. Records are put together again by a join on the address, and
no payload is trusted before its digest is computed anew. Both tables are written by
Spark's committer, so lost tasks leave nothing behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, only

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 in upper-case base32: four times ten hex digits become eight base32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _record_name(ident: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(ident.cast("string")), F.lit(">")), F.lit("<urn:page:>"))


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Writes an archive of one record per row below ``root``.

    Of the records with equal payloads of ``min_bytes`` or more, the one with the largest id is the
    response and the others are revisits that refer to it; smaller payloads are responses all. A null
    payload is empty. Rows that repeat the largest id are responses too, their payload stored once. A
    null id sorts below all others and gives a record name without an id. Ids may be of any type that
    becomes text; they are percent-encoded in names, and an empty text reads back as null. Line ends in a url are percent-encoded and a null url
    leaves out its header. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    src = only(pages, id=id_col, url=url_col, payload=payload_col).withColumn("payload", _bytes(F.col("payload")))
    facts = src.select("id", "url", F.unhex(F.sha2("payload", 256)).alias("address"), F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"))
    facts.write.parquet(f"{root}/facts")
    facts = spark.read.parquet(f"{root}/facts")
    first = facts.groupBy("address").agg(F.max("id").alias("response"))
    records = facts.join(first, "address").withColumn("revisit", (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("response")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    length = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_name(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _record_name(F.col("response"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(_CRLF),
        http,
    )
    records.select("address", header.cast("binary").alias("header")).write.parquet(f"{root}/headers")
    kept = first.select(F.col("response").alias("kept"), "address")
    payloads = src.join(kept, src.id.eqNullSafe(F.col("kept"))).where(F.unhex(F.sha2("payload", 256)) == F.col("address")).select("address", "payload")
    if facts.groupBy("id").count().where("count > 1").limit(1).count():
        payloads = payloads.dropDuplicates(["address"])
    payloads.write.parquet(f"{root}/payloads")


def _verified(spark: SparkSession, root: str) -> DataFrame:
    payloads = spark.read.parquet(f"{root}/payloads")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("address")
    broken = F.raise_error(F.concat(F.lit("a payload differs from its address "), F.hex("address")))
    return payloads.select("address", F.when(sound, F.col("payload")).otherwise(broken).alias("payload"))


def _head() -> Column:
    """The lines before the block."""
    return F.substring_index(F.col("header").cast("string"), _CRLF * 2, 1)


def _http() -> Column:
    """The lines that begin the block."""
    return F.split(F.col("header").cast("string"), _CRLF * 2, 2)[1]


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(_head(), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """``(record_type, record_id, target_uri, refers_to, declared_digest, declared_length, address, payload, header_bytes, block_at, http_length, record)``.

    ``record`` is the bytes of the original WARC record, whose block begins at the byte ``block_at`` and declares an entity of
    ``http_length``: the exact header (``header_bytes`` long, the block's HTTP header included) and, of a response, its payload,
    which a join on the address brings. A revisit's record has no payload of its own, so ``payload`` is null
    there and no payload is copied to its revisits; :func:`full_payloads` attaches it.
    """
    headers = spark.read.parquet(f"{root}/headers").withColumn("kind", _field("WARC-Type"))
    held = headers.where("kind = 'response'").join(_verified(spark, root), "address")
    rows = held.unionByName(headers.where("kind = 'revisit'").withColumn("payload", F.lit(None).cast("binary")))
    return rows.select(
        F.col("kind").alias("record_type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("target_uri"), _field("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest").alias("declared_digest"), _field("Content-Length").cast("long").alias("declared_length"), "address", "payload", F.octet_length("header").alias("header_bytes"),
        (F.octet_length(_head()) + 4).alias("block_at"), F.nullif(F.regexp_extract(_http(), r"\r\nContent-Length: (\d+)\r\n", 1), F.lit("")).cast("long").alias("http_length"),
        F.concat("header", F.coalesce("payload", F.lit(b"")), F.lit((_CRLF * 2).encode())).alias("record"),
    )


def full_payloads(records: DataFrame) -> DataFrame:
    """The records with the full payload in each, revisits too: a join of revisits with responses on the address."""
    source = records.where("record_type = 'response'").groupBy("address").agg(F.first("payload").alias("full"))
    return records.where("record_type = 'response'").unionByName(records.where("record_type = 'revisit'").drop("payload").join(source, "address").withColumnRenamed("full", "payload"))


def read_facts(spark: SparkSession, root: str, id_col: str = "page_id", id_type: str = "bigint") -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of each record put together by :func:`read_records`.

    Length and digest are computed from the record's own bytes; a revisit gets those of the response of its
    address. It is an error if a record declares another digest, a ``Content-Length`` other than the bytes of its
    block, of either kind, or an HTTP length other than the payload's.
    """
    records = read_records(spark, root)
    own = F.when(F.col("record_type") == "response", F.expr("substring(record, header_bytes + 1, octet_length(record) - header_bytes - 4)"))
    block = F.octet_length("record") - F.col("block_at") - 4
    rows = records.select("address", "record_type", "record_id", "refers_to", F.col("declared_digest").alias("said"), "http_length", (block == F.col("declared_length")).alias("fits"), own.alias("body"))
    rows = rows.select("address", "record_type", "record_id", "refers_to", "said", "http_length", "fits", F.octet_length("body").cast("long").alias("n"), base32_sha1(F.col("body")).alias("digest"))
    facts = Workspace(spark, "warc-facts").table(rows, "facts")
    stored = facts.where("record_type = 'response'").groupBy("address").agg(F.max("n").alias("payload_bytes"), F.max("digest").alias("payload_digest"))
    met = facts.select("address", "record_type", "record_id", "refers_to", "said", "http_length", "fits").join(stored, "address")
    name = lambda c: F.url_decode(F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit(""))).cast(id_type)
    sound = F.coalesce(F.col("fits") & (F.col("http_length") == F.col("payload_bytes")) & (F.col("said") == F.concat(F.lit("sha1:"), "payload_digest")), F.lit(False))
    return met.select(
        name(F.col("record_id")).alias(id_col), "payload_bytes", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header declares another digest or length"))).alias("payload_digest"),
        "record_type", name(F.col("refers_to")).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archives the pages in the session's shared folder and returns the facts of the records read back."""
    root = Workspace(pages.sparkSession, "warc").root
    write_archive(pages, root, id_col, url_col, payload_col, min_bytes=min_bytes)
    return read_facts(pages.sparkSession, root, id_col, pages.schema[id_col].dataType.simpleString())
