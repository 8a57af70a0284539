"""Working tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; unset, a temporary folder, which only local mode may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="vellumite-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


#: Rows and bytes of an Arrow batch at most, so that a Python worker holds little of long texts.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to those above; lower ones stay."""
    for key, most in ARROW_LIMITS.items():
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def _give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """The same iterator function, giving freed memory back when a task ends: workers live on for other tasks."""

    def wrapper(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapper


def trimmed_group(run):
    """The same function of one group, giving freed memory back after each."""

    def wrapper(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            _give_back()

    return wrapper


#: Bits of a key filter: 8 MB, the most that is broadcast for it.
FILTER_BITS = 1 << 26


def row_digest(df: DataFrame) -> Column:
    """Two 64-bit hashes of all columns of a row, nulls and their places included: equal for equal rows only."""
    cols = [F.to_json(F.struct(c.name)) if "map<" in c.dataType.simpleString() or "variant" in c.dataType.simpleString() else F.col(f"`{c.name}`") for c in df.schema]
    nulls = [c.isNull() for c in cols]
    return F.struct(F.xxhash64(*cols, *nulls).alias("x"), F.xxhash64(F.lit(1), *cols, *nulls).alias("y"))


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``(bucket, bits)``: one bit for each hash of the first column, in chunks of 32768; ``bits`` bounds its size."""
    place = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits)) + 1
    chunks = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
    return chunks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def split_by_keys(df: DataFrame, key: str | Column, chunks: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not among those of a :func:`key_filter`, and the rows that may have one.

    The filter is broadcast, whose size is fixed; only rows of the second kind need a join.
    """
    own = {c: f"_filter_{c}" for c in ("place", "bucket", "bits", "hit")}
    at = F.bitmap_bit_position(F.col(own["place"]))
    byte = F.conv(F.hex(F.substring(F.col(own["bits"]), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    rows = df.withColumn(own["place"], F.pmod(F.xxhash64(key), F.lit(bits)) + 1).withColumn(own["bucket"], F.bitmap_bucket_number(own["place"]))
    marks = F.broadcast(chunks.select(F.col("bucket").alias(own["bucket"]), F.col("bits").alias(own["bits"])))
    marked = rows.join(marks, own["bucket"], "left").withColumn(own["hit"], hit)
    return marked.where(~F.col(own["hit"])).select(df.columns), marked.where(own["hit"]).select(df.columns)


class Workspace:
    """A folder of intermediate tables of one query; a written table replaces its lineage."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and returns them as read back."""
        where = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of jobs whose tables are written."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this workspace that nothing reads any more."""
        for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if self.root.rpartition("/")[2] in file:
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
                hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that no further column of the input can clash."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))
