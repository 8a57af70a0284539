"""A session with the settings that the engine is tuned for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "vellumite", **more: str) -> SparkSession:
    """A session; ``more`` gives further settings, underscores for dots."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).getOrCreate()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; unset, in a temporary one, which only local mode may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if not root and app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="vellumite-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"{(root or f'file://{_OWN[app]}').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of a table written below a folder of :func:`shared_folder`, as read back: it replaces the lineage, so what uses it often computes it once."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
