"""Scratch folders of queries that build a store and read it again: in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir (in local mode one is made if it is unset), deleted when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='sievework-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(discard)
    _made.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to a new folder and read again, for what is used more than once."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
