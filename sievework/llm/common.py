"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Word pattern of every operator here: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: A side joined by broadcast has at most this many narrow rows; larger sides take a shuffle join.
BROADCAST_ROWS = 100_000

#: Partitions of one shuffle at most: the driver keeps a table of them for every task that writes.
MOST_PARTITIONS = 50_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary one.

    On a cluster with the setting missing this raises, as a machine-local folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sievework-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(discard_all)
    _written.append((spark, path))
    return path


def discard_all() -> None:
    """Deletes all scratch tables; for the end of a driver or between independent jobs."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    _written[:] = [x for x in _written if x[1] != path]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends at durable files."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if a count of (materialised, narrow) df stays within the bound, else returns it as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, total: DataFrame, keys: list[str], rows: int = 20_000) -> DataFrame:
    """df dealt by keys into partitions of about ``rows`` rows (of the number that total gives in one cell), sorted by keys.

    Groups stream through a partition, so with over ``MOST_PARTITIONS`` of that size partitions get longer instead.
    """
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-(total.first()[0] or 0) // rows)))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where body uses it many times."""
    return F.transform(F.array(value), body)[0]
