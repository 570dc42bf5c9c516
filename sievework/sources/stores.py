"""Stores: chunk vectors, keyword indexes and graphs as tables, one bucket column per store so that a document's rows lie together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders of a store; many small documents share one.
BUCKETS = 64


def bucket(doc_id: str = "doc_id", n: int = BUCKETS):
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def save(rows: DataFrame, path: str, n: int = BUCKETS) -> None:
    """Writes rows (with doc_id) in a folder per bucket, one task a bucket."""
    rows.withColumn("bucket", bucket(n=n)).repartition(n, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, doc_id=None, n: int = BUCKETS) -> DataFrame:
    """All rows of a store, or a document's: its bucket's folder alone is read."""
    df = spark.read.parquet(path)
    if doc_id is not None:
        kind = dict(df.dtypes)["doc_id"]
        df = df.where((F.col("bucket") == bucket(F.lit(doc_id).cast(kind), n)) & (F.col("doc_id") == F.lit(doc_id)))
    return df.drop("bucket")


def clear(like: DataFrame, path: str) -> None:
    """Empties a store; its schema stays."""
    like.limit(0).withColumn("bucket", bucket()).write.mode("overwrite").parquet(path)


def delete(spark: SparkSession, path: str, doc_id, n: int = BUCKETS) -> None:
    """Takes a document out of a store: its bucket's folder alone is written anew, or removed where nothing else is in it."""
    df = spark.read.parquet(path)
    own = bucket(F.lit(doc_id).cast(dict(df.dtypes)["doc_id"]), n)
    rest = df.where((F.col("bucket") == own) & ~F.col("doc_id").eqNullSafe(F.lit(doc_id)))
    if not rest.isEmpty():
        rest.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        return
    number = spark.range(1).select(own).first()[0]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={number}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def reset(stores: dict[str, tuple[DataFrame, str]]) -> dict[str, str]:
    """Empties several stores (name to rows of its kind and path); a name's error, or an empty text. One that fails doesn't keep the others."""
    errors = {}
    for name, (like, path) in stores.items():
        try:
            clear(like, path)
            errors[name] = ""
        except Exception as e:  # noqa: BLE001  reported by name
            errors[name] = str(e)
    return errors


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length of the files under a folder, hidden ones left out, SKILL.md last."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumn("name", name).where(~F.col("name").startswith(".")).orderBy(F.col("name") == "SKILL.md", "path").select("path", "name", "length")


def is_word_file(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(".doc", ".docx")
