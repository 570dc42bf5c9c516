"""A stored cache of embeddings: a text is sent to the model once, by the 128-bit hash of the text and the model's name.

A pass joins the texts it is given against the cache, calls the hook for the distinct rest, and commits what came back as one
version. A text for which the hook gives null is kept apart as failed: it is no hit, and the next pass tries it again. Two
passes at once can't both commit: the later one gets ``Conflict`` and starts again from what the first has stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.models import Hooks
from .versions import Snapshot, Versions


def _key(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _stored(log: Versions, at: Snapshot, model: str) -> DataFrame | None:
    rows = log.read("vectors", at)
    return None if rows is None else rows.where((F.col("model") == model) & F.col("embedding").isNotNull()).select(F.col("key").alias("__key"), "embedding")


def encode(rows: DataFrame, hooks: Hooks, root: str, model: str, text: str = "text") -> DataFrame:
    """rows with embedding, as ``models.encode`` gives them (rows of blank text are left out), null where the model failed.

    Rows move by their keys alone; the texts that go to the hook are those that no earlier pass has had, once each.
    """
    log = Versions(rows.sparkSession, root)
    base = log.snapshot()
    own = rows.where(F.trim(text) != "").withColumn("__key", _key(text))
    new, held = own.groupBy("__key").agg(F.first(text).alias("__text")), _stored(log, base, model)
    if held is not None:
        new = new.join(held.select("__key"), "__key", "left_anti")
    made = new.select(F.col("__key").alias("key"), F.lit(model).alias("model"), hooks.embed(F.col("__text")).cast("array<double>").alias("embedding"))
    done = log.commit({"vectors": made}, base)
    return own.join(_stored(log, done, model), "__key", "left").drop("__key")


def calls(spark: SparkSession, root: str) -> DataFrame:
    """version, model, sent (texts sent to the hook), failed: a row for each pass that sent any."""
    rows = Versions(spark, root).read("vectors")
    return rows.groupBy(F.col("seq").alias("version"), "model").agg(F.count("*").alias("sent"), F.count_if(F.col("embedding").isNull()).alias("failed"))
