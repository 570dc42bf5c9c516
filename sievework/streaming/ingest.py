"""Streaming ingest: new document files become chunks in an append-only store, with a status row per batch; and event-time windows.

The reference's background ingest thread and status polling become a file stream with foreachBatch; the event windows go
beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.relations import chunks

DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def ingest(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Reads document files as they come; writes chunks under store/chunks and a status row per batch under store/status.

    A batch is written to a folder of its own id, so a batch that runs again after a failure replaces its own output.
    """
    docs = spark.readStream.schema(DOCUMENTS).parquet(incoming)

    def write(batch: DataFrame, batch_id: int) -> None:
        made = chunks(batch)
        made.write.mode("overwrite").parquet(f"{store}/chunks/batch={batch_id}")
        status = made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.lit("completed").alias("status"))
        missing = batch.select("doc_id").join(status, "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("chunks"), F.lit("failed").alias("status"))
        status.unionByName(missing).write.mode("overwrite").parquet(f"{store}/status/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value), batch or stream."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    out = w.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
