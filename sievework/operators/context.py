"""Conversation history and answer contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

NO_ANSWER = "抱歉，根据当前知识库内容，我无法回答这个问题。您可以尝试重新描述问题或上传相关文档。"
CUT_OFF = "\n...(内容截断)"


def recent(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(w).cast("long")).where(F.col("back") <= n)


def build(hits: DataFrame, longest: int = 3000) -> DataFrame:
    """query_id, context: hits (query_id, rank, doc_id, ord, text) by document in order of first hit, chunks by ord, cut at longest characters."""
    docs = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rank", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "doc_id", "text"))), lambda x: x["text"]), "\n\n")
    out = docs.groupBy("query_id").agg(text.alias("context"))
    return out.select("query_id", F.when(F.length("context") > longest, F.concat(F.substring("context", 1, longest), F.lit(CUT_OFF))).otherwise(F.col("context")).alias("context"))
