"""Weighted reciprocal-rank fusion, reranking, score gates and two-stage fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import tokens

RRF_K = 60
WEIGHTS = {"vector": 0.5, "keyword": 0.3, "graph": 0.2}
CHUNK_GATE, RERANK_GATE = 0.3, 0.6


def rrf(hits: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, fused_score and each method's share, from ranked lists (query_id, chunk_id, rank from 1).

    One union and one aggregation in the place of a full outer join per method.
    """
    parts = [df.select("query_id", "chunk_id", F.lit(m).alias("method"), (F.lit(weights[m]) / (k + F.col("rank"))).alias("part")) for m, df in hits.items()]
    shares = [F.coalesce(F.sum(F.when(F.col("method") == m, F.col("part"))), F.lit(0.0)).alias(f"{m}_part") for m in weights]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(*shares).withColumn("fused_score", reduce(Column.__add__, [F.col(f"{m}_part") for m in weights]))


def merged(vector: DataFrame, keyword: DataFrame, graph: DataFrame) -> DataFrame:
    """query_id, chunk_id, doc_id, text, vector_score, keyword_score, graph_score, related_entities of chunks that any search found.

    vector has query_id, chunk_id, doc_id, text, score, keyword the same without text, graph also related_entities. The text is
    the vector search's, empty where it didn't find the chunk; a score that is missing is 0. One union and one aggregation.
    """
    none = F.lit(None)
    side = lambda df, place, text, related: df.select("query_id", "chunk_id", "doc_id", F.lit(place).alias("side"), text.cast("string").alias("text"), "score", related.cast("array<string>").alias("related"))
    rows = side(vector, 0, F.col("text"), none).unionByName(side(keyword, 1, none, none)).unionByName(side(graph, 2, none, F.col("related_entities")))
    score = lambda i: F.coalesce(F.max(F.when(F.col("side") == i, F.col("score"))), F.lit(0.0))
    return rows.groupBy("query_id", "chunk_id").agg(
        F.min_by("doc_id", "side").alias("doc_id"), F.coalesce(F.max("text"), F.lit("")).alias("text"), score(0).alias("vector_score"), score(1).alias("keyword_score"), score(2).alias("graph_score"),
        F.max("related").alias("related_entities"),
    )


def best(fused: DataFrame, n: int = 20) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("fused_score", 12)), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def overlap(query: Column, text: Column) -> Column:
    """The default reranker: share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.size(F.array_intersect(q, tokens(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(candidates: DataFrame, scorer=overlap, n: int = 5) -> DataFrame:
    """candidates (query_id, query, chunk_id, text, rank) in order of the scorer, n a query, ties in input order; plus rerank_score and new_rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return candidates.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 9)).withColumn("new_rank", F.row_number().over(w).cast("long")).where(F.col("new_rank") <= n)


def pad(scored: DataFrame, n: int = 5) -> DataFrame:
    """Fills up what a reranker returned (rerank_score not null) to n with the other candidates whose text is not among the returned ones, in input order."""
    key = Window.partitionBy("query_id", "text")
    df = scored.withColumn("returned", F.max(F.col("rerank_score").isNotNull()).over(key))
    df = df.where("rerank_score is not null or not returned")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return df.withColumn("new_rank", F.row_number().over(w).cast("long")).where(F.col("new_rank") <= n).drop("returned")


def gate(ranked: DataFrame, least: float = CHUNK_GATE) -> DataFrame:
    return ranked.where(F.coalesce("rerank_score", F.lit(0.0)) >= least)


def fallback(scoped: DataFrame, overall: DataFrame, questions: DataFrame, least: float = RERANK_GATE) -> DataFrame:
    """For each question (query_id, kb_id): its scoped hits if no knowledge base is set or their best score reaches least, else the overall ones.

    Both passes are one plan; a question without hits has a best score of 0.
    """
    top = scoped.groupBy("query_id").agg(F.max(F.coalesce("rerank_score", F.lit(0.0))).alias("top"))
    choice = questions.join(top, "query_id", "left").select("query_id", (F.col("kb_id").isNull() | (F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)) >= least)).alias("stay"))
    first = scoped.join(choice.where("stay"), "query_id", "left_semi").withColumn("scope", F.lit("kb"))
    second = overall.join(choice.where("not stay"), "query_id", "left_semi").withColumn("scope", F.lit("global"))
    return first.unionByName(second)
