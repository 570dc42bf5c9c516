"""Composite plans: document ingest and question answering over many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import models, titles
from ..functions.text import token_count
from ..operators import catalog, context, fusion, graph, keyword, outline, quality, vector
from ..sources import embedding_cache, scratch
from ..sources.relations import chunks
from ..sources.versions import ChunkStore


def outlined(documents: DataFrame) -> DataFrame:
    """doc_id, ord, text, path (array): lines below the table of contents' titles, chunks of title-only text joined with the next."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "")
    lines = lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "text")
    found = outline.after_toc(outline.titles(lines), outline.toc_range(lines))
    grouped = outline.chunks_by_title(lines, outline.paths(outline.levels(found)), joined=False)
    return outline.merge_title_only(grouped.withColumn("path", F.coalesce("path", F.array().cast("array<string>"))), joined=False)


def judged(rows: DataFrame, hooks: models.Hooks, patterns: list[str] | None = None) -> DataFrame:
    """rows (doc_id, ord, text, path array) with every quality rule: risks, total_risk, hard, mode; patterns are those of title levels."""
    df = quality.rules(quality.measured(rows))
    df = quality.window_similarity(quality.neighbor_similarity(df, hooks.embed), hooks.embed)
    return quality.validated(quality.topic_rules(df.withColumn("breaks_structure", titles.breaks_structure(F.col("path"), patterns or []))))


def document_graph(rows: DataFrame, hooks: models.Hooks) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each document's graph from chunks (doc_id, ord, chunk_id, text) by the extraction hooks."""
    return graph.build(models.extracted_entities(rows, hooks), models.extracted_relations(rows, hooks))


def ingest(documents: DataFrame, hooks: models.Hooks, short: int = 20, by_title: bool = False) -> DataFrame:
    """doc_id, ord, chunk_id, text, length, embedding: lines, or chunks by title; short ones merged, blank ones left out, embedded."""
    rows = (outlined(documents) if by_title else chunks(documents)).select("doc_id", "ord", "text")
    merged = outline.merge_short(rows, token_count(F.col("text")) < short)
    out = merged.select("doc_id", "ord", F.concat_ws("_", "doc_id", "ord").alias("chunk_id"), "text", F.length("text").cast("long").alias("length"))
    return models.encode(out, hooks)


def post_processed(rows: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, ord, chunk_id, text, path, page, type, keywords, length: chunks as they are stored.

    rows (doc_id, ord, text, path array, and page, type if known) are joined where a chunk is only its title, numbered from 1 in
    each document and given their k keywords, greatest weight first. A missing page is 1, a missing type "text". A chunk
    without words has no keywords.
    """
    for name, kind in (("page", "long"), ("type", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    merged = outline.merge_title_only(rows, joined=False).withColumn("chunk_id", F.concat_ws("_", "doc_id", "ord"))
    path = scratch.folder(rows.sparkSession, "processed-chunks")  # read three times
    merged.write.parquet(path)
    merged = rows.sparkSession.read.schema(merged.schema).parquet(path)
    best = keyword.keyword_lists(merged.select("chunk_id", "text"), k).select("chunk_id", F.transform("best", lambda x: x["keyword"]).alias("keywords"))
    out = merged.join(best, "chunk_id", "left")
    return out.select(
        "doc_id", "ord", "chunk_id", "text", "path", F.coalesce("page", F.lit(1).cast("long")).alias("page"), F.coalesce("type", F.lit("text")).alias("type"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"),
    )


def reingest(documents: DataFrame, store: ChunkStore, hooks: models.Hooks, cache: str, model: str = "default", short: int = 20, by_title: bool = False) -> int:
    """Takes documents into a store anew and gives its version: what a full ingest() of them gives, with texts of the cache not embedded again.

    A document's chunks are replaced in one commit, also where none is left. An edit changes the chunks that it touches; only
    those texts go to the hook, wherever the others stand now.
    """
    rows = (outlined(documents) if by_title else chunks(documents)).select("doc_id", "ord", "text")
    merged = outline.merge_short(rows, token_count(F.col("text")) < short)
    fresh = merged.select("doc_id", "ord", F.concat_ws("_", "doc_id", "ord").alias("chunk_id"), "text", F.length("text").cast("long").alias("length"))
    return store.replace_documents(embedding_cache.encode(fresh, hooks, cache, model), ids=documents.select("doc_id"))


def recall_test(queries: DataFrame, stored: DataFrame, files: DataFrame, hooks: models.Hooks, fan_out: int = 20, n: int = 5) -> DataFrame:
    """query_id, chunk_id, doc_id, file_name, text, score, rerank_score, new_rank: the vector stage reranked, with file names.

    queries (query_id, text, embedding, kb_id) search their knowledge base, those without one all of stored (chunk_id, doc_id,
    kb_id, text, embedding). A knowledge base without files or hits gives no rows.
    """
    rows, asked = stored.select("chunk_id", "kb_id", "embedding"), queries.select("query_id", "kb_id", "embedding")
    scoped = vector.top_k_batch(asked.where("kb_id is not null"), rows.where("kb_id is not null"), fan_out, by="kb_id")
    hits = scoped.unionByName(vector.top_k_batch(asked.where("kb_id is null"), rows, fan_out))
    wide = hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(stored.select("chunk_id", "doc_id", "text"), "chunk_id")
    ranked = catalog.named_hits(fusion.rerank(wide, hooks.score, n), files)
    return ranked.select("query_id", "chunk_id", "doc_id", "file_name", "text", "score", "rerank_score", "new_rank")


def hybrid(queries: DataFrame, stored: DataFrame, hooks: models.Hooks, graph_hits: DataFrame | None = None, fan_out: int = 20, n: int = 5) -> DataFrame:
    """query_id, chunk_id, fused_score, rerank_score, new_rank for queries (query_id, text, embedding) over stored (chunk_id long, text, embedding)."""
    hits = {"vector": vector.top_k_batch(queries.select("query_id", "embedding"), stored.select("chunk_id", "embedding"), fan_out), "keyword": keyword.search(queries.select("query_id", "text"), stored.select("chunk_id", "text"), fan_out)}
    if graph_hits is not None:
        hits["graph"] = graph_hits
    fused = fusion.best(fusion.rrf(hits), fan_out)
    wide = fused.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(stored.select("chunk_id", "text"), "chunk_id")
    return fusion.rerank(wide, hooks.score, n)


def ask(queries: DataFrame, stored: DataFrame, hooks: models.Hooks) -> DataFrame:
    """query_id, answer: hybrid retrieval, the score gate, contexts, and the answer hook; a question without hits gets the apology."""
    ranked = fusion.gate(hybrid(queries, stored, hooks))
    hits = ranked.join(stored.select("chunk_id", "doc_id", "ord"), "chunk_id").select("query_id", F.col("new_rank").alias("rank"), "doc_id", "ord", "text")
    full = queries.select("query_id", F.col("text").alias("query")).join(context.build(hits), "query_id", "left").withColumn("context", F.coalesce("context", F.lit(context.NO_ANSWER)))
    return models.answers(full, hooks)
