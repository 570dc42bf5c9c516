"""Queries of whole retrievals: recall tests, hybrid answers, cached embeddings, records as stores keep them, tables of a page."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import models
from ..operators import catalog, tables
from ..sources import embedding_cache, relations as rel, scratch
from ..sources.versions import Versions
from . import pipelines
from .registry import _BM25, _DISTANCE, _QUESTIONS, S, _chunks, _questions, _t, _vectors, query
from .registry_validation import LETTERS

_OVERLAP = r"coalesce(round(len(list_intersect(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')), regexp_extract_all(lower({1}), '[\p{{L}}\p{{N}}]+')))::DOUBLE / nullif(len(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))), 0), 9), 0)"


def _stored(spark, d):
    """Documents that have a vector, as stored chunks."""
    texts = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return _vectors(spark, d).join(texts, "chunk_id")


def _asked(spark, d):
    """Questions with the vector of their number."""
    return _questions(spark, d).join(_vectors(spark, d).select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id")


@query(rf"""WITH {_QUESTIONS}, {S['files']}, qk AS (SELECT query_id, text, CASE WHEN query_id % 40 = 0 THEN kb_id END AS kb_id FROM qs),
vs AS (SELECT query_id, qk.text AS query, v.vec_id AS chunk_id, d.text, {_DISTANCE} AS score FROM qk JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON true JOIN documents d ON d.doc_id = v.vec_id AND (kb_id IS NULL OR d.source = kb_id)),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 20),
rs AS (SELECT *, {_OVERLAP.format("query", "text")} AS rerank_score FROM vr), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM rs QUALIFY new_rank <= 5)
SELECT query_id, chunk_id, CASE WHEN f.id IS NULL THEN '未知文件_' || chunk_id WHEN trim(f.name) = '' THEN '文件_' || chunk_id ELSE f.name END AS file_name, md5(text) AS text_md5, round(score, 6) AS score, rerank_score, new_rank FROM rr LEFT JOIN files f ON f.id = chunk_id AND f.id % 11 <> 0""")  # fmt: skip
def recall_hits(spark, d):
    """The recall test of every question, half of them within their knowledge base, with names, scores and texts; some files are unknown."""
    q = _asked(spark, d).withColumn("kb_id", F.when(F.col("query_id") % 40 == 0, F.col("kb_id")))
    out = pipelines.recall_test(q, _stored(spark, d), rel.files(_t(spark, d, "documents")).where("id % 11 <> 0"), models.Hooks())
    return out.select("query_id", "chunk_id", "file_name", F.md5("text").alias("text_md5"), F.round("score", 6).alias("score"), "rerank_score", "new_rank")


_HELD = _BM25.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))")


@query(rf"""WITH {_HELD}, vs AS (SELECT query_id, v.vec_id AS chunk_id, {_DISTANCE} AS score FROM qs JOIN embeddings q ON q.vec_id = query_id, embeddings v JOIN documents d ON d.doc_id = v.vec_id),
vh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM vs),
u AS (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS p FROM vh WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 0.3 / (60 + rank) FROM kw WHERE rank <= 20),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 12) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(p) AS f FROM u GROUP BY 1, 2) QUALIFY rank <= 20),
rs AS (SELECT fr.*, d.text, {_OVERLAP.format("qs.text", "d.text")} AS rerank_score FROM fr JOIN qs USING (query_id) JOIN documents d ON d.doc_id = chunk_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM rs QUALIFY new_rank <= 5),
g AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY new_rank) AS context FROM rr WHERE rerank_score >= 0.3 GROUP BY query_id),
c AS (SELECT query_id, CASE WHEN length(context) > 3000 THEN left(context, 3000) || chr(10) || '...(内容截断)' ELSE context END AS context FROM g),
a AS (SELECT qs.query_id, coalesce(context, '抱歉，根据当前知识库内容，我无法回答这个问题。您可以尝试重新描述问题或上传相关文档。') AS context FROM qs JOIN embeddings ON vec_id = query_id LEFT JOIN c USING (query_id))
SELECT query_id, context[1:200] AS answer FROM a""")  # fmt: skip
def hybrid_answers(spark, d):
    """Every question through hybrid retrieval, rerank, gate, context and the default answer; the apology where nothing passes."""
    stored = _stored(spark, d).withColumn("ord", F.col("chunk_id"))
    return pipelines.ask(_asked(spark, d).where("query_id is not null"), stored, models.Hooks())


@query(f"""WITH {S['chunks']}, t AS (SELECT doc_id % 3 = 0 AS early, text, list_sum({LETTERS.format("text")}) AS letters FROM chunks WHERE trim(text) <> ''), k AS (SELECT text, bool_or(early) AS early, any_value(letters) AS letters FROM t GROUP BY text)
SELECT CASE WHEN early THEN 0 ELSE 1 END AS version, count(*) AS sent, sum(letters)::DOUBLE AS letters, (SELECT count(*) FROM t) AS embedded FROM k GROUP BY early""")  # fmt: skip
def cached_embeddings(spark, d):
    """Texts sent to the model by a pass over a third of the documents and one over all: the second sends what the first has not."""
    root, rows, hooks = scratch.folder(spark, "cache"), _chunks(spark, d).select("doc_id", "ord", "text"), models.Hooks(embed=models.letter_counts)
    embedding_cache.encode(rows.where("doc_id % 3 = 0"), hooks, root, "letters")
    full = embedding_cache.encode(rows, hooks, root, "letters").agg(F.count("embedding").alias("embedded"))
    sent = Versions(spark, root).read("vectors").withColumn("l", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x))
    return sent.groupBy(F.col("seq").cast("int").alias("version")).agg(F.count("*").alias("sent"), F.sum("l").alias("letters")).join(F.broadcast(full))


@query(f"WITH {S['chunks']} SELECT doc_id, ord, kb_id AS base, doc_id::VARCHAR AS document, 2 AS depth, ord % 2 = 0 AS found FROM chunks WHERE kb_id IS NOT NULL AND doc_id % 5 = 0")
def document_records(spark, d):
    """The records of a fifth of the documents in order, their JSON paths decoded, and whether a chunk is in another store."""
    rows = _chunks(spark, d).where("kb_id is not null")
    records = rows.select("doc_id", "ord", "chunk_id", catalog.encoded_path(F.array("kb_id", F.col("doc_id").cast("string"))).alias("title_path"))
    held = catalog.document_records(records, rows.where("doc_id % 5 = 0"))
    out = catalog.existing(held, rows.where("ord % 2 = 0"))
    return out.select("doc_id", "ord", F.get("title_path", F.lit(0)).alias("base"), F.get("title_path", F.lit(1)).alias("document"), F.size("title_path").alias("depth"), "found")


@query("""WITH RECURSIVE t AS (SELECT o_custkey AS doc_id, o_orderkey % 3 AS page, o_orderkey AS id, o_totalprice AS row_count, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS i,
  (row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) + 2 * sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey))::INT AS ord FROM orders),
g AS (SELECT doc_id, page, i, ord, row_count, ord AS first FROM t WHERE i = 1 UNION ALL SELECT t.doc_id, t.page, t.i, t.ord, t.row_count, CASE WHEN t.ord - g.first > 2 THEN t.ord ELSE g.first END FROM g JOIN t ON t.doc_id = g.doc_id AND t.page = g.page AND t.i = g.i + 1)
SELECT doc_id, page, first, count(*) AS members, round(sum(row_count)::DOUBLE, 2) AS row_count, min(ord)::DOUBLE AS y0, max(ord + 1)::DOUBLE AS y1 FROM g GROUP BY 1, 2, 3""")  # fmt: skip
def merged_tables(spark, d):
    """Groups of a page's tables: each within two places of the first of its group."""
    w = Window.partitionBy("o_custkey", F.col("o_orderkey") % 3).orderBy("o_orderkey")
    n = F.row_number().over(w) + 2 * F.sum((F.col("o_orderstatus") == "F").cast("int")).over(w)
    t = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 3).alias("page"), n.cast("int").alias("ord"), F.lit("t").alias("text"), F.col("o_totalprice").alias("row_count"))
    t = t.withColumns({"x0": F.lit(0.0), "y0": F.col("ord").cast("double"), "x1": F.lit(1.0), "y1": (F.col("ord") + 1).cast("double")})
    return tables.merge_tables(t).select("doc_id", "page", "first", "members", F.round(F.col("row_count").cast("double"), 2).alias("row_count"), "y0", "y1")
