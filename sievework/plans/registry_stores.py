"""Queries of stores and indexes: each builds one from the given tables in the shared folder, changes it and reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph_store, keyword_index, vector_index
from ..sources import relations as rel, scratch
from ..sources.versions import ChunkStore
from .registry import _BM25, ORACLES, S, _chunks, _documents_as_chunks, _questions, _t, query

_RANKED = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw WHERE rank <= 20"


# ---- stored keyword index
@query(f"WITH {_BM25} {_RANKED}")
def stored_bm25(spark, d):
    """BM25 from an index of two segments."""
    path, docs = scratch.folder(spark, "keywords"), _documents_as_chunks(spark, d)
    for part in (0, 1):
        keyword_index.append(spark, path, docs.where(F.col("chunk_id") % 2 == part))
    return keyword_index.search(spark, path, _questions(spark, d), 20).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25}, ow AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM sc WHERE score > 0 AND own) SELECT query_id, chunk_id, round(score, 6) AS score, place AS rank FROM ow WHERE place <= 20")
def stored_bm25_scoped(spark, d):
    """BM25 within each question's knowledge base, from an index whose blocks don't mix knowledge bases."""
    path = scratch.folder(spark, "keywords")
    keyword_index.append(spark, path, _documents_as_chunks(spark, d), by="kb_id")
    return keyword_index.search(spark, path, _questions(spark, d), 20, by="kb_id").withColumn("score", F.round("score", 6))


_LEFT = _BM25.replace("FROM documents)", "FROM documents WHERE doc_id % 3 <> 0)")


@query(f"WITH {_LEFT} {_RANKED}")
def index_after_changes(spark, d):
    """BM25 after a third of the chunks was removed, some came back and went again, and the segments were merged."""
    path, docs = scratch.folder(spark, "keywords"), _documents_as_chunks(spark, d)
    out = docs.where("chunk_id % 3 = 0")
    keyword_index.append(spark, path, docs)
    keyword_index.remove(spark, path, out)
    keyword_index.append(spark, path, out.where("chunk_id % 2 = 0"))
    keyword_index.merge(spark, path)
    keyword_index.remove(spark, path, out.where("chunk_id % 2 = 0"))
    return keyword_index.search(spark, path, _questions(spark, d), 20).withColumn("score", F.round("score", 6))


# ---- versioned store
@query(f"""WITH {S['chunks']}, v0 AS (SELECT doc_id, ord, chunk_id, text FROM chunks), v1 AS (SELECT * FROM v0 WHERE doc_id % 7 <> 0),
v2 AS (SELECT doc_id, ord, chunk_id, CASE WHEN doc_id % 5 = 0 AND ord = 1 THEN 'new: ' || text ELSE text END AS text FROM v1 UNION ALL SELECT doc_id, ord, chunk_id, 'new: ' || text FROM v0 WHERE doc_id % 5 = 0 AND doc_id % 7 = 0 AND ord = 1),
v3 AS (SELECT * FROM v2 UNION ALL SELECT doc_id, ord, chunk_id, text FROM v0 WHERE doc_id % 7 = 0 AND NOT (doc_id % 5 = 0 AND ord = 1))
SELECT version, doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(ord)::BIGINT AS ords, count(*) FILTER (starts_with(text, 'new: ')) AS changed FROM (SELECT 0 AS version, * FROM v0 UNION ALL SELECT 1, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3) GROUP BY 1, 2""")  # fmt: skip
def store_versions(spark, d):
    """Every version of a store after a delete, an upsert and an insert of absent chunks, all read at the end; the last one compacted."""
    rows = _chunks(spark, d).select("doc_id", "ord", "chunk_id", "text")
    store = ChunkStore(spark, scratch.folder(spark, "chunks"))
    store.append(rows)
    store.delete_documents(rows.where("doc_id % 7 = 0").select("doc_id"))
    store.upsert(rows.where("doc_id % 5 = 0 AND ord = 1").withColumn("text", F.concat(F.lit("new: "), "text")))
    store.add_absent(rows.where("doc_id % 7 = 0 OR doc_id % 2 = 0"))
    store.compact()
    found = [store.read(v).withColumn("version", F.lit(v if v < 4 else 3)) for v in (0, 1, 2, 4)]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return every.groupBy("version", "doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("ord").alias("ords"), F.count_if(F.startswith("text", F.lit("new: "))).alias("changed"))


# ---- vector index
_NEAREST = "s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, 1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0{0})"
_PLACED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20"


@query(f"WITH {_NEAREST.format('')}, {_PLACED}")
def vector_index_exact(spark, d):
    """The 20 nearest vectors by a stored index of two parts that reads on until cells' radii prove the result."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    path = scratch.folder(spark, "vectors")
    for part in (0, 1):
        vector_index.append(spark, path, v.where(F.col("chunk_id") % 2 == part))
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return vector_index.search(spark, path, q, 20, exact=True).withColumn("score", F.round("score", 6))


@query(f"WITH {_NEAREST.format(' AND v.vec_id % 3 <> 1')}, {_PLACED}")
def vector_index_after_removal(spark, d):
    """The same after a third of the vectors was removed."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    path = scratch.folder(spark, "vectors")
    vector_index.append(spark, path, v)
    vector_index.remove(spark, path, v.where("chunk_id % 3 = 1"))
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return vector_index.search(spark, path, q, 20, exact=True).withColumn("score", F.round("score", 6))


# ---- stored graph
@query(ORACLES["neighbors_2hop"])
def stored_neighbors(spark, d):
    """Two hops from every supplier over a stored graph of two parts."""
    path, edges = scratch.folder(spark, "graph"), rel.relations(spark, d)
    graph_store.append(spark, path, edges.where("relation_type <> 'SUPPLIES'"))
    graph_store.append(spark, path, edges.where("relation_type = 'SUPPLIES'"))
    seeds = rel.entities(spark, d).where("type = 'supplier'").select(F.col("entity_id").alias("seed"))
    return graph_store.neighbors(spark, path, seeds, 2, 20)


@query(ORACLES["simple_paths"])
def stored_paths(spark, d):
    """Paths between suppliers and two regions, read from both ends of a stored graph."""
    path, nodes = scratch.folder(spark, "graph"), rel.entities(spark, d)
    graph_store.append(spark, path, rel.relations(spark, d))
    pairs = nodes.where("type = 'supplier'").select(F.col("entity_id").alias("source"), F.explode(F.array(F.lit("R0"), F.lit("R1"))).alias("target"))
    return graph_store.paths(spark, path, pairs, 3)
