"""Vector search: score = 1 - squared Euclidean distance (for unit vectors 2 cos - 1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a side is null or zero. One root of both squared lengths: a cosine of whole numbers that a double holds, as 0.75, is exact."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sums = F.array(F.struct(total(a, b).alias("ab"), total(a, a).alias("aa"), total(b, b).alias("bb")))

    def of(s: Column) -> Column:
        both = s["aa"] * s["bb"]  # leaves the range of doubles before its root does
        size = F.when((both > 1e-280) & (both < 1e280), F.sqrt(both)).otherwise(F.sqrt(s["aa"]) * F.sqrt(s["bb"]))
        return F.when(size > 0, s["ab"] / size).otherwise(0.0)

    return F.get(F.transform(sums, of), F.lit(0))


def top_k(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k best chunks of one query vector; a filter on vectors before this reaches the scan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", 1 - squared_distance(F.col("embedding"), q))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


#: Queries that are sent to all executors; with more, blocks of queries meet blocks of chunks.
SENT_QUERIES = 4_096


def fit_vectors(dim: int | None = None, name: str = "embedding") -> Column:
    """Whether a vector can be compared: not null or empty, of a length if one is given, without null or non-finite components."""
    v = F.col(name)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) == dim if dim is not None else F.size(v) > 0) & finite, F.lit(False))


def vector_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = pa.compute.list_flatten(column)
    return flat.to_numpy().astype(np.float64).reshape(len(column), len(flat) // max(1, len(column)))


#: Queries that a task compares with a batch of chunks at a time.
COMPARED = 256


def _nearest(qi: np.ndarray, a: np.ndarray, vi: np.ndarray, b: np.ndarray, k: int, allowed: np.ndarray | None = None) -> pa.Table:
    """query_id, chunk_id, score of each query's k best among some chunks, ties by chunk_id."""
    if len(a) > COMPARED:
        cut = [slice(i, i + COMPARED) for i in range(0, len(a), COMPARED)]
        return pa.concat_tables([_nearest(qi[s], a[s], vi, b, k, None if allowed is None else allowed[s]) for s in cut])
    out: list[np.ndarray] = []
    if len(a) and len(b):
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        rough = a2[:, None] + b2[None, :] - 2 * a @ b.T
        if allowed is not None:
            rough[~allowed] = np.inf
        # all that rounding of the product or of scores may tie with the k-th, however many; those are scored term by term
        slack = 1e-8 + 8 * (a.shape[1] + 4) * np.finfo(float).eps * (a2 + b2.max())
        last = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1] + slack
        kept = ~(rough > last[:, None]) & (rough < np.inf)
        for i in range(len(a)):
            near = np.flatnonzero(kept[i])
            score = 1 - ((b[near] - a[i]) ** 2).sum(axis=1)
            order = np.lexsort((vi[near], -np.round(score, 9)))[:k]
            out.append(np.rec.fromarrays([np.full(len(order), qi[i]), vi[near][order], score[order]], names="q,v,s"))
    rows = np.concatenate(out) if out else np.rec.fromarrays([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], names="q,v,s")
    return pa.table({"query_id": pa.array(rows["q"], pa.int64()), "chunk_id": pa.array(rows["v"], pa.int64()), "score": pa.array(rows["s"], pa.float64())})


def top_k_batch(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = 1024, by: str | None = None, sent: int = SENT_QUERIES) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best chunks of every query (query_id, embedding), with by among those of equal key.

    Vectors that are null, empty, of another length than the queries' (the commonest, the least of equals), or hold null or
    non-finite components, are left out, and such queries find nothing. A counted, bounded number of queries is sent to the executors: chunks stay where they are read and each batch keeps k rows a
    query. More queries and chunks are dealt into blocks, and a task compares block with block by one matrix product.
    """
    key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    q = queries.select("query_id", key.alias("key"), "embedding").where(fit_vectors())
    lengths = q.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    n, dim = (lengths[0]["n"], lengths[0]["dim"]) if lengths else (0, 0)
    q, v = q.where(F.size("embedding") == dim), vectors.select("chunk_id", key.alias("key"), "embedding").where(fit_vectors(dim))
    if n <= sent:
        asked = q.toArrow()  # at most ``sent`` rows
        qi, a, qk = asked.column("query_id").to_numpy(), vector_rows(asked.column("embedding").combine_chunks()), np.array(asked.column("key").to_pylist(), dtype=object)

        def scan(batches):
            for b in batches:
                allowed = qk[:, None] == np.array(b.column("key").to_pylist(), dtype=object)[None, :] if by else None
                yield from _nearest(qi, a, b.column("chunk_id").to_numpy(), vector_rows(b.column("embedding")), k, allowed).to_batches()

        local = v.mapInArrow(scan, "query_id long, chunk_id long, score double")
    else:
        nq, nv = (max(1, -(-x // block)) for x in (n, v.count()))
        of = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        left = q.select("key", of("query_id", nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("vb"), F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("embedding").alias("v"))
        right = v.select("key", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), of("chunk_id", nv).alias("vb"), F.lit(1).alias("side"), F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))

        def best(_, rows):
            side, ids, x = rows.column("side").to_numpy(), rows.column("id").to_numpy(), vector_rows(rows.column("v").combine_chunks())
            return _nearest(ids[side == 0], x[side == 0], ids[side == 1], x[side == 1], k)

        local = left.unionByName(right).groupBy("key", "qb", "vb").applyInArrow(best, "query_id long, chunk_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return local.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("total_chunks"), F.count_distinct("doc_id").alias("total_documents"))


def dimensions(vectors: DataFrame) -> DataFrame:
    """dim, n: how many vectors have each length; a store should have one."""
    return vectors.groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))
