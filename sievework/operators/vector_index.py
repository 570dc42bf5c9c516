"""A stored vector index: cells of near vectors as folders, so that a search reads the cells near its queries.

Cells are the means of a k-means fit on a bounded sample, the rows with the least hashes; the sample shapes speed alone. Each
vector lies in the cell of its nearest centre with an 8-bit code of its offset from it, the code's scale and the exact length of
what the code leaves out. Each commit adds a part; a cell's radius and size are facts in a table of the version.

A search ranks the cells for each query, reads codes of the nearest ones, bounds each distance from both sides by what the code
leaves out, and scores exactly only those that may be among the k best. In exact mode the cells whose nearest possible vector,
by their radius, still beats the k-th score are read next, which proves the result; else it ends with the cells probed. Scores
and ties are those of ``vector.top_k_batch``. Queries are sent to executors in blocks of bounded size; what the blocks find is
ranked together, in one sort a task however many blocks there are.

Vectors that are null, empty, of another length than the index, or hold null or non-finite components are not indexed, and such
queries find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.versions import Snapshot, Versions
from .vector import fit_vectors, vector_rows

#: Rows of the sample that cells are fitted on, and the most cells.
SAMPLE = 20_000
MOST_CELLS = 4_096
#: Queries of a block.
SENT_QUERIES = 1_024


def _sample(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n)


def _centres(vectors: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Means of a sample of a bounded number of rows, fitted on executors."""
    held = _sample(vectors, SAMPLE).select(array_to_vector("embedding").alias("features")).repartition(8)
    model = KMeans(k=cells, seed=seed, maxIter=10, initSteps=2).fit(held)
    return np.array([c for c in model.clusterCenters()], float)


def _coded(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors (chunk_id, embedding) with cell, far (distance to its centre), code, scale, rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c2 = (centres * centres).sum(1)
        for b in batches:
            x = vector_rows(b.column(1))
            cell = np.concatenate([np.argmin(c2 - 2 * x[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)
            offset = x - centres[cell]
            scale = np.maximum(np.abs(offset).max(axis=1, initial=0) / 127, 1e-300)
            code = np.rint(offset / scale[:, None]).astype(np.int8)
            rest = np.sqrt(((offset - code * scale[:, None]) ** 2).sum(1))
            codes = pa.array([r.tobytes() for r in code], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt((offset * offset).sum(1))), codes, pa.array(scale), pa.array(rest), pa.array(cell.astype(np.int32))], ["chunk_id", "embedding", "far", "code", "scale", "rest", "cell"])

    return vectors.mapInArrow(run, "chunk_id long, embedding array<double>, far double, code binary, scale double, rest double, cell int")


def append(spark: SparkSession, path: str, vectors: DataFrame, cells: int | None = None, seed: int = 7) -> int:
    """Adds vectors (chunk_id long, embedding); the version. The first call fits the cells, as many as the root of the rows if not given."""
    log = Versions(spark, path)
    base = log.snapshot()
    held = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if "centres" not in base.facts:
        first = held.where(fit_vectors()).agg(F.min(F.struct(F.xxhash64("chunk_id"), F.size("embedding").alias("dim"))).alias("m"), F.count("*").alias("n")).first()
        if not first["n"]:
            return base.version
        dim = first["m"]["dim"]
        held = held.where(fit_vectors(dim))
        centres = _centres(held, max(1, min(cells or int(first["n"] ** 0.5), MOST_CELLS, SAMPLE)), seed)
        facts = {"centres": centres.tolist(), "dim": dim}
    else:
        held, centres, facts = held.where(fit_vectors(base.facts["dim"])), np.array(base.facts["centres"], float), {}
    # a cell of any size is split over files of the advisory size
    dealt = _coded(held, centres).hint("rebalance", "cell").sortWithinPartitions("cell", "chunk_id")
    staged = log.stage({"vectors": dealt}, base, facts=facts, partition_by={"vectors": "cell"})
    own = log.read("vectors", staged).where(F.col("seq") == staged.version)
    sizes = own.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    return log.publish(log.stage({"cells": sizes.coalesce(1)}, staged)).version


def remove(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Takes chunks (chunk_id) out; the version."""
    log = Versions(spark, path)
    base = log.snapshot()
    gone = ids.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct().withColumn("seq", F.lit(base.version + 1).cast("long"))
    return log.commit({"gone": gone}, base).version


def cell_rows(log: Versions, at: Snapshot, cells: list[int]) -> DataFrame:
    """Vectors of some cells: other cells' folders are not read. Removed ones are left out."""
    rows = log.read("vectors", at).where(F.col("cell").isin([int(c) for c in cells]))
    if at.parts.get("gone"):
        gone = log.read("gone", at).groupBy(F.col("chunk_id").alias("__c")).agg(F.max("seq").alias("__s"))
        rows = rows.join(gone, (F.col("chunk_id") == F.col("__c")) & (F.col("seq") < F.col("__s")), "left_anti")
    return rows


def _near(rows: DataFrame, ids: np.ndarray, q: np.ndarray, centres: np.ndarray, wanted: np.ndarray, limit: np.ndarray, k: int) -> DataFrame:
    """query_id, chunk_id, score: exact scores of the vectors in rows that may be among a query's k best, by their codes.

    wanted says which cells each query reads; limit is a squared distance beyond which a vector is of no use. The bounds of a
    batch's codes drop what has k better vectors in the batch or lies beyond the limit; a query has at most k rows a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, cell = b.column(0).to_numpy(), b.column(5).to_numpy()
            code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(len(chunk), -1)
            near = centres[cell] + code * b.column(3).to_numpy()[:, None]
            rest = b.column(4).to_numpy()
            out: list[tuple] = []
            x = None
            for i in range(len(q)):
                own = np.flatnonzero(wanted[i, cell])
                if not len(own):
                    continue
                d = np.sqrt(((near[own] - q[i]) ** 2).sum(1))
                slack = 1e-9 * (1 + d)
                low, high = np.maximum(d - rest[own] - slack, 0) ** 2, (d + rest[own] + slack) ** 2
                last = min(limit[i], np.partition(high, k - 1)[k - 1] if len(own) > k else np.inf)
                kept = own[low <= last]
                if len(kept):
                    x = vector_rows(b.column(1)) if x is None else x
                    score = 1 - ((x[kept] - q[i]) ** 2).sum(axis=1)
                    order = np.lexsort((chunk[kept], -np.round(score, 9)))[:k]
                    out.append((np.full(len(order), ids[i]), chunk[kept][order], score[order]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "chunk_id", "score"])

    return rows.select("chunk_id", "embedding", "code", "scale", "rest", "cell").mapInArrow(run, "query_id long, chunk_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _block(log: Versions, at: Snapshot, asked: pa.Table, k: int, probes: int, exact: bool) -> DataFrame:
    """query_id, chunk_id, score of what may be among the k best of a block of queries, not ranked."""
    centres = np.array(at.facts["centres"], float)
    ids, q = asked.column("query_id").to_numpy(), vector_rows(asked.column("embedding").combine_chunks())
    held = log.read("cells", at).groupBy("cell").agg(F.max("radius").alias("radius")).collect()  # a row a cell, at most MOST_CELLS
    radius = np.full(len(centres), -np.inf)
    for r in held:
        radius[r.cell] = r.radius
    away = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * q @ centres.T, 0))
    away = np.where(np.isfinite(radius)[None], away, np.inf)
    order = np.argsort(away, axis=1, kind="stable")[:, :probes]
    wanted = np.zeros(away.shape, bool)
    np.put_along_axis(wanted, order, True, axis=1)
    wanted &= np.isfinite(away)
    none = np.full(len(q), np.inf)
    first = _near(cell_rows(log, at, np.flatnonzero(wanted.any(0)).tolist()), ids, q, centres, wanted, none, k)
    if not exact:
        return first
    found = _ranked(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last")).collect()  # a row a query of the block
    limit = dict.fromkeys(ids.tolist(), np.inf) | {r.query_id: 1 - r.last + 1e-8 for r in found if r.n == k}
    limits = np.array([limit[i] for i in ids.tolist()])
    least = np.maximum(away - radius[None] - 1e-9 * (1 + away), 0) ** 2
    more = ~wanted & np.isfinite(away) & (least <= limits[:, None])
    if not more.any():
        return first
    return first.unionByName(_near(cell_rows(log, at, np.flatnonzero(more.any(0)).tolist()), ids, q, centres, more, limits, k))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, probes: int = 8, exact: bool = False, version: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best chunks of each query (query_id long, embedding): of the cells probed, or of all in exact mode."""
    log = Versions(spark, path)
    at = log.snapshot(version)
    empty = spark.createDataFrame([], "query_id long, chunk_id long, score double, rank long")
    if "centres" not in at.facts:
        return empty
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fit_vectors(at.facts["dim"]))
    blocks = max(1, -(-q.count() // SENT_QUERIES))
    out = None
    for number in range(blocks):
        asked = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()  # about SENT_QUERIES rows
        if asked.num_rows:
            found = _block(log, at, asked, k, probes, exact)
            out = found if out is None else out.unionByName(found)
    return empty if out is None else _ranked(out, k).select("query_id", "chunk_id", "score", "rank")
