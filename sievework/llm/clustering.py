"""Centroid clustering with Drake's adaptive distance bounds.

Each vector keeps its centroid, an upper bound of the distance to it, its next few nearest centroids with a lower bound each,
and one bound for all remaining centroids. A bound holds for its centroid and all later ones, so after centroids have moved the
first bound above the upper one tells which centroids can't have come nearest; only those before it are compared, and all of
them where no bound suffices. Comparisons are of exact integers, equal distances go to the smaller number. A bound decides only
beyond a margin for rounding, so what bounds can't certify is compared exactly. How many bounds are kept follows the greatest
number that a round needed.

Vectors are packed integers in a table that each round writes anew with its bounds, and with the sums that its batches' moved
vectors add to and take from centroids; a round is one pass, and the driver gets one row a centroid and component. The table
before the last is deleted, so the disk holds two.

Kept are vectors of exactly ``dim`` components, none null, NaN or infinite. A component beyond ``LARGEST`` in absolute value
counts as infinite too, as squared distances would not fit 64 bits. Fewer kept vectors than centroids give a centroid each.
Repeated rows are vectors of their own; a null id is kept but seeds a centroid only after all others. Sums that don't fit a long
are null. Other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, scratch, table

#: Lower bounds a vector starts with; they become fewer as rounds need fewer, but not below two.
NEAREST = 3
#: Greatest absolute value of a component before scaling by 1024: with it 64 squared differences add up within 63 bits.
LARGEST = float(1 << 17)
#: A bound decides only if it is clear by this share and amount.
MARGIN = 1e-9
#: Products of integers up to this size add up exactly in doubles, for up to 128 components.
EXACT = 1 << 22
#: Vectors compared at a time.
ROWS = 4096


def _rows(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.dtype.itemsize * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _pack(x: np.ndarray) -> pa.Array:
    """Rows of integers as binary, in the narrowest of 16, 32 and 64 bits for all of them."""
    most = int(np.abs(x).max(initial=0))
    return _rows(x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"))


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    widths = np.diff(offsets)
    out = np.empty((len(column), dim), np.int64)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        at = (offsets[:-1][rows][:, None] + np.arange(width)) if len(rows) < len(column) else slice(offsets[0], offsets[-1])
        out[rows] = np.ascontiguousarray(data[at]).reshape(len(rows), width).view({2: "<i2", 4: "<i4", 8: "<i8"}[width // dim])
    return out


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of equal length out of binary."""
    if not len(column) or not width:
        return np.zeros((len(column), width), kind)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    data = np.frombuffer(column.buffers()[2], np.uint8)[first : first + np.dtype(kind).itemsize * width * len(column)]
    return data.view(kind).reshape(len(column), width)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, as 64-bit integers."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) <= EXACT and x.shape[1] <= 128:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class State(NamedTuple):
    """Of a batch: centroid, upper bound, next nearest centroids, lower bounds (one more, for the rest)."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray


def scan(x: np.ndarray, centroids: np.ndarray, bounds: int) -> State:
    """All centroids compared."""
    d = squared(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
    rest = far[:, bounds + 1] if len(centroids) > bounds + 1 else np.full(len(x), np.inf)
    return State(order[:, 0].copy(), far[:, 0].copy(), order[:, 1 : bounds + 1].copy(), np.column_stack([far[:, 1 : bounds + 1], rest]))


def clear(upper: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where the lower bound is above the upper one whatever rounding did."""
    return upper * (1 + MARGIN) + MARGIN < low


def advance(x: np.ndarray, s: State, centroids: np.ndarray, moves: np.ndarray, bounds: int) -> tuple[State, int, int]:
    """The state after centroids moved, with so many bounds; the depth that was needed and the distances computed."""
    low, near = s.low[:, : bounds + 1].copy(), s.near[:, :bounds].copy()
    low[:, bounds] = s.low[:, bounds:].min(axis=1) - moves.max(initial=0)
    for z in range(bounds - 1, -1, -1):
        low[:, z] = np.minimum(low[:, z] - moves[near[:, z]], low[:, z + 1])
    cluster, upper = s.cluster.copy(), s.upper + moves[s.cluster]
    open_ = np.flatnonzero(~clear(upper, low[:, 0]))
    upper[open_] = np.sqrt(((x[open_] - centroids[cluster[open_]]) ** 2).sum(1).astype(float))
    depth = (~clear(upper[open_, None], low[open_])).sum(axis=1)
    computed = len(open_)
    for z in range(1, bounds + 1):
        r = open_[depth == z]
        if len(r):
            ids = np.sort(np.column_stack([cluster[r], near[r, :z]]), axis=1)
            d = np.stack([((x[r] - centroids[ids[:, i]]) ** 2).sum(1) for i in range(z + 1)], axis=1)
            order = np.argsort(d, axis=1, kind="stable")
            ids, far = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(float))
            cluster[r], upper[r], near[r, :z] = ids[:, 0], far[:, 0], ids[:, 1:]
            for i in range(z - 1, -1, -1):
                low[r, i] = np.minimum(far[:, i + 1], low[r, i + 1])
            computed += d.size
    r = open_[depth == bounds + 1]
    if len(r):
        full = scan(x[r], centroids, bounds)
        cluster[r], upper[r], near[r], low[r] = full
        computed += len(r) * len(centroids)
    return State(cluster, upper, near, low), int(depth.max(initial=0)), computed


def prepare(rows: DataFrame, dim: int, scale: int = 1024) -> DataFrame:
    """vec_id, v (packed integers floor(scale * component)) of the kept rows (vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), _pack(np.floor(scale * x).astype(np.int64))], ["vec_id", "v"])

    fit = (F.size("embedding") == dim) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) <= LARGEST * 1024 / scale, F.lit(False)))
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(fit).mapInArrow(run, f"vec_id {kind}, v binary")


COLUMNS = "v binary, cluster int, upper double, near binary, low binary, distance long, moved int, n long, total array<long>"


def _round(state: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, kept: int, bounds: int) -> DataFrame:
    """The next table: a row a vector, and a row for each batch and centroid with what moved (moved = k: depth and distances computed)."""
    k, dim = centroids.shape
    first = moves is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", *[c.split(" ")[0] for c in COLUMNS.split(", ")]]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x, n = _unpack(b.column(1), dim), b.num_rows
                if first:
                    new, depth, computed, before = scan(x, centroids, bounds), 0, n * k, np.full(n, -1)
                else:
                    before = b.column(2).to_numpy().astype(np.int64)
                    old = State(before, b.column(3).to_numpy(), _matrix(b.column(4), "<i2", kept).astype(np.int64), _matrix(b.column(5), "<f8", kept + 1))
                    new, depth, computed = advance(x, old, centroids, moves, bounds)
                own = ((x - centroids[new.cluster]) ** 2).sum(1)
                nulls = lambda kind, n=n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array(new.cluster.astype(np.int32)), pa.array(new.upper), _rows(new.near.astype("<i2")), _rows(new.low.astype("<f8")), pa.array(own),
                    nulls(pa.int32()), nulls(pa.int64()), nulls(pa.list_(pa.int64())),
                ], names)
                went = before != new.cluster
                rows = [(k, computed, [depth])]
                for c in range(k):
                    enters, leaves = went & (new.cluster == c), went & (before == c)
                    if enters.any() or leaves.any():
                        rows.append((c, int(enters.sum()) - int(leaves.sum()), (x[enters].sum(0) - x[leaves].sum(0)).tolist()))
                m = len(rows)
                yield pa.RecordBatch.from_arrays([
                    nulls(b.schema.field(0).type, m), nulls(pa.binary(), m), nulls(pa.int32(), m), nulls(pa.float64(), m), nulls(pa.binary(), m), nulls(pa.binary(), m), nulls(pa.int64(), m),
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                ], names)

    kind = state.schema["vec_id"].dataType.simpleString()
    columns = ["vec_id", "v"] if first else ["vec_id", "v", "cluster", "upper", "near", "low"]
    return state.where("v is not null").select(*columns).mapInArrow(run, f"vec_id {kind}, {COLUMNS}")


def drake(rows: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, salt: str = "3", nearest: int = NEAREST) -> tuple[DataFrame, np.ndarray, list[int]]:
    """vec_id, cluster, distance (squared) of the kept rows after the rounds and a last assignment; the centroids; distances computed in each."""
    spark = rows.sparkSession
    paths: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "drake"))
        df.write.parquet(paths[-1])
        if len(paths) > 2:
            discard(spark, paths.pop(0))
        return spark.read.schema(df.schema).parquet(paths[-1])

    state = written(prepare(rows, dim))
    named = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = state.select("v", named.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    kinds = {2: "<i2", 4: "<i4", 8: "<i8"}
    centroids = np.array([np.frombuffer(r.v, kinds[len(r.v) // dim]) for r in seeds], np.int64).reshape(-1, dim)
    k = len(centroids)
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    bounds = kept = max(0, min(nearest, k - 1))
    moves, work = None, []
    for number in range(rounds + 1 if k else 0):
        state = written(_round(state, centroids, moves, kept, bounds))
        added = state.where("moved is not null").select("moved", "n", F.posexplode("total").alias("at", "x"))
        told = added.groupBy("moved", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("x").alias("most")).collect()  # k * dim rows and one
        depth = bounds
        for r in told:
            if r.moved == k:
                work.append(r.n)
                depth = r.most
            else:
                sums[r.moved][r.at] += r.x
                if r.at == 0:
                    counts[r.moved] += r.n
        if number == rounds:
            break
        before = centroids.copy()
        for c in range(k):
            if counts[c]:
                centroids[c] = [s // counts[c] for s in sums[c]]
        moves = np.array([math.sqrt(sum(int(d) ** 2 for d in a - b)) for a, b in zip(before, centroids, strict=True)]) * (1 + MARGIN)
        kept, bounds = bounds, bounds if number == 0 else max(min(2, bounds), min(bounds, depth))
    if not k:
        state = state.select("vec_id", "v", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    return state.where("v is not null").select("vec_id", "cluster", "distance"), centroids, work


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance, sums of it and the centroid's hash for every kept vector of embeddings, 8 centroids, 10 rounds."""
    found, centroids, _ = drake(table(spark, sf_dir, "embeddings"))
    digest = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in centroids]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid
    total = sum(int(r.s) for r in sums)
    fit = lambda x: x if x < 1 << 63 else None
    told = [(r.cluster, fit(int(r.s)), fit(total), digest[r.cluster]) for r in sums]
    of = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The rounds one after another, every vector compared with every centroid."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        "e AS MATERIALIZED (SELECT rid, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM v)",
        f"s AS (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM s)",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT rid, c, sum((x - y) * (x - y))::BIGINT AS d FROM e JOIN c{r} USING (j) GROUP BY rid, c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < rounds:
            mean = f"SELECT c, j, sum(x)::BIGINT AS t, count(*) AS n FROM a{r} JOIN e USING (rid) GROUP BY c, j"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce((t - ((t % n) + n) % n) // n, y) AS y, o.j FROM c{r} o LEFT JOIN ({mean}) m USING (c, j))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c)")
    out = "sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia"
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, {out}, h AS centroid_sha256 FROM a{rounds} JOIN v USING (rid) JOIN h USING (c)"
