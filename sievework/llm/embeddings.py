"""Near duplicates among embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors that are equal in every component form a class, which takes part once with its count. Each class gets one signature per
table, the signs of its products with random hyperplanes, and a code: the first ``CODE_BITS`` of those signs. Classes that share
a signature in a table first meet by code alone. A pair whose codes differ in more bits than all but ``MISS`` of the pairs at the
threshold do, or that met in an earlier table that the codes hold, goes no further; vectors move only to buckets where a pair of
theirs is left, and are compared there exactly in double precision. Buckets are dealt block against block of about ``BLOCK``
classes, so one of any size is spread over tasks and no pair leaves a task: a task gives each class's number of new links and its
local root. A pair that meets in several tables counts in the first. Roots of all tasks are joined into components.

Planes and unit vectors are rounded to integers small enough for exact sums, so a vector has the same signs wherever they are
computed. Bits per table grow with the logarithm of the number of classes, so a bucket holds about 2 to the ``ROOM_BITS``
unrelated ones; the number of tables follows from the bits and the wanted recall at the threshold itself (higher above it).

Null vectors, those with null or non-finite components and zero vectors link with nothing. Vectors of different lengths
never meet. Repeated rows are vectors of their own. A null vec_id takes part, names no component unless all its ids are
null, and is kept only if its component has no id. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import bounded_broadcast, materialize, spread, table
from .components import components

THRESHOLD = 0.9
RECALL = 0.99
#: Share of the pairs at the threshold that codes may lose; the tables' recall makes up for it.
MISS = 0.001
ROOM_BITS = 5
CODE_BITS = 256
SEED = 20_011
BLOCK = 4096
#: Pairs compared at a time.
PAIRS = 1 << 19


def plan_tables(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits) for a number of classes."""
    bits = min(60, max(6, math.ceil(math.log2(max(classes, 2))) - ROOM_BITS))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    recall = min(recall / (1 - MISS), 1 - 1e-9)
    return math.ceil(math.log(1 - recall) / math.log(1 - hit)), bits


def most_differing(threshold: float = THRESHOLD) -> int:
    """Bits in which the codes of all but ``MISS`` of the pairs at the threshold differ at most."""
    share = math.acos(threshold) / math.pi
    return math.ceil(CODE_BITS * share + NormalDist().inv_cdf(1 - MISS) * math.sqrt(CODE_BITS * share * (1 - share)))


@functools.lru_cache(maxsize=8)
def planes(dim: int, n: int) -> np.ndarray:
    """n planes as integers; the first ones are the same for every n."""
    return np.rint(np.random.default_rng([SEED, dim]).standard_normal((n, dim)) * 2**12).T.copy()


def signs(units: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) signs of unit vectors: sums of integers under 2**52 for up to 2**17 components, so exact in any order."""
    p = planes(units.shape[1], n)
    out = np.empty((len(units), n), bool)
    for at in range(0, len(units), 2048):
        out[at : at + 2048] = np.rint(units[at : at + 2048] * 2**20) @ p > 0
    return out


def signatures(bits_of: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables) signatures of rows of signs."""
    return bits_of[:, : tables * bits].reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _units(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: row numbers and unit vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py()).to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy() - column.offsets[0].as_py()
    out = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        v = flat[starts[rows][:, None] + np.arange(d)].astype(np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
        out[int(d)] = (rows, v / np.linalg.norm(v, axis=1, keepdims=True))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first columns from sorted batches, also across batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[s] for c in cols)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(b.slice(s, e - s))
    if held:
        yield held_key, pa.Table.from_batches(held)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal first columns, with the place where each run begins and the end."""
    held: list[pa.RecordBatch] = []

    def starts(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows - 1, bool)
        for i in range(keys):
            c = rows.column(i).to_numpy()
            change |= c[1:] != c[:-1]
        return np.r_[0, np.flatnonzero(change) + 1, rows.num_rows]

    for b in batches:
        if not b.num_rows:
            continue
        # a run that goes on is only held, not looked through again
        if held and all(held[0].column(i)[0] == b.column(i)[-1] for i in range(keys)):
            held.append(b)
            continue
        rows = pa.Table.from_batches([*held, b]).combine_chunks()
        at = starts(rows)
        if len(at) > 2:
            yield rows.slice(0, at[-2]).combine_chunks(), at[:-1]
        held = rows.slice(at[-2]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, starts(rows)


def suspects(at: np.ndarray, t: np.ndarray, crossed: np.ndarray, mine: np.ndarray, codes: np.ndarray, most: int, bits: int, small: int = 64) -> np.ndarray:
    """Flags of the rows of whole buckets that have a pair whose codes differ in at most ``most`` bits and that no earlier table in the codes has.

    Rows at[i] to at[i + 1] are a bucket, of table t; of a crossed one only pairs of different ``mine`` count.
    """
    flags = np.zeros(len(codes), bool)
    masks = np.zeros((CODE_BITS // bits, CODE_BITS), bool)
    for s in range(len(masks)):
        masks[s, s * bits : (s + 1) * bits] = True
    masks = np.packbits(masks, axis=1, bitorder="little").view(np.uint64)

    def mark(i: np.ndarray, j: np.ndarray) -> None:
        differ = codes[i] ^ codes[j]
        new = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most
        i, j, differ = i[new], j[new], differ[new]
        for s in range(min(len(masks), int(t[i].max(initial=0)))):
            new = (s >= t[i]) | (differ & masks[s]).any(axis=1)
            i, j, differ = i[new], j[new], differ[new]
        flags[i] = True
        flags[j] = True

    size = np.diff(at)
    end = np.repeat(at[1:], size)
    rows = np.flatnonzero(np.repeat((size <= small) & (size > 1), size))
    for step in range(1, small):
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        pair = rows[~crossed[rows] | (mine[rows] != mine[rows + step])]
        mark(pair, pair + step)
    for s, e in zip(at[:-1][size > small], at[1:][size > small], strict=True):
        left = np.arange(s, e)
        right = left
        if crossed[s]:
            left, right = left[mine[s:e] == mine[s]], left[mine[s:e] != mine[s]]
        if not len(right):
            continue
        for k in range(0, len(left), max(1, PAIRS // len(right))):
            part = left[k : k + max(1, PAIRS // len(right))]
            i, j = np.repeat(part, len(right)), np.tile(right, len(part))
            if not crossed[s]:
                i, j = i[i < j], j[i < j]
            mark(i, j)
    return flags


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that pairs (i, j) link each of n rows to."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For classes (cls long or binary, n long, v array): (cls, n_links to other classes' vectors) and edges (a, b)."""
    count = vectors.count()
    tables, bits = plan_tables(count, threshold, recall)
    n_signs = -(-max(tables * bits, CODE_BITS) // 64) * 64
    most = most_differing(threshold)
    kind = vectors.schema["cls"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, (rows, units) in _units(b.column(1)).items():
                packed = np.packbits(signs(units, n_signs), axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), pa.array([r.tobytes() for r in packed], pa.binary())], ["cls", "d", "signs"])

    coded = materialize(vectors.select("cls", "v").mapInArrow(sign, f"cls {kind}, d int, signs binary"), "embedding-codes")

    def in_tables(batches: Iterator[pa.RecordBatch], with_code: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            packed = np.frombuffer(b"".join(b.column("signs").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            sig = signatures(np.unpackbits(packed, axis=1, bitorder="little"), tables, bits)
            place = pa.array(np.repeat(np.arange(b.num_rows), tables))
            cols = [pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)), b.column("d").take(place), pa.array(sig.ravel())]
            names = ["t", "d", "sig"]
            if with_code:
                code = pa.array([r.tobytes() for r in packed[:, : CODE_BITS // 8]], pa.binary())
                cols, names = [*cols, b.column("cls").take(place), code.take(place)], [*names, "cls", "code"]
            yield pa.RecordBatch.from_arrays(cols, names)

    bucket = ["t", "d", "sig"]
    sizes = coded.select("d", "signs").mapInArrow(lambda x: in_tables(x, False), "t int, d int, sig long").groupBy(*bucket).agg(F.count("*").alias("m"))
    large = materialize(sizes.where(F.col("m") > block).withColumn("blocks", F.ceil(F.col("m") / block).cast("int")), "embedding-large")
    met = coded.mapInArrow(lambda x: in_tables(x, True), f"t int, d int, sig long, cls {kind}, code binary")
    met = met.join(bounded_broadcast(large), bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # a row for each pair of blocks that has this class's block
    met = met.withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(7)), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [*bucket, "bi", "bj"]
    met = met.select(*bucket, F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine", "cls", "code")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in _whole_groups(batches, 5):
            t, bi, bj, mine = (rows.column(c).to_numpy() for c in ("t", "bi", "bj", "mine"))
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
            left = rows.drop_columns(["code"]).filter(pa.array(suspects(at, t, bi != bj, mine, codes, most, bits)))
            yield from left.combine_chunks().to_batches()

    met = spread(met, large.agg(F.coalesce(F.sum(F.col("m") * (F.col("blocks") - 1)), F.lit(0)) + F.lit(count * tables)), keys, 200_000)
    left = materialize(met.mapInArrow(prune, f"t int, d int, sig long, bi int, bj int, mine int, cls {kind}"), "embedding-suspects")
    dealt = left.join(vectors, "cls").select(*keys, "mine", "cls", "n", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, _, _, bi, bj), rows in _groups(batches, 5):
            rows = rows.combine_chunks()
            if rows.num_rows < 2:
                continue
            n, mine = (rows.column(c).to_numpy() for c in ("n", "mine"))
            ((_, units),) = _units(rows.column("v").combine_chunks()).values()
            sig = signatures(signs(units, t * bits), t, bits) if t else None
            left = np.flatnonzero(mine == bi)
            right = left if bi == bj else np.flatnonzero(mine == bj)
            add, root = np.zeros(rows.num_rows, np.int64), np.arange(rows.num_rows)
            for at in range(0, len(left), max(1, PAIRS // max(1, len(right)))):
                part = left[at : at + max(1, PAIRS // max(1, len(right)))]
                i, j = np.nonzero(units[part] @ units[right].T >= threshold)
                i, j = part[i], right[j]
                if bi == bj:
                    i, j = i[i > j], j[i > j]
                for s in range(int(t)):  # pairs that met before count there
                    new = sig[i, s] != sig[j, s]
                    i, j = i[new], j[new]
                np.add.at(add, i, n[j])
                np.add.at(add, j, n[i])
                # of this part's links only a root for each row is kept
                root = local_roots(rows.num_rows, np.r_[i, np.arange(rows.num_rows)], np.r_[j, root])
            used = np.flatnonzero(add)
            if not len(used):
                continue
            cls = rows.column("cls").combine_chunks()
            yield pa.RecordBatch.from_arrays([cls.take(pa.array(used)), pa.array(add[used]), cls.take(pa.array(root[used]))], ["cls", "links", "root"])

    found = materialize(spread(dealt, left.agg(F.count("*")), keys).mapInArrow(compare, f"cls {kind}, links long, root {kind}"), "embedding-links")
    return found.groupBy("cls").agg(F.sum("links").alias("n_links")), found.select(F.col("cls").alias("a"), F.col("root").alias("b"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    v = F.col("embedding").cast("array<double>")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    single = embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType(), embeddings.schema["embedding"].dataType.containsNull)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(bad, None).otherwise(F.col("embedding") if single else v).alias("v"))
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    rows = rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.unhex(F.concat(half("v"), half(F.lit(1), "v")))))
    classes = rows.where("v is not null").groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("v").alias("v"))
    # numbers, written with the classes, stand for their names from here on
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()), "embedding-classes")
    counted, edges = links(classes.select(F.col("no").alias("cls"), "n", "v"), threshold, recall)
    roots = components(edges, "embedding-components")
    placed = classes.select("cls", "no", "n", "low").join(counted.withColumnRenamed("cls", "no"), "no", "left").join(roots.withColumnRenamed("node", "no"), "no", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "no")), "embedding-rooted")
    lows = materialize(placed.groupBy("root").agg(F.min("low").alias("component_id")), "embedding-lows")
    placed = materialize(placed.join(lows, "root").select("cls", F.col("n").alias("copies"), "n_links", "component_id"), "embedding-placed")
    df = rows.select("vec_id", "cls").join(placed, "cls", "left")
    own = F.col("cls").isNull()
    component = F.when(own, F.col("vec_id")).otherwise(F.col("component_id"))
    return df.select("vec_id", F.when(own, 0).otherwise(F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
