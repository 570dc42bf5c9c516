"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a text of fewer words is one shingle). Texts with equal sets form a class, which takes
part once with its count, so copies are never paired. Each class is signed once with ``HASHES`` MinHash values of 16 bits;
classes that agree in a band of ``ROWS`` of them meet in that band's bucket, block against block of about ``BLOCK`` classes, so
a bucket of any size is spread over tasks, and classes that share no band are never compared. In a bucket a pair that met in
an earlier band is left out; the MinHash values of the others are compared a slice at a time: with m of n equal and a uniform
prior, the similarity has a Beta(m + 1, n - m + 1) posterior, and a pair whose probability of reaching the threshold is under
``TOLERANCE`` is dropped. Only classes that are left in a pair get their texts, in the bucket where they are left, and their pairs
are verified on the sets. No pair leaves its task: a task gives each class's number of links and its local root.

A pair at the threshold itself shares a band with probability 1 - (1 - 0.8 ** ROWS) ** (HASHES / ROWS) = 0.9993.

Null text and texts without words have no shingles and link with nothing. Null doc_ids take part and sort last when a
group's first document is named. Repeated rows are documents of their own. Empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_broadcast, materialize, spread, table
from .components import components
from .embeddings import _groups, local_roots
from .shingles import mix, runs, word_hashes

WORDS = 5
THRESHOLD = 0.8
HASHES = 144
ROWS = 6
SLICE = 24
TOLERANCE = 1e-6
SEED = 30_011
BLOCK = 256
#: Texts under which pairs are intersected one by one rather than by matrix products.
PAIRWISE = 64

_MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of a non-empty set: 16 bits of the least of its upper 32 bits' products with odd multipliers."""
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(upper), 2048):
        np.minimum(low, np.multiply.outer(_MULTIPLIERS, upper[at : at + 2048]).min(axis=1), out=low)
    return (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that name a set, whatever its order."""
    return mix(shingles + np.uint64(len(shingles))).sum().tobytes() + mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum().tobytes()


def bands(signatures: np.ndarray) -> np.ndarray:
    """(n, bands) hashes of the bands of n signatures."""
    rows = signatures.reshape(len(signatures), -1, ROWS)
    out = np.zeros(rows.shape[:2], np.uint64)
    for r in range(ROWS):
        out = mix(out + rows[:, :, r] + np.uint64(1))
    return out


@functools.lru_cache
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values of n that leave a pair in: P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray, same: bool, band: int = 0, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) that share no band before this one and that the posterior never rules out; for same, j < i."""
    alive = np.tri(len(left), k=-1, dtype=bool) if same else np.ones((len(left), len(right)), bool)
    if band:
        for a, b in zip(bands(left).T[:band], bands(right).T[:band], strict=True):
            alive &= a[:, None] != b[None, :]
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int32)
    for n in range(SLICE, HASHES + 1, SLICE):
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            matches[s] += (left[i[s], n - SLICE : n] == right[j[s], n - SLICE : n]).sum(axis=1, dtype=np.int32)
        ok = matches >= least_matches(n, threshold)
        i, j, matches = i[ok], j[ok], matches[ok]
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of threshold or more, exactly."""
    size = np.array([len(s) for s in sets])
    common = np.zeros(len(i), np.int64)
    if len(i) <= PAIRWISE or len(i) < 2 * len(sets):
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            common[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:  # products of membership matrices, a slice of shared shingles at a time
        used = np.unique(np.concatenate([i, j]))
        owner = np.repeat(np.arange(len(used)), size[used])
        values, place, counts = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(counts > 1)
        column = np.full(len(values), -1)
        column[shared] = np.arange(len(shared))
        column = column[place]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        products = np.zeros((len(used), len(used)), np.float32)
        for at in range(0, len(shared), 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            m = np.zeros((len(used), 4096), np.float32)
            m[owner[a:b], column[a:b] - at] = 1
            products += m @ m.T
        common = products[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)
    return common / (size[i] + size[j] - common) >= threshold


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, signed = [], []
        for _, words in word_hashes(b.column(2)):
            s = np.unique(runs(words, WORDS))
            cls.append(set_id(s) if len(s) else None)
            signed.append(minhash(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "th", "cls", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = bands(_stacked(b.column(1), np.uint16))
        n, k = found.shape
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(found.view(np.int64).ravel())], ["cls", "t", "bucket"])


def _stacked(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _met(rows: pa.Table, t: int, bi: int, bj: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The surviving pairs of a bucket's two blocks, as row numbers."""
    mine = rows.column("mine").to_numpy()
    sig = _stacked(rows.column("sig").combine_chunks(), np.uint16)
    left = np.flatnonzero(mine == bi)
    right = left if bi == bj else np.flatnonzero(mine == bj)
    i, j = survivors(sig[left], sig[right], bi == bj, t, threshold)
    return left[i], right[j]


def _prune(threshold: float):
    """Rows of classes that are in a surviving pair of their bucket: the others' texts are not wanted."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, _, bi, bj), rows in _groups(batches, 4):
            if rows.num_rows > 1:
                pairs = _met(rows, int(t), bi, bj, threshold)
                used = rows.drop_columns(["sig"]).take(pa.array(np.unique(np.concatenate(pairs))))
                yield from used.combine_chunks().to_batches()

    return prune


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, _, bi, bj), rows in _groups(batches, 4):
            i, j = _met(rows, int(t), bi, bj, threshold)
            if not len(i):
                continue
            n = rows.column("n").to_numpy()
            sets = [np.unique(runs(w, WORDS)) for _, w in word_hashes(rows.column("text").combine_chunks())]
            ok = verified(sets, i, j, threshold)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            add = np.zeros(len(n), np.int64)
            np.add.at(add, i, n[j])
            np.add.at(add, j, n[i])
            root = local_roots(len(n), i, j)
            linked = np.unique(np.concatenate([i, j]))
            cls = rows.column("cls").combine_chunks()
            yield pa.RecordBatch.from_arrays([cls.take(pa.array(linked)), pa.array(add[linked]), cls.take(pa.array(root[linked]))], ["cls", "links", "root"])

    return compare


def text_hash():
    return F.coalesce(F.md5("text"), F.lit(""))


def _joined(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, th, cls), (classes: cls, copies, n_links, class_low, low) where low is the first (null, doc_id, th) of the component."""
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text").mapInArrow(_sign, "doc_id long, th string, cls binary, sig binary")
    rows = materialize(signed, "jaccard-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min(first).alias("low"), F.min("th").alias("th"), F.first("sig").alias("sig"))
    classes = materialize(classes, "jaccard-classes")
    banded = materialize(classes.select("cls", "sig").mapInArrow(_bands, "cls binary, t int, bucket long"), "jaccard-bands")
    # buckets with a count each; those of one class have nothing to compare
    sizes = materialize(banded.groupBy("t", "bucket").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "jaccard-sizes")
    met = materialize(banded.join(sizes, ["t", "bucket"]).select("t", "bucket", "cls", "blocks"), "jaccard-met")
    # a row for each pair of blocks that has this class's block
    dealt = met.withColumn("mine", F.pmod(F.xxhash64("cls", "t"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["t", "bucket", "bi", "bj"]
    dealt = dealt.select("t", "bucket", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine", "cls").join(classes.select("cls", "sig"), "cls").select(*keys, "mine", "cls", "sig")
    pruned = spread(dealt, met.agg(F.sum("blocks")), keys).mapInArrow(_prune(threshold), "t int, bucket long, bi int, bj int, mine int, cls binary")
    close = materialize(pruned, "jaccard-close")
    # texts go to the pairs that are left alone: one text of each class, reduced before the shuffle
    wanted = materialize(classes.join(close.select("cls").distinct(), "cls").select("cls", "th", "sig", F.col("copies").alias("n")), "jaccard-wanted")
    texts = docs.select(text_hash().alias("th"), "text").join(bounded_broadcast(wanted.select("th")), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    wanted = materialize(wanted.join(texts, "th").drop("th"), "jaccard-texts")
    dealt = spread(close.join(wanted, "cls").select(*keys, "mine", "cls", "n", "sig", "text"), close.agg(F.count("*")), keys, 5_000)
    found = materialize(dealt.mapInArrow(_compare(threshold), "cls binary, links long, root binary"), "jaccard-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "jaccard-components")
    placed = classes.select("cls", "copies", F.col("low").alias("class_low")).join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "cls")), "jaccard-rooted")
    lows = materialize(placed.groupBy("root").agg(F.min("class_low").alias("low")), "jaccard-lows")
    return rows.drop("sig"), materialize(placed.join(lows, "root").select("cls", "copies", "n_links", "class_low", "low"), "jaccard-placed")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (first document with the same shingles), n_links (other documents at threshold or more), component_id, kept."""
    rows, placed = _joined(docs, threshold)
    df = rows.join(placed, "cls", "left")
    alone = F.col("cls").isNull()
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    return df.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_low.id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("low.id")).alias("component_id"), (alone | (own == F.col("low"))).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each component, its first; all columns of docs."""
    rows, placed = _joined(docs, threshold)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    kept = rows.join(placed, "cls", "left").where(F.col("cls").isNull() | (own == F.col("low")))
    # equal (doc_id, th) among the kept are repeated rows: one stays, unless there is no word in them
    kept = materialize(kept.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.max(F.col("cls").isNotNull() & (F.col("copies") > 1)).alias("__copied")), "jaccard-kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(row.alias("__row"), F.col("doc_id").cast("long").alias("__i"), text_hash().alias("__t"))
    df = df.join(kept, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th"))).select("__row", "__i", "__t", "__copied")
    once = df.where("__copied").groupBy("__i", "__t").agg(F.first("__row").alias("__row")).select("__row")
    return df.where("not __copied").select("__row").union(once).select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
