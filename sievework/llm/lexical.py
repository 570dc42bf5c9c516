"""Ranked lexical search by windowed bucket scoring.

Documents are indexed where they are read: each window of 2,048 documents, in doc_id order within the window, becomes one row with
its document ids, lengths, and postings (slots and counts) by term. Collection statistics come from the windows' own totals. A
scoring task walks its windows; in each it traverses the postings of a query's terms, adds their impacts into an array of one
64-bit bucket a slot, marks slots in an occupancy set, and harvests marked buckets into a heap of the best k a query. Heaps of
all tasks meet in one ranking. All scores are 64-bit integers, so no order of additions changes them.

Queries are dealt into blocks of bounded size and all windows are walked once a block. Terms of the queries alone are indexed if
their number is within a bound, all terms otherwise; rows are the same.

A null or empty text has no terms; such a document counts in no statistic and is never found, such a query finds nothing. Each
row of documents is a document of its own, also with a repeated or null id (nulls rank last among equal scores). Rows of queries
with one id, null included, are one query with the terms of all of them. Other columns are left out. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialize, table

#: Documents of a window, one bucket each.
WINDOW = 2048
#: Query terms that are sent to all executors to index them alone.
SENT_TERMS = 500_000
#: Rows (query, term) of a block of queries.
BLOCK_TERMS = 500_000

# fixed values: characters of terms; A-Z are lower-cased, other ASCII characters end a term
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 128 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

SEGMENT = "doc_ids binary, nulls binary, lengths binary, n_docs long, n_terms long, terms array<binary>, dfs array<int>, slots binary, tfs binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_TABLE).split() if text else []


def index_windows(docs: DataFrame, terms: frozenset[bytes] | None = None) -> DataFrame:
    """One row for each window of documents (doc_id, text): SEGMENT; with terms, postings of those alone."""

    def window(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for slot, (_, _, counts) in enumerate(rows):
            for t, n in counts.items():
                postings.setdefault(t, []).append((slot, n))
        names = sorted(postings)
        pairs = np.array([p for t in names for p in postings[t]], np.int64).reshape(-1, 2)
        lengths = np.array([r[1] for r in rows], "<i8")
        cells = [
            np.array([r[0] or 0 for r in rows], "<i8").tobytes(), np.array([r[0] is None for r in rows]).tobytes(), lengths.tobytes(), int((lengths > 0).sum()), int(lengths.sum()),
            names, [len(postings[t]) for t in names], pairs[:, 0].astype("<u2").tobytes(), pairs[:, 1].astype("<i4").tobytes(),
        ]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [x.split(" ")[0] for x in SEGMENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                found = terms_of(text.as_py())
                rows.append((doc_id, len(found), Counter(found if terms is None else filter(terms.__contains__, found))))
                if len(rows) == WINDOW:
                    yield window(rows)
                    rows = []
        if rows:
            yield window(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SEGMENT)


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, term: each query's terms, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(x.as_py()))) for x in b.column(1).cast(pa.binary())]
            lists = pa.array(found, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pc.list_parent_indices(lists)), lists.flatten()], ["item_id", "term"])

    kind = queries.schema["item_id"].dataType.simpleString()
    return queries.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, term binary").distinct()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Scorer:
    """Buckets and heaps of a task for a block of queries, given as lists of term numbers."""

    def __init__(self, numbers: dict[bytes, int], weights: np.ndarray, queries: list[list[int]], n_docs: int, n_terms: int, k: int):
        self.numbers, self.weights, self.queries, self.n_docs, self.n_terms, self.k = numbers, weights, queries, n_docs, n_terms, k
        self.heaps: list[list[tuple]] = [[] for _ in queries]
        self.buckets = np.zeros(WINDOW, np.int64)
        self.occupied = np.zeros(WINDOW, bool)

    def walk(self, doc_ids, nulls, lengths, terms, dfs, slots, tfs) -> None:
        """Scores one window for all queries."""
        own = np.array([self.numbers.get(t, -1) for t in terms], np.int64)
        edges = np.concatenate([[0], np.cumsum(dfs, dtype=np.int64)])
        if 50 * int(lengths.max(initial=0)) * self.n_docs < 1 << 63:
            m = 50 + (50 * lengths * self.n_docs) // self.n_terms
        else:
            m = np.array([50 + (50 * int(n) * self.n_docs) // self.n_terms for n in lengths], np.int64)
        tf = tfs.astype(np.int64)
        impacts = np.repeat(np.where(own >= 0, self.weights[own], 0), dfs) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[slots]))
        where = np.full(len(self.numbers), -1)
        where[own[own >= 0]] = np.flatnonzero(own >= 0)
        for heap, asked in zip(self.heaps, self.queries, strict=True):
            here = where[asked]
            for p in here[here >= 0].tolist():
                s = slots[edges[p] : edges[p + 1]]
                self.buckets[s] += impacts[edges[p] : edges[p + 1]]
                self.occupied[s] = True
            marked = np.flatnonzero(self.occupied)
            if len(marked):
                self.harvest(heap, marked, self.buckets[marked], doc_ids, nulls)
                self.buckets[marked] = 0
                self.occupied[marked] = False

    def harvest(self, heap: list[tuple], marked: np.ndarray, scores: np.ndarray, doc_ids, nulls) -> None:
        fit = scores >= (heap[0][0] if len(heap) == self.k else 1)
        marked, scores = marked[fit], scores[fit]
        if len(marked) > self.k:  # slots ascend by doc_id, so the first of equals stay
            best = np.lexsort((marked, -scores))[: self.k]
            marked, scores = marked[best], scores[best]
        for slot, score in zip(marked.tolist(), scores.tolist(), strict=True):
            entry = (score, not nulls[slot], -int(doc_ids[slot]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, sent_terms: int = SENT_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents (doc_id, text) of each query (item_id, text)."""
    spark = docs.sparkSession
    asked = materialize(query_terms(queries), "lexical-asked")
    kind = asked.schema["item_id"].dataType.simpleString()
    names = asked.select("term").distinct().limit(sent_terms + 1).toArrow().column(0).to_pylist()  # bounded by the limit
    segments = materialize(index_windows(docs, frozenset(names) if len(names) <= sent_terms else None), "lexical-index")
    totals = segments.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    df = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    known = materialize(asked.join(df, "term"), "lexical-known")
    blocks = max(1, -(-known.count() // block_terms))
    block = F.pmod(F.xxhash64(F.col("item_id")), F.lit(blocks))

    def scored(number: int) -> DataFrame:
        rows = known.where(block == number).toArrow()  # about block_terms rows
        id_type = rows.schema.field("item_id").type
        numbers: dict[bytes, int] = {}
        weights: list[int] = []
        lists: dict[object, list[int]] = {}
        for term, item, n in zip(*[rows.column(c).to_pylist() for c in ("term", "item_id", "df")], strict=True):
            if term not in numbers:
                numbers[term] = len(weights)
                weights.append(weight(n_docs, n))
            lists.setdefault(item, []).append(numbers[term])
        items, of_items = list(lists), list(lists.values())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(numbers, np.array([*weights, 0], np.int64), of_items, n_docs, n_terms, k)
            for b in batches:
                for doc_ids, nulls, lengths, terms, dfs, slots, tfs in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    scorer.walk(np.frombuffer(doc_ids, "<i8"), np.frombuffer(nulls, bool), np.frombuffer(lengths, "<i8"), terms, np.array(dfs, np.int64), np.frombuffer(slots, "<u2"), np.frombuffer(tfs, "<i4"))
            best = [(items[i], -neg if own else None, score) for i, heap in enumerate(scorer.heaps) for score, own, neg in heap]
            arrays = [pa.array([x[i] for x in best], of) for i, of in enumerate((id_type, pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["item_id", "doc_id", "score"])

        return segments.select("doc_ids", "nulls", "lengths", "terms", "dfs", "slots", "tfs").mapInArrow(run, f"item_id {kind}, doc_id long, score long")

    found = scored(0)
    for number in range(1, blocks):
        found = found.unionByName(scored(number))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {terms} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
p AS MATERIALIZED (SELECT rid, doc_id, len(w)::BIGINT AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, n_docs),
r AS (SELECT item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50"""
