"""Substring dedup by collinear chaining of shared k-mer seeds.

Every distinct text gives its seeds: the runs of ``K`` words whose hash divides by ``EVERY``, which does not depend on the words
around them, so an edit spoils only the runs it touches. A seed that several texts hold links each of them to its head, the text
with the least hash: links grow with the number of texts, not with its square, and a seed in a third of all texts is a grouped
minimum and a join that skew handling can split. Where neighbouring seeds have heads that don't hold both of them near each
other, as when the parts of a passage also stand alone in other texts, each pair of them is a seed with a head of its own: the
least text that holds both in that order within ``REACH`` words. For each (text, head) the matches are chained in order: a
Fenwick tree holds the best chain end by place in the head, and each match takes the best chain before it, less a cost for the
gap. Chains of two seeds or more are aligned on the words: exact blocks grow from the seeds, and what lies between and around
them is aligned by its longest common subsequence. An aligned passage of at least ``MIN_WORDS`` words and ``SIMILARITY`` equal
ones is a repeat.

Texts that are equal as a whole are one text here; each further copy of MIN_WORDS words or more is a repeat of the first, a
null doc_id's copy too. Passages that a text repeats within itself alone are not looked for. Null text and short texts have no
seeds; a null doc_id takes part and sorts last among copies; rows that repeat a doc_id with its text count as one document;
empty tables give empty results. Texts are named by 64 bits while they are linked, and by 128 wherever rows are given or removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WORD, bounded_broadcast, materialize, table
from .shingles import mix, runs, word_hashes

K = 5
#: One run of K words in so many is a seed, and one seed in so many may be half of a pair.
EVERY = 3
PAIRED = 2
MIN_WORDS = 50
SIMILARITY = 0.8
#: A chain's cost for each word of a gap in either text, and the largest gap between matches of a passage.
GAP_COST = 0.05
MAX_GAP = 60
#: Words between two seeds that are linked as a pair where their own heads don't hold both; no less than a passage's least.
REACH = 60
#: Words between a chain's first and last that make it worth aligning.
LEAST_SPAN = 10
#: Words of the texts around a chain that the alignment may use: more than a similar passage has between two seeds.
MARGIN = 80
#: Words past a block that are aligned at a time, and equal ones among the next half of them that such a step needs.
STEP = 32
STEP_EQUAL = 8


def sampled(words: np.ndarray, k: int = K, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text's seeds; none below k words."""
    if len(words) < k:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h = runs(words, k)
    at = np.flatnonzero(h % np.uint64(every) == 0)
    return at.astype(np.int32), h[at].view(np.int64)


def chains(own: np.ndarray, other: np.ndarray, k: int = K) -> list[np.ndarray]:
    """Best collinear chains of matches (own place, other place), as indices in order; a match is in one chain at most.

    A chain ending in a match scores k plus the best of: nothing, or the score of a chain whose end lies before it in both
    texts, less GAP_COST for each word between them in either. That cost splits into a part of each end, so one Fenwick
    tree of greatest (score + cost so far) by place in the other text gives the best predecessor in logarithmic time.
    Chains are taken best first and cut where a gap exceeds MAX_GAP.
    """
    order = np.lexsort((other, own))
    xs, ys = own[order].tolist(), other[order].tolist()
    n = len(xs)
    rank = (np.searchsorted(np.unique(other), other[order]) + 1).tolist()
    size = max(rank, default=0) + 1
    tree: list[tuple[float, int]] = [(-1e18, -1)] * size
    best, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        stop = i
        while stop < n and xs[stop] == xs[i]:
            stop += 1
        for t in range(i, stop):  # those with the same own place don't precede each other
            at, top = rank[t] - 1, (-1e18, -1)
            while at > 0:
                top = max(top, tree[at])
                at &= at - 1
            gained = top[0] - GAP_COST * (xs[t] + ys[t])
            best[t], back[t] = (k + gained, top[1]) if gained > 0 else (float(k), -1)
        for t in range(i, stop):
            at, value = rank[t], (best[t] + GAP_COST * (xs[t] + ys[t]), t)
            while at < size:
                if value > tree[at]:
                    tree[at] = value
                at += at & -at
        i = stop
    used = [False] * n
    out = []
    for t in sorted(range(n), key=lambda t: -best[t]):
        chain, at = [], t
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = back[at]
        chain.reverse()
        start = 0
        for c in range(1, len(chain) + 1):
            if c == len(chain) or max(xs[chain[c]] - xs[chain[c - 1]], ys[chain[c]] - ys[chain[c - 1]]) > MAX_GAP:
                if c > start:
                    out.append(order[chain[start:c]])
                start = c
    return out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, by the bit-parallel recurrence: a zero bit i is where the length grows at a[i]."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = [full]
    for y in b:
        row = rows[-1]
        hit = row & where.get(y, 0)
        rows.append(((row + hit) | (row - hit)) & full)
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif rows[j - 1] >> (i - 1) & 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            j -= 1
    return out[::-1]


def align(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Equal blocks (place in a, place in b, length) in order: a chain's seeds grown to exact blocks, and common words between and past them."""
    a, b = a.tolist(), b.tolist()
    pairs: list[tuple[int, int]] = []

    def onward(i: int, j: int, step: int) -> list[tuple[int, int]]:
        """Common words from (i, j) on, forwards or backwards, as long as the next words have enough of them."""
        out = []
        while True:
            x, y = (a[i : i + STEP], b[j : j + STEP]) if step > 0 else (a[max(0, i - STEP + 1) : i + 1][::-1], b[max(0, j - STEP + 1) : j + 1][::-1])
            near = set(x[: STEP // 2])
            if sum(w in near for w in y[: STEP // 2]) < min(STEP_EQUAL, len(x), len(y)) or not x or not y:
                return out
            found = common(x, y)
            if not found:
                return out
            out += [(i + step * p, j + step * q) for p, q in found]
            p, q = found[-1]
            i, j = i + step * (p + 1), j + step * (q + 1)

    for i, j in anchors:
        if pairs and (i <= pairs[-1][0] or j <= pairs[-1][1]):
            continue
        low_i, low_j = (pairs[-1][0] + 1, pairs[-1][1] + 1) if pairs else (0, 0)
        s = e = 0
        while i - s > low_i and j - s > low_j and a[i - s - 1] == b[j - s - 1]:
            s += 1
        while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e]:
            e += 1
        if not s + e:
            continue
        if pairs:
            pairs += [(low_i + p, low_j + q) for p, q in common(a[low_i : i - s], b[low_j : j - s])]
        pairs += [(i + r, j + r) for r in range(-s, e)]
    if not pairs:
        return []
    pairs = onward(pairs[0][0] - 1, pairs[0][1] - 1, -1)[::-1] + pairs + onward(pairs[-1][0] + 1, pairs[-1][1] + 1, 1)
    blocks: list[tuple[int, int, int]] = []
    for i, j in pairs:
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def similar_stretches(blocks: list[tuple[int, int, int]], least: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, equal words) of the stretches of an alignment with enough words and equal ones.

    Equal words are a share of them and the words of edits (of the longer side each). The longest stretch goes first, then those
    on either side of it, so no stretch with enough words and equal ones lies apart from all that are given.
    """
    if not blocks:
        return []
    i, j, n = np.array(blocks, np.int64).T
    # an equal word counts 1, a word of an edit similarity / (1 - similarity) less: a stretch has enough equal words if its sum is not negative
    gaps = np.append(0, np.maximum(i[1:] - i[:-1] - n[:-1], j[1:] - j[:-1] - n[:-1])) * (similarity / (1 - similarity) - 1e-9)
    after = np.cumsum(n - gaps)
    before = after - n
    out, todo = [], [(0, len(blocks))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        # the last block that a stretch from each block on can reach: the greatest of the sums from there to the end only falls
        falling = np.maximum.accumulate(after[lo:hi][::-1])
        last = hi - 1 - np.searchsorted(falling, before[lo:hi] - 1e-6)
        size = np.minimum((i + n)[last] - i[lo:hi], (j + n)[last] - j[lo:hi])
        s = int(size.argmax())
        if size[s] < least:
            continue
        s, e = lo + s, int(last[s])
        out.append((int(i[s]), int(i[e] + n[e]), int(j[s]), int(j[e] + n[e]), int(n[s : e + 1].sum())))
        todo += [(lo, s), (e + 1, hi)]
    return out


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places, seeds, sizes = [], [], []
        for _, words in word_hashes(b.column(1)):
            p, s = sampled(words)
            places.append(p)
            seeds.append(s)
            sizes.append(len(p))
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind), pa.from_numpy_dtype(kind))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), join(places, np.int32)), pa.ListArray.from_arrays(pa.array(ends), join(seeds, np.int64))], ["tid", "places", "seeds"])


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a text's shared seeds at most REACH words apart whose heads don't hold both so: (key, tid, place, second place).

    Head and other place are the same for all holders of a seed, so a pair is left out in all texts or in none; where it is
    left out, its seeds link all of them to the same head. Where a seed occurs again between the two, the nearer pair stands for
    both, so a text of repeated lines has few pairs a place; it holds the same keys.
    """

    def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["key", "tid", "place", "place2"])

    for b in batches:
        parts, held = [], 0
        for tid, shared in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            place, seed, head, other = (shared.values.field(c).to_numpy() for c in range(4))
            hashes = seed.view(np.uint64)
            order = np.argsort(seed, kind="stable")
            again = seed[order[1:]] == seed[order[:-1]]
            following, before = np.full(len(seed), len(seed)), np.full(len(seed), -1)
            following[order[:-1][again]], before[order[1:][again]] = order[1:][again], order[:-1][again]
            at = np.arange(len(seed))
            for step in range(1, len(place)):
                near = place[step:] - place[:-step] <= REACH
                if not near.any():
                    break
                apart = other[step:].astype(np.int64) - other[:-step]
                nearest = (following[:-step] >= at[step:]) & (before[step:] <= at[:-step])
                first = np.flatnonzero(near & nearest & ((head[step:] != head[:-step]) | (apart <= 0) | (apart > REACH)))
                keys = mix(mix(hashes[first]) + hashes[first + step]).view(np.int64)
                parts.append([keys, np.full(len(first), tid, np.int64), place[first], place[first + step]])
                held += len(first)
            if held > 100_000:
                yield out(parts)
                parts, held = [], 0
        if held:
            yield out(parts)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains that may belong to a long enough passage: (tid, head, own, other)."""
    for b in batches:
        rows = []
        for tid, head, matches in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            m = matches.values
            own, other = m.field(0).to_numpy(), m.field(1).to_numpy()
            for idx in chains(own, other):
                if len(idx) > 1 and own[idx[-1]] - own[idx[0]] + K >= LEAST_SPAN:
                    rows.append((tid, head, own[idx].tolist(), other[idx].tolist()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["tid", "head", "own", "other"])


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the first text around a chain."""
    for b in batches:
        parts, firsts = [], []
        own = b.column(2)
        for row, words in word_hashes(b.column(4)):
            places = own[row].values
            first = max(0, places[0].as_py() - MARGIN)
            parts.append(words[first : places[-1].as_py() + K + MARGIN].view(np.int64))
            firsts.append(first)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(parts, pa.list_(pa.int64())), pa.array(firsts, pa.int32())], ["tid", "head", "own", "other", "words", "first"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for row, words in word_hashes(b.column(6)):
            tid, head, first = (b.column(c)[row].as_py() for c in (0, 1, 5))
            own, other = b.column(2)[row].values.to_numpy(), b.column(3)[row].values.to_numpy()
            mine = b.column(4)[row].values.to_numpy().view(np.uint64)
            base = max(0, int(other[0]) - MARGIN)
            theirs = words[base : int(other[-1]) + K + MARGIN]
            blocks = align(mine, theirs, list(zip((own - first).tolist(), (other - base).tolist(), strict=True)))
            rows += [(tid, head, first + s, first + e, base + os, base + oe, n) for s, e, os, oe, n in similar_stretches(blocks)]
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["tid", "head", "start", "end", "other_start", "other_end", "equal"])


def _doc():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"))


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: tid, th (md5), low (null, doc_id), copies, n_words; repeats: tid, th, head, head_th, start, end, other_start, other_end, equal)."""
    keyed = docs.select(F.xxhash64("text").alias("tid"), F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    signed = materialize(keyed.select("tid", "text").mapInArrow(_seeds, "tid long, places array<int>, seeds array<long>").where(F.size("seeds") > 0), "passage-seeds")
    seeds = signed.select("tid", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(F.col("s.seeds").alias("seed"), "tid", F.col("s.places").alias("place"))
    heads = seeds.groupBy("seed").agg(F.min(F.struct("tid", "place")).alias("h"), F.max("tid").alias("last")).where("h.tid <> last").select("seed", F.col("h.tid").alias("head"), F.col("h.place").alias("other"))
    heads = materialize(heads, "passage-heads")  # so that the join's sides are plain shuffles, and those of a very common seed can be split
    shared = materialize(seeds.join(heads, "seed").select("tid", "place", "seed", "head", "other"), "passage-shared")
    halves = shared.where(F.pmod(F.xxhash64("seed"), F.lit(PAIRED)) == 0)
    by_text = halves.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("place", "seed", "head", "other"))).alias("s")).where(F.size("s") >= 2)
    crossings = materialize(by_text.mapInArrow(_crossings, "key long, tid long, place int, place2 int"), "passage-crossings")
    tops = crossings.groupBy("key").agg(F.min(F.struct("tid", "place", "place2")).alias("h"), F.max("tid").alias("last")).where("h.tid <> last")
    tops = materialize(tops.select("key", F.col("h.tid").alias("head"), F.col("h.place").alias("other"), F.col("h.place2").alias("other2")), "passage-tops")
    crossed = crossings.join(tops, "key").where("tid <> head")
    matches = shared.select("tid", "head", "place", "other").where("tid <> head").union(crossed.select("tid", "head", "place", "other")).union(crossed.select("tid", "head", "place2", "other2")).distinct()
    grouped = matches.groupBy("tid", "head").agg(F.collect_list(F.struct("place", "other")).alias("m")).where(F.size("m") >= 2)
    chained = materialize(grouped.mapInArrow(_chain, "tid long, head long, own array<int>, other array<int>"), "passage-chains")
    # one text of each hash that a chain needs, reduced before the shuffle
    needed = chained.select("tid").union(chained.select(F.col("head").alias("tid"))).distinct()
    texts = keyed.select("tid", "text").join(bounded_broadcast(materialize(needed, "passage-needed"), 200_000), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    texts = materialize(texts.withColumn("th", F.md5("text")), "passage-texts")
    cut = chained.join(texts.drop("th"), "tid").select("tid", "head", "own", "other", "text").mapInArrow(_stretch, "tid long, head long, own array<int>, other array<int>, words array<long>, first int")
    both = cut.join(texts.drop("th").withColumnRenamed("tid", "head"), "head").select("tid", "head", "own", "other", "words", "first", "text")
    repeats = materialize(both.mapInArrow(_align, "tid long, head long, start long, end long, other_start long, other_end long, equal long"), "passage-aligned")
    named = texts.drop("text")
    repeats = repeats.join(named, "tid").join(named.select(F.col("tid").alias("head"), F.col("th").alias("head_th")), "head")
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    names = keyed.select("tid", F.md5("text").alias("th"), _doc().alias("doc"), n_words.alias("n_words")).groupBy("tid", "th").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("n_words").alias("n_words"))
    return materialize(names, "passage-names"), materialize(repeats, "passage-repeats")


def _several(names: DataFrame) -> DataFrame:
    """Texts of MIN_WORDS words or more that more than one document has."""
    return names.where((F.col("low") != F.col("high")) & (F.col("n_words") >= MIN_WORDS))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, match_doc_id, start, end, match_start, match_end (word numbers, end exclusive), n_words, equal_words: one row per repeat.

    A copy of a whole text is a row with its first document; a text's passages are given with its first document.
    """
    names, repeats = _found(docs)
    first = names.select("tid", "th", F.col("low.id").alias("doc_id"))
    df = repeats.join(first, ["tid", "th"]).join(first.select(F.col("tid").alias("head"), F.col("th").alias("head_th"), F.col("doc_id").alias("match_doc_id")), ["head", "head_th"])
    parts = df.select("doc_id", "match_doc_id", "start", "end", F.col("other_start").alias("match_start"), F.col("other_end").alias("match_end"), (F.col("end") - F.col("start")).alias("n_words"), F.col("equal").alias("equal_words"))
    several = _several(names).select("tid", "th", F.col("low.id").alias("match_doc_id"), "n_words")
    copies = docs.select(F.xxhash64("text").alias("tid"), F.md5("text").alias("th"), F.col("doc_id").cast("long").alias("doc_id")).distinct().join(several, ["tid", "th"]).where(~F.col("doc_id").eqNullSafe(F.col("match_doc_id")))
    zero = F.lit(0).cast("long")
    copies = copies.select("doc_id", "match_doc_id", zero.alias("start"), F.col("n_words").alias("end"), zero.alias("match_start"), F.col("n_words").alias("match_end"), "n_words", F.col("n_words").alias("equal_words"))
    return parts.unionByName(copies)


_WORD = re.compile(WORD)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans (start, end in words); what stands between kept words stays as it is."""
    ends = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s, e in sorted(spans):
        s, e = ends[s][0], ends[min(e, len(ends)) - 1][1]
        if s > at:
            out.append(text[at:s])
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without their repeats of other texts' passages, which stay in the head; texts left without a word are dropped."""
    names, repeats = _found(docs)
    spans = repeats.groupBy("tid", "th").agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    several = _several(names).select("tid", "th", F.col("low").alias("__low"))
    todo = bounded_broadcast(materialize(spans.join(several, ["tid", "th"], "full"), "passage-todo"), 20_000)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    joined = docs.select(row.alias("__row"), F.xxhash64("text").alias("tid"), F.md5("text").alias("th"), _doc().alias("__own")).join(todo, ["tid", "th"], "left")
    joined = joined.where(F.col("__low").isNull() | (F.col("__low") == F.col("__own")))
    kept = joined.where("__spans is null").select("__row.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts = [without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(b.column(names.index("text")).to_pylist(), b.column(names.index("__spans")).to_pylist(), strict=True)]
            cols = {c: b.column(i) for i, c in enumerate(names[:-1])} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names[:-1])

    changed = joined.where("__spans is not null").select("__row.*", "__spans").mapInArrow(cut, docs.schema)
    return kept.union(changed.where(F.col("text").rlike(WORD)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
