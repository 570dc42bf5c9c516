"""Ranked lexical search against plain scoring of every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """docs (doc_id, text), items (item_id, text): a list of (doc_id, score) a query, best first."""
    words = [(i, split(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(split(text))
    out = {}
    for item, terms in asked.items():
        scored = []
        for doc_id, w in words:
            tf = Counter(w)
            m = 100 - 50 + (50 * len(w) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((doc_id, score))
        out[item] = sorted(scored, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return {i: x for i, x in out.items() if x}


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("item_id", "rank").collect():
        out[r.item_id].append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return dict(out)


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 5}, {"sent_terms": 3}])
@pytest.mark.parametrize("window", [2048, 16])
def test_against_plain_scoring(spark, monkeypatch, sizes, window):
    monkeypatch.setattr(L, "WINDOW", window)
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)] + ["Été", "日本", "A1", "a-b", "x_y", "ÄÖ"]
    docs = [(rng.choice([None, i, i, i, 7]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), "c") for i in range(400)]
    docs += [(900, None, "c"), (901, ""), (902, " -- "), docs[5], docs[5]]
    docs = [(d[0], d[1], "c") for d in docs]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(12)] + [(3, "A1 w1"), (None, "w1 w2"), (None, "w3"), (50, None), (51, ""), (52, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(5)
    want = plain([d[:2] for d in docs], items, 20)
    got = found(L.search(df, spark.createDataFrame(items, "item_id long, text string"), 20, **sizes))
    assert got == want and len(want) > 10


def test_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(100, 0, -1)] + [(None, "same words here"), (500, "other")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([("q", "same")], "item_id string, text string")
    assert [x[0] for x in found(L.search(docs, items, 50))["q"]] == list(range(1, 51))
    assert L.search(docs.limit(0), items).count() == 0 and L.search(docs, items.limit(0)).count() == 0
    assert L.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a b " * 400_000), (2, "a c"), (3, "c")], "doc_id long, text string")
    assert found(L.search(docs, spark.createDataFrame([(1, "A b C")], "item_id int, text string"))) == plain([(1, "a b " * 400_000), (2, "a c"), (3, "c")], [(1, "A b C")], 50)


def test_lengths_beyond_64_bits():
    lengths = np.array([6_000_000_000, 1], np.int64)
    s = L.Scorer({b"a": 0}, np.array([10, 0], np.int64), [[0]], 1 << 34, 1 << 40, 5)
    s.walk(np.array([4, 5]), np.array([False, False]), lengths, [b"a"], np.array([2]), np.array([0, 1], np.uint16), np.array([3, 1], np.int32))
    m = [50 + (50 * int(n) * (1 << 34)) // (1 << 40) for n in lengths]
    assert sorted(s.heaps[0]) == sorted((10 * ((10**9 * tf) // (1000 * tf + 20 * x)), True, -i) for i, tf, x in ((4, 3, m[0]), (5, 1, m[1])) if (10**9 * tf) // (1000 * tf + 20 * x))
