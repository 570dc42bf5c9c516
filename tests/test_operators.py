"""Hand-computed cases and properties of order-dependent operators."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.operators import catalog, context, fusion, graph, keyword, layout, outline, quality
from sievework.sources import stores


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_top_k_batch_ties(spark):
    from sievework.operators import vector

    rows = [(i, [0.6, 0.8]) for i in range(300, 0, -1)] + [(1000 + i, [1.0, i / 50]) for i in range(50)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [0.6, 0.8]), (8, [0.6, 0.7])], "query_id long, embedding array<double>")
    got = vector.top_k_batch(q, v, 20).collect()
    assert {k: [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == k] for k in (7, 8)} == dict.fromkeys((7, 8), list(range(1, 21)))


def test_top_k_batch_both_ways(spark):
    """Sent queries and blocks of queries give the same rows, over all chunks and within keys, and equal brute force."""
    import numpy as np

    from sievework.operators import vector

    x = np.random.default_rng(3).standard_normal((90, 8))
    v = spark.createDataFrame([(i, f"k{i % 3}", r.tolist()) for i, r in enumerate(x)], "chunk_id long, kb_id string, embedding array<double>")
    q = v.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    for by in (None, "kb_id"):
        runs = [sorted((r.query_id, r["rank"], r.chunk_id) for r in vector.top_k_batch(q, v, 4, block=16, by=by, sent=n).collect()) for n in (4096, 0)]
        want = []
        for a in range(0, 90, 10):
            near = sorted((round(((x[a] - x[b]) ** 2).sum(), 9), b) for b in range(90) if not by or a % 3 == b % 3)
            want += [(a, k, b) for k, (_, b) in enumerate(near[:4], 1)]
        assert runs[0] == runs[1] == sorted(want)


def test_neighbors_of_hubs(spark):
    """Cut hubs and stopped seeds give what a walk over all edges gives."""
    import random

    rng = random.Random(2)
    edges = [(f"e{i:04d}", "H" if rng.random() < 0.4 else f"n{rng.randrange(30)}", "H" if rng.random() < 0.3 else f"n{rng.randrange(30)}") for i in range(400)] + [(f"z{i}", f"q{i % 3}", f"q{(i + 1) % 3}") for i in range(9)] + [("y", "q0", "H")]
    df = spark.createDataFrame(edges, "relation_id string, source_id string, target_id string")
    for limit in (3, 7):
        got = {}
        for r in graph.neighbors(df, spark.createDataFrame([("H",), ("q1",), ("n3",)], "seed string"), 2, limit).orderBy("seq").collect():
            got.setdefault(r.seed, []).append((r.neighbor, r.hop, r.direction, r.relation_id))
        for seed in ("H", "q1", "n3"):
            seen, frontier, out = {seed}, [seed], []
            for hop in (1, 2):
                found, rows_, order = {}, [], []
                for pos, node in enumerate(frontier):
                    for d, (a, b) in enumerate(((1, 2), (2, 1))):
                        for e in sorted(edges):
                            if e[a] == node and e[b] not in seen and found.setdefault(e[b], (pos, d)) == (pos, d):
                                rows_.append((pos, d, min(x[0] for x in edges if x[a] == node and x[b] == e[b]), e[0], e[b]))
                rows_.sort()
                out += [(to, hop, "out" if d == 0 else "in", rid) for _, d, _, rid, to in rows_]
                order = list(dict.fromkeys(r[4] for r in rows_))
                seen |= set(order)
                frontier = order
            assert got[seed] == out[:limit]


def test_containment(spark):
    parts, wholes = ["ab", "b", "bcd", "", "zz"], ["abcd", "b", "xab"]
    got = graph.contained(spark.createDataFrame([(x,) for x in parts], "part string"), spark.createDataFrame([(x,) for x in wholes], "whole string")).collect()
    assert sorted(map(tuple, got)) == sorted((p, w) for p in parts for w in wholes if p and p in w)


def test_rrf(spark):
    hits = lambda xs: spark.createDataFrame([(1, c, i) for i, c in enumerate(xs, 1)], "query_id int, chunk_id string, rank int")
    out = fusion.best(fusion.rrf({"vector": hits(["c1", "c2"]), "keyword": hits(["c2", "c3"]), "graph": hits(["c3"])}))
    got = {r.chunk_id: (r.rank, round(r.fused_score, 7)) for r in out.collect()}
    assert got == {"c2": (1, 0.0129825), "c1": (2, 0.0081967), "c3": (3, 0.0081174)}


def test_bm25(spark):
    chunks = spark.createDataFrame([("d1", "a b"), ("d2", "a c c"), ("d3", "d")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "c"), (2, "a"), (3, "a a d")], "query_id int, text string")
    got = {(r.query_id, r.chunk_id): round(r.score, 6) for r in keyword.search(asked, chunks).collect()}
    assert got == {(1, "d2"): 0.628708, (2, "d1"): 0.063853, (2, "d2"): 0.052125, (3, "d3"): 0.65913, (3, "d1"): 0.127706, (3, "d2"): 0.10425}


def merged(spark, flags, fold):
    df = spark.createDataFrame([(1, i, str(i), f == "1") for i, f in enumerate(flags)], "doc_id int, ord int, text string, s boolean")
    out = outline._pairs(df, F.col("s"), fold).groupBy("group").agg(F.sort_array(F.collect_list("ord")).alias("o")).orderBy("group")
    return [r.o for r in out.collect()]


def greedy(flags, fold):
    groups, i = [], 0
    while i < len(flags):
        if flags[i] == "1" and i + 1 < len(flags):
            groups.append([i, i + 1])
            i += 2
        else:
            if flags[i] == "1" and fold and groups:
                groups[-1].append(i)
            else:
                groups.append([i])
            i += 1
    return groups


def test_merge_groups(spark):
    for flags in ("11101", "01", "1", "11", "101", "000"):
        assert merged(spark, flags, True) == greedy(flags, True)
    for flags in ("110", "01", "111", "10"):
        assert merged(spark, flags, False) == greedy(flags, False)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=14), st.booleans())
def test_merge_groups_any(spark, flags, fold):
    flags = "".join("1" if f else "0" for f in flags)
    assert merged(spark, flags, fold) == greedy(flags, fold)


def test_outline(spark):
    text = ["intro", "第一章 概述", "body a", "1.1 背景", "body b", "第二章 实现", "1.2 细节", "body c"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text, 1)], "doc_id int, line_no int, text string")
    found = outline.paths(outline.levels(outline.titles(lines)))
    assert rows(found.orderBy("line_no"), "line_no", "rule", "level") == [(2, "CN_CHAPTER", 1), (4, "NUM_DECIMAL", 2), (6, "CN_CHAPTER", 1), (7, "NUM_DECIMAL", 2)]
    out = outline.chunks_by_title(lines, found, keep_preamble=False).orderBy("ord")
    assert rows(out, "text", "path") == [("第一章 概述\nbody a", "第一章 概述"), ("1.1 背景\nbody b", "第一章 概述 > 1.1 背景"), ("第二章 实现\n1.2 细节\nbody c", "第二章 实现 > 1.2 细节")]
    assert outline.chunks_by_title(lines, found).count() == 4


def test_toc(spark):
    text = ["目录", "第一章 概述 1", "第二章 实现 5", "第一章 概述", "body", "第二章 实现", "body"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text, 1)], "doc_id int, line_no int, text string")
    assert rows(outline.toc_start(lines), "doc_id", "toc_start") == [(1, 2)]


def test_neighbors_and_paths(spark):
    edges = spark.createDataFrame([("e1", "A", "B"), ("e2", "A", "B"), ("e3", "C", "A"), ("e4", "B", "D"), ("e5", "D", "A")], "relation_id string, source_id string, target_id string")
    seeds = spark.createDataFrame([("A",), ("X",)], "seed string")
    out = graph.neighbors(edges, seeds, 2, 50).orderBy("seq")
    assert rows(out, "neighbor", "direction", "hop", "relation_id") == [("B", "out", 1, "e1"), ("B", "out", 1, "e2"), ("C", "in", 1, "e3"), ("D", "in", 1, "e5")]
    assert graph.neighbors(edges, seeds, 2, 1).count() == 1
    pairs = spark.createDataFrame([("A", "D")], "source string, target string")
    assert rows(graph.paths(edges, pairs), "path") == [("A>B>D",), ("A>B>D",)]


def test_entities(spark):
    raw = spark.createDataFrame([(1, "x", "t", "c2", 5, 0), (1, "x", "t", "c1", 3, 1)], "doc_id int, text string, type string, chunk_id string, chunk_index int, pos int")
    assert rows(graph.dedup_entities(raw), "chunk_id", "chunk_index", "mentions") == [("c2", 3, 2)]
    rel = spark.createDataFrame([(1, "a", "b", "r", 1), (1, "a", "b", "r", 0), (1, "b", "a", "r", 2)], "doc_id int, source string, target string, relation_type string, pos int")
    assert sorted(rows(graph.dedup_relations(rel), "source", "relation_id")) == [("a", "1_R0"), ("b", "1_R1")]
    ents = spark.createDataFrame([(1, "a", "E0", 0), (1, "a", "E1", 1), (1, "b", "E2", 2)], "doc_id int, text string, entity_id string, pos int")
    assert rows(graph.link_entities(rel.where("pos = 2"), ents), "source_id", "target_id") == [("E2", "E1")]


def test_fallback(spark):
    asked = spark.createDataFrame([(1, "k1"), (2, "k1"), (3, "k1"), (4, None), (5, "k1")], "query_id int, kb_id string")
    hits = spark.createDataFrame([(1, 0.70), (2, 0.60), (3, 0.59), (4, 0.59)], "query_id int, rerank_score double")
    every = spark.createDataFrame([(i, 0.1) for i in range(1, 6)], "query_id int, rerank_score double")
    assert dict(rows(fusion.fallback(hits, every, asked), "query_id", "scope")) == {1: "kb", 2: "kb", 3: "global", 4: "kb", 5: "global"}


def test_rerank_padding(spark):
    df = spark.createDataFrame([(1, "a", "t0", 1, None), (1, "b", "t1", 2, None), (1, "c", "t2", 3, 0.9), (1, "d", "t2", 4, None)], "query_id int, chunk_id string, text string, rank int, rerank_score double")
    out = fusion.pad(df, 3).orderBy("new_rank")
    assert rows(out, "chunk_id") == [("c",), ("a",), ("b",)]
    assert rows(fusion.gate(out), "chunk_id") == [("c",)]


def test_quality(spark):
    m = spark.createDataFrame([(1, 60, 400.0, 15, 9000, 0), (2, 1200, 300.0, 1200, 9000, 0), (3, 500, 500.0, 0, 9000, 0), (4, 80, 400.0, 300, 9000, 0), (5, 100, 100.0, 300, 9000, 50)], "ord int, tokens long, median_tokens double, content_tokens long, doc_tokens long, param_tokens long")
    got = {r.ord: (r.total_risk, r["mode"], r.hard) for r in quality.rules(m).collect()}
    assert got == {1: (55, "merge", False), 2: (15, "split", False), 3: (60, "merge", True), 4: (10, "merge", False), 5: (25, "split", False)}


def test_context(spark):
    hits = spark.createDataFrame([(1, 1, "b", 2, "b2"), (1, 2, "a", 1, "a1"), (1, 3, "b", 1, "b1"), (2, 1, "x", 1, "y" * 3001)], "query_id int, rank int, doc_id string, ord int, text string")
    got = dict(rows(context.build(hits), "query_id", "context"))
    assert got[1] == "b1\n\nb2\n\na1" and got[2] == "y" * 3000 + context.CUT_OFF


def test_pages(spark):
    df = spark.range(21).withColumn("k", F.lit(1))
    assert catalog.page(df, ["id"], 3, 10).count() == 1
    assert rows(catalog.page_counts(df, "k", 10), "total", "total_pages") == [(21, 3)]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    path = f"file://{tmp_path}/s"
    stores.save(df, path)
    one = stores.load(spark, path, 7)
    assert rows(one, "doc_id", "text") == [(7, "t7")] and stores.load(spark, path).count() == 50
    stores.delete(spark, path, 7)
    assert stores.load(spark, path, 7).count() == 0 and stores.load(spark, path).count() == 49
    alone = f"{path}-one"
    stores.save(df.where("doc_id = 7"), alone)
    stores.save(df.where("doc_id in (7, 8)"), f"{path}-two", 1)
    stores.delete(spark, f"{path}-two", 7, 1)
    assert rows(stores.load(spark, f"{path}-two"), "doc_id") == [(8,)]
    errors = stores.reset({"a": (df, path), "b": (df, "nowhere://x/y"), "c": (df, alone)})
    assert (errors["a"], errors["c"]) == ("", "") and errors["b"]
    assert stores.load(spark, path).count() == 0 and stores.load(spark, alone).count() == 0


def test_text(spark):
    df = spark.createDataFrame([("第 3 页", "```json\n{\"a\": 1}\n```"), ("x", "no"), ("12", "t {\"b\": 2} u")], "p string, a string")
    assert rows(df.select(tx.page_number(F.col("p")).alias("n"), tx.json_block(F.col("a")).alias("j")), "n", "j") == [(3, '{"a": 1}\n'), (None, None), (12, '{"b": 2}')]


def test_layout(spark):
    words = spark.createDataFrame([(1, 1, 5.0, 10.0, "b"), (1, 1, 1.0, 12.0, "a"), (1, 1, 1.0, 30.0, "c")], "doc_id long, page long, x double, top double, text string")
    assert rows(layout.words_to_lines(words), "line_no", "text") == [(1, "a b"), (2, "c")]
    cells = spark.createDataFrame([(1, 0, 0, "n"), (1, 0, 1, "s"), (1, 0, 2, ""), (1, 1, 0, "n"), (1, 1, 1, "x"), (1, 1, 2, "y")], "table_id int, row int, col int, value string")
    assert sorted(rows(layout.flat_headers(cells, 2), "col", "header")) == [(0, "n"), (1, "s.x"), (2, "y")]




def test_prefixes_of_dotted_numbers(spark):
    """The deepest number that a separator ends counts, also where the last part runs into a word."""
    from sievework.functions import titles

    want = {"1.": "high", "1.1": "high", "1.1x": "high", "1.23 ": "high", "1.1 x": "medium", "1.1.": "medium", "1.2.3x": "medium", "1.2.3、": "low", "1.2.3.4 x": "low", "12": None, "12 x": "high", "x1.": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.p and r.p.level for r in df.select("t", titles.prefix_pattern(F.col("t")).alias("p")).collect()} == want
