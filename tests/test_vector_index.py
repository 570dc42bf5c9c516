"""The stored vector index against exact search; recall of probing; vectors that can't be compared."""

import re

import numpy as np
import pytest

from sievework.operators import vector, vector_index
from sievework.sources.versions import Versions

KIND = "chunk_id long, embedding array<double>"


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], KIND)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((25, 16))
    x = np.repeat(centres, 60, axis=0) + 0.25 * rng.standard_normal((1500, 16))
    x[100:160] = x[100]  # copies: more ties than k
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('v')}/i"
    vector_index.append(spark, path, frame(spark, points[:1000]), cells=20)
    vector_index.append(spark, path, frame(spark, points[1000:], 1000))
    return path


def test_exact_mode_equals_exact_search(spark, points, index, monkeypatch):
    queries = frame(spark, points[::30]).withColumnRenamed("chunk_id", "query_id")
    want = ranked(vector.top_k_batch(queries, frame(spark, points), 10))
    assert ranked(vector_index.search(spark, index, queries, 10, probes=1, exact=True)) == want
    monkeypatch.setattr(vector_index, "SENT_QUERIES", 20)
    assert ranked(vector_index.search(spark, index, queries, 10, probes=3, exact=True)) == want


@pytest.mark.parametrize("exact", [False, True])
def test_blocks_are_ranked_together(spark, points, index, monkeypatch, exact):
    monkeypatch.setattr(vector_index, "SENT_QUERIES", 10)
    queries = frame(spark, points[::30]).withColumnRenamed("chunk_id", "query_id")
    plan = vector_index.search(spark, index, queries, 10, exact=exact)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") > 3 and len(re.findall(r"\bWindow \[", plan)) == 1


def test_recall_of_probing(spark, points, index):
    queries = frame(spark, points[::10]).withColumnRenamed("chunk_id", "query_id")
    want = {(q, c) for q, _, c, _ in ranked(vector.top_k_batch(queries, frame(spark, points), 10))}
    got = {(q, c) for q, _, c, _ in ranked(vector_index.search(spark, index, queries, 10, probes=6))}
    assert len(want & got) / len(want) >= 0.95


def test_search_reads_cells_alone(spark, index):
    log = Versions(spark, index)
    rows = vector_index.cell_rows(log, log.snapshot(), [3, 4])
    assert {r.cell for r in rows.select("cell").distinct().collect()} <= {3, 4}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_removal_and_versions(spark, points, index):
    queries = frame(spark, points[:3]).withColumnRenamed("chunk_id", "query_id")
    before = Versions(spark, index).snapshot().version
    old = ranked(vector_index.search(spark, index, queries, 5, exact=True))
    vector_index.remove(spark, index, spark.range(0, 1500, 2).withColumnRenamed("id", "chunk_id"))
    left = frame(spark, points).where("chunk_id % 2 = 1")
    assert ranked(vector_index.search(spark, index, queries, 5, exact=True)) == ranked(vector.top_k_batch(queries, left, 5))
    assert ranked(vector_index.search(spark, index, queries, 5, exact=True, version=before)) == old


def test_blocks_after_removal_are_ranked_together(spark, points, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SENT_QUERIES", 2)
    path = f"file://{tmp_path}/r"
    vector_index.append(spark, path, frame(spark, points[:120]), cells=4)
    vector_index.remove(spark, path, spark.range(1, 120, 3).withColumnRenamed("id", "chunk_id"))
    queries = frame(spark, points[:120:20]).withColumnRenamed("chunk_id", "query_id")
    found = vector_index.search(spark, path, queries, 5, exact=True)
    assert len(re.findall(r"\bWindow \[", found._jdf.queryExecution().executedPlan().toString())) == 1
    assert ranked(found) == ranked(vector.top_k_batch(queries, frame(spark, points[:120]).where("chunk_id % 3 <> 1"), 5))


BAD = [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 0.0]), (54, [float("nan"), 0.0, 0.0]), (55, [float("inf"), 0.0, 0.0])]


@pytest.mark.parametrize("sent", [4096, 0])
def test_vectors_that_cannot_be_compared(spark, sent, tmp_path):
    good = [(i, [float(i), 1.0, 0.0]) for i in range(9)]
    v = spark.createDataFrame(good + BAD, KIND)
    q = v.withColumnRenamed("chunk_id", "query_id")
    want = ranked(vector.top_k_batch(spark.createDataFrame(good, KIND).withColumnRenamed("chunk_id", "query_id"), spark.createDataFrame(good, KIND), 4))
    assert len(want) == 36 and ranked(vector.top_k_batch(q, v, 4, sent=sent)) == want
    assert vector.top_k_batch(q.where("query_id = 50"), v, 4, sent=sent).count() == 0
    path = f"file://{tmp_path}/b"
    vector_index.append(spark, path, v, cells=3)
    assert ranked(vector_index.search(spark, path, q, 4, exact=True)) == want


def test_many_queries_a_batch(spark, monkeypatch):
    monkeypatch.setattr(vector, "COMPARED", 7)
    x = np.random.default_rng(9).standard_normal((60, 5))
    v = frame(spark, x)
    got = ranked(vector.top_k_batch(v.withColumnRenamed("chunk_id", "query_id"), v, 3))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert [c for q, r, c, _ in got if r == 1] == list(range(60)) and [c for q, r, c, _ in got if r == 2] == np.argsort(d, axis=1)[:, 1].tolist()


def test_empty_index(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert vector_index.search(spark, path, q).count() == 0
    vector_index.append(spark, path, spark.createDataFrame(BAD[:2], KIND))
    assert vector_index.search(spark, path, q).count() == 0
