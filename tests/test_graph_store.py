"""Traversals over a stored graph against those over all its edges."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import graph, graph_store
from sievework.sources.versions import Versions


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(6)
    rows = [(f"r{i:03d}", f"n{rng.randrange(40)}", "hub" if rng.random() < 0.1 else f"n{rng.randrange(40)}", "x") for i in range(130)] + [("loop", "n1", "n1", "x")]
    return spark.createDataFrame(rows, "relation_id string, source_id string, target_id string, relation_type string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_neighbors_and_versions(spark, edges, tmp_path):
    path = f"file://{tmp_path}/g"
    graph_store.append(spark, path, edges.where("relation_id < 'r050' AND relation_id <> 'loop'"))
    first = graph_store.append(spark, path, edges.where("relation_id >= 'r050'"))
    graph_store.append(spark, path, edges.where("relation_id = 'loop'"))
    seeds = spark.createDataFrame([("n1",), ("hub",), ("nowhere",), (None,)], "seed string")
    assert rows(graph_store.neighbors(spark, path, seeds, 2, 9)) == rows(graph.neighbors(edges, seeds, 2, 9))
    graph_store.remove(spark, path, edges.where("relation_id LIKE '%3'"))
    left = edges.where("relation_id NOT LIKE '%3'")
    assert rows(graph_store.neighbors(spark, path, seeds, 2, 9)) == rows(graph.neighbors(left, seeds, 2, 9))
    assert rows(graph_store.reach(spark, path, seeds.withColumnRenamed("seed", "node"), 1, version=first)) == rows(edges.where("relation_id <> 'loop'").where(F.col("source_id").isin("n1", "hub") | F.col("target_id").isin("n1", "hub")))


@pytest.mark.parametrize("longest", [1, 2, 5])
def test_paths_meet_in_the_middle(spark, tmp_path, longest):
    rng = random.Random(8)
    few = spark.createDataFrame([(f"r{i:03d}", f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", "x") for i in range(55)] + [(f"c{i}", a, b, "x") for i, (a, b) in enumerate(zip(["n0", *"pqrs"], [*"pqrs", "n10"]))], "relation_id string, source_id string, target_id string, relation_type string")
    path = f"file://{tmp_path}/p"
    graph_store.append(spark, path, few)
    pairs = spark.createDataFrame([(f"n{a}", f"n{b}") for a in range(6) for b in range(10, 14)], "source string, target string")
    want = rows(graph.paths(few, pairs, longest))
    assert rows(graph_store.paths(spark, path, pairs, longest)) == want
    assert longest < 5 or max(r[3] for r in want) == 5


def test_a_seed_reads_its_folder(spark, edges, tmp_path):
    path = f"file://{tmp_path}/f"
    graph_store.append(spark, path, edges)
    log = Versions(spark, path)
    plan = graph_store.edges_at(log, log.snapshot(), spark.createDataFrame([("n1",)], "node string"))._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: [")[1].split("]")[0]
