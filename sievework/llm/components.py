"""Distributed connected components by alternating large-star and small-star steps.

Edges stay in tables; each step is a grouped minimum and a join, so a node with very many edges is summed up before it is
shuffled and its rows can be split by skew handling. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node that links reach. Ids are longs; loops are ignored."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that the join's sides are plain shuffles and the rows of a node with very many edges can be split
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-low")
        hung = both.join(low, "u")
        if large:
            out = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = hung.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    # an edge runs from its larger to its smaller end
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    while before[0]:
        edges = materialize(star(star(edges, True), False), label)
        now = print_of(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
