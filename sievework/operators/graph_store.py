"""A stored graph: each edge lies at both its ends, in folders by hash of the node, so that a hop reads its frontier's folders alone.

``neighbors`` reads a hop's edges and cuts them as ``graph.neighbors`` does. ``paths`` reads the edges it can need, hop by hop, and then runs ``graph.paths`` on those. An edge of a
path of up to n edges lies within n/2 hops of one of its ends, so paths are read from both ends to the middle. The edges read
are written to the shared folder once a hop. Versions are those of ``sources.versions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import scratch
from ..sources.versions import Snapshot, Versions
from . import graph

#: Ends of edges that a folder is made for, and the most folders.
FOLDER_ENDS = 1_000_000
MOST_FOLDERS = 4_096
EDGE = ["relation_id", "source_id", "target_id", "relation_type"]
OUT, IN = 0, 1


def _folder(node, folders: int):
    return F.pmod(F.xxhash64(node), F.lit(folders)).cast("int")


def append(spark: SparkSession, path: str, edges: DataFrame) -> int:
    """Adds edges (relation_id, source_id, target_id, relation_type); the version. The first call sets the number of folders by size."""
    log = Versions(spark, path)
    base = log.snapshot()
    folders = base.facts.get("folders") or min(MOST_FOLDERS, max(8, 2 * edges.count() // FOLDER_ENDS))
    side = lambda end, d: F.struct(F.col(end).alias("node"), F.lit(d).alias("side"))
    both = edges.select(F.explode(F.array(side("source_id", OUT), side("target_id", IN))).alias("e"), *EDGE).select("e.*", *EDGE).withColumn("folder", _folder("node", folders))
    # a hub's edges are split over files of the advisory size
    dealt = both.hint("rebalance", "folder").sortWithinPartitions("folder", "node", "side", "relation_id")
    return log.commit({"edges": dealt}, base, facts={"folders": folders}, partition_by={"edges": "folder"}).version


def remove(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Takes edges (relation_id) out; the version."""
    log = Versions(spark, path)
    base = log.snapshot()
    return log.commit({"gone": ids.select("relation_id").distinct().withColumn("seq", F.lit(base.version + 1).cast("long"))}, base).version


def edges_at(log: Versions, at: Snapshot, nodes: DataFrame, side: int | None = None) -> DataFrame:
    """Stored ends of edges at some nodes (node), of one side or both, from those nodes' folders."""
    wanted = [r[0] for r in nodes.select(_folder("node", at.facts["folders"])).distinct().collect()]  # one number a folder at most
    rows = log.read("edges", at).where(F.col("folder").isin(wanted))
    if side is not None:
        rows = rows.where(F.col("side") == side)
    if at.parts.get("gone"):
        gone = log.read("gone", at).groupBy(F.col("relation_id").alias("__r")).agg(F.max("seq").alias("__s"))
        rows = rows.join(gone, (F.col("relation_id") == F.col("__r")) & (F.col("seq") < F.col("__s")), "left_anti")
    return rows.join(nodes.select("node").distinct(), "node", "left_semi")


def reach(spark: SparkSession, path: str, seeds: DataFrame, hops: int, side: int | None = None, version: int | None = None) -> DataFrame:
    """The edges (EDGE) met within so many hops of the seeds (node): outwards, inwards or both ways."""
    log = Versions(spark, path)
    at = log.snapshot(version)
    out, seen, frontier = None, None, seeds.select("node").where("node is not null").distinct()
    for _ in range(hops):
        where = scratch.folder(spark, "graph-hop")
        found = edges_at(log, at, frontier, side)
        found.select(*EDGE, F.when(F.col("side") == OUT, F.col("target_id")).otherwise(F.col("source_id")).alias("other")).write.parquet(where)
        met = spark.read.parquet(where)
        out = met.select(*EDGE) if out is None else out.unionByName(met.select(*EDGE))
        seen = frontier if seen is None else seen.unionByName(frontier)
        frontier = met.select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
    return out.dropDuplicates(EDGE)


def neighbors(spark: SparkSession, path: str, seeds: DataFrame, hops: int = 2, limit: int = 20, version: int | None = None) -> DataFrame:
    """``graph.neighbors`` of the seeds (seed) over a stored graph; of a hop's nodes the edges that a list can need go on."""
    log = Versions(spark, path)
    at = log.snapshot(version)
    other = F.when(F.col("side") == OUT, F.col("target_id")).otherwise(F.col("source_id"))

    def sides(nodes: DataFrame) -> DataFrame:
        rows = edges_at(log, at, nodes).select(F.col("node").alias("at"), other.alias("to"), F.col("side").alias("d"), "relation_id", "relation_type")
        return graph.cut_sides(rows.repartition("at", "d", "to").distinct().drop("relation_type"), limit)  # an edge may be stored twice

    return graph.traversed(sides, seeds.where("seed is not null"), hops, limit)


def paths(spark: SparkSession, path: str, pairs: DataFrame, longest: int = 3, version: int | None = None) -> DataFrame:
    """``graph.paths`` of the pairs (source, target) over a stored graph."""
    ahead = reach(spark, path, pairs.select(F.col("source").alias("node")), -(-longest // 2), OUT, version)
    behind = reach(spark, path, pairs.select(F.col("target").alias("node")), longest // 2, IN, version) if longest > 1 else ahead
    return graph.paths(ahead.unionByName(behind).dropDuplicates(EDGE), pairs, longest)
