"""Reachability and shortest paths by frontier rounds: a round joins the edges to the newest level only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.operators.graph import Graph, subgraph
from kgweave.runtime import Scratch, join_unique


def _links(graph: Graph, direction: str) -> DataFrame:
    out = graph.edges.select("source", "target")
    if direction == "out":
        return out.distinct()
    back = out.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return (back if direction == "in" else out.unionByName(back)).distinct()


def reach(graph: Graph, seeds: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """id, level, parent: every id reachable from ``seeds.id`` with its distance; parent is the least of the level before.

    Without ``max_depth`` rounds go on until nothing new is found. Seeds have level 0 and no parent, with a node or not.
    """
    spark = seeds.sparkSession
    scratch = Scratch(spark)
    links = scratch.save(_links(graph, direction))
    heavy = graph.hubs
    level = scratch.save(seeds.where(F.col("id").isNotNull()).select("id").distinct().select("id", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")))
    seen, k = level, 0
    while max_depth is None or k < max_depth:
        k += 1
        front = level.select(F.col("id").alias("source"), F.lit(True).alias("at"))
        next_rows = join_unique(links, front, "source", "inner", heavy).groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        level, n = scratch.save_counted(next_rows.join(seen.select("id"), "id", "left_anti").select("id", F.lit(k).alias("level"), "parent"))
        if not n:
            break
        seen = seen.unionByName(level)
    return seen


bfs = reach


def dfs(graph: Graph, seeds: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """The set that a depth-first search visits is that of ``reach``."""
    return reach(graph, seeds, max_depth, direction)


def shortest_path(graph: Graph, source: str, target: str, direction: str = "out") -> list[str] | None:
    """Ids of a shortest path, of equal ones the one of least parents; None without a path. The walk back reads one row a step."""
    spark = graph.edges.sparkSession
    scratch = Scratch(spark)
    if source == target:
        return [source]
    links = scratch.save(_links(graph, direction))
    heavy = graph.hubs
    levels = [scratch.save(spark.createDataFrame([(source, None)], "id string, parent string"))]
    seen = levels[0]
    while True:
        front = levels[-1].select(F.col("id").alias("source"), F.lit(True).alias("at"))
        rows = join_unique(links, front, "source", "inner", heavy).groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        level, n = scratch.save_counted(rows.join(seen.select("id"), "id", "left_anti").select("id", "parent"))
        if not n:
            return None
        levels.append(level)
        seen = seen.unionByName(level)
        if level.where(F.col("id") == target).limit(1).count():
            break
    path, at = [target], target
    for level in reversed(levels[1:]):
        at = level.where(F.col("id") == at).first()["parent"]
        path.append(at)
    return path[::-1]


def query_graph(graph: Graph, seeds: DataFrame, max_depth: int | None = None, direction: str = "out") -> Graph:
    """What is reachable from the seeds: nodes, and the edges among the reached ids."""
    return subgraph(graph, reach(graph, seeds, max_depth, direction))
