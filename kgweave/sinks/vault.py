"""The vault's notes of communities and its canvas, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.operators.graph import Graph, cohesion


def community_notes(graph: Graph, communities: DataFrame) -> DataFrame:
    """community_id, file, part, pos, line: a community's note line by line, so that no note is one huge value.

    Part 0 is the head, part 1 one line a member in listed order; ``write_notes`` puts the lines together.
    """
    sizes = communities.groupBy("community_id").agg(F.count(F.lit(1)).alias("members"))
    head = sizes.join(cohesion(graph, communities), "community_id", "left")
    number = F.col("community_id").cast("string")
    file = F.concat(F.lit("communities/_COMMUNITY_"), number, F.lit(".md")).alias("file")
    text = F.concat(F.lit("# Community "), number, F.lit("\n\n- Members: "), F.col("members").cast("string"), F.lit("\n- Cohesion: "), F.format_string("%.3f", F.coalesce("score", F.lit(0.0))), F.lit("\n\n## Members\n"))
    first = head.select("community_id", file, F.lit(0).alias("part"), F.lit(0).alias("pos"), text.alias("line"))
    named = communities.join(graph.nodes.select(F.col("id").alias("node_id"), "label"), "node_id", "left")
    rest = named.select("community_id", file, F.lit(1).alias("part"), "pos", F.concat(F.lit("- [["), F.coalesce("label", F.lit("unknown")), F.lit("]]")).alias("line"))
    return first.unionByName(rest)


def canvas(graph: Graph, communities: DataFrame) -> DataFrame:
    """part, key, text: the canvas' entries for members (number a thousandfold the community plus the place) and edges."""
    number = (F.col("community_id").cast("bigint") * 1000 + F.col("pos")).cast("string")
    nodes = communities.select(F.lit("node").alias("part"), F.concat(number, F.lit(":"), F.col("node_id")).alias("key"), F.concat(F.lit("  - id: "), number, F.lit("\n    node: "), "node_id", F.lit("\n    community: "), F.col("community_id").cast("string")).alias("text"))
    edges = graph.edges.select(F.lit("edge").alias("part"), F.concat("source", F.lit("->"), "target").alias("key"), F.concat(F.lit("  - from: "), "source", F.lit("\n    to: "), "target").alias("text"))
    return nodes.unionByName(edges)


def write_notes(notes: DataFrame, path: str) -> None:
    """One folder a note file, its lines in order; a community of any size is written in sorted ranges of lines."""
    rows = notes.repartitionByRange("file", "part", "pos").sortWithinPartitions("file", "part", "pos")
    rows.select("line", "file").write.mode("overwrite").partitionBy("file").text(path)
