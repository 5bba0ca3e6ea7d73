"""The graph document: one JSON object of nodes, edges, communities and statistics."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.operators.graph import Graph
from kgweave.schema import EDGE, GRAPH_JSON, NODE, checked


def read_graph_json(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """(graph, communities) of a graph document; undirected. A missing file or a malformed document raises."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    doc = spark.read.schema(GRAPH_JSON).option("mode", "FAILFAST").json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("x")).select(*(F.col(f"x.{f.name}").alias(f.name) for f in NODE))
    edges = doc.select(F.explode("edges").alias("x")).select(*(F.col(f"x.{f.name}").alias(f.name) for f in EDGE))
    communities = doc.select(F.explode("communities").alias("k", "members")).select(F.col("k").cast("int").alias("community_id"), F.posexplode("members").alias("pos", "node_id")).select("community_id", "node_id", "pos")
    return Graph(nodes, checked(edges)), communities


def node_lines(graph: Graph) -> DataFrame:
    """value: each node as a JSON object, the section's streamed form."""
    return graph.nodes.select(F.to_json(F.struct(*[f.name for f in NODE if f.name in graph.nodes.columns])).alias("value"))


def edge_lines(graph: Graph) -> DataFrame:
    return graph.edges.select(F.to_json(F.struct(*[f.name for f in EDGE if f.name in graph.edges.columns])).alias("value"))


def write_graph_json(graph: Graph, communities: DataFrame, path: str, cohesion: DataFrame | None = None, gods: DataFrame | None = None, labels: DataFrame | None = None) -> None:
    """Write the document to a local file, streaming rows through the driver, never all at once."""
    import json

    def section(f, name, rows, first=False):
        f.write(("" if first else ",\n") + json.dumps(name) + ": [")
        for k, r in enumerate(rows.toLocalIterator()):
            f.write(("," if k else "") + "\n" + r[0])
        f.write("]")

    tmp = Path(path + ".tmp")
    with tmp.open("w") as f:
        f.write("{")
        section(f, "nodes", node_lines(graph), True)
        section(f, "edges", edge_lines(graph))
        f.write(',\n"communities": {')
        last = None
        for r in communities.orderBy("community_id", "pos").select("community_id", "node_id").toLocalIterator():
            f.write(("," if last == r[0] else ("" if last is None else "],") + json.dumps(str(r[0])) + ": [") + json.dumps(r[1]))
            last = r[0]
        f.write("]}" if last is not None else "}")
        for name, df, pair in (("cohesion", cohesion, ("community_id", "score")), ("community_labels", labels, ("community_id", "label"))):
            if df is not None:
                f.write(f",\n{json.dumps(name)}: " + json.dumps({str(r[0]): r[1] for r in df.select(*pair).toLocalIterator()}))
        if gods is not None:
            f.write(',\n"god_nodes": ' + json.dumps([r.asDict() for r in gods.collect()]))
        f.write("}\n")
    tmp.replace(path)


def write_tables(graph: Graph, communities: DataFrame, path: str) -> None:
    """The primary stored form: one Parquet table a part."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes.parquet")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges.parquet")
    communities.write.mode("overwrite").parquet(f"{path}/communities.parquet")


def read_tables(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    return Graph(spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet")), spark.read.parquet(f"{path}/communities.parquet")
