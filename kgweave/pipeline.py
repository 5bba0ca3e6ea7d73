"""The batch pipeline: files to graph, communities, inferred edges, communities again, analysis, stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions import text as X
from kgweave.operators.community import detect_communities
from kgweave.operators.graph import Graph, build_graph, merge_extractions
from kgweave.operators.infer import infer_edges
from kgweave.runtime import Scratch
from kgweave.sources import code, detect, extract


@dataclass
class Result:
    graph: Graph
    communities: DataFrame


def extract_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of code and documents among ``files`` (path, content); what cannot be read becomes a stub node."""
    routed = detect.route(files.select("path", "content").where(~detect.in_ignored_dir()))
    docs, hs = routed.where("extractor = 'document'"), routed.where("extractor = 'lines'")
    py = routed.where(F.col("path").endswith(".py"))
    lined = routed.where(F.regexp_extract("path", r"\.([a-z]+)$", 1).isin(*code.LANGUAGES))
    rest = routed.where("extractor <> 'document'")
    p = F.col("path")
    defs = extract.python_definitions(py)
    py_nodes = defs.select(*extract._node(X.symbol_id(p, F.col("name")), F.col("label"), "code", p, F.col("line"), F.col("kind"), F.col("line_end"))).dropDuplicates(["id"])
    source = F.when(F.col("parent").isNotNull(), X.symbol_id(p, F.col("parent"))).otherwise(X.stub_id(p))
    py_edges = defs.select(*extract._edge(source, X.symbol_id(p, F.col("name")), "contains", "EXTRACTED", 1.0, p, F.col("line"))).dropDuplicates(["source", "target"])
    parts = [
        (extract.stub_nodes(rest), py_edges), (py_nodes, extract.haskell_edges(hs)), (extract.haskell_nodes(hs), extract.document_edges(docs)), (extract.document_nodes(docs), code.code_edges(lined)), (code.code_nodes(lined), py_edges.where(F.lit(False))),
    ]
    return merge_extractions(*parts)


def run(files: DataFrame, density: str = "normal", gamma: float = 1.0, cluster: bool = True) -> Result:
    """All stages; each stage's tables are written to the shared folder and read again."""
    scratch = Scratch(files.sparkSession)
    nodes, edges = extract_files(files)
    g = build_graph(nodes.withColumns({c: F.lit(None).cast("string") for c in ("source_url", "captured_at", "author", "contributor") if c not in nodes.columns}), edges)
    g = Graph(scratch.save(g.nodes), scratch.save(g.edges))
    if not cluster:
        return Result(g, g.nodes.sparkSession.createDataFrame([], "community_id int, node_id string, pos int"))
    first = scratch.save(detect_communities(g, gamma).withColumn("pos", F.lit(0)))
    more = infer_edges(g, first, density)
    known = g.edges.select(*extract.EDGE_COLUMNS)
    grown = Graph(g.nodes, scratch.save(known.unionByName(more.join(known.select("source", "target"), ["source", "target"], "left_anti").select(*extract.EDGE_COLUMNS))))
    return Result(grown, scratch.save(detect_communities(grown, gamma)))
