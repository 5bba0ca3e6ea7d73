"""Graph construction, merge, diff and the statistics of nodes, edges and communities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.functions.text import basename
from kgweave.runtime import heavy_keys, join_unique, not_blank
from kgweave.schema import clean

NODE_ORDER = ("label", "file_type", "source_file", "source_location", "line_end", "kind", "signature", "source_url", "captured_at", "author", "contributor")
EDGE_ORDER = ("relation", "confidence", "confidence_score", "source_file", "source_location", "weight")


@dataclass(frozen=True)
class Graph:
    """One row a node id, one row an ordered pair; edges may end at ids without a node."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @cached_property
    def hubs(self) -> list:
        """Ids at a large share of the edges' ends, found once a graph: the heavy keys of every table derived from its edges."""
        return heavy_keys(self.edges.select(F.explode(F.array("source", "target")).alias("id")), "id")


def _pick(df: DataFrame, keys: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The row of each key with the greatest rank, by partial aggregation (no window over a hot key)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)])).alias("x"))
    return best.select(*keys, *(F.col("x")[c].alias(c) for c in rest))


def merge_nodes(nodes: DataFrame, seq: str = "extraction_seq") -> DataFrame:
    """One row an id: of several extractions the earliest wins, within one the greatest row (the last of a sorted run)."""
    rows = nodes.where(not_blank("id"))
    return _pick(rows, ["id"], [-F.col(seq), *(F.col(c) for c in NODE_ORDER if c in rows.columns)])


def build_edges(edges: DataFrame, seq: str = "extraction_seq") -> DataFrame:
    """One row an ordered pair: the latest extraction wins whatever its relation; relations in canonical form, blank ends left out."""
    rows = edges.where(not_blank("source") & not_blank("target")).withColumn("relation", clean("relation"))
    return _pick(rows, ["source", "target"], [F.col(seq), *(F.col(c) for c in EDGE_ORDER if c in rows.columns)])


def build_graph(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> Graph:
    return Graph(merge_nodes(nodes), build_edges(edges), directed)


def merge_extractions(*extractions: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Extractions in order become one: earlier ones win for nodes, edges are all kept (a bag)."""
    nodes = edges = None
    for k, (n, e) in enumerate(extractions):
        n, e = n.withColumn("extraction_seq", F.lit(k)), e.withColumn("extraction_seq", F.lit(k))
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
    return merge_nodes(nodes), edges


def merge_graphs(old: Graph, new: Graph) -> Graph:
    """Union by key; old rows win. Directed as the old graph."""
    nodes = old.nodes.unionByName(new.nodes.join(old.nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
    edges = old.edges.unionByName(new.edges.join(old.edges.select("source", "target"), ["source", "target"], "left_anti"), allowMissingColumns=True)
    return Graph(nodes, edges, old.directed)


def graph_diff(old: Graph, new: Graph) -> DataFrame:
    """part (new_node, removed_node, new_edge, removed_edge), source, target: keys only, changed attributes are no difference."""
    node = lambda a, b, part: a.nodes.select("id").join(b.nodes.select("id"), "id", "left_anti").select(F.lit(part).alias("part"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"))
    k = ["source", "target"]
    edge = lambda a, b, part: a.edges.select(*k).join(b.edges.select(*k), k, "left_anti").select(F.lit(part).alias("part"), *k)
    return node(new, old, "new_node").unionByName(node(old, new, "removed_node")).unionByName(edge(new, old, "new_edge")).unionByName(edge(old, new, "removed_edge"))


def diff_summary(diff: DataFrame) -> str:
    """'2 new nodes, 1 removed edge' in fixed order, or 'no changes'."""
    counts = {r[0]: r[1] for r in diff.groupBy("part").count().collect()}
    parts = [f"{counts[p]} {p.replace('_', ' ')}{'s' if counts[p] != 1 else ''}" for p in ("new_node", "new_edge", "removed_node", "removed_edge") if counts.get(p)]
    return ", ".join(parts) or "no changes"


def subgraph(graph: Graph, ids: DataFrame) -> Graph:
    """Nodes in ``ids.id`` and the edges with both ends there."""
    keep = ids.select("id").distinct()
    edges = graph.edges.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(graph.nodes.join(keep, "id", "left_semi"), edges, graph.directed)


def validate_extraction(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None) -> DataFrame:
    """rule, detail, n: duplicate_label, empty_node_id, empty_end, score_out_of_range, small_hyperedge."""
    out = [
        nodes.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_label").alias("rule"), F.col("label").alias("detail"), "n"),
        nodes.where(~not_blank("id")).groupBy(F.lit("empty_node_id").alias("rule"), F.coalesce("label", F.lit("")).alias("detail")).agg(F.count(F.lit(1)).alias("n")),
        edges.where(~(not_blank("source") & not_blank("target"))).groupBy(F.lit("empty_end").alias("rule"), F.concat(F.coalesce("source", F.lit("")), F.lit("->"), F.coalesce("target", F.lit(""))).alias("detail")).agg(F.count(F.lit(1)).alias("n")),
        edges.where("confidence_score < 0 or confidence_score > 1").groupBy(F.lit("score_out_of_range").alias("rule"), F.concat("source", F.lit("->"), "target").alias("detail")).agg(F.count(F.lit(1)).alias("n")),
    ]
    if hyperedges is not None:
        out.append(hyperedges.where(F.coalesce(F.size("nodes"), F.lit(0)) < 3).groupBy(F.lit("small_hyperedge").alias("rule"), F.col("id").alias("detail")).agg(F.count(F.lit(1)).alias("n")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def adjacency(graph: Graph) -> DataFrame:
    """node, neighbour: distinct pairs; both directions unless the graph is directed. Self-loops are neighbours."""
    pairs = graph.edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"))
    if graph.directed:
        return pairs.distinct()
    return pairs.unionByName(pairs.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))).distinct()


def degrees(graph: Graph) -> DataFrame:
    """id, degree: neighbours of every node and of every id without a node, 0 for isolated nodes."""
    found = adjacency(graph).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("id").join(found, "id", "full_outer").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_stats(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
    e = graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))
    both = n.select("n_nodes", F.lit(0).cast("bigint").alias("n_edges")).unionByName(e.select(F.lit(0).cast("bigint").alias("n_nodes"), "n_edges"))
    return both.agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges")).withColumn("average_degree", F.when(F.col("n_nodes") > 0, 2 * F.col("n_edges") / F.col("n_nodes")).otherwise(F.lit(0.0)))


def is_file_node(degree: str = "degree") -> Column:
    """A file or a method stub: '.name()', 'name()' of at most one neighbour, or the file's own name."""
    label = F.col("label")
    return F.coalesce((label.startswith(".") & label.endswith(")")) | (label.endswith(")") & (F.col(degree) <= 1)) | (label == basename("source_file")), F.lit(False))


def is_concept_node() -> Column:
    return F.coalesce((F.col("source_file") == "") | F.col("source_file").endswith("."), F.lit(True))


def described_nodes(graph: Graph) -> DataFrame:
    """The nodes with degree, is_file and is_concept."""
    d = graph.nodes.join(degrees(graph), "id", "left")
    return d.withColumn("is_file", is_file_node()).withColumn("is_concept", is_concept_node())


def god_nodes(graph: Graph, top: int = 10) -> DataFrame:
    """id, label, edges: most connected nodes, files and concepts aside; ties by id."""
    rows = described_nodes(graph).where("degree > 0 and not is_file and not is_concept")
    return rows.orderBy(F.col("degree").desc(), "id").limit(top).select("id", "label", F.col("degree").alias("edges"))


def neighbours(graph: Graph) -> DataFrame:
    """node, neighbour, label: neighbours that have a node."""
    adj = adjacency(graph)
    named = graph.nodes.select(F.col("id").alias("neighbour"), "label")
    return join_unique(adj, named, "neighbour", "inner", graph.hubs)


def assigned(communities: DataFrame) -> DataFrame:
    """node_id, community_id: the least community of a node listed in several."""
    return communities.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min("community_id").alias("community_id"))


def _ends(pairs: DataFrame, of: DataFrame, a: str, b: str, heavy: list, how: str = "inner") -> DataFrame:
    """Adds ca and cb, the communities of the columns a and b; ``heavy`` holds the graph's hubs."""
    out = join_unique(pairs, of.select(F.col("node_id").alias(a), F.col("community_id").alias("ca")), a, how, heavy)
    return join_unique(out, of.select(F.col("node_id").alias(b), F.col("community_id").alias("cb")), b, how, heavy)


def cohesion(graph: Graph, communities: DataFrame) -> DataFrame:
    """community_id, size, score: linked pairs inside over all pairs; 0 where there are fewer than two members."""
    of = assigned(communities)
    adj = adjacency(graph)
    pairs = adj.where("node < neighbour") if graph.directed else adj.select(F.least("node", "neighbour").alias("node"), F.greatest("node", "neighbour").alias("neighbour")).where("node < neighbour").distinct()
    inside = _ends(pairs, of, "node", "neighbour", graph.hubs).where("ca = cb").groupBy(F.col("ca").alias("community_id")).agg(F.count(F.lit(1)).alias("k"))
    sizes = of.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    most = F.greatest(F.lit(1).cast("bigint"), F.expr("size * (size - 1) div 2"))
    return sizes.join(inside, "community_id", "left").select("community_id", "size", (F.coalesce("k", F.lit(0)) / most).alias("score"))


def cohesion_to_community(graph: Graph, communities: DataFrame) -> DataFrame:
    """node_id, community_id, share: of each node's neighbours, those in each community that has any of them."""
    adj = adjacency(graph)
    n = adj.groupBy(F.col("node").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    near = join_unique(adj, assigned(communities).withColumnRenamed("node_id", "neighbour"), "neighbour", "inner", graph.hubs)
    return near.groupBy(F.col("node").alias("node_id"), "community_id").agg(F.count(F.lit(1)).alias("k")).join(n, "node_id").select("node_id", "community_id", (F.col("k") / F.col("n")).alias("share"))


def verbose_nodes(graph: Graph, communities: DataFrame, bridges: DataFrame) -> DataFrame:
    """id, label, kind, signature, lines, community_id, degree, is_bridge of every node."""
    lines = F.concat(F.coalesce("source_location", F.lit("")), F.coalesce(F.concat(F.lit("-L"), F.col("line_end").cast("string")), F.lit("")))
    rows = graph.nodes.join(degrees(graph), "id", "left").join(assigned(communities).withColumnRenamed("node_id", "id"), "id", "left").join(bridges.select("id").distinct().withColumn("b", F.lit(True)), "id", "left")
    return rows.select("id", "label", "kind", "signature", lines.alias("lines"), "community_id", "degree", F.coalesce("b", F.lit(False)).alias("is_bridge"))


def community_stats(graph: Graph, communities: DataFrame) -> DataFrame:
    """community_id, sigma_tot (summed degrees), sigma_in (twice the edges inside)."""
    of = assigned(communities)
    total = degrees(graph).join(of, F.col("id") == F.col("node_id")).groupBy("community_id").agg(F.sum("degree").alias("sigma_tot"))
    inside = _ends(graph.edges.select("source", "target"), of, "source", "target", graph.hubs).where("ca = cb").groupBy(F.col("ca").alias("community_id")).agg((2 * F.count(F.lit(1))).alias("sigma_in"))
    return total.join(inside, "community_id", "full_outer").na.fill(0)


def centroids(graph: Graph, communities: DataFrame) -> DataFrame:
    """community_id, node_id, degree: the member of the highest degree, the first listed of equals."""
    d = communities.join(degrees(graph).withColumnRenamed("id", "node_id"), "node_id", "left").na.fill(0, ["degree"])
    best = d.groupBy("community_id").agg(F.max_by(F.struct("node_id", "degree"), F.struct("degree", -F.col("pos"), F.col("node_id"))).alias("x"))
    return best.select("community_id", "x.*")


def super_nodes(graph: Graph, communities: DataFrame) -> DataFrame:
    """community_id, size, cohesion, label (three best connected members), members (first five listed).

    Ranks within a community are taken over rows with bounded keep: only the three and five best survive the partial
    aggregation, so a community with a third of all nodes is no burden.
    """
    named = communities.join(graph.nodes.select(F.col("id").alias("node_id"), "label"), "node_id", "left").join(degrees(graph).withColumnRenamed("id", "node_id"), "node_id", "left")
    named = named.withColumn("label", F.coalesce("label", "node_id")).withColumn("degree", F.coalesce("degree", F.lit(0)))
    sizes = named.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    by_degree = top_per_group(named, ["community_id"], [F.col("degree").desc(), F.col("node_id").asc()], 3)
    by_pos = top_per_group(named, ["community_id"], [F.col("pos").asc(), F.col("node_id").asc()], 5)
    joined = lambda rows, name, sep: rows.groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]), sep).alias(name))
    score = cohesion(graph, communities).select("community_id", F.col("score").alias("cohesion"))
    out = sizes.join(joined(by_degree, "label", ", "), "community_id").join(joined(by_pos, "members", "; "), "community_id").join(score, "community_id", "left")
    return out.select("community_id", "size", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), "label", "members")


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: int = 16) -> DataFrame:
    """The n first rows of each group with their rank ``rn``, in two steps: of each salted part first, then of the group."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(salt))
    first = rows.withColumn("salt", part).withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))).where(F.col("rn") <= n).drop("rn", "salt")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def super_edges(graph: Graph, communities: DataFrame) -> DataFrame:
    """source, target (community ids, source < target), n_edges, bridges (the five first source nodes)."""
    between = _ends(graph.edges.select("source", "target"), assigned(communities), "source", "target", graph.hubs).where("ca <> cb")
    rows = between.select(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2"), F.col("source").alias("node"))
    counts = rows.groupBy("c1", "c2", "node").agg(F.count(F.lit(1)).alias("k"))
    total = counts.groupBy("c1", "c2").agg(F.sum("k").alias("n_edges"))
    first = top_per_group(counts.select("c1", "c2", "node"), ["c1", "c2"], [F.col("node").asc()], 5)
    named = first.groupBy("c1", "c2").agg(F.array_join(F.sort_array(F.collect_list("node")), ",").alias("bridges"))
    return total.join(named, ["c1", "c2"]).select(F.col("c1").alias("source"), F.col("c2").alias("target"), "n_edges", "bridges")


def hyperedge_members(hyperedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, relation, node_id, has_node: members of the distinct hyperedges, in long form."""
    rows = hyperedges.select("id", "relation", F.explode("nodes").alias("node_id")).distinct()
    known = nodes.select(F.col("id").alias("node_id")).distinct().withColumn("has_node", F.lit(True))
    return rows.join(known, "node_id", "left").select("id", "relation", "node_id", F.coalesce("has_node", F.lit(False)).alias("has_node"))
