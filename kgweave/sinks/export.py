"""Exports as DataFrames of rows or lines: Cypher, GraphML, SVG, vault notes, page view-model, report, and their searches."""

from __future__ import annotations

import html
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions import text as X
from kgweave.operators.analysis import community_labels, suggested_questions, surprising_connections
from kgweave.operators.graph import Graph, adjacency, assigned, cohesion, degrees, god_nodes, graph_stats
from kgweave.runtime import global_rank

# The drawing's colours.
PALETTE = ("#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00", "#ffff33", "#a65628", "#f781bf", "#999999", "#66c2a5", "#fc8d62", "#8da0cb")
MAX_DRAWN = 5_000
PUSH_BATCH = 50


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit("'"), X.cypher_escape(F.coalesce(F.col(c), F.lit(""))), F.lit("'"))
    return nodes.select("id", F.concat(F.lit("MERGE (n:Node {id: "), q("id"), F.lit("}) SET n.label = "), q("label"), F.lit(", n.file_type = "), q("file_type"), F.lit(", n.source_file = "), q("source_file"), F.lit(";")).alias("statement"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    q = lambda c: F.concat(F.lit("'"), X.cypher_escape(c), F.lit("'"))
    kind = F.concat(F.lit("`"), F.replace(F.upper("relation"), F.lit("`"), F.lit("``")), F.lit("`"))
    return edges.select("source", "target", F.concat(F.lit("MATCH (a:Node {id: "), q("source"), F.lit("}) MATCH (b:Node {id: "), q("target"), F.lit("}) MERGE (a)-[r:"), kind, F.lit("]->(b) SET r.confidence = "), q("confidence"), F.lit(";")).alias("statement"))


def cypher_communities(graph: Graph, communities: DataFrame) -> DataFrame:
    """kind (community, member), key, statement: a Community node each, with label, size and cohesion, and BELONGS_TO for its members."""
    q = lambda c: F.concat(F.lit("'"), X.cypher_escape(c), F.lit("'"))
    number = F.col("community_id").cast("string")
    facts = cohesion(graph, communities).join(community_labels(graph, communities), "community_id")
    head = F.concat(F.lit("MERGE (c:Community {id: "), number, F.lit("}) SET c.label = "), q("label"), F.lit(", c.size = "), F.col("size").cast("string"), F.lit(", c.cohesion = "), F.format_string("%.3f", "score"), F.lit(";"))
    member = F.concat(F.lit("MATCH (n:Node {id: "), q("node_id"), F.lit("}) MATCH (c:Community {id: "), number, F.lit("}) MERGE (n)-[:BELONGS_TO]->(c);"))
    a = facts.select(F.lit("community").alias("kind"), number.alias("key"), head.alias("statement"))
    return a.unionByName(communities.select("community_id", "node_id").distinct().select(F.lit("member").alias("kind"), F.concat(number, F.lit(":"), "node_id").alias("key"), member.alias("statement")))


def push_batches(statements: DataFrame, size: int = PUSH_BATCH) -> DataFrame:
    """batch, statement: numbered batches of ``size`` for a sink that takes many at once."""
    return global_rank(statements.select("statement"), ["statement"]).select((F.floor(F.col("rank") / size)).cast("bigint").alias("batch"), "statement")


def graphml_lines(graph: Graph) -> DataFrame:
    """ord, line of a whole GraphML document."""
    spark = graph.nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<key id="relation" for="edge" attr.name="relation" attr.type="string"/>', '<graph edgedefault="' + ("directed" if graph.directed else "undirected") + '">']
    ends = spark.createDataFrame([(0, "\n".join(head)), (3, "</graph></graphml>")], "ord int, line string")
    n = graph.nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), X.html_escape("id"), F.lit('"><data key="label">'), X.html_escape(F.coalesce("label", F.lit(""))), F.lit("</data></node>")).alias("line"))
    e = graph.edges.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), X.html_escape("source"), F.lit('" target="'), X.html_escape("target"), F.lit('"><data key="relation">'), X.html_escape("relation"), F.lit("</data></edge>")).alias("line"))
    return ends.unionByName(n).unionByName(e)


def svg_positions(graph: Graph, communities: DataFrame, radius: float = 400.0, centre: float = 500.0) -> DataFrame:
    """id, idx, x, y, colour: nodes on a circle in id order, coloured by community."""
    n = max(1, graph.nodes.count())
    ranked = global_rank(graph.nodes.select("id"), ["id"], "idx").join(assigned(communities).withColumnRenamed("node_id", "id"), "id", "left")
    angle = F.lit(2 * math.pi) * F.col("idx") / F.lit(n)
    colour = F.get(F.array(*map(F.lit, PALETTE)), F.pmod(F.coalesce("community_id", F.lit(0)), F.lit(len(PALETTE))))
    return ranked.select("id", "idx", F.round(F.lit(centre) + F.lit(radius) * F.cos(angle), 3).alias("x"), F.round(F.lit(centre) + F.lit(radius) * F.sin(angle), 3).alias("y"), colour.alias("colour"))


def svg_document(graph: Graph, communities: DataFrame) -> str:
    """The drawing; more than 5,000 nodes give a comment in its place."""
    n = graph.nodes.count()
    if n > MAX_DRAWN:
        return f'<svg xmlns="http://www.w3.org/2000/svg"><!-- {n} nodes are too many to draw --></svg>'
    at = {r["id"]: r for r in svg_positions(graph, communities).collect()}
    lines = [f'<line x1="{at[r[0]]["x"]}" y1="{at[r[0]]["y"]}" x2="{at[r[1]]["x"]}" y2="{at[r[1]]["y"]}" stroke="#ccc"/>' for r in graph.edges.select("source", "target").toLocalIterator() if r[0] in at and r[1] in at]
    dots = [f'<circle cx="{r["x"]}" cy="{r["y"]}" r="4" fill="{r["colour"]}"><title>{html.escape(r["id"])}</title></circle>' for r in at.values()]
    return '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000">' + "".join(lines + dots) + "</svg>"


def vault_notes(graph: Graph, communities: DataFrame) -> DataFrame:
    """file, content: a note a node; names that collide get the id."""
    of = assigned(communities).withColumnRenamed("node_id", "id")
    base = X.file_name(F.coalesce("label", "id"))
    named = graph.nodes.withColumn("name", base)
    dup = named.groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    rows = named.join(dup, "name").join(of, "id", "left")
    name = F.concat(F.when(F.col("k") > 1, F.concat("name", F.lit(" "), X.file_name("id"))).otherwise(F.col("name")), F.lit(".md"))
    content = F.concat(F.lit("---\nid: "), "id", F.lit("\nfile_type: "), F.coalesce("file_type", F.lit("")), F.lit("\nsource: "), F.coalesce("source_file", F.lit("")), F.lit("\ncommunity: "), F.coalesce(F.col("community_id").cast("string"), F.lit("")), F.lit("\n---\n# "), F.coalesce("label", "id"), F.lit("\n"))
    return rows.select("id", name.alias("file"), content.alias("content"))


def page_nodes(graph: Graph, communities: DataFrame, bridges: DataFrame | None = None) -> DataFrame:
    """The page's nodes: id, label, file, group (community or -1), degree, bridge."""
    of = assigned(communities).withColumnRenamed("node_id", "id")
    rows = graph.nodes.join(of, "id", "left").join(degrees(graph), "id", "left")
    if bridges is not None:
        rows = rows.join(bridges.select("id").distinct().withColumn("bridge", F.lit(True)), "id", "left")
    else:
        rows = rows.withColumn("bridge", F.lit(False))
    return rows.select("id", X.sanitize_label("label").alias("label"), F.coalesce("source_file", F.lit("")).alias("file"), F.coalesce("community_id", F.lit(-1)).alias("group"), "degree", F.coalesce("bridge", F.lit(False)).alias("bridge"))


def page_edges(graph: Graph) -> DataFrame:
    """The page's edges: those with nodes at both ends."""
    ids = graph.nodes.select("id")
    rows = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return rows.select("source", "target", "relation", "confidence")


def search_notes(nodes: DataFrame, query: str, top: int = 50) -> DataFrame:
    """id, label: two or more characters found in label or file; documents and others first, then headings, by label."""
    q = query.lower()
    if len(q) < 2:
        return nodes.where(F.lit(False)).select("id", "label")
    rank = F.when(F.col("id").contains("_h1_"), 1).when(F.col("id").contains("_h2_"), 2).otherwise(0)
    hit = F.lower("label").contains(q) | F.lower("source_file").contains(q)
    return nodes.where(F.coalesce(hit, F.lit(False))).orderBy(rank, "label", "id").limit(top).select("id", "label")


def one_hop(graph: Graph, ids: DataFrame) -> DataFrame:
    """id, role (match, neighbour, dim) of every node, over edges with nodes at both ends."""
    m = ids.select("id").distinct().withColumn("m", F.lit(True))
    e = page_edges(graph)
    both = e.select(F.col("source").alias("id"), F.col("target").alias("id2")).unionByName(e.select(F.col("target").alias("id"), F.col("source").alias("id2")))
    near = both.join(ids.select(F.col("id").alias("id2")).distinct(), "id2", "left_semi").select("id").distinct().withColumn("n", F.lit(True))
    return graph.nodes.select("id").join(m, "id", "left").join(near, "id", "left").select("id", F.when(F.col("m"), "match").when(F.col("n"), "neighbour").otherwise("dim").alias("role"))


def node_details(graph: Graph, communities: DataFrame) -> DataFrame:
    """id, label, file, community_id, n_neighbours (with a node, whatever the direction)."""
    e = page_edges(graph)
    n = adjacency(Graph(graph.nodes, e)).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    of = assigned(communities).withColumnRenamed("node_id", "id")
    return graph.nodes.join(of, "id", "left").join(n, "id", "left").select("id", "label", X.short_path("source_file").alias("file"), "community_id", F.coalesce("n", F.lit(0)).alias("n_neighbours"))


def report(graph: Graph, communities: DataFrame, top: int = 10) -> str:
    """The report as Markdown, from small results only."""
    s = graph_stats(graph).first()
    c = cohesion(graph, communities).orderBy(F.col("size").desc(), "community_id").limit(50).collect()
    out = ["# Graph report", "", f"{s['n_nodes']} nodes, {s['n_edges']} edges, average degree {s['average_degree']:.2f}", "", "## Communities", "", "| id | size | cohesion |", "| --- | --- | --- |"]
    out += [f"| {r['community_id']} | {r['size']} | {r['score']:.3f} |" for r in c]
    out += ["", "## Hubs", ""] + [f"- {r['label']} ({r['edges']})" for r in god_nodes(graph, top).collect()]
    out += ["", "## Surprising connections", ""] + [f"- {r['source']} {r['relation']} {r['target']}" for r in surprising_connections(graph, communities).collect()]
    out += ["", "## Questions", ""] + [f"- {r['question']}" for r in suggested_questions(graph, communities).collect()]
    return "\n".join(out) + "\n"


def token_sums(conversations: DataFrame) -> DataFrame:
    """exchanges, tokens of the distinct conversations; non-positive counts are unknown and count as 0."""
    one = conversations.where("id is not null").groupBy("id").agg(F.max(F.greatest(F.coalesce("tokens_used", F.lit(0)), F.lit(0))).alias("t"))
    return one.agg(F.count(F.lit(1)).alias("exchanges"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))


def conversation_note(conversations: DataFrame) -> DataFrame:
    """file, content: a memory note a conversation, quotes escaped."""
    q = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('\\"'))
    content = F.concat(F.lit('---\nid: "'), q("id"), F.lit('"\nquestion: "'), q("question"), F.lit('"\ntimestamp: "'), q("timestamp"), F.lit('"\ntokens_used: '), F.coalesce(F.col("tokens_used").cast("string"), F.lit("0")), F.lit("\n---\n"), F.coalesce("summary", F.lit("")), F.lit("\n"))
    return conversations.where("id is not null").select("id", F.concat(F.lit("memory/"), X.safe_name("id"), F.lit(".md")).alias("file"), content.alias("content")).distinct()


def cost_totals(runs: DataFrame) -> DataFrame:
    """The runs with running totals by date; the ledger of one project, which is short."""
    from pyspark.sql import Window

    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("total_input", F.sum("input_tokens").over(w)).withColumn("total_output", F.sum("output_tokens").over(w))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def colour(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, PALETTE)), F.pmod(c, F.lit(len(PALETTE))))
