"""Questions to graphs: seeds, complexity, budgets, context selection and its text form, conversation memory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.functions.text import match_score, query_terms, safe_name
from kgweave.operators.graph import Graph, adjacency, assigned, centroids, degrees, god_nodes, subgraph
from kgweave.operators.kernels import articulation_points
from kgweave.operators.traverse import reach, shortest_path
from kgweave.runtime import global_rank
from kgweave.schema import CHAT_COMMUNITY

# Words of questions about the whole.
ARCHITECTURAL = ("overview", "architecture", "structure", "how does", "how do", "explain", "describe", "design", "module")


@dataclass(frozen=True)
class Budget:
    graph_ratio: float
    source_ratio: float
    max_nodes: int
    max_edges: int


# Shares and sizes for each complexity.
BUDGETS = {
    "focused": Budget(0.10, 0.70, 10, 20), "module": Budget(0.20, 0.55, 30, 60), "cross_module": Budget(0.30, 0.40, 50, 100),
    "architectural": Budget(0.40, 0.20, 40, 80), "exploratory": Budget(0.25, 0.45, 40, 80),
}


def scored(nodes: DataFrame, terms: list[str]) -> DataFrame:
    return nodes.withColumn("match", match_score("label", terms))


def seeds(nodes: DataFrame, question: str, top: int = 5) -> DataFrame:
    """The best matching nodes: id, label, match; ties by id."""
    return scored(nodes, query_terms(question)).where("match > 0").orderBy(F.col("match").desc(), "id").limit(top).select("id", "label", "match")


def best_node(nodes: DataFrame, text: str) -> str | None:
    row = scored(nodes, query_terms(text, 1)).where("match > 0").orderBy(F.col("match").desc(), "id").select("id").first()
    return row[0] if row else None


def path_query(graph: Graph, start: str, end: str) -> list[str] | None:
    a, b = best_node(graph.nodes, start), best_node(graph.nodes, end)
    return shortest_path(graph, a, b) if a is not None and b is not None else None


def explain(graph: Graph, communities: DataFrame, text: str) -> DataFrame:
    """id, label, degree, community_id, neighbour, neighbour_label, relation of the best matching node; the forward edge's relation first."""
    node = best_node(graph.nodes, text)
    hit = graph.nodes.where(F.col("id") == F.lit(node)).select("id", "label") if node is not None else graph.nodes.where(F.lit(False)).select("id", "label")
    at = lambda a, b, name: graph.edges.where(F.col(a) == F.lit(node)).select(F.col(b).alias("neighbour"), F.col("relation").alias(name))
    near = at("source", "target", "fwd").join(at("target", "source", "back"), "neighbour", "full_outer")
    near = near.join(graph.nodes.select(F.col("id").alias("neighbour"), F.col("label").alias("neighbour_label")), "neighbour", "left")
    one = hit.withColumn("key", F.lit(1)).join(near.withColumn("key", F.lit(1)), "key", "left").drop("key")
    one = one.join(assigned(communities).withColumnRenamed("node_id", "id"), "id", "left")
    n = near.count() if node is not None else 0
    return one.select("id", "label", F.lit(n).alias("degree"), "community_id", "neighbour", "neighbour_label", F.coalesce("fwd", "back", F.lit("related")).alias("relation"))


def classify_complexity(nodes: DataFrame, question: str) -> str:
    q, terms = question.lower(), query_terms(question)
    if any(k in q for k in ARCHITECTURAL):
        return "architectural"
    matches = scored(nodes, terms).where("match > 0").count()
    if len(terms) <= 1 and matches <= 3:
        return "focused"
    if matches <= 10:
        return "module"
    return "exploratory" if matches > 15 or len(terms) > 5 else "cross_module"


def relevance(graph: Graph, question: str) -> DataFrame:
    """id, label, match, relevance: matches, one for more than ten neighbours, half the confidence of each edge out."""
    out = graph.edges.groupBy(F.col("source").alias("id")).agg(F.sum(F.col("confidence_score") * 0.5).alias("out"))
    d = degrees(graph)
    rows = scored(graph.nodes, query_terms(question)).select("id", "label", "match").join(d, "id", "left").join(out, "id", "left")
    score = F.col("match") + F.when(F.col("degree") > 10, 1.0).otherwise(0.0) + F.coalesce("out", F.lit(0.0))
    return rows.select("id", "label", "match", F.round(score, 6).alias("relevance"))


def _cut(graph: Graph, picked: DataFrame, order: list[Column], budget: Budget) -> Graph:
    nodes = picked.select("id").distinct()
    if order:
        nodes = picked.dropDuplicates(["id"]).orderBy(*order).select("id")
    sub = subgraph(graph, nodes.limit(budget.max_nodes))
    return Graph(sub.nodes, sub.edges.orderBy("source", "target").limit(budget.max_edges), graph.directed)


def _named(graph: Graph, ids: DataFrame, scores: DataFrame) -> DataFrame:
    return ids.distinct().join(scores, "id", "left").na.fill(0, ["relevance"])


def select_community_aware(graph: Graph, communities: DataFrame, question: str, budget: Budget) -> Graph:
    """The best seed's community, the articulation points in it, and five hubs, the most relevant first."""
    best = seeds(graph.nodes, question, 1)
    of = assigned(communities)
    mine = of.join(best.select(F.col("id").alias("node_id")), "node_id").select("community_id").distinct()
    members = of.join(mine, "community_id", "left_semi").select(F.col("node_id").alias("id"))
    ids = members.unionByName(god_nodes(graph, 5).select("id")).unionByName(best.select("id"))
    return _cut(graph, _named(graph, ids, relevance(graph, question)), [F.col("relevance").desc(), F.col("id").asc()], budget)


def select_relevance_weighted(graph: Graph, communities: DataFrame, question: str, budget: Budget) -> Graph:
    """What three seeds reach, the most relevant first."""
    scores = relevance(graph, question)
    start = scores.where("match > 0").orderBy(F.col("relevance").desc(), "id").limit(3).select("id")
    return _cut(graph, _named(graph, reach(graph, start).select("id"), scores), [F.col("relevance").desc(), F.col("id").asc()], budget)


def select_path_based(graph: Graph, communities: DataFrame, question: str, budget: Budget) -> Graph:
    """The path between the two best seeds with its neighbours; one seed or no path: community-aware."""
    top = [r[0] for r in seeds(graph.nodes, question, 2).collect()]
    if not top:
        return Graph(graph.nodes.where(F.lit(False)), graph.edges.where(F.lit(False)), graph.directed)
    path = shortest_path(graph, top[0], top[1]) if len(top) > 1 else None
    if not path:
        return select_community_aware(graph, communities, question, budget)
    on = graph.edges.sparkSession.createDataFrame([(p,) for p in path], "id string")
    near = adjacency(graph).join(on.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("neighbour").alias("id"))
    return _cut(graph, _named(graph, on.unionByName(near), relevance(graph, question)), [F.col("relevance").desc(), F.col("id").asc()], budget)


def select_architectural(graph: Graph, communities: DataFrame, question: str, budget: Budget) -> Graph:
    """Ten hubs, ten articulation points and each community's best connected member, by id."""
    ids = god_nodes(graph, 10).select("id").unionByName(articulation_points(graph).select("id").orderBy("id").limit(10))
    ids = ids.unionByName(centroids(graph, communities).select(F.col("node_id").alias("id")))
    return _cut(graph, ids, [F.col("id").asc()], budget)


STRATEGIES = {
    "focused": select_community_aware, "module": select_community_aware, "cross_module": select_path_based, "architectural": select_architectural, "exploratory": select_relevance_weighted,
}


def without_chat(communities: DataFrame) -> DataFrame:
    return communities.where(F.col("community_id") != CHAT_COMMUNITY)


def select_context(graph: Graph, communities: DataFrame, question: str, history: bool = False, complexity: str | None = None) -> Graph:
    """The part of the graph for a question: its complexity picks strategy and budget; ``history`` keeps the chat community."""
    kind = complexity or classify_complexity(graph.nodes, question)
    return STRATEGIES[kind](graph, communities if history else without_chat(communities), question, BUDGETS[kind])


def context_lines(context: Graph, communities: DataFrame) -> DataFrame:
    """ord, line: the context as text, nodes by lower-case label, then up to 50 edges. Bounded by the budget."""
    of = assigned(communities).withColumnRenamed("node_id", "id")
    nodes = context.nodes.join(of, "id", "left").orderBy(F.lower("label"), "id")
    n = nodes.select(F.concat(F.lit("- **"), "label", F.lit("** ("), F.coalesce("kind", F.lit("node")), F.lit(") "), F.coalesce("source_file", F.lit("")), F.coalesce(F.concat(F.lit(" [community "), F.col("community_id").cast("string"), F.lit("]")), F.lit(""))).alias("line"), F.lower("label").alias("k"), "id")
    n = n.select((F.row_number().over(Window.orderBy("k", "id"))).alias("ord"), "line")
    e = context.edges.orderBy("source", "target").limit(50).select(F.concat("source", F.lit(" --"), "relation", F.lit("--> "), "target").alias("line"), "source", "target")
    e = e.select((F.lit(1_000_000) + F.row_number().over(Window.orderBy("source", "target"))).alias("ord"), "line")
    return n.unionByName(e)


def format_context(context: Graph, communities: DataFrame, question: str) -> str:
    rows = [r[0] for r in context_lines(context, communities).orderBy("ord").select("line").collect()]
    nodes = [r for r in rows if r.startswith("- **")]
    edges = rows[len(nodes) :]
    return "\n".join([f"# Context: {question}", "", f"## Nodes ({len(nodes)})", *nodes, "", f"## Edges ({len(edges)})", *edges])


# Conversation memory


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    return conversations.where("id is not null").select("id", F.coalesce("question", F.lit("")).alias("label"), F.lit("document").alias("file_type"), F.concat(F.lit("memory/"), safe_name("id"), F.lit(".md")).alias("source_file"), F.col("timestamp").alias("captured_at"), F.lit("Conversation").alias("kind")).distinct()


def conversation_edges(conversations: DataFrame) -> DataFrame:
    rows = conversations.where("id is not null").select(F.col("id").alias("source"), F.explode("relevant_nodes").alias("target")).where("target is not null and target <> ''").distinct()
    return rows.select("source", "target", F.lit("references").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score"), F.lit(1.0).alias("weight"))


def with_chat_community(communities: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversation ids as further members of the chat community, after those listed."""
    known = communities.where(F.col("community_id") == CHAT_COMMUNITY).select(F.col("node_id").alias("id"))
    last = communities.where(F.col("community_id") == CHAT_COMMUNITY).agg(F.max("pos")).first()[0]
    new = conversations.where("id is not null").select("id").distinct().join(known, "id", "left_anti")
    ranked = global_rank(new, ["id"])
    return communities.select("community_id", "node_id", "pos").unionByName(ranked.select(F.lit(CHAT_COMMUNITY).alias("community_id"), F.col("id").alias("node_id"), (F.lit(-1 if last is None else last) + 1 + F.col("rank")).cast("int").alias("pos")))


def related_nodes(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """id, question, score, related (sorted ids of the relevant nodes, joined by ', ') of conversations that a search found."""
    near = conversation_edges(conversations).select(F.col("source").alias("id"), "target").join(found.select("id"), "id", "left_semi")
    return found.join(near.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("related")), "id", "left").select("id", "question", "score", F.coalesce("related", F.lit("")).alias("related"))


def search_conversations(conversations: DataFrame, question: str, top: int = 10) -> DataFrame:
    """id, question, score: three a matching term of the question, one a term of the summary; ties by id."""
    terms = query_terms(question)
    rows = conversations.where("id is not null").groupBy("id").agg(F.max(F.struct("question", "summary")).alias("x")).select("id", "x.question", "x.summary")
    score = 3 * match_score("question", terms) + match_score(F.coalesce("summary", F.lit("")), terms)
    return rows.select("id", "question", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(top)
