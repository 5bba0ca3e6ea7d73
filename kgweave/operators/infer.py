"""Rule-based edge inference: anti-joined equi-joins on top of a built graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgweave.functions.text import file_base_name
from kgweave.operators.graph import Graph, _pick, adjacency, centroids
from kgweave.runtime import Scratch, heavy_keys, join_salted, join_unique

DEPENDENCIES = ("imports", "imports_from", "depends_on")
#: Nodes with more neighbours give no shared context; this also bounds the pairs of a node.
MAX_SHARED_NEIGHBOURS = 64
#: Communities of a block whose pairs with a centroid are made together; a multiple of 64.
BRIDGE_BLOCK = 4096


def _without_existing(pairs: DataFrame, graph: Graph) -> DataFrame:
    """Rows of pairs (source, target) that no edge links in either direction."""
    e = graph.edges.select("source", "target")
    known = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return pairs.join(known, ["source", "target"], "left_anti")


def _edges(pairs: DataFrame, relation: str, score, origin: str) -> DataFrame:
    score = F.lit(score) if isinstance(score, float) else score
    return pairs.select("source", "target", F.lit(relation).alias("relation"), F.lit("INFERRED").alias("confidence"), score.cast("double").alias("confidence_score"), F.lit(origin).alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.lit(1.0).alias("weight"))


def community_bridges(graph: Graph, communities: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """An edge between the centroids of every two communities that no edge links yet; the result is quadratic in the communities by definition.

    The pairs are never shuffled, sorted or written. A pair comes up once: s is before t if s's least community is below t's
    greatest. Centroids, one row a community, stand in blocks of BRIDGE_BLOCK in the order of the latter; each meets the
    blocks that can hold later ones, with a bit for every one that it must leave out: those linked to it, and the pairs
    (source, target) of ``but``.
    """
    scratch = Scratch(graph.edges.sparkSession)
    c = centroids(graph, communities).where(F.col("community_id").isNotNull() & F.col("node_id").isNotNull())
    c = c.groupBy("node_id").agg(F.min("community_id").alias("lo"), F.max("community_id").alias("hi"))
    # one row a community
    c, n = scratch.save_counted(c.withColumn("at", F.row_number().over(Window.orderBy("hi", "node_id")) - 1))
    at = lambda end: c.select(F.col("node_id").alias(end), F.col("at").alias(f"{end}_at"))
    e = graph.edges.select("source", "target")
    out = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))
    out = out if but is None else out.unionByName(but.select("source", "target"))
    out = join_unique(join_unique(out, at("source"), "source", "inner", graph.hubs), at("target"), "target", "inner", graph.hubs)
    block, word, bit = F.floor(F.col("target_at") / BRIDGE_BLOCK).cast("int"), F.floor(F.col("target_at") % BRIDGE_BLOCK / 64).cast("int"), F.expr("shiftleft(1L, cast(target_at % 64 as int))")
    words = out.groupBy(F.col("source_at").alias("at"), block.alias("block"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = words.groupBy("at", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    words = words.select("at", "block", F.transform(F.sequence(F.lit(0), F.lit(BRIDGE_BLOCK // 64 - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("bigint"))).alias("words"))
    ends = c.select(F.floor(F.col("at") / BRIDGE_BLOCK).cast("int").alias("block"), "hi", F.col("node_id").alias("target"), (F.col("at") % BRIDGE_BLOCK).cast("int").alias("t"))
    blocks = ends.groupBy("block").agg(F.max("hi").alias("most"))
    starts = c.select("at", "lo", F.col("node_id").alias("source")).join(F.broadcast(blocks), F.col("lo") < F.col("most")).drop("most")
    # as many tasks as the pairs need: the rows themselves are few
    tasks = max(graph.edges.sparkSession.sparkContext.defaultParallelism * 2, min(20_000, n * n // 4_000_000))
    starts = scratch.save(starts.join(words, ["at", "block"], "left").repartition(tasks, "at", "block"))
    pairs = starts.join(F.broadcast(ends), "block").where((F.col("lo") < F.col("hi")) & (F.col("source") != F.col("target")) & F.expr("words is null or getbit(words[t div 64], t % 64) = 0"))
    return _edges(pairs, "conceptually_related_to", 0.5, "inferred:community-bridge")


def transitive_dependencies(graph: Graph, mode: str = "transitive") -> DataFrame:
    """depends_on edges A->C from A->B->C (``transitive``), or between all ends that depend on one B (``codependent``).

    No self-loops, none that exists in either direction. A hub B makes as many pairs as the result has; the join runs on
    distinct pairs, and a hub's are spread over many tasks.
    """
    dep = graph.edges.where(F.col("relation").isin(*DEPENDENCIES)).select("source", "target").distinct()
    second = dep.select(F.col("source").alias("mid"), F.col("target").alias("end")) if mode == "transitive" else dep.select(F.col("target").alias("mid"), F.col("source").alias("end"))
    pairs = join_salted(dep.withColumnRenamed("target", "mid"), second, "mid", graph.hubs).where("source <> end").select("source", F.col("end").alias("target")).distinct()
    return _edges(_without_existing(pairs, graph), "depends_on", 0.4, "inferred:transitive-dependency")


def codependent_groups(graph: Graph) -> DataFrame:
    """shared, member, group_size: the ids that depend on one id, in linear form; every two of a group are codependent.

    The pairs themselves (``transitive_dependencies`` with mode codependent) are quadratic in a hub's dependents.
    """
    dep = graph.edges.where(F.col("relation").isin(*DEPENDENCIES)).select("source", "target").distinct()
    size = dep.groupBy("target").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return join_unique(dep, size, "target", "inner", graph.hubs).select(F.col("target").alias("shared"), F.col("source").alias("member"), "group_size")


def shared_context(graph: Graph, least: int = 3) -> DataFrame:
    """Edges between ids with ``least`` or more common neighbours; hubs of more than 64 neighbours share nothing."""
    adj = adjacency(graph)
    small = adj.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= MAX_SHARED_NEIGHBOURS).select("node")
    a = join_unique(adj, small.withColumn("small", F.lit(True)), "node", "inner", graph.hubs).select("node", "neighbour")
    pairs = a.withColumnRenamed("neighbour", "source").join(a.withColumnRenamed("neighbour", "target"), "node").where("source < target")
    counts = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    return _edges(_without_existing(counts, graph), "conceptually_related_to", F.least(F.lit(0.9), F.lit(0.2) * F.col("shared")), "inferred:shared-context")


def code_document_links(graph: Graph) -> DataFrame:
    """references edges from code to documents of the same label, else of the same file base name; the first rule wins."""
    n = graph.nodes.select("id", F.lower("label").alias("label"), file_base_name("source_file").alias("base"), F.col("file_type"))
    code = n.where(F.lower("file_type") == "code")
    doc = n.where(F.lower("file_type") == "document")

    def aligned(key: str, rank: int, name: str) -> DataFrame:
        c = code.where(F.col(key) != "").select(F.col("id").alias("source"), key)
        d = doc.where(F.col(key) != "").select(F.col("id").alias("target"), key)
        return join_salted(c, d, key, heavy_keys(c, key)).where("source <> target").select("source", "target", F.lit(rank).alias("rank"), F.lit(f"inferred:code-doc-{name}").alias("origin"))

    pairs = aligned("label", 0, "name").unionByName(aligned("base", 1, "path"))
    first = pairs.groupBy("source", "target").agg(F.min_by("origin", "rank").alias("origin"))
    return _edges(_without_existing(first, graph), "references", 0.7, "inferred").drop("source_file").join(first, ["source", "target"]).withColumnRenamed("origin", "source_file")


def infer_edges(graph: Graph, communities: DataFrame, density: str = "normal") -> DataFrame:
    """sparse: code-document links; normal: with bridges and transitive dependencies; dense, maximum: with shared context of 3, 2.

    Of several rules for one ordered pair the last in that order wins.
    """
    density = density.lower()
    if density not in ("sparse", "normal", "dense", "maximum"):
        raise ValueError(f"unknown density: {density}")
    links = code_document_links(graph)
    if density == "sparse":
        rules = [links]
    else:
        rules = [transitive_dependencies(graph)]
        if density != "normal":
            rules.append(shared_context(graph, 3 if density == "dense" else 2))
        rules.append(links)
    all_rows = None
    for k, r in enumerate(rules):
        r = r.withColumn("seq", F.lit(k))
        all_rows = r if all_rows is None else all_rows.unionByName(r)
    picked = _pick(all_rows, ["source", "target"], [F.col("seq")]).drop("seq")
    if density == "sparse":
        return picked
    # bridges lose to every other rule, so they are made without its pairs in place of being compared with them
    picked = Scratch(graph.edges.sparkSession).save(picked)
    return picked.unionByName(community_bridges(graph, communities, picked))
