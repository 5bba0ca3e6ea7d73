"""Queries over the graph tables and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.operators import analysis, community, components, context, graph, infer, kernels, traverse
from kgweave.operators.graph import EDGE_ORDER, NODE_ORDER, Graph
from kgweave.plans import algorithm_sql
from kgweave.runtime import Scratch, table
from kgweave.schema import bad_values

QUESTION = "how does the graph parser handle import labels"
START, END, EXPLAINED = "index barrel", "prelude", "graph parser"
ASKED = (QUESTION, "barrel", "overview of the system", "which parser reads cursor headers", "budget community option table query")


def built(spark, d) -> Graph:
    return graph.build_graph(table(spark, d, "nodes"), table(spark, d, "edges"))


def stored(spark, d) -> Graph:
    """The built graph as written tables, for operators that read it many times."""
    g, s = built(spark, d), Scratch(spark)
    return Graph(s.save(g.nodes), s.save(g.edges))


def communities(spark, d):
    return table(spark, d, "communities")


def _halves(spark, d) -> tuple[Graph, Graph]:
    n, e = table(spark, d, "nodes"), table(spark, d, "edges")
    return (graph.build_graph(n.where("extraction_seq <= 4"), e.where("extraction_seq <= 4")), graph.build_graph(n.where("extraction_seq > 4"), e.where("extraction_seq > 4")))


def build_nodes(spark, d):
    return built(spark, d).nodes.select("id", "label", "file_type", "source_file", "source_location", "kind", "extraction_seq")


def build_edges(spark, d):
    return built(spark, d).edges.select("source", "target", "relation", "confidence", "confidence_score", "source_file", "weight", "extraction_seq")


def merge_graphs(spark, d):
    m = graph.merge_graphs(*_halves(spark, d))
    return m.nodes.select("id", "label", F.lit("node").alias("part")).unionByName(m.edges.select(F.concat("source", F.lit("->"), "target").alias("id"), F.col("relation").alias("label"), F.lit("edge").alias("part")))


def graph_diff(spark, d):
    return graph.graph_diff(*_halves(spark, d))


def subgraph_code(spark, d):
    g = stored(spark, d)
    return graph.subgraph(g, g.nodes.where(F.lower("file_type") == "code").select("id")).edges.select("source", "target", "relation")


def validate_extraction(spark, d):
    return graph.validate_extraction(*(table(spark, d, t) for t in ("nodes", "edges", "hyperedges")))


def unknown_values(spark, d):
    return bad_values(table(spark, d, "edges"))


def degree(spark, d):
    return graph.degrees(built(spark, d))


def graph_stats(spark, d):
    return graph.graph_stats(built(spark, d)).withColumn("average_degree", F.round("average_degree", 6))


def god_nodes(spark, d):
    return graph.god_nodes(built(spark, d))


def node_flags(spark, d):
    return graph.described_nodes(built(spark, d)).select("id", "degree", "is_file", "is_concept")


def neighbors(spark, d):
    return graph.neighbours(built(spark, d))


def cohesion(spark, d):
    return graph.cohesion(built(spark, d), communities(spark, d)).withColumn("score", F.round("score", 9))


def community_stats(spark, d):
    return graph.community_stats(built(spark, d), communities(spark, d))


def centroids(spark, d):
    return graph.centroids(built(spark, d), communities(spark, d))


def super_nodes(spark, d):
    return graph.super_nodes(built(spark, d), communities(spark, d)).withColumn("cohesion", F.round("cohesion", 9))


def super_edges(spark, d):
    return graph.super_edges(built(spark, d), communities(spark, d))


def hyperedge_members(spark, d):
    return graph.hyperedge_members(table(spark, d, "hyperedges"), table(spark, d, "nodes"))


_INFERRED = ("source", "target", "relation", "confidence_score", "source_file")


def transitive_dependencies(spark, d):
    return infer.transitive_dependencies(stored(spark, d)).select(*_INFERRED)


def codependents(spark, d):
    return infer.codependent_groups(stored(spark, d))


def shared_context_dense(spark, d):
    return infer.shared_context(stored(spark, d), 3).select("source", "target", F.round("confidence_score", 6).alias("confidence_score"))


def shared_context_maximum(spark, d):
    return infer.shared_context(stored(spark, d), 2).select("source", "target", F.round("confidence_score", 6).alias("confidence_score"))


def community_bridges(spark, d):
    return infer.community_bridges(stored(spark, d), communities(spark, d)).select(*_INFERRED)


def code_document_links(spark, d):
    return infer.code_document_links(stored(spark, d)).select(*_INFERRED)


def inferred_edges(spark, d):
    return infer.infer_edges(stored(spark, d), communities(spark, d)).select(*_INFERRED)


def cross_file_surprises(spark, d):
    return analysis.cross_file_surprises(stored(spark, d), communities(spark, d), None)


def top_surprises(spark, d):
    return analysis.cross_file_surprises(stored(spark, d), communities(spark, d))


def cross_community_surprises(spark, d):
    return analysis.cross_community_surprises(stored(spark, d), communities(spark, d), None)


def suggested_questions(spark, d):
    return analysis.suggested_questions(stored(spark, d), communities(spark, d))


def label_terms(spark, d):
    return analysis.label_terms(stored(spark, d), communities(spark, d)).withColumn("tf", F.round("tf", 6))


def community_labels(spark, d):
    return analysis.community_labels(stored(spark, d), communities(spark, d))


def label_prompts(spark, d):
    return analysis.label_prompt(stored(spark, d), communities(spark, d))


def query_seeds(spark, d):
    return context.seeds(built(spark, d).nodes, QUESTION)


def relevance(spark, d):
    return context.relevance(built(spark, d), QUESTION)


def reachable(spark, d):
    g = stored(spark, d)
    return traverse.reach(g, context.seeds(g.nodes, QUESTION)).select("id")


def reach_levels(spark, d):
    g = stored(spark, d)
    return traverse.reach(g, context.seeds(g.nodes, QUESTION), 4, "both").select("id", "level")


def query_graph(spark, d):
    g = stored(spark, d)
    return traverse.query_graph(g, context.seeds(g.nodes, QUESTION)).edges.select("source", "target", "relation", "confidence")


def path_query(spark, d):
    g = stored(spark, d)
    path = context.path_query(g, START, END)
    return spark.createDataFrame([(k, p) for k, p in enumerate(path or [])], "hop int, id string")


def explain_node(spark, d):
    return context.explain(stored(spark, d), communities(spark, d), EXPLAINED)


def complexity(spark, d):
    nodes = stored(spark, d).nodes
    return spark.createDataFrame([(q, context.classify_complexity(nodes, q)) for q in ASKED], "question string, complexity string")


def _context(question, kind=None):
    def run(spark, d):
        g = stored(spark, d)
        c = communities(spark, d)
        return context.context_lines(context.select_context(g, c, question, complexity=kind), c)

    return run


def connected_components(spark, d):
    return components.connected_components(built(spark, d).edges)


def articulation_points(spark, d):
    return kernels.articulation_points(stored(spark, d))


def biconnected_components(spark, d):
    return kernels.biconnected_components(stored(spark, d))


def dominators(spark, d):
    g = stored(spark, d)
    return kernels.dominators(g, context.best_node(g.nodes, START) or "")


def edge_betweenness(spark, d):
    return kernels.edge_betweenness(stored(spark, d)).withColumn("betweenness", F.round("betweenness", 12))


def bridge_nodes(spark, d):
    return kernels.bridge_nodes(stored(spark, d), communities(spark, d))


def detected_communities(spark, d):
    return community.detect_communities(stored(spark, d))


def detected_communities_distributed(spark, d):
    return community.detect_communities(stored(spark, d), mode="distributed")


def community_invariants(spark, d):
    """Counts that must hold of any division: every node once, none below the least size, numbers from 1 without gaps."""
    g = stored(spark, d)
    found = Scratch(spark).save(community.detect_communities(g))
    sizes = found.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    s = sizes.agg(F.count_if(F.col("n") < community.MIN_SIZE).alias("too_small"), F.min("community_id").alias("first"), (F.max("community_id") - F.count(F.lit(1))).alias("gaps"))
    n = found.agg(F.count(F.lit(1)).alias("members"), (F.count(F.lit(1)) - F.count_distinct("node_id")).alias("repeated"))
    lost = g.nodes.join(found.select(F.col("node_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    # one row each
    rows = [df.select(F.lit(k).alias("part"), F.to_json(F.struct(*df.columns)).alias("facts")) for k, df in (("sizes", s), ("members", n), ("nodes", lost))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def cohesion_to_community(spark, d):
    return graph.cohesion_to_community(built(spark, d), communities(spark, d)).withColumn("share", F.round("share", 9))


def verbose_nodes(spark, d):
    g = stored(spark, d)
    return graph.verbose_nodes(g, communities(spark, d), kernels.articulation_points(g))


def simple_labels(spark, d):
    return analysis.simple_labels(stored(spark, d), communities(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        build_nodes, build_edges, merge_graphs, graph_diff, subgraph_code, validate_extraction, unknown_values, degree, graph_stats, god_nodes, node_flags, neighbors, cohesion, community_stats,
        centroids, super_nodes, super_edges, hyperedge_members, transitive_dependencies, codependents, shared_context_dense, shared_context_maximum, community_bridges, code_document_links,
        inferred_edges, cross_file_surprises, top_surprises, cross_community_surprises, suggested_questions, label_terms, community_labels, label_prompts, query_seeds, relevance, reachable,
        reach_levels, query_graph, path_query, explain_node, complexity, connected_components, articulation_points, biconnected_components, dominators, edge_betweenness, bridge_nodes,
        detected_communities, detected_communities_distributed, community_invariants, cohesion_to_community, verbose_nodes, simple_labels,
    )
}
QUERIES |= {
    "context_community_aware": _context(QUESTION, "module"), "context_path_based": _context(QUESTION, "cross_module"),
    "context_architectural": _context(QUESTION, "architectural"), "context_relevance_weighted": _context(QUESTION, "exploratory"),
}

_desc = lambda cols: ", ".join(f"{c} DESC NULLS LAST" for c in cols)


def _gn(where: str = "TRUE") -> str:
    return f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extraction_seq ASC NULLS LAST, {_desc(NODE_ORDER)}) AS rn FROM nodes WHERE id <> '' AND {where}) WHERE rn = 1"


def _ge(where: str = "TRUE") -> str:
    return f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY extraction_seq DESC NULLS LAST, {_desc(EDGE_ORDER)}) AS rn
        FROM (SELECT * REPLACE (lower(trim(relation)) AS relation) FROM edges WHERE source <> '' AND target <> '' AND {where})) WHERE rn = 1"""


G = f"""gn AS MATERIALIZED ({_gn()}), ge AS MATERIALIZED ({_ge()}),
  adj AS MATERIALIZED (SELECT source AS node, target AS neighbour FROM ge UNION SELECT target, source FROM ge),
  dg AS (SELECT coalesce(gn.id, a.node) AS id, coalesce(k, 0) AS degree FROM gn FULL JOIN (SELECT node, count(*) AS k FROM adj GROUP BY node) a ON a.node = gn.id),
  cm AS (SELECT node_id, min(community_id) AS c FROM communities WHERE node_id IS NOT NULL GROUP BY node_id),
  both_ways AS (SELECT source, target FROM ge UNION SELECT target, source FROM ge)"""
_BASE = "string_split(source_file, '/')[-1]"
FLAGS = f"""fl AS (SELECT gn.*, degree,
    coalesce((starts_with(label, '.') AND suffix(label, ')')) OR (suffix(label, ')') AND degree <= 1) OR label = {_BASE}, false) AS is_file,
    coalesce(source_file = '' OR suffix(source_file, '.'), true) AS is_concept FROM gn JOIN dg USING (id))"""
_NEW = "NOT EXISTS (SELECT 1 FROM both_ways b WHERE b.source = x.source AND b.target = x.target)"
_DEP = "dep AS (SELECT DISTINCT source, target FROM ge WHERE relation IN ('imports', 'imports_from', 'depends_on'))"
_TERMS = [t for t in QUESTION.split() if len(t) > 2]
_MATCH = " + ".join(f"coalesce(contains(lower(label), '{t}')::INT, 0)" for t in _TERMS)
_CODE = "'\\.(py|ts|js|go|rs|java|c|cpp|rb|cs|kt|scala|php|swift|lua|zig|hs|ex|m|jl)$'"
_CAT = lambda c: f"CASE WHEN regexp_matches(lower({c}), {_CODE}) THEN 'code' WHEN suffix(lower({c}), '.pdf') THEN 'paper' ELSE 'document' END"
ENDS = f"""ee AS (SELECT e.source, e.target, e.relation, e.confidence, coalesce(a.source_file, '') AS sf, coalesce(b.source_file, '') AS tf, coalesce(a.is_file, false) AS sfile, coalesce(b.is_file, false) AS tfile,
    coalesce(a.is_concept, true) AS sc, coalesce(b.is_concept, true) AS tc, ca.c AS c1, cb.c AS c2
    FROM ge e LEFT JOIN fl a ON a.id = e.source LEFT JOIN fl b ON b.id = e.target LEFT JOIN cm ca ON ca.node_id = e.source LEFT JOIN cm cb ON cb.node_id = e.target)"""
_STRUCT = "relation NOT IN ('imports', 'imports_from', 'contains', 'method')"
_BONUS = "CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END"
_HALF = "CASE confidence WHEN 'AMBIGUOUS' THEN 4 WHEN 'INFERRED' THEN 3 ELSE 2 END"  # 1.5 bonuses, to even
_SURPRISE = f"""sp AS (SELECT source, target, relation, confidence,
    {_BONUS} + CASE WHEN relation = 'semantically_similar_to' THEN {_HALF} ELSE 0 END + CASE WHEN {_CAT('sf')} <> {_CAT('tf')} THEN 2 ELSE 0 END + CASE WHEN c1 <> c2 THEN 1 ELSE 0 END AS score,
    coalesce(nullif(concat_ws('; ', CASE confidence WHEN 'INFERRED' THEN 'inferred connection' END, CASE WHEN {_CAT('sf')} <> {_CAT('tf')} THEN 'crosses file types' END,
      CASE WHEN c1 <> c2 THEN 'bridges separate communities' END, CASE WHEN relation = 'semantically_similar_to' THEN 'semantically similar concepts' END), ''), 'cross-file semantic connection') AS reason
    FROM ee WHERE sf <> '' AND tf <> '' AND sf <> tf AND {_STRUCT} AND NOT sc AND NOT tc)"""
_STOP = ", ".join(f"'{w}'" for w in analysis.STOP_WORDS)
_LABELS = f"""nm AS (SELECT DISTINCT m.community_id, m.node_id, gn.label, coalesce(degree, 0) AS degree FROM communities m JOIN gn ON gn.id = m.node_id LEFT JOIN dg ON dg.id = m.node_id),
  mn AS (SELECT community_id, avg(degree) AS mean FROM nm GROUP BY 1),
  wd AS (SELECT community_id, greatest(1.0, degree / greatest(1.0, mean)) AS w, unnest(string_split_regex(lower(label), '\\s+')) AS word FROM nm JOIN mn USING (community_id)),
  tf AS (SELECT community_id, word, sum(w) AS tf FROM wd WHERE length(word) > 1 AND word NOT IN ({_STOP}) GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)"""
_SEEDS = f"seeds AS (SELECT id, label, {_MATCH} AS m FROM gn WHERE {_MATCH} > 0 ORDER BY m DESC, id LIMIT 5)"


_PAIRS = """pr AS (SELECT DISTINCT least(node, neighbour) AS a, greatest(node, neighbour) AS b FROM adj WHERE node <> neighbour),
        pk AS (SELECT x.c, count(*) AS k FROM pr JOIN cm x ON x.node_id = a JOIN cm y ON y.node_id = b WHERE x.c = y.c GROUP BY 1), cs AS (SELECT c, any_value(k) AS k, any_value(size) AS size FROM (SELECT c, count(*) AS size FROM cm GROUP BY 1) LEFT JOIN pk USING (c) GROUP BY c)"""


def _shared(k: int) -> str:
    return f"""WITH {G}, small AS (SELECT node FROM adj GROUP BY node HAVING count(*) <= 64), a AS (SELECT * FROM adj WHERE node IN (SELECT node FROM small)),
      x AS (SELECT a.neighbour AS source, b.neighbour AS target, count(*) AS k FROM a JOIN a b ON a.node = b.node AND a.neighbour < b.neighbour GROUP BY 1, 2 HAVING count(*) >= {k})
      SELECT source, target, round(least(0.9, 0.2 * k), 6)::DOUBLE AS confidence_score FROM x WHERE {_NEW}"""


_CENTRE = """ct AS (SELECT community_id, node_id, degree FROM (SELECT m.community_id, m.node_id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY m.community_id ORDER BY coalesce(degree, 0) DESC, pos, m.node_id DESC) AS rn
    FROM communities m LEFT JOIN dg ON dg.id = m.node_id) WHERE rn = 1)"""
_BRIDGE = f"SELECT DISTINCT source, target, 'conceptually_related_to' AS relation, 0.5::DOUBLE AS confidence_score, 'inferred:community-bridge' AS source_file FROM (SELECT a.node_id AS source, b.node_id AS target FROM ct a JOIN ct b ON a.community_id < b.community_id) x WHERE source <> target AND {_NEW}"
_TRANS = f"SELECT DISTINCT source, target, 'depends_on' AS relation, 0.4::DOUBLE AS confidence_score, 'inferred:transitive-dependency' AS source_file FROM (SELECT a.source, b.target FROM dep a JOIN dep b ON a.target = b.source) x WHERE source <> target AND {_NEW}"
_FB = r"coalesce(nullif(regexp_extract(string_split(source_file, '/')[-1], '([^.]*)\.[^.]{1,5}$', 1), ''), string_split(source_file, '/')[-1])"
_CD = f"""cd AS (SELECT id, lower(label) AS label, {_FB} AS base, lower(file_type) AS t FROM gn),
  cl AS (SELECT source, target, arg_min(origin, r) AS origin FROM (
    SELECT c.id AS source, d.id AS target, 0 AS r, 'inferred:code-doc-name' AS origin FROM cd c JOIN cd d ON c.label = d.label WHERE c.t = 'code' AND d.t = 'document' AND c.label <> ''
    UNION ALL SELECT c.id, d.id, 1, 'inferred:code-doc-path' FROM cd c JOIN cd d ON c.base = d.base WHERE c.t = 'code' AND d.t = 'document' AND c.base <> '') GROUP BY 1, 2)"""
_LINKS = f"SELECT source, target, 'references' AS relation, 0.7::DOUBLE AS confidence_score, origin AS source_file FROM cl x WHERE source <> target AND {_NEW}"

ORACLE = {
    "build_nodes": f"SELECT id, label, file_type, source_file, source_location, kind, extraction_seq FROM ({_gn()})",
    "build_edges": f"SELECT source, target, relation, confidence, confidence_score, source_file, weight, extraction_seq FROM ({_ge()})",
    "merge_graphs": f"""WITH a AS ({_gn('extraction_seq <= 4')}), b AS ({_gn('extraction_seq > 4')}), x AS ({_ge('extraction_seq <= 4')}), y AS ({_ge('extraction_seq > 4')})
        SELECT id, label, 'node' AS part FROM a UNION ALL SELECT id, label, 'node' FROM b WHERE id NOT IN (SELECT id FROM a)
        UNION ALL SELECT source || '->' || target, relation, 'edge' FROM x UNION ALL SELECT y.source || '->' || y.target, y.relation, 'edge' FROM y ANTI JOIN x USING (source, target)""",
    "graph_diff": f"""WITH a AS ({_gn('extraction_seq <= 4')}), b AS ({_gn('extraction_seq > 4')}), x AS ({_ge('extraction_seq <= 4')}), y AS ({_ge('extraction_seq > 4')})
        SELECT 'new_node' AS part, id AS source, NULL::VARCHAR AS target FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'removed_node', id, NULL FROM a WHERE id NOT IN (SELECT id FROM b)
        UNION ALL SELECT 'new_edge', source, target FROM (SELECT source, target FROM y EXCEPT SELECT source, target FROM x) UNION ALL SELECT 'removed_edge', source, target FROM (SELECT source, target FROM x EXCEPT SELECT source, target FROM y)""",
    "subgraph_code": f"WITH {G}, k AS (SELECT id FROM gn WHERE lower(file_type) = 'code') SELECT source, target, relation FROM ge WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)",
    "validate_extraction": """SELECT 'duplicate_label' AS rule, label AS detail, count(*) AS n FROM nodes WHERE label IS NOT NULL GROUP BY label HAVING count(*) > 1
        UNION ALL SELECT 'empty_node_id', coalesce(label, ''), count(*) FROM nodes WHERE coalesce(id, '') = '' GROUP BY 2
        UNION ALL SELECT 'empty_end', coalesce(source, '') || '->' || coalesce(target, ''), count(*) FROM edges WHERE coalesce(source, '') = '' OR coalesce(target, '') = '' GROUP BY 2
        UNION ALL SELECT 'score_out_of_range', source || '->' || target, count(*) FROM edges WHERE confidence_score < 0 OR confidence_score > 1 GROUP BY 2
        UNION ALL SELECT 'small_hyperedge', id, count(*) FROM hyperedges WHERE coalesce(len(nodes), 0) < 3 GROUP BY id""",
    "unknown_values": """SELECT 'relation' AS "column", relation AS value, count(*) AS n FROM edges WHERE relation IS NULL OR relation NOT IN ('calls', 'implements', 'references', 'cites', 'conceptually_related_to', 'shares_data_with',
          'semantically_similar_to', 'rationale_for', 'imports', 'imports_from', 'contains', 'method', 'extends', 'overrides', 'depends_on') GROUP BY relation
        UNION ALL SELECT 'confidence', confidence, count(*) FROM edges WHERE confidence IS NULL OR confidence NOT IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS') GROUP BY confidence""",
    "degree": f"WITH {G} SELECT id, degree FROM dg",
    "graph_stats": f"WITH {G} SELECT (SELECT count(*) FROM gn) AS n_nodes, (SELECT count(*) FROM ge) AS n_edges, round(2.0 * (SELECT count(*) FROM ge) / (SELECT count(*) FROM gn), 6)::DOUBLE AS average_degree",
    "god_nodes": f"WITH {G}, {FLAGS} SELECT id, label, degree AS edges FROM fl WHERE degree > 0 AND NOT is_file AND NOT is_concept ORDER BY degree DESC, id LIMIT 10",
    "node_flags": f"WITH {G}, {FLAGS} SELECT id, degree, is_file, is_concept FROM fl",
    "neighbors": f"WITH {G} SELECT node, neighbour, label FROM adj JOIN gn ON gn.id = adj.neighbour",
    "cohesion": f"""WITH {G}, pr AS (SELECT DISTINCT least(node, neighbour) AS a, greatest(node, neighbour) AS b FROM adj WHERE node <> neighbour),
        k AS (SELECT x.c, count(*) AS k FROM pr JOIN cm x ON x.node_id = a JOIN cm y ON y.node_id = b WHERE x.c = y.c GROUP BY 1), s AS (SELECT c, count(*) AS size FROM cm GROUP BY 1)
        SELECT s.c AS community_id, size, round(coalesce(k, 0) / greatest(1, size * (size - 1) // 2), 9)::DOUBLE AS score FROM s LEFT JOIN k ON k.c = s.c""",
    "community_stats": f"""WITH {G}, t AS (SELECT c, sum(degree) AS t FROM dg JOIN cm ON node_id = id GROUP BY 1), i AS (SELECT x.c, 2 * count(*) AS i FROM ge JOIN cm x ON x.node_id = source JOIN cm y ON y.node_id = target WHERE x.c = y.c GROUP BY 1)
        SELECT coalesce(t.c, i.c) AS community_id, coalesce(t, 0)::BIGINT AS sigma_tot, coalesce(i, 0)::BIGINT AS sigma_in FROM t FULL JOIN i ON t.c = i.c""",
    "centroids": f"WITH {G}, {_CENTRE} SELECT * FROM ct",
    "super_nodes": f"""WITH {G}, n AS (SELECT m.community_id, m.node_id, m.pos, coalesce(gn.label, m.node_id) AS label, coalesce(degree, 0) AS degree FROM communities m LEFT JOIN gn ON gn.id = m.node_id LEFT JOIN dg ON dg.id = m.node_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, node_id) AS a, row_number() OVER (PARTITION BY community_id ORDER BY pos, node_id) AS b FROM n), {_PAIRS}
        SELECT community_id, count(*) AS size, any_value(round(coalesce(cs.k, 0) / greatest(1, cs.size * (cs.size - 1) // 2), 9))::DOUBLE AS cohesion,
          string_agg(label, ', ' ORDER BY a) FILTER (a <= 3) AS label, string_agg(label, '; ' ORDER BY b) FILTER (b <= 5) AS members FROM r LEFT JOIN cs ON cs.c = r.community_id GROUP BY 1""",
    "super_edges": f"""WITH {G}, x AS (SELECT least(a.c, b.c) AS c1, greatest(a.c, b.c) AS c2, source FROM ge JOIN cm a ON a.node_id = source JOIN cm b ON b.node_id = target WHERE a.c <> b.c),
        u AS (SELECT c1, c2, source, count(*) AS k, row_number() OVER (PARTITION BY c1, c2 ORDER BY source) AS rn FROM x GROUP BY 1, 2, 3)
        SELECT c1 AS source, c2 AS target, sum(k)::BIGINT AS n_edges, string_agg(source, ',' ORDER BY source) FILTER (rn <= 5) AS bridges FROM u GROUP BY 1, 2""",
    "hyperedge_members": "WITH m AS (SELECT DISTINCT id, relation, unnest(nodes) AS node_id FROM hyperedges) SELECT id, relation, node_id, node_id IN (SELECT id FROM nodes WHERE id IS NOT NULL) AS has_node FROM m",
    "transitive_dependencies": f"WITH {G}, {_DEP} {_TRANS}",
    "codependents": f"WITH {G}, {_DEP}, k AS (SELECT target, count(*) AS n FROM dep GROUP BY 1) SELECT target AS shared, source AS member, n AS group_size FROM dep JOIN k USING (target) WHERE n > 1",
    "shared_context_dense": _shared(3),
    "shared_context_maximum": _shared(2),
    "community_bridges": f"WITH {G}, {_CENTRE} {_BRIDGE}",
    "code_document_links": f"WITH {G}, {_CD} {_LINKS}",
    "inferred_edges": f"""WITH {G}, {_CENTRE}, {_DEP}, {_CD}, al AS (SELECT *, 0 AS s FROM ({_BRIDGE}) UNION ALL SELECT *, 1 FROM ({_TRANS}) UNION ALL SELECT *, 2 FROM ({_LINKS}))
        SELECT * EXCLUDE (s, rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY s DESC) AS rn FROM al) WHERE rn = 1""",
    "cross_file_surprises": f"WITH {G}, {FLAGS}, {ENDS}, {_SURPRISE} SELECT * FROM sp",
    "top_surprises": f"WITH {G}, {FLAGS}, {ENDS}, {_SURPRISE} SELECT * FROM sp ORDER BY score DESC, source, target LIMIT 5",
    "cross_community_surprises": f"""WITH {G}, {FLAGS}, {ENDS}, k AS (SELECT coalesce(c1, -1) AS from_community, coalesce(c2, -1) AS to_community, CASE confidence WHEN 'AMBIGUOUS' THEN 2 WHEN 'INFERRED' THEN 1 ELSE 0 END AS rank, source, target, relation, confidence
          FROM ee WHERE c1 IS DISTINCT FROM c2 AND NOT sfile AND NOT tfile AND {_STRUCT})
        SELECT from_community, to_community, source, target, relation, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY from_community, to_community ORDER BY rank DESC, source, target) AS rn FROM k) WHERE rn = 1""",
    "suggested_questions": f"""WITH {G}, {FLAGS},
        a AS (SELECT source, target FROM ge WHERE confidence = 'AMBIGUOUS' ORDER BY source, target LIMIT 3),
        q1 AS (SELECT 1 AS ord, 'ambiguous_edge' AS kind, source || '->' || target AS subject, 'What is the exact relationship between `' || coalesce(s.label, 'unknown') || '` and `' || coalesce(t.label, 'unknown') || '`?' AS question FROM a LEFT JOIN gn s ON s.id = source LEFT JOIN gn t ON t.id = target),
        q2 AS (SELECT 2 AS ord, 'bridge_node' AS kind, id AS subject, 'Why does `' || label || '` connect across communities?' AS question FROM (SELECT * FROM fl WHERE NOT is_file ORDER BY 1.0 / greatest(1, degree) DESC, id LIMIT 3)),
        pr AS (SELECT DISTINCT least(node, neighbour) AS a, greatest(node, neighbour) AS b FROM adj WHERE node <> neighbour),
        k AS (SELECT x.c, count(*) AS k FROM pr JOIN cm x ON x.node_id = a JOIN cm y ON y.node_id = b WHERE x.c = y.c GROUP BY 1), s AS (SELECT c, count(*) AS size FROM cm GROUP BY 1),
        q3 AS (SELECT 3 AS ord, 'low_cohesion' AS kind, s.c::VARCHAR AS subject, 'Should `Community ' || s.c || '` be split into smaller, more focused modules?' AS question FROM s LEFT JOIN k ON k.c = s.c WHERE size >= 5 AND coalesce(k, 0) / greatest(1, size * (size - 1) // 2) < 0.15 ORDER BY s.c LIMIT 7)
        SELECT * FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3) ORDER BY ord, subject LIMIT 7""",
    "label_terms": f"WITH {G}, {_LABELS} SELECT community_id, word, round(tf, 6)::DOUBLE AS tf, df FROM tf JOIN df USING (word)",
    "community_labels": f"""WITH {G}, {_LABELS}, n AS (SELECT count(DISTINCT community_id) AS n FROM communities),
        r AS (SELECT community_id, word, row_number() OVER (PARTITION BY community_id ORDER BY round(tf * ln(n.n / df), 9) DESC, word) AS rn FROM tf JOIN df USING (word), n),
        l AS (SELECT community_id, string_agg(CASE WHEN regexp_matches(word, '^[a-z]') THEN upper(word[1]) || word[2:] ELSE word END, ' ' ORDER BY rn) AS label FROM r WHERE rn <= 3 GROUP BY 1)
        SELECT c.community_id, coalesce(l.label, 'Unnamed Community') AS label FROM (SELECT DISTINCT community_id FROM communities) c LEFT JOIN l USING (community_id)""",
    "query_seeds": f"WITH {G}, {_SEEDS} SELECT id, label, m AS match FROM seeds",
    "relevance": f"""WITH {G}, o AS (SELECT source AS id, sum(confidence_score * 0.5) AS o FROM ge GROUP BY 1)
        SELECT gn.id, label, {_MATCH} AS match, round({_MATCH} + CASE WHEN degree > 10 THEN 1.0 ELSE 0.0 END + coalesce(o, 0), 6)::DOUBLE AS relevance FROM gn JOIN dg USING (id) LEFT JOIN o USING (id)""",
    "reachable": f"WITH RECURSIVE {G}, {_SEEDS}, r AS (SELECT id FROM seeds UNION SELECT ge.target FROM r JOIN ge ON ge.source = r.id) SELECT id FROM r",
    "reach_levels": f"WITH RECURSIVE {G}, {_SEEDS}, r AS (SELECT id, 0 AS level FROM seeds UNION SELECT b.target, r.level + 1 FROM r JOIN both_ways b ON b.source = r.id WHERE r.level < 4) SELECT id, min(level) AS level FROM r GROUP BY id",
    "query_graph": f"WITH RECURSIVE {G}, {_SEEDS}, r AS (SELECT id FROM seeds UNION SELECT ge.target FROM r JOIN ge ON ge.source = r.id) SELECT source, target, relation, confidence FROM ge WHERE source IN (SELECT id FROM r) AND target IN (SELECT id FROM r)",
}
ORACLE |= algorithm_sql.oracle(G, FLAGS, QUESTION, START, END, EXPLAINED, ASKED)
ORACLE |= {
    "label_prompts": f"""WITH {G}, {_PAIRS}, n AS (SELECT m.community_id, m.node_id, gn.label, coalesce(degree, 0) AS degree FROM communities m JOIN gn ON gn.id = m.node_id LEFT JOIN dg ON dg.id = m.node_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY degree DESC, node_id) AS rn FROM n), t AS (SELECT community_id, string_agg('- ' || label, chr(10) ORDER BY rn) AS list FROM r WHERE rn <= 10 GROUP BY 1)
        SELECT community_id, 'Community ' || community_id || ' (' || size || ' nodes, cohesion ' || printf('%.3f', coalesce(k, 0) / greatest(1, size * (size - 1) // 2)) || '):' || chr(10) || list AS prompt FROM cs JOIN t ON t.community_id = cs.c""",
    "community_invariants": f"""WITH {G} SELECT 'sizes' AS part, '{{"too_small":0,"first":1,"gaps":0}}' AS facts UNION ALL SELECT 'members', '{{"members":' || (SELECT count(*) FROM gn) || ',"repeated":0}}' UNION ALL SELECT 'nodes', '{{"lost":0}}'""",
    "cohesion_to_community": f"""WITH {G}, n AS (SELECT node, count(*) AS n FROM adj GROUP BY 1) SELECT node AS node_id, cm.c AS community_id, round(count(*) / any_value(n), 9)::DOUBLE AS share FROM adj JOIN cm ON cm.node_id = neighbour JOIN n USING (node) GROUP BY 1, 2""",
    "verbose_nodes": f"""WITH RECURSIVE {G}, {algorithm_sql.SIMPLE}, {algorithm_sql.COMPONENTS}, {algorithm_sql.FOREST}, {algorithm_sql.BLOCKS}
        SELECT gn.id, label, kind, signature, coalesce(source_location, '') || coalesce('-L' || line_end, '') AS lines, cm.c AS community_id, degree, gn.id IN (SELECT id FROM ap) AS is_bridge FROM gn JOIN dg USING (id) LEFT JOIN cm ON cm.node_id = gn.id""",
    "simple_labels": f"""WITH {G}, w AS (SELECT community_id, unnest(string_split_regex(lower(label), '\\s+')) AS word FROM (SELECT DISTINCT m.community_id, m.node_id, gn.label FROM communities m JOIN gn ON gn.id = m.node_id)),
        k AS (SELECT community_id, word, count(*) AS n FROM w WHERE length(word) > 1 AND word NOT IN ({_STOP}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY n DESC, word) AS rn FROM k),
        l AS (SELECT community_id, string_agg(CASE WHEN regexp_matches(word, '^[a-z]') THEN upper(word[1]) || word[2:] ELSE word END, ' ' ORDER BY rn) AS label FROM r WHERE rn <= 3 GROUP BY 1)
        SELECT c.community_id, coalesce(l.label, 'Unnamed Community') AS label FROM (SELECT DISTINCT community_id FROM communities) c LEFT JOIN l USING (community_id)""",
}
