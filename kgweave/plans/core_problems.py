"""Queries over skewed keys and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.operators import hierarchy as H
from kgweave.operators import skew as S
from kgweave.runtime import clean_relation, table


def p3_found(spark, d):
    return S.heavy_endpoints(table(spark, d, "edges")).select("endpoint", "node_key")


def p3_profile(spark, d):
    p = S.key_profile(table(spark, d, "edges"))
    return p.select("node_key", "out_rows", "out_neighbours", F.round("out_weight", 3).alias("out_weight"), "in_rows", "in_neighbours", F.round("in_weight", 3).alias("in_weight"), "two_hop_rows")


def p3_relations(spark, d):
    return S.relation_counts(table(spark, d, "edges"))


def p3_neighbours(spark, d):
    return S.neighbour_lists(table(spark, d, "edges"))


def p3_two_hops(spark, d):
    e = table(spark, d, "edges").where("source <> '' and target <> ''").withColumn("relation", F.coalesce(clean_relation(), F.lit("")))
    into = e.select(F.col("target").alias("via"), F.col("relation").alias("first_relation"), "weight")
    out = e.select(F.col("source").alias("via"), F.col("relation").alias("second_relation"), "weight")
    r = S.eager_join_agg(into, out, "via", ["first_relation"], ["second_relation"], "weight", "weight")
    return r.select(F.col("l_first_relation").alias("first_relation"), F.col("r_second_relation").alias("second_relation"), F.col("n").alias("paths"), F.round(F.col("sum_left") + F.col("sum_right"), 2).alias("weight"))


def p4_found(spark, d):
    return H.hierarchy(table(spark, d, "edges")).select("node_id", "root_id", "depth")


def p4_hierarchy(spark, d):
    tree = H.hierarchy(table(spark, d, "edges"))
    paths = H.ancestor_paths(tree).select("node_id", F.array_join("path", "/").alias("path"))
    return tree.join(paths, "node_id", "left").select("node_id", "parent_id", "root_id", "depth", "n_descendants", "on_cycle", "path")


def p4_descendants(spark, d):
    return H.descendants(H.hierarchy(table(spark, d, "edges")))


QUERIES = {f.__name__: f for f in (p3_found, p3_profile, p3_relations, p3_neighbours, p3_two_hops, p4_found, p4_hierarchy, p4_descendants)}

_REL = "coalesce(lower(trim(relation)), '')"
_TREE = """RECURSIVE links AS (
    SELECT target AS node, min(source) AS parent FROM edges WHERE lower(trim(relation)) IN ('contains', 'method') AND source <> '' AND target <> '' GROUP BY target),
  tops AS (SELECT DISTINCT parent AS node FROM links WHERE parent NOT IN (SELECT node FROM links)),
  tree AS (
    SELECT node AS node_id, NULL::VARCHAR AS parent_id, node AS root_id, 0 AS depth, node AS path FROM tops
    UNION ALL
    SELECT l.node, l.parent, t.root_id, t.depth + 1, t.path || '/' || l.node FROM tree t JOIN links l ON l.parent = t.node_id)"""
_CYCLES = """caught AS (SELECT node, parent FROM links WHERE node NOT IN (SELECT node_id FROM tree)),
  up AS (SELECT node, parent AS anc FROM caught UNION SELECT u.node, c.parent FROM up u JOIN caught c ON c.node = u.anc),
  ring AS (SELECT node FROM up WHERE node = anc),
  low AS (SELECT u.node, min(u.anc) AS root_id FROM up u WHERE u.anc IN (SELECT node FROM ring) GROUP BY u.node)"""

ORACLE = {
    "p3_found": """WITH e AS (SELECT source, target FROM edges), n AS (SELECT count(*) AS total FROM e)
        SELECT 'source' AS endpoint, source AS node_key FROM e, n WHERE source <> '' GROUP BY source, total HAVING count(*) * 100 >= total
        UNION ALL SELECT 'target', target FROM e, n WHERE target <> '' GROUP BY target, total HAVING count(*) * 100 >= total""",
    "p3_profile": """WITH o AS (SELECT source AS node_key, count(*) AS r, count(DISTINCT nullif(target, '')) AS k, sum(coalesce(weight, 0)) AS w FROM edges WHERE source <> '' GROUP BY 1),
        i AS (SELECT target AS node_key, count(*) AS r, count(DISTINCT nullif(source, '')) AS k, sum(coalesce(weight, 0)) AS w FROM edges WHERE target <> '' GROUP BY 1)
        SELECT coalesce(o.node_key, i.node_key) AS node_key, coalesce(o.r, 0) AS out_rows, coalesce(o.k, 0) AS out_neighbours, round(coalesce(o.w, 0), 3) AS out_weight,
          coalesce(i.r, 0) AS in_rows, coalesce(i.k, 0) AS in_neighbours, round(coalesce(i.w, 0), 3) AS in_weight, coalesce(o.r, 0) * coalesce(i.r, 0) AS two_hop_rows
        FROM o FULL JOIN i ON o.node_key = i.node_key""",
    "p3_relations": f"""SELECT 'source' AS endpoint, source AS node_key, {_REL} AS relation, count(*) AS n FROM edges WHERE source <> '' GROUP BY ALL
        UNION ALL SELECT 'target', target, {_REL}, count(*) FROM edges WHERE target <> '' GROUP BY ALL""",
    "p3_neighbours": """SELECT source AS node_key, target AS neighbour FROM edges WHERE source <> '' AND target <> ''
        UNION SELECT target, source FROM edges WHERE source <> '' AND target <> ''""",
    "p3_two_hops": f"""WITH e AS (SELECT source, target, {_REL} AS relation, weight FROM edges WHERE source <> '' AND target <> ''),
        i AS (SELECT target AS via, relation, count(*) AS n, sum(coalesce(weight, 0)) AS w FROM e GROUP BY ALL), o AS (SELECT source AS via, relation, count(*) AS n, sum(coalesce(weight, 0)) AS w FROM e GROUP BY ALL)
        SELECT i.relation AS first_relation, o.relation AS second_relation, sum(i.n * o.n)::BIGINT AS paths, round(sum(i.w * o.n) + sum(o.w * i.n), 2) AS weight FROM i JOIN o USING (via) GROUP BY ALL""",
    "p4_found": f"WITH {_TREE}, {_CYCLES} SELECT node_id, root_id, depth FROM tree UNION ALL SELECT node, root_id, -1 FROM low",
    "p4_hierarchy": f"""WITH {_TREE}, {_CYCLES},
        sub AS (SELECT a.node_id, count(b.node_id) - 1 AS n FROM tree a JOIN tree b ON b.root_id = a.root_id AND (b.path = a.path OR b.path LIKE replace(replace(a.path, '%', '%%'), '_', '_') || '/%' AND starts_with(b.path, a.path || '/')) GROUP BY a.node_id)
        SELECT t.node_id, parent_id, root_id, depth, n AS n_descendants, false AS on_cycle, path FROM tree t JOIN sub USING (node_id)
        UNION ALL SELECT l.node, c.parent, l.root_id, -1, NULL, l.node IN (SELECT node FROM ring), NULL FROM low l JOIN caught c ON c.node = l.node""",
    "p4_descendants": f"""WITH {_TREE}, pairs AS (SELECT node_id, unnest(string_split(path, '/')) AS ancestor_id, unnest(range(len(string_split(path, '/')))) AS k, depth FROM tree)
        SELECT ancestor_id, node_id, (depth - k)::INTEGER AS distance FROM pairs WHERE k < depth""",
}
