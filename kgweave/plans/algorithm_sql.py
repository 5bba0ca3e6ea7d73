"""SQL for the graph algorithms and contexts: slow definitions over whole tables, for the comparison only.

Articulation points and blocks come from a breadth-first forest: without a node, each of its children's subtrees hangs
together, and links between subtrees (or to the rest of the tree) join them.
"""

from __future__ import annotations

from kgweave.functions import text as X
from kgweave.operators import context

#: Rounds of label propagation; more than the longest chain of labels on the test tables.
ROUNDS = 40

SIMPLE = """sp AS MATERIALIZED (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM ge WHERE source <> target),
  nb AS MATERIALIZED (SELECT u AS a, v AS b FROM sp UNION SELECT v, u FROM sp)"""
COMPONENTS = f"""ids AS (SELECT source AS id FROM ge UNION SELECT target FROM ge), sl AS MATERIALIZED (SELECT a, b FROM nb UNION SELECT id, id FROM ids),
  cr AS (SELECT 0 AS k, id, id AS c FROM ids UNION ALL SELECT any_value(cr.k) + 1, sl.a, min(cr.c) FROM cr JOIN sl ON sl.b = cr.id WHERE cr.k < {ROUNDS} GROUP BY sl.a),
  cc AS MATERIALIZED (SELECT id, c FROM cr WHERE k = {ROUNDS})"""
#: bf: a breadth-first forest from the least ids (id, level, parent); an: each node's proper ancestors with the child on the way.
FOREST = f"""lv AS (SELECT DISTINCT c AS id, 0 AS k FROM cc UNION SELECT nb.b, k + 1 FROM lv JOIN nb ON nb.a = lv.id WHERE k < 24),
  ll AS MATERIALIZED (SELECT id, min(k) AS level FROM lv GROUP BY id),
  bf AS MATERIALIZED (SELECT x.id, x.level, min(y.id) AS parent FROM ll x LEFT JOIN nb ON nb.b = x.id LEFT JOIN ll y ON y.id = nb.a AND y.level = x.level - 1 GROUP BY x.id, x.level),
  au AS (SELECT id, parent AS anc, id AS child FROM bf WHERE parent IS NOT NULL UNION ALL SELECT au.id, bf.parent, au.anc FROM au JOIN bf ON bf.id = au.anc WHERE bf.parent IS NOT NULL),
  an AS MATERIALIZED (SELECT * FROM au),
  -- links between the parts that the graph has without v: (v, part, part); the rest of the tree is the part ''
  pt AS MATERIALIZED (SELECT DISTINCT a.anc AS v, a.child AS p, coalesce(b.child, '') AS q FROM sp JOIN an a ON a.id = sp.u LEFT JOIN an b ON b.id = sp.v AND b.anc = a.anc WHERE a.anc <> sp.v AND a.child <> coalesce(b.child, '')
    UNION SELECT b.anc, b.child, coalesce(a.child, '') FROM sp JOIN an b ON b.id = sp.v LEFT JOIN an a ON a.id = sp.u AND a.anc = b.anc WHERE b.anc <> sp.u AND b.child <> coalesce(a.child, '')),
  ps AS MATERIALIZED (SELECT v, p, q FROM pt UNION SELECT v, q, p FROM pt UNION SELECT parent, id, id FROM bf WHERE parent IS NOT NULL UNION SELECT id, '', '' FROM bf WHERE parent IS NOT NULL),
  pr AS (SELECT 0 AS k, v, p, p AS c FROM (SELECT DISTINCT v, p FROM ps) UNION ALL SELECT any_value(pr.k) + 1, ps.v, ps.p, min(pr.c) FROM pr JOIN ps ON ps.v = pr.v AND ps.q = pr.p WHERE pr.k < {ROUNDS} GROUP BY ps.v, ps.p),
  pc AS MATERIALIZED (SELECT v, p, c FROM pr WHERE k = {ROUNDS})"""
#: bl: (u, v, block number) of every link; a tree link is known by its child, a link by the tree link of its deeper end.
BLOCKS = f"""tl AS MATERIALIZED (SELECT p AS a, CASE WHEN c = '' THEN v ELSE c END AS b FROM pc WHERE p <> ''),
  tn AS MATERIALIZED (SELECT a, b FROM tl UNION SELECT b, a FROM tl UNION SELECT a, a FROM tl),
  tr AS (SELECT 0 AS k, a AS id, a AS c FROM (SELECT DISTINCT a FROM tn) UNION ALL SELECT any_value(tr.k) + 1, tn.a, min(tr.c) FROM tr JOIN tn ON tn.b = tr.id WHERE tr.k < {ROUNDS} GROUP BY tn.a),
  tc AS MATERIALIZED (SELECT id, c FROM tr WHERE k = {ROUNDS}),
  bl AS MATERIALIZED (SELECT u, v, tc.c, min(u || '|' || v) OVER (PARTITION BY tc.c) AS block FROM (SELECT sp.*, CASE WHEN x.level >= y.level THEN u ELSE v END AS deep FROM sp JOIN ll x ON x.id = u JOIN ll y ON y.id = v) JOIN tc ON tc.id = deep),
  bc AS MATERIALIZED (SELECT block, u AS id FROM bl UNION SELECT block, v FROM bl), ap AS MATERIALIZED (SELECT id, count(*) AS n_blocks FROM bc GROUP BY id HAVING count(*) > 1)"""


def best(name: str, text: str) -> str:
    """A CTE of the one node that matches ``text`` best."""
    m = " + ".join(f"coalesce(contains(lower(label), '{t}')::INT, 0)" for t in X.query_terms(text, 1))
    return f"{name} AS MATERIALIZED (SELECT id, label FROM gn WHERE {m} > 0 ORDER BY {m} DESC, id LIMIT 1)"


def path_query(start: str, end: str, g: str) -> str:
    return f"""WITH RECURSIVE {g}, {best('st', start)}, {best('en', end)}, ln AS MATERIALIZED (SELECT DISTINCT source, target FROM ge),
      lv AS (SELECT id, 0 AS k FROM st UNION SELECT ln.target, k + 1 FROM lv JOIN ln ON ln.source = lv.id WHERE k < 24), ll AS MATERIALIZED (SELECT id, min(k) AS level FROM lv GROUP BY id),
      bk AS (SELECT id, level FROM ll WHERE id IN (SELECT id FROM en) UNION ALL SELECT p, lev FROM (SELECT min(ll.id) AS p, any_value(ll.level) AS lev FROM bk JOIN ln ON ln.target = bk.id JOIN ll ON ll.id = ln.source AND ll.level = bk.level - 1 GROUP BY bk.id))
      SELECT level AS hop, id FROM bk"""


def explain_node(text: str, g: str) -> str:
    return f"""WITH {g}, {best('nd', text)}, f AS (SELECT target AS n, relation FROM ge WHERE source IN (SELECT id FROM nd)), b AS (SELECT source AS n, relation FROM ge WHERE target IN (SELECT id FROM nd)),
      x AS (SELECT coalesce(f.n, b.n) AS n, coalesce(f.relation, b.relation, 'related') AS relation FROM f FULL JOIN b ON f.n = b.n)
      SELECT nd.id, nd.label, (SELECT count(*) FROM x)::INTEGER AS degree, cm.c AS community_id, x.n AS neighbour, gn.label AS neighbour_label, coalesce(x.relation, 'related') AS relation
      FROM nd LEFT JOIN x ON TRUE LEFT JOIN gn ON gn.id = x.n LEFT JOIN cm ON cm.node_id = nd.id"""


def complexity(questions: list[str], g: str) -> str:
    rows = []
    for q in questions:
        terms = X.query_terms(q)
        m = " + ".join(f"coalesce(contains(lower(label), '{t}')::INT, 0)" for t in terms) or "0"
        n = f"(SELECT count(*) FROM gn WHERE {m} > 0)"
        few, many = str(len(terms) <= 1).upper(), str(len(terms) > 5).upper()
        whole = str(any(k in q.lower() for k in context.ARCHITECTURAL)).upper()
        rows.append(f"SELECT '{q}' AS question, CASE WHEN {whole} THEN 'architectural' WHEN {few} AND {n} <= 3 THEN 'focused' WHEN {n} <= 10 THEN 'module' WHEN {n} > 15 OR {many} THEN 'exploratory' ELSE 'cross_module' END AS complexity")
    return f"WITH {g} " + " UNION ALL ".join(rows)


def dominators(start: str, g: str) -> str:
    return f"""WITH RECURSIVE {g}, {best('st', start)}, ln AS MATERIALIZED (SELECT DISTINCT source, target FROM ge WHERE source <> target),
      lv AS (SELECT id, 0 AS k FROM st UNION SELECT ln.target, k + 1 FROM lv JOIN ln ON ln.source = lv.id WHERE k < 24), ll AS MATERIALIZED (SELECT id, min(k) AS level FROM lv GROUP BY id),
      pa AS MATERIALIZED (SELECT ll.id, min(p.id) AS parent FROM ll JOIN ln ON ln.target = ll.id JOIN ll p ON p.id = ln.source AND p.level = ll.level - 1 GROUP BY ll.id),
      cut AS MATERIALIZED (SELECT DISTINCT parent AS d FROM pa WHERE parent NOT IN (SELECT id FROM st)),
      wo AS (SELECT d, st.id FROM cut, st UNION SELECT d, ln.target FROM wo JOIN ln ON ln.source = wo.id WHERE ln.target <> d),
      am AS (SELECT id, parent AS d FROM pa UNION SELECT am.id, pa.parent FROM am JOIN pa ON pa.id = am.d),
      dm AS (SELECT am.id, am.d FROM am WHERE am.d IN (SELECT id FROM st) OR NOT EXISTS (SELECT 1 FROM wo WHERE wo.d = am.d AND wo.id = am.id))
      SELECT dm.id, arg_max(dm.d, ll.level) AS idom FROM dm JOIN ll ON ll.id = dm.d GROUP BY dm.id"""


#: sd: shortest-path links of each of the 500 least nodes; eb: the summed dependencies of the links.
BETWEENNESS = """ln AS MATERIALIZED (SELECT DISTINCT source, target FROM ge WHERE source <> target), sr AS MATERIALIZED (SELECT id AS s FROM gn ORDER BY id LIMIT 500),
  ds(s, id, d) USING KEY (s, id) AS (SELECT s, s, 0 FROM sr UNION SELECT w.s, ln.target, min(w.d) + 1 FROM ds w JOIN ln ON ln.source = w.id LEFT JOIN recurring.ds o ON o.s = w.s AND o.id = ln.target WHERE o.id IS NULL GROUP BY w.s, ln.target),
  dd AS MATERIALIZED (SELECT s, id, d FROM ds), sd AS MATERIALIZED (SELECT x.s, x.id AS u, y.id AS v, x.d FROM dd x JOIN ln ON ln.source = x.id JOIN dd y ON y.s = x.s AND y.id = ln.target AND y.d = x.d + 1),
  sg AS (SELECT s, s AS id, 0 AS d, 1.0::DOUBLE AS n FROM sr UNION ALL SELECT sg.s, sd.v, any_value(sg.d) + 1, sum(sg.n) FROM sg JOIN sd ON sd.s = sg.s AND sd.u = sg.id GROUP BY sg.s, sd.v),
  gs AS MATERIALIZED (SELECT s, id, d, n FROM sg), top AS MATERIALIZED (SELECT max(d) AS d FROM gs),
  dl AS (SELECT gs.s, gs.id, gs.d, gs.n, 0.0::DOUBLE AS dep FROM gs, top WHERE gs.d = top.d
    UNION ALL SELECT g.s, g.id, g.d, any_value(g.n), coalesce(sum(any_n / w.n * (1 + w.dep)), 0) FROM (SELECT gs.*, gs.n AS any_n, lo.d AS below FROM gs JOIN (SELECT min(d) AS d FROM dl) lo ON gs.d = lo.d - 1) g
      LEFT JOIN sd ON sd.s = g.s AND sd.u = g.id LEFT JOIN dl w ON w.s = g.s AND w.id = sd.v GROUP BY g.s, g.id, g.d),
  eb AS MATERIALIZED (SELECT sd.u AS source, sd.v AS target, sum(a.n / b.n * (1 + b.dep)) AS x FROM sd JOIN dl a ON a.s = sd.s AND a.id = sd.u JOIN dl b ON b.s = sd.s AND b.id = sd.v GROUP BY 1, 2),
  bs AS MATERIALIZED (SELECT source, target, x * ((SELECT count(*) FROM gn) / least(500.0, (SELECT count(*) FROM gn))) / ((SELECT count(*) FROM gn) * ((SELECT count(*) FROM gn) - 1.0)) AS betweenness FROM eb)"""

#: The same with every node a source.
BETWEENNESS_WHOLE = BETWEENNESS.replace(" ORDER BY id LIMIT 500", "").replace("least(500.0, (SELECT count(*) FROM gn))", "(SELECT count(*) FROM gn)")


def _cut(picked: str, order: str, kind: str) -> str:
    b = context.BUDGETS[kind]
    return f"""nn AS MATERIALIZED (SELECT id FROM ({picked}) ORDER BY {order} LIMIT {b.max_nodes}), ee2 AS MATERIALIZED (SELECT source, target, relation FROM ge WHERE source IN (SELECT id FROM nn) AND target IN (SELECT id FROM nn) ORDER BY source, target LIMIT {b.max_edges})"""


_LINES = """SELECT row_number() OVER (ORDER BY lower(label), gn.id)::INTEGER AS ord, '- **' || label || '** (' || coalesce(kind, 'node') || ') ' || coalesce(source_file, '') || coalesce(' [community ' || cm.c || ']', '') AS line
      FROM gn LEFT JOIN cm ON cm.node_id = gn.id WHERE gn.id IN (SELECT id FROM nn)
    UNION ALL SELECT (1000000 + row_number() OVER (ORDER BY source, target))::INTEGER, source || ' --' || relation || '--> ' || target FROM (SELECT * FROM ee2 ORDER BY source, target LIMIT 50)"""


def contexts(question: str, g: str, flags: str) -> dict[str, str]:
    terms = X.query_terms(question)
    m = " + ".join(f"coalesce(contains(lower(label), '{t}')::INT, 0)" for t in terms)
    rel = f"""o AS (SELECT source AS id, sum(confidence_score * 0.5) AS o FROM ge GROUP BY 1), rl AS MATERIALIZED (SELECT gn.id, label, {m} AS match, round({m} + CASE WHEN degree > 10 THEN 1.0 ELSE 0.0 END + coalesce(o, 0), 6)::DOUBLE AS relevance FROM gn JOIN dg USING (id) LEFT JOIN o USING (id)),
      nc AS (SELECT * FROM communities WHERE community_id <> 0), c1 AS (SELECT node_id, min(community_id) AS c FROM nc WHERE node_id IS NOT NULL GROUP BY node_id)"""
    gods = lambda k: f"(SELECT id FROM fl WHERE degree > 0 AND NOT is_file AND NOT is_concept ORDER BY degree DESC, id LIMIT {k})"
    seeds = lambda k: f"(SELECT id FROM rl WHERE match > 0 ORDER BY match DESC, id LIMIT {k})"
    scored = lambda ids: f"SELECT DISTINCT i.id, coalesce(relevance, 0) AS relevance FROM ({ids}) i LEFT JOIN rl ON rl.id = i.id"
    aware = f"SELECT node_id AS id FROM c1 WHERE c IN (SELECT c FROM c1 WHERE node_id IN {seeds(1)}) UNION {gods(5)} UNION {seeds(1)}"
    two = f"""sd AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY match DESC, id) AS rn FROM rl WHERE match > 0), ln AS MATERIALIZED (SELECT DISTINCT source, target FROM ge),
      lv AS (SELECT id, 0 AS k FROM sd WHERE rn = 1 UNION SELECT ln.target, k + 1 FROM lv JOIN ln ON ln.source = lv.id WHERE k < 24), ll AS MATERIALIZED (SELECT id, min(k) AS level FROM lv GROUP BY id),
      bk AS (SELECT id, level FROM ll WHERE id IN (SELECT id FROM sd WHERE rn = 2) UNION ALL SELECT p, lev FROM (SELECT min(ll.id) AS p, any_value(ll.level) AS lev FROM bk JOIN ln ON ln.target = bk.id JOIN ll ON ll.id = ln.source AND ll.level = bk.level - 1 GROUP BY bk.id)),
      pa AS MATERIALIZED (SELECT id FROM bk)"""
    path = f"SELECT id FROM pa UNION SELECT neighbour FROM adj WHERE node IN (SELECT id FROM pa) UNION SELECT id FROM ({aware}) WHERE NOT EXISTS (SELECT 1 FROM pa)"
    reached = f"st AS MATERIALIZED (SELECT id FROM rl WHERE match > 0 ORDER BY relevance DESC, id LIMIT 3), rr AS (SELECT id FROM st UNION SELECT ge.target FROM rr JOIN ge ON ge.source = rr.id)"
    centre = "SELECT node_id AS id FROM (SELECT m.community_id, m.node_id, row_number() OVER (PARTITION BY m.community_id ORDER BY coalesce(degree, 0) DESC, pos, m.node_id DESC) AS rn FROM nc m LEFT JOIN dg ON dg.id = m.node_id) WHERE rn = 1"
    base = f"WITH RECURSIVE {g}, {flags}, {rel}"
    by = "relevance DESC, id"
    return {
        "context_community_aware": f"{base}, {_cut(scored(aware), by, 'module')} {_LINES}",
        "context_path_based": f"{base}, {two}, {_cut(scored(path), by, 'cross_module')} {_LINES}",
        "context_relevance_weighted": f"{base}, {reached}, {_cut(scored('SELECT id FROM rr'), by, 'exploratory')} {_LINES}",
        "context_architectural": f"{base}, {SIMPLE}, {COMPONENTS}, {FOREST}, {BLOCKS}, {_cut(f'SELECT DISTINCT id FROM ({gods(10)} UNION (SELECT id FROM ap ORDER BY id LIMIT 10) UNION {centre})', 'id', 'architectural')} {_LINES}",
    }


def oracle(g: str, flags: str, question: str, start: str, end: str, explained: str, asked: list[str]) -> dict[str, str]:
    graph = f"WITH RECURSIVE {g}, {SIMPLE}, {COMPONENTS}"
    blocks = f"{graph}, {FOREST}, {BLOCKS}"
    return {
        "connected_components": f"{graph} SELECT id AS node, c AS component FROM cc",
        "articulation_points": f"{blocks} SELECT id, n_blocks FROM ap",
        "biconnected_components": f"{blocks} SELECT block, id FROM bc",
        "dominators": dominators(start, g),
        "edge_betweenness": f"WITH RECURSIVE {g}, {BETWEENNESS} SELECT source, target, round(betweenness, 12) AS betweenness FROM bs",
        "bridge_nodes": f"""{blocks}, {BETWEENNESS_WHOLE}, pn AS (SELECT id, sum(betweenness) AS b FROM (SELECT source AS id, betweenness FROM bs UNION ALL SELECT target, betweenness FROM bs) GROUP BY id)
            SELECT ap.id, n_blocks, round(coalesce(b, 0), 9) AS betweenness, CASE WHEN cm.c IS NULL THEN [] ELSE [cm.c] END AS communities FROM ap LEFT JOIN pn USING (id) LEFT JOIN cm ON cm.node_id = ap.id""",
        "path_query": path_query(start, end, g),
        "explain_node": explain_node(explained, g),
        "complexity": complexity(asked, g),
        **contexts(question, g, flags),
    }
