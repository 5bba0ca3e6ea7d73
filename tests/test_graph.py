import pytest
from pyspark.sql import functions as F

from kgweave.operators import analysis, community, components, context, graph, infer, kernels, traverse
from kgweave.operators.graph import Graph


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ids(df, c="id"):
    return {r[c] for r in df.collect()}


@pytest.fixture()
def make(nodes, edges):
    return lambda ns, es, directed=False: graph.build_graph(nodes(*ns), edges(*es), directed)


@pytest.fixture()
def comm(spark):
    return lambda *r: spark.createDataFrame([(c, n, k) for k, (c, n) in enumerate(r)], "community_id int, node_id string, pos int")


def test_build_last_edge_and_first_extraction_win(nodes, edges):
    n = nodes(("a", "Original")).unionByName(nodes(("a", "Updated"), seq=2))
    e = edges(("a", "b", " CALLS ")).unionByName(edges(("a", "b", "imports"), ("", "b"), (None, "b"), seq=3))
    g = graph.build_graph(n.withColumn("degree", F.lit(1)), e)
    assert [r["label"] for r in g.nodes.collect()] == ["Original"] and [r["relation"] for r in g.edges.collect()] == ["imports"]
    assert rows(graph.degrees(g)) == [("a", 1), ("b", 1)]


def test_degrees_neighbours_stats(make):
    g = make("abcd", [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("a", "ghost"), ("d", "d")])
    d = dict(rows(graph.degrees(g)))
    assert d == {"a": 4, "b": 2, "c": 2, "d": 2, "ghost": 1}
    assert {(r["node"], r["neighbour"]) for r in graph.neighbours(g).where("node = 'a'").collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    assert graph.god_nodes(g, 2).collect()[0]["id"] == "a" and graph.god_nodes(g, 2).count() == 2
    empty = make([], [])
    assert graph.graph_stats(empty).first()["average_degree"] == 0.0 and graph.degrees(empty).count() == 0


def test_file_and_concept_nodes(make):
    g = make([("t", "test.hs"), ("m", ".foo()"), ("f", "func"), ("c", "C", ""), ("p", "P", "model.py")], [("t", "f")])
    got = {r["id"]: (r["is_file"], r["is_concept"]) for r in graph.described_nodes(g).collect()}
    assert got["t"][0] and got["m"][0] and not got["f"][0] and got["c"][1] and not got["p"][1]
    assert "t" not in ids(graph.god_nodes(g))


def test_merge_and_diff(make):
    old, new = make([("a", "Original"), "b"], [("a", "b")]), make([("a", "Updated"), "b", "c"], [("a", "b"), ("b", "c")])
    m = graph.merge_graphs(old, new)
    assert {r["id"]: r["label"] for r in m.nodes.collect()} == {"a": "Original", "b": "b", "c": "c"} and m.edges.count() == 2
    diff = graph.graph_diff(old, new)
    assert rows(diff) == [("new_edge", "b", "c"), ("new_node", "c", None)]
    assert graph.diff_summary(diff) == "1 new node, 1 new edge" and graph.diff_summary(graph.graph_diff(old, old)) == "no changes"
    again = graph.merge_graphs(m, m)
    assert rows(again.nodes) == rows(m.nodes) and rows(again.edges) == rows(m.edges)


def test_subgraph_and_validation(spark, nodes, edges, make):
    g = make("abc", [("a", "b"), ("b", "c")])
    sub = graph.subgraph(g, spark.createDataFrame([("a",), ("b",), ("b",)], "id string"))
    assert ids(sub.nodes) == {"a", "b"} and sub.edges.count() == 1
    h = spark.createDataFrame([("h", ["a", "b"]), ("i", None)], "id string, nodes array<string>")
    bad = graph.validate_extraction(nodes(("a", "L"), ("b", "L"), ("", "x")), edges(("a", ""), ("a", "b")).withColumn("confidence_score", F.lit(1.5)), h)
    assert {r["rule"] for r in bad.collect()} == {"duplicate_label", "empty_node_id", "empty_end", "score_out_of_range", "small_hyperedge"}


def test_cohesion_centroid_super_graph(make, comm):
    g = make("abcd", [("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("b", "a")])
    c = comm((1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "zz"))
    assert {r["community_id"]: r["score"] for r in graph.cohesion(g, c).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}
    assert {r["community_id"]: r["node_id"] for r in graph.centroids(g, c).collect()}[1] == "a"
    assert rows(graph.super_edges(g, c)) == [(1, 2, 1, "b")]
    assert {r["community_id"]: r["label"] for r in graph.super_nodes(g, c).collect()} == {1: "a, b", 2: "c, d", 3: "zz"}


def test_reach_and_paths(spark, make):
    g = make("abcde", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    seed = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["level"] for r in traverse.reach(g, seed).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert ids(traverse.reach(g, seed, 1)) == {"a", "b"} and ids(traverse.reach(g, seed, 1, "both")) == {"a", "b", "c"}
    assert traverse.shortest_path(g, "a", "d") == ["a", "b", "c", "d"] and traverse.shortest_path(g, "d", "a") is None and traverse.shortest_path(g, "e", "e") == ["e"]


def components_of(pairs, nodes):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in pairs:
            m = min(comp[u], comp[v])
            if comp[u] != m or comp[v] != m:
                comp[u] = comp[v] = m
                changed = True
    return comp


def test_components_blocks_articulation(spark, make):
    es = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("x", "y"), ("x", "x")]
    g = make("abcdefgxyz", es)
    got = {r["node"]: r["component"] for r in components.connected_components(g.edges).collect()}
    assert got == components_of(es, {x for e in es for x in e})
    points = {r["id"]: r["n_blocks"] for r in kernels.articulation_points(g).collect()}
    want = set()
    ns = sorted({x for e in es for x in e})
    for n in ns:
        rest = [(u, v) for u, v in es if n not in (u, v)]
        left = [x for x in ns if x != n]
        comp, whole = components_of(rest, left), components_of(es, ns)
        if len({comp[x] for x in left if whole[x] == whole[n]}) > 1:
            want.add(n)
    assert set(points) == want == {"c", "d", "f"}
    blocks = {frozenset(r["n"]) for r in kernels.biconnected_components(g).groupBy("block").agg(F.collect_set("id").alias("n")).collect()}
    assert blocks == {frozenset("abc"), frozenset("cd"), frozenset("def"), frozenset("fg"), frozenset("xy")}
    assert kernels.articulation_points(make("ab", [])).count() == 0


def test_dominators_and_betweenness(make):
    g = make("abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "b")])
    assert dict(rows(kernels.dominators(g, "a"))) == {"b": "a", "c": "a", "d": "a"}
    chain = make("abc", [("a", "b"), ("b", "c")])
    assert {(r[0], r[1]): round(r[2], 6) for r in kernels.edge_betweenness(chain).collect()} == {("a", "b"): round(2 / 6, 6), ("b", "c"): round(2 / 6, 6)}


def test_betweenness_has_no_bound_of_links(spark, make, monkeypatch):
    star = Graph(spark.createDataFrame([("a",)], "id string"), spark.range(2_000_001).select(F.lit("a").alias("source"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("target")))
    assert kernels.edge_betweenness(star).agg(F.count(F.lit(1)), F.min("betweenness"), F.max("betweenness")).first()[:] == (2_000_001, 1.0, 1.0)
    es = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("e", "x"), ("y", "a")]
    adj = {u: [w for v, w in es if v == u] for u, _ in es}
    want = {}
    for s in "abcde":
        for k, c in kernels.source_dependencies(adj, s).items():
            want[k] = want.get(k, 0) + c / 20
    monkeypatch.setattr(kernels, "AT_ONCE", 2)
    got = {(r[0], r[1]): r[2] for r in kernels.edge_betweenness(make("abcde", es)).collect()}
    assert got == pytest.approx(want)


def test_bridge_nodes_take_every_node_as_a_source(make, comm, monkeypatch):
    names = [f"n{k:03d}" for k in range(503)]
    es = [(names[501], names[0]), (names[500], names[501]), (names[502], names[501])]  # the last ids alone lead to others
    got = {r["id"]: r["betweenness"] for r in kernels.bridge_nodes(make(names, es), comm((1, names[501]))).collect()}
    # links: 1 from n501, 2 + 1 from n500 and n502
    assert got == {names[501]: round((1 + 2 * 3) / (503 * 502), 9)}


def test_communities_cover_every_node_once(make):
    es = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    g = make("abcdefz", es)
    for mode in ("exact", "distributed"):
        r = community.detect_communities(g, mode=mode).collect()
        assert sorted(x["node_id"] for x in r) == sorted("abcdefz") and min(x["community_id"] for x in r) == 1
    assert community.merge_small({"a": ["b"], "b": ["a", "c"], "c": ["b"]}, {"a": 0, "b": 1, "c": 2}, 3) in ({"a": 0, "b": 0, "c": 0}, {"a": 1, "b": 1, "c": 1}, {"a": 2, "b": 2, "c": 2})


def test_communities_are_the_same_at_every_size(make, monkeypatch):
    import random

    rng = random.Random(4)
    names = [f"n{k:03d}" for k in range(150)]
    groups = [names[k : k + 12] for k in range(0, 120, 12)]
    es = [tuple(rng.sample(g, 2)) for g in groups for _ in range(30)] + [(rng.choice(names[:120]), rng.choice(names[:120])) for _ in range(50)]
    es += [("n005", x) for x in names[20:90:2]] + list(zip(names[130:137], names[131:138])) + [("n140", "n141"), ("n142", "n003"), ("n007", "n007")]  # hub, path, pair, leaf, loop; the rest unlinked
    for limits in ((500_000, 10_000, 50), (60, 20, 5)):  # one block, and many with hubs
        for name, x in zip(("BLOCK_LINKS", "HUB_LINKS", "BUCKET"), limits):
            monkeypatch.setattr(community, name, x)
        both = [sorted(map(tuple, community.detect_communities(make(names, es), mode=m).collect())) for m in ("exact", "distributed")]
        assert both[0] == both[1]
    sizes = {}
    for c, _ in both[1]:
        sizes[c] = sizes.get(c, 0) + 1
    assert min(sizes.values()) >= community.MIN_SIZE



def test_rounds_that_repeat_are_left_out(monkeypatch):
    import random

    def plain(adj, rounds):  # the definition, every round of it
        comm, deg, n = list(range(len(adj))), [len(x) for x in adj], len(adj)
        m = sum(deg) / 2
        for _ in range(rounds):
            total = {c: float(sum(deg[u] for u in range(n) if comm[u] == c)) for c in set(comm)}
            for u in range(n):
                inside = {}
                for v in adj[u]:
                    inside[comm[v]] = inside.get(comm[v], 0) + 1
                score = {c: k / m - total[c] * deg[u] / (2 * m * m) for c, k in inside.items()}
                if score and max(score.values()) > 0:
                    comm[u] = max(score, key=score.get)
            fresh, changed = max(comm) + 1, False
            for c in sorted(set(comm)):
                own = [u for u in range(n) if comm[u] == c]
                well = [u for u in own if sum(comm[v] == c for v in adj[u]) > 0.5 * max(1, deg[u])]
                if well and len(well) < len(own) // 2:
                    for u in well:
                        comm[u] = fresh
                    fresh, changed = fresh + 1, True
            if not changed:
                break
        return comm

    places = lambda comm: [sorted(set(comm)).index(c) for c in comm]
    swept, count = [0], community._count_elements
    monkeypatch.setattr(community, "_count_elements", lambda *x: (swept.__setitem__(0, swept[0] + 1), count(*x)))
    fewer = 0
    for seed in range(10):
        rng, n = random.Random(seed), 60
        es = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(240)}
        adj = [sorted({a + b - u for a, b in es if u in (a, b)}) for u in range(n)]
        swept[0] = 0
        got = community.local_moving(dict(enumerate(adj)))
        assert places([got[u] for u in range(n)]) == places(plain(adj, community.MAX_ROUNDS)), seed
        fewer += plain(adj, 49) != plain(adj, 50) and swept[0] < 50 * n  # it would go on
    assert fewer


def test_inference(make, comm):
    g = make([("a", "Auth"), ("b", "Db"), ("c", "Router"), ("d", "auth", "docs/auth.md", "document")], [("a", "b", "imports"), ("b", "c", "imports"), ("x", "b", "imports")])
    assert {(r[0], r[1]) for r in infer.transitive_dependencies(g).collect()} == {("a", "c"), ("x", "c")}
    assert {(r[0], r[1]) for r in infer.transitive_dependencies(g, "codependent").collect()} == {("a", "x"), ("x", "a")}
    assert rows(infer.codependent_groups(g)) == [("b", "a", 2), ("b", "x", 2)]
    links = infer.code_document_links(g).collect()
    assert [(r["source"], r["target"], r["source_file"]) for r in links] == [("a", "d", "inferred:code-doc-name")]
    c = comm((1, "a"), (2, "c"), (3, "b"))
    assert {(r[0], r[1]) for r in infer.community_bridges(g, c).collect()} == {("a", "c")}
    assert infer.infer_edges(g, c, "Normal").count() >= 2
    with pytest.raises(ValueError):
        infer.infer_edges(g, c, "other")


def test_bridges_between_many_communities_are_not_shuffled(make, comm, monkeypatch):
    monkeypatch.setattr(infer, "BRIDGE_BLOCK", 64)
    names = [f"n{k:03d}" for k in range(150)]
    es = [(names[0], x) for x in names[50:120:3]] + [(names[140], names[3]), (names[149], names[63])]
    es += [("n001", "m", "imports"), ("m", "n070", "imports"), ("n080", "m", "imports")]
    member = [(k, x) for k, x in enumerate(names)] + [(200, names[7]), (201, names[149]), (202, names[7])]  # two lead several
    g, c = make([*names, "m"], es), comm(*member)
    known = {x for e in es for x in (e[:2], e[1::-1])}
    want = {(a, b) for i, a in member for j, b in member if i < j and a != b and (a, b) not in known}
    bridges = infer.community_bridges(g, c)
    got = [(r[0], r[1]) for r in bridges.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = bridges._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan  # neither shuffled nor made distinct
    other = {("n001", "n070"), ("n080", "n070")}
    rows_ = [(r["source"], r["target"], r["relation"]) for r in infer.infer_edges(g, c).collect()]
    assert len(rows_) == len(want | other) and {x[:2] for x in rows_ if x[2] == "depends_on"} == other and {x[:2] for x in rows_} == want | other


def test_shared_context_skips_hubs(make):
    es = [(h, n) for n in "pq" for h in "xyz"] + [("hub", f"n{k:02d}") for k in range(65)]
    got = infer.shared_context(make([], es), 3).collect()
    assert [(r["source"], r["target"], round(r["confidence_score"], 2)) for r in got if r["source"] == "p"] == [("p", "q", 0.6)]
    assert not [r for r in infer.shared_context(make([], es + [("hub2", "n00"), ("hub2", "n01")]), 2).collect() if r["source"].startswith("n")]


def test_surprises_and_questions(make, comm):
    g = make([("a", "A", "x.py"), ("b", "B", "doc.md"), ("c", "C", "y.py")], [("a", "b", "semantically_similar_to", "AMBIGUOUS"), ("a", "c", "calls"), ("b", "c", "imports")])
    c = comm((1, "a"), (2, "b"), (1, "c"))
    got = analysis.cross_file_surprises(g, c).collect()
    assert [(r["source"], r["target"], r["score"]) for r in got] == [("a", "b", 3 + 4 + 2 + 1), ("a", "c", 1)]
    assert [r["kind"] for r in analysis.suggested_questions(g, c).collect()][0] == "ambiguous_edge"
    assert analysis.cross_community_surprises(g, c).count() == 1
    labels = {r["community_id"]: r["label"] for r in analysis.community_labels(g, comm((1, "a"), (2, "zz"))).collect()}
    assert labels == {1: "Unnamed Community", 2: "Unnamed Community"}


def test_questions_to_context(make, comm):
    g = make([("m", "AuthModule"), ("d", "Database"), ("r", "Router")], [("m", "d"), ("d", "r")])
    c = comm((1, "m"), (1, "d"), (2, "r"))
    assert [r["id"] for r in context.seeds(g.nodes, "Auth").collect()] == ["m"] and context.seeds(g.nodes, "ZZZZnotfound").count() == 0
    assert context.path_query(g, "authmodule", "router") == ["m", "d", "r"] and context.path_query(g, "authmodule", "none") is None
    assert context.classify_complexity(g.nodes, "connectToDatabase") == "focused" and context.classify_complexity(g.nodes, "how does the architecture work") == "architectural"
    for kind in context.BUDGETS:
        sub = context.select_context(g, c, "auth database", complexity=kind)
        assert ids(sub.nodes) <= {"m", "d", "r"} and sub.nodes.count() >= 1
    text = context.format_context(sub, c, "q")
    assert "AuthModule" in text and text.startswith("# Context: q")
    assert {r["neighbour"] for r in context.explain(g, c, "database").collect()} == {"m", "r"} and context.explain(g, c, "zzzz").count() == 0


def test_conversations(spark, comm):
    conv = spark.createDataFrame([("c1", "about parsers", None, "t", ["a", "", None, "a"], 3), ("c1", "about parsers", None, "t", ["a", "", None, "a"], 3), (None, "x", None, None, None, None)], "id string, question string, summary string, timestamp string, relevant_nodes array<string>, tokens_used int")
    assert [tuple(r)[:2] for r in context.conversation_edges(conv).collect()] == [("c1", "a")] and context.conversation_nodes(conv).count() == 1
    assert [tuple(r) for r in context.search_conversations(conv, "the parser").collect()] == [("c1", "about parsers", 3)]
    assert rows(context.with_chat_community(comm((1, "A")), conv)) == [(0, "c1", 0), (1, "A", 0)]


def test_top_per_group_in_two_steps(spark):
    df = spark.createDataFrame([("g", k) for k in range(100)], "g string, v int")
    assert [(r["v"], r["rn"]) for r in graph.top_per_group(df, ["g"], [F.col("v").desc()], 3).orderBy("rn").collect()] == [(99, 1), (98, 2), (97, 3)]


def test_directed_graph(make):
    assert dict(rows(graph.degrees(make("ab", [("a", "b")], True)))) == {"a": 1, "b": 0}
    assert isinstance(make("a", []), Graph)
