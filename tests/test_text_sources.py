import io
import json
import time

from pyspark.sql import functions as F

from kgweave import pipeline, schema, tools
from kgweave.functions import text as X
from kgweave.operators.graph import Graph
from kgweave.sinks import export
from kgweave.sources import detect, extract, graph_json
from kgweave.streaming import watcher


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.token_estimate, "hello world") == 3 and one(spark, X.token_estimate, "") == 0
    assert one(spark, X.normalize_for_search, "Ærøskøbing Straße") == "aroskobing strase"
    h = 0
    for ch in "src/a/":
        h = (h * 31 + ord(ch)) % 65536
    assert one(spark, X.stub_id, "src/a/File.test.ts") == f"{h:05d}_File"
    assert one(spark, X.file_base_name, "a/Data.Map.hs") == "Map" and one(spark, X.short_path, "a/b/c") == "b/c" and one(spark, X.short_path, "c") == "c"
    assert one(spark, X.url_type, "https://arxiv.org/abs/1.pdf") == "arxiv" and one(spark, X.url_type, "https://netflix.com") == "twitter"
    assert [tuple(r) for r in one(spark, X.headers, "# A\n##### deep\ntext\n  ##B")] == [(1, "A", 1), (4, "# deep", 2), (2, "B", 4)]
    assert one(spark, X.tags, "see #tag-1 and #x\n#line #tag-1") == ["tag-1"] and one(spark, X.wiki_links, "[[A|b]] [[C]]") == ["A", "C"]
    assert one(spark, X.paper_score, None) == 0 and one(spark, X.paper_score, "arXiv: doi 10.1000/xyz Abstract, et al. References") == 5
    assert one(spark, X.sanitize_label, "<a>\x01&'") == "&lt;a&gt;&amp;&#39;" and one(spark, X.valid_graph_path, "a/../b") is False and one(spark, X.valid_url, "ftp://x") is False


def test_codec(spark, edges):
    e = spark.createDataFrame([(r.upper(), c) for r in schema.RELATIONS for c in schema.CONFIDENCES], "relation string, confidence string")
    got = e.select(schema.clean("relation").alias("r"), schema.confidence_rank().alias("k"), schema.confidence_score().alias("s"))
    assert {r["r"] for r in got.collect()} == set(schema.RELATIONS) and {(r["k"], r["s"]) for r in got.collect()} == {(0, 1.0), (1, 0.7), (2, 0.2)}
    assert schema.bad_values(edges(("a", "b", "odd"))).count() == 1


def test_detection(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for p, t in (("src/a.py", "def f():\n    pass\n"), ("src/b.md", "# T\n#x #tag [[L]]"), ("node_modules/c.js", ""), ("src/d.xyz", "")):
        (tmp_path / p).write_text(t)
    found = detect.scan(spark, str(tmp_path))
    assert {(r["path"].rsplit("/", 1)[1], r["category"]) for r in found.collect()} == {("a.py", "code"), ("b.md", "document")}
    assert detect.scan(spark, str(tmp_path / "none")).count() == 0 and detect.corpus_warning(0) and detect.corpus_warning(201) and not detect.corpus_warning(5)
    pats = detect.parse_ignore("# c\nbuild/\n*.min.js\nsrc/*.log\nREADME\n")
    assert [k for k, _ in pats] == ["prefix", "suffix", "glob", "exact"]
    df = spark.createDataFrame([("build/a",), ("x/a.min.js",), ("src/x.log",), ("a/README",), ("src/keep.py",)], "path string")
    assert [r[0] for r in df.where(~detect.ignored(pats)).collect()] == ["src/keep.py"]
    assert spark.createDataFrame([("a/.env",), ("a/x.py",)], "path string").select(detect.sensitive()).collect()[0][0] is True
    assert detect.merge_config({"lsp": {"a": 1}, "x": {"p": 1}}, {"lsp": {"b": 2}, "x": {"q": 1}}) == {"lsp": {"a": 1, "b": 2}, "x": {"q": 1}}
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, content string")
    manifest = spark.createDataFrame([("a", "x"), ("z", "y")], "path string, hash string")
    assert {tuple(r) for r in detect.changed_files(files, manifest).collect()} == {("a", "modified"), ("b", "added"), ("c", "added"), ("z", "removed")}
    assert detect.read_text(spark, str(tmp_path / "src" / "a.py")).count() == 1 and detect.read_manifest(spark, str(tmp_path / "no")).count() == 0


def test_extraction(spark):
    files = spark.createDataFrame([("m/a.hs", "module A.B where\nimport qualified Data.Map as M\ndata T = T\nf :: Int -> Int\nf x = x"), ("m/bad.hs", None)], "path string, content string")
    assert {(r["part"], r["name"]) for r in extract.haskell_lines(files).collect()} == {("module", "A.B"), ("import", "Data.Map"), ("declaration", "T"), ("declaration", "f")}
    assert extract.haskell_edges(files).count() == 3 and extract.haskell_nodes(files).count() == 4
    py = spark.createDataFrame([("p.py", "class A:\n    def m(self):\n        pass\n\ndef g():\n    pass\n"), ("q.py", "def ("), ("r.py", None)], "path string, content string")
    assert [(r["name"], r["kind"], r["parent"]) for r in extract.python_definitions(py).collect()] == [("A", "Class", None), ("m", "Method", "A"), ("g", "Function", None)]
    nested = [{"name": "A", "kind": 5, "range": {"start": {"line": 0, "character": 0}, "end": {"line": 9, "character": 0}}, "children": [{"name": "", "children": [{"name": "b", "kind": 6, "range": {"start": {"line": 1, "character": 0}, "end": {"line": 2, "character": 0}}}]}]}]
    s = extract.flatten_symbols(spark.createDataFrame([("x.ts", json.dumps(nested)), ("y.ts", "no json"), ("z.ts", None)], "path string, response string"))
    assert [(r["name"], r["kind"]) for r in s.orderBy("seq").collect()] == [("A", 5), ("b", 6)]
    assert [r["kind"] for r in extract.symbol_nodes(s).orderBy("id").collect()] == ["Class", "Method"] and extract.symbol_edges(s).count() == 3
    ws = spark.createDataFrame([(json.dumps([{"name": "a", "kind": 12, "location": {"uri": "file:///p/x.ts"}}, {"name": ""}]),)], "response string")
    assert [tuple(r) for r in extract.workspace_symbols(ws).collect()] == [("/p/x.ts", "a", 12)]


def test_graph_document_round_trip(spark, nodes, edges, tmp_path):
    n, e = nodes(("a", 'A"x'), "b").drop("extraction_seq"), edges(("a", "b")).drop("extraction_seq")
    c = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "community_id int, node_id string, pos int")
    path = str(tmp_path / "graph.json")
    graph_json.write_graph_json(Graph(n, e), c, path)
    g, back = graph_json.read_graph_json(spark, path)
    assert sorted(map(tuple, g.nodes.collect())) == sorted(map(tuple, n.collect())) and g.edges.count() == 1 and sorted(map(tuple, back.collect())) == [(1, "a", 0), (1, "b", 1)]
    graph_json.write_tables(Graph(n, e), c, str(tmp_path / "t"))
    assert graph_json.read_tables(spark, str(tmp_path / "t"))[0].nodes.count() == 2


def test_exports(spark, nodes, edges):
    g = Graph(nodes(("a", "it's <A>"), ("b", "same"), ("c", "same")), edges(("a", "b"), ("a", "ghost")))
    c = spark.createDataFrame([(1, "a", 0)], "community_id int, node_id string, pos int")
    assert "it''s" in export.cypher_nodes(g.nodes).where("id = 'a'").first()["statement"]
    assert export.page_edges(g).count() == 1 and export.svg_document(g, c).count("<circle") == 3
    assert len({r["file"] for r in export.vault_notes(g, c).collect()}) == 3
    xml = "\n".join(r["line"] for r in export.graphml_lines(g).orderBy("ord").collect())
    import xml.dom.minidom as m

    assert len(m.parseString(xml).getElementsByTagName("node")) == 3
    assert "3 nodes, 2 edges" in export.report(g, c)
    assert [r["id"] for r in export.search_notes(g.nodes, "SAME").collect()] == ["b", "c"] and export.search_notes(g.nodes, "s").count() == 0
    assert dict(map(tuple, export.one_hop(g, g.nodes.where("id = 'a'")).collect())) == {"a": "match", "b": "neighbour", "c": "dim"}
    runs = spark.createDataFrame([("1", 5, 1, 1), ("2", 7, 2, 1)], schema.COST_RUN)
    assert [r["total_input"] for r in export.cost_totals(runs).orderBy("date").collect()] == [5, 12]


def test_tools_loop(spark, nodes, edges):
    g = Graph(nodes(("a", "Alpha"), ("b", "Beta")), edges(("a", "b")))
    w = tools.Workspace(g, spark.createDataFrame([(1, "a", 0)], "community_id int, node_id string, pos int"))
    ask = lambda method, **a: tools.handle(w, json.dumps({"id": 1, "method": "tools/call", "params": {"name": method, "arguments": a}}))
    assert ask("get_node", id="a")["result"]["label"] == "Alpha" and ask("get_node", id="zz")["error"]["code"] == -32602
    assert [r["id"] for r in ask("get_neighbors", id="a")["result"]] == ["b"] and ask("path", start="alpha", end="beta")["result"]["hops"] == 1
    assert ask("nothing")["error"]["code"] == -32601 and tools.handle(w, "{")["error"]["code"] == -32700
    assert ask("get_community", community_id=1)["result"]["size"] == 1 and ask("graph_statistics")["result"]["n_nodes"] == 2 and ask("bridges")["result"]["count"] == 0
    assert "Alpha" in ask("select_context", question="alpha")["result"]["text"] and ask("query", question="alpha")["result"]["nodes"]
    assert ask("add_conversation", question="what is alpha", timestamp="2025-01-01T00:00:00Z")["result"]["id"] == "conv_20250101T000000Z"
    assert ask("conversation_history", question="alpha")["result"][0]["score"] == 3
    out = io.StringIO()
    tools.serve(w, ['{"id": 2, "method": "tools/list"}\n', "\n"], out)
    assert "get_node" in json.loads(out.getvalue())["result"]["tools"]


def test_watcher_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("1")
    seen = []
    q = watcher.watch_directory(spark, str(src), seen.extend, str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        (src / "b.txt").write_text("2")
        time.sleep(0.3)
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(p.rsplit("/", 1)[1] for p in seen) == ["a.txt", "b.txt"]


def test_pipeline(spark):
    files = spark.createDataFrame([("r/a.py", "class A:\n    def m(self):\n        pass\n"), ("r/a.md", "# A\ntext"), ("r/b.hs", "module B where\nimport Data.Map\n"), ("r/c.ts", "x")], "path string, content string")
    r = pipeline.run(files)
    assert r.graph.nodes.count() >= 8 and r.graph.edges.count() >= 4
    assert r.communities.select("node_id").distinct().count() == r.communities.count() == r.graph.nodes.count()
