import json
import os

import pytest

from kgweave import __main__ as cli
from kgweave import config, tools
from kgweave.operators import community, graph, kernels
from kgweave.sinks import page, stores, vault
from kgweave.sources import code, detect, graph_json, ingest
from kgweave.streaming import watcher

CODE = [
    ("a/x.ts", "import {A} from './types';\nexport class Box extends A {\n}\nexport interface Shape {\nexport async function run(a) {\nconst LIMIT = 3;\n"),
    ("a/y.go", 'package main\nimport "fmt"\nfunc (b *Box) Size() int {\nfunc main() {\ntype Box struct {\n'),
    ("a/z.rs", "use std::io;\npub fn parse(x: u8) {\n    fn inner() {}\npub struct Tree {\nimpl Tree {\n"),
    ("a/c.json", '{\n  "name": "x",\n  "deep": {"k": 1}\n}'), ("a/none.md", "# class X"), ("a/null.ts", None), ("a/empty.rs", ""),
]


def test_code_by_lines(spark):
    df = spark.createDataFrame(CODE + CODE[:1], "path string, content string")
    got = {(r["path"], r["kind"], r["name"]) for r in code.code_declarations(df).collect()}
    assert got == {
        ("a/x.ts", "Import", "./types"), ("a/x.ts", "Class", "Box"), ("a/x.ts", "Interface", "Shape"), ("a/x.ts", "Function", "run"), ("a/x.ts", "Variable", "LIMIT"),
        ("a/y.go", "Module", "main"), ("a/y.go", "Import", "fmt"), ("a/y.go", "Method", "Size"), ("a/y.go", "Function", "main"), ("a/y.go", "Class", "Box"),
        ("a/z.rs", "Import", "std::io"), ("a/z.rs", "Function", "parse"), ("a/z.rs", "Function", "inner"), ("a/z.rs", "Struct", "Tree"), ("a/z.rs", "Class", "Tree"),
        ("a/c.json", "Key", "name"), ("a/c.json", "Key", "deep"),
    }
    assert code.code_nodes(df).count() == 15 and {r["relation"] for r in code.code_edges(df).collect()} == {"contains", "imports"}  # Tree and main are named twice


def test_capabilities_and_notes(spark, tmp_path):
    said = [
        ("nested", {"result": {"capabilities": {"textDocument": {"documentSymbolProvider": True, "referencesProvider": {"x": 1}, "definitionProvider": 0}, "workspace": {"symbolProvider": False}, "workspaceSymbolProvider": True}}}),
        ("flat", {"result": {"capabilities": {"documentSymbolProvider": 0, "referencesProvider": 2, "callHierarchyProvider": {}, "definitionProvider": "yes"}}}), ("none", {"result": 1}),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in said] + [("broken", "{")], "server string, response string")
    on = {(r["server"], r["capability"]) for r in ingest.capabilities(df).where("enabled").collect()}
    assert on == {("nested", "document_symbol"), ("nested", "references"), ("nested", "definition"), ("flat", "references"), ("flat", "call_hierarchy")}
    urls = spark.createDataFrame([("https://h.invalid/a.pdf", "2024", "me"), ("https://h.invalid/a.pdf", "2023", None), ("ftp://no", None, None), (None, None, None)], "url string, captured_at string, author string")
    notes = ingest.url_notes(urls)
    assert [(r["type"], r["file"]) for r in notes.collect()] == [("pdf", "https___h_invalid_a_pdf.pdf")] and 'captured_at: "2023"\nauthor: null' in notes.first()["content"]
    assert ingest.write_new(notes, str(tmp_path)) == ["https___h_invalid_a_pdf.pdf"] and ingest.write_new(notes, str(tmp_path)) == []
    assert ingest.office_notes(spark.createDataFrame([("a/b.docx",), ("c.txt",)], "path string")).first()["content"].startswith("# b.docx")


def test_settings(tmp_path):
    at = str(tmp_path / "s.json")
    assert config.load_config(at) == config.DEFAULTS == config.load_config(None)
    assert config.init_config(at) and not config.init_config(at) and config.load_config(at) == config.DEFAULTS
    (tmp_path / "u.json").write_text('{"lsp": {"py": "own"}, "neo4j": {"uri": "x"}}')
    got = config.load_config(str(tmp_path / "u.json"))
    assert got["lsp"]["py"] == "own" and got["lsp"]["go"] == "gopls" and got["neo4j"] == {"uri": "x"}
    (tmp_path / "bad.json").write_text("{")
    assert config.load_config(str(tmp_path / "bad.json")) == config.DEFAULTS
    assert set(detect.installed_servers()) == set(detect.SERVERS.values())


@pytest.fixture(scope="module")
def small(spark, nodes, edges):
    g = graph.build_graph(nodes(("a", "Alpha"), ("b", "Beta"), ("c", "Gamma"), ("d", "Delta")), edges(("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "gone")))
    c = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "d", 0), (2, "gone", 1)], "community_id int, node_id string, pos int")
    return g, c


def test_blocks_of_known_graphs(spark, nodes, edges):
    def points(*pairs):
        g = graph.build_graph(nodes("x"), edges(*pairs))
        return {r["id"] for r in kernels.articulation_points(g).collect()}, kernels.biconnected_edges(g).select("block").distinct().count()

    def both_ways(*pairs):
        g = graph.build_graph(nodes("x"), edges(*pairs))
        one, many = ({tuple(r) for r in kernels.biconnected_edges(g, k).collect()} for k in (100, 0))
        return one == many

    barbell = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")]
    assert points(*barbell) == ({"c", "d"}, 3)
    assert both_ways(*barbell, ("f", "g"), ("g", "h"), ("h", "f"), ("p", "q"), ("q", "r"), ("r", "p"))
    assert points(("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "x")) == (set(), 1)
    assert points(("x", "x")) == (set(), 0)


def test_vault_page_and_exports(small, tmp_path):
    g, c = small
    lines = [r["line"] for r in vault.community_notes(g, c).where("community_id = 2").orderBy("part", "pos").collect()]
    assert lines == ["# Community 2\n\n- Members: 2\n- Cohesion: 1.000\n\n## Members\n", "- [[Delta]]", "- [[unknown]]"]
    vault.write_notes(vault.community_notes(g, c), str(tmp_path / "notes"))
    assert any(f.startswith("file=") for f in os.listdir(tmp_path / "notes"))
    assert vault.canvas(g, c).where("part = 'node'").count() == 5
    n, e = page.community_focus(g, c, 1)
    assert n.count() == 3 and e.count() == 3
    text = page.html_page(g, c)
    data = json.loads(text.split("const data = ", 1)[1].split(", colours = ", 1)[0])
    assert len(data["nodes"]) == 4 and len(data["edges"]) == 4
    share = {(r["node_id"], r["community_id"]): round(r["share"], 3) for r in graph.cohesion_to_community(g, c).collect()}
    assert share[("c", 1)] == 0.667 and share[("c", 2)] == 0.333
    v = {r["id"]: r for r in graph.verbose_nodes(g, c, kernels.articulation_points(g)).collect()}
    assert v["c"]["is_bridge"] and not v["a"]["is_bridge"] and v["a"]["degree"] == 2


def test_stores_and_conversations(spark, small, tmp_path):
    g, c = small
    at = str(tmp_path / "g.json")
    stores.write_checkpoint(g, c, at)
    assert json.loads(open(at).read())["checkpoint"] is True and graph_json.read_graph_json(spark, at)[0].nodes.count() == 4
    stores.clear_checkpoint(at)
    stores.clear_checkpoint(at)
    files = spark.createDataFrame([("p", "one"), ("p", "one"), ("q", None)], "path string, content string")
    stores.write_manifest(files, str(tmp_path / "m"))
    assert detect.changed_files(files.distinct(), detect.read_manifest(spark, str(tmp_path / "m"))).count() == 0
    rows = stores.cache_rows(files, spark.createDataFrame([("p", "x"), ("p", "y"), (None, "z")], "source_file string, id string"))
    stores.write_cache(rows, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).first()["n_rows"] == 2
    assert stores.save_answer(str(tmp_path), "Why?", "So.", "path", ["a"], "2024").endswith("qa_2024.md")
    assert stores.parse_labels('```json\n{"3": "Export Module", "x": "no", "4": 5}\n```') == {3: "Export Module"} == stores.parse_labels(json.dumps({"choices": [{"message": {"content": '{"3": "Export Module"}'}}]}))
    assert stores.parse_labels("no labels") == {}
    root = str(tmp_path / "ws")
    os.makedirs(root)
    w = tools.Workspace(g, c, None, root)
    said = tools.TOOLS["add_conversation"](w, {"question": "where is Alpha", "summary": "in a", "relevant_nodes": ["a"], "timestamp": "2024-01-02T03:04:05Z"})
    assert os.path.exists(f"{root}/memory/{said['id']}.md")
    again = tools.Workspace(g, c, stores.stored_conversations(spark, root), root)
    assert tools.TOOLS["conversation_history"](again, {"question": "alpha"})[0]["related"] == "a"
    assert stores.stored_conversations(spark, str(tmp_path / "nothing")).count() == 0


def test_changes_between_snapshots(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "b.txt").write_text("1")
    before = watcher.snapshot(spark, str(tmp_path)).collect()
    (tmp_path / "a.txt").write_text("22")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("1")
    got = {(os.path.basename(r["path"]), r["change"]) for r in watcher.changes(spark.createDataFrame(before, watcher.snapshot(spark, str(tmp_path)).schema), watcher.snapshot(spark, str(tmp_path))).collect()}
    assert got == {("a.txt", "modified"), ("b.txt", "removed"), ("c.txt", "added")}


def test_polling_reports_changed_and_removed_files(spark, tmp_path):
    import time

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_text("1")
    seen: list = []
    q = watcher.poll_directory(spark, str(root), str(tmp_path / "state"), seen.extend, str(tmp_path / "cp"), every_ms=300)
    try:
        end = time.time() + 60
        while not (tmp_path / "state" / "s1").exists() and time.time() < end:
            time.sleep(0.2)
        (root / "b.txt").write_text("1")
        (root / "a.txt").unlink()
        while {k for _, k in seen} != {"added", "removed"} and time.time() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert {(os.path.basename(p), k) for p, k in seen} == {("b.txt", "added"), ("a.txt", "removed")}


def test_command_line(spark, small, tmp_path, capsys):
    g, c = small
    out = str(tmp_path / "out")
    graph_json.write_tables(g, c, out)
    assert cli.main(["path", "alpha", "delta", "--out", out], spark) == 0
    assert json.loads(capsys.readouterr().out)["path"] == ["a", "c", "d"]
    assert cli.main(["explain", "nothing_like_it", "--out", out], spark) == 1
    at = str(tmp_path / "first.json")
    assert cli.main(["init", "--file", at]) == 0 and cli.main(["init", "--file", at]) == 1


def test_small_communities_may_join_the_largest(nodes, edges):
    g = graph.build_graph(nodes(*"abcdefgh"), edges(("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("e", "f")))
    got = {r["community_id"] for r in community.detect_communities(g, merge="largest").collect()}
    assert got == {1}


def test_heavy_branches_give_the_same(spark, small):
    g, c = small
    plain = {q: sorted(map(tuple, f(graph.Graph(g.nodes, g.edges)).collect()), key=repr) for q, f in (("near", graph.neighbours), ("cohesion", lambda x: graph.cohesion(x, c)))}
    spark.conf.set("kgweave.heavy.rows", "1")
    try:
        hot = graph.Graph(g.nodes, g.edges)
        assert set(hot.hubs) == {"a", "b", "c", "d", "gone"}
        assert sorted(map(tuple, graph.neighbours(hot).collect()), key=repr) == plain["near"] and sorted(map(tuple, graph.cohesion(hot, c).collect()), key=repr) == plain["cohesion"]
    finally:
        spark.conf.unset("kgweave.heavy.rows")
