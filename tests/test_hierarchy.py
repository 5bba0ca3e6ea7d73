import random

import pytest
from pyspark.sql import functions as F

from kgweave import runtime
from kgweave.operators import hierarchy as H


def brute(links):
    par = {}
    for s, t in links:
        par[t] = min(s, par.get(t, s))
    out = {}
    for n in {x for link in links for x in link}:
        seen, x, k = {}, n, 0
        while x in par and x not in seen:
            seen[x], k, x = k, k + 1, par[x]
        if x in seen:
            ring = [y for y, i in seen.items() if i >= seen[x]]
            out[n] = (min(ring), -1, n in ring)
        else:
            out[n] = (x, k, False)
    return out


def run(df):
    return {r["node_id"]: r for r in H.hierarchy(df).collect()}


def check(edges, links):
    got = run(edges(*links, relation="contains"))
    assert {k: (r["root_id"], r["depth"], r["on_cycle"]) for k, r in got.items()} == brute(links)
    return got


def test_random_forest_with_cycles(edges):
    rng = random.Random(7)
    ids = [f"n{k:03d}" for k in range(160)]
    links = [(ids[rng.randrange(k)], ids[k]) for k in range(3, 120)]  # trees
    links += [(ids[k], ids[k + 1]) for k in range(120, 150)]  # a chain
    links += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "y1"), ("y1", "y2"), ("s", "s"), ("s", "t")]  # cycles with tails
    got = check(edges, links)
    par = {r["node_id"]: r["parent_id"] for r in got.values()}
    for n, r in got.items():
        if r["depth"] < 0:
            assert r["entry"] is None and r["n_descendants"] is None
            continue
        x, above = n, 0
        while par[x] is not None:
            x, above = par[x], above + 1
            assert got[x]["entry"] < r["entry"] and r["exit"] < got[x]["exit"]
        assert above == r["depth"]
        assert r["n_descendants"] == sum(1 for m, q in got.items() if q["root_id"] == r["root_id"] and q["depth"] >= 0 and r["entry"] < q["entry"] < r["exit"])


@pytest.mark.parametrize("links", [[("a", "b")], [("a", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("c", "b")], [("a", "b"), ("a", "b"), ("b", "c")]])
def test_small_shapes(edges, links):
    check(edges, links)


def test_paths_and_descendants(edges):
    tree = H.hierarchy(edges(("r", "a"), ("a", "b"), ("r", "c"), ("z", "z"), relation="method"))
    assert {r["node_id"]: r["path"] for r in H.ancestor_paths(tree).collect()} == {"r": ["r"], "a": ["r", "a"], "b": ["r", "a", "b"], "c": ["r", "c"]}
    assert {tuple(r) for r in H.descendants(tree).collect()} == {("r", "a", 1), ("r", "b", 2), ("r", "c", 1), ("a", "b", 1)}
    assert {tuple(r) for r in H.descendants(tree, tree.where("node_id = 'a'")).collect()} == {("a", "b", 1)}


def test_nulls_blanks_case_and_extra_columns(spark, edges):
    df = edges(("a", "b", " Contains "), ("b", "c", "METHOD"), ("", "d", "contains"), (None, "e", "contains"), ("f", None, "contains"), ("g", "h", None), ("i", "j", "calls"))
    df = df.withColumn("node", F.lit("clash")).withColumn("parent", F.lit(3)).withColumn("root", F.lit(None).cast("string"))
    assert {k: (r["root_id"], r["depth"]) for k, r in run(df).items()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2)}
    assert run(edges(relation="contains")) == {}


def test_hot_parent_is_split(edges, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_ROWS", 7)
    monkeypatch.setattr(H, "heavy_keys", lambda df, key, **k: runtime.heavy_keys(df, key, share=0.2, min_rows=5, **k))
    links = [("hub", f"c{k:02d}") for k in range(40)] + [("c05", f"d{k}") for k in range(9)] + [("d1", "e1")]
    got = check(edges, links)
    entries = [r["entry"] for r in got.values()]
    assert len(set(entries)) == len(entries) and got["hub"]["n_descendants"] == 50


def test_intervals_of_a_long_chain_and_a_wide_tree(spark, edges):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)]
    wide = [("top", f"w{k:03d}") for k in range(50)]
    tree = H.hierarchy(edges(*chain, *wide, relation="contains"))
    got = {tuple(r) for r in H.descendants(tree).collect()}
    want = {(f"n{a:03d}", f"n{b:03d}", b - a) for a in range(41) for b in range(a + 1, 41)} | {("top", f"w{k:03d}", 1) for k in range(50)}
    assert got == want and H.descendants(tree).count() == len(want)
    paths = {r["node_id"]: r["path"] for r in H.ancestor_paths(tree).collect()}
    assert paths["n040"] == [f"n{k:03d}" for k in range(41)] and paths["top"] == ["top"] and len(paths) == 92
