from collections import Counter

from pyspark.sql import functions as F

from kgweave import runtime
from kgweave.operators import skew as S


def test_eager_join_equals_join(spark):
    left = spark.createDataFrame([("h", "a", 1.0)] * 30 + [("h", "b", 2.0)] * 5 + [("x", "a", None), (None, "a", 9.0)], "k string, g string, v double")
    right = spark.createDataFrame([("h", "c", 3.0)] * 20 + [("x", "d", 4.0), ("y", "d", 5.0), (None, "d", 5.0)], "k string, g string, v double")
    got = {(r["l_g"], r["r_g"]): (r["n"], r["sum_left"], r["sum_right"]) for r in S.eager_join_agg(left, right, "k", ["g"], ["g"], "v", "v").collect()}
    want = {}
    for a in left.collect():
        for b in right.collect():
            if a["k"] is not None and a["k"] == b["k"]:
                n, x, y = want.get((a["g"], b["g"]), (0, 0.0, 0.0))
                want[(a["g"], b["g"])] = (n + 1, x + (a["v"] or 0), y + (b["v"] or 0))
    assert got == want
    assert S.eager_join_agg(left.limit(0), right, "k", ["g"], ["g"]).count() == 0
    assert S.eager_join_agg(left, right, "k", keep_key=True).where("k = 'h'").first()["n"] == 700


def test_profile_counts_lists(edges):
    rows = [("a", "hub")] * 6 + [("b", "hub"), ("hub", "c"), ("", "hub"), (None, "hub"), ("a", ""), ("a", None), ("a", "a")]
    df = edges(*rows).withColumn("node_key", F.lit(1)).withColumn("n", F.lit("clash")).withColumn("w", F.lit("x"))
    p = {r["node_key"]: r for r in S.key_profile(df).collect()}
    assert set(p) == {"a", "b", "c", "hub"}
    assert (p["hub"]["in_rows"], p["hub"]["in_neighbours"], p["hub"]["out_rows"], p["hub"]["two_hop_rows"]) == (9, 2, 1, 9)
    assert (p["a"]["out_rows"], p["a"]["out_neighbours"]) == (9, 2)
    rel = Counter((r["endpoint"], r["node_key"]) for r in S.relation_counts(df).collect())
    assert rel[("source", "a")] == 1
    assert {tuple(r) for r in S.neighbour_lists(df).collect()} == {("a", "hub"), ("hub", "a"), ("b", "hub"), ("hub", "b"), ("hub", "c"), ("c", "hub"), ("a", "a")}
    assert S.key_profile(df.limit(0)).count() == 0 and S.heavy_endpoints(df.limit(0)).count() == 0


def test_heavy_endpoints_at_the_edge(edges):
    df = edges(*[("a", f"t{k}") for k in range(2)], *[(f"s{k}", "") for k in range(198)])
    assert {(r["endpoint"], r["node_key"]) for r in S.heavy_endpoints(df).collect()} == {("source", "a")}


def test_join_unique_with_heavy_keys(spark):
    big = spark.createDataFrame([("h", k) for k in range(50)] + [("t", 1), (None, 2), ("u", 3)], "k string, x int")
    one = spark.createDataFrame([("h", "H"), ("t", "T")], "k string, y string")
    heavy = runtime.heavy_keys(big, "k", share=0.3, min_rows=10)
    assert heavy == ["h"]
    plain = sorted(map(tuple, big.join(one, "k", "left").collect()), key=repr)
    assert sorted(map(tuple, runtime.join_unique(big, one, "k", "left", heavy).select("k", "x", "y").collect()), key=repr) == plain


def test_global_rank(spark):
    got = runtime.global_rank(spark.range(0, 500).select(F.format_string("%03d", "id").alias("s")), ["s"]).collect()
    assert {r["s"]: r["rank"] for r in got} == {f"{k:03d}": k for k in range(500)}
