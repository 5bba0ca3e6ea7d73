import math
import re
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from kgweave.llm import distinctive as D


def words(label):
    return [w.lower() for w in re.findall("[A-Za-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", label or ""))]


ROWS = [("a", "parseHTMLTree zebraish"), ("a", "parseHTMLTree"), ("b", "parse tree_zebraish"), ("c", "parse the tree"), ("d", None), ("e", ""), (None, "parse"), ("f", "x" * 5000 + " parse")]


def test_scores_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, "id string, label string").withColumn("term", F.lit("clash")).withColumn("tf", F.lit(1))
    tf, cf = defaultdict(Counter), Counter()
    for k, label in ROWS:
        if k is not None:
            tf[k].update(words(label))
    for c in tf.values():
        cf.update(c)
    n, df_ = sum(cf.values()), Counter(w for c in tf.values() for w in c)
    want = {}
    for k, c in tf.items():
        for w, x in c.items():
            if df_[w] >= D.MIN_DF:
                p = cf[w] / n
                q = (x + D.MU * p) / (sum(c.values()) + D.MU)
                want[(k, w)] = (x, df_[w], round(q * math.log(q / p), 9))
    got = {(r["rec_key"], r["term"]): (r["tf"], r["df"], round(r["score"], 9)) for r in D.term_scores(df).collect()}
    assert got == want and got[("a", "zebraish")][2] > got[("a", "parse")][2]
    assert D.term_scores(df.limit(0)).count() == 0


def test_pairs_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, "id string, label string")
    by = defaultdict(set)
    for k, label in ROWS:
        for w in words(label):
            if k is not None and len(w) >= 6:
                by[w].add(k)
    want = {p for s in by.values() if len(s) <= 3 for p in combinations(sorted(s), 2)}
    scores = D.term_scores(df, rare_df=3, min_length=6)
    got = D.shared_rare_terms(scores.where("df <= 3"))
    assert {(r["node_a"], r["node_b"]) for r in got.collect()} == want == {("a", "b")}
    one = {r["rec_key"]: r["score"] for r in scores.where("term = 'zebraish'").collect()}
    assert abs(got.first()["weight"] - sum(one.values())) < 1e-12
    assert "ln(" in scores._jdf.queryExecution().optimizedPlan().toString().lower()


def test_the_cut_keeps_every_rare_term(spark):
    # in so small a collection the shared word is no more frequent in one label than in all, so its score is not positive
    rows = [("a", "parser " + " ".join(f"w{chr(97 + k)}" for k in range(9))), ("b", "parser"), ("c", "common common common"), ("d", "common"), ("e", "common"), ("f", "common")]
    df = spark.createDataFrame(rows, "id string, label string")
    scores = D.term_scores(df, rare_df=3, min_length=6)
    assert {(r["rec_key"], r["term"]) for r in scores.collect()} == {("a", "parser"), ("b", "parser")}
