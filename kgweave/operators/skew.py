"""Per-key results when a handful of keys hold most rows: eager aggregation through joins.

Neither input of a join is ever grouped raw on one task. Each side is first reduced to one compact row a join key (and
group) by Spark's partial aggregation, which runs before the shuffle, so a key with a third of all rows sends one
partial row a task. The compact rows are joined, their counts multiplied and their sums combined, and the products are
rolled up. The result equals that of joining first and aggregating afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.runtime import clean_relation, not_blank


def eager_join_agg(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_groups: Sequence[str] = (),
    right_groups: Sequence[str] = (),
    left_sum: str | None = None,
    right_sum: str | None = None,
    keep_key: bool = False,
) -> DataFrame:
    """Aggregate ``left JOIN right USING (on)`` without building the join's rows.

    Returns ``left_groups + right_groups`` (+ ``on`` with ``keep_key``), ``n`` = joined rows and, where asked,
    ``sum_left``/``sum_right`` = the sum of that column over the joined rows (nulls count as 0). Null keys never match.
    Two group columns of one name, or columns beyond those named, do no harm: inputs are projected and prefixed first.
    Empty inputs give an empty result.
    """

    def compact(df: DataFrame, side: str, groups: Sequence[str], total: str | None) -> DataFrame:
        keys = [F.col(g).alias(f"{side}_{g}") for g in groups]
        value = F.coalesce(F.col(total).cast("double"), F.lit(0.0)) if total else F.lit(0.0)
        rows = df.where(F.col(on).isNotNull()).select(F.col(on).alias("k"), *keys, value.alias("v"))
        return rows.groupBy("k", *(f"{side}_{g}" for g in groups)).agg(F.count(F.lit(1)).alias(f"{side}n"), F.sum("v").alias(f"{side}s"))

    lhs, rhs = compact(left, "l", left_groups, left_sum), compact(right, "r", right_groups, right_sum)
    keys = [*(f"l_{g}" for g in left_groups), *(f"r_{g}" for g in right_groups), *(["k"] if keep_key else [])]
    out = lhs.join(rhs, "k").groupBy(*keys).agg(
        F.sum(F.col("ln") * F.col("rn")).alias("n"),
        F.sum(F.col("ls") * F.col("rn")).alias("sum_left"),
        F.sum(F.col("rs") * F.col("ln")).alias("sum_right"),
    )
    drop = [c for c, used in (("sum_left", left_sum), ("sum_right", right_sum)) if not used]
    return out.drop(*drop).withColumnRenamed("k", on) if keep_key else out.drop(*drop)


def _side(edges: DataFrame, key: str, other: str, p: str, neighbours: bool) -> DataFrame:
    """One compact row a key: rows, summed weight and, where asked, distinct neighbours, which need a level of their own."""
    weight = F.coalesce(F.col("weight"), F.lit(0.0))
    rows = edges.where(not_blank(key))
    if not neighbours:
        return rows.groupBy(F.col(key).alias("node_key")).agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.sum(weight).alias(f"{p}_weight"))
    pairs = rows.groupBy(F.col(key).alias("node_key"), F.col(other).alias("o")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    return pairs.groupBy("node_key").agg(
        F.sum("n").alias(f"{p}_rows"), F.sum((F.coalesce(F.col("o"), F.lit("")) != "").cast("bigint")).alias(f"{p}_neighbours"), F.sum("w").alias(f"{p}_weight")
    )


def key_profile(edges: DataFrame, neighbours: bool = True) -> DataFrame:
    """node_key, out_rows, out_neighbours, out_weight, in_rows, in_neighbours, in_weight, two_hop_rows for every key.

    ``two_hop_rows`` is the number of rows of edges JOIN edges ON target = source through the key: the product of the
    two compact counts. Repeated rows count in ``*_rows``, once in ``*_neighbours``. Null or empty keys are no keys; an
    empty or null other end counts as a row but as no neighbour. An empty table gives no rows. Without ``neighbours`` the
    two columns are left out, and each side sends one row a key and task.
    """
    e = edges.select("source", "target", "weight")
    joined = _side(e, "source", "target", "out", neighbours).join(_side(e, "target", "source", "in", neighbours), "node_key", "full_outer").na.fill(0)
    return joined.withColumn("two_hop_rows", F.col("out_rows") * F.col("in_rows"))


def relation_counts(edges: DataFrame) -> DataFrame:
    """endpoint, node_key, relation, n: rows by key and relation (lower case, trimmed; null becomes '')."""
    rel = F.coalesce(clean_relation(), F.lit("")).alias("relation")
    parts = [
        edges.where(not_blank(c)).groupBy(F.col(c).alias("node_key"), rel).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("endpoint"), "node_key", "relation", "n")
        for c in ("source", "target")
    ]
    return parts[0].unionByName(parts[1])


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """Distinct (node_key, neighbour) pairs of either direction, one row a pair, so that no key's list is in one row."""
    ends = edges.where(not_blank("source") & not_blank("target")).select("source", "target")
    both = ends.select(F.col("source").alias("node_key"), F.col("target").alias("neighbour")).unionByName(
        ends.select(F.col("target").alias("node_key"), F.col("source").alias("neighbour"))
    )
    return both.distinct()


def heavy_endpoints(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """endpoint, node_key, n of the keys that fill at least ``share`` of all rows of ``edges``, blanks aside."""
    total = edges.count()
    profile = key_profile(edges, neighbours=False)
    parts = [
        profile.where((F.col(n) > 0) & (F.col(n) >= F.lit(share * total * (1 - 1e-12)))).select(F.lit(e).alias("endpoint"), "node_key", F.col(n).alias("n"))
        for e, n in (("source", "out_rows"), ("target", "in_rows"))
    ]
    return parts[0].unionByName(parts[1])
