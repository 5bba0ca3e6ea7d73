"""Connected components: forests of the partitions, contracted by star rounds, finished by one union-find.

Each partition of the links is first reduced to a spanning forest, without a shuffle. While the forests are larger than one
task may hold, alternating large-star and small-star rounds shrink them: they only ever send a vertex's neighbours to their
minimum through aggregations and unique-key joins, so a vertex with a third of all links is never gathered in one task. What
is left, at most FINISH_LINKS links, ends in one task. Every way gives a component the name of its least vertex.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.runtime import Scratch, heavy_keys, join_unique

#: Links that one task may hold.
FINISH_LINKS = 1_000_000


def forest(pairs) -> dict:
    """vertex -> least vertex of its component, by union-find with path halving."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in pairs:
        if u not in up:
            up[u] = u
        if v not in up:
            up[v] = v
        a, b = find(u), find(v)
        if a < b:
            up[b] = a
        elif b < a:
            up[a] = b
    return {x: find(x) for x in up}


def _star(links: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """links (u, v): every v of a u's neighbours (larger ones, or smaller ones and u) is linked to the least of them."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    met = join_unique(both, least, "u", "inner", heavy_keys(both, "u"))
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
    return scratch.save(out.where(F.col("u") != F.col("v")).distinct())


def connected_components(links: DataFrame, src: str = "source", dst: str = "target", finish: int = FINISH_LINKS) -> DataFrame:
    """node, component: the smallest node of its undirected component, for every node in ``links``.

    Rows with a null end are left out, self-loops make components of one, repeated links count once. No rows, no result.
    """
    scratch = Scratch(links.sparkSession)
    kind = links.select(F.col(src).alias("u")).schema["u"].dataType.simpleString()
    ends = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())

    def thin(batches):
        pairs: dict = {}
        for batch in batches:
            pairs.update(dict.fromkeys(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            if len(pairs) > finish:  # a partition may hold more links than a task should
                yield table_of(forest(pairs), batch.schema)
                pairs = {}
        if pairs:
            yield table_of(forest(pairs), batch.schema)

    def table_of(up: dict, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(up), schema.field(0).type), pa.array(list(up.values()), schema.field(1).type)], names=["u", "v"])

    thinned, n = scratch.save_counted(ends.mapInArrow(thin, f"u {kind}, v {kind}"))
    if n <= finish:
        return scratch.save(thinned.coalesce(1).mapInArrow(thin, f"u {kind}, v {kind}").select(F.col("u").alias("node"), F.col("v").alias("component")))
    nodes = thinned.select(F.col("u").alias("node")).distinct()
    state, stamp = thinned.where("u <> v"), None
    while True:
        wide = _star(state, True, scratch)
        fresh = _star(wide, False, scratch)
        scratch.drop(state, wide)
        state = fresh
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == stamp:
            break
        stamp = now
    return nodes.join(state.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
