"""Parent-child links to whole hierarchies: leaf peeling, Euler tours by parallel list ranking, interval queries.

1. Leaves are peeled round by round, one job a round; each parent remembers the room its peeled subtrees take. Rounds go on
   while they shrink the core well, so bushy trees shrink to a few per cent; what cannot be peeled contains every cycle.
2. The core's Euler tour is a linked list: entering and leaving each node, linked through first child, next sibling and
   parent. List ranking by pointer doubling gives every element the room and the depth from it to the list's end. Lists
   that never end are those of cycles.
3. Entry and exit numbers follow from the ranks; peeled nodes get theirs inside the room their parent kept for them.
   ``a`` is an ancestor of ``b`` exactly when ``entry(a) < entry(b) < exit(a)`` and both have one root. That is the whole
   hierarchy in linear form; ``ancestor_paths`` and ``descendants`` write it out by joining intervals with points.

Siblings are ordered in buckets of bounded size, so no parent's children are gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.operators.components import connected_components
from kgweave.runtime import Scratch, clean_relation, heavy_keys, join_unique, not_blank

RELATIONS = ("contains", "method")
#: Siblings a bucket holds on average, at most.
BUCKET_ROWS = 50_000
#: A peeling round must remove this share of the core for another to follow.
PEEL_SHARE = 0.1
#: Sizes of the aligned blocks that intervals are cut into, as powers of two. The largest bounds the nodes of a block.
BLOCK_BITS = (0, 4, 8, 12, 16)


def all_links(edges: DataFrame, relations=RELATIONS) -> DataFrame:
    """source, target: the distinct links with two ends."""
    return edges.where(clean_relation().isin(*relations) & not_blank("source") & not_blank("target")).select("source", "target").distinct()


def parent_links(edges: DataFrame, relations=RELATIONS) -> DataFrame:
    """node, parent: one row a child. Of several parents the smallest id is kept (the hierarchy is a forest)."""
    return all_links(edges, relations).groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent"))


def _buckets(n: int) -> int:
    return max(1, math.ceil(n / BUCKET_ROWS))


def _placed(peeled: DataFrame, n: int) -> DataFrame:
    """Adds ``before``: summed size of the siblings placed before the row."""
    b = _buckets(n)
    rows = peeled.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(b)))
    in_bucket = Window.partitionBy("parent", "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    if b == 1:
        return rows.drop("bucket")
    each = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("parent", "bucket").agg(F.sum("size").alias("s")).withColumn("start", F.coalesce(F.sum("s").over(each), F.lit(0))).drop("s")
    return rows.join(starts, ["parent", "bucket"]).withColumn("before", F.col("before") + F.col("start")).drop("bucket", "start")


def _tour(core: DataFrame, n: int) -> DataFrame:
    """e, nxt, w, d: the Euler tour's elements ('>id' enters, '<id' leaves), their successors, room and depth change."""
    kids = core.where(F.col("parent").isNotNull()).select("node", "parent").withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(_buckets(n))))
    in_bucket = Window.partitionBy("parent", "bucket").orderBy("node")
    kids = kids.withColumn("next", F.lead("node").over(in_bucket))
    runs = kids.groupBy("parent", "bucket").agg(F.min("node").alias("first"))
    runs = runs.withColumn("follows", F.lead("first").over(Window.partitionBy("parent").orderBy("bucket")))
    firsts = kids.groupBy("parent").agg(F.min_by("bucket", "bucket").alias("bucket")).join(runs, ["parent", "bucket"]).select(F.col("parent").alias("node"), "first")
    ends = kids.where(F.col("next").isNull()).join(runs.select("parent", "bucket", "follows"), ["parent", "bucket"])
    nexts = kids.where(F.col("next").isNotNull()).select("node", "next").unionByName(ends.where(F.col("follows").isNotNull()).select("node", F.col("follows").alias("next")))
    rows = core.join(firsts, "node", "left").join(nexts, "node", "left")
    enter, leave = F.concat(F.lit(">"), F.col("node")), F.concat(F.lit("<"), F.col("node"))
    element = F.array(
        F.struct(enter.alias("e"), F.coalesce(F.concat(F.lit(">"), F.col("first")), leave).alias("nxt"), (2 * F.col("acc") + 1).alias("w"), F.lit(1).cast("bigint").alias("d"), leave.alias("last")),
        F.struct(leave.alias("e"), F.coalesce(F.concat(F.lit(">"), F.col("next")), F.concat(F.lit("<"), F.col("parent"))).alias("nxt"), F.lit(1).cast("bigint").alias("w"), F.lit(-1).cast("bigint").alias("d"), leave.alias("last")),
    )
    return rows.select(F.explode(element).alias("x")).select("x.*")


def _ranked(tour: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer doubling: w and d become sums up to the list's end, ``last`` its last element; nxt stays set on endless lists.

    Ranks of a list have no gaps, so a round that ends no element shows that only endless lists are left. Rows that have
    ended are written once and only looked up afterwards.
    """
    going = F.col("nxt").isNotNull()
    state = scratch.save(tour)
    ended, state = state.where(~going), state.where(going)
    n_open = state.count()
    while n_open:
        ahead = ended.unionByName(state).select(F.col("e").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("w").alias("w2"), F.col("d").alias("d2"), F.col("last").alias("last2"))
        moved = scratch.save(state.join(ahead, "nxt").select(
            "e", F.col("nxt2").alias("nxt"), (F.col("w") + F.col("w2")).alias("w"), (F.col("d") + F.col("d2")).alias("d"), F.col("last2").alias("last")
        ))
        ended, state = ended.unionByName(moved.where(~going)), moved.where(going)
        still = state.count()
        if still == n_open:
            break
        n_open = still
    return ended.unionByName(state)


def _cycle_roots(caught: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root, on_cycle for nodes on or below cycles; every parent of ``caught`` is in ``caught``.

    Steps up are doubled until the ancestors met are no fewer than before: then they are those that lie on cycles. Every
    weak component holds one cycle, whose least id is its root.
    """
    caught, n = scratch.save_counted(caught)
    if not n:
        return caught.select("node", F.col("parent").alias("root"), F.lit(False).alias("on_cycle"))
    state, met = caught.select("node", F.col("parent").alias("anc")), -1
    while True:
        tops, now = scratch.save_counted(state.select(F.col("anc").alias("node")).distinct())
        if now == met:
            break
        met = now
        hop = state.select(F.col("node").alias("anc"), F.col("anc").alias("up"))
        state = scratch.save(join_unique(state, hop, "anc", "inner", heavy_keys(state, "anc")).select("node", F.col("up").alias("anc")))
    parts = connected_components(caught, "node", "parent")
    marked = scratch.save(parts.join(tops.withColumn("on_cycle", F.lit(True)), "node", "left"))
    lows = marked.where("on_cycle").groupBy("component").agg(F.min("node").alias("root"))
    return join_unique(marked, lows, "component", "inner", heavy_keys(marked, "component")).select("node", "root", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def hierarchy(edges: DataFrame, relations=RELATIONS) -> DataFrame:
    """node_id, parent_id, root_id, depth, entry, exit, n_descendants, on_cycle for every id in any link.

    A root has itself as root and depth 0. A node on a cycle or below one has the smallest id of that cycle as root,
    depth -1 and null entry, exit and n_descendants; ``on_cycle`` tells the cycle's own nodes from those below. Links
    with a null or empty end are left out, repeated links count once, a self-loop is a cycle of one, and of several
    parents the smallest id is kept. No links give no rows; extra columns are ignored. Runs jobs while it is called:
    rounds are written to the shared folder.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    raw = scratch.save(all_links(edges, relations))
    links = scratch.save(raw.groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent")))
    heavy = heavy_keys(links, "parent")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    ends = links.select("node", "parent", zero.alias("kids"))
    ends = ends.unionByName(links.groupBy("parent").agg(F.count(F.lit(1)).alias("kids")).select(F.col("parent").alias("node"), none.alias("parent"), "kids"))
    ends = ends.unionByName(raw.select(F.col("source").alias("node")).distinct().select("node", none.alias("parent"), zero.alias("kids")))
    core, n = scratch.save_counted(ends.groupBy("node").agg(F.max("parent").alias("parent"), F.sum("kids").alias("kids")).withColumn("acc", zero))
    leaf = (F.col("kids") == 0) & F.col("parent").isNotNull()
    rounds = []
    n_leaves = core.where(leaf).count() if n else 0
    while n and n_leaves >= PEEL_SHARE * n:
        peeled = core.where(leaf).select("node", "parent", "acc", (F.col("acc") + 1).alias("size"))
        rounds.append((peeled, n_leaves, core))
        grown = peeled.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("more"), F.count(F.lit(1)).alias("gone"))
        rest = core.where(~leaf).join(grown, "node", "left")
        core, n = scratch.save_counted(rest.select("node", "parent", (F.col("kids") - F.coalesce("gone", zero)).alias("kids"), (F.col("acc") + F.coalesce("more", zero)).alias("acc")))
        n_leaves = core.where(leaf).count() if n else 0
    ranked = _ranked(_tour(core.select("node", "parent", "acc"), max(n, 1)), scratch)
    spans = ranked.groupBy(F.substring("e", 2, 1 << 30).alias("node")).agg(
        F.max(F.when(F.col("nxt").isNotNull(), F.lit(True))).alias("caught"),
        F.max(F.when(F.col("e").startswith(">"), -F.col("w"))).alias("entry"),
        F.max(F.when(F.col("e").startswith("<"), -F.col("w"))).alias("exit"),
        F.max(F.when(F.col("e").startswith(">"), -F.col("d"))).alias("depth"),
        F.max(F.substring("last", 2, 1 << 30)).alias("root"),
    )
    spans = scratch.save(core.join(spans, "node"))
    caught = spans.where("caught").select("node", "parent")
    cyclic = _cycle_roots(caught, scratch).select("node", F.col("root").alias("cycle_root"), "on_cycle")
    is_caught = F.coalesce(F.col("caught"), F.lit(False))
    found = spans.join(cyclic, "node", "left").select(
        "node",
        "parent",
        F.when(is_caught, F.col("cycle_root")).otherwise(F.col("root")).alias("root"),
        F.when(is_caught, F.lit(-1).cast("bigint")).otherwise(F.col("depth")).alias("depth"),
        F.when(~is_caught, F.col("entry")).alias("entry"),
        F.when(~is_caught, F.col("exit")).alias("exit"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
    )
    if rounds:
        found = scratch.save(found)
    for k, (peeled, n_peeled, before) in enumerate(reversed(rounds), 1):
        # the room kept by earlier rounds comes first: acc of the parent as it was at the round's start
        room = before.where(F.col("kids") > 0).select(F.col("node").alias("parent"), F.col("acc").alias("room"))
        over = found.select(F.col("node").alias("parent"), F.col("root"), F.col("depth").alias("pd"), F.col("entry").alias("pe"))
        placed = join_unique(_placed(peeled, n_peeled), over.join(room, "parent"), "parent", "inner", heavy)
        entry = F.col("pe") + 1 + 2 * (F.col("room") + F.col("before"))
        level = placed.select(
            "node", "parent", "root", F.when(F.col("pd") < 0, F.col("pd")).otherwise(F.col("pd") + 1).alias("depth"),
            entry.alias("entry"), (entry + 2 * F.col("size") - 1).alias("exit"), F.lit(False).alias("on_cycle"),
        )
        # each level is written once; the last one is read by nobody here
        found = found.unionByName(level if k == len(rounds) else scratch.save(level))
    return found.select(
        F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"),
        "entry", "exit", (F.expr("(exit - entry - 1) div 2")).alias("n_descendants"), "on_cycle",
    )


def _sequence(a: Column, b: Column) -> Column:
    """a, a + 1, ..., b - 1."""
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))


def _sized(at: Column, bits: int) -> Column:
    return F.transform(at, lambda b: F.struct(F.lit(bits).alias("bits"), b.alias("at")))


def aligned_blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks (bits, at) that make up the numbers from lo to hi - 1, the largest that fit."""
    out = []
    for k, bits in enumerate(BLOCK_BITS):
        size = 1 << bits
        first, last = F.shiftright(lo + F.lit(size - 1).cast("bigint"), bits), F.shiftright(hi, bits)
        if k + 1 < len(BLOCK_BITS):
            step = 1 << (BLOCK_BITS[k + 1] - bits)
            up, down = F.shiftright(lo + F.lit(size * step - 1).cast("bigint"), BLOCK_BITS[k + 1]), F.shiftright(hi, BLOCK_BITS[k + 1])
            at = F.when(up < down, F.concat(_sequence(first, up * step), _sequence(down * step, last))).otherwise(_sequence(first, last))
        else:
            at = _sequence(first, last)
        out.append(_sized(at, bits))
    return F.concat(*out)


def descendants(tree: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """ancestor_id, node_id, distance: every descendant of every node (or of the nodes in ``ids.node_id``), written out.

    ``tree`` is the result of ``hierarchy``, whose intervals are the linear form of the same. Each ancestor's interval is cut
    into aligned blocks of up to 2**16 places, each node's place lies in one block of each size, and blocks meet by equality:
    a pair meets once, and no block holds more nodes than its places, however large a tree is. Rows of cycles are left out,
    as they have no order.
    """
    inner = tree.where("n_descendants > 0")
    if ids is not None:
        inner = inner.join(ids.select("node_id").distinct(), "node_id", "left_semi")
    spans = inner.select("root_id", F.col("node_id").alias("ancestor_id"), F.col("depth").alias("top"), F.explode(aligned_blocks(F.col("entry") + 1, F.col("exit"))).alias("b"))
    places = F.array(*(F.struct(F.lit(k).alias("bits"), F.shiftright("entry", k).alias("at")) for k in BLOCK_BITS))
    points = tree.where("depth > 0").select("root_id", "node_id", "depth", F.explode(places).alias("b"))
    key = lambda df: df.select("root_id", *[c for c in df.columns if c not in ("root_id", "b")], F.col("b.bits").alias("bits"), F.col("b.at").alias("at"))
    return key(spans).join(key(points), ["root_id", "bits", "at"]).select("ancestor_id", "node_id", (F.col("depth") - F.col("top")).alias("distance"))


def ancestor_paths(tree: DataFrame) -> DataFrame:
    """node_id, path (array of ids from the root to the node) of every node outside cycles, from the intervals.

    A path is as long as its node is deep. Nodes on or below a cycle have no path and no row.
    """
    above = descendants(tree).groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("ancestor_id").alias("id")))).alias("x"))
    rows = tree.where("depth >= 0").select("node_id").join(above, "node_id", "left")
    return rows.select("node_id", F.concat(F.coalesce(F.transform("x", lambda x: x["id"]), F.array().cast("array<string>")), F.array("node_id")).alias("path"))
