"""Community detection by local moving and refinement, with small communities merged.

The definition's pass is sequential in id order. Exact mode runs it in one task; distributed mode, for graphs of any size,
gives the same communities in blocks, so that the size of a graph decides nothing but where the work is done. A block
of nodes is swept in order in one task, with the latest communities of lower nodes elsewhere and the pass's old ones of
higher nodes; blocks that saw a lower node change are swept again until none does. At that point each node has decided as
the sequential pass decides. Refinement and the merge of small communities are joins. Communities are numbered from 1; 0 is
kept for the chat.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter, _count_elements, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgweave.operators.graph import Graph, adjacency
from kgweave.runtime import Scratch, global_rank, heavy_keys, join_unique

MAX_ROUNDS = 50
MIN_SIZE = 3
#: Nodes and links up to which one task does all rounds.
EXACT_LIMIT = 40_000_000
#: Nodes that the task looks at together where arrays are as long as their links.
STEP = 100_000
#: Links of a block that one task sweeps; nodes of more than HUB_LINKS links are scored by joins instead.
BLOCK_LINKS, HUB_LINKS = 1_000_000, 10_000
#: Nodes that are put into a block together.
BUCKET = 50


def local_moving(adj: dict[str, list[str]], gamma: float = 1.0, max_rounds: int = MAX_ROUNDS) -> dict[str, int]:
    """node -> community: sequential passes in id order, totals frozen at the start of a pass, until refinement changes nothing."""
    ids = sorted(adj)
    at = {u: k for k, u in enumerate(ids)}
    near = [[at[v] for v in adj[u] if v in at] for u in ids]  # places of the neighbours that have a node
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in near])]).astype(np.int64)
    to = np.array([v for x in near for v in x], np.int32)
    return dict(zip(ids, moved_places(ptr, to, np.array([len(adj[u]) for u in ids], np.int64), gamma, max_rounds).tolist()))


def moved_places(ptr: np.ndarray, to: np.ndarray, degree: np.ndarray, gamma: float = 1.0, max_rounds: int = MAX_ROUNDS) -> np.ndarray:
    """``local_moving`` over places: the neighbours of u are ``to`` from ``ptr[u]`` to ``ptr[u + 1]``; in place of lists of numbers.

    What a round makes depends on who is together and on the order of the numbers alone. So once a round's division and order
    are those of an earlier one, rounds repeat, and whole periods are left out.
    """
    n, m = len(degree), float(degree.sum()) / 2
    comm, deg, ends, near = list(range(n)), degree.tolist(), ptr.tolist(), array("i", to.astype(np.int32).tobytes())
    if not m:
        return np.arange(n)
    left, seen = max_rounds, {}
    while left:
        left -= 1
        total, get, a = np.bincount(comm, degree).tolist(), comm.__getitem__, 0
        for u in range(n):
            b = ends[u + 1]
            inside: dict[int, int] = {}  # in the order of the first neighbours
            _count_elements(inside, map(get, near[a:b]))
            best, best_score, k, a = None, 0.0, deg[u], b
            for c, x in inside.items():
                score = x / m - gamma * total[c] * k / (2 * m * m)
                if score > best_score:
                    best, best_score = c, score
            if best is not None:
                comm[u] = best
        found = np.array(comm, np.int64)
        own = np.zeros(n, np.int64)  # neighbours in the own community
        for first in range(0, n, STEP):
            last = min(n, first + STEP)
            u = np.repeat(np.arange(first, last), np.diff(ptr[first : last + 1]))
            own[first:last] = np.bincount(u[found[u] == found[to[ptr[first] : ptr[last]]]] - first, minlength=last - first)
        well = own > 0.5 * np.maximum(1, degree)
        size, wells = np.bincount(found), np.bincount(found[well], minlength=found.max() + 1)
        split = np.flatnonzero((wells > 0) & (wells < size // 2))
        if not len(split):
            return found
        fresh = np.arange(len(size))
        fresh[split] = len(size) + np.arange(len(split))
        found = np.where(well, fresh[found], found)
        comm = found.tolist()
        state = hashlib.blake2b(np.unique(found, return_inverse=True)[1].astype(np.int32).tobytes()).digest()
        if state in seen:
            left %= seen[state] - left
            seen = {}
        else:
            seen[state] = left
    return found


def merge_small(adj: dict[str, list[str]], comm: dict[str, int], min_size: int = MIN_SIZE, to: str = "neighbour") -> dict[str, int]:
    """Communities below ``min_size`` join the neighbour with most links (ties: the least), else the largest; chains are resolved."""
    size = Counter(comm.values())
    goal = _goals(size, ((c, [comm[v] for v in adj[u] if v in comm]) for u, c in comm.items() if size[c] < min_size), min_size, to)
    return {u: goal.get(c, c) for u, c in comm.items()}


def _goals(size: dict[int, int], near, min_size: int, to: str) -> dict[int, int]:
    """small community -> the one that it ends in; ``near`` has (community, communities of its neighbours) of the members of small ones."""
    small = sorted(c for c in size if size[c] < min_size)
    largest = min((c for c in size), key=lambda c: (-size[c], c), default=None)
    links: dict[int, Counter] = defaultdict(Counter)
    for c, others in near:
        links[c].update(x for x in others if x != c)
    target: dict[int, int] = {}

    def find(c: int) -> int:
        while c in target:
            c = target[c]
        return c

    for c in small:
        best = min(links[c].items(), key=lambda x: (-x[1], x[0]))[0] if links[c] and to == "neighbour" else largest
        if best is not None and find(best) != c:
            target[c] = find(best)
    return {c: find(c) for c in target}


def _numbered(rows: DataFrame) -> DataFrame:
    """community_id from 1 by the least member, pos by id; ranks by sorted ranges, not in one window."""
    first = rows.groupBy("c").agg(F.min("node_id").alias("first"))
    # communities are far fewer than nodes; their order is one window over one row each
    numbered = first.withColumn("community_id", F.row_number().over(Window.orderBy("first")))
    out = join_unique(rows, numbered.select("c", "community_id"), "c", "inner", heavy_keys(rows, "c"))
    return out.select("community_id", "node_id")


def detect_communities(graph: Graph, gamma: float = 1.0, min_size: int = MIN_SIZE, mode: str = "auto", merge: str = "neighbour") -> DataFrame:
    """community_id, node_id: every node in exactly one community, numbered from 1 by least member.

    ``exact`` (up to EXACT_LIMIT nodes and links) is one task, ``distributed`` has no size limit; both give the same
    communities. Higher ``gamma`` gives smaller communities. ``merge`` sends small ones to the ``neighbour`` with most links or
    to the ``largest``.
    """
    scratch = Scratch(graph.edges.sparkSession)
    adj = adjacency(graph)
    if mode == "auto":
        mode = "exact" if graph.nodes.count() + graph.edges.count() <= EXACT_LIMIT else "distributed"
    nodes = graph.nodes.select(F.col("id").alias("node_id"))
    if mode == "distributed":
        return _numbered(_distributed(nodes, adj, gamma, min_size, graph.hubs, scratch, merge))
    return _numbered(_exact(nodes, adj, gamma, min_size, graph.hubs, scratch, merge))


def _coded(nodes: DataFrame, adj: DataFrame, hubs: list, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node_id, pos of every node by rank; u, v of the neighbours by pos, v null for ids without a node)."""
    ranked = scratch.save(global_rank(nodes, ["node_id"], "pos"))
    near = scratch.save(adj.where(F.col("node").isNotNull() & F.col("neighbour").isNotNull()))
    coded = join_unique(near, ranked.select(F.col("node_id").alias("node"), F.col("pos").alias("u")), "node", "inner", hubs)
    coded = scratch.save(join_unique(coded, ranked.select(F.col("node_id").alias("neighbour"), F.col("pos").alias("v")), "neighbour", "left", hubs).select("u", "v"))
    scratch.drop(near)
    return ranked, coded


def _exact(nodes: DataFrame, adj: DataFrame, gamma: float, min_size: int, hubs: list, scratch: Scratch, merge: str) -> DataFrame:
    """node_id, c: all rounds in one task, which holds coded links, four bytes each way of a link and twelve while they are read."""
    ranked, coded = _coded(nodes, adj, hubs, scratch)
    n, rows = ranked.count(), coded.count()

    def kernel(batches):
        keys, at = np.empty(rows, np.int64), 0
        for b in batches:
            keys[at : at + b.num_rows] = b.column(0).to_numpy() * (n + 1) + b.column(1).fill_null(n).to_numpy()
            at += b.num_rows
        keys.sort()
        ptr = np.searchsorted(keys, np.arange(n + 1) * (n + 1))
        keys %= n + 1
        to = keys.astype(np.int32)
        del keys
        degree, known = np.diff(ptr), to < n
        ptr = np.concatenate([[0], np.cumsum(known)])[ptr]
        to = to[known]
        comm = moved_places(ptr, to, degree, gamma)
        numbers, sizes = np.unique(comm, return_counts=True)
        size = dict(zip(numbers.tolist(), sizes.tolist()))
        small = np.flatnonzero(np.isin(comm, numbers[sizes < min_size]))
        near = ((int(comm[u]), comm[to[ptr[u] : ptr[u + 1]]].tolist()) for u in small)
        goal = _goals(size, near, min_size, merge)
        to_number = np.array([goal.get(c, c) for c in numbers.tolist()], np.int64)
        comm = to_number[np.searchsorted(numbers, comm)]
        for a in range(0, n, STEP):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, min(n, a + STEP))), pa.array(comm[a : a + STEP])], names=["pos", "c"])

    found = scratch.save(coded.coalesce(1).mapInArrow(kernel, "pos bigint, c bigint"))
    return scratch.save(ranked.join(found, "pos").select("node_id", "c"))


def _distributed(nodes: DataFrame, adj: DataFrame, gamma: float, min_size: int, hubs: list, scratch: Scratch, merge: str = "neighbour") -> DataFrame:
    """node_id, c: the communities of ``local_moving`` and ``merge_small``, numbers included."""
    ranked, coded = _coded(nodes, adj, hubs, scratch)
    m = coded.count() / 2
    placed = scratch.save(_placed(ranked.select("pos").join(coded.groupBy(F.col("u").alias("pos")).agg(F.count(F.lit(1)).alias("k")), "pos", "left").na.fill(0)))
    hot = heavy_keys(coded, "u")
    links = scratch.save(join_unique(coded.where(F.col("v").isNotNull()), placed.select(F.col("pos").alias("u"), F.col("k").alias("uk"), F.col("block").alias("ub")), "u", "inner", hot))
    hot_v = heavy_keys(links, "v")
    state = placed.withColumn("c", F.col("pos"))
    for _ in range(MAX_ROUNDS if m else 0):
        moved = _moved(state, links, gamma, m, hot_v, scratch)
        ends = join_unique(links, moved.select(F.col("pos").alias("v"), F.col("c").alias("cv")), "v", "inner", hot_v)
        ends = join_unique(ends, moved.select(F.col("pos").alias("u"), F.col("c").alias("cu")), "u", "inner", hot)
        well = ends.where("cu = cv").groupBy(F.col("u").alias("pos"), "uk").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") / F.greatest(F.lit(1), F.col("uk")) > 0.5).select("pos", F.lit(True).alias("well"))
        marked = scratch.save(moved.join(well, "pos", "left"))
        split = marked.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.count("well").alias("wells")).where((F.col("wells") > 0) & (F.col("wells") < F.floor(F.col("size") / 2)))
        above = marked.agg(F.max("c")).first()[0]
        # one row a split community
        split = scratch.save(split.select("c", (F.row_number().over(Window.orderBy("c")) + F.lit(above)).cast("bigint").alias("fresh")))
        state = scratch.save(join_unique(marked, split, "c", "left", heavy_keys(marked, "c")).select("pos", "k", "block", F.when(F.col("well"), F.coalesce("fresh", "c")).otherwise(F.col("c")).alias("c")))
        if not split.limit(1).count():
            break
    merged = _merged(state, links, min_size, hot, hot_v, scratch, merge)
    return ranked.join(merged, "pos").select("node_id", "c")


def _placed(nodes: DataFrame) -> DataFrame:
    """Adds ``block``: consecutive nodes with about BLOCK_LINKS links; -1 for hubs."""
    bucket = F.floor(F.col("pos") / BUCKET)
    sums = nodes.groupBy(bucket.alias("bucket")).agg(F.sum(F.when(F.col("k") <= HUB_LINKS, F.col("k") + 1).otherwise(0)).alias("n"))
    # one row a bucket
    before = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    block = F.when(F.col("k") > HUB_LINKS, F.lit(-1)).otherwise(F.floor(F.col("before") / BLOCK_LINKS)).cast("bigint")
    return nodes.withColumn("bucket", bucket).join(before, "bucket").select("pos", "k", block.alias("block"))


def _moved(state: DataFrame, links: DataFrame, gamma: float, m: float, hot_v: list, scratch: Scratch) -> DataFrame:
    """pos, k, block, c after one sequential pass over all nodes, with totals frozen at its start."""
    total = scratch.save(state.groupBy("c").agg(F.sum("k").cast("double").alias("total")))
    now = join_unique(state, total, "c", "inner", heavy_keys(state, "c"))
    now = scratch.save(now.withColumn("n", F.col("c")).withColumn("nt", F.col("total")))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        own = pdf[pdf["v"] < 0]
        comm = dict(zip(own["u"].tolist(), own["c"].tolist()))
        totals = dict(zip(pdf["c"].tolist(), pdf["total"].tolist()))
        at, end = pdf["u"].searchsorted(own["u"], "left").tolist(), pdf["u"].searchsorted(own["u"], "right").tolist()
        vs, cs = pdf["v"].tolist(), pdf["c"].tolist()
        for u, k, a, b in zip(own["u"].tolist(), own["uk"].tolist(), at, end):
            inside: dict[int, int] = {}  # in the order of the first neighbours
            for x in range(a + 1, b):
                c = comm.get(vs[x], cs[x])
                inside[c] = inside.get(c, 0) + 1
            best, best_score = None, 0.0
            for c, n in inside.items():
                score = n / m - gamma * totals[c] * k / (2 * m * m)
                if score > best_score:
                    best, best_score = c, score
            if best is not None:
                comm[u] = best
        return pd.DataFrame({"pos": list(comm), "new": list(comm.values())}, dtype="int64")

    todo: list[int] | None = None
    while True:
        seen = now.select(F.col("pos").alias("v"), F.col("block").alias("vb"), "c", "total", "n", "nt")
        lower = F.col("v") < F.col("u")
        met = join_unique(links if todo is None else links.where(F.col("ub").isin(todo)), seen, "v", "inner", hot_v)
        met = met.select("ub", "u", "uk", "v", F.when(lower, F.col("n")).otherwise(F.col("c")).alias("c"), F.when(lower, F.col("nt")).otherwise(F.col("total")).alias("total"))
        own = now.where((F.col("block") >= 0) if todo is None else F.col("block").isin([b for b in todo if b >= 0]))
        own = own.select(F.col("block").alias("ub"), F.col("pos").alias("u"), F.col("k").alias("uk"), F.lit(-1).cast("bigint").alias("v"), "c", "total")
        new = met.where("ub >= 0").unionByName(own).groupBy("ub").applyInPandas(sweep, "pos bigint, new bigint")
        votes = met.where("ub < 0").groupBy("u", "c").agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("first"), F.max("total").alias("total"), F.max("uk").alias("uk"))
        score = F.col("inside") / F.lit(m) - F.lit(float(gamma)) * F.col("total") * F.col("uk") / F.lit(2 * m * m)
        hubs = votes.groupBy(F.col("u").alias("pos")).agg(F.min(F.struct((-score).alias("s"), "first", "c")).alias("x")).select("pos", F.when(F.col("x.s") < 0, F.col("x.c")).otherwise(F.lit(-1)).alias("new"))
        later = now.join(new.unionByName(hubs), "pos", "left").select("pos", "k", "block", "c", "total", F.col("n").alias("before"), F.coalesce(F.when(F.col("new") < 0, F.col("c")).otherwise(F.col("new")), F.col("n")).alias("n"))
        later = scratch.save(later)
        fresh = scratch.save(join_unique(later, total.select(F.col("c").alias("n"), F.col("total").alias("nt")), "n", "inner", heavy_keys(later, "n")))
        scratch.drop(now, later)
        now = fresh
        changed = now.where("n <> before").select(F.col("pos").alias("v"), F.col("block").alias("vb"))
        again = join_unique(links, changed, "v", "inner", hot_v).where(lower & ((F.col("ub") != F.col("vb")) | (F.col("ub") < 0)))
        todo = [r[0] for r in again.select("ub").distinct().collect()]  # one row a block
        if not todo:
            return now.select("pos", "k", "block", F.col("n").alias("c"))


def _merged(state: DataFrame, links: DataFrame, min_size: int, hot: list, hot_v: list, scratch: Scratch, merge: str) -> DataFrame:
    """pos, c with small communities merged as in ``merge_small``: each points to its goal, chains by pointer doubling."""
    size = scratch.save(state.groupBy("c").agg(F.count(F.lit(1)).alias("size")))
    small = size.where(F.col("size") < min_size).select("c")
    n = small.count()
    if not n:
        return state.select("pos", "c")
    largest = size.orderBy(F.desc("size"), "c").first()[0]
    within = scratch.save(state.join(small, "c", "left_semi").select(F.col("pos").alias("u"), F.col("c").alias("cu")))
    ends = join_unique(links.join(within, "u"), state.select(F.col("pos").alias("v"), F.col("c").alias("cv")), "v", "inner", hot_v).where("cu <> cv")
    goal = ends.groupBy("cu", "cv").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("cu").alias("c")).agg(F.min(F.struct((-F.col("n")).alias("n"), "cv")).alias("x"))
    if merge == "largest":
        goal = goal.where(F.lit(False))
    to = scratch.save(small.join(goal, "c", "left").select("c", F.coalesce("x.cv", F.lit(largest)).alias("p")))
    # merges run in the order of the numbers, so the last of a ring stays; of rings of two that is seen at once
    back = to.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    to = scratch.save(to.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") > F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")).withColumn("top", F.col("c")))
    for _ in range(n.bit_length() + 1):
        ahead = to.select(F.col("c").alias("p"), F.col("p").alias("pp"), F.col("top").alias("ptop"))
        hop = scratch.save(join_unique(to, ahead, "p", "left", heavy_keys(to, "p")).select("c", F.coalesce("pp", "p").alias("p"), F.greatest("top", "ptop").alias("top"), (F.coalesce("pp", "p") != F.col("p")).alias("hopped")))
        to = hop.drop("hopped")
        if not hop.where("hopped").limit(1).count():
            break
    # a goal that is small itself is its own or lies on a ring, whose greatest number stays
    end = to.select(F.col("c").alias("p"), F.col("top").alias("ptop"))
    root = scratch.save(join_unique(to, end, "p", "left", heavy_keys(to, "p")).select("c", F.coalesce("ptop", "p").alias("root")))
    return join_unique(state, root, "c", "left", heavy_keys(state, "c")).select("pos", F.coalesce("root", "c").alias("c"))
