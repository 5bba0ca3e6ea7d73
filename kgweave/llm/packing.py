"""Filling fixed-capacity containers with items: sum-of-squares online packing.

Each item goes to the fill level for which the sum of squared counts of partially filled containers grows least; a level
array holds the counts, so placing an item costs one vector operation over the levels. Items are packed in shards of a
bounded size in parallel; what shards leave nearly empty is packed once more together. Items longer than a container are
cut at the capacity, all others stay whole.
"""

from __future__ import annotations

import base64
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.runtime import Scratch

#: Items of one shard, about; each is packed in one task.
SHARD_ITEMS = 20_000
#: Containers filled less than this share are opened again and packed with those of other shards.
REPACK_BELOW = 0.9
#: Containers a run may have (a table of settings).
MAX_WINDOWS = 1_000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The public byte-level tokenizer at ``path``, once a process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document, over the whole text; null and empty texts have none."""
    path = tokenizer or os.environ.get("KGWEAVE_TOKENIZER", TOKENIZER)

    def run(batches):
        enc = encoding(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id bigint, n_tokens bigint")


class Packer:
    """Sum-of-squares packing of sizes 1..capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # containers at each fill level; level 0 and capacity stay 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset) for an item."""
        cap, n = self.capacity, self.count
        if size >= cap:
            self.made += 1
            return self.made - 1, 0
        # level h -> h + size: the squares change by 1 - 2 n[h] and, below capacity, 1 + 2 n[h + size]
        change = np.full(cap - size + 1, np.iinfo(np.int64).max)
        change[0] = 1 + 2 * n[size]
        here = n[1 : cap - size + 1]
        there = n[1 + size : cap + 1]
        cost = 2 - 2 * here + 2 * there
        cost[-1] = 1 - 2 * here[-1]  # exactly full
        change[1:] = np.where(here > 0, cost, change[1:])
        # of equals the fullest level, which leaves least space
        level = cap - size - int(np.argmin(change[::-1]))
        if level:
            box = self.open[level].pop()
            n[level] -= 1
        else:
            box = self.made
            self.made += 1
        if level + size < cap:
            n[level + size] += 1
            self.open[level + size].append(box)
        return box, level


def pack_sizes(sizes, capacity: int) -> list[tuple[int, int]]:
    """(container, offset) of each size, in the given order."""
    packer = Packer(capacity)
    return [packer.place(int(s)) for s in sizes]


def pack(documents: DataFrame, windows: DataFrame, tokenizer: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """window_id, doc_id, piece, token_start, n_tokens, container, container_offset for every document and container size.

    ``container`` is a string that is unique within the window_id; pieces of a document longer than the capacity have
    numbers from 0 and token ranges, all but the last fill a container alone. Documents without tokens (null, empty)
    take container '-' at offset 0, as they need no room. Repeated doc_ids are packed as repeated items. Windows with a
    null or non-positive capacity are left out. Extra columns are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    schema = "window_id int, doc_id bigint, piece int, token_start bigint, n_tokens int, container string, container_offset int"
    caps = [(r[0], r[1]) for r in windows.where("capacity_tokens > 0").select("window_id", "capacity_tokens").distinct().orderBy("window_id").limit(MAX_WINDOWS + 1).collect()]
    if len(caps) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} container sizes")
    if not caps:
        return spark.createDataFrame([], schema)
    counted = scratch.save(token_counts(documents, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(counted.count() / shard_items))
    settings = F.array(*(F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c).cast("int").alias("capacity")) for w, c in caps))
    sized = counted.where("n_tokens > 0").select("row", "doc_id", "n_tokens", F.explode(settings).alias("w")).select("row", "doc_id", "n_tokens", "w.*")
    n_full = F.expr("n_tokens div capacity")
    rest = F.col("n_tokens") - n_full * F.col("capacity")
    # full pieces are containers of their own and need no packing
    full = sized.where(n_full > 0).select("window_id", "row", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), n_full - 1)).alias("k")).select(
        "window_id", "doc_id", F.col("k").cast("int").alias("piece"), (F.col("k") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"),
        F.concat(F.lit("f"), F.col("row"), F.lit("."), F.col("k")).alias("container"), F.lit(0).alias("container_offset"),
    )
    items = sized.where(rest > 0).select("window_id", "capacity", "doc_id", n_full.cast("int").alias("piece"), (n_full * F.col("capacity")).alias("token_start"), rest.cast("int").alias("n_tokens"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def first(key, pdf):
        # the online order is by a hash, which mixes long and short items at any size of the table
        order = np.argsort([hash((int(d), int(p))) & 0xFFFFFFFF for d, p in zip(pdf["doc_id"], pdf["piece"])], kind="stable")
        pdf = pdf.iloc[order].reset_index(drop=True)
        placed = pack_sizes(pdf["n_tokens"], int(pdf["capacity"].iloc[0])) if len(pdf) else []
        pdf["container"] = [f"s{key[1]}.{b}" for b, _ in placed]
        pdf["container_offset"] = [o for _, o in placed]
        pdf["filled"] = pdf.groupby("container")["n_tokens"].transform("sum")
        return pdf[["window_id", "capacity", "doc_id", "piece", "token_start", "n_tokens", "container", "container_offset", "filled"]]

    packed = scratch.save(items.groupBy("window_id", "shard").applyInPandas(first, "window_id int, capacity int, doc_id bigint, piece int, token_start bigint, n_tokens int, container string, container_offset int, filled bigint"))
    poor = F.col("filled") < REPACK_BELOW * F.col("capacity")
    good = packed.where(~poor).select("window_id", "doc_id", "piece", "token_start", "n_tokens", "container", "container_offset")
    # what is left is packed again over several shards at a time, longest first; the shards' leavings are few
    left = packed.where(poor)
    groups = max(1, math.ceil(left.count() / shard_items))

    def again(key, pdf):
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        placed = pack_sizes(pdf["n_tokens"], int(pdf["capacity"].iloc[0])) if len(pdf) else []
        pdf["container"] = [f"r{key[1]}.{b}" for b, _ in placed]
        pdf["container_offset"] = [o for _, o in placed]
        return pdf[["window_id", "doc_id", "piece", "token_start", "n_tokens", "container", "container_offset"]]

    regrouped = left.withColumn("g", F.pmod(F.xxhash64("container"), F.lit(groups)).cast("int"))
    repacked = regrouped.groupBy("window_id", "g").applyInPandas(again, schema)
    nothing = counted.where("n_tokens = 0").select(F.explode(settings).alias("w"), "doc_id").select(
        F.col("w.window_id").alias("window_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).alias("n_tokens"), F.lit("-").alias("container"), F.lit(0).alias("container_offset")
    )
    return good.unionByName(repacked).unionByName(full).unionByName(nothing)


def fill_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id, containers, tokens, fewest (the lower bound of containers), fill (share of the space used)."""
    caps = windows.where("capacity_tokens > 0").select("window_id", F.col("capacity_tokens").alias("capacity")).distinct()
    boxes = packed.where("container <> '-'").groupBy("window_id", "container").agg(F.sum("n_tokens").alias("t"))
    sums = boxes.groupBy("window_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens")).join(caps, "window_id")
    return sums.select("window_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
