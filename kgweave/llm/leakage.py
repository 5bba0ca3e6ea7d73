"""Evaluation texts leaking into training text: a prefix-filtered set join of five-word shingles, verified by alignment.

The held-out items are the small side. Their shingles are ordered by rarity in the corpus; of every item-sized window of
``min_words`` words only the necessary prefix (its rarest shingles) is indexed: a document that shares enough shingles of
the window must share one of these. Documents are scanned twice where they lie and never shuffled: once to count the
items' shingles, once to look up the index, apply the length and positional bounds and align the words. The index is
broadcast in blocks of bounded size, so any number of items works.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.runtime import heavy_keys, join_unique

SHINGLE = 5
#: Words of an item's passage that a document must carry.
MIN_WORDS = 25
#: A gap between two exact runs of one piece, in words, on either side.
MAX_GAP = 4
#: A piece is running text of at least so many words.
MIN_PIECE = 8
#: Shingles in one block of the broadcast index (about 100 MB of Python objects at most).
BLOCK_SHINGLES = 400_000

_TAG = re.compile(r"<[/!a-zA-Z][^<>]{0,300}>")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[\s>|#*/;%-]*(?=[^\W\d_])")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words in lower case without markup, invisible characters, accents' forms or breaks at line ends."""
    if not text:
        return []
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", html.unescape(text) if "&" in text else text))
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "-" in t:
        t = _BROKEN.sub("", t)
    return _WORD.findall(t.casefold())


def least_shared(min_words: int) -> int:
    """Shingles that some window of ``min_words`` words keeps at least: those of the larger of two pieces, in which exact runs
    of one shingle follow each other with less than MAX_GAP words between them."""
    return 1 + max(0, -(-min_words // 2) - SHINGLE) // (SHINGLE + MAX_GAP - 1)


def passage_of(paragraphs: list[tuple[str, bool]]) -> list[str]:
    """Words of an item's passage: its longest paragraph, and the others that are neither a question nor, as instructions are,
    shared by several items. ``paragraphs`` are (text, shared)."""
    words = [words_of(p) for p, _ in paragraphs]
    longest = max(range(len(words)), key=lambda k: len(words[k]), default=0)
    return [w for k, (p, shared) in enumerate(paragraphs) if k == longest or not (shared or p.rstrip().endswith(("?", ":"))) for w in words[k]]


def _key(words: list[str], at: int) -> int:
    return xxhash.xxh64_intdigest(" ".join(words[at : at + SHINGLE])) - (1 << 63)


def _shingles(words: list[str], known: frozenset | set) -> list[tuple[int, int]]:
    """(position, key) of the shingles made of known words only."""
    out, run = [], 0
    for i, w in enumerate(words):
        run = run + 1 if w in known else 0
        if run >= SHINGLE:
            at = i - SHINGLE + 1
            out.append((at, _key(words, at)))
    return out


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def carried_words(doc: list[str], item: list[str], hits: list[tuple[int, int]]) -> tuple[int, int]:
    """(words, pieces): the most words of ``item`` that ``doc`` carries in one or two pieces of running text.

    ``hits`` are (doc position, item position) of common shingles. Exact runs are grown word by word, chained over gaps
    of up to MAX_GAP words, and the best two pieces that take different parts of the item are summed.
    """
    runs, seen = [], set()
    for d, i in sorted(hits):
        if (d, i) in seen:
            continue
        a, b = d, i
        while a and b and doc[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        e, f = d, i
        while e < len(doc) and f < len(item) and doc[e] == item[f]:
            seen.add((e, f))
            e, f = e + 1, f + 1
        runs.append((a, b, e - a))
    runs = sorted(set(runs))
    longest = max((n for _, _, n in runs), default=0)
    best: list[tuple[int, int, int]] = []  # of pieces ending with each run: words, item start, item end
    for k, (d, i, n) in enumerate(runs):
        top = (n, i, i + n)
        for j in range(k - 1, -1, -1):
            pd_, pi, pn = runs[j]
            if d - pd_ > longest + MAX_GAP:  # no earlier run reaches so far
                break
            gd, gi = d - pd_ - pn, i - pi - pn
            over = max(0, -gd, -gi)
            if over < n and gd + over <= MAX_GAP and gi + over <= MAX_GAP and i > pi and d > pd_:
                gap = _lcs(doc[pd_ + pn : d], item[pi + pn : i]) if gd > 0 and gi > 0 else 0
                words = best[j][0] + n - over + gap
                if words > top[0]:
                    top = (words, best[j][1], i + n)
        best.append(top)
    pieces = [p for p in best if p[0] >= MIN_PIECE]
    if not pieces:
        return 0, 0
    one = max(p[0] for p in pieces)
    # the best piece that ends at or before each point of the item, and the best that starts there or after
    ends, starts = [0] * (len(item) + 1), [0] * (len(item) + 1)
    for n, start, end in pieces:
        ends[end], starts[start] = max(ends[end], n), max(starts[start], n)
    for x in range(1, len(item) + 1):
        ends[x] = max(ends[x], ends[x - 1])
        starts[-1 - x] = max(starts[-1 - x], starts[-x])
    two = max((a + b for a, b in zip(ends, starts) if a and b), default=0)
    return (two, 2) if two > one else (one, 1)


def _item_words(items: DataFrame):
    """The held-out items' ids and passages, one after the other; no more than a block of them is ever held."""
    rows = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    parts = rows.select("item_id", "text", F.posexplode(F.split("text", r"\n\s*\n")).alias("at", "part")).withColumn("key", F.lower(F.trim("part")))
    shared = parts.groupBy("key").agg((F.count_distinct("item_id") > 1).alias("shared"))
    whole = join_unique(parts, shared, "key", "inner", heavy_keys(parts, "key")).groupBy("item_id", "text").agg(F.sort_array(F.collect_list(F.struct("at", "part", "shared"))).alias("x"))
    for r in whole.select("item_id", "x.part", "x.shared").toLocalIterator():
        yield r[0], passage_of(list(zip(r[1], r[2])))


def _blocks(items):
    block, n = [], 0
    for x in items:
        if block and n + len(x[1]) > BLOCK_SHINGLES:
            yield block
            block, n = [], 0
        block.append(x)
        n += len(x[1])
    if block:
        yield block


def leaked(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, carried_words, pieces, item_words: documents that carry ``min_words`` or more of an item's passage.

    Repeated rows give one case; null or empty texts, items of fewer words than ``min_words`` and null ids give none.
    Case, punctuation, markup, hyphenation at line ends and up to MAX_GAP changed words between runs do not matter.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    parts = [_leaked_block(docs, block, min_words) for block in _blocks(x for x in _item_words(items) if len(x[1]) >= min_words)]
    schema = "doc_id bigint, item_id bigint, carried_words int, pieces int, item_words int"
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("carried_words", "pieces", "item_words"), "carried_words").alias("x")).select("doc_id", "item_id", "x.*")


def _leaked_block(docs: DataFrame, block: list[tuple[int, list[str]]], min_words: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast(frozenset(w for _, ws in block for w in ws))
    wanted = sc.broadcast(frozenset(_key(ws, k) for _, ws in block for k in range(len(ws) - SHINGLE + 1)))

    def count(batches):
        counts: dict[int, int] = defaultdict(int)
        for pdf in batches:
            for text in pdf["text"]:
                for key in {k for _, k in _shingles(words_of(text), vocabulary.value)} & wanted.value:
                    counts[key] += 1
        yield pd.DataFrame({"key": list(counts), "n": list(counts.values())}, columns=["key", "n"]).astype("int64")

    # at most one row an indexed shingle, so bounded by BLOCK_SHINGLES
    rarity = {r[0]: r[1] for r in docs.select("text").mapInPandas(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n")).collect()}

    window = min_words - SHINGLE + 1
    shared_least = least_shared(min_words)
    prefix = max(1, window - shared_least + 1)
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)  # all shingles of the items, for positions
    first: set[int] = set()  # shingles in a necessary prefix of some window
    for k, (_, ws) in enumerate(block):
        keys = [_key(ws, i) for i in range(len(ws) - SHINGLE + 1)]
        for i, key in enumerate(keys):
            if key in rarity:
                index[key].append((k, i))
        order = sorted(range(len(keys)), key=lambda i: (rarity.get(keys[i], 0), keys[i]))
        rank = {i: r for r, i in enumerate(order)}
        for s in range(max(1, len(keys) - window + 1)):
            first.update(keys[i] for i in sorted(range(s, min(s + window, len(keys))), key=rank.__getitem__)[:prefix])
    shared = sc.broadcast((block, dict(index), frozenset(first & rarity.keys())))

    def find(batches):
        block, index, first = shared.value
        known = vocabulary.value
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = words_of(text)
                if len(words) < min_words:
                    continue
                shingles = [(d, key) for d, key in _shingles(words, known) if key in index]
                if len(shingles) < shared_least or not any(key in first for _, key in shingles):
                    continue
                hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
                opened = {k for _, key in shingles if key in first for k, _ in index[key]}
                for d, key in shingles:
                    for k, i in index[key]:
                        if k in opened:
                            hits[k].append((d, i))
                for k, found in hits.items():
                    if len({i for _, i in found}) < shared_least:  # too few shingles of the item for min_words words
                        continue
                    n, pieces = carried_words(words, block[k][1], found)
                    if n >= min_words:
                        rows.append((doc_id, block[k][0], n, pieces, len(block[k][1])))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "carried_words", "pieces", "item_words"])

    return docs.mapInPandas(find, "doc_id bigint, item_id bigint, carried_words int, pieces int, item_words int")
