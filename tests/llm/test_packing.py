import os
import random

import pytest
from pyspark.sql import functions as F

from kgweave.llm import packing as K


def test_place_minimises_the_squares():
    rng = random.Random(2)
    cap = 23
    p = K.Packer(cap)
    level = {}
    for _ in range(400):
        s = rng.randrange(1, cap + 1)
        counts = [0] * (cap + 1)
        for v in level.values():
            if v < cap:
                counts[v] += 1
        base = sum(c * c for c in counts)

        def cost(h):
            c = list(counts)
            if h:
                c[h] -= 1
            if h + s < cap:
                c[h + s] += 1
            return sum(x * x for x in c) - base

        best = min(cost(h) for h in [0] + [h for h in range(1, cap - s + 1) if counts[h]])
        box, at = p.place(s)
        assert level.get(box, 0) == at and at + s <= cap and (s == cap or cost(at) == best)
        level[box] = at + s


def test_uniform_sizes_pack_well():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 200) for _ in range(5000)]
    boxes = {b for b, _ in K.pack_sizes(sizes, 500)}
    assert len(boxes) <= 1.02 * -(-sum(sizes) // 500)


@pytest.mark.skipif(not os.path.exists(K.TOKENIZER), reason="no tokenizer files")
def test_nothing_is_lost_cut_or_overfull(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "né", "x1"]) for _ in range(rng.randrange(0, 90))) for _ in range(300)] + ["word " * 3000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id bigint, text string").withColumn("capacity", F.lit("clash")).withColumn("row", F.lit(1))
    windows = spark.createDataFrame([(1, 128), (2, 1024), (3, None), (4, 0)], "window_id int, capacity_tokens int")
    got = K.pack(df, windows, shard_items=60).collect()
    enc = K.encoding(K.TOKENIZER)
    n = {k: len(enc.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}
    for w, cap in ((1, 128), (2, 1024)):
        rows = [r for r in got if r["window_id"] == w]
        fill = {}
        for r in rows:
            if r["container"] != "-":
                fill.setdefault(r["container"], []).append((r["container_offset"], r["n_tokens"]))
        for spans in fill.values():
            spans.sort()
            assert all(a + k <= b for (a, k), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= cap
        for k, total in n.items():
            mine = sorted((r["token_start"], r["n_tokens"]) for r in rows if r["doc_id"] == k)
            assert sum(x for _, x in mine) == total * (2 if k == 3 else 1)
            assert k == 3 or total <= cap and len(mine) == 1 or total > cap and [s for s, _ in mine] == [cap * i for i in range(len(mine))]
    assert {r["window_id"] for r in got} == {1, 2}
    assert min(r["fill"] for r in K.fill_report(spark.createDataFrame(got), windows).collect()) > 0.9
    assert K.pack(df.limit(0), windows).count() == 0 and K.pack(df, windows.limit(0)).count() == 0
