import random

from pyspark.sql import functions as F

from kgweave.llm import leakage as L

WORDS = [a + b for a in ("ka", "mo", "ti", "re", "su", "pa", "lo") for b in ("ran", "del", "vik", "tos", "mer", "lin", "gat", "bor")]


def passage(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n)]


def test_planted_cases(spark):
    rng = random.Random(5)
    items = {k: passage(rng, 80) for k in range(12)}
    filler = lambda n: [rng.choice(("a", "of", "the", "to", "and")) + str(rng.randrange(99)) for _ in range(n)]
    docs, want = [], set()

    def add(words, hit=None):
        docs.append((len(docs), " ".join(words)))
        if hit is not None:
            want.add((len(docs) - 1, hit))

    for k, p in items.items():
        add(filler(30) + p + filler(30), k)
        add(filler(9) + p[10:35] + filler(9), k)  # just enough
        add(filler(9) + p[10:34] + filler(9))  # one word short
        edited = p[5:45]
        edited[12] = "other"
        del edited[24]
        add(filler(5) + edited + filler(5), k)
        add(filler(5) + p[:14] + filler(40) + p[50:64] + filler(5), k)  # two pieces
        add(filler(5) + p[:10] + filler(40) + p[50:60])
        add([w.upper() + "," for w in p[20:60]], k)
    text = [(k, f"Read the passage and answer.\n\n{' '.join(p)}.\n\nWho did it?", 1) for k, p in items.items()]
    it = spark.createDataFrame(text + [(99, "", 1), (98, None, 1), (None, "x", 1)], "item_id bigint, text string, doc_id int")
    df = spark.createDataFrame(docs + [(0, docs[0][1]), (5000, None), (5001, "")], "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("n", F.lit(0))
    got = L.leaked(df, it)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and got.count() == len(want)
    assert L.leaked(df.limit(0), it).count() == 0 and L.leaked(df, it.limit(0)).count() == 0


def test_layout_markup_and_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(passage(rng, 60))) for k in range(5)]
    monkeypatch.setattr(L, "BLOCK_SHINGLES", 100)
    broken = items[3][1][:-2] + "-\n> " + items[3][1][-2:]
    docs = [(1, "<p>" + items[0][1].replace(" ", "</b> <b>") + "</p>"), (2, "x " * 60_000 + items[4][1]), (3, broken)]
    got = L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 0), (2, 4), (3, 3)}


def test_second_piece_after_many_of_the_first():
    rng = random.Random(7)
    item = [w + str(k) for k, w in enumerate(passage(rng, 60))]
    doc = []
    for k in range(60):
        doc += item[5:25] + [f"x{k}y{j}" for j in range(300)]
    doc += item[40:48]
    hits = [(d, i) for d in range(len(doc) - 4) for i in range(56) if doc[d : d + 5] == item[i : i + 5]]
    assert L.carried_words(doc, item, hits) == (28, 2)


def test_two_edited_pieces(spark):
    rng = random.Random(10)
    item = [w + str(k) for k, w in enumerate(passage(rng, 80))]
    a, b = item[5:19], item[55:69]
    a[7], b[7] = "other", "word"  # 13 and 13 words
    doc = " ".join(["the"] * 5 + a + [f"x{k}" for k in range(40)] + b)
    got = L.leaked(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["carried_words"], r["pieces"]) for r in got] == [(1, 7, 26, 2)]


def test_a_long_run_before_short_ones_is_chained():
    item = [f"w{k}" for k in range(295)]
    item += item[20:25]
    doc = item[:260] + ["q"] + item[261:290]  # the first run starts before a short one that ends long before the next
    hits = [(d, i) for d in range(len(doc) - 4) for i in range(296) if doc[d : d + 5] == item[i : i + 5]]
    assert L.carried_words(doc, item, hits) == (289, 1)


def test_every_paragraph_of_a_passage_counts(spark):
    rng = random.Random(12)
    items, docs = [], []
    for k in range(3):
        a, b = passage(rng, 40), passage(rng, 29)
        items.append((k, "Read the passage and answer.\n\n" + " ".join(a) + ".\n\n" + " ".join(b) + ".\n\nWho did it, " + " ".join(passage(rng, 30)) + "?"))
        docs.append((k, "so " * 9 + " ".join(b)))  # the shorter paragraph
        docs.append((10 + k, "so " * 9 + items[-1][1].split("\n\n")[-1]))  # the question
    got = L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["carried_words"]) for r in got) == [(k, k, 29) for k in range(3)]


def test_short_items_with_a_lower_bound(spark):
    rng = random.Random(13)
    item = passage(rng, 9)
    assert L.least_shared(25) == 2 and L.least_shared(9) == 1
    got = L.leaked(spark.createDataFrame([(1, "so so " + " ".join(item) + " so")], "doc_id bigint, text string"), spark.createDataFrame([(4, " ".join(item))], "item_id bigint, text string"), min_words=9).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 4)]
