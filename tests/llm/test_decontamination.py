"""Planted copies, exact and with words replaced, against a brute-force overlay of every item on every position."""

import random

import numpy as np

from sieverank.llm import decontamination as D


def brute(text, item):
    """Largest share of the item's words that are equal on one diagonal, and whether a stretch qualifies."""
    a, b = D.words_of(text), D.words_of(item)
    best = 0
    for start in range(-len(b) + 1, len(a)):
        equal = np.array([0 <= start + j < len(a) and a[start + j] == b[j] for j in range(len(b))])
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                if equal[i] and equal[j - 1] and equal[i:j].sum() >= D.SIMILARITY * (j - i):
                    best = max(best, j - i)
    return best


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "w%d" % rng.randrange(4000)
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 7, 15, 30])))) for i in range(20)]
    docs = []
    for k in range(60):
        body = [word() for _ in range(rng.choice([0, 5, 60]))]
        if k % 2:
            copy = items[rng.randrange(20)][1].split()
            if k % 4 == 3:
                for p in rng.sample(range(len(copy)), len(copy) // 10):
                    copy[p] = "changed"
            at = rng.randint(0, len(body))
            body = body[:at] + copy + body[at:]
        docs.append((k, " ".join(body)))
    return items, docs


def test_equal_to_brute_force():
    for seed in range(3):
        items, docs = corpus(seed)
        index = D.Index(items)
        got = {(docs[d][0], index.items[i][0]) for d, i, *_ in D.find(index, [t for _, t in docs])}
        for doc_id, text in docs:
            for item_id, item in items:
                n = len(item.split())
                best = brute(text, item)
                if best >= 0.95 * n or (doc_id, item_id) in got:
                    wanted = best >= max(min(D.MIN_WORDS, n), D.COVERAGE * n)
                    assert ((doc_id, item_id) in got) == wanted, (doc_id, item_id, best, n)


def test_longest_stretch_by_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randint(1, 25))])
        best = 0
        for i in range(len(equal)):
            for j in range(i + 1, len(equal) + 1):
                if equal[i] and equal[j - 1] and equal[i:j].sum() >= D.SIMILARITY * (j - i) - 1e-9:
                    best = max(best, j - i)
        a, b = D.longest_stretch(equal)
        assert b - a == best


def test_blocks_and_odd_rows(spark):
    items, docs = corpus(7)
    bench = spark.createDataFrame([*items, (90, None), (91, ""), items[0]], "item_id long, text string")
    rows = spark.createDataFrame([*docs, (70, None), (71, ""), (None, items[3][1]), docs[1]], "doc_id long, text string").withColumn("item_id", D.F.lit(1))
    one = sorted(map(tuple, D.contaminated(rows, bench).fillna(-1).collect()))
    assert one and one == sorted(map(tuple, D.contaminated(rows, bench, block_words=60).fillna(-1).collect()))
    assert D.contaminated(rows.limit(0), bench).count() == 0
    assert D.contaminated(rows, bench.limit(0)).count() == 0
    kept = {r.doc_id for r in D.drop_contaminated(rows, bench).collect()}
    assert not kept & {r[0] for r in one if r[0] >= 0} and {0, 70, 71} - {r[0] for r in one} <= kept


def test_copies_in_the_fixture_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = bench.collect()
    held = {(r.doc_id, b.item_id) for r in docs.collect() for b in items if b.text in r.text}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert held <= got and len(got - held) <= 0.1 * len(got)


def test_passages_of_long_items_and_several_stretches():
    def hit(item, text):
        return len(list(D.find(D.Index([(1, " ".join(item))]), [" ".join(text)])))

    other = ["o%d" % i for i in range(40)]
    item = ["i%d" % i for i in range(500)]
    assert hit(item, other + item[100:300] + other)
    assert hit(item[:59], other + item[20:45] + other)
    assert hit(item[:59], other + item[20:33] + other) and not hit(item[:59], other + item[20:32] + other)
    assert hit(item[:54], item[:18] + other[:18] + item[36:54])
    # two stretches of 10 on one diagonal, each shorter than LONG_RUN, are half of the item
    assert hit(item[:40], item[:10] + other[:20] + item[30:40])
    assert not hit(item[:40], item[:10] + other[:30])
    assert D.stretches(np.array([1] * 6 + [0] * 6 + [1] * 8 + [0] * 5 + [1] * 5, bool), 5) == [(12, 20), (25, 30), (0, 6)]


def test_recall_over_replaced_words(spark):
    """Copies on unique words with 0 to 20 % of the words replaced, against the overlay of all positions."""
    rng = random.Random(11)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(rng.choice([10, 20, 40])))) for i in range(150)]
    docs, wanted = [], set()
    for i, item in items:
        copy = item.split()
        for p in rng.sample(range(len(copy)), int(len(copy) * (i % 5) * 0.05)):
            copy[p] = "changed"
        text = " ".join(["some", "words"] * 5 + copy + ["more"] * 5)
        docs.append((i, text))
        if brute(text, item) >= max(min(D.MIN_WORDS, len(copy)), D.COVERAGE * len(copy)):
            wanted.add((i, i))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= wanted and len(got) >= 0.95 * len(wanted) and len(wanted) > 130


def test_rows_without_id_and_large_ids_are_judged_by_their_text(spark):
    item = " ".join(f"w{j}" for j in range(20))
    large = (1 << 60) + 1
    rows = [(None, item), (None, "clean text"), (None, None), (large, item), (large + 1, "clean"), (large, "also clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(large, item), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert got == {(None, large), (None, None), (large, large), (large, None)}
    assert {tuple(r) for r in D.drop_contaminated(docs, bench).collect()} == {(None, "clean text"), (None, None), (large + 1, "clean"), (large, "also clean")}
