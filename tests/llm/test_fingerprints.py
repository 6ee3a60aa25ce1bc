"""Edited texts by hand, syncmers by their definition, likeness against exact shares, defined results."""

import hashlib
import random

from pyspark.sql import functions as F

from sieverank.llm import fingerprints as P


def test_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in P.fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    good = 0
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        prints.setdefault(text, set()).add(r.fingerprint)
        good += r.near_edited > r.near_next + 0.2 or text == after
    assert all(len(v) == 1 for v in prints.values())
    assert good >= 0.97 * len(rows)


def test_anchors_are_closed_and_free_of_context(spark):
    rng = random.Random(2)
    words = ["w%d" % rng.randrange(50) for _ in range(200)]
    text = " ".join(words)
    df = spark.createDataFrame([(1, text), (2, "other words come first here " * 8 + text)], "doc_id long, text string")
    hashed = spark.createDataFrame([(a, b) for a, b in zip(words, words[1:])], "a string, b string").select(F.xxhash64("a", "b").alias("g")).collect()
    g = [r.g for r in hashed]
    want = [i for i in range(len(g) - 3) if min(g[i : i + 4]) in (g[i], g[i + 3])]
    found = P.anchors(df).collect()
    one = sorted((r["at"], r.anchor) for r in found if r.doc_id == 1)
    assert [a for a, _ in one] == want
    two = {(r["at"], r.anchor) for r in found if r.doc_id == 2}
    assert {(a + 40, h) for a, h in one} <= two


def test_likeness_is_exact_for_small_sets(spark):
    a, b = " ".join(f"x{i}" for i in range(60)), " ".join(f"x{i}" for i in range(20, 80))
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    sets = {}
    for r in P.anchors(df).collect():
        sets.setdefault(r.doc_id, set()).add(r.anchor & 0xFFFFFFFF)
    want = len(sets[1] & sets[2]) / len(sets[1] | sets[2])
    got = {r.doc_id: r for r in P.fingerprint_edits(df).collect()}
    union = sorted(sets[1] | sets[2])[: P.SKETCH]
    assert got[1].near_next == len([x for x in union if x in sets[1] & sets[2]]) / len(union)
    assert abs(got[1].near_next - want) < 0.2


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "c"), (1, None, "c"), (2, "", "c"), (3, "ab", "c"), (3, "abcd efgh", "c"), (None, "x" * 50, "c")], "doc_id long, text string, h string")
    got = P.fingerprint_edits(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 2, 9, 50]
    assert all(r.fingerprint == "" and r.near_edited == 1.0 for r in got if r.n_chars == 0)
    assert P.fingerprint_edits(df.limit(0)).count() == 0
    (one,) = P.fingerprint_edits(df.filter("doc_id = 2")).collect()
    assert one.near_next == 1.0


def test_texts_on_both_sides_of_the_limit_are_compared_alike(spark):
    text = " ".join(f"word{i}" for i in range(32))
    df = spark.createDataFrame([(1, text), (2, text.rsplit(" ", 1)[0]), (3, "x" * 600)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.fingerprint_edits(df).collect()}
    assert got[1].near_next > 0.8  # 32 words and 31 of them
    assert got[2].near_edited > 0.4 and got[2].near_next == 0
    long = " ".join(f"word{i}" for i in range(40))
    tail = spark.createDataFrame([(1, long), (2, "y" * 600)], "doc_id long, text string")
    one = {r.doc_id: r for r in P.fingerprint_edits(tail).collect()}[1]  # the edited text has 31 words or fewer
    assert one.near_edited > 0.4


def test_every_text_has_an_anchor(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([8, 9]))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in P.anchors(df).collect()} == set(range(200))
