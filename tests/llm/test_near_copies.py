"""Near copies against all pairs by their real shingle likeness."""

import random
from itertools import combinations

import numpy as np
import pandas as pd

from sieverank.llm import simhash as S


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def least_ids(rows):
    """The smallest id that links of Jaccard likeness 0.8 or more reach, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = {i: i for i, _ in rows}
    links = [(rows[i][0], rows[j][0]) for i, j in combinations(range(len(rows)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in S.keep_representatives(docs).collect()}


def test_texts_below_the_likeness_stay(spark):
    rng = random.Random(3)
    rows, loose = [], 0
    for k in range(30):  # likeness of about 0.7: within WIDE_BITS as often as not
        words = ["w%d" % rng.randrange(5000) for _ in range(300)]
        copy = list(words)
        for p in rng.sample(range(2, 298), 11):
            copy[p] = "new"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = (np.array(S.wide_fingerprint(S.shingle_hashes(S.normal_words(t)))).view(np.uint64) for _, t in rows[-2:])
        loose += np.bitwise_count(a ^ b).sum() <= S.WIDE_BITS
    want = least_ids(rows)
    assert loose >= 5 and all(i == r for i, r in want.items())
    assert kept(spark, rows) == set(want)


def test_equal_to_all_pairs(spark):
    rng = random.Random(5)
    passage = ["common%d" % i for i in range(80)]  # in many texts that are not alike
    rows = []
    for k in range(60):
        words = ["w%d" % rng.randrange(5000) for _ in range(rng.choice([4, 30, 300]))]
        words += passage[: rng.choice([0, 80])]
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):  # likeness about 0.8, on either side
            copy = list(words)
            for p in rng.sample(range(len(copy)), round(len(copy) * rng.choice([0.01, 0.02, 0.025]))):
                copy[p] = "new%d" % rng.randrange(5000)
            rows.append((len(rows), " ".join(copy)))
    want = least_ids(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 8):
        assert {r.doc_id: r.component_id for r in S.near_copies(docs, block=block).collect()} == want


def test_prefixes_and_bounds_keep_every_alike_pair():
    rng = np.random.default_rng(2)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for n in (*range(1, 40), 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = rng.integers(0, len(a) // 5 + 1)
            b = np.sort(np.r_[a[cut:], rng.integers(0, 2**63, rng.integers(0, len(a) // 4 + 1)).astype(np.uint64)])
            if S.alike(a, b):
                assert len(np.intersect1d(S.prefix_keys(a, none), S.prefix_keys(b, none))) >= S.guaranteed(len(a), len(b))
                assert S.may_be_alike(np.array([len(a), len(b)]), np.stack([S.parity(a), S.parity(b)]).view(np.uint64), 0, np.array([1])).all()


def test_stage_on_the_fixture(spark):
    """The near-dedup and decontamination stages against all pairs by their real likeness and whole items."""
    import corpus_pipeline

    fixture = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["language_id"](spark, spark.read.parquet(f"{fixture}/documents.parquet"), fixture).cache()
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    out = stages["simhash_near_dedup"](spark, docs, fixture)
    left = {r.doc_id: r.text for r in out.collect()}
    assert set(left) == {i for i, r in least_ids(rows).items() if i == r}
    items = [r.text for r in spark.read.parquet(f"{fixture}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["benchmark_decontamination"](spark, out, fixture).collect()}
    assert set(left) - clean == {i for i, t in left.items() if any(x in t for x in items)}


def test_nulls_and_copies_without_ids(spark):
    base = " ".join("w%d" % i for i in range(200))
    near = base.replace("w150 ", "other ")
    rows = [(None, base), (None, base), (None, near), (7, near.upper()), (3, None), (4, ""), (9, "alone")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node long, known long")
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_copies(docs).collect())
    assert got == [(-1, 7), (-1, 7), (-1, 7), (3, 3), (4, 3), (7, 7), (9, 9)]
    assert S.near_copies(docs.limit(0)).count() == 0
    assert S.unpacked_set(S.packed_set(np.array([2**63, 5 << 30, 5 << 30], np.uint64))).tolist() == [5 << 6, 2**39]


def test_rows_of_a_large_posting_stay_below_its_rows():
    """Pairs of a posting are not written out: 400 sets that may all be alike are joined by 399 links, not by 79,800."""
    n = 400
    rows = pd.DataFrame({"key": 1, "lo": 0, "hi": 0, "block": 0, "node": np.arange(n), "known": np.arange(n), "size": 100, **{m: 0 for m in S.SKETCH}})
    other = rows[:20].assign(key=2, node=np.arange(20) + n, known=np.arange(20) + n)
    out = pd.concat(S.possible_links(iter([rows[:150], rows[150:], other])))
    assert len(out) == n - 1 + 19
    assert len(pd.concat(S.possible_links(iter([rows.assign(known=7)])))) == 0


def test_alike_sets_of_a_family_across_blocks():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.sort(np.r_[base[k:], rng.integers(0, 2**63, k).astype(np.uint64)]) for k in (0, 0, 3, 3, 60, 90)]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = [(i, i, i % 2, len(s), *S.parity(s).tolist(), S.prefix_keys(s, none).view(np.int64), S.packed_set(s)) for i, s in enumerate(sets)]
    rows = pd.DataFrame(found, columns=["node", "known", "block", "size", *S.SKETCH, "keys", "shingles"])
    label = {}
    for a, b in S.alike_links(rows, False):
        label[a] = label[b] = 1
    want = {i for i in range(6) for j in range(6) if i != j and S.alike(sets[i], sets[j])}
    assert set(label) == want and len(S.alike_links(rows, False)) == len(want) - 1
    assert all(a % 2 != b % 2 for a, b in S.alike_links(rows, True))


def test_tally_alone_joins_no_nodes_by_their_components():
    keys = [[1, 2, 3], [7, 8, 9], [1, 2, 3], [7, 8, 9]]
    rows = pd.DataFrame({"node": range(4), "known": [0, 0, 5, 5], "block": 0, "size": 10, **{m: 0 for m in S.SKETCH}, "keys": [np.array(k) for k in keys]})
    assert sorted(S.alike_links(rows, False)) == [(0, 2), (1, 3)]
