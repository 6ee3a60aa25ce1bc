"""Fingerprints and components against brute force."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash

from sieverank.llm import simhash as S


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_triples_cover_all_fours():
    triples = [set(t) for t in S.covering_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_fingerprints():
    rng = random.Random(1)
    parts = ["The", "of", "ÉTÉ", "été", "\x0b", "\n", " ", " ", " ", "a\x1cb", "　", "x"]
    for n in [0, 1, 3, 8, 60, 3000]:
        for _ in range(30 if n < 1000 else 3):
            text = "".join(rng.choice(parts) for _ in range(n))
            assert S.fingerprint(text) == brute_fingerprint(text)
    assert S.fingerprint(None) == 0


def test_components_of_fixture_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f, rows[c].doc_id) for r, f, c in zip(rows, fps, brute_components(fps), strict=True)}
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == want


def test_links_in_large_postings(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for block in (4096, 40):
        roots = {r.node: r.root for r in S.components(S.fingerprint_links(nodes, block)).collect()}
        want = brute_components(fps)
        signed = [int(np.uint64(f).view(np.int64)) for f in fps]
        ours = [roots.get(f, f) for f in signed]
        groups = lambda labels: sorted(sorted(np.flatnonzero(np.array(labels) == x).tolist()) for x in set(labels))
        assert groups(ours) == groups(want)


def test_postings_across_batches():
    rng = random.Random(6)
    rows = sorted((k, 0, 0, 0, rng.getrandbits(3)) for k in range(20) for _ in range(rng.choice([1, 2, 9, 50])))
    frame = pd.DataFrame(rows, columns=["key", "lo", "hi", "block", "fp"]).assign(node=lambda f: f["fp"])
    whole = pd.concat(S.posting_links([frame]))
    for step in (1, 3, 17):
        parts = pd.concat(list(S.posting_links([frame[i : i + step] for i in range(0, len(frame), step)])))
        assert set(map(tuple, parts.values)) == set(map(tuple, whole.values))


def test_nulls_empty_repeated(spark):
    docs = spark.createDataFrame([(5, None, 1), (3, "", 2), (3, "", 2), (9, "one two", 3), (None, "one two", 4)], "doc_id long, text string, fp long")
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == [(-1, 9), (3, 3), (3, 3), (5, 3), (9, 9)]
    assert S.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in S.keep_representatives(docs).collect()) == [-1, 3, 3, 9]
