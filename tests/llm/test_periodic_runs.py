"""Runs against a plain scan of every lag, and the query against the contract worked out word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieverank.llm import periodic_runs as P
from sieverank.llm.queries import op12_periodic_runs

DATA = "/root/testdata/sf0.001"


def plain(words):
    """(start, length, period) of all runs; lags ascend, so the smallest period of a stretch comes first."""
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                seen.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, k, q) for (s, k), q in seen.items())


def varied(rng, n):
    ids = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 30 else 0):
        a, p = rng.randrange(n - 10), rng.randrange(1, 20)
        for i in range(a + p, min(n, a + rng.randrange(10, 150))):
            ids[i] = ids[i - p]
    return ids


@pytest.mark.parametrize("weight, pairs", [(1e-4, 2_000_000), (3.0, 2_000_000), (1e9, 50)])
def test_counts_and_runs_equal_a_plain_scan(monkeypatch, weight, pairs):
    monkeypatch.setattr(P, "PAIRS_A_POINT", weight)  # all light, mixed, all heavy
    monkeypatch.setattr(P, "PAIRS", pairs)
    rng = random.Random(4)
    for _ in range(150):
        ids = np.array(varied(rng, rng.randrange(1, 250)), dtype=np.int64)
        n = len(ids)
        counts = P.lag_matches(ids, n // 3)
        assert counts[1:].tolist() == [int((ids[q:] == ids[: n - q]).sum()) for q in range(1, n // 3 + 1)]
        assert P.find_runs(ids) == plain(ids.tolist())


def test_one_word_over_and_over_is_scanned_once():
    assert P.find_runs(np.zeros(60_000, dtype=np.int64)) == [(0, 60_000, 1)]
    assert P.find_runs(np.arange(40_000) % 7) == [(0, 40_000, 7)]


def test_collapse_keeps_the_first_period():
    words = "x a b a b a b a b y".split()
    assert P.collapse(words, [(1, 8, 2)]) == "x a b y"
    assert P.collapse([], []) == ""


def by_hand(doc_id, text):
    words = re.findall(P.WORD, text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = (None,) * 4
    if runs:
        s, k, q = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
        best = (s, k, q, 1000 * k // q)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_the_contract(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter(F.length("text") < 4000).collect()
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    want = {r.doc_id: by_hand(r.doc_id, r.text) for r in docs}
    assert {k: got[k] for k in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_nulls_empty_texts_repeated_rows_and_other_columns(spark):
    text = "one " * 30 + "two three four"
    rows = [(None, text, "a"), (7, None, "b"), (7, "", None), (8, text, "a"), (8, text, "a"), (9, " \t\n", "c"), (10, "\u00a0x " * 40, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = P.run_digest(P.periodic_runs(P.with_planted_periods(docs))).collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted((by_hand(i, t) for i, t, _ in rows), key=key)
    assert P.run_digest(P.periodic_runs(docs.limit(0))).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{i % 5000}" if i < 100_000 else f"v{i % 11}" for i in range(200_000)]
    row = P.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 100_000, 5000), (100_000, 100_000, 11)]
    assert row.collapsed.split() == words[:5000] + words[100_000:100_011]


def test_chosen_documents_without_words(spark):
    chosen = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(chosen[0], ""), (chosen[1], " \n"), (chosen[2], None), (chosen[3], "a")]
    found = P.run_digest(P.periodic_runs(P.with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    assert {(r.doc_id, r.n_runs, r.start, r.collapsed_sha256) for r in found} == {(i, 0, None, hashlib.sha256((t or "").strip().encode()).hexdigest()) for i, t in rows}
