"""Removed bytes against a dictionary of all strings, on the fixture and on repetitive random texts."""

import hashlib
import random

import numpy as np

from sieverank.llm import suffix_dedup as S


def brute(rows):
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - S.LENGTH + 1):
            w = raw[i : i + S.LENGTH]
            if w in seen:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, rows, hot=S.HOT):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicate(df, hot=hot).collect()}
    rows = sorted(rows, key=lambda r: r[0])
    for (doc_id, _), want in zip(rows, brute(rows), strict=True):
        assert got[doc_id] == want, doc_id


def test_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    compare(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_repetitive_texts(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(2, 7)))
    passages = ["".join(word() for _ in range(rng.choice([20, 40, 90]))) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [rng.choice(passages) if rng.random() < 0.6 else word() for _ in range(rng.choice([0, 1, 3, 8]))]
        rows.append((i * 37 % 1009, "".join(parts)))
    rows += [(2000, "a" * 1000), (2001, "ab" * 400), (2002, "a" * 99), (2003, "a" * 100), (2004, None), (2005, "")]
    compare(spark, rows)


def test_hot_triggers_take_the_other_way():
    """One trigger in many distinct phrases, settled by content instead of by trigger."""
    rng = random.Random(5)
    core = "".join(rng.choice("abcdefgh") for _ in range(120))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) + core[: rng.randint(90, 120)] + "".join(rng.choice("uvw") for _ in range(50))) for i in range(60)]
    for hot in (4096, 2):
        assert run_local(rows, 7, hot) == [w[1] for w in brute(rows)]


def run_local(rows, chunks, hot):
    """The steps without Spark."""
    import pandas as pd

    docs = pd.DataFrame([(i, False, 0, t) for i, t in rows], columns=["id", "unnamed", "tie", "text"])
    docs["dest"] = S.chunk_of(docs["id"].to_numpy(np.int64), docs["tie"].to_numpy(np.int64), chunks)
    parsed = pd.concat(list(S._parse(chunks, chunks)([docs.iloc[:25], docs.iloc[25:]])))
    known = pd.concat([S._dictionary(chunks, hot)(k, g) for k, g in parsed.groupby(["route", "dest"])])
    fetched = pd.concat([S._fetch(chunks)((k,), g, known[known["dest"] == k]) for k, g in docs.groupby("dest")])
    cuts = pd.concat([S._suffixes(chunks)(k, g) for k, g in fetched.groupby(["route", "dest"])])
    done = pd.concat([S._cut((k,), g, cuts[cuts["dest"] == k]) for k, g in docs.groupby("dest")])
    return done.sort_values("id")["n_removed"].tolist()


def test_odd_rows(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text[:150], 0), (2, None, 0)], "doc_id long, text string, dest int")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in S.deduplicate(df).collect())
    first = brute([(0, text[:150]), (1, text)])
    assert got == [(-1, 150, first[0][1]), (1, 300, first[1][1]), (1, 300, first[1][1]), (2, 0, 0)]
    assert S.deduplicate(df.limit(0)).count() == 0


def test_rows_without_id(spark):
    """2,000 distinct texts without id, a few of which share a passage, and one id with many texts."""
    rng = random.Random(12)
    alone = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(130)) for _ in range(1990)]
    passage = "".join(rng.choice("ABCDEFGH") for _ in range(120))
    twice = [f"{i} {passage}" for i in range(10)]
    for doc_id in (None, 5):
        df = spark.createDataFrame([(doc_id, t) for t in alone + twice], "doc_id long, text string")
        got = S.deduplicate(df).collect()
        assert len(got) == 2000 and all(r.doc_id == doc_id for r in got)
        cut = [r for r in got if r.n_removed]
        assert len(cut) == 9 and all(r.n_removed in (120, 121, 122) and r.n_spans == 1 for r in cut)


def test_hot_triggers_through_spark(spark):
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefgh") for _ in range(120))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) + core[: rng.randint(90, 120)] + "".join(rng.choice("uvw") for _ in range(50))) for i in range(60)]
    compare(spark, rows, hot=2)
