"""The audit against filters applied one after another, row by row."""

import random
import re
from itertools import permutations

import numpy as np
import pandas as pd

from sieverank.llm import filter_audit as A


def plain(docs, labels):
    """All rows of the audit, by removing documents step by step."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(A.WORD, text)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            fails.add("E")
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                unique = sum(r[1] == {f} for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def made(rng, n):
    docs = []
    for i in range(n):
        words = [rng.choice(["alpha", "Beta", "gamma", "delta", f"w{rng.randrange(200)}", f"u{i}"]) for _ in range(rng.choice([3, 49, 50, 80]))]
        text = " ".join(words) + rng.choice(["", "", "#", " $"])
        docs.append((i, text, rng.choice(["hot", "hot", "hot", "a", None, ""])))
    copies = [(n + i, rng.choice(docs)[1], rng.choice(["hot", "b"])) for i in range(n // 2)]
    return docs + copies


def test_equal_to_filters_applied_in_turn(spark):
    rng = random.Random(5)
    docs = made(rng, 120)
    docs += [(3, docs[3][1], "hot"), (None, docs[4][1], "a"), (None, None, None), (900, None, "a"), (901, "", "z"), (902, "x " * 30000, "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, source string, part string, A int").repartition(7)
    l = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")  # noqa: E741
    found = A.audit(d, l)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs, labels)
    assert A.audit(d.limit(0), l).count() == 0
    unlabelled = A.audit(d, l.limit(0))
    assert {r.good_lost for r in unlabelled.collect()} == {0}


def test_subsets_of_other_filters_with_many_parts(spark):
    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"shard": rng.integers(0, 3000, 20000).astype(str), "f": rng.random(20000) < 0.5, "g": rng.random(20000) < 0.2})
    got = {(r.part, r.subset): r.n for r in A.subset_counts(spark.createDataFrame(rows), ["f", "g"], part="shard").collect()}
    want = {}
    for part, f, g in rows.itertuples(index=False):
        for s in range(4):
            want[part, s] = want.get((part, s), 0) + int(not (s & 1 and f) and not (s & 2 and g))
    assert got == want
