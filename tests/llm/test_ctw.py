"""Scores against a plain recursive context tree and a plain word count; probabilities that add up to one."""

import math
from collections import Counter, defaultdict

import numpy as np

from sieverank.llm import ctw as C


def plain(train, texts, depth):
    """Log10 scores by the definition, with a dictionary for each context."""
    counts = defaultdict(lambda: [0, 0])

    def walk(text):
        data = b"\xff" * depth + text.encode() + b"\xff"
        for i in range(depth, len(data)):
            for b in range(8):
                node = (1 << b) | (data[i] >> (8 - b))
                yield [(data[i - d : i], node) for d in range(depth + 1)], data[i] >> (7 - b) & 1

    for t in train:
        for path, bit in walk(t):
            for key in path:
                counts[key][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append((context, node))
    weight, share = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            weight[key], share[key] = own, 1.0
        else:
            below = sum(weight[c] for c in children[key])
            weight[key] = math.log(0.5) + np.logaddexp(own, below)
            share[key] = 1 / (1 + math.exp(below - own))
    out = []
    for t in texts:
        total = 0.0
        for path, bit in walk(t):
            p = 0.5
            for key in reversed(path):
                if key in counts:
                    a, b = counts[key]
                    p = share[key] * (b + 0.5) / (a + b + 1) + (1 - share[key]) * p
                else:
                    p = 0.5
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_equal_to_plain_tree(spark):
    texts = ["the cat sat on the mat", "the dog sat", "", "Été à la plage", "the the the the", "xyz", "a cat and a dog"] * 4
    rows = list(enumerate(texts)) + [(100, None)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, chunk string")
    want = plain([t or "" for i, t in rows if C.is_training(i)], [t or "" for _, t in rows], C.DEPTH)
    tokens = Counter(w for i, t in rows if C.is_training(i) for w in C.words(t))
    ends = sum(C.is_training(i) for i, _ in rows)
    n, v = sum(tokens.values()) + ends, len(tokens) + 1
    for chunk_chars in (10**6, 60):
        got = {r.doc_id: r for r in C.lm_scores(df, chunk_chars=chunk_chars).collect()}
        assert len(got) == len(rows)
        for (i, t), s in zip(rows, want, strict=True):
            r = got[i]
            assert abs(r.score - s) < 1e-8
            base = [tokens[w] for w in C.words(t)] + [ends]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(base), sum(c > 0 for c in base), n)
            assert abs(r.base_score - sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in base)) < 1e-9
            assert r.held_out == (not C.is_training(i))


def test_next_byte_probabilities_sum_to_one():
    keys, counts = np.unique(C.grams([b"abracadabra", b"the cat"], 3)[0], return_counts=True)
    top = C.Top(C.top_sums(keys, counts, 3).groupby("node", as_index=False).sum())
    for context in (b"abr", b"zzz", b"xab"):
        # the nearest byte is the highest
        strings = np.array([int.from_bytes(context[::-1] + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        every = np.union1d(keys, strings)
        seen = np.where(np.isin(every, keys), counts[np.minimum(np.searchsorted(keys, every), len(keys) - 1)], 0)
        log = top.log10(every, seen, 3)[np.searchsorted(every, strings)]
        assert abs((10**log).sum() - 1) < 1e-9


def test_counts_beyond_32_bits():
    keys = np.array([5, 7], dtype=np.uint64)
    counts = np.array([6_000_000_000, 1], dtype=np.int64)
    assert C.unpack(C.pack(counts), np.int64).tolist() == counts.tolist()
    assert np.isfinite(C.Top(C.top_sums(keys, counts, 3).groupby("node", as_index=False).sum()).log10(keys, counts, 3)).all()


def test_held_out_scores_beat_the_word_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in C.lm_scores(docs).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = C.lm_scores(df).collect()
    assert sorted(r.n_tokens for r in got) == [2, 3, 3]
    assert C.lm_scores(df.limit(0)).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 100.5, 1e6 + 0.5])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
