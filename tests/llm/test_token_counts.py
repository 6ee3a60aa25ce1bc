"""Edits must leave the same counts as encoding the edited text from scratch."""

import hashlib
import random

from sieverank.llm.token_counts import PretokenTree, counter, sample_edits, token_counts


def test_edits_equal_full_recount():
    rng = random.Random(5)
    counts = counter()
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "1", "23", ".", ",,", "ll", "　", "日本", "\U0001f600"]
    for trial in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 40, 600])))
        tree = PretokenTree(text, counts)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 50]))
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 6, 400 if trial % 50 == 0 else 2])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text
            assert [p for x in tree.blocks for p in x] == counts.find(text)
            assert tree.n_tokens == len(counts.encoding.encode_ordinary(text))


def test_only_a_little_is_encoded_again():
    counts = counter()
    text = "some words of a long text, repeated. " * 2000
    tree = PretokenTree(text, counts)
    assert tree.edit(30000, 30005, "X") < 40


def test_sample_edits_of_short_texts():
    counts = counter()
    for text in ("", "a", "ab", "abc def"):
        tree, now = PretokenTree(text, counts), text
        for a, b, new in sample_edits(text):
            tree.edit(a, b, new)
            a, b = min(a, len(now)), min(b, len(now))
            now = now[:a] + new + now[b:]
        assert tree.text() == now


def edited(text):
    for a, b, new in sample_edits(text):
        text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
    return text


def test_rows_equal_full_recounts(spark):
    rng = random.Random(6)
    texts = ["", None, " ", "a", "word " * 4000, "\u65e5\u672c\u8a9e " * 50] + ["".join(rng.choice(["ab", " ", "\n", "'s", "1", "."]) for _ in range(rng.randrange(200))) for _ in range(40)]
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)] + [(3, "a", "x"), (3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)
    encoding = counter().encoding
    want = []
    for i, t, _ in rows:
        t = t or ""
        e = edited(t)
        want.append((i, len(t), len(encoding.encode_ordinary(t)), len(encoding.encode_ordinary(e)), hashlib.sha256(e.encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.n_tokens, r.edited_tokens, r.edited_sha256) for r in token_counts(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(docs.limit(0)).count() == 0
