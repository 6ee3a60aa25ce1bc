"""The lattice must give the reference library's ids, and decoding must give the text back."""

import random

import sentencepiece

from sieverank.llm import sentencepiece_codec as S


def test_equal_to_the_library():
    rng = random.Random(3)
    own, lib = S.codec(), sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    parts = ["the", "tion", "a", "er", "an", " ", "  ", "     ", "\n", "\t", ".", "ß", "é", "日本", "\U0001f600", "1", "23", "==", "AKIA", "un", "\x00", "ing", "x"]
    texts = ["", " ", "   ", "a", "aaaaaaa", " " * 50 + "b"] + ["".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(800)]
    for text, packed in zip(texts, own.encode_batch(texts), strict=True):
        ids = own.encode(text)
        assert len(packed) == 4 * len(ids)
        assert ids == lib.encode(text), text
        assert own.decode(ids) == text


def test_documents_equal_to_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.piece_ids for r in S.encode_documents(docs).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    rows = docs.select("doc_id", "text").collect()
    assert all(got[r.doc_id] == lib.encode(r.text) for r in rows)
    back = {r.doc_id: r.text for r in S.decode_documents(S.encode_documents(docs)).collect()}
    assert back == {r.doc_id: r.text for r in rows}


def test_unigram_scores_by_brute_force():
    own = S.Codec(kind="unigram")
    own.scores = [-len(p) - 0.5 * (i % 7) for i, p in enumerate(own.pieces)]

    def best(word):
        if not word:
            return 0.0
        options = [own.scores[own.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in own.ids]
        return max(options)

    for word in ["▁thering", "▁in", "nation"]:
        packed = own.encode_words([word])[word]
        ids = [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
        assert abs(sum(own.scores[i] for i in ids) - best(word)) < 1e-9


def test_nulls_empty_and_repeated(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (2, "", "z"), (None, "hi", "q")], "doc_id long, text string, n_pieces string")
    out = S.encode_and_check(rows).collect()
    assert sorted((r.n_pieces, r.round_trip) for r in out) == [(0, True), (0, True), (0, True), (1, True)]
    assert S.encode_and_check(rows.limit(0)).count() == 0
