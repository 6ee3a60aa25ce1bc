"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are marked (a mark for each space and one in front) and cut into marked words, which no piece crosses. The
distinct words of a batch are sorted, so that walking them in order is a depth-first walk of their trie: the forward
states of the prefix shared with the word before stay on a stack and only the rest of the word is worked out.

The lattice has a state for each prefix. For a unigram model the forward score of a state is the best sum of piece
scores. For a BPE model, sums of scores would not give the pieces that the merges give, so the transition score is 0
if the two adjacent pieces survive the merges of their joined text and minus infinity otherwise. A piece sequence is
what the merges give exactly if each adjacent pair survives, and each prefix has one such sequence, so the best path
is the encoding of the reference library, id for id. Characters outside the vocabulary become byte pieces.

Defined results: a null text counts as empty (no piece, decodes to an empty text); a literal mark in a text decodes as
a space, as in the reference library; repeated rows are encoded row by row; input columns other than id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.llm.batching import slices, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bounds of a worker's memory, not of the result: words and pairs remembered.
WORDS, PAIRS = 300_000, 600_000


class Codec:
    """Encoder and decoder for one model file; `kind` is "bpe" or "unigram" (how the model's scores are meant)."""

    def __init__(self, model: str = MODEL, kind: str = "bpe"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        size, self.kind = own.get_piece_size(), kind
        special = [own.is_byte(i) or own.is_control(i) or own.is_unknown(i) for i in range(size)]
        self.pieces = [own.id_to_piece(i) for i in range(size)]
        self.scores = [own.get_score(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if own.is_byte(i)}
        self.unknown_id = own.unk_id()
        self.surface = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else b"" if special[i] else p.encode() for i, p in enumerate(self.pieces)]
        self.backward: dict = {}  # trie of reversed pieces; the key None holds the piece
        for piece in self.ids:
            node = self.backward
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[None] = piece
        alone = [c for c in "\n\t\r" if not any(c in p for p in self.ids)]
        stop = MARK + "".join(alone)
        self.cut = re.compile(f"{MARK}+[^{stop}]*|[^{stop}]+|[{''.join(alone) or MARK}]").findall
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.cut = lambda marked: [marked] if marked else []
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    # -- the merges themselves, on texts of one or two pieces
    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str, right: str) -> bool:
        """Whether `right` may stand after `left` ("" at the start of a word)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    # -- the lattice
    def _extend(self, word: str, at: int, last: list[str], score: list[float]) -> None:
        """Append the state of word[:at]."""
        node, j = self.backward, at
        best, best_score = None, -1e300
        while j > 0:
            j -= 1
            node = node.get(word[j])
            if node is None:
                break
            piece = node.get(None)
            if piece is not None:
                if self.kind == "unigram":
                    s = score[j] + self.scores[self.ids[piece]]
                    if s > best_score:
                        best, best_score = piece, s
                elif self.follows(last[j], piece):
                    best, best_score = piece, 0.0
                    break
        if best is None:  # a character outside the vocabulary stands alone
            best, best_score = word[at - 1], score[at - 1] - (20.0 if self.kind == "unigram" else 0.0)
        last.append(best)
        score.append(best_score)

    def _ids(self, word: str, last: list[str]) -> list[int]:
        out: list[list[int]] = []
        at = len(word)
        while at:
            piece = last[at]
            known = self.ids.get(piece)
            out.append([known] if known is not None else [self.byte_ids.get(b, self.unknown_id) for b in piece.encode("utf-8", "surrogatepass")])
            at -= len(piece)
        return [i for group in reversed(out) for i in group]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids (little-endian int32) of distinct words, by a depth-first walk of their trie."""
        found: dict[str, bytes] = {}
        before, last, score = "", [""], [0.0]
        for word in sorted(words):
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for at in range(shared + 1, len(word) + 1):
                self._extend(word, at, last, score)
            found[word] = np.array(self._ids(word, last), dtype="<i4").tobytes()
            before = word
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = {w for words in cut for w in words if w not in self.words}
        if len(self.words) + len(fresh) > WORDS:
            self.words = {}
            fresh = {w for words in cut for w in words}
        self.words.update(self.encode_words(fresh))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text or ""])[0], "<i4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(model: str = MODEL, kind: str = "bpe") -> Codec:
    """One codec for each worker process and model."""
    return Codec(model, kind)


def _kept(run):
    """Codecs stay in a worker from task to task, until another operator takes it over."""
    return tidy(run, "sentencepiece", lambda: codec.cache_clear())


def _encoded(batches: Iterable[pd.DataFrame], model: str, kind: str) -> Iterator[tuple[list, list[str], list[bytes], Codec]]:
    own = codec(model, kind)
    for batch in batches:
        ids, texts = batch.iloc[:, 0].tolist(), [t or "" for t in batch.iloc[:, 1]]
        for part in slices(texts):
            yield ids[part], texts[part], own.encode_batch(texts[part]), own


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, model: str = MODEL, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece_ids array<int> for each row; no shuffle."""

    def run(batches):
        for ids, _, packed, _ in _encoded(batches, model, kind):
            yield pd.DataFrame({"doc_id": ids, "piece_ids": [np.frombuffer(p, "<i4") for p in packed]})

    return _rows(docs, id_col, text_col).mapInPandas(_kept(run), "doc_id long, piece_ids array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """doc_id, text for each row of piece ids (null: empty); no shuffle."""

    def run(batches):
        own = codec(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": ["" if x is None else own.decode(x) for x in batch["piece_ids"]]})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("piece_ids")).mapInPandas(_kept(run), "doc_id long, text string")


def encode_and_check(docs: DataFrame, model: str = MODEL, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_pieces, the SHA-256 of the packed ids and whether decoding gives the text back, for each row, in one pass."""

    def run(batches):
        for ids, texts, packed, own in _encoded(batches, model, kind):
            back = [own.decode(np.frombuffer(p, "<i4").tolist()) for p in packed]
            yield pd.DataFrame(
                {
                    "doc_id": ids,
                    "n_chars": [len(t) for t in texts],
                    "n_pieces": [len(p) // 4 for p in packed],
                    "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                    "decoded_sha256": [hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back],
                    "round_trip": [b == t for b, t in zip(back, texts, strict=True)],
                }
            )

    out = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return _rows(docs, id_col, text_col).mapInPandas(_kept(run), out)
