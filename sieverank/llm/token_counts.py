"""Edit-aware token counts.

A document is cut into pre-tokens (the units inside which byte-pair merges happen, so token counts add up over them).
The pre-tokens of a document are the leaves of a segment tree whose nodes hold (code points, pre-tokens, tokens) of
their subtree. An edit replaces a range of code points: only the pre-tokens that the edit touches, one unit of context
before them and whatever follows until the new cut meets an old one are cut and encoded again; the sums on the path
to the root are then updated.

Defined results: a null text counts as empty; an empty text has no pre-token and no token; repeated rows are counted
row by row; other columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the cut of byte-level BPE vocabularies of this family.
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf block; a block that grows past four times this is rebuilt.
BLOCK = 64
#: Pre-tokens whose counts a worker remembers before it starts afresh.
MEMORY = 400_000


class PieceCounter(dict):
    """Pre-token -> number of tokens, filled on demand and emptied when it holds MEMORY entries (a memo, not a cap)."""

    def __init__(self, vocabulary: str):
        super().__init__()
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding._core_bpe.encode_single_piece
        self.find = regex.compile(PRETOKEN_PATTERN).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = len(self.encode(piece.encode("utf-8", "surrogatepass")))
        self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(vocabulary: str = VOCABULARY) -> PieceCounter:
    """One counter for each worker process and vocabulary."""
    return PieceCounter(vocabulary)


class PretokenTree:
    """Segment tree over blocks of pre-tokens. Node i has children 2i and 2i+1; the root is node 1."""

    def __init__(self, text: str, counts: PieceCounter):
        self.counts = counts
        self.reencoded = 0
        self._build(counts.find(text))

    def _build(self, pieces: list[str]) -> None:
        self.blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        size = 2 * self.width
        self.chars, self.units, self.tokens = [0] * size, [0] * size, [0] * size
        for b, block in enumerate(self.blocks):
            self._set(self.width + b, block)
        for i in range(self.width - 1, 0, -1):
            self._pull(i)

    def _set(self, i: int, block: list[str]) -> None:
        self.chars[i], self.units[i] = sum(map(len, block)), len(block)
        self.tokens[i] = sum(map(self.counts.__getitem__, block))

    def _pull(self, i: int) -> None:
        for sums in (self.chars, self.units, self.tokens):
            sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_units(self) -> int:
        return self.units[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(b) for b in self.blocks)

    def _locate(self, at: int) -> tuple[int, int]:
        """(block, code points before it) of the block that holds code point `at`; the last block beyond the end."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i] and self.units[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def _pieces_from(self, block: int, skip: int) -> Iterator[tuple[int, int, str]]:
        for b in range(block, len(self.blocks)):
            for k in range(skip if b == block else 0, len(self.blocks[b])):
                yield b, k, self.blocks[b][k]

    def edit(self, start: int, end: int, insert: str) -> int:
        """Replace code points [start, end) by `insert`; returns the number of pre-tokens encoded again."""
        n = self.n_chars
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        if start == end and not insert:
            return 0
        # A cut is decided by what it consumes and one unit after it; a space run looks one further. So the last
        # pre-token that starts two code points before the edit is a safe place to start over.
        block, before = self._locate(max(0, start - 2))
        skip, at = 0, before
        for k, piece in enumerate(self.blocks[block]):
            if at + len(piece) > max(0, start - 2):
                skip = k
                break
            at += len(piece)
            skip = k + 1
        head = at  # code points before the first pre-token that is cut again
        old = self._pieces_from(block, skip)
        window, taken, upto = "", [], head
        for b, k, piece in old:  # up to the end of the edit
            window += piece
            taken.append((b, k))
            upto += len(piece)
            if upto >= end:
                break
        shift = len(insert) - (end - start)
        fresh_text = window[: start - head] + insert + window[end - head :]
        edited_end = start - head + len(insert)  # in fresh_text: nothing after this was edited
        ends = {len(fresh_text)}  # old cuts after the edit, as positions of fresh_text
        grow = 8
        while True:
            more, exhausted = [], True
            for b, k, piece in old:  # context to the right: cut until a new boundary meets an old one
                more.append(piece)
                taken.append((b, k))
                if len(more) >= grow:
                    exhausted = False
                    break
            for piece in more:
                fresh_text += piece
                ends.add(len(fresh_text))
            pieces = self.counts.find(fresh_text)
            if exhausted:
                break
            # A boundary counts if the cut before it saw nothing beyond the text at hand.
            pos, met = 0, None
            for j, piece in enumerate(pieces):
                pos += len(piece)
                if pos >= edited_end and pos in ends and pos + 2 < len(fresh_text):
                    met = (j + 1, pos)
                    break
            if met:
                pieces, keep = pieces[: met[0]], met[1]
                while len(fresh_text) > keep:  # give back the old pre-tokens after the meeting point
                    b, k = taken.pop()
                    fresh_text = fresh_text[: len(fresh_text) - len(self.blocks[b][k])]
                break
            grow *= 2
        self.reencoded += len(pieces)
        self._splice(block, skip, taken, pieces)
        assert self.n_chars == n + shift
        return len(pieces)

    def _splice(self, block: int, skip: int, taken: list[tuple[int, int]], pieces: list[str]) -> None:
        last_block, last = taken[-1] if taken else (block, skip - 1)
        tail = self.blocks[last_block][last + 1 :]
        touched = range(block, last_block + 1)
        self.blocks[block] = self.blocks[block][:skip] + pieces + (tail if last_block == block else [])
        for b in touched[1:]:
            self.blocks[b] = tail if b == last_block else []
        if len(self.blocks[block]) > 4 * BLOCK:
            self._build([p for b in self.blocks for p in b])
            return
        dirty = {self.width + b for b in touched}
        for i in dirty:
            self._set(i, self.blocks[i - self.width])
        while dirty := {i // 2 for i in dirty if i > 1}:
            for i in dirty:
                self._pull(i)


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits that the registered query applies, in order: replace, delete, insert. They are fixed by the text."""
    n = len(text)
    third = n // 3
    return [(third, third + min(16, third), text[:24]), (2 * third, 2 * third + 8, ""), (n // 2, n // 2, " edit 42's")]


OUT = "doc_id long, n_chars long, n_pretokens long, n_tokens long, edited_pretokens long, edited_tokens long, reencoded_pretokens long, edited_sha256 string"


def count_batches(batches: Iterable[pd.DataFrame], vocabulary: str = VOCABULARY, edits=sample_edits) -> Iterator[pd.DataFrame]:
    counts = counter(vocabulary)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            text = text or ""
            tree = PretokenTree(text, counts)
            units, tokens = tree.n_units, tree.n_tokens
            for edit in edits(text):
                tree.edit(*edit)
            digest = hashlib.sha256(tree.text().encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc_id, len(text), units, tokens, tree.n_units, tree.n_tokens, tree.reencoded, digest))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, edits=sample_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts before and after `edits` (a function text -> [(start, end, insert)]) for each row; no shuffle.

    vocabulary: path of a rank file that executors can open (a parameter; the file is not part of this package).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(lambda batches: count_batches(batches, vocabulary, edits), OUT)
