"""Language-model scoring with context-tree weighting.

Bytes are coded bit by bit, most significant first. Each of the 255 bit positions of a byte (a node of the binary
decomposition) has a context tree over the DEPTH bytes before. Every context of depth 0 to DEPTH keeps how often a 0
and a 1 came (learned from the training documents); its Krichevsky-Trofimov estimate is mixed half and half with the
product of its child contexts, from the deepest up. The weights that result give the probability of each bit: on the
path of contexts, share * KT + (1 - share) * (what the deeper context says). A context that training never saw says
1/2. A text is its UTF-8 bytes between DEPTH start bytes and one end byte, 0xFF, which UTF-8 never uses; its score is
the log10 probability, and -score / log10(2) / bytes the code length per byte.

Layout. Documents are dealt into chunks of about CHUNK_CHARS. A chunk sends its distinct (DEPTH + 1)-byte strings with
their training counts, and its distinct words with theirs, to parts; a part owns all contexts that end in the same two
bytes, so everything from depth 2 down is worked out there. What is above, at most 256 * 255 + 255 nodes whatever the
corpus, is put together on the driver and sent out. Parts answer each chunk with the log probability of its strings
(and the counts of its words), and the chunk sums them over its documents. Nothing that grows is broadcast or
collected.

Defined results: null texts count as empty and are scored on their end alone; documents without id are hashed as the
text "null"; repeated rows are scored and, where they train, counted row by row; other columns are ignored; without any
training document every count is 0 and every bit has probability 1/2.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.llm.batching import slices, take_over, trim
from sieverank.session import ensure_checkpoint_dir

DEPTH, EDGE = 5, b"\xff"
CHUNK_CHARS, SLICE_CHARS, CONTEXTS = 8_000_000, 2_000_000, 1 << 16
PRIOR = 0.1  # added to each count of the word model
SENT = "part int, chunk int, kind string, keys binary, counts binary, train_tokens long, train_docs long"
U64, LOW = np.uint64, np.uint64(0xFF)


def pack(a: np.ndarray) -> bytes:
    """An array as compressed planes of bytes; sorted keys are stored as differences."""
    if a.dtype == np.uint64 and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    a = np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(a, dtype=np.uint64) if dtype == np.uint64 else a


def is_training(doc_id, modulus: int = 10) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % modulus != 0


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Packed (depth + 1)-byte strings that end at each byte and at the end of each text, and where each text begins.

    The nearest byte of the context is the highest, then the one before it, and so on; the byte itself is the lowest. In
    order, strings of one context stand together at every depth.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer((EDGE * depth).join([b"", *(t + EDGE for t in texts)]), np.uint8).astype(np.uint64)
    codes = data[depth:].copy()
    for j in range(1, depth + 1):
        codes |= data[depth - j : len(data) - j] << U64(8 * (depth - j + 1))
    begin = np.r_[0, np.cumsum(sizes)[:-1]] if len(texts) else np.zeros(0, np.int64)
    # Between texts stand `depth` start bytes; strings that end there are left out.
    keep = np.ones(len(codes), bool)
    for k, b in enumerate(begin[1:], 1):
        gap = b + (k - 1) * depth
        keep[gap : gap + depth] = False
    return codes[keep], begin


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def part_of(keys: np.ndarray, kind: str, parts: int, depth: int = DEPTH) -> np.ndarray:
    own = keys >> U64(8 * depth - 8) if kind == "gram" else keys  # the two nearest bytes
    mixed = (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_keys(distinct: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 8) for w in distinct], dtype=np.uint64)


def chunk_counts(ids: list, texts: list[str], depth: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[int], int, int]:
    """Distinct strings and words of a chunk with their training counts; training tokens and documents."""
    train = [is_training(i) for i in ids]
    keys, counts = [], []
    seen: Counter = Counter()
    others: set[bytes] = set()
    for part in slices(texts, SLICE_CHARS):
        codes, begin = grams([(t or "").encode("utf-8", "surrogatepass") for t in texts[part]], depth)
        of = np.repeat(np.array(train[part], dtype=np.int64), np.diff(np.r_[begin, len(codes)]))
        for chosen in (1, 0):
            k, c = np.unique(codes[of == chosen], return_counts=True)
            keys.append(k)
            counts.append(c * chosen)
        for t, learns in zip(texts[part], train[part], strict=True):
            (seen if learns else others).update(words(t))
    n_tokens = sum(seen.values()) + sum(train)
    distinct = [*seen, *(others - seen.keys())]
    return *merge(keys, counts), distinct, [seen.get(w, 0) for w in distinct], n_tokens, sum(train)


def _send(depth: int, parts: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        take_over("")
        ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"]]
        codes, counts, distinct, word_counts, n_tokens, n_docs = chunk_counts(ids, rows["text"].tolist(), depth)
        out = []
        for kind, keys, values in (("gram", codes, counts), ("word", word_keys(distinct), np.array(word_counts, dtype=np.int64))):
            part = part_of(keys, kind, parts, depth)
            order = word_order(distinct, parts) if kind == "word" else np.argsort(part, kind="stable")
            keys, values, part = keys[order], values[order].astype(np.int64), part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                if cuts[p] < cuts[p + 1]:
                    piece = slice(cuts[p], cuts[p + 1])
                    out.append((p, int(key[0]), kind, pack(keys[piece]), pack(values[piece]), 0, 0))
        out.append((0, int(key[0]), "total", b"", b"", n_tokens, n_docs))
        trim()
        return pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 8; x > 0."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - shift


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class BitTree:
    """The context trees of one bit position, from sorted distinct strings and their training counts.

    A node is a context and the bits of the byte that come before this one; below[d] gives each node of depth d + 1 its
    node at depth d. Strings that training never saw are in it with a count of 0: their nodes weigh 0 and say 1/2, so
    they change no other node. Only one bit position is held at a time.
    """

    def __init__(self, strings: np.ndarray, counts: np.ndarray, bit: int, depth: int, least: int):
        byte = strings & LOW
        self.one = ((byte >> U64(7 - bit)) & U64(1)).astype(bool)
        keys = (strings & ~LOW) | U64(1 << bit) | (byte >> U64(8 - bit))  # in order, as the strings are
        fresh = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        self.node = np.cumsum(fresh, dtype=np.int32) - 1
        total = np.add.reduceat(counts, first) if len(keys) else counts
        ones = np.add.reduceat(np.where(self.one, counts, 0), first) if len(keys) else counts
        zeros, keys = total - ones, keys[first]
        self.weight = kt_block(zeros, ones)
        self.estimate = [(ones + 0.5) / (zeros + ones + 1.0)]
        self.shares: list[np.ndarray] = []
        self.up: list[np.ndarray] = []
        for d in range(depth - 1, least - 1, -1):
            keys = keys & ~(LOW << U64(8 * (depth - d)))
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            fresh = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
            up = np.empty(len(keys), np.int32)
            up[order] = np.cumsum(fresh, dtype=np.int32) - 1
            keys = ranked[fresh]
            del order, ranked, fresh
            n = len(keys)
            zeros, ones, under = (np.bincount(up, x, n) for x in (zeros, ones, self.weight))
            own = kt_block(zeros, ones)
            self.weight = np.logaddexp(own, under) + math.log(0.5)
            self.shares.append(share(own, under))
            self.estimate.append((ones + 0.5) / (zeros + ones + 1.0))
            self.up.append(up)
        self.keys, self.zeros, self.ones = keys, zeros, ones

    def says(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node of the greatest depth: the probability of a 1, mixed up to the least depth, and its node there."""
        p, at = self.estimate[0], np.arange(len(self.estimate[0]))
        for up, part, estimate in zip(self.up, self.shares, self.estimate[1:], strict=True):
            at = up[at]
            p = part[at] * estimate[at] + (1 - part[at]) * p
        return p, at


def top_sums(strings: np.ndarray, counts: np.ndarray, depth: int) -> pd.DataFrame:
    """node (context byte << 8 | bits), zeros, ones, below: what these strings add to the contexts of one byte."""
    out = []
    for bit in range(8):
        tree = BitTree(strings, counts, bit, depth, 2)
        up = ((tree.keys >> U64(8 * depth)) << U64(8) | (tree.keys & LOW)).astype(np.int64)
        node, at = np.unique(up, return_inverse=True)
        sums = [np.bincount(at, x, len(node)) for x in (tree.zeros, tree.ones, tree.weight)]
        out.append(pd.DataFrame(dict(zip(("node", "zeros", "ones", "below"), (node, *sums), strict=True))))
    return pd.concat(out)


class Top:
    """The root and the contexts of one byte, as dense tables over [context byte,] bit position."""

    def __init__(self, table: pd.DataFrame):
        zeros, ones, below = (np.zeros(65536) for _ in range(3))
        at = table["node"].to_numpy()
        zeros[at], ones[at], below[at] = table["zeros"], table["ones"], table["below"]
        own = kt_block(zeros, ones)
        self.share1 = share(own, below).reshape(256, 256)
        self.kt1 = ((ones + 0.5) / (zeros + ones + 1)).reshape(256, 256)
        self.seen1 = (zeros + ones > 0).reshape(256, 256)
        weight = np.where(self.seen1.ravel(), np.logaddexp(own, below) + math.log(0.5), 0.0).reshape(256, 256).sum(axis=0)
        zeros, ones = zeros.reshape(256, 256).sum(axis=0), ones.reshape(256, 256).sum(axis=0)
        self.share0 = share(kt_block(zeros, ones), weight)
        self.kt0 = (ones + 0.5) / (zeros + ones + 1)

    def log10(self, strings: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
        """Log10 probability of the last byte of each string (sorted, distinct) after the bytes before it."""
        total = np.zeros(len(strings))
        for bit in range(8):
            tree = BitTree(strings, counts, bit, depth, 2)
            p, at = tree.says()
            before = (tree.keys[at] >> U64(8 * depth)).astype(np.int64)
            node = (tree.keys[at] & LOW).astype(np.int64)
            s = self.share1[before, node]
            p = np.where(self.seen1[before, node], s * self.kt1[before, node] + (1 - s) * p, 0.5)
            s = self.share0[node]
            p = s * self.kt0[node] + (1 - s) * p
            total += np.log10(np.where(tree.one, p[tree.node], 1 - p[tree.node]))
        return total


def _owned(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A part's strings by chunk, and all of them merged with their training counts; in a fixed order."""
    sent = [unpack(k, np.uint64) for k in rows["keys"]]
    keys, counts = merge(sent, [unpack(c, np.int64) for c in rows["counts"]])
    return sent, keys, counts


def _tops(depth: int):
    def run(_, rows: pd.DataFrame) -> pd.DataFrame:
        _, keys, counts = _owned(rows.sort_values("chunk"))
        return top_sums(keys[counts > 0], counts[counts > 0], depth)

    return run


def _answers(top: Top, depth: int):
    def run(_, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        sent, keys, counts = _owned(rows)
        log = top.log10(keys, counts, depth)
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "kind": "gram", "keys": rows["keys"], "counts": [pack(log[np.searchsorted(keys, k)]) for k in sent]})

    return run


def _word_answers(_, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("chunk")
    sent, keys, counts = _owned(rows)
    known = [0] * len(rows)
    known[0] = int((counts > 0).sum())
    # The keys stay here: a chunk can work out which words it sent, and in which order.
    return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "kind": "word", "keys": None, "counts": [pack(counts[np.searchsorted(keys, k)]) for k in sent], "known": known})


def _lookup(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's strings and the logs of their probabilities, in order."""
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0)
    keys = np.concatenate([unpack(k, np.uint64) for k in rows["keys"]])
    values = np.concatenate([unpack(c, np.float64) for c in rows["counts"]])
    order = np.argsort(keys)
    return keys[order], values[order]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values at `wanted`; looked up in order, which memory caches like better."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted))
    out[order] = values[np.searchsorted(keys, wanted[order])]
    return out


def word_order(distinct: list[bytes], parts: int) -> np.ndarray:
    """The order in which a chunk sends its words: by part, then key."""
    keys = word_keys(distinct)
    return np.lexsort((keys, part_of(keys, "word", parts)))


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _score(depth: int, parts: int, n_all: int, n_distinct: int, n_ends: int):
    def run(_, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own_keys, logs = _lookup(told[told["kind"] == "gram"])
        counts = [unpack(c, np.int64) for c in told[told["kind"] == "word"].sort_values("part")["counts"]]
        ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"]]
        texts = rows["text"].tolist()
        denominator = n_all + PRIOR * (n_distinct + 1)
        distinct = list({w for t in texts for w in words(t)})
        distinct = [distinct[i] for i in word_order(distinct, parts)]
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        value = dict(zip(distinct, np.log10((count + PRIOR) / denominator).tolist(), strict=True))
        known = dict(zip(distinct, (count > 0).astype(int).tolist(), strict=True))
        end_value = math.log10((n_ends + PRIOR) / denominator)
        out = []
        for part in slices(texts, SLICE_CHARS):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[part]]
            codes, begin = grams(raw, depth)
            score = np.add.reduceat(_looked_up(own_keys, logs, codes), begin)
            lists = [words(t) for t in texts[part]]
            for i, ws, s, b in zip(ids[part], lists, score.tolist(), raw, strict=True):
                base = math.fsum(map(value.__getitem__, ws)) + end_value
                out.append((i, not is_training(i), len(ws) + 1, sum(map(known.__getitem__, ws)) + (n_ends > 0), n_all, base, s, -s / math.log10(2) / (len(b) + 1)))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        trim()
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return run


def lm_scores(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Scores of each row: the word model's (base_score) and the context tree's (score), with its bits per byte."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.char_length("text") + 1)).first()[0] or 0
    n_chunks = max(1, math.ceil(size / chunk_chars))
    parts = max(4, min(n_chunks, CONTEXTS))  # a part owns whole contexts of two bytes, of which there are so many
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))
    sent = chunked.groupBy("chunk").applyInPandas(_send(depth, parts), SENT).checkpoint()
    strings, distinct = sent.filter("kind = 'gram'"), sent.filter("kind = 'word'")
    tops = strings.groupBy("part").applyInPandas(_tops(depth), "node long, zeros double, ones double, below double")
    top = Top(tops.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas())
    word_answers = distinct.groupBy("part").applyInPandas(_word_answers, "chunk int, part int, kind string, keys binary, counts binary, known long").checkpoint()
    total = sent.filter("kind = 'total'").agg(F.sum("train_tokens"), F.sum("train_docs")).first()
    n_all, n_ends = int(total[0] or 0), int(total[1] or 0)
    n_distinct = int(word_answers.agg(F.sum("known")).first()[0] or 0) + (n_ends > 0)
    answers = strings.groupBy("part").applyInPandas(_answers(top, depth), "chunk int, part int, kind string, keys binary, counts binary")
    told = answers.unionByName(word_answers.drop("known"))
    return chunked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_score(depth, parts, n_all, n_distinct, n_ends), OUT)
