"""Removal of repeated byte strings by prefix-free parsing, spread over a cluster.

A byte goes if it lies in a LENGTH-byte string that also starts earlier (in a document with a smaller id, or earlier in
the same one). Strings are judged on the input and never cross documents.

1. Parsing. A rolling hash gives each GRAM-byte string a value; every LENGTH-byte string has a trigger, its least such
   value (leftmost on ties), which depends on nothing but its own bytes. Neighbouring strings with one trigger form a
   phrase: the bytes they cover. Equal strings have their trigger at the same place, so they lie in phrases with the
   same trigger, and the parse of a text of n bytes has about 2 n / (LENGTH - GRAM + 2) phrases.
2. Dictionary and parse. Occurrences of phrases meet by trigger. All strings of a phrase that is not the first of its
   content are repeats: highly repetitive text ends here, as one entry of the dictionary for all its occurrences.
3. Suffixes of the dictionary. Distinct phrases with a common trigger may still share strings. Their bytes are fetched
   and the strings in them are put into suffix order to the depth of LENGTH bytes; in each run of equal strings the
   first by (document, start) stays and the others go. A suffix array of a whole corpus would order its strings far
   beyond that depth and in one place; equal strings need no more than this order, trigger by trigger.
4. The spans found are joined to the texts.

Triggers that occur in more than HOT distinct phrases are not sorted in one task: their strings are dealt out by
content (two hashes of 64 bits), and each chunk of documents sends one row for each distinct string. Phrases are
compared by their trigger's and their content's hash, 128 bits in all.

Defined results: null texts count as empty; rows without id come before the others (ids below -2**62 apart), in the
order of a hash of their texts; rows with the same id and text are one document (each of the rows gets its result), rows
with the same id and different texts are ordered by a 64-bit hash of the text; texts shorter than LENGTH lose nothing;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.llm.batching import tidy, trim

LENGTH, GRAM = 100, 24
SLICE_BYTES, CHUNK_BYTES, HOT = 2_000_000, 8_000_000, 4096
ROUTED = "route string, dest int, a binary, b binary, c binary, d binary, e binary"
U8, U64, I64 = np.uint8, np.uint64, np.int64
BASE = U64(0x9E3779B97F4A7C15)
#: Random values of bytes and their use as digits of a polynomial hash modulo 2**64.
DIGITS = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: Other digits, for a second hash.
MORE_DIGITS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def pack(a: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(U8).reshape(len(a), width).T).tobytes())


def unpack(blob: bytes | None, dtype) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), U8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on, by doubling."""
    power, size, have, at = DIGITS[data], 1, None, 0
    while True:
        if n & size:
            if have is None:
                have, at = power, size
            else:  # what is put together so far, followed by the next `size` bytes
                m = len(data) - at - size + 1
                have = have[:m] * U64(pow(int(BASE), size, 1 << 64)) + power[at : at + m]
                at += size
        if at == n:
            return scramble(have)
        m = len(data) - 2 * size + 1
        power = power[:m] * U64(pow(int(BASE), size, 1 << 64)) + power[size : size + m]
        size *= 2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the `width` values from each position on."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Hashes:
    """Hashes of any byte range of one array, from running sums of digits."""

    def __init__(self, data: np.ndarray, digits: np.ndarray = DIGITS):
        powers = np.full(len(data) + 1, BASE, U64)
        powers[0] = U64(1)
        np.cumprod(powers, out=powers)
        powers[:-1] *= digits[data]
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(powers[:-1], out=self.sums[1:])
        powers[:] = INVERSE
        powers[0] = U64(1)
        self.inverse = np.cumprod(powers, out=powers)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))


def phrases(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the documents that stand in `data`: document, first string's start (in the document), number of
    strings, trigger hash, content hash; a phrase covers strings + LENGTH - 1 bytes."""
    none = tuple(np.zeros(0, t) for t in (I64, I64, I64, U64, U64))
    if len(data) < LENGTH:
        return none
    grams = rolling(data, GRAM)
    order = grams & ~U64(0xFFFFFF)
    order |= np.arange(len(grams), dtype=U64)
    trigger = (least(order, LENGTH - GRAM + 1) & U64(0xFFFFFF)).astype(np.int32)
    del order
    count = np.maximum(sizes - LENGTH + 1, 0)
    if not count.sum():
        return none
    at = np.repeat((begin - (np.cumsum(count) - count)).astype(np.int32), count) + np.arange(count.sum(), dtype=np.int32)
    own = trigger[at]
    fresh = np.r_[True, own[1:] != own[:-1]]
    fresh[(np.cumsum(count) - count)[count > 0]] = True  # the first string of a document
    first = np.flatnonzero(fresh)
    n = np.diff(np.r_[first, len(at)])
    at, own = at[first].astype(I64), own[first].astype(I64)
    doc = np.searchsorted(begin, at, "right") - 1
    hashes = Hashes(data)
    # the place of the trigger belongs to the content
    content = hashes.of(at, at + n + LENGTH - 1) ^ scramble((own - at).astype(U64) + U64(1))
    return doc, at - begin[doc], n, grams[own], content


def place(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Start and number of strings (8 bits) in one number; sorts by start."""
    return (start.astype(U64) << U64(8)) | n.astype(U64)


def start_of(p: np.ndarray) -> np.ndarray:
    return (p >> U64(8)).astype(I64)


def chunk_of(doc: np.ndarray, tie: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk that holds a document; neither a frequent id nor a frequent text fills one."""
    return (doc ^ tie) % chunks


def cuts_by_chunk(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray, chunks: int) -> list[tuple]:
    """Rows for the route "cut": spans to remove, for each chunk of documents; touching spans are put together."""
    if not len(doc):
        return []
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    same = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1])
    group = np.r_[0, np.cumsum(~same)]
    reach = np.maximum.accumulate(end + group * (1 << 41)) - group * (1 << 41)  # furthest end so far in the document
    first = np.flatnonzero(np.r_[True, ~same | (start[1:] > reach[:-1])])
    doc, tie, start, end = doc[first], tie[first], start[first], reach[np.r_[first[1:] - 1, len(reach) - 1]]
    chunk = chunk_of(doc, tie, chunks)
    order = np.argsort(chunk, kind="stable")
    doc, tie, start, end, chunk = (x[order] for x in (doc, tie, start, end, chunk))
    out, edge = [], np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    for a, b in zip(edge, np.r_[edge[1:], len(chunk)], strict=True):
        out.append(("cut", int(chunk[a]), pack(doc[a:b]), pack(tie[a:b]), pack(start[a:b]), pack(end[a:b]), None))
    return out


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ROUTED.split(", ")])


def repeats(keys: list[np.ndarray], doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal keys: order (sorted by keys, then document and place) and whether a row is a repeat there.

    A row at the very place of its group's first (a repeated row of the table) is no repeat.
    """
    order = np.lexsort((at, tie, doc, *reversed(keys)))
    if not len(order):
        return order, np.zeros(0, bool)
    head = np.r_[True, np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return order, (doc[order] != doc[lead]) | (tie[order] != tie[lead]) | (at[order] != at[lead])


def _parse(parts: int, chunks: int):
    """Step 1 on slices of the scan. Repeats within a slice are settled here, so a phrase leaves a slice once."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, ties = batch["id"].to_numpy(I64), batch["tie"].to_numpy(I64)
            raw, size, lo = [], 0, 0
            for i, text in enumerate(batch["text"]):
                own = text.encode("utf-8", "surrogatepass")
                if raw and size + len(own) > SLICE_BYTES:
                    yield frame(one(ids[lo:i], ties[lo:i], raw))
                    raw, size, lo = [], 0, i
                raw.append(own)
                size += len(own)
            if raw:
                yield frame(one(ids[lo:], ties[lo:], raw))

    def one(ids, ties, raw) -> list[tuple]:
        out: list[tuple] = []
        for local, base, piece in pieces(raw):
            sizes = np.array([len(r) for r in piece], dtype=I64)
            doc, start, n, trigger, content = phrases(np.frombuffer(b"".join(piece), U8), np.cumsum(sizes) - sizes, sizes)
            if len(doc):
                out += settle(ids[local][doc], ties[local][doc], start + base, n, trigger, content)
        return out

    def settle(doc, tie, start, n, trigger, content) -> list[tuple]:
        at = place(start, n)
        order, again = repeats([trigger, content], doc, tie, at)
        gone = order[again]
        rows = cuts_by_chunk(doc[gone], tie[gone], start[gone], start[gone] + n[gone] + LENGTH - 1, chunks)
        keep = order[~again]
        part = (trigger[keep] % U64(parts)).astype(I64)
        turn = np.argsort(part, kind="stable")
        keep, part = keep[turn], part[turn]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, I64)
        for a, b in zip(edges, np.r_[edges[1:], len(part)], strict=False):
            own = keep[a:b]
            rows.append(("phrase", int(part[a]), pack(trigger[own]), pack(content[own]), pack(doc[own]), pack(at[own]), pack(tie[own])))
        return rows

    return run


def pieces(raw: list[bytes], most: int = 4_000_000) -> Iterator[tuple[slice, int, list[bytes]]]:
    """A slice of documents as it is; one longer than `most` in overlapping pieces that share no string."""
    if len(raw) > 1 or len(raw[0]) <= most:
        yield slice(0, len(raw)), 0, raw
        return
    for at in range(0, max(1, len(raw[0]) - LENGTH + 1), most):
        yield slice(0, 1), at, [raw[0][at : at + most + LENGTH - 1]]


def _dictionary(chunks: int, most: int = HOT):
    """Step 2: repeats of whole phrases become cuts; phrases whose trigger has others ask for their bytes."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] == "cut":
            return rows
        trigger = np.concatenate([unpack(x, U64) for x in rows["a"]])
        content = np.concatenate([unpack(x, U64) for x in rows["b"]])
        doc = np.concatenate([unpack(x, I64) for x in rows["c"]])
        at = np.concatenate([unpack(x, U64) for x in rows["d"]])
        tie = np.concatenate([unpack(x, I64) for x in rows["e"]])
        order, again = repeats([trigger, content], doc, tie, at)
        start, n = start_of(at), (at & U64(0xFF)).astype(I64)
        gone = order[again]
        out = cuts_by_chunk(doc[gone], tie[gone], start[gone], start[gone] + n[gone] + LENGTH - 1, chunks)
        rest = order[~again]
        t = trigger[rest]
        edge = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, I64)
        size = np.diff(np.r_[edge, len(t)])
        ask = rest[np.repeat(size > 1, size)]
        hot = np.repeat(size > most, size)[np.repeat(size > 1, size)]
        chunk = chunk_of(doc[ask], tie[ask], chunks)
        turn = np.argsort(chunk, kind="stable")
        ask, hot, chunk = ask[turn], hot[turn], chunk[turn]
        edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.zeros(0, I64)
        for a, b in zip(edge, np.r_[edge[1:], len(chunk)].astype(I64)[: len(edge)], strict=True):
            own = ask[a:b]
            out.append(("ask", int(chunk[a]), pack(trigger[own]), pack(hot[a:b].astype(U8)), pack(doc[own]), pack(at[own]), pack(tie[own])))
        return frame(out)

    return run


def _texts(rows: pd.DataFrame) -> tuple[dict[tuple[int, int], int], np.ndarray, list[bytes]]:
    """Where each document of a chunk begins in the chunk's bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
    where, at = {}, 0
    for key, r in zip(zip(rows["id"].tolist(), rows["tie"].tolist(), strict=True), raw, strict=True):
        where.setdefault(key, at)
        at += len(r)
    return where, np.frombuffer(b"".join(raw), U8), raw


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., of size[0] numbers, then those of the next."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _fetch(parts: int):
    """Step 3, first half: the bytes of asked phrases, sent by trigger; strings of hot triggers, sent by content."""

    def run(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = [tuple(r) for r in told[told["route"] == "cut"].itertuples(index=False, name=None)]
        asked = told[told["route"] == "ask"]
        if not len(asked) or not len(rows):
            return frame(out)
        where, data, _ = _texts(rows)
        trigger = np.concatenate([unpack(x, U64) for x in asked["a"]])
        hot = np.concatenate([unpack(x, U8) for x in asked["b"]]).astype(bool)
        doc = np.concatenate([unpack(x, I64) for x in asked["c"]])
        at = np.concatenate([unpack(x, U64) for x in asked["d"]])
        tie = np.concatenate([unpack(x, I64) for x in asked["e"]])
        base = np.array([where[k] for k in zip(doc.tolist(), tie.tolist(), strict=True)], dtype=I64) + start_of(at)
        n = (at & U64(0xFF)).astype(I64)
        part = (trigger % U64(parts)).astype(I64)
        for p in np.unique(part[~hot]):
            own = np.flatnonzero((part == p) & ~hot)
            size = n[own] + LENGTH - 1
            out.append(("bytes", int(p), pack(tie[own]), pack(doc[own]), pack(at[own]), pack(data[spread(base[own], size)]), None))
        if hot.any():
            own = np.flatnonzero(hot)
            begin = spread(base[own], n[own])
            value, second = (Hashes(data, digits).of(begin, begin + LENGTH) for digits in (DIGITS, MORE_DIGITS))
            of = np.repeat(own, n[own])
            start = start_of(at[of]) + (begin - base[of])
            spot = place(start, np.ones(len(start), I64))
            order, again = repeats([value, second], doc[of], tie[of], spot)
            gone = order[again]
            out += cuts_by_chunk(doc[of][gone], tie[of][gone], start[gone], start[gone] + LENGTH, key_chunks)
            keep = order[~again]
            dest = (scramble(value[keep]) % U64(parts)).astype(I64)
            for p in np.unique(dest):
                k = keep[dest == p]
                out.append(("strings", int(p), pack(value[k]), pack(doc[of][k]), pack(spot[k]), pack(tie[of][k]), pack(second[k])))
        return frame(out)

    key_chunks = parts
    return run


def suffix_order(text: np.ndarray, begin: np.ndarray, doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of LENGTH bytes from `begin` on, sorted by their bytes, then document and place; and which are repeats."""
    padded = np.concatenate([text, np.zeros(8, U8)])
    keys = []
    for k in range(0, LENGTH, 8):
        word = np.zeros(len(begin), U64)
        for j in range(8):
            word = (word << U64(8)) | (padded[begin + k + j].astype(U64) if k + j < LENGTH else U64(0))
        keys.append(word)
    return repeats(keys, doc, tie, at)


def _suffixes(chunks: int):
    """Step 3, second half: repeats among the strings of distinct phrases."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] == "cut":
            return rows
        if key[0] == "strings":
            value = np.concatenate([unpack(x, U64) for x in rows["a"]])
            doc = np.concatenate([unpack(x, I64) for x in rows["b"]])
            at = np.concatenate([unpack(x, U64) for x in rows["c"]])
            tie = np.concatenate([unpack(x, I64) for x in rows["d"]])
            order, again = repeats([value, np.concatenate([unpack(x, U64) for x in rows["e"]])], doc, tie, at)
            gone = order[again]
            start = start_of(at[gone])
            return frame(cuts_by_chunk(doc[gone], tie[gone], start, start + LENGTH, chunks))
        doc = np.concatenate([unpack(x, I64) for x in rows["b"]])
        at = np.concatenate([unpack(x, U64) for x in rows["c"]])
        text = np.concatenate([unpack(x, U8) for x in rows["d"]])
        n = (at & U64(0xFF)).astype(I64)
        size = n + LENGTH - 1
        begin = spread(np.cumsum(size) - size, n)
        of = np.repeat(np.arange(len(n)), n)
        start = start_of(at)[of] + (begin - (np.cumsum(size) - size)[of])
        tie = np.concatenate([unpack(x, I64) for x in rows["a"]])[of]
        # Strings that occur once cannot be repeats; the others are put into suffix order.
        value = Hashes(text).of(begin, begin + LENGTH)
        order = np.argsort(value)
        v = value[order]
        twice = np.r_[False, v[1:] == v[:-1]] | np.r_[v[1:] == v[:-1], False] if len(v) else np.zeros(0, bool)
        pick = np.sort(order[twice])
        spot = place(start[pick], np.ones(len(pick), I64))
        ranked, again = suffix_order(text, begin[pick], doc[of][pick], tie[pick], spot)
        gone = pick[ranked[again]]
        return frame(cuts_by_chunk(doc[of][gone], tie[gone], start[gone], start[gone] + LENGTH, chunks))

    return run


def spans_of(told: pd.DataFrame) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Maximal removed runs of each document, in order."""
    cut = told[told["route"] == "cut"]
    if not len(cut):
        return {}
    doc = np.concatenate([unpack(x, I64) for x in cut["a"]])
    tie = np.concatenate([unpack(x, I64) for x in cut["b"]])
    start = np.concatenate([unpack(x, I64) for x in cut["c"]])
    end = np.concatenate([unpack(x, I64) for x in cut["d"]])
    order = np.lexsort((start, tie, doc))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, t, s, e in zip(*(x[order].tolist() for x in (doc, tie, start, end)), strict=True):
        own = out.setdefault((d, t), [])
        if own and s <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], e))
        else:
            own.append((s, e))
    return out


def _cut(_: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Step 4: the remaining bytes of each document of a chunk."""
    spans = spans_of(told)
    out = []
    for i, gone, t, text in zip(rows["id"].tolist(), rows["unnamed"].tolist(), rows["tie"].tolist(), rows["text"], strict=True):
        raw, own = text.encode("utf-8", "surrogatepass"), spans.get((i, t), [])
        kept, at = [], 0
        for s, e in own:
            kept.append(raw[at:s])
            at = e
        kept.append(raw[at:])
        rest = b"".join(kept)
        out.append((None if gone else i, len(raw), len(raw) - len(rest), len(own), rest, hashlib.sha256(rest).hexdigest()))
    done = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
    trim()
    return done.assign(id=pd.array([o[0] for o in out], dtype="Int64"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 for each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tie = F.xxhash64(text)
    # A row without id is named by its text, at the lower end of the numbers, and by a null beside it.
    unnamed = F.lit(-(1 << 63)) + F.shiftrightunsigned(tie, 2)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("id"), F.col(id_col).isNull().alias("unnamed"), tie.alias("tie"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 2 * math.ceil(size / CHUNK_BYTES / 2) + 7
    parsed = rows.select("id", "tie", "text").mapInPandas(tidy(_parse(chunks, chunks)), ROUTED)
    known = parsed.groupBy("route", "dest").applyInPandas(_dictionary(chunks, hot), ROUTED)
    chunk = F.pmod(F.col("id").bitwiseXOR(F.col("tie")), F.lit(chunks)).cast("int")
    texts = rows.withColumn("dest", chunk).groupBy("dest")
    fetched = texts.cogroup(known.groupBy("dest")).applyInPandas(_fetch(chunks), ROUTED)
    cuts = fetched.groupBy("route", "dest").applyInPandas(_suffixes(chunks), ROUTED)
    out = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    done = texts.cogroup(cuts.groupBy("dest")).applyInPandas(_cut, out)
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
