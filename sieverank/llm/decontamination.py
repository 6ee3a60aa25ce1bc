"""Benchmark decontamination by spaced-seed hashing.

Texts are word sequences (lower case, cut at white space). A seed is a fixed mask over word positions: the positions it
leaves out may differ, so a seed still hits where a copy had words replaced. Both sides become tables of seed hashes that
are joined by equality, which names the items that a document may hold. Documents are read once: a bit filter of
FILTER_BITS over the benchmark's seeds, of one size whatever the benchmark, goes to the executors, and only seeds that
pass it, and texts that have one, go on to the join.

Each candidate is then verified: a hit names a diagonal (document position minus item position). Around it the item is laid over the document word by word, and
stretches with at least SIMILARITY equal words are verified: the longest, then those before and after it. Stretches of
one item on one diagonal or several (words were inserted or deleted) add up. A document is contaminated by an item if
the verified words cover at least COVERAGE of the item and at least MIN_WORDS words, or the whole of a shorter item, or
if one stretch has LONG_RUN words or more.

A document meets its candidate items in parts of about BLOCK_WORDS words of the benchmark, so no row grows with it.

Defined results: null or empty texts and items are never contaminated; an item that occurs several times in the
benchmark under one id counts once for each id; repeated document rows are reported row by row; other columns are
ignored. Rows are told apart by id and text, so rows without an id, or with a shared one, are judged by their own text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.llm.batching import slices, tidy
from sieverank.session import ensure_checkpoint_dir

#: Fixed masks: word positions that count. Each has weight 5; items shorter than a mask are looked up whole.
MASKS = ((0, 1, 3, 5, 6), (0, 1, 2, 5, 7), (0, 2, 4, 5, 6))
SIMILARITY, COVERAGE, MIN_WORDS = 0.8, 0.5, 8
#: A stretch of so many words is reported whatever share of the item it is.
LONG_RUN = 13
BLOCK_WORDS = 500_000
FILTER_BITS = 1 << 27
#: Words that the longest mask spans.
REACH = max(max(mask) for mask in MASKS) + 1
OUT = "doc_id long, item_id long, n_item_words long, n_covered long, n_equal long, similarity double, first_word long, last_word long"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Index:
    """Seed table of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.items.append((item_id, np.array(ids, dtype=np.int64)))
        short = sorted({len(ids) for _, ids in self.items if len(ids) < REACH})
        self.masks = [*MASKS, *(tuple(range(n)) for n in short)]
        self.tables = []
        for k, mask in enumerate(self.masks):
            whole = k >= len(MASKS)
            keys, owners, offsets = [], [], []
            for i, (_, ids) in enumerate(self.items):
                if (len(ids) == len(mask)) if whole else (len(ids) >= REACH):
                    found = hashed(ids, mask)
                    keys.append(found)
                    owners.append(np.full(len(found), i))
                    offsets.append(np.arange(len(found)))
            if not keys:
                self.tables.append(None)
                continue
            key, owner, offset = map(np.concatenate, (keys, owners, offsets))
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], owner[order], offset[order]))


def hashed(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of each placement of the mask; 0 where it holds a word of id 0."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, known = np.full(n, len(mask), np.uint64), np.ones(n, bool)
    for at in mask:
        part = ids[at : at + n]
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        known &= part > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """[start, end) of the longest stretch that has at least SIMILARITY equal words and equal words at both ends."""
    n = len(equal)
    score = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - SIMILARITY, -SIMILARITY))])
    best = (0, 0)
    at = np.flatnonzero(equal)
    if not len(at):
        return best
    low = score[at]
    running = np.minimum.accumulate(low)
    for end in at[::-1] + 1:
        if end - at[0] <= best[1] - best[0]:
            break
        k = int(np.searchsorted(-running, -(score[end] + 1e-9)))  # first start whose score is not above the end's
        if k < len(at) and at[k] < end and end - at[k] > best[1] - best[0]:
            best = (int(at[k]), int(end))
    return best if n else (0, 0)


def stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """All stretches of at least `least` words: the longest, then those of what lies before and after it."""
    found, open_ = [], [(0, len(equal))]
    while open_:
        lo, hi = open_.pop()
        a, b = longest_stretch(equal[lo:hi])
        if b - a >= max(least, 1):
            found.append((lo + a, lo + b))
            open_ += [(lo, lo + a), (lo + b, hi)]
    return found


def find(index: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(text number, item number, item words, covered, equal, first word, last word) of each contaminated pair."""
    get = index.vocabulary.get
    lists = [words_of(t) for t in texts]
    pad = [0] * REACH
    flat: list[int] = []
    starts = []
    for words in lists:
        starts.append(len(flat))
        flat.extend(map(get, words, repeat(0)))
        flat.extend(pad)  # no seed reaches the next text
    ids, begin = np.array(flat, dtype=np.int64), np.array(starts)
    hits = []
    for mask, table in zip(index.masks, index.tables, strict=True):
        if table is None:
            continue
        own = hashed(ids, mask)
        at = np.flatnonzero(own)
        left = np.searchsorted(table[0], own[at], "left")
        count = np.searchsorted(table[0], own[at], "right") - left
        at, left, count = at[count > 0], left[count > 0], count[count > 0]
        if len(at):
            slot = np.repeat(left - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            where = np.repeat(at, count)
            doc = np.searchsorted(begin, where, "right") - 1
            hits.append(np.stack([doc, table[1][slot], where - table[2][slot]], axis=1))
    if not hits:
        return
    pairs = np.unique(np.concatenate(hits), axis=0)
    cuts = np.flatnonzero((pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)) + 1
    for group in np.split(pairs, cuts):
        doc, item = int(group[0, 0]), int(group[0, 1])
        wanted = index.items[item][1]
        n = len(wanted)
        covered, same = np.zeros(n, bool), np.zeros(n, bool)
        first, last, longest = None, None, 0
        for start in group[:, 2]:
            lo, hi = max(0, int(begin[doc] - start)), min(n, int(begin[doc] + len(lists[doc]) - start))
            equal = np.zeros(n, bool)
            equal[lo:hi] = ids[start + lo : start + hi] == wanted[lo:hi]
            for a, b in stretches(equal, min(5, n)):
                longest = max(longest, b - a)
                covered[a:b] = True
                same[a:b] |= equal[a:b]
                first = min(first, start + a - begin[doc]) if first is not None else start + a - begin[doc]
                last = max(last, start + b - 1 - begin[doc]) if last is not None else start + b - 1 - begin[doc]
        enough = covered.sum() >= max(min(MIN_WORDS, n), COVERAGE * n)
        if enough or longest >= LONG_RUN:
            yield doc, item, n, int(covered.sum()), int(same.sum()), int(first), int(last)


def word_hashes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, REACH zeros after each, and where each text begins."""
    sizes = np.array([len(words) for words in lists], dtype=np.int64)
    begin = np.cumsum(sizes + REACH) - sizes - REACH
    ids = np.zeros(int((sizes + REACH).sum()), np.uint64)
    if sizes.sum():
        codes, words = pd.factorize(np.array([w for words in lists for w in words], dtype=object))
        hashes = np.maximum(pd.util.hash_array(words, categorize=False), np.uint64(1))
        ids[np.arange(len(codes)) + np.repeat(np.arange(len(lists)) * REACH, sizes)] = hashes[codes]
    return ids, begin


def seeds_of(ids: np.ndarray, masks: dict[int, tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: the places where it lies on words only, and its hashes there; equal hashes are of one mask."""
    for number, mask in masks.items():
        found = hashed(ids, mask)
        at = np.flatnonzero(found)
        yield at, (found[at] ^ np.uint64(number)) * np.uint64(0xD6E8FEB86659FD93)


def _item_seeds(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """item, number of the mask (its words for a short item, which is looked up whole), seed."""
    for batch in batches:
        parts = []
        for item, text in zip(batch["item"], batch["item_text"], strict=True):
            if not (words := words_of(text)):
                continue
            masks = dict(enumerate(MASKS, REACH)) if len(words) >= REACH else {len(words): tuple(range(len(words)))}
            for number, (_, found) in zip(masks, seeds_of(word_hashes([words])[0], masks), strict=True):
                parts.append(pd.DataFrame({"item": item, "mask": number, "seed": np.unique(found).view(np.int64)}))
        yield pd.concat(parts) if parts else pd.DataFrame({"item": [], "mask": [], "seed": []})


def _bits(seed: Column) -> Column:
    """The two bits of a seed in the filter."""
    return F.array(seed.bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned(seed, 32).bitwiseAND(FILTER_BITS - 1))


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The filter as 64-bit words, put together by the executors; at most FILTER_BITS / 64 rows reach the driver."""
    bits = seeds.select(F.explode(_bits(F.col("seed"))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _passes(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    out = np.ones(len(seeds), bool)
    for shift in (0, 32):
        at = (seeds >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)
        out &= ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def _seeker(shared, masks: dict[int, tuple[int, ...]]):
    """Rows that have a seed in the filter, with these seeds."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices([t or "" for t in texts]):
                ids, begin = word_hashes([words_of(t) for t in texts[part]])
                docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for at, seeds in seeds_of(ids, masks):
                    keep = _passes(bits, seeds)
                    docs.append(np.searchsorted(begin, at[keep], "right") - 1)
                    found.append(seeds[keep])
                hits = pd.DataFrame({"doc": np.concatenate(docs), "seed": np.concatenate(found).view(np.int64)}).drop_duplicates()
                if len(hits):
                    by_doc = hits.groupby("doc")["seed"].agg(list)
                    yield batch.iloc[part].iloc[by_doc.index].assign(seeds=by_doc.tolist())

    return tidy(run)


def _verifier(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, hashes, texts, wanted = (batch[c].tolist() for c in ("doc_id", "h", "text", "items"))
        found = []
        for part in slices(texts):
            items = {i["item"]: (i["item_id"], i["item_text"]) for row in wanted[part] for i in row}
            index = Index([(item, text) for item, (_, text) in items.items()])
            own = [{i["item"] for i in row} for row in wanted[part]]
            for doc, k, n, covered, same, first, last in find(index, texts[part]):
                item = index.items[k][0]
                if item in own[doc]:
                    found.append((ids[part.start + doc], hashes[part.start + doc], items[item][0], n, covered, same, same / n, first, last))
        yield pd.DataFrame(found, columns=["doc_id", "h", *[c.split()[0] for c in OUT.split(", ")][1:]])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Id and hash of the text of a row of docs; the id as a string, as pandas has no whole numbers beside nulls."""
    return docs[id_col].cast("long").cast("string"), F.xxhash64(docs[text_col].cast("string"))


def _pairs(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, block_words: int) -> DataFrame:
    """The columns of contaminated(), and h, the hash of the text."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    items = benchmark.select(F.col(item_id_col).cast("long").cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).distinct()
    items = items.select(F.xxhash64("item_id", "item_text").alias("item"), "item_id", "item_text")
    seeds = items.mapInPandas(_item_seeds, "item long, mask int, seed long").checkpoint()
    sizes = items.agg(F.sum(F.size(F.split("item_text", r"\s+"))).alias("words")).first().words or 0
    parts = max(1, -(-sizes // block_words))
    masks = {r.mask: MASKS[r.mask - REACH] if r.mask >= REACH else tuple(range(r.mask)) for r in seeds.select("mask").distinct().collect()}
    shared = spark.sparkContext.broadcast(seed_filter(seeds))
    rows = docs.select(*[c.alias(n) for c, n in zip(_keyed(docs, id_col, text_col), ("doc_id", "h"), strict=True)], F.col(text_col).cast("string").alias("text"))
    hits = rows.mapInPandas(_seeker(shared, masks), "doc_id string, h long, text string, seeds array<long>").checkpoint()
    shared.unpersist()
    met = hits.select("doc_id", "h", F.explode("seeds").alias("seed")).join(seeds.select("item", "seed"), "seed")
    candidates = met.select("doc_id", "h", "item").distinct().join(items, "item")
    rest = F.pmod(F.col("item"), F.lit(parts))
    candidates = candidates.groupBy("doc_id", "h", rest.alias("part")).agg(F.collect_list(F.struct("item", "item_id", "item_text")).alias("items"))
    candidates = candidates.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "items")
    met = hits.drop("seeds").join(candidates, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    return met.select("doc_id", "h", "text", "items").mapInPandas(tidy(_verifier), OUT.replace("doc_id long, item_id long,", "doc_id string, h long, item_id string,"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each contaminated (document, item): how much of the item is covered, how many of those words are
    equal, and from which to which word of the document."""
    return _pairs(docs, benchmark, id_col, text_col, item_id_col, item_text_col, block_words).withColumns({c: F.col(c).cast("long") for c in ("doc_id", "item_id")}).drop("h")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; a row without an id is judged by its text like any other."""
    gone = _pairs(docs, benchmark, id_col, text_col, "item_id", "text", BLOCK_WORDS).select(F.col("doc_id").alias("_gone"), F.col("h").alias("_gone_h")).distinct()
    doc_id, h = _keyed(docs, id_col, text_col)
    return docs.join(gone, doc_id.eqNullSafe(F.col("_gone")) & (h == F.col("_gone_h")), "left_anti")
