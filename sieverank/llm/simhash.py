"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits agree in at least four byte positions
(count filter: GUARANTEED). Postings on single bytes would hold 1/256 of all fingerprints each and their pairs grow
with the square of the corpus, so the index is on triples of positions: 20 triples suffice for every four positions to
contain one of them (Turan's construction on groups of 3, 3 and 2 positions). Pairs that meet in a posting have their
shared positions tallied, those below the guaranteed count are dropped, the rest is verified by differing bits.

Exact copies have one fingerprint and are one node. Within a posting only a spanning forest of its verified links is
kept, which leaves the components as they are. Postings of more than BLOCK fingerprints are cut into blocks, and each
pair of blocks is a task group of its own, so that no posting meets in one task and none is capped.

Defined results: null and empty texts have no word and the fingerprint zero, linked like any other; a null id never
becomes a component id unless the whole component has none; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.llm.batching import tidy
from sieverank.llm.graph import components, least_ids
from sieverank.session import ensure_checkpoint_dir

SHINGLE, SEED, MOST_BITS = 4, 42, 4
GUARANTEED = 8 - MOST_BITS
#: Fingerprints of one posting that are compared in one piece; larger postings are cut into blocks of about this size.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])], dtype="<u8")
    return int.from_bytes(np.packbits(2 * votes(hashes) > len(hashes), bitorder="little").tobytes(), "little")


#: Bits of each byte value, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) for each row; no shuffle."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": values.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(tidy(run), "doc_id long, fp long")


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the positions 0 to 7 such that each four positions contain one."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    found = [t for g in groups for t in combinations(g, 3)]
    for i, g in enumerate(groups):
        found += [(*pair, one) for pair in combinations(g, 2) for one in groups[(i + 1) % 3]]
    return found


def postings(fp: Column) -> Column:
    """Keys of the index: the triple's number and the bytes at its three positions."""

    def byte(i: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))

    return F.array(*[F.lit(t << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for t, (a, b, c) in enumerate(covering_triples())])


def near(a: np.ndarray, b: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Count filter, then verification, on arrays of pairs (rows of 64-bit words): the byte positions that a pair shares
    are tallied, pairs below the guaranteed number (GUARANTEED for one word and MOST_BITS) go, the rest is verified."""
    x = a ^ b
    shared = (np.ascontiguousarray(x).view(np.uint8) == 0).sum(axis=1)
    kept = np.flatnonzero(shared >= 8 * x.shape[1] - most)
    out = np.zeros(len(x), bool)
    out[kept] = np.bitwise_count(x[kept]).sum(axis=1) <= most
    return out


def forest(fps: np.ndarray, side: np.ndarray | None, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among `fps`; with `side`, only links between different sides count."""
    label = np.arange(len(fps))
    links = []
    for i in range(len(fps) - 1):
        rest = fps[i + 1 :]
        hit = near(rest, fps[i], most)
        if side is not None:
            hit &= side[i + 1 :] != side[i]
        at = np.flatnonzero(hit) + i + 1
        at = at[label[at] != label[i]]
        while len(at):
            links.append((i, int(at[0])))
            label[label == label[at[0]]] = label[i]
            at = at[label[at] != label[i]]
    return links


def whole_postings(batches: Iterable[pd.DataFrame], found: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """found() of sorted rows (key, lo, hi, ...) in pieces that cut no posting."""
    held: list[pd.DataFrame] = []  # rows of the posting that is still open
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[["key", "lo", "hi"]].to_numpy()
        is_open = (keys == keys[-1]).all(axis=1)
        if held and (held[-1][["key", "lo", "hi"]].to_numpy()[-1] == keys[-1]).all():
            held.append(batch)
            continue
        closed = [*held, batch[~is_open]]
        if sum(map(len, closed)):
            yield found(pd.concat(closed))
        held = [batch[is_open]]
    if held:
        yield found(pd.concat(held))


def posting_links(batches: Iterable[pd.DataFrame], most: int = MOST_BITS, words: tuple[str, ...] = ("fp",)) -> Iterator[pd.DataFrame]:
    """Links of sorted postings (key, lo, hi, block, node, words...); a posting may cross batches, none is larger than
    two blocks."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[["key", "lo", "hi"]].to_numpy()
        fps = rows[list(words)].to_numpy().view(np.uint64)
        node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.r_[first, len(rows)])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        small = size <= 32
        at = np.flatnonzero(np.repeat(small, size))
        g = np.repeat(np.arange(len(first)), size)[at]
        d = 1
        while d < len(at) and (size[small] > d).any():  # d-th neighbours in all small postings at once
            same = np.flatnonzero(g[d:] == g[:-d])
            a, b = at[same], at[same + d]
            ok = near(fps[a], fps[b], most)
            out.append((node[a[ok]], node[b[ok]]))
            d += 1
        for k in np.flatnonzero(~small):
            part = slice(first[k], first[k] + size[k])
            side = block[part] if key[first[k], 1] != key[first[k], 2] else None
            found = np.array(forest(fps[part], side, most), dtype=np.int64).reshape(-1, 2)
            out.append((node[part][found[:, 0]], node[part][found[:, 1]]))
        a, b = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return whole_postings(batches, links)


def _meeting(keyed: DataFrame, counts: DataFrame, nodes: DataFrame, block: int, words: tuple[str, ...], compare: Callable) -> DataFrame:
    """a, b: what `compare` finds among the rows (key, node) of the keys in counts (key, count).

    Most keys occur once and go at the first join; only the others fetch the words of their fingerprint from nodes.
    """
    return _blocks(keyed.select("key", "node").join(counts.select("key", "count"), "key"), nodes, block, words, compare)


def _blocks(shared: DataFrame, nodes: DataFrame, block: int, words: tuple[str, ...], compare: Callable, out: str = "a long, b long") -> DataFrame:
    """The same for rows (key, node, count); postings of more than `block` rows go to pairs of blocks."""
    rows = shared.select("key", "node", F.ceil(F.col("count") / block).cast("int").alias("blocks")).join(nodes.select("node", *words), "node")
    mine = F.when(F.col("blocks") > 1, F.pmod(F.hash("node"), F.col("blocks"))).otherwise(F.lit(0))
    rows = rows.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", *words)
    sorted_rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return sorted_rows.mapInPandas(tidy(compare), out)


def fingerprint_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that give the components of the link graph."""
    nodes = nodes.select(F.col("fp").alias("node"), "fp")
    keyed = nodes.select(F.explode(postings(F.col("fp"))).alias("key"), "node")
    return _meeting(keyed, keyed.groupBy("key").count().filter("count > 1"), nodes, block, ("fp",), posting_links)


#: The wide form: two 64-bit words, and posting keys of three byte positions after each of ROUNDS fixed permutations of
#: the bits. It only joins early what is easily joined.
WIDE_BITS, WIDE_SHINGLE, ROUNDS = 20, 5, 2


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of their 64 bits set."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 200:
        return np.unpackbits(columns, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(columns[:, i], minlength=256) @ BITS for i in range(8)])


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of shingle hashes, repeats included, as two signed words; the second is voted on by their remix."""
    again = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    again ^= again >> np.uint64(32)
    bits = np.concatenate([votes(hashes), votes(again)])
    a, b = np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")
    return int(a), int(b)


def wide_postings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys [rows, 5 * ROUNDS]: five triples of the sixteen bytes after each permutation of the bits."""
    bits = np.unpackbits(np.stack([a, b], axis=1).view(np.uint8), axis=1)
    rng = np.random.default_rng(128)
    keys = []
    for r in range(ROUNDS):
        data = np.packbits(bits[:, rng.permutation(128)], axis=1).astype(np.int64)
        for k in range(5):
            keys.append((np.int64(5 * r + k) << 24) | (data[:, 3 * k] << 16) | (data[:, 3 * k + 1] << 8) | data[:, 3 * k + 2])
    return np.stack(keys, axis=1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for each row: component_id is the smallest doc_id that links reach."""
    ensure_checkpoint_dir(docs.sparkSession)
    known = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    nodes = known.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    ids = least_ids(nodes.withColumnRenamed("fp", "node"), components(fingerprint_links(nodes.select("fp"))))
    return known.join(ids.withColumnRenamed("node", "fp"), "fp").select("doc_id", "fp", "component_id")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_of(words: list[bytes]) -> int:
    """Signed 64-bit name of a word sequence; texts that differ only in case or blanks are one node."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64))


def shingle_hashes(words: list[bytes], shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; texts of fewer words are one shingle, those without any the empty one."""
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined)], dtype=np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.array([digest(joined[a : b - 1]) for a, b in zip(starts, starts[shingle:])], dtype=np.uint64)


def shingle_set(words: list[bytes], shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(words, shingle))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard likeness of 0.8 or more: 9 |a and b| >= 4 (|a| + |b|), in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


#: Bytes of each shingle hash that are sent for verification; within one pair of texts these do not collide.
SENT_BYTES = 5


def packed_set(shingles: np.ndarray) -> bytes:
    """A shingle set by the upper SENT_BYTES bytes of its hashes, in order, as compressed planes."""
    planes = (np.unique(shingles >> np.uint64(64 - 8 * SENT_BYTES))).view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked_set(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(SENT_BYTES, -1).T
    out = np.zeros((len(planes), 8), np.uint8)
    out[:, :SENT_BYTES] = planes
    return out.view(np.uint64).ravel()


#: Bits of the filter that keeps texts no candidate names out of the shuffle; false hits cost time only.
WANTED_BITS = 24


def _place(key: int) -> int:
    return (key ^ (key >> 21) ^ (key >> 43)) & ((1 << WANTED_BITS) - 1)


def shingle_sets(named_in: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, shingles (packed) of the nodes in named_in (node), and of some others; nodes has node and least, docs doc_id and text.

    Of the copies of a word sequence only the row with the least id sends its shingles (all rows if none has an id, and
    seldom another one).
    """
    ids = named_in.join(nodes.select("node", "least"), "node").select(F.coalesce("least", "node").alias("key"))
    at = ids.select((F.col("key").bitwiseXOR(F.shiftright("key", 21)).bitwiseXOR(F.shiftright("key", 43))).bitwiseAND(F.lit((1 << WANTED_BITS) - 1)).alias("at"))
    bits = np.zeros(1 << WANTED_BITS, bool)
    bits[at.distinct().toPandas()["at"].to_numpy(np.int64)] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def is_wanted(key: int) -> bool:
            return bool(wanted.value[_place(key) >> 3] >> (7 - (_place(key) & 7)) & 1)

        for batch in batches:
            found = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if pd.isna(doc_id):
                    words = normal_words(text)
                    if is_wanted(node := node_of(words)):
                        found.append((node, packed_set(shingle_hashes(words))))
                elif is_wanted(int(doc_id)):
                    words = normal_words(text)
                    found.append((node_of(words), packed_set(shingle_hashes(words))))
            yield pd.DataFrame(found, columns=["node", "shingles"])

    return docs.select("doc_id", "text").mapInPandas(tidy(sets), "node long, shingles binary")


def real_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: nodes) whose texts are alike; nodes and docs as in shingle_sets()."""

    def check(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [alike(unpacked_set(x), unpacked_set(y)) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    sets = shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), nodes, docs)

    def told(side: str, name: str) -> DataFrame:
        return sets.select(F.col("node").alias(side), F.col("shingles").alias(name))

    both = pairs.join(told("a", "x"), "a").join(told("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInPandas(tidy(check), "a long, b long").distinct()


#: Words of a set's parity sketch: bit i tells whether an odd number of its hashes falls on i.
SKETCH = tuple(f"m{i}" for i in range(4))
NAMED = "doc_id long, node long, w0 long, w1 long, size long, " + ", ".join(f"{m} long" for m in SKETCH)


def named(rows: DataFrame) -> DataFrame:
    """NAMED for each row: the name of its word sequence, 128-bit fingerprint, number of distinct shingles and parity sketch."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                words = normal_words(text)
                hashes = shingle_hashes(words)
                distinct = np.unique(hashes)
                found.append((node_of(words), *wide_fingerprint(hashes), len(distinct), *parity(distinct).tolist()))
            out = pd.DataFrame(found, columns=["node", "w0", "w1", "size", *SKETCH])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return rows.mapInPandas(tidy(run), NAMED)


def wide_index(nodes: DataFrame) -> DataFrame:
    """key, node: the posting keys of each node (node, w0, w1)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = wide_postings(*(batch[c].to_numpy().view(np.uint64) for c in ("w0", "w1")))
            yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(batch["node"].to_numpy(), keys.shape[1])})

    return nodes.select("node", "w0", "w1").mapInPandas(tidy(run), "key long, node long")


#: Documents (about) whose shingles are counted for the order of the prefix index, and how many frequent ones it knows.
#: Any order gives the same links; a better one gives shorter postings. A key seen in HOT_SEEN of them has postings that
#: are counted with partial sums before anything meets.
ORDER_ROWS, ORDER_SIZE, HOT_SEEN = 10_000, 200_000, 5


def frequent_shingles(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and counts, of the most frequent shingles of a sample of docs (column text)."""
    share = max(1, n_docs // ORDER_ROWS)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(normal_words(t)).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, np.int64), *found])})

    counts = docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").mapInPandas(tidy(run), "h long").groupBy("h").count()
    top = counts.filter("count > 1").orderBy(F.desc("count"), "h").limit(ORDER_SIZE).toPandas()
    hashes, ranks = top["h"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def guaranteed(n, m):
    """The least number of keys that the prefixes of two alike sets of n and m shingles share.

    Up to the earlier end of the two prefixes in the order of shingles, all common shingles are in both; what comes later
    is at most the rest of that set, and 4 (n + m) / 9 are common in all.
    """
    rest = np.maximum(n - prefix_length(n), m - prefix_length(m))
    return np.maximum(-(-(4 * (n + m) - 9 * rest) // 9), 1)


def prefix_of(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(0.8 n) + 1 shingles, rare ones first, and which of them are hot. Two sets that are alike share
    one of these: each has 0.8 n shingles in common with the other, so the first common one in the order cannot come later."""
    hashes, counts = frequent
    rank = np.zeros(len(shingles), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        rank = np.where(hashes[at] == shingles, counts[at], 0)
    chosen = np.lexsort((shingles, rank))[: prefix_length(len(shingles))]
    return shingles[chosen], rank[chosen] >= HOT_SEEN


def prefix_keys(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return prefix_of(shingles, frequent)[0]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bits by which two sketches differ: at most the shingles by which the two sets differ."""
    bits = np.bincount((shingles & np.uint64(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def prefix_index(docs: DataFrame, n_docs: int) -> DataFrame:
    """node, keys, hot_keys: one row for each distinct word sequence of docs (column text)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n_docs))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done: dict[int, tuple] = {}
            for text in batch["text"]:
                words = normal_words(text)
                node = node_of(words)
                if node not in done:
                    keys, hot = prefix_of(shingle_set(words), shared.value)
                    done[node] = (node, keys[~hot].view(np.int64), keys[hot].view(np.int64))
            yield pd.DataFrame(list(done.values()), columns=["node", "keys", "hot_keys"])

    return docs.select("text").mapInPandas(tidy(run), "node long, keys array<long>, hot_keys array<long>").dropDuplicates(["node"])


def may_be_alike(size: np.ndarray, sketch: np.ndarray, i: int | np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which of the sets `rest` can be alike to set i, by bounds that no alike pair breaks: each has 0.8 of the other's
    size, and they differ in at most a ninth of their sizes' sum."""
    n = size[rest]
    fits = (5 * np.minimum(n, size[i]) >= 4 * np.maximum(n, size[i]))
    return fits & (9 * np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= n + size[i])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links a, b that join what the links before have not joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            kept.append(k)
    return a[kept], b[kept]


def groups_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the groups (key, lo, hi) of sorted rows start, their sizes, and whether only pairs across blocks are theirs."""
    key = rows[["key", "lo", "hi"]].to_numpy()
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    return first, np.diff(np.r_[first, len(rows)]), key[first, 1] != key[first, 2]


def possible_links(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b: links that join what may be alike and is of different components in a posting, of sorted batches (key, lo, hi,
    block, node, known, size, SKETCH...). Less than one for each row comes out, however large the postings are."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        first, count, across = groups_of(rows)
        node, known, block, size = (rows[c].to_numpy() for c in ("node", "known", "block", "size"))
        sketch = rows[list(SKETCH)].to_numpy().view(np.uint64)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def add(i: int | np.ndarray, rest: np.ndarray, across: bool | np.ndarray) -> np.ndarray:
            ok = (known[rest] != known[i]) & (~np.asarray(across) | (block[rest] != block[i]))
            ok[ok] = may_be_alike(size, sketch, i if np.isscalar(i) else i[ok], rest[ok])
            return ok

        small = count <= 32
        at = np.flatnonzero(np.repeat(small, count))
        g = np.repeat(np.arange(len(first)), count)[at]
        d = 1
        while d < len(at) and (count[small] > d).any():  # d-th neighbours in all small postings at once
            same = np.flatnonzero(g[d:] == g[:-d])
            i, rest = at[same], at[same + d]
            ok = add(i, rest, across[g[same]])
            out.append((node[i[ok]], node[rest[ok]]))
            d += 1
        for k in np.flatnonzero(~small):
            start, end = first[k], first[k] + count[k]
            label = np.arange(end - start)
            for i in range(start, end - 1):
                rest = np.arange(i + 1, end)
                rest = rest[label[rest - start] != label[i - start]]
                rest = rest[add(int(i), rest, across[k])]
                _, one = np.unique(label[rest - start], return_index=True)
                out.append((np.full(len(one), node[i]), node[rest[one]]))
                label[np.isin(label, label[rest - start])] = label[i - start]
        a, b = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        a, b = spanning(a, b)
        return pd.DataFrame({"a": a, "b": b})

    return whole_postings(batches, links)


def alike_links(rows: pd.DataFrame, across: bool) -> list[tuple[int, int]]:
    """A spanning forest, with what `known` says, of the alike pairs among rows (node, known, block, size, SKETCH..., keys,
    shingles); with `across` of those between different blocks. The postings that a pair shares are tallied, and pairs
    below the number that alike sets are guaranteed to share are not compared. Without shingles the tally alone decides."""
    rows = rows.drop_duplicates("node")
    node, block, size = (rows[c].to_numpy() for c in ("node", "block", "size"))
    known = np.unique(rows["known"].to_numpy(), return_inverse=True)[1]
    sketch = rows[list(SKETCH)].to_numpy().view(np.uint64)
    lengths = rows["keys"].map(len).to_numpy()
    _, code = np.unique(np.concatenate([np.asarray(k, np.int64) for k in rows["keys"]]), return_inverse=True)
    ends = np.r_[0, np.cumsum(lengths)]
    owner = np.repeat(np.arange(len(rows)), lengths)[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    start = np.cumsum(count) - count
    blobs = rows["shingles"].tolist() if "shingles" in rows else None
    # Links by tally alone say nothing of other nodes of the same components: there each node has its own label.
    label = np.arange(len(rows)) if blobs is None else known.copy()
    sets: dict[int, np.ndarray] = {}

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = unpacked_set(blobs[i])
        return sets[i]

    links = []
    for i in range(len(rows) - 1):
        mine = code[ends[i] : ends[i + 1]]
        n = count[mine]
        met = owner[np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        met = met[(met > i) & (known[met] != known[i]) & (label[met] != label[i])]
        if across:
            met = met[block[met] != block[i]]
        rest, tally = np.unique(met, return_counts=True)
        ok = tally >= guaranteed(size[rest], size[i])
        ok[ok] = may_be_alike(size, sketch, i, rest[ok])
        rest = rest[ok][np.argsort(-tally[ok], kind="stable")]
        while len(rest):
            j, rest = int(rest[0]), rest[1:]
            if blobs is None or alike(set_of(i), set_of(j)):
                links.append((node[i], node[j]))
                label[label == label[j]] = label[i]
                rest = rest[label[rest] != label[i]]
    return links


def family_links(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b: alike_links() of each family, or pair of its blocks, in sorted batches (key, lo, hi, block, node, ...)."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        first, count, across = groups_of(rows)
        found = [pair for k in np.flatnonzero(count > 1) for pair in alike_links(rows.iloc[first[k] : first[k] + count[k]], across[k])]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return whole_postings(batches, links)


#: Shingles of one family's texts that are compared in one piece; larger families are cut into more blocks. Where only
#: prefixes are sent, a piece takes more.
FAMILY_SHINGLES, FAMILY_KEYS = 4_000_000, 16_000_000


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, component_id: components of the pairs whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

    The keys of the wide form join what is easily joined. Then an index on shingle prefixes gives all candidates between
    different components. Pairs are not written out, as they grow with the square of a group of near copies: postings tell
    which nodes may be alike as links that join them, these give families, and each family is compared in one place (or in
    pairs of blocks): first the postings that a pair shares are tallied, which gives smaller families, then the sets of
    those are compared. Only links that join components come out of each step.
    Every link of either pass is verified by its shingles before components are made.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = named(rows).checkpoint()
    same = [F.first(c).alias(c) for c in ("w0", "w1", "size", *SKETCH)]  # functions of the node
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *same).checkpoint()
    n_docs = int(nodes.agg(F.sum("copies")).first()[0] or 0)
    keyed = wide_index(nodes)
    pairs = _meeting(keyed, keyed.groupBy("key").count().filter("count > 1"), nodes, block, ("w0", "w1"), lambda batches: posting_links(batches, WIDE_BITS, ("w0", "w1"))).distinct().checkpoint()
    links = real_links(pairs, nodes, rows).checkpoint()
    told = prefix_index(rows, n_docs).join(components(links), "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root").checkpoint()
    words = ("known", "size", *SKETCH)
    beside = told.select("node", "known").join(nodes.select("node", "size", *SKETCH), "node")
    # Most keys occur once: they go in the one shuffle that brings rows of a key together. Hot keys are counted first.
    every = Window.partitionBy("key")
    rest = told.select(F.explode("keys").alias("key"), "node", "known")
    rest = rest.select("key", "node", F.min("known").over(every).alias("lo"), F.max("known").over(every).alias("hi"), F.count("*").over(every).alias("count")).filter("lo <> hi")
    hot = told.select(F.explode("hot_keys").alias("key"), "node", "known")
    counted = hot.groupBy("key").agg(F.min("known").alias("lo"), F.max("known").alias("hi"), F.count("*").alias("count")).filter("lo <> hi").select("key", "count")
    shared = rest.select("key", "node", "count").unionByName(hot.select("key", "node").join(counted, "key"))
    shared = shared.checkpoint()
    shared_keys = shared.groupBy("node").agg(F.collect_list("key").alias("keys"))

    def within(families: DataFrame, full: DataFrame, most: int, *more: str) -> DataFrame:
        """Links inside each family (node, root): blocks of at most about `block` nodes and `most` shingles."""
        weight = F.greatest(F.count("*"), F.ceil(F.sum("size") * (block / most)))
        counted = families.join(beside.select("node", "size"), "node").groupBy("root").agg(weight.alias("count"))
        members = families.join(counted, "root").select(F.col("root").alias("key"), "node", "count")
        return _blocks(members, full, block, (*words, "keys", *more), family_links)

    # Families by bounds alone can be wide, so the tally splits them by their keys before any set is sent.
    loose = components(_blocks(shared, beside, block, words, possible_links))
    inside = loose.select("node").join(beside, "node").join(shared_keys, "node").checkpoint()
    tight = components(within(loose, inside, FAMILY_KEYS))
    full = tight.select("node").join(inside, "node").join(shingle_sets(tight.select("node"), nodes, rows), "node")
    more = within(tight, full, FAMILY_SHINGLES, "shingles").checkpoint()
    ids = least_ids(nodes.select("node", "least"), components(links.unionByName(more)))
    return known.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-duplicates of near_copies: of each component the document whose id is the component's smallest stays.

    Rows that share an id count as one document and stay or go together; rows without an id cannot be named and stay.
    """
    groups = near_copies(docs, id_col, text_col)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
