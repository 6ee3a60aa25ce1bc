"""How filters act on each other, by part of the corpus and order of application.

Each partition packs its rows into bitsets: one for every filter (row fails), label and part. The rows that survive a
set of filters are the AND-NOT of its bitsets; a popcount against parts and labels gives one small row of counts for
each part and set. Those rows are summed over partitions. Whatever an order of filters keeps, removes or loses at a step
is a difference of two such counts, so documents are read once for all orders.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.llm.batching import tidy
from sieverank.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Fewest words, smallest share of distinct words and greatest share of capitals (percent).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"
LABELS = ("good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """Failure of filters A to D, which look at one text."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (fails the filter), good, toxic for each row of `docs` (doc_id, text, source).

    A null text or source is an empty one. E: a row with a smaller doc_id, anywhere in the table, has the same text; a
    row without id is neither smaller nor greater than any, rows that share an id do not fail each other. Text is compared
    by its SHA-256. A label holds for a document if any of its rows in `labels` has a 1; ids without label have none.
    Only ids, digests and flags are shuffled. The first id of each text is found with partial minima, and only texts that
    occur twice or more are joined back, with the many rows of one text on the side that adaptive execution splits.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flags = text_flags(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in flags.items())).checkpoint()
    repeated = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    marked = facts.join(repeated, "digest", "left").withColumn("E", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    has = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    out = marked.drop("digest", "first").join(has, "doc_id", "left")
    return out.select("part", *"ABCDE", *(F.coalesce(F.col(k), F.lit(False)).alias(k) for k in LABELS))


def _bits(flags: np.ndarray) -> np.ndarray:
    """Booleans (last axis) packed into words of 64 bits."""
    packed = np.packbits(flags, axis=-1)
    spare = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, spare)])).view(np.uint64)


def subset_counts(rows: DataFrame, filters: Sequence[str], labels: Sequence[str] = (), part: str = "part") -> DataFrame:
    """part, subset (bit k: filter k), n and one count for each label: rows that pass every filter of the subset.

    Every part has a row for each subset. Flags are booleans, null counts as false; a null part is a part of its own. A
    task holds the bitsets of one batch and one table of counts; tables with many parts are handed on in between.
    """
    k, names = len(filters), list(labels)
    columns = [part, *filters, *names]

    def table(totals: dict) -> pd.DataFrame:
        parts = list(totals)
        counts = np.stack([totals[p] for p in parts])  # part, subset, measure
        out = {"part": np.repeat(np.array(parts, dtype=object), 1 << k), "subset": np.tile(np.arange(1 << k, dtype=np.int32), len(parts))}
        return pd.DataFrame(out | {name: counts[:, :, m].ravel() for m, name in enumerate(["n", *names])})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            codes, parts = pd.factorize(batch.iloc[:, 0], use_na_sentinel=False)
            flags = _bits(np.stack([batch.iloc[:, 1 + j].fillna(False).to_numpy(bool) for j in range(k + len(names))]))
            everything = _bits(np.ones((1, len(batch)), bool))
            measures = np.concatenate([everything, flags[k:]])
            alive = np.empty((1 << k, flags.shape[1]), np.uint64)
            alive[0] = everything[0]
            for j in range(k):
                alive[1 << j : 2 << j] = alive[: 1 << j] & ~flags[j]
            for number, name in enumerate(parts):
                chosen = _bits((codes == number)[None])[0] & measures  # measure, word
                found = np.bitwise_count(alive[:, None, :] & chosen[None]).sum(axis=2, dtype=np.int64)
                key = None if pd.isna(name) else name
                totals[key] = totals[key] + found if key in totals else found
            if len(totals) > 1000:
                yield table(totals)
                totals = {}
        if totals:
            yield table(totals)

    counts = ["n", *names]
    schema = ", ".join(["part string", "subset int", *(f"`{c}` long" for c in counts)])
    found = rows.select(*columns).mapInPandas(tidy(run), schema)
    return found.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in counts))


def interactions(counts: DataFrame, filters: str = "ABCDE", labels: Sequence[str] = LABELS) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of the filters; `counts` as of
    `subset_counts` for the same filters and labels.

    kept: rows after the step; removed: rows that go here; redundant: rows that fail the step's filter and are gone
    before; unique_fails: rows that fail this filter only; <label>_lost: labelled rows that go here; shapley: what the
    filter removes, summed over all orders. One row of arrays a part is made of the counts and exploded again, in memory.
    """
    k, whole = len(filters), (1 << len(filters)) - 1
    names = ["n", *labels]
    by_part = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *names))).alias("c"))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters)))).alias("filter_order")
    steps = by_part.select("part", "c", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    letter = "instr('{0}', substring(filter_order, {1}, 1)) - 1"
    mask = f"aggregate(sequence(1, step), 0, (m, j) -> m | shiftleft(1, {letter.format(filters, 'j')}))"
    steps = steps.withColumn("own", F.expr(f"shiftleft(1, {letter.format(filters, 'step')})")).withColumn("after", F.expr(mask))
    steps = steps.withColumn("before", F.expr("after ^ own"))
    weights = f"array({', '.join(str(factorial(s) * factorial(k - 1 - s)) for s in range(k))})"
    shapley = f"aggregate(sequence(0, {whole}), 0L, (s, i) -> s + if(i & own = 0, {weights}[cast(bit_count(i) as int)] * (c[i].n - c[i | own].n), 0L))"
    removed = "c[before].{0} - c[after].{0}"
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.expr("c[after].n").alias("kept"),
        F.expr(removed.format("n")).alias("removed"),
        F.expr("(c[0].n - c[own].n) - (c[before].n - c[after].n)").alias("redundant"),
        F.expr(f"c[{whole} ^ own].n - c[{whole}].n").alias("unique_fails"),
        *(F.expr(removed.format(name)).alias(f"{name}_lost") for name in labels),
        F.expr(shapley).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of filters A to E over `docs` and its `labels`; no documents give no rows."""
    return interactions(subset_counts(failures(docs, labels), "ABCDE", LABELS))
