"""Runs of words that repeat with a period, found by counting the matches of every lag.

At lag q two positions match if their words are equal. A run of period q and n words holds n - q consecutive matches,
so a lag with fewer matches in the whole text holds none. All lags are counted at once: words that are frequent enough
by an exact autocorrelation (their indicators are transformed, squared, summed and transformed back once), the others by
the differences of their positions, in pieces of bounded size. Only lags with enough matches get an island scan, which
looks at the matches themselves, so the result does not hang on the counts' rounding.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.llm.batching import tidy

WORD = r"[^\x20\x09-\x0D]+"
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Word pairs that take the time of one point of a transform, per doubling of its size.
PAIRS_A_POINT = 3.0
#: Positions of the shortest stretch that are looked at before a lag is scanned in full.
SAMPLES = 8
#: Pairs of positions that are differenced at once.
PAIRS = 2_000_000

_words = re.compile(WORD).findall


def _smooth(n: int) -> int:
    """The least 2^a 3^b 5^c that is n or more: sizes that transform fast."""
    best, five = 1 << max(n - 1, 0).bit_length(), 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max((n + three - 1) // three - 1, 0).bit_length())
            three *= 3
        five *= 5
    return best


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """Number of positions i with ids[i] == ids[i + q], for q = 0 (not counted, 0) to `most`."""
    n = len(ids)
    counts = np.zeros(most + 1, dtype=np.int64)
    size = _smooth(n + most)  # a circle in which no lag up to `most` wraps around
    often = np.bincount(ids)
    heavy = np.flatnonzero(often * (often - 1.0) / 2 * PAIRS_A_POINT > size * np.log2(size))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            spectrum = np.fft.rfft((ids == word).astype(np.float64), size)
            power += spectrum.real**2 + spectrum.imag**2
        counts[1:] += np.rint(np.fft.irfft(power, size)[1 : most + 1]).astype(np.int64)
    light = (often > 1) & ~np.isin(np.arange(len(often)), heavy)
    order = np.argsort(ids, kind="stable")
    order = order[light[ids[order]]]
    words = ids[order]
    # Every occurrence pairs with the later ones of its word, which follow it in `order`.
    later = np.searchsorted(words, words, "right") - np.arange(len(words)) - 1
    total = np.cumsum(later)
    start = 0
    while start < len(order):
        done = total[start - 1] if start else 0
        stop = max(int(np.searchsorted(total, done + PAIRS, "right")), start + 1)
        some = later[start:stop]
        left = np.repeat(np.arange(start, stop), some)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some)
        lags = order[right] - order[left]
        counts += np.bincount(lags[lags <= most], minlength=most + 1)
        start = stop
    return counts


def find_runs(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    Lags are taken in ascending order. The stretch of a multiple of the period of a run found before, over the same
    words, is the same run: it begins and ends with it, as the words beyond break the shorter period too. So its matches
    are taken off the count of that lag; a text of one word is scanned at lag 1 alone.
    """
    n, found = len(ids), {}
    most = n // least_periods
    if n < least_words or most < 1:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(least_words - lags, (least_periods - 1) * lags)
    spare = lag_matches(ids, most) - need
    for q in np.flatnonzero(spare[1:] >= 0) + 1:
        if spare[q] < 0:  # runs found meanwhile account for its matches
            continue
        # A long enough stretch covers so many of every step-th position in a row; most lags end here.
        step = max(int(need[q]) // SAMPLES, 1)
        gaps = np.flatnonzero(ids[q::step] != ids[: n - q : step])
        if np.diff(gaps, prepend=-1, append=(n - q + step - 1) // step).max() - 1 < need[q] // step:
            continue
        breaks = np.flatnonzero(ids[q:] != ids[: n - q])
        ends = np.append(breaks, n - q)
        begins = np.append(0, breaks + 1)
        for start, stop in zip(begins[ends - begins >= need[q]], ends[ends - begins >= need[q]], strict=True):
            length = int(stop - start + q)
            if (int(start), length) in found:
                continue
            found[int(start), length] = int(q)
            multiples = np.arange(q, min(length - 1, most) + 1, q)
            spare[multiples] -= length - multiples
    return sorted((start, length, q) for (start, length), q in found.items())


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words outside of runs and the first period of each run, joined by one space."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    inside = np.cumsum(edges)
    return " ".join([w for w, k in zip(words, inside, strict=False) if not k]) if runs else " ".join(words)


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and the collapsed text of each row.

    No shuffle: a row needs nothing but its own text, and a task holds one batch and the counts of one text. A null text
    is an empty one (no words, no runs, empty text); ids may be null or repeat, each row gives one row; other columns
    are not looked at; an empty table gives no rows. Of runs over the same words the smallest period is reported.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch["text"]:
                words = _words(text or "")
                number: dict[str, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                found = find_runs(ids, least_words, least_periods)
                counts.append(len(words))
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
                texts.append(collapse(words, found))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": counts, "runs": runs, "collapsed": texts})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(tidy(run), RUNS)


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with the words of one document in ten made periodic from a point on, both chosen by its id.

    h is the CRC-32 of the id in decimal and g = h div 10. Where h mod 10 is 0 and there are words, word i from
    a = g mod n on becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other rows keep their text, as do
    rows without an id.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), h.alias("h"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    chosen = F.col("h") % 10 == 0
    rows = rows.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.expr("(h div 10) % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    periodic = F.expr("concat_ws(' ', transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])))")
    return rows.select("doc_id", F.when(chosen & (F.col("n") > 0), periodic).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exact exponent, and digests, of the rows of `periodic_runs`."""
    lines: Column = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    # Runs come by start, then period, so an equal exponent leaves the first.
    best = F.expr("aggregate(runs, runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
