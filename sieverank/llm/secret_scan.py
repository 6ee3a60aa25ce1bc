"""Secret scans with built-in functions only.

Base rules find assignments, access keys and hex runs. The randomness battery adds spans: each other run of key-like
characters gets an inferred encoding and three tests against the null hypothesis "a token that somebody composed from
words, numbers and separators":

* chi-squared uniformity over the inferred alphabet: composed tokens repeat letters, so their statistic lies well above
  that of uniform symbols; a low one speaks for a generated key;
* runs: changes between lower case, upper case and digits are rare in composed tokens (rate CHANGE_RATES of the encoding)
  and frequent in generated ones. A capital before a small letter begins a word and counts as a small letter, so that
  camel case is composed;
* serial correlation of the character class at lag 1: near COMPOSED_CORRELATION in composed tokens, near 0 in
  generated ones.

Each p-value is an upper bound that holds at any length (Chernoff bounds), the three are combined by Bonferroni (they
depend on each other), and a step-up false-discovery control at level FDR runs over all candidates of the corpus within
each stratum, a band of lengths of one encoding: long words, of one case, do not raise the limit for mixed keys. For that,
p-values are put into bins of BIN in -log10, taken at their upper edge; the table of (stratum, bin) counts has at most
(len(BANDS) + 1) * len(CHANGE_RATES) * MAX_BIN rows whatever the corpus.

Runs of fewer than 16 characters are not tested: no test tells them from composed ones at these levels. Digits alone and
letters of one case have no change of class, and are found by their letters only where they are long.

Positions are code points, ends exclusive. Results are row by row: a null text counts as empty, repeated rows give
repeated results, ids may be null or repeated, further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.llm.columns import let
from sieverank.session import ensure_checkpoint_dir

#: The base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Cheaper forms for the same matches: maximal runs that are long enough.
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
LONG_HEX = r"[0-9a-f]{24,}"
#: What the battery looks at.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
COMPOSED_CORRELATION, COINCIDENCE, FDR = 0.6, 0.066, 0.001
#: Symbols of the encoding -> rate of changes of class in composed tokens of it (digits in words are rare, in hex less so).
CHANGE_RATES = {10: 0.15, 16: 0.08, 26: 0.15, 32: 0.05, 36: 0.05, 62: 0.05, 64: 0.08}
BANDS = (20, 24, 32, 48, 64, 128)
BIN, MAX_BIN = 0.05, 1200

SPAN = "struct<start:long,rank:int,stop:long>"


def _sum(values: Column, zero: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(zero), lambda acc, x: acc + x)


def prefix_sums(lengths: Column) -> Column:
    """Exclusive running sums of an array of longs. Two levels of about sqrt(n) keep it at n**1.5 steps for long arrays."""

    def of(values: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), width)
        return let(F.transform(starts, lambda s: F.slice(values, s, width)), within)

    def within(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: _sum(block))
        return let(sums, lambda of_blocks: let(starts_of(of_blocks), lambda at: F.flatten(F.zip_with(blocks, at, lambda block, a: F.transform(block, lambda _, j: a + _sum(F.slice(block, 1, j)))))))

    def starts_of(sums: Column) -> Column:
        return F.transform(sums, lambda _, b: _sum(F.slice(sums, 1, b)))

    return let(lengths, of)


def _spans(pieces: Column, found: Column, rank: int) -> Column:
    """Spans of the matches, from what stands between them (`pieces`) and the matches themselves."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: (F.char_length(p) + F.char_length(m)).cast("long"))
    before = prefix_sums(steps)
    starts = F.zip_with(before, F.slice(pieces, 1, F.size(found)), lambda b, p: b + F.char_length(p).cast("long"))
    return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.char_length(m).cast("long")).alias("stop")))


def _matches(df: DataFrame, name: str, guard: str, pattern: str, rank: int, keep=None, group: int | None = None) -> DataFrame:
    """Adds column `name`: the spans of `pattern` in `t`; regular expressions run again only on texts that pass `guard`."""
    none, no_spans = F.array().cast("array<string>"), F.array().cast(f"array<{SPAN}>")
    hit = f"_{name}_hit"
    df = df.withColumn(hit, F.col("t").rlike(guard))
    df = df.withColumn(f"_{name}_m", F.when(F.col(hit), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(f"_{name}_p", F.when(F.col(hit), F.split("t", pattern)).otherwise(none))
    spans = _spans(F.col(f"_{name}_p"), F.col(f"_{name}_m"), rank)
    if keep is not None:
        df = df.withColumn(f"_{name}_g", F.when(F.col(hit), F.regexp_extract_all("t", F.lit(pattern), F.lit(group))).otherwise(none))
        pairs = F.zip_with(spans, F.col(f"_{name}_g"), lambda s, g: F.when(keep(g), s))
        spans = F.filter(pairs, lambda s: s.isNotNull())
    df = df.withColumn(name, F.when(F.size(f"_{name}_m") > 0, spans).otherwise(no_spans))
    return df.drop(hit, f"_{name}_p", f"_{name}_g")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds assign, access, hex: arrays of spans in column `t`."""
    df = _matches(df, "assign", r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]", ASSIGN, 0, lambda g: F.char_length(g) >= ASSIGN_VALUE, 2)
    df = _matches(df, "access", LONG_ACCESS, LONG_ACCESS, 1)
    return _matches(df, "hex", LONG_HEX, LONG_HEX, 2).drop("_assign_m", "_access_m", "_hex_m")


def alphabet_size(token: Column) -> Column:
    """Symbols of the inferred encoding: digits, hex, letters of one case, base 32, one case and digits, base 62, base 64."""
    sizes = ((r"^[0-9]+$", 10), (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16), (r"^(?:[a-z]+|[A-Z]+)$", 26), (r"^[A-Z2-7]+=*$", 32), (r"^(?:[a-z0-9]+|[A-Z0-9]+)$", 36), (r"^[A-Za-z0-9]+$", 62))
    out = F.lit(64)
    for pattern, size in reversed(sizes):
        out = F.when(token.rlike(pattern), F.lit(size)).otherwise(out)
    return out


def _upper_tail(z: Column) -> Column:
    """A bound of the normal upper tail that holds for every z."""
    return F.when(z > 0, 0.5 * F.exp(-z * z / 2)).otherwise(F.lit(1.0))


def battery(token: Column) -> Column:
    """-log10 of the combined p-value against the null hypothesis of a composed token."""
    n = F.char_length(token).cast("double")
    k = alphabet_size(token).cast("double")
    composed = F.lit(0.0)
    for symbols, usual in CHANGE_RATES.items():
        composed = F.when(k == symbols, F.lit(usual)).otherwise(composed)
    squares = F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.char_length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    excess = (n - 1) * (k * COINCIDENCE - 1)
    chi_p = F.when(excess > 0, let(k * squares / n - n, lambda chi: _upper_tail((k - 1 + excess - chi) / F.sqrt(2 * (k - 1) + 4 * excess)))).otherwise(F.lit(1.0))
    plain = F.regexp_replace(token, "[^A-Za-z0-9]", "")  # separators join words and are of no class
    words = F.regexp_replace(plain, "[A-Z][a-z]", "aa")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(words, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")

    size = F.greatest(F.char_length(plain), F.lit(4)).cast("double")

    def runs(rate: Column, usual: Column) -> Column:
        divergence = rate * F.log(F.greatest(rate, F.lit(1e-12)) / usual) + (1 - rate) * F.log(F.greatest(1 - rate, F.lit(1e-12)) / (1 - usual))
        return F.when(rate > usual, F.exp(-(size - 1) * divergence)).otherwise(F.lit(1.0))

    def serial(rate: Column, chance: Column) -> Column:
        """Lag-1 agreement of classes beyond chance; a token of one class agrees fully. A token counts for as many symbols
        as its classes are mixed: one digit in a long word says nothing of the order of classes."""
        mixed = F.greatest(F.least(2 * (1 - chance), F.lit(1.0)) * size - 3, F.lit(0.0))
        r = F.when(chance > 0.999, F.lit(0.999)).otherwise(F.greatest(F.least((1 - rate - chance) / (1 - chance), F.lit(0.999)), F.lit(-0.999)))
        expected = F.lit(COMPOSED_CORRELATION)
        return let(r, lambda v: _upper_tail((0.5 * F.log((1 + expected) / (1 - expected)) - 0.5 * F.log((1 + v) / (1 - v))) * F.sqrt(mixed)))

    def on_classes(cl: Column) -> Column:
        share = [F.pow((size - F.char_length(F.replace(cl, F.lit(c), F.lit("")))) / size, F.lit(2.0)) for c in "aA0"]
        rate = F.greatest(F.regexp_count(cl, F.lit("a+|A+|0+")) - 1, F.lit(0)) / (size - 1)
        return let(rate, lambda v: let(share[0] + share[1] + share[2], lambda chance: F.least(let(composed, lambda usual: runs(v, usual)), serial(v, chance))))

    best = let(F.least(chi_p, let(classes, on_classes)), lambda p: -F.log10(F.greatest(F.least(3 * p, F.lit(1.0)), F.lit(1e-60))))
    return best


def _stratum(token: Column) -> Column:
    """The band of lengths and the inferred encoding as one number."""
    band = F.lit(len(BANDS))
    for i, limit in reversed(list(enumerate(BANDS))):
        band = F.when(F.char_length(token) < limit, F.lit(i)).otherwise(band)
    return band * 100 + alphabet_size(token)


def thresholds(candidates: DataFrame, fdr: float = FDR) -> DataFrame:
    """stratum, least_bin: candidates of a stratum are findings from this bin on (step-up control over all of them)."""
    counts = candidates.groupBy("stratum", "bin").count()
    total = F.expr("sum(count) over (partition by stratum)")
    rank = F.expr("sum(count) over (partition by stratum order by bin desc)")
    ranked = counts.select("stratum", "bin", total.alias("m"), rank.alias("r"))
    passing = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") * BIN) <= fdr * F.col("r") / F.col("m"))
    return passing.groupBy("stratum").agg(F.min("bin").alias("least_bin"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans: arrays of struct<start, rank, stop> sorted by start, then kind; and `kept`, a struct of the
    columns named in `keep`.

    `spans` holds base findings and those of the battery, which never overlap a base finding. Findings, with
    what is kept, are checkpointed for the corpus-wide control, so texts are scanned once.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), kept.alias("kept"))
    df = _matches(base_spans(df), "seen", CANDIDATE, CANDIDATE, 3)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    df = df.withColumn("base", base)
    tried = F.zip_with("seen", "_seen_m", lambda s, m: F.struct(s.alias("span"), m.alias("token")))
    free = let(F.col("base"), lambda base: F.filter(tried, lambda c: ~F.exists(base, lambda b: (b["start"] < c["span"]["stop"]) & (c["span"]["start"] < b["stop"]))))
    df = df.withColumn("_free", F.when(F.size("seen") > 0, free))
    scored = F.transform("_free", lambda c: F.struct(c["span"].alias("span"), _stratum(c["token"]).alias("stratum"), F.least(F.floor(battery(c["token"]) / BIN), F.lit(MAX_BIN)).cast("int").alias("bin")))
    df = df.withColumn("_scored", F.when(F.size("_free") > 0, scored))
    df = df.select("doc_id", "base", "_scored", *(["kept"] if keep else [])).checkpoint()
    levels = thresholds(df.select(F.explode("_scored").alias("c")).select("c.stratum", "c.bin"), fdr)
    table = levels.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least_bin"))).alias("levels"))
    df = df.withColumn("_levels", table.scalar())
    added = F.transform(F.filter("_scored", lambda c: c["bin"] >= F.coalesce(F.try_element_at(F.col("_levels"), c["stratum"]), F.lit(MAX_BIN + 1))), lambda c: c["span"])
    spans = F.array_sort(F.concat("base", F.coalesce(added, F.array().cast(f"array<{SPAN}>"))))
    return df.select("doc_id", "base", spans.alias("spans"), *(["kept"] if keep else []))


def spans_text(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The registered form of the result: counts, digest of the base spans and all spans of each row."""
    found = scan(docs)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the same columns and rows; every span of a secret is replaced by `mark` (touching or nested spans by one)."""
    names = docs.columns
    found = scan(docs, id_col, text_col, keep=tuple(names))
    t = F.coalesce(F.col("kept")[text_col], F.lit(""))
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["stop"] <= acc["at"], acc).otherwise(
            F.struct(
                s["stop"].alias("at"),
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(t, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(t, acc["at"].cast("int") + 1, F.lit(2147483647))),
    )
    clean = F.when(F.size("spans") > 0, step).otherwise(F.col("kept")[text_col])
    return found.select(*[clean.alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in names])
