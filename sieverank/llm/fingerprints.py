"""Document fingerprints from closed syncmers, with built-in functions only.

A text is a sequence of units: words, or single code points where it has fewer than SHORT words. Of each run of units
(a k-mer) the hashes of its WIDTH inner runs (s-mers) are compared; the k-mer is an anchor if the least of them is the
first or the last. That looks at nothing outside the k-mer, so equal passages have equal anchors wherever they stand,
and between two anchors lie at most WIDTH - 2 k-mers. k is five words (eight code points), s two (five).

The fingerprint is a bottom sketch: the SKETCH least distinct anchor hashes (32 bits each) as hexadecimal digits. The
likeness of two fingerprints estimates the share of anchors that both texts have among those that either has: of the
SKETCH least hashes of their union, the share that is in both. Two empty texts have likeness 1.

Two texts are compared in one kind of unit: where either is short, both are read as code points. A text without a closed
syncmer has its least k-mer as anchor.

Defined results: null texts count as empty and have an empty fingerprint; texts with fewer units than a k-mer have one
anchor, the hash of the whole text; rows with the same id and text count once; rows with one id and different texts
are documents of their own, in the order of their text's hash; a missing id counts as the smallest number. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.llm.columns import let
from sieverank.session import ensure_checkpoint_dir

WIDTH, SHORT, SKETCH = 4, 32, 64
WORD_S, CHAR_S = 2, 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def is_short(text: Column) -> Column:
    return F.size(_words(text)) < SHORT


def _units(text: Column, chars: Column) -> Column:
    return F.when(chars, F.filter(F.split(text, ""), lambda c: c != "")).otherwise(_words(text))


def _inner(units: Column, is_words: Column) -> Column:
    """Hashes of all s-mers."""

    def run(i: Column, s: int) -> Column:
        return F.xxhash64(*[F.get(units, i + j) for j in range(s)])

    def every(s: int) -> Column:
        return F.when(F.size(units) < s, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(units) - s), lambda i: run(i, s)))

    return F.when(is_words, every(WORD_S)).otherwise(every(CHAR_S))


def syncmers(text: Column, chars: Column | None = None) -> Column:
    """Closed syncmers of a text column: array<struct<at, anchor>>; `at` is the first unit of the k-mer. `chars` tells
    whether code points are the units, which short texts have by themselves."""
    chars = is_short(text) if chars is None else chars

    def chosen(g: Column) -> Column:
        def closed(i: Column) -> Column:
            a, b, c, d = (F.get(g, i + j) for j in range(WIDTH))
            return ((a <= b) & (a <= c) & (a <= d)) | ((d <= a) & (d <= b) & (d <= c))

        def anchor(i: Column) -> Column:
            return F.xxhash64(*[F.get(g, i + j) for j in range(WIDTH)])

        every = F.sequence(F.lit(0), F.size(g) - WIDTH)
        least = F.array_min(F.transform(every, lambda i: F.struct(anchor(i).alias("anchor"), i.alias("at"))))
        found = F.transform(F.filter(every, closed), lambda i: F.struct(i.alias("at"), anchor(i).alias("anchor")))
        found = let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.struct(least["at"].alias("at"), least["anchor"].alias("anchor")))))
        whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(text).alias("anchor")))
        return F.when(F.size(g) >= WIDTH, found).otherwise(whole)

    found = let(_units(text, chars), lambda u: let(_inner(u, ~chars), chosen))
    return F.when(F.char_length(text) == 0, F.array().cast("array<struct<at:int,anchor:long>>")).otherwise(found)


def sketch(text: Column, chars: Column | None = None) -> Column:
    """The SKETCH least anchor hashes, as integers of 32 bits in order."""
    hashes = F.transform(syncmers(text, chars), lambda a: a["anchor"].bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, SKETCH)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union).cast("double"))


def as_text(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, at, anchor: one row for each anchor of each row, for positional matching."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(syncmers(F.coalesce(F.col(text_col), F.lit("")))).alias("a"))
    return found.select("doc_id", F.col("a.at").alias("at"), F.col("a.anchor").alias("anchor"))


#: The place of a missing id in the order of ids.
NO_ID = -(1 << 63)


def neighbours(keys: DataFrame) -> DataFrame:
    """id, h, n, short and prev: the same of the document before in the order of (id, h); the last before the first.

    Keys are dealt out by ranges. Each range looks back within itself, and the table of the ranges' last keys, which
    has a row for each partition, fills in what comes before their first.
    """
    ranged = keys.distinct().repartitionByRange("id", "h").withColumn("range", F.spark_partition_id()).checkpoint()
    entry = F.struct("id", "h", "n", "short")
    inside = ranged.withColumn("prev", F.lag(entry).over(Window.partitionBy("range").orderBy("id", "h")))
    last = ranged.groupBy("range").agg(F.max(entry).alias("last"))
    final = F.max("last").over(Window.partitionBy())
    before = last.select("range", F.coalesce(F.lag("last").over(Window.orderBy("range")), final).alias("before"))
    return inside.join(before, "range").select("id", "h", "n", "short", F.coalesce("prev", "before").alias("prev"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The registered form of the result: fingerprints of each document and of its edited text, whose last quarter is
    replaced by the beginning of the next document, and likenesses.

    Texts are shuffled once, by (id, h), and stay dealt out so; what travels to the document before is only the part
    of the text that it takes.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    key = ["id", "h"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    keys = neighbours(rows.select("id", "h", F.char_length("t").alias("n"), is_short(F.col("t")).alias("short")))
    texts = rows.join(keys, key).dropDuplicates(key)
    sent = texts.select(F.col("prev.id").alias("id"), F.col("prev.h").alias("h"), F.substring("t", F.lit(1), F.floor(F.col("prev.n") / 4).cast("int")).alias("tail"), F.col("short").alias("next_short"))
    edited = F.concat(F.substring("t", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int")), "tail")
    made = texts.join(sent, key).select("id", "h", "n", "short", "next_short", "prev", "t", edited.alias("e"))
    made = made.withColumn("e_short", is_short(F.col("e")))
    # Like is compared with like: where one text of a pair is short, both are read as code points.
    both = F.col("short") | F.col("e_short")
    own_chars = F.when(~F.col("short") & (both | F.col("next_short") | F.col("prev.short")), sketch(F.col("t"), F.lit(True)))
    other_chars = F.when(~F.col("e_short") & both, sketch(F.col("e"), F.lit(True)))
    made = made.select(
        "id", "h", "n", "short", "next_short", "e_short", "prev",
        sketch(F.col("t"), F.col("short")).alias("own"), sketch(F.col("e"), F.col("e_short")).alias("other"),
        own_chars.alias("own_chars"), other_chars.alias("other_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
    ).checkpoint()
    after = made.select(F.col("prev.id").alias("id"), F.col("prev.h").alias("h"), F.col("own").alias("next"), F.col("own_chars").alias("next_chars"))

    def compared(short: Column, other: str, other_chars: str) -> Column:
        as_chars = likeness(F.coalesce("own_chars", "own"), F.coalesce(F.col(other_chars), F.col(other)))
        return F.when(short, as_chars).otherwise(likeness(F.col("own"), F.col(other)))

    return made.join(after, key).select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        compared(F.col("short") | F.col("e_short"), "other", "other_chars").alias("near_edited"),
        compared(F.col("short") | F.col("next_short"), "next", "next_chars").alias("near_next"),
    )
