"""Exact and fingerprint duplicates, repeated blocks, distinct names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.text import content_hash, text_of


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id: the smallest id with the same content. Hashes, not texts, are shuffled; minima are combined first."""
    rows = docs.select(F.col(id_col).alias("id"), content_hash(F.col(text_col)).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("id").alias("keep_id")), "h").select("id", "keep_id")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """content_hash, n for contents that occur more than once."""
    return docs.groupBy(content_hash(F.col(text_col)).alias("content_hash")).agg(F.count("*").alias("n")).filter("n > 1")


def profile_fingerprint(name, skills):
    """SHA-256 of the lower-case name and the sorted lower-case skills."""
    low = F.array_sort(F.array_distinct(F.transform(skills, lambda s: F.lower(s))))
    return F.sha2(F.concat(F.lower(text_of(name)), F.lit("|"), F.array_join(low, ",")).cast("binary"), 256)


def drop_repeated_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 10, least_chars: int = 50) -> DataFrame:
    """id, text: of blocks (between blank lines) that read the same and are longer than least_chars, the first stays.

    Within a row; texts with fewer than least_lines lines stay as they are.
    """
    blocks = F.split(text_of(F.col(text_col)), r"\n\s*\n")
    normal = F.transform(blocks, lambda b: F.lower(F.trim(F.regexp_replace(b, r"\s+", " "))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), blocks.alias("b"), normal.alias("n"))
    kept = F.filter(F.transform("b", lambda b, i: F.when((F.length(F.get("n", i)) <= least_chars) | (F.array_position("n", F.get("n", i)) == i + 1), b)), lambda b: b.isNotNull())
    return rows.select("id", F.when(F.size(F.split("text", "\n")) >= least_lines, F.array_join(kept, "\n\n")).otherwise(F.col("text")).alias("text"))


def distinct_ignoring_case(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first row of each spelling of `value` within the keys."""
    w = Window.partitionBy(*keys, F.lower(value)).orderBy(order, value)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
