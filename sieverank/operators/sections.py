"""Sections of ordered lines: header lookup, forward fill, continuation, neighbours, merging of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def header_key(line: Column) -> Column:
    """Lower case without leading numbers and signs, a colon at the end and repeated blanks."""
    x = F.regexp_replace(F.lower(F.coalesce(line, F.lit(""))), r"^[^a-z]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[:\-\s]+$", ""), r"\s+", " "))


def resolve_headers(lines: DataFrame, headers: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with `section`: set where the line is a header (at most six words, no year)."""
    keyed = lines.withColumn("header", header_key(F.col(line_col)))
    found = keyed.join(headers, "header", "left")
    ok = (F.size(F.split("header", " ")) <= 6) & ~F.col(line_col).rlike(r"\d{4}")
    return found.withColumn("section", F.when(ok, F.col("section"))).drop("header")


def assign(lines: DataFrame, keys: list[str], order: str, marker: str, out: str) -> DataFrame:
    """lines with `out`: the last marker at or before the line (as-of assignment), null before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(out, F.last(F.col(marker), ignorenulls=True).over(w))


def merge_continuations(lines: DataFrame, keys: list[str], order: str, starts: Column, text: str) -> DataFrame:
    """One row for each entry: a line that starts one and the lines that follow it, joined by blanks in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("entry", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(*keys, "entry").agg(F.array_join(parts, " ").alias(text))


def with_neighbours(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return lines.withColumn("next_line", F.lead(text).over(w)).withColumn("previous_line", F.lag(text).over(w))


def merge_sources(sections: DataFrame) -> DataFrame:
    """id, section, text: of a section's sources the first by priority with text; of one priority the longest."""
    w = Window.partitionBy("id", "section").orderBy("priority", F.length("text").desc(), "text")
    return sections.filter("trim(text) <> ''").withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "section", "text")
