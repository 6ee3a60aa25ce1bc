"""Date intervals of an id: union length, gaps, latest end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.text import round_half_up


def union_years(spans: DataFrame, id_col: str = "id") -> DataFrame:
    """id, total_years: length of the union of an id's [start, end] in years, one decimal.

    Spans that overlap or touch are one island; a running maximum of ends finds where a new island begins. Rows without
    a start or end, or that end before they start, add nothing.
    """
    rows = spans.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") >= F.col("start")))
    order = Window.partitionBy(id_col).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = islands.groupBy(id_col, "island").agg(F.datediff(F.max("end"), F.min("start")).alias("days"))
    return length.groupBy(id_col).agg(round_half_up(F.sum("days") / F.lit(365.25), 1).alias("total_years"))


def first_gap(spans: DataFrame, days: int = 180, id_col: str = "id") -> DataFrame:
    """id, gap_start, gap_days, gap_months: the first gap of more than `days` between a span's end and the next start."""
    order = Window.partitionBy(id_col).orderBy("start", "end")
    rows = spans.filter("start is not null and end is not null").withColumn("next", F.lead("start").over(order))
    gaps = rows.withColumn("gap_days", F.datediff("next", "end")).filter(F.col("gap_days") > days)
    best = gaps.groupBy(id_col).agg(F.min_by(F.struct("end", "gap_days"), F.struct("start", "end")).alias("g"))
    return best.select(id_col, F.col("g.end").alias("gap_start"), F.col("g.gap_days").alias("gap_days"), F.floor(F.col("g.gap_days") / 30).alias("gap_months"))


def latest_end(spans: DataFrame, id_col: str = "id") -> DataFrame:
    return spans.groupBy(id_col).agg(F.max("end").alias("latest_end"))


def years_score(total: Column, least: Column, most: Column) -> Column:
    """100 in range or without a range, in proportion up to 80 below, 80 above."""
    return F.when((least == 0) & (most >= 99), 100.0).when((total >= least) & (total <= most), 100.0).when(total < least, F.when(least > 0, total / least * 80.0).otherwise(80.0)).otherwise(80.0)
