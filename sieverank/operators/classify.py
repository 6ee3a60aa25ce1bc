"""Weighted keyword votes, penalties between domains, pre-filter, degree levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.text import round_half_up
from sieverank.registries import DEFAULT_PENALTY, DEGREES


def keyword_votes(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """id, domain, domain_ord, votes: the sum over a text's keywords (contained, whatever the case) of weight * factor.

    texts(id, text, factor); keywords(domain, domain_ord, keyword, weight) is a small table, sent as one array, so that
    each text is read once and nothing is joined.
    """
    table = keywords.agg(F.sort_array(F.collect_list(F.struct("domain_ord", "domain", "keyword", "weight"))).alias("k")).scalar()
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = texts.select("id", "factor", low.alias("low")).withColumn("k", table).select("id", "factor", F.explode(F.filter("k", lambda k: F.contains(F.col("low"), k["keyword"]))).alias("k"))
    return hits.groupBy("id", F.col("k.domain").alias("domain"), F.col("k.domain_ord").alias("domain_ord")).agg(F.sum(F.col("k.weight") * F.col("factor")).alias("votes"))


def vote(votes: DataFrame, default: str = "unknown") -> DataFrame:
    """id, domain, confidence: the domain with most votes (ties: the first in order) and its share, three decimals."""
    by = Window.partitionBy("id")
    best = votes.withColumn("total", F.sum("votes").over(by)).withColumn("n", F.row_number().over(by.orderBy(F.col("votes").desc(), "domain_ord")))
    return best.filter("n = 1").select("id", F.coalesce("domain", F.lit(default)).alias("domain"), round_half_up(F.col("votes") / F.col("total"), 3).alias("confidence"))


def pattern_votes(texts: DataFrame, signals: list[tuple[str, str, float]], most: int = 3, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, kind, confidence: each (kind, pattern, weight) counts up to `most` occurrences; the best kind and its share."""
    kinds = list(dict.fromkeys(k for k, _, _ in signals))
    scores = [sum((F.least(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(p)), F.lit(most)) * w for k, p, w in signals if k == kind), F.lit(0.0)) for kind in kinds]
    rows = texts.select(F.col(id_col).alias("id"), F.array(*scores).alias("s")).withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x))
    best = F.array_max("s")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.array_position("s", best).cast("int"))
    return rows.select("id", F.when(F.col("total") > 0, kind).otherwise("unknown").alias("kind"), F.when(F.col("total") > 0, round_half_up(best / F.col("total"), 3)).otherwise(0.0).alias("confidence"))


def with_penalty(pairs: DataFrame, penalties: DataFrame, least: float = 0.4, default: int = DEFAULT_PENALTY) -> DataFrame:
    """pairs(jd_domain, jd_conf, cand_domain, cand_conf) with `penalty`: 0 for one domain, unknown or unsure ones."""
    known = pairs.join(penalties, ["jd_domain", "cand_domain"], "left")
    free = (F.col("jd_domain") == F.col("cand_domain")) | (F.col("jd_domain") == "unknown") | (F.col("cand_domain") == "unknown") | (F.col("jd_conf") < least) | (F.col("cand_conf") < least)
    return known.withColumn("penalty", F.when(free, 0).otherwise(F.coalesce("penalty", F.lit(default))))


def prefilter(pairs: DataFrame, penalties: DataFrame, least: float = 0.35, limit: int = -60) -> DataFrame:
    """pairs without those whose domains are sure, different and at least -limit percent apart."""
    return with_penalty(pairs, penalties, least).filter(F.col("penalty") > limit)


def degree_level(x: Column) -> Column:
    """Level of the first key that the text contains; 0 without one."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(level)) for k, level in DEGREES], F.lit(0))


def degree_score(best: Column, required: Column) -> Column:
    return F.when(required <= 0, 100.0).when(best >= required, 100.0).when(best == required - 1, 60.0).when(best > 0, 30.0).otherwise(0.0)
