"""Ranking of profiles against requests: every request at once, one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank.functions.dates import recency_score
from sieverank.functions.text import round_half_up
from sieverank.operators.intervals import latest_end, union_years, years_score
from sieverank.operators.matching import MUST_WEIGHT, infer, match_pairs
from sieverank.operators.relevance import bm25_skills
from sieverank.session import ensure_checkpoint_dir

WEIGHTS = {"skills": 0.4, "experience": 0.25, "keywords": 0.2, "education": 0.15}


def weighted_final(skills: Column, experience: Column, keywords: Column, education: Column, has_keywords: Column, bonus: Column, knocked_out: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum plus bonus, at most 100, one decimal, 0 for knocked-out rows. Without keywords the other weights
    are scaled to a sum of one."""
    w = weights or WEIGHTS
    rest = w["skills"] + w["experience"] + w["education"]
    full = skills * w["skills"] + experience * w["experience"] + keywords * w["keywords"] + education * w["education"]
    part = skills * (w["skills"] / rest) + experience * (w["experience"] / rest) + education * (w["education"] / rest)
    return F.when(knocked_out, 0.0).otherwise(round_half_up(F.least(F.when(has_keywords, full).otherwise(part) + bonus, F.lit(100.0)), 1))


def anomalies(total_years: Column, max_years: Column, gap_days: Column, quality: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(total_years == 0, F.lit("FRESHER")),
            F.when((max_years < 99) & (total_years > max_years * 1.5), F.lit("OVERQUALIFIED")),
            F.when(gap_days.isNotNull(), F.concat(F.lit("GAP: "), F.floor(gap_days / 30).cast("string"), F.lit(" months"))),
            F.when(quality < 0.5, F.lit("LOW_QUALITY")),
        )
    )


def knockout_reasons(missing: Column, total_years: Column, entries: Column, min_years: Column, max_years: Column, level: Column, required: Column, stated_years: Column) -> Column:
    few = (total_years < min_years) & (entries < 2) & (F.coalesce(stated_years, F.lit(0)) < min_years) & (total_years < min_years * 0.5)
    return F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
            F.when(few, F.lit("too few years")),
            F.when((max_years < 99) & (total_years > max_years), F.lit("too many years")),
            F.when((required > 0) & (level < required), F.lit("degree")),
        )
    )


def skill_scores(have: DataFrame, wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """jd_id, id, skill_score (BM25), matched_must, missing_must (arrays in the order of the request).

    wanted(jd_id, jd_pos, jd_skill, must). Ids with no match at all have no row: the caller fills in.
    """
    ensure_checkpoint_dir(have.sparkSession)
    have = have.checkpoint()  # read by idf, lengths and the graph joins
    pairs = match_pairs(have, wanted).checkpoint()
    bm25 = bm25_skills(have, pairs, wanted)
    found = infer(have, wanted, edges, pairs).filter(F.col("weight") >= MUST_WEIGHT).join(wanted.filter("must").select("jd_id", "jd_skill"), ["jd_id", "jd_skill"])
    met = found.groupBy("jd_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("jd_pos", "jd_skill"))), lambda x: x["jd_skill"]).alias("matched_must"))
    return bm25.join(met, ["jd_id", "id"], "full").select("jd_id", "id", F.coalesce("raw", F.lit(0.0)).alias("skill_score"), F.coalesce("matched_must", F.array().cast("array<string>")).alias("matched_must"))


def score(jds: DataFrame, people: DataFrame, have: DataFrame, wanted: DataFrame, spans: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """All scores of every (request, person), without ranks.

    jds(jd_id, min_years, max_years, required_level, keywords); people(id, level, text); have(id, pos, skill);
    wanted(jd_id, jd_pos, jd_skill, must); spans(id, start, end). Requests are a small stated set: they travel as one
    array, so persons are never joined to them by a shuffle.
    """
    must = wanted.filter("must").groupBy("jd_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("jd_pos", "jd_skill"))), lambda x: x["jd_skill"]).alias("must"))
    asked = jds.join(must, "jd_id", "left").agg(F.collect_list(F.struct("*")).alias("jds")).scalar()
    facts = people.join(union_years(spans), "id", "left").join(latest_end(spans), "id", "left").join(spans.groupBy("id").agg(F.count("*").alias("entries")), "id", "left")
    rows = facts.withColumn("jds", asked).select("*", F.explode("jds").alias("jd")).select("id", "level", "text", F.coalesce("total_years", F.lit(0.0)).alias("total_years"), "latest_end", F.coalesce("entries", F.lit(0)).alias("entries"), "jd.*")
    rows = rows.join(skill_scores(have, wanted, edges), ["jd_id", "id"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"skill_score": F.coalesce("skill_score", F.lit(0.0)), "missing_must": F.array_except(F.coalesce("must", none), F.coalesce("matched_must", none))})
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.size(F.filter("keywords", lambda k: F.contains(low, F.lower(k))))
    has = F.size("keywords") > 0
    rows = rows.withColumn("keyword_score", F.when(has, hits / F.size("keywords") * 100).otherwise(0.0))
    recent = recency_score(F.col("latest_end"), F.col("entries") > 0, as_of)
    rows = rows.withColumn("experience_score", years_score(F.col("total_years"), F.col("min_years"), F.col("max_years")) * (0.4 / 0.6) + recent * (0.2 / 0.6))
    required = F.col("required_level")
    education = F.when(required <= 0, 100.0).when(F.col("level") >= required, 100.0).when(F.col("level") == required - 1, 60.0).when(F.col("level") > 0, 30.0).otherwise(0.0)
    rows = rows.withColumn("education_score", education)
    reasons = knockout_reasons(F.col("missing_must"), F.col("total_years"), F.col("entries"), F.col("min_years"), F.col("max_years"), F.col("level"), required, F.lit(None).cast("int"))
    rows = rows.withColumn("reasons", reasons).withColumn("knocked_out", F.size("reasons") > 0)
    final = weighted_final(F.col("skill_score"), F.col("experience_score"), F.col("keyword_score"), F.col("education_score"), has, F.lit(0.0), F.col("knocked_out"))
    return rows.withColumn("final_score", final)


def rank(jds: DataFrame, people: DataFrame, have: DataFrame, wanted: DataFrame, spans: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """score() with ranks."""
    from sieverank.plans.scoring import ranked

    return ranked(score(jds, people, have, wanted, spans, edges, as_of))
