"""Ranking of whole records against requests: pre-filter, skill inference, knockouts, scores, bonuses, penalties, ranks.

A record is scored in its own row; requests travel as one array. The only shuffles are the counts behind the inverse
document frequencies (one row for each request and skill), the best score of each request, and the order of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.dates import recency_score
from sieverank.functions.text import round_half_up, text_of, years_stated
from sieverank.operators import bonus
from sieverank.operators import scoring as S
from sieverank.operators.classify import degree_level, degree_score
from sieverank.operators.intervals import years_score
from sieverank.operators.relevance import idf
from sieverank.plans.ranking import anomalies, weighted_final
from sieverank.session import ROWS_A_TASK, ensure_checkpoint_dir, parts_for

JD = """jd_id int, title string, department string, description string, must array<string>, nice array<string>, min_years int,
 max_years int, required_degree string, preferred_field string, keywords array<string>, weights map<string,double>"""


def extracted_only(documents: DataFrame) -> DataFrame:
    """Documents whose record is there; others are not scored."""
    return documents.filter(F.col("status") == "EXTRACTED")


def most_overlap(pairs: DataFrame, overlap: str, most: int = 500) -> DataFrame:
    """Of each request the `most` records that share most with it (a report's limit); ties by id."""
    order = Window.partitionBy("jd_id").orderBy(F.col(overlap).desc(), "id")
    return pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def prepare_requests(jds: DataFrame) -> DataFrame:
    """JD with what every record needs of a request: prepared skills, domain and branch, words for certificates."""
    must, nice = S.strings(F.col("must")), S.strings(F.col("nice"))
    asked, keywords = S.prepared(F.concat(must, nice)), S.strings(F.col("keywords"))
    about = F.concat_ws(" ", "title", "department", "description")
    return jds.select(
        *[c for c in jds.columns if c not in ("must", "nice", "keywords")],
        must.alias("must"), nice.alias("nice"), keywords.alias("keywords"), S.with_variants(asked).alias("asked"),
        S.with_variants(S.prepared(must)).alias("asked_must"), S.with_variants(S.prepared(keywords)).alias("asked_keywords"),
        S.request_domain(F.col("title"), F.col("department"), F.col("description"), asked).alias("jd_domain"),
        S.request_subdomain(F.col("title"), F.col("department")).alias("jd_sub"),
        bonus.relevant_words(about, F.concat(must, nice), keywords).alias("relevant"),
    )


def prepare_records(people: DataFrame, as_of: Column) -> DataFrame:
    """One row a record with all that does not depend on a request."""
    p = {c: F.col(c) for c in people.columns}
    own = S.prepared(p["skills"])
    rows = people.withColumns({"own": own, "dated": S.spans(p["experience"], as_of), "skill_text": S.skill_text(p), "sub_domain": S.profile_subdomain(p)})
    full = F.lower(text_of(F.try_element_at(p["raw_text_sections"], F.lit("full_text"))))
    rows = rows.withColumns({"domain": S.profile_domain(p, F.col("own")), "full_text": full, "total_years": S.total_years(F.col("dated")), "degree": S.best_degree(p["education"])})
    said = F.concat_ws(" ", "full_text", F.lower(F.array_join(S.strings(p["skills"]), " ")), F.lower(text_of(p["summary"])))
    return rows.withColumn("all_text", said)


def paired(jds: DataFrame, people: DataFrame, as_of: Column, apart: bool = False) -> DataFrame:
    """Every (request, record) that the pre-filter leaves, or with `apart` those that it drops: domains that are sure and
    too far apart. Requests are sorted out in their array, before a record is repeated for them."""
    asked = prepare_requests(jds).agg(F.collect_list(F.struct("*")).alias("j")).scalar()
    far = lambda jd: S.far_apart(jd["jd_domain"], F.col("domain"))
    rows = prepare_records(people, as_of).withColumn("j", asked)
    return rows.select("*", F.explode(F.filter("j", lambda jd: far(jd) if apart else ~far(jd))).alias("jd")).drop("j")


def skill_statistics(pairs: DataFrame) -> DataFrame:
    """jd_id, idf (map of skill to weight), average (length of skill lists) over the records that are scored."""
    hit = F.filter("jd.asked", lambda a: F.exists("own", lambda s: S.same_skill(s, a)))
    rows = pairs.select(F.col("jd.jd_id").alias("jd_id"), F.size("own").alias("n"), F.array_distinct(F.transform(hit, lambda a: a["s"])).alias("hit"), F.array_distinct(F.transform("jd.asked", lambda a: a["s"])).alias("every"))
    # One pass: each record of a request counts once for each skill, and for none (null) where the request asks for none.
    counted = rows.select("jd_id", "n", "hit", F.explode_outer("every").alias("skill")).groupBy("jd_id", "skill").agg(F.count_if(F.array_contains("hit", F.col("skill"))).alias("df"), F.count("*").alias("records"), F.avg("n").alias("average"))
    weighed = F.collect_list(F.when(F.col("skill").isNotNull(), F.struct("skill", idf(F.col("records"), F.col("df")))))
    return counted.groupBy("jd_id").agg(F.first("average").alias("average"), F.map_from_entries(weighed).alias("idf"))


def ranked(scores: DataFrame, per: str = "jd_id") -> DataFrame:
    """`rank` (knocked-out rows last, then by score, then by id) and `percentile` (percent of the request's best score).

    Rows are dealt out by ranges of that order; a row's rank is its place in its range after the rows of the ranges
    before, so no request is sorted in one task. There are as many ranges as the rows ask for, and best scores travel as
    one map: a join by request would bring all rows of a request together.
    """
    ensure_checkpoint_dir(scores.sparkSession)
    scores = scores.filter(F.col(per).isNotNull()).checkpoint()  # read for the best scores, the bounds of the ranges and their rows
    n = parts_for(scores, ROWS_A_TASK // 4)
    best = scores.groupBy(per).agg(F.max(F.when(~F.col("knocked_out"), F.col("final_score"))).alias("_best"))
    table = best.agg(F.map_from_entries(F.collect_list(F.struct(per, "_best")))).scalar()
    order = [F.col("knocked_out"), F.col("final_score").desc(), F.col("id")]
    dealt = scores.repartitionByRange(n, F.col(per), *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy(per, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(per).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.select(per, "_range", before.alias("_before")).repartition(n, per, "_range")
    placed = dealt.repartition(n, per, "_range").join(ranges, [per, "_range"]).withColumn("_best", F.try_element_at(table, F.col(per)))
    within = F.row_number().over(Window.partitionBy(per, "_range").orderBy(*order))
    share = F.when(~F.col("knocked_out") & (F.col("_best") > 0), round_half_up(F.col("final_score") / F.col("_best") * 100, 1)).otherwise(0.0)
    return placed.withColumn("rank", (F.col("_before") + within).cast("int")).withColumn("percentile", share).drop("_range", "_before", "_best")


def score(jds: DataFrame, people: DataFrame, as_of: Column) -> DataFrame:
    """All scores of every (request, record) that the pre-filter leaves; knocked-out records keep their partial scores."""
    rows = paired(jds, people, as_of)
    # Statistics travel as one map: joined by request, all records of a request would meet in one task.
    stats = skill_statistics(rows).agg(F.map_from_entries(F.collect_list(F.struct("jd_id", F.struct("average", "idf"))))).scalar()
    rows = rows.select("*", "jd.*").drop("jd").withColumn("stats", F.try_element_at(stats, F.col("jd_id"))).select("*", "stats.*").drop("stats")
    rows = rows.withColumn("wider", S.augmented(F.col("own"), F.col("asked"), F.col("skill_text")))
    rows = rows.withColumn("skill_matches", S.skill_results(F.col("wider"), F.col("asked")))
    weight = lambda s: S.weight_of(F.col("skill_matches"), s)
    every = F.concat("must", "nice")
    raw_skill = S.bm25(F.col("skill_matches"), F.col("asked"), F.coalesce("idf", F.create_map().cast("map<string,double>")), F.size("wider"), F.col("average"))
    penalty = S.domain_penalty(F.col("jd_domain"), F.col("domain"), F.col("jd_sub"), F.when(F.col("domain.domain") == "engineering", F.col("sub_domain")).otherwise(F.col("domain.domain")))
    unmatched = F.filter("asked_must", lambda a: ~F.exists("own", lambda s: S.same_skill(s, a)))
    unmet = F.filter(unmatched, lambda a: (weight(a["s"]) < 0.75) & ~((F.length(F.trim(a["s"])) >= 4) & S.named_in(F.col("skill_text"), a["v"])))
    rows = rows.withColumns(
        {
            "domain_penalty": penalty,
            "raw_skill": raw_skill,
            "unmet": F.transform(unmet, lambda a: a["s"]),
            "matched_must": F.filter("must", lambda s: weight(s) >= 0.75),
            "missing_must": F.filter("must", lambda s: weight(s) < 0.75),
            "matched_nice": F.filter("nice", lambda s: weight(s) > 0),
            "matched_inferred": F.transform(F.filter("skill_matches", lambda m: m["match_type"] == "inferred"), lambda m: m["skill"]),
            "matched_related": F.transform(F.filter("skill_matches", lambda m: m["match_type"] == "related"), lambda m: m["skill"]),
            "extra_skills": F.transform(F.filter("own", lambda s: ~F.exists("asked", lambda a: (F.lower(a["s"]) == F.lower(s["s"])) | S.same_skill(s, a))), lambda s: s["s"]),
            "title": S.best_title(F.col("experience"), F.col("title")),
            "matched_keywords": S.matched_keywords(F.col("all_text"), F.col("own"), F.col("asked_keywords")),
            "project_bonus": bonus.project_bonus(F.col("projects"), every, F.col("asked")),
            "prestige_bonus": bonus.prestige_bonus(F.transform("experience", lambda e: e["company"])),
            "cert_bonus": bonus.cert_bonus(F.col("certifications"), F.col("relevant"), F.col("full_text")),
        }
    )
    last = F.array_max(F.transform("dated", lambda s: s["end"]))
    rows = rows.withColumn("required", degree_level(F.col("required_degree")))
    required = F.col("required")
    rows = rows.withColumn("level", F.greatest(F.col("degree.level"), S.stated_level(F.col("full_text"), required)))
    rows = rows.withColumn("stated", years_stated(F.col("full_text")))
    entries = F.size("experience")
    years = years_score(F.col("total_years"), F.col("min_years"), F.col("max_years"))
    recent = recency_score(last, entries > 0, as_of)
    has = F.size("keywords") > 0
    jd = {c: F.col(c) for c in ("min_years", "max_years", "required_degree", "required")}
    rows = rows.withColumns(
        {
            "skill_score": F.greatest(F.col("raw_skill") * (1 + F.col("domain_penalty") / 100.0), F.lit(0.0)),
            "experience_score": S.title_score(F.col("title.sim")) * 0.4 + years * 0.4 + recent * 0.2,
            "keyword_score": F.when(has, F.size("matched_keywords") / F.when(has, F.size("keywords")) * 100.0).otherwise(0.0),
            "education_score": degree_score(F.col("degree.level"), required) * 0.6 + S.field_score(F.col("education"), F.col("preferred_field"), F.col("full_text")) * 0.4,
            "missing_keywords": F.array_except("keywords", "matched_keywords"),
            "reasons": S.knockout(F.col("unmet"), F.col("total_years"), entries, F.col("stated"), F.col("level"), jd),
            "anomalies": anomalies(F.col("total_years"), F.col("max_years"), S.first_gap(F.col("dated")), F.col("extraction_quality")),
        }
    )
    rows = rows.withColumn("knocked_out", F.size("reasons") > 0)
    total = F.col("project_bonus") + F.col("prestige_bonus") + F.col("cert_bonus")
    parts = [F.coalesce(F.try_element_at("weights", F.lit(k)), F.lit(v)) for k, v in (("skills", 0.4), ("experience", 0.25), ("keywords", 0.2), ("education", 0.15))]
    final = weighted_final(F.col("skill_score"), F.col("experience_score"), F.col("keyword_score"), F.col("education_score"), has, total, F.col("knocked_out"), dict(zip(("skills", "experience", "keywords", "education"), parts, strict=True)))
    return rows.withColumn("final_score", final).select(
        "jd_id", "id", "knocked_out", "reasons", "final_score", "skill_score", "experience_score", "keyword_score", "education_score", "project_bonus",
        "prestige_bonus", "cert_bonus", "domain_penalty", F.col("domain.domain").alias("domain"), F.col("domain.confidence").alias("domain_confidence"), "sub_domain",
        "total_years", F.col("title.role").alias("best_title"), F.col("degree.degree").alias("best_degree"), "matched_must", "missing_must", "matched_nice",
        "extra_skills", "matched_inferred", "matched_related", "skill_matches", "matched_keywords", "missing_keywords", "anomalies",
    )


def rank_records(jds: DataFrame, people: DataFrame, as_of: Column) -> DataFrame:
    """score() with ranks; jds as in JD, people as records with id."""
    return ranked(score(jds, people, as_of))


def prefiltered(jds: DataFrame, people: DataFrame, as_of: Column) -> DataFrame:
    """jd_id, id, domain of the records that the pre-filter drops."""
    return paired(jds, people, as_of, apart=True).select("jd.jd_id", "id", F.col("domain.domain").alias("domain"))
