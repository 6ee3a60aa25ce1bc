"""Evaluation reports as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.text import round_half_up


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 (0 where nothing divides)."""
    p, a = predicted.cast("boolean"), actual.cast("boolean")
    c = rows.agg(*[F.count_if(x).alias(n) for n, x in (("tp", p & a), ("fp", p & ~a), ("fn", ~p & a), ("tn", ~p & ~a))])

    def share(x: Column, of: Column) -> Column:
        return round_half_up(F.when(of > 0, x / of).otherwise(0.0), 6)

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def field_rates(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, present, rate: how many rows have each field."""
    counted = rows.agg(F.count("*").alias("n"), *[F.count_if(c.isNotNull()).alias(name) for name, c in fields.items()])
    long = counted.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields])).alias("x"))
    return long.select("x.field", "x.present", round_half_up(F.when(F.col("n") > 0, F.col("x.present") / F.col("n") * 100).otherwise(0.0), 1).alias("rate"))


def scorecard(scores: DataFrame) -> DataFrame:
    """overall, verdict from (category, score, weight)."""
    total = scores.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("x"))
    verdict = F.when(F.col("x") >= 85, "ready").when(F.col("x") >= 70, "usable").otherwise("not ready")
    return total.select(round_half_up(F.col("x"), 1).alias("overall"), verdict.alias("verdict"))


# -- audit of rankings: who is ranked high by mistake, and who is missing
#: Domains far from engineering, and branches that are wrong for a kind of request.
FAR_DOMAINS = ("marketing", "accounting", "legal", "healthcare", "hr", "finance", "education", "hospitality", "admin", "sales")
OWN_BRANCHES = {"civil": ("civil", ""), "electrical": ("electrical", "embedded", ""), "mechanical": ("mechanical", "")}
SOFT_WRONG_BRANCHES = ("civil", "mechanical", "electrical")


def wrong_hits(ranked: DataFrame, jds: DataFrame, first: int = 10, least: float = 30.0) -> DataFrame:
    """jd_id, id, rank, tier for the rows among the `first` of each request that are there by mistake.

    ranked(jd_id, id, rank, score, domain, sub_domain); jds(jd_id, kind, related array<string>), kind: software, civil,
    electrical, mechanical, anything else for requests outside engineering. Rows of unknown or null domain, and scores up
    to `least`, are left out. The first rule that fits names the tier: related_domain, true_fp, same_domain.
    """
    rows = ranked.filter((F.col("rank") <= first) & (F.col("score") > least) & (F.col("domain") != "unknown")).join(jds.select("jd_id", "kind", "related"), "jd_id")
    domain, branch, kind = F.col("domain"), F.coalesce(F.col("sub_domain"), F.lit("")), F.coalesce(F.col("kind"), F.lit(""))
    related = F.coalesce(F.array_contains("related", domain), F.lit(False))
    far, inside = domain.isin(*FAR_DOMAINS), domain == "engineering"
    tier = F.when((kind == "civil") & ((domain == "construction") | related), "related_domain")
    tier = tier.when(kind.isin("software", *OWN_BRANCHES) & far, "true_fp")
    tier = tier.when((kind == "software") & inside & branch.isin(*SOFT_WRONG_BRANCHES), "same_domain")
    for name, own in OWN_BRANCHES.items():
        tier = tier.when((kind == name) & inside & ~branch.isin(*own), "same_domain")
    outside = ~kind.isin("software", *OWN_BRANCHES) & inside & (F.col("score") > 40)
    tier = tier.when(outside & related, "related_domain").when(outside, "true_fp")
    return rows.withColumn("tier", tier).filter("tier is not null").select("jd_id", "id", "rank", "tier")


def wrong_hit_rates(hits: DataFrame, jds: DataFrame, first: int = 10) -> DataFrame:
    """true_fp, related_domain, same_domain, true_fp_rate, all_fp_rate: counts, and percent of the slots of all requests."""
    tiers = ("true_fp", "related_domain", "same_domain")
    counts = hits.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in tiers])
    slots = jds.agg((F.count("*") * first).alias("slots"))
    both = counts.withColumn("slots", slots.scalar())
    rate = lambda n: F.when(F.col("slots") > 0, round_half_up(n / F.col("slots") * 100, 1)).otherwise(0.0)
    return both.select(*tiers, rate(F.col("true_fp")).alias("true_fp_rate"), rate(sum((F.col(t) for t in tiers[1:]), F.col("true_fp"))).alias("all_fp_rate"))


def missed_hits(ranked: DataFrame, people: DataFrame, jds: DataFrame, top: int = 20, least: int = 3, most: int = 20, in_all: int = 200) -> DataFrame:
    """jd_id, id, overlap, asked: persons of a request's domain that share `least` or more of its skills, yet are not among
    its first `top`; of each request the `most` with the smallest ids (a report's limit), no further requests once the
    ones before, by jd_id, have given `in_all`.

    people(id, domain, sub_domain, skills); jds(jd_id, department, skills). Skills are compared in lower case, each once;
    the pairs come from an equality join on skills, so persons without a common skill never meet a request. Ranked rows
    are taken off by an anti-join, and the limit keeps few rows a request before its shuffle.
    """
    low = lambda c: F.array_distinct(F.transform(F.filter(c, lambda s: s.isNotNull()), F.lower))
    asked = jds.select("jd_id", F.lower("department").alias("department"), low("skills").alias("wanted"))
    wanted = asked.select("jd_id", F.explode("wanted").alias("skill"))
    have = people.select("id", F.explode(low("skills")).alias("skill"))
    shared = have.join(wanted, "skill").groupBy("jd_id", "id").agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= least)
    facts = people.select("id", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("sub_domain", F.lit("")).alias("sub_domain"))
    rows = shared.join(facts, "id").join(asked.select("jd_id", "department", F.size("wanted").alias("asked")), "jd_id")
    software = (F.col("department") == "engineering") & F.startswith("sub_domain", F.lit("software"))
    fits = software | (F.col("domain") == F.col("department")) | (F.replace("department", F.lit(" "), F.lit("_")) == F.col("sub_domain"))
    missing = rows.filter(fits).join(ranked.filter(F.col("rank") <= top).select("jd_id", "id"), ["jd_id", "id"], "left_anti")
    few = missing.withColumn("_n", F.row_number().over(Window.partitionBy("jd_id").orderBy("id"))).filter(F.col("_n") <= most).drop("_n")
    # One row a request: a stated set, so one small window over all of it.
    sizes = few.groupBy("jd_id").agg(F.count("*").alias("n")).groupBy().agg(F.array_sort(F.collect_list(F.struct("jd_id", "n"))).alias("all")).scalar()
    before = F.aggregate(F.filter("_sizes", lambda s: s["jd_id"] < F.col("jd_id")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return few.withColumn("_sizes", sizes).filter(before < in_all).select("jd_id", "id", "overlap", "asked")
