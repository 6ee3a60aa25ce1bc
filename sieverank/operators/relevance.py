"""BM25 on terms of texts and on skill lists; term-frequency vectors and their cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.text import round_half_up, tokenize

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25_terms(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: BM25 of the request's terms in each text, in percent of a document with each term once; rank by score.

    One scan: term counts are array sizes in the same row, so nothing is exploded or shuffled but the corpus totals.
    """
    words = tokenize(F.col(text_col))
    counted = docs.select(F.col(id_col).alias("id"), words.alias("w")).select(
        "id", F.size("w").cast("double").alias("dl"), *[F.size(F.filter("w", _is(t))).cast("double").alias(f"tf{i}") for i, t in enumerate(terms)]
    )
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    rows = counted.withColumn("totals", totals.select(F.struct("*")).scalar()).select("*", "totals.*")
    norm = F.when(F.col("avgdl") > 0, 1 - B + B * F.col("dl") / F.col("avgdl")).otherwise(F.lit(1.0))
    score = best = F.lit(0.0)
    for i in range(len(terms)):
        weight, tf = idf(F.col("n"), F.col(f"df{i}")), F.col(f"tf{i}")
        score = score + weight * tf * (K1 + 1) / (tf + K1 * norm)
        best = best + weight
    return rows.select("id", F.when(best > 0, F.least(score / best * 100, F.lit(100.0))).otherwise(100.0).alias("raw")).select("id", round_half_up(F.col("raw"), 6).alias("score"))


def _is(term: str):
    return lambda w: w == F.lit(term)


def skill_idf(have: DataFrame, matches: DataFrame, wanted: DataFrame) -> DataFrame:
    """jd_id, jd_skill, df, idf: in how many lists a requested skill is matched, over all ids of `have`."""
    n = have.select(F.countDistinct("id").alias("n"))
    df = matches.groupBy("jd_id", "jd_skill").agg(F.countDistinct("id").alias("df"))
    out = wanted.select("jd_id", "jd_skill").distinct().join(df, ["jd_id", "jd_skill"], "left").withColumn("n", n.scalar())
    return out.select("jd_id", "jd_skill", F.coalesce("df", F.lit(0)).alias("df"), idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))


def bm25_skills(have: DataFrame, matches: DataFrame, wanted: DataFrame) -> DataFrame:
    """jd_id, id, raw (percent) for ids with a match: tf is the number of the id's skills that match a requested one."""
    weights = skill_idf(have, matches, wanted)
    best = weights.groupBy("jd_id").agg(F.sum("idf").alias("best"))
    lengths = have.groupBy("id").agg(F.count("*").cast("double").alias("dl"))
    avgdl = lengths.agg(F.avg("dl")).scalar()
    tf = matches.groupBy("jd_id", "id", "jd_skill").agg(F.count("*").cast("double").alias("tf"))
    scored = tf.join(weights, ["jd_id", "jd_skill"]).join(lengths, "id").withColumn("avgdl", avgdl)
    norm = 1 - B + B * F.col("dl") / F.col("avgdl")
    sums = scored.groupBy("jd_id", "id").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)).alias("s"))
    return sums.join(best, "jd_id").select("jd_id", "id", F.when(F.col("best") > 0, F.least(F.col("s") / F.col("best") * 100, F.lit(100.0))).otherwise(100.0).alias("raw"))


def tf_vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, token, tf: count over length; one row for each distinct token of a text."""
    words = tokenize(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.size(words).alias("n"), F.explode(words).alias("token"))
    return rows.groupBy("id", "n", "token").agg((F.count("*") / F.col("n")).alias("tf")).select("id", "token", "tf")


def tf_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, other, sim for pairs that share a token; `right` is a stated query set of vectors."""
    def norms(v: DataFrame, name: str) -> DataFrame:
        return v.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(name))

    dots = left.join(right.select(F.col("id").alias("other"), "token", F.col("tf").alias("tf2")), "token").groupBy("id", "other").agg(F.sum(F.col("tf") * F.col("tf2")).alias("dot"))
    out = dots.join(norms(left, "a"), "id").join(norms(right, "b").withColumnRenamed("id", "other"), "other")
    return out.select("id", "other", round_half_up(F.col("dot") / (F.col("a") * F.col("b")), 6).alias("sim"))


def top_k(scores: DataFrame, k: int, by: str = "score", id_col: str = "id", per: list[str] | None = None) -> DataFrame:
    """The k best rows, of all or of each key; ties by id."""
    if per:
        w = Window.partitionBy(*per).orderBy(F.col(by).desc(), F.col(id_col))
        return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    best = scores.orderBy(F.col(by).desc(), F.col(id_col)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), F.col(id_col))))
