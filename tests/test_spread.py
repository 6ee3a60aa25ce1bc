"""Wide steps take as many partitions as their rows ask for, whatever adaptive execution would make of their bytes."""

from pyspark.sql import functions as F

from sieverank.operators import matching
from sieverank.plans import audits, fixtures, profiles, scoring
from sieverank.session import parts_for

DATA = "/root/testdata/sf0.01"


def test_parts_follow_rows(spark):
    least = spark.sparkContext.defaultParallelism
    assert parts_for(spark.range(10)) == least
    assert parts_for(spark.range(1000), 10) == max(least, 100)
    assert parts_for(spark.range(1001), 10) == max(least, 101)


def test_owned_skills_keep_their_partitions(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "parts_for", lambda rows: 23)
    have = fixtures.have(spark, DATA)
    used = have.withColumn("p", F.spark_partition_id())
    assert used.select("p").distinct().count() == 23
    assert used.groupBy("id").agg(F.countDistinct("p").alias("n")).filter("n > 1").count() == 0
    assert have.count() == have.distinct().count()


def test_ranked_persons_are_dealt_out(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(audits, "parts_for", lambda rows, most: asked.append((rows.count(), most)) or 23)
    plan = audits._ranked(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert asked == [(spark.read.parquet(f"{DATA}/customer.parquet").count(), 500_000 // len(audits.KINDS))]
    assert "RepartitionByExpression [id" in plan and ", 23" in plan


def test_graph_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(matching, "parts_for", lambda rows, most: 23)
    nodes = spark.createDataFrame([(0, "a_b", ["x"]), (1, "c", None)], "at int, key string, aliases array<string>")
    skills = spark.createDataFrame([("X",), ("a b",), ("C",), ("none",), (None,), ("X",)], "skill string")
    out = matching.graph_keys(skills, nodes)
    assert ", 23" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["skill"]: r["key"] for r in out.collect()} == {"X": "a_b", "a b": "a_b", "C": "c"}


def test_scored_records_do_not_meet_by_request(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "parts_for", lambda rows: 23)
    rows = scoring.score(fixtures.record_jds(spark), fixtures.records(spark, DATA), F.lit(fixtures.AS_OF).cast("date"))
    plan = rows.select("jd_id", "id", "final_score")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and ", 23" in plan


def test_ranges_of_ranks_keep_their_number(spark, monkeypatch):
    monkeypatch.setattr(scoring, "parts_for", lambda rows, most: 23)
    rows = spark.range(3000).select((F.col("id") % 2).cast("int").alias("jd_id"), "id", (F.col("id") % 7 == 0).alias("knocked_out"), (F.col("id") % 90).cast("double").alias("final_score"))
    out = scoring.ranked(rows)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    want = sorted((r for r in rows.collect()), key=lambda r: (r.jd_id, r.knocked_out, -r.final_score, r.id))
    got = sorted(out.collect(), key=lambda r: (r.jd_id, r["rank"]))
    assert [(r.jd_id, r.id) for r in got] == [(r.jd_id, r.id) for r in want]
    assert got[0].percentile == 100.0 and [r["rank"] for r in got if r.jd_id == 1] == list(range(1, 1501))


def test_tagged_texts_are_read_once(spark):
    """Of an exploded array Spark infers a filter that it has entries; below the shuffle it would read every text again."""
    plan = profiles.tagged_employment(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "Filter ((size(" not in plan


def test_graph_keys_are_worked_out_for_distinct_names(spark, monkeypatch):
    monkeypatch.setattr(matching, "graph_key", lambda x: F.concat(F.lit("key of "), x))
    have = spark.createDataFrame([(i, 0, "a") for i in range(9)] + [(9, 0, None)], "id int, pos int, skill string")
    wanted = spark.createDataFrame([(1, 0, "zzz")], "jd_id int, jd_pos int, jd_skill string")
    edges = spark.createDataFrame([("key of a", "key of zzz", "implies")], "src string, dst string, kind string")
    out = matching.infer(have, wanted, edges)
    assert sorted((r.id, r.match_type) for r in out.collect()) == [(i, "inferred") for i in range(9)]
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    keyed = [i for i, s in enumerate(lines) if "Project" in s and "key of " in s and "skill#" in s]
    assert keyed and all("Aggregate [skill" in lines[i + 1] for i in keyed if "jd_skill" not in lines[i])
