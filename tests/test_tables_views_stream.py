"""Sources and sinks, store operators, bonuses, views and the stream."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sieverank.operators import bonus, store, views
from sieverank.sources import tables
from sieverank.streaming import progress


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"document_id": "a", "skills": ["x"]}) + "\n")
    (row,) = tables.read_records(spark, str(tmp_path / "r.json")).collect()
    assert row.skills == ["x"] and row.summary is None
    tables.write_records(tables.read_records(spark, str(tmp_path / "r.json")).withColumn("job_id", F.lit("j")), str(tmp_path / "t"))
    assert tables.job_rows(spark, str(tmp_path / "t"), "j").count() == 1
    (tmp_path / "d.json").write_text(json.dumps(["Python", "__comment x", "python", "Go"]))
    assert sorted(r.lower for r in tables.read_dictionary(spark, str(tmp_path / "d.json")).collect()) == ["go", "python"]
    (tmp_path / "g.json").write_text(json.dumps({"___c": {}, "django": {"implies": ["python"], "related": ["flask"]}}))
    assert sorted(tuple(r) for r in tables.read_graph(spark, str(tmp_path / "g.json")).collect()) == [("django", "flask", "related"), ("django", "python", "implies"), ("flask", "django", "related")]
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.pdf").write_bytes(b"abc")
    (up,) = tables.read_uploads(spark, str(tmp_path / "u")).collect()
    assert (up.name, up.size) == ("a.pdf", 3)
    tables.write_csv(spark.createDataFrame([(1, ["a", "b"])], "id int, skills array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().skills == "a; b"


def test_store(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    assert [r.k for r in store.insert_if_absent(table, new, ["k"]).collect()] == [3]
    moves = spark.createDataFrame([("created", "extracting"), ("created", "scored")], "old string, new string")
    assert [r.legal for r in store.legal_transitions(moves).collect()] == [True, False]
    jobs = spark.createDataFrame([("j", 1), ("k", 2), ("j", 3)], "job_id string, doc int")
    assert store.without_job(jobs, "j").count() == 1
    assert {r.job_id: r.document_count for r in store.document_counts(jobs).collect()} == {"j": 2, "k": 1}


def test_bonuses(spark):
    df = spark.createDataFrame(
        [([{"name": "Shop", "description": "built with react", "technologies": ["Django"]}], ["Google India", "Acme"], [{"name": "AWS Cloud Practitioner", "issuer": "AWS"}, {"name": "Hackathon winner", "issuer": None}])],
        "projects array<struct<name:string,description:string,technologies:array<string>>>, companies array<string>, certs array<struct<name:string,issuer:string>>",
    )
    wanted = F.array(F.lit("React"), F.lit("django"), F.lit("Go"))
    row = df.select(
        bonus.project_bonus(F.col("projects"), wanted).alias("p"), bonus.prestige_bonus(F.col("companies")).alias("c"), bonus.cert_bonus(F.col("certs"), F.array(F.lit("cloud"))).alias("z"),
        bonus.keyword_score(F.lit("Back-end and Node work"), {"backend": ["backend", "back-end"], "node": ["node"], "go": ["go"]}).alias("k"),
    ).first()
    assert (row.p, row.c, row.z, round(row.k, 3)) == (4.0, 2.0, 1.3, 66.667)


def test_views(spark):
    rows = spark.createDataFrame([(1, "Ann", ["go"], 80.0, "strong"), (2, "bob", ["py"], 55.0, "good"), (3, "Cy", [], 0.0, "knockout")], "id int, name string, skills array<string>, score double, signal string")
    assert [r.id for r in views.visible(rows).collect()] == [1, 2]
    assert [r.id for r in views.visible(rows, wanted="knockout").collect()] == []
    assert [r.id for r in views.visible(rows, search="PY").collect()] == [2]
    assert [r.id for r in views.visible(rows, show_knockouts=True, sort="name").collect()] == [1, 2, 3]


def test_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("j", "h1", at, "ok"), ("j", "h1", at, "ok"), ("j", "h2", at, "failed"), ("k", "h1", at, "ok")], "job_id string, content_hash string, at timestamp, status string")
    rows.write.parquet(str(tmp_path / "in"))
    counts = progress.status_counts(progress.ingest(spark, str(tmp_path / "in"), rows.schema))
    progress.to_table(counts, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.job_id, r.status, r.n) for r in got.collect()) == [("j", "failed", 1), ("j", "ok", 1), ("k", "ok", 1)]
