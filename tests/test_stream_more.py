"""Streams that stop and go on, batches that fail, deletes with children, names by locale."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sieverank.operators import views
from sieverank.sources import tables
from sieverank.streaming import progress

DAY = dt.datetime(2024, 1, 1)


def uploads(spark, rows, path):
    spark.createDataFrame(rows, "job_id string, content_hash string, at timestamp, name string").coalesce(1).write.mode("append").parquet(path)


def test_admit_takes_no_repeat_however_late(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "job_id string, content_hash string, at timestamp, name string"
    uploads(spark, [("j", "h1", DAY, "b"), ("j", "h1", DAY, "a"), ("j", None, DAY, "n"), ("k", "h1", DAY, "c")], src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    progress.admit(stream(), out, ck).awaitTermination(120)
    year = DAY + dt.timedelta(days=400)
    uploads(spark, [("j", "h1", year, "late"), ("j", None, year, "late"), ("k", "h2", year, "new")], src)
    progress.admit(stream(), out, ck).awaitTermination(120)
    got = sorted((r.job_id, r.content_hash or "", r.name) for r in spark.read.parquet(out).collect())
    assert got == [("j", "", "n"), ("j", "h1", "a"), ("k", "h1", "c"), ("k", "h2", "new")]


def finished(spark, rows, path):
    spark.createDataFrame(rows, "job_id string, document_id string, at timestamp, ok boolean, total int").coalesce(1).write.mode("append").parquet(path)


def test_progress_goes_on_after_a_stop_like_one_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = [("j", f"d{i}", DAY + dt.timedelta(minutes=i), i % 3 != 0, 5) for i in range(5)] + [("k", "e0", DAY, None, 2), ("k", "e1", DAY + dt.timedelta(minutes=1), True, 2)]
    finished(spark, [r for r in rows if r[1] in ("d0", "d1", "e0")], src)
    schema = "job_id string, document_id string, at timestamp, ok boolean, total int"

    def run():
        events = progress.progress_stream(spark.readStream.schema(schema).parquet(src))
        progress.to_table(events, out, ck, "append").awaitTermination(120)

    run()
    assert spark.read.parquet(out).count() == 3
    finished(spark, [r for r in rows if r[1] not in ("d0", "d1", "e0")], src)
    run()
    names = ["job_id", "document_id", "type", "current", "total", "succeeded", "failed"]
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*names).collect())
    whole = spark.createDataFrame(rows, schema).withColumn("ok", F.coalesce("ok", F.lit(False)))
    assert got == sorted(tuple(r) for r in progress.progress_events(whole).select(*names).collect())
    assert {g[1] for g in got if g[2] == "complete"} == {"d4", "e1"}


def test_counts_go_on_after_a_stop(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = [("j", f"d{i}", DAY, i % 2 == 0, 9) for i in range(9)]
    for part in (rows[:4], rows[4:]):
        finished(spark, part, src)
        stream = spark.readStream.schema("job_id string, document_id string, at timestamp, ok boolean, total int").parquet(src)
        progress.to_table(progress.status_counts(stream, ("job_id", "ok")), out, ck).awaitTermination(120)
    last = spark.read.parquet(out).groupBy("job_id", "ok").agg(F.max_by("n", "batch").alias("n"))
    assert {(r.ok, r.n) for r in last.collect()} == {(True, 5), (False, 4)}


def test_a_batch_that_fails_leaves_the_table(spark, tmp_path):
    out = str(tmp_path / "out")
    progress._replace(spark.createDataFrame([(1,)], "x int"), out, 0)
    broken = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.lit(2)).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        progress._replace(broken, out, 0)
    assert [r.x for r in spark.read.parquet(out).collect()] == [1]
    progress._replace(spark.createDataFrame([(3,)], "x int"), out, 0)
    progress._replace(spark.createDataFrame([(4,)], "x int"), out, 1)
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [3, 4]


def test_feed(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    finished(spark, [("j", "d", DAY, True, 1)], src)
    events = progress.progress_stream(spark.readStream.schema("job_id string, document_id string, at timestamp, ok boolean, total int").parquet(src))
    progress.to_feed(events, out, ck).awaitTermination(120)
    (line,) = spark.read.parquet(out).collect()
    assert line.line == 'event: complete\ndata: {"job_id":"j","document_id":"d","current":1,"total":1,"succeeded":1,"failed":0}\n\n'


def test_delete_with_children(spark, tmp_path):
    rows = spark.createDataFrame([("a/b=1", 1), ("a/b=1", 2), ("k", 3)], "job_id string, n int")
    paths = [str(tmp_path / t) for t in ("results", "documents", "jobs")]
    for p in paths[:2]:
        rows.write.partitionBy("job_id").parquet(p)
    spark.createDataFrame([("k", 3)], "job_id string, n int").write.partitionBy("job_id").parquet(paths[2])
    assert tables.delete_job(spark, "a/b=1", paths) == paths[:2]
    assert tables.delete_job(spark, "a/b=1", paths) == []
    assert [[(r.job_id, r.n) for r in spark.read.parquet(p).collect()] for p in paths] == [[("k", 3)]] * 3


def test_names_by_locale(spark):
    rows = [(1, "Zoë", ["Go"], 1.0, "good"), (2, "émile", None, 2.0, "good"), (3, "Emil", [], 3.0, "good"), (4, None, ["Échelle"], 4.0, "good"), (5, "zoe", [], 5.0, "knockout")]
    df = spark.createDataFrame(rows, "id int, name string, skills array<string>, score double, signal string")
    assert [r.id for r in views.visible(df, sort="name").collect()] == [4, 3, 2, 1]
    assert [r.id for r in views.visible(df, search="ÉCH").collect()] == [4]
    assert [r.id for r in views.visible(df, search="  ").collect()] == [4, 3, 2, 1]
    assert [r.id for r in views.visible(df.withColumn("matched", F.array(F.lit("Rust"))), search="rus").collect()] == [4, 3, 2, 1]
    assert sorted(r.id for r in views.search_names(df, "ZOE").collect()) == [1, 5]
    assert sorted((r.name or "", r.n) for r in views.distinct_names(df).collect()) == [("", 1), ("Emil", 1), ("Zoë", 2), ("émile", 1)]
    assert views.distinct_names(df.limit(0)).count() == 0
