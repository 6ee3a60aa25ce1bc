"""Held-out accuracy, the fusion formula by hand, and defined results for odd rows."""

import numpy as np
from pyspark.sql import functions as F

from sieverank.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    model = L.fit(train, F.col("lang"))
    assert model.languages == ["de", "en", "es", "fr"]
    got = L.identify(held, model, host=F.col("source")).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 500
    assert sum(r.language == r.lang for r in got) >= 0.98 * len(got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_pages_use_markup_address_and_host(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = L.fit(docs, F.col("lang"))
    got = {r.doc_id: r for r in L.identify_pages(pages, model).collect()}
    assert len(got) == pages.count()
    said = {r.page_id: r.html.split('lang="')[1][:2] for r in pages.collect() if 'lang="' in r.html}
    assert sum(got[i].language == s for i, s in said.items()) >= 0.9 * len(said)


def test_fusion_by_hand(spark):
    counts = {"aa": np.ones(L.BUCKETS), "bb": np.ones(L.BUCKETS)}
    model = L.Model(counts)
    df = spark.createDataFrame([(1, "x", "h1"), (2, "y", "h1"), (3, "z", None)], "doc_id long, text string, host string")
    rows = {r.doc_id: r for r in L.identify(df, model, host=F.col("host")).collect()}
    assert rows[1].language == "aa" and abs(rows[1].confidence - 1 / 3) < 1e-6 and rows[1].rejected


def test_noise_is_rejected_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, F.col("lang"))
    rng = np.random.default_rng(1)
    noise = "".join(map(chr, rng.integers(33, 0x2FF, 2000)))
    df = spark.createDataFrame([(1, noise, "s"), (2, None, "s"), (3, "", None), (4, "the and of that with from", "s"), (4, "the and of that with from", "s"), (None, "the and of", "s")], "doc_id long, text string, language string")
    got = sorted((r.doc_id or -1, r.language, r.rejected) for r in L.identify(df, model, host=F.col("language")).collect())
    assert got == [(-1, "en", False), (1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False)]
    assert L.identify(df.limit(0), model).count() == 0
    none = L.fit(df.withColumn("lang", F.lit(None).cast("string")), F.col("lang"))
    assert {r.language for r in L.identify(df, none).collect()} == {"und"}


def test_host_is_smoothed_towards_its_suffix(spark):
    counts = {"aa": np.zeros(L.BUCKETS), "bb": np.zeros(L.BUCKETS)}
    for language, text in (("aa", "aaa"), ("bb", "bbb")):
        counts[language] += 1e5 * np.bincount(L.trigrams([text])[0], minlength=L.BUCKETS + 1)[:-1]
    model = L.Model(counts)
    rows = [(i, "aaa", f"h{i}", "a") for i in range(100)] + [(i, "bbb", f"h{i}", "b") for i in range(100, 400)] + [(400, "bab", "new", "a"), (401, "bab", None, "a"), (402, "bab", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string")
    got = {r.doc_id: r.confidence for r in L.identify(df, model, host=F.col("host"), suffix=F.col("suffix")).collect()}
    log = model.likelihoods([r[1] for r in rows])
    p = np.exp(log - log.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    share = (p.sum(axis=0) + 1) / (p.sum() + p.shape[1])
    a = p[[i for i, r in enumerate(rows) if r[3] == "a"]].sum(axis=0)
    suffix = (a + L.SUFFIX_WEIGHT * share) / (a.sum() + L.SUFFIX_WEIGHT)
    host = (p[400] + L.HOST_WEIGHT * suffix) / (1 + L.HOST_WEIGHT)
    for i, prior in ((400, host), (401, suffix), (402, share)):
        q = np.exp(log[i]) * prior
        assert abs(got[i] - q.max() / q.sum()) < 1e-6


def test_pages_are_registered(spark):
    from sieverank.llm.queries import QUERIES

    got = {r.page_id: r.language for r in QUERIES["op10_language_id_pages"](spark, "/root/testdata/sf0.01").collect()}
    said = {r.page_id: r.html.split('lang="')[1][:2] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if 'lang="' in r.html}
    assert set(said) <= set(got) and sum(got[i] == s for i, s in said.items()) >= 0.9 * len(said)


def test_rare_languages_are_kept(spark):
    words = {"en": "the and of that with from this", "xx": "zoqua vexil krombu yatz pluvog wirrim"}
    rows = [(i, " ".join([words["en"]] * 5), "en") for i in range(3000)] + [(3000 + i, " ".join([words["xx"]] * 5), "xx") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = L.training_rows(df, F.col("lang"), rows=50)
    got = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"en": 50, "xx": 3}
    hashes = df.filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("id")).withColumn("h", F.xxhash64("id")).orderBy("h").limit(50)
    assert {r.id for r in hashes.collect()} == {r.id for r in chosen.filter("label = 'en'").collect()}
    model = L.fit(df, F.col("lang"), rows=50)
    assert model.languages == ["en", "xx"]
    assert {r.language for r in L.identify(df.filter("doc_id >= 3000"), model).collect()} == {"xx"}
