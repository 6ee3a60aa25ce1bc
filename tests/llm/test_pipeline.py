"""The pipeline against a plain version of each stage on the small fixture."""

import re

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sieverank.llm.sentencepiece_codec import MODEL
from tests.llm.test_near_copies import least_ids

FIXTURE = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet").cache()
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FIXTURE)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        after[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(after["language_id"]) >= 0.99 * len(before)
    # of near-duplicates: the smallest id of each component, by brute force over all pairs
    least = least_ids(sorted(after["language_id"].items()))
    assert set(after["simhash_near_dedup"]) == {i for i, root in least.items() if i == root}
    items = [r.text for r in spark.read.parquet(f"{FIXTURE}/benchmark.parquet").collect()]
    gone = set(after["simhash_near_dedup"]) - set(after["benchmark_decontamination"])
    assert gone == {i for i in after["simhash_near_dedup"] if any(t in before[i] for t in items)}
    for i, text in after["secret_scans"].items():
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|password=\w{6}", text)
        assert re.sub(r"AKIA[A-Z0-9]{16,}|password=[0-9a-f]{6,}|token = \"[0-9a-f]{40}", "[SECRET]", before[i]) == text


def test_run(spark):
    out = corpus_pipeline.run(spark, FIXTURE).collect()
    assert out and all(r.round_trip for r in out)
    assert len({r.doc_id for r in out}) == len(out)


def test_last_stage_equals_the_library(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r.n_pieces for r in corpus_pipeline.STAGES[-1][1](spark, docs, FIXTURE).collect()}
    assert got == {r.doc_id: len(own.encode(r.text)) for r in docs.select("doc_id", F.col("text")).collect()}
