"""The registered queries of this folder: thin applications of each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieverank.llm.oracles import ORACLE_SQL  # noqa: F401
from sieverank.session import load


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    from sieverank.llm.secret_scan import secret_digest

    return secret_digest(load(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a fixed list of edits."""
    from sieverank.llm.token_counts import token_counts

    return token_counts(load(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprint of every document and of its edited text, with their likeness and that to the next document."""
    from sieverank.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(load(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated strings of 100 bytes leaves of every document."""
    from sieverank.llm.suffix_dedup import deduplicate

    return deduplicate(load(spark, sf_dir, "documents")).drop("kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with the item and the words that match."""
    from sieverank.llm.decontamination import contaminated

    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from pyspark.sql import functions as F

    from sieverank.llm.simhash import near_duplicates

    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: piece count, digests of ids and decoded text, round trip."""
    from sieverank.llm.sentencepiece_codec import encode_and_check

    return encode_and_check(load(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-model and context-tree scores of every document."""
    from sieverank.llm.ctw import lm_scores

    return lm_scores(load(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from sieverank.llm.html_extract import main_text

    return main_text(load(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, with its confidence and whether it is rejected."""
    from pyspark.sql import functions as F

    from sieverank.llm.language_id import identify_documents

    return identify_documents(load(spark, sf_dir, "documents")).withColumn("confidence", F.round("confidence", 6))


def op10_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page by its text, declared language, address suffix and host; trigrams as for the documents."""
    from pyspark.sql import functions as F

    from sieverank.llm.language_id import fit, identify_pages

    found = identify_pages(load(spark, sf_dir, "pages"), fit(load(spark, sf_dir, "documents"), F.col("lang")))
    return found.withColumnRenamed("doc_id", "page_id").withColumn("confidence", F.round("confidence", 6))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page, with verdicts carried over canonical links and refreshes."""
    from sieverank.llm.url_filter import filter_urls, rule_table

    return filter_urls(load(spark, sf_dir, "pages"), rule_table(spark)).drop("url")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of them made periodic by its id, and what collapsing the runs leaves."""
    from sieverank.llm.periodic_runs import periodic_runs, run_digest, with_planted_periods

    return run_digest(periodic_runs(with_planted_periods(load(spark, sf_dir, "documents"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and lose at each step of all their orders, by source."""
    from sieverank.llm.filter_audit import audit

    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_token_counts,
        op3_fingerprints,
        op4_suffix_dedup,
        op5_decontamination,
        op6_simhash,
        op7_sentencepiece,
        op8_lm_scores,
        op9_html_extract,
        op10_language_id,
        op10_language_id_pages,
        op11_url_filter,
        op12_periodic_runs,
        op13_filter_audit,
    )
}
