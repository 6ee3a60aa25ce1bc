"""Versioned tables: insert if absent, optimistic update, latest version, upload gate, cascading delete, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ("created", "documents_uploaded", "extracting", "extracted", "scoring", "scored")
#: The state that may follow.
TRANSITIONS = (("created", "documents_uploaded"), ("created", "extracting"), ("documents_uploaded", "extracting"), ("extracting", "extracted"), ("extracting", "created"), ("extracted", "extracting"), ("extracted", "scoring"), ("scoring", "scored"), ("scoring", "extracted"), ("scored", "scoring"), ("scored", "extracting"))
MOST_BYTES = 10 * 1024 * 1024


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the greatest version of each key; an aggregate, so that only one row a key and task is shuffled."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key the table lacks, one for each key."""
    return new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def optimistic_update(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """New versions for changes(keys, expected, fields...) that expect the current version; null fields keep the value."""
    fields = [c for c in changes.columns if c not in (*keys, "expected")]
    current = latest(table, keys, "version")
    both = current.join(changes.select(*keys, "expected", *[F.col(f).alias(f"_{f}") for f in fields]), keys).filter("version = expected")
    return both.select(*[(F.col("version") + 1).alias("version") if c == "version" else F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def legal_transitions(changes: DataFrame, source: str = "old", target: str = "new") -> DataFrame:
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    return changes.withColumn("legal", F.array_contains(pairs, F.concat(source, F.lit(">"), target)))


def upload_gate(files: DataFrame) -> DataFrame:
    """files(job_id, name, content_type, size, content_hash) with `reason`: null for accepted ones. Of equal contents in
    a job the first by name is accepted."""
    w = Window.partitionBy("job_id", "content_hash").orderBy("name")
    reason = (
        F.when(~F.lower("name").endswith(".pdf"), "not a PDF name")
        .when(~F.col("content_type").isin("application/pdf", "application/octet-stream"), "not a PDF type")
        .when(F.col("size") > MOST_BYTES, "too large")
        .when(F.col("size") == 0, "empty")
    )
    fine = files.withColumn("reason", reason)
    twice = F.when(F.col("reason").isNull() & (F.row_number().over(w.orderBy(F.col("reason").isNotNull(), "name")) > 1), "duplicate")
    return fine.withColumn("reason", F.coalesce("reason", twice))


def without_job(table: DataFrame, job_id) -> DataFrame:
    """The table after a job and all that belongs to it were deleted."""
    return table.filter(~F.col("job_id").eqNullSafe(F.lit(job_id)))


def document_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("job_id").agg(F.count("*").alias("document_count"))
