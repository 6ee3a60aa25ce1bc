"""Incremental ingest and progress with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest(spark: SparkSession, path: str, schema, delay: str = "1 day") -> DataFrame:
    """A stream of uploads(job_id, content_hash, at, ...) from Parquet files: a content is taken once for each job.

    The watermark bounds the state that duplicates need: a repeat that comes later than `delay` is taken again. `admit`
    takes none again.
    """
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["job_id", "content_hash"])


def admit(stream: DataFrame, folder: str, checkpoint: str, keys: tuple[str, ...] = ("job_id", "content_hash")):
    """Writes rows whose keys the table in `folder` lacks, however late a repeat comes: the table itself is the state.

    Of equal keys in a batch the row with the least values, column by column, is taken. A batch that runs again after a
    failure does not see its own earlier rows and replaces them. Rows with a null key are told apart like any other value.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c not in keys]
        least = F.min(F.struct(*others)).alias("_row") if others else F.count("*").alias("_row")
        once = batch.groupBy(*keys).agg(least).select(*keys, *(["_row.*"] if others else []))
        known = _table(spark, folder, batch.schema).filter(F.col("batch") != number)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
        condition = same[0]
        for more in same[1:]:
            condition = condition & more
        _replace(once.alias("n").join(known.select(*keys).alias("k"), condition, "left_anti").select(*batch.columns), folder, number)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def _table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of a table of batches, none where it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(folder) if there else spark.createDataFrame([], whole)


def _replace(batch: DataFrame, folder: str, number: int) -> None:
    """One batch of a table: staged first, put in place at the end, so that a failure leaves the table as it was."""
    rows = batch.withColumn("batch", F.lit(number).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def status_counts(stream: DataFrame, keys: tuple[str, ...] = ("job_id", "status")) -> DataFrame:
    """Running counters; one row for each key in update mode. The counts live in the checkpoint of the query, so a query
    that is started again goes on counting."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update"):
    """Writes each micro-batch under its number, so that a batch that runs again after a failure replaces itself, and one
    that fails leaves the table as it was."""

    def write(batch: DataFrame, number: int) -> None:
        _replace(batch, folder, number)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def progress_stream(done: DataFrame) -> DataFrame:
    """Events of a stream of finished documents(job_id, document_id, at, ok, total): job_id, document_id, type, current,
    total, succeeded, failed.

    The counters of a job are the only state, so a query that is started again goes on from them. Within a batch documents
    count in the order of `at`, then id, of each piece that arrives; the event that reaches `total` is "complete". A null
    `ok` counts as failed.
    """
    import pandas as pd

    def run(key, pieces, state):
        good, bad = state.get if state.exists else (0, 0)
        for piece in pieces:
            piece = piece.sort_values(["at", "document_id"])
            ok = piece["ok"].fillna(False).astype(bool)
            succeeded = good + ok.cumsum()
            failed = bad + (~ok).cumsum()
            good, bad = int(succeeded.iloc[-1]), int(failed.iloc[-1])
            current = succeeded + failed
            kind = (current >= piece["total"]).map({True: "complete", False: "progress"})
            yield pd.DataFrame({"job_id": key[0], "document_id": piece["document_id"], "type": kind, "current": current, "total": piece["total"], "succeeded": succeeded, "failed": failed})
        state.update((good, bad))

    out = "job_id string, document_id string, type string, current long, total long, succeeded long, failed long"
    rows = done.select("job_id", "document_id", "at", "ok", F.col("total").cast("long").alias("total"))
    return rows.groupBy("job_id").applyInPandasWithState(run, out, "good long, bad long", "append", "NoTimeout")


def feed_lines(events: DataFrame) -> Column:
    """An event as a server sends it: its name, its data as JSON, a blank line."""
    data = F.to_json(F.struct(*[c for c in events.columns if c != "type"]))
    return F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), data, F.lit("\n\n"))


def to_feed(events: DataFrame, folder: str, checkpoint: str):
    """Writes a stream of events as lines of a feed, one folder a batch."""
    return to_table(events.select("job_id", feed_lines(events).alias("line")), folder, checkpoint, "append")


def isolated(rows: DataFrame, work, schema: str, id_col: str = "document_id"):
    """id_col, ok, error, record (struct of `schema`): `work` on each row as a dict; a row that fails is marked, others go on."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append((row[id_col], True, None, work(row)))
                except Exception as failed:  # noqa: BLE001  whatever a document does, the job goes on
                    out.append((row[id_col], False, f"{type(failed).__name__}: {failed}", None))
            yield pd.DataFrame(out, columns=[id_col, "ok", "error", "record"])

    return rows.mapInPandas(run, f"{id_col} {dict(rows.dtypes)[id_col]}, ok boolean, error string, record struct<{schema}>")


def progress_events(done: DataFrame, key: str = "job_id", at: str = "at") -> DataFrame:
    """type, current, total, succeeded, failed for each finished document of a job, in the order they finished; the last
    one of a job is "complete"."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(at, "document_id")
    total = F.count("*").over(Window.partitionBy(key))
    current = F.row_number().over(w)
    good = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return done.select(key, "document_id", F.when(current == total, "complete").otherwise("progress").alias("type"), current.alias("current"), total.alias("total"), good.alias("succeeded"), (current - good).alias("failed"))
