"""Session helper: settings that the operators count on, and a checkpoint folder where none is set."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task of a wide step is given. Adaptive execution joins partitions by their compressed bytes, so that
#: rows that compress well would all meet in a few tasks, whose memory grows with the table.
ROWS_A_TASK = 500_000


def get_session(app: str = "sieverank", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever their working folder is."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; set a local one only where none is set and the
    session is local, as in tests."""
    ensure_importable(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sieverank-checkpoint-"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader so that any store works."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts_for(rows: DataFrame, rows_a_task: int = ROWS_A_TASK) -> int:
    """Partitions for a wide step over `rows`, as many as their number asks for. Given to repartition() as a number, which
    adaptive execution leaves as it is; both sides of a join take the same."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / rows_a_task))
