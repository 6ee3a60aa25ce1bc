"""Sources and sinks: records, registries, uploads and job tables on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

PERSON = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("personal_info", T.StructType([T.StructField(n, T.StringType()) for n in ("name", "email", "phone", "linkedin", "github", "location", "dob")])),
        T.StructField("summary", T.StringType()),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("experience", T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("role", "company", "start", "end", "location", "description")], T.StructField("achievements", T.ArrayType(T.StringType()))]))),
        T.StructField("education", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("degree", "institution", "start", "end", "grade")]))),
        T.StructField("projects", T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("name", "description", "github", "demo")], T.StructField("technologies", T.ArrayType(T.StringType()))]))),
        T.StructField("certifications", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "issuer", "date")]))),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("raw_text_sections", T.MapType(T.StringType(), T.StringType())),
        T.StructField("extraction_quality", T.DoubleType()),
    ]
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Extracted records as JSON lines; fields that a record lacks are null."""
    return spark.read.schema(PERSON).json(path)


def write_records(records: DataFrame, path: str, job_id: str | None = None) -> None:
    """Parquet, in one folder for each job, so that a job's rows are found without reading others."""
    rows = records if job_id is None else records.withColumn("job_id", F.lit(job_id))
    writer = rows.write.mode("append")
    (writer.partitionBy("job_id") if "job_id" in rows.columns else writer).parquet(path)


def job_rows(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """A job's rows; the filter prunes folders."""
    return spark.read.parquet(path).filter(F.col("job_id") == job_id)


def by_hash(table: DataFrame, job_id: str, content_hash: str) -> DataFrame:
    """The first document of a job with that content, if any."""
    return table.filter((F.col("job_id") == job_id) & (F.col("content_hash") == content_hash)).limit(1)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with name, size and SHA-256 of their bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), "content")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """canonical, lower: names of a JSON list, without comment rows; an unreadable or absent file gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        raw = spark.createDataFrame([], "value string")
    text = raw.select(F.from_json("value", "array<string>").alias("names"))
    rows = text.select(F.explode("names").alias("canonical")).filter(~F.col("canonical").startswith("__comment"))
    return rows.withColumn("lower", F.lower("canonical")).dropDuplicates(["lower"])


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, kind of a skill graph {key: {implies: [...], related: [...]}}; keys that start with ___ are comments;
    related edges run both ways."""
    entry = "struct<implies:array<string>,related:array<string>>"
    nodes = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("src", "e")).filter(~F.col("src").startswith("___"))
    implies = nodes.select("src", F.explode("e.implies").alias("dst"), F.lit("implies").alias("kind"))
    related = nodes.select("src", F.explode("e.related").alias("dst"), F.lit("related").alias("kind"))
    return implies.unionByName(related).unionByName(related.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")).distinct()


def read_graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    """at, key, aliases of the nodes of a skill graph {key: {aliases: [...]}}, in the order of the file; keys that start
    with ___ are comments."""
    parsed = F.from_json("value", "map<string,struct<aliases:array<string>>>")
    nodes = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(parsed)).alias("at", "e"))
    return nodes.select("at", "e.key", F.coalesce("e.value.aliases", F.array().cast("array<string>")).alias("aliases")).filter(~F.col("key").startswith("___"))


def write_csv(ranking: DataFrame, path: str) -> None:
    """The ranking as CSV; lists become one field."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in ranking.schema.fields]
    ranking.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_ranking(ranking: DataFrame, path: str, job_id: str) -> None:
    """A job's ranking as JSON lines, in a folder of its own that a later ranking replaces."""
    ranking.write.mode("overwrite").json(f"{path}/job_id={job_id}")


def read_ranking(spark: SparkSession, path: str, job_id: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/job_id={job_id}")


def by_id(table: DataFrame, job_id: str, document_id: str) -> DataFrame:
    """One row by its keys; the first prunes folders."""
    return table.filter((F.col("job_id") == job_id) & (F.col("document_id") == document_id))


def delete_job(spark: SparkSession, job_id: str, tables: list[str]) -> list[str]:
    """Deletes a job from tables that have a folder for each job_id, in the given order: children first, the job last, so
    that a run that fails half way can be run again. Returns the tables that held it; an unknown job changes nothing.

    A folder goes as a whole and other jobs are not read. Null ids lie in no folder of their own and are not deleted.
    """
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(job_id)
    gone = []
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table, f"job_id={name}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path) and files.delete(path, True):
            gone.append(table)
    return gone


def put_uploads(files: DataFrame, path: str) -> None:
    """Contents of accepted files beside their hashes, in one folder for each job."""
    files.select("job_id", "name", "content_hash", "content").write.mode("append").partitionBy("job_id").parquet(path)


def ensure_tables(spark: SparkSession, tables: dict[str, str]) -> dict[str, bool]:
    """Creates the tables (name -> columns as in DDL) that are not there; tells which are there afterwards."""
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return {name: spark.catalog.tableExists(name) for name in tables}
