"""The operators' inputs, made from the driver's tables: customers play persons, what they ordered their skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieverank.session import load, parts_for

#: The last day that the ranking knows.
AS_OF = "2002-01-01"
JDS = ((1, 2, 99, 0, ["BUILDING"]), (2, 0, 5, 2, []), (3, 6, 99, 3, ["AUTOMOBILE", "MACHINERY"]))
WANTED = ((1, 0, "small ring", True), (1, 1, "Brand#2", False), (1, 2, "PROMO", False), (2, 0, "red widget", False), (2, 1, "Brand#11", True), (3, 0, "ECONOMY", True), (3, 1, "blue bolt", False))


def wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*WANTED], "jd_id int, jd_pos int, jd_skill string, must boolean")


def jds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*JDS], "jd_id int, min_years int, max_years int, required_level int, keywords array<string>")


def have(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, skill: names, brands and types of the parts that a customer ordered."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = parts_for(lines)
    lines = lines.repartition(n, "l_orderkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type").repartition(n, "p_partkey")
    owned = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").repartition(n, "l_partkey").distinct()
    named = owned.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("id"), F.explode(F.array("p_name", "p_brand", "p_type")).alias("skill"))
    rows = named.repartition(n, "id").distinct()
    return rows.withColumn("pos", F.lit(0))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, start, end: each order as a time of 90 days."""
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 90).alias("end"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 6).alias("level"), F.col("c_mktsegment").alias("text"))


RECORD_JDS = (
    (1, "Senior Python Backend", "Engineering", "Senior Python backend engineer", ["Python"], ["Docker", "AWS"], 3, 15, "bachelor", "Computer Science", ["backend", "api"], None),
    (2, "Clinical Nurse", "Healthcare", "patient care in a hospital", ["Nursing"], ["CPR"], 0, 99, "any", "any", [], None),
    (3, "Brand Manager", "Marketing", "campaign and brand work", [], ["SEO", "Analytics"], 1, 5, "master", "Marketing", ["campaign"], None),
)
_ROLES = ("Backend Developer", "Staff Nurse", "Marketing Manager", "Python Developer", "Accountant")
_SKILLS = ("Python", "Docker", "Nursing", "SEO", "Django", "Java", "MySQL", "CPR", "React.js")
_DEGREES = ("Bachelor of Computer Science", "Master of Marketing", "Diploma", "", "PhD")


def record_jds(spark: SparkSession) -> DataFrame:
    from sieverank.plans.scoring import JD

    return spark.createDataFrame([*RECORD_JDS], JD)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all customers: what they ordered as work, with text, skills, degrees and certificates by their keys."""
    def pick(names: tuple[str, ...], at):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (at % len(names) + 1).cast("int"))

    # A record is a small row with much work and compresses well: adaptive execution, which goes by bytes, would give many
    # to one task. Orders and customers take partitions by the rows of orders.
    o = load(spark, sf_dir, "orders")
    n = parts_for(o)
    o = o.repartition(n, "o_custkey")
    job = F.struct(
        F.date_format("o_orderdate", "MMM yyyy").alias("start"), F.when(F.col("o_orderkey") % 9 == 0, "Present").otherwise(F.date_format(F.add_months("o_orderdate", 7), "MM/yyyy")).alias("end"),
        pick(_ROLES, F.col("o_custkey")).alias("role"), F.concat(F.lit("Clerk Bank "), F.col("o_orderkey").cast("string")).alias("company"),
        F.lit("Built api services").alias("description"), F.array(F.lit("kept the backend running")).alias("achievements"),
    )
    work = o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(job)).alias("experience"))
    c, k = load(spark, sf_dir, "customer").repartition(n, "c_custkey"), F.col("c_custkey")
    empty = F.array().cast(work.schema["experience"].dataType)
    return c.join(work, F.col("id") == k, "left").select(
        k.alias("id"), F.col("c_name").alias("name"), F.array_distinct(F.array(pick(_SKILLS, k), pick(_SKILLS, k + 3), pick(_SKILLS, k * 2))).alias("skills"), F.lit("").alias("summary"), F.coalesce("experience", empty).alias("experience"),
        F.array(F.struct(pick(_DEGREES, k).alias("degree"), F.lit("State University").alias("institution"))).alias("education"),
        F.array(F.struct(F.lit("Shop").alias("name"), F.lit("a web shop").alias("description"), F.array(pick(_SKILLS, k + 1)).alias("technologies"))).alias("projects"),
        F.array(F.struct(F.when(k % 5 == 0, "AWS Cloud Practitioner").otherwise("First Aid").alias("name"), F.lit(None).cast("string").alias("issuer"))).alias("certifications"),
        F.create_map(F.lit("full_text"), F.concat(F.col("c_mktsegment"), F.lit(" with "), (k % 9).cast("string"), F.lit(" years of experience"))).alias("raw_text_sections"), ((k % 10) / 10.0).alias("extraction_quality"),
    )
