"""Queries that audit a ranking, order names by locale and keep tables of jobs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieverank.functions import literals
from sieverank.operators import evaluate, matching, parse, views
from sieverank.session import ROWS_A_TASK, ensure_checkpoint_dir, load, parts_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- wrong and missing rows of a ranking: customers ordered by balance stand for the ranked persons of seven requests
KINDS = ("software", "civil", "electrical", "mechanical", "other", "other", "software")
DEPARTMENTS = ("Engineering", "Engineering", "Legal", "Finance", "Marketing", "Human Resources", "Engineering")
DOMAINS = ("engineering", "legal", "construction", "unknown", "finance", "engineering", "marketing", "engineering")
BRANCHES = ("software", "civil", "electrical", "", "embedded", "human_resources", "mechanical")
ASKED = (("Red", "blue", "Ring", "small"), ("green", "ring", "widget", "bolt"), ("red", "large", "plate"), ("blue", "small", "gear"), ("bolt", "ring", "steel"), ("red", "blue", "green"), ("widget", "plate", "gear", "red"))


def _requests(spark: SparkSession) -> DataFrame:
    rows = [(i, kind, ["construction"] if kind == "civil" else ["engineering"] if i == 4 else [], dept, list(skills)) for i, (kind, dept, skills) in enumerate(zip(KINDS, DEPARTMENTS, ASKED, strict=True))]
    return spark.createDataFrame(rows, "jd_id int, kind string, related array<string>, department string, skills array<string>")


def _persons(spark: SparkSession, d: str) -> DataFrame:
    """id, domain, sub_domain, score for each customer, and the words of the names of the parts that they ordered."""
    at = lambda names, k: F.get(literals.array(names), (k % len(names)).cast("int"))
    c = F.col("c_custkey")
    people = load(spark, d, "customer").select(c.alias("id"), at(DOMAINS, c).alias("domain"), at(BRANCHES, c).alias("sub_domain"), F.round(F.col("c_acctbal") / 100, 1).alias("score"))
    lines, orders, part = (load(spark, d, t) for t in ("lineitem", "orders", "part"))
    named = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    words = named.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("p_name", " "))))).alias("skills"))
    return people.join(words, "id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """The hundred first customers of each request, whose scores differ by request."""
    from pyspark.sql import Window

    # A file of customers is one task, and it sorts its rows for each request: they are dealt out by their number first.
    n = parts_for(load(spark, d, "customer"), ROWS_A_TASK // len(KINDS))
    rows = _persons(spark, d).drop("skills").repartition(n, "id").withColumn("jd_id", F.explode(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)))).withColumn("score", (F.col("score") + F.col("id") * (F.col("jd_id") + 1) % 50).cast("double"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("jd_id").orderBy(F.col("score").desc(), "id"))).filter("rank <= 100")


_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_PEOPLE = f"SELECT c_custkey AS id, {_list(DOMAINS)}[c_custkey % {len(DOMAINS)} + 1] AS domain, {_list(BRANCHES)}[c_custkey % {len(BRANCHES)} + 1] AS branch, round(c_acctbal / 100, 1) AS score FROM customer"
_RANKED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY s DESC, id) AS rank FROM (SELECT id, domain, branch, jd_id, CAST(score + id * (jd_id + 1) % 50 AS DOUBLE) AS s
  FROM ({_PEOPLE}), (SELECT unnest(range({len(KINDS)})) AS jd_id))) WHERE rank <= 100"""
_FAR = "('marketing', 'accounting', 'legal', 'healthcare', 'hr', 'finance', 'education', 'hospitality', 'admin', 'sales')"
_HITS = f"""SELECT * FROM (SELECT jd_id::INT AS jd_id, id, rank::INT AS rank, CASE WHEN kind = 'civil' AND domain = 'construction' THEN 'related_domain'
  WHEN kind <> 'other' AND domain IN {_FAR} THEN 'true_fp'
  WHEN domain = 'engineering' AND ((kind = 'software' AND branch IN ('civil', 'mechanical', 'electrical')) OR (kind = 'civil' AND branch NOT IN ('civil', ''))
   OR (kind = 'electrical' AND branch NOT IN ('electrical', 'embedded', '')) OR (kind = 'mechanical' AND branch NOT IN ('mechanical', ''))) THEN 'same_domain'
  WHEN kind = 'other' AND domain = 'engineering' AND s > 40 THEN CASE WHEN jd_id = 4 THEN 'related_domain' ELSE 'true_fp' END END AS tier
  FROM (SELECT *, {_list(KINDS)}[jd_id + 1] AS kind FROM ({_RANKED}) WHERE rank <= 10 AND s > 30 AND domain <> 'unknown')) WHERE tier IS NOT NULL"""


@query(_HITS)
def wrong_hits(spark, d):
    return evaluate.wrong_hits(_ranked(spark, d), _requests(spark))


@query(f"""SELECT a AS true_fp, b AS related_domain, c AS same_domain, floor(a / {10 * len(KINDS)} * 1000 + 0.5) / 10 AS true_fp_rate, floor((a + b + c) / {10 * len(KINDS)} * 1000 + 0.5) / 10 AS all_fp_rate
  FROM (SELECT count_if(tier = 'true_fp') AS a, count_if(tier = 'related_domain') AS b, count_if(tier = 'same_domain') AS c FROM ({_HITS}))""")
def wrong_hit_rates(spark, d):
    return evaluate.wrong_hit_rates(wrong_hits(spark, d), _requests(spark))


_ASKED = "(VALUES " + ", ".join(f"({i}, '{DEPARTMENTS[i].lower()}', '{s.lower()}')" for i, skills in enumerate(ASKED) for s in skills) + ") AS a(jd_id, department, skill)"


@query(f"""WITH h AS (SELECT DISTINCT o_custkey AS id, lower(unnest(string_split(p_name, ' '))) AS skill FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
 s AS (SELECT jd_id, department, id, count(*) AS overlap FROM h JOIN {_ASKED} USING (skill) GROUP BY ALL HAVING count(*) >= 3),
 f AS (SELECT s.*, row_number() OVER (PARTITION BY jd_id ORDER BY id) AS n FROM s JOIN ({_PEOPLE}) p USING (id) WHERE ((department = 'engineering' AND starts_with(branch, 'software')) OR domain = department OR replace(department, ' ', '_') = branch)
  AND NOT EXISTS (SELECT 1 FROM ({_RANKED}) r WHERE r.jd_id = s.jd_id AND r.id = s.id AND r.rank <= 20)),
 k AS (SELECT * FROM f WHERE n <= 20), c AS (SELECT jd_id, coalesce(sum(count(*)) OVER (ORDER BY jd_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k GROUP BY jd_id)
 SELECT jd_id::INT AS jd_id, id, overlap, (SELECT count(*) FROM {_ASKED} WHERE a.jd_id = k.jd_id)::INT AS asked FROM k JOIN c USING (jd_id) WHERE before < 50""")
def missed_hits(spark, d):
    return evaluate.missed_hits(_ranked(spark, d), _persons(spark, d), _requests(spark), in_all=50)


# -- names in the order of a locale
NAMES = ("Émile", "emile", "Emile", "Zoë", "zoe", "Ängström", "angstrom", "Oz", "öz", "Åsa", "asa", "Élan", "elan", "Zoé", "Ñandú", "nandu")
_ACCENTED = f"SELECT c_custkey AS id, c_nationkey AS nation, {_list(NAMES)}[c_custkey * 7 % {len(NAMES)} + 1] AS name FROM customer"
#: The order of the names above in the root locale: letters, then accents, then case.
_BASE = "translate(lower({0}), 'éëäöåñú', 'eeaoanu')"


def _named(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return load(spark, d, "customer").select(c.alias("id"), F.col("c_nationkey").alias("nation"), F.get(literals.array(NAMES), (c * 7 % len(NAMES)).cast("int")).alias("name"))


@query(f"""SELECT id, name, CAST(row_number() OVER (PARTITION BY nation ORDER BY {_BASE.format('name')}, strip_accents(name) <> name, translate(lower(name), 'éëäöåñú', '12a3b4u'), name = lower(name) DESC, id) AS INT) AS place FROM ({_ACCENTED})""")
def names_by_locale(spark, d):
    from pyspark.sql import Window

    return _named(spark, d).select("id", "name", F.row_number().over(Window.partitionBy("nation").orderBy(*views.by_name(), "id")).alias("place"))


@query(f"SELECT id, name FROM ({_ACCENTED}) WHERE contains(lower(strip_accents(name)), 'an') OR contains(lower(strip_accents(name)), 'zoe')")
def names_searched(spark, d):
    rows = _named(spark, d)
    return views.search_names(rows, "ÁN").select("id", "name").unionByName(views.search_names(rows, "Zoê").select("id", "name"))


@query(f"SELECT min(name) AS name, count(*) AS n FROM ({_ACCENTED}) GROUP BY name COLLATE NOCASE.NOACCENT")
def names_distinct(spark, d):
    return views.distinct_names(_named(spark, d))


# -- a skill graph with a node for each part, in three spellings
_SPELLED = "CASE l_partkey % 4 WHEN 0 THEN 'Part-' || l_partkey WHEN 1 THEN 'Old.Name ' || l_partkey WHEN 2 THEN 'PART ' || l_partkey ELSE 'Unheard ' || l_partkey END"
_OWNED = f"SELECT DISTINCT o_custkey AS id, l_partkey AS k, {_SPELLED} AS skill FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_NODES = "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 2 THEN 'part_' || p_partkey ELSE 'node' || p_partkey END AS key FROM part"
_WANTED_PARTS = "SELECT k, 'Part/' || k AS jd_skill FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 < 2 AND p_partkey % 50 < 2)"


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    key = F.when(k % 4 == 2, text("part_", k)).otherwise(text("node", k))
    aliases = F.when(k % 4 < 2, F.array(text("part", k), text("old name ", k))).otherwise(F.array().cast("array<string>"))
    return load(spark, d, "part").select(k.alias("at"), key.alias("key"), aliases.alias("aliases"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """A part implies the next one, every third; it is related to the one after, every fifth, both ways."""
    nodes = graph_nodes(spark, d).select("at", "key")
    ahead = lambda n, every, kind: nodes.filter(F.col("at") % every == 0).join(nodes.select((F.col("at") - n).alias("at"), F.col("key").alias("dst")), "at").select(F.col("key").alias("src"), "dst", F.lit(kind).alias("kind"))
    related = ahead(2, 5, "related")
    return ahead(1, 3, "implies").unionByName(related).unionByName(related.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))


@query(f"""WITH h AS ({_OWNED}), w AS ({_WANTED_PARTS}), known AS (SELECT h.* FROM h JOIN part ON p_partkey = k WHERE k % 4 < 3),
 m AS (SELECT h.id, w.jd_skill, h.skill, CASE WHEN h.k = w.k AND h.k % 4 = 0 THEN 1 WHEN h.k = w.k THEN 2 WHEN w.k = h.k + 1 AND h.k % 3 = 0 THEN 3
   WHEN (w.k = h.k + 2 AND h.k % 5 = 0) OR (w.k = h.k - 2 AND w.k % 5 = 0) THEN 4 END AS p FROM known h JOIN w ON w.k BETWEEN h.k - 2 AND h.k + 2),
 n AS (SELECT h.id, w.jd_skill, h.skill, 1 AS p FROM (SELECT *, translate(regexp_replace(lower(skill), '[ ./-]', '', 'g'), '', '') AS f FROM h) h JOIN (SELECT *, 'part' || k AS f FROM w) w ON contains(h.f, w.f) OR contains(w.f, h.f)),
 a AS (SELECT *, row_number() OVER (PARTITION BY id, jd_skill ORDER BY p, skill) AS r FROM (SELECT * FROM m WHERE p IS NOT NULL UNION ALL SELECT * FROM n))
 SELECT id, jd_skill, skill AS source, ['explicit', 'alias', 'inferred', 'related'][p] AS match_type FROM a WHERE r = 1""")
def graph_inference(spark, d):
    """Parts that customers ordered against requested ones, through a graph with a node for each part."""
    lines, orders = load(spark, d, "lineitem"), load(spark, d, "orders")
    owned = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), F.expr(_SPELLED).alias("skill")).distinct().withColumn("pos", F.lit(0))
    ensure_checkpoint_dir(spark)
    owned = owned.checkpoint()  # read for the names, the pairs and the graph's keys
    k = F.col("p_partkey")
    wanted = load(spark, d, "part").filter((k % 4 < 2) & (k % 50 < 2)).select(F.lit(1).alias("jd_id"), F.lit(0).alias("jd_pos"), F.concat(F.lit("Part/"), k.cast("string")).alias("jd_skill"))
    found = matching.infer(owned, wanted, graph_edges(spark, d), nodes=graph_nodes(spark, d))
    return found.select("id", "jd_skill", "source", "match_type")


@query("""SELECT skill, CASE p_partkey % 4 WHEN 2 THEN 'part_' ELSE 'node' END || p_partkey AS key FROM part, (SELECT unnest(['Part-', 'OLD NAME ', 'old/name.', 'part ', 'Part_']) AS form), LATERAL (SELECT form || p_partkey AS skill)
  WHERE p_partkey % 4 < 2 AND form <> 'Part_' OR p_partkey % 4 = 2 AND form IN ('part ', 'Part_')""")
def graph_key_lookup(spark, d):
    """The node of a graph that a spelling stands for, for five spellings of each part."""
    forms = F.explode(literals.array(("Part-", "OLD NAME ", "old/name.", "part ", "Part_"))).alias("form")
    skills = load(spark, d, "part").select("p_partkey", forms).select(F.concat("form", F.col("p_partkey").cast("string")).alias("skill"))
    return matching.graph_keys(skills, graph_nodes(spark, d))


# -- garbled names
@query()
def fuzzy_dictionary(spark, d):
    """Garbled names of parts, and the name that each is most like (no SQL: tests hold it against all pairs)."""
    part, k, name = load(spark, d, "part"), F.col("p_partkey"), F.col("p_name")
    typed = F.when(k % 3 == 0, F.replace(name, F.lit("e"), F.lit("o"))).when(k % 3 == 1, F.concat(name, F.lit("s"))).otherwise(F.substr(name, F.lit(1), F.length(name) - 2))
    names = part.select(F.col("p_name").alias("canonical"), F.lower("p_name").alias("lower")).distinct()
    return parse.fuzzy_names(part.select(typed.alias("raw")), names).withColumn("ratio", F.round("ratio", 6))
