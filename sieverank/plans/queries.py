"""Registered queries: each applies one operator to a whole table, with the same result in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieverank import registries as R
from sieverank.functions import dates, text
from sieverank.operators import bonus, classify, dedup, evaluate, extract, intervals, layout, matching, record, relevance, sections, store, views
from sieverank.plans import audits, extraction, fixtures, profiles, ranking, scoring
from sieverank.session import load
from sieverank.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(rows, names: str) -> str:
    """An inline table for the SQL side."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, dt.date):
            return f"DATE '{v}'"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


def half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


TERMS = ("the", "tion", "de")
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_TF = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(TERMS))
_DF = ", ".join(f"sum(CAST(tf{i} > 0 AS INT)) AS df{i}" for i in range(3))
_IDF = [f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1.0)" for i in range(3)]
_BM25 = " + ".join(f"{_IDF[i]} * tf{i} * 2.5 / (tf{i} + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(3))
BM25_SQL = f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), c AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS dl, {_TF} FROM t),
 a AS (SELECT count(*) AS n, avg(dl) AS avgdl, {_DF} FROM c)
 SELECT doc_id AS id, {half_up(f"least(({_BM25}) / ({' + '.join(_IDF)}) * 100, 100.0)", 6)} AS score FROM c, a"""


@query(BM25_SQL)
def bm25_documents(spark, d):
    return relevance.bm25_terms(load(spark, d, "documents"), list(TERMS))


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM ({BM25_SQL})) WHERE rank <= 10")
def bm25_top10(spark, d):
    return relevance.top_k(bm25_documents(spark, d), 10)


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOKENS})) AS BIGINT) AS n_distinct FROM documents")
def token_totals(spark, d):
    w = text.tokenize(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


_VEC = f"SELECT id, token, count(*) / max(n) AS tf FROM (SELECT item_id AS id, len({TOKENS}) AS n, unnest({TOKENS}) AS token FROM benchmark) GROUP BY id, token"


@query(f"SELECT id, token, {half_up('tf', 9)} AS tf FROM ({_VEC})")
def tf_vectors(spark, d):
    return relevance.tf_vectors(load(spark, d, "benchmark"), "item_id", "text").withColumn("tf", text.round_half_up(F.col("tf"), 9))


@query(f"""WITH v AS ({_VEC}), q AS (SELECT * FROM v WHERE id % 50 = 0), n AS (SELECT id, sqrt(sum(tf * tf)) AS a FROM v GROUP BY id)
 SELECT v.id, q.id AS other, {half_up('sum(v.tf * q.tf) / (max(n.a) * max(m.a))', 6)} AS sim FROM v JOIN q USING (token) JOIN n ON n.id = v.id JOIN n m ON m.id = q.id GROUP BY v.id, q.id""")
def tf_cosine_pairs(spark, d):
    v = relevance.tf_vectors(load(spark, d, "benchmark"), "item_id", "text")
    return relevance.tf_cosine(v, v.filter("id % 50 = 0"))


@query(f"SELECT doc_id, lower(regexp_extract(text, '{text.EMAIL}')) AS email FROM documents WHERE regexp_matches(text, '{text.EMAIL}')")
def email_extract(spark, d):
    return load(spark, d, "documents").select("doc_id", text.email(F.col("text")).alias("email")).filter("email is not null")


_PHONE = ", ".join(f"nullif(regexp_extract(text, '{p}'), '')" for p in text.PHONES)


@query(f"SELECT * FROM (SELECT doc_id, coalesce({_PHONE}) AS phone FROM documents) WHERE phone IS NOT NULL")
def phone_extract(spark, d):
    return load(spark, d, "documents").select("doc_id", text.phone(F.col("text")).alias("phone")).filter("phone is not null")


@query(r"""WITH c AS (SELECT doc_id, text, regexp_replace(text, '\[/?[A-Z_]+\]', '', 'g') AS c FROM documents),
 m AS (SELECT doc_id, text, c, length(c) AS n, length(regexp_replace(c, '[^\p{L}]', '', 'g')) / length(c) AS letters, length(regexp_replace(c, '[\t\n\f\r\v ]+', '', 'g')) AS nb,
  len(list_filter(regexp_split_to_array(c, '[\t\n\f\r\v ]+'), lambda x: x <> '')) AS words, length(regexp_replace(c, '[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) / length(c) AS control,
  least(len(regexp_extract_all(c, '\(cid:\d+\)')) * 0.1, 0.5) AS cid, least(len(regexp_extract_all(c, '[^a-zA-Z\t\n\f\r\v ,.\-:;()]{3,}')) * 0.02, 0.3) AS signs FROM c)
 SELECT doc_id, CASE WHEN length(text) >= 10 AND nb > 0 THEN floor(greatest(least(CAST(1.0 AS DOUBLE) - CASE WHEN letters < 0.4 THEN 0.5 WHEN letters < 0.6 THEN 0.2 ELSE 0.0 END - CASE WHEN nb / words < 2 THEN 0.3 WHEN nb / words < 3 THEN 0.1 ELSE 0.0 END
  - control * 2 - CAST(cid AS DOUBLE) - CAST(signs AS DOUBLE), 1.0), 0.0) * 100 + 0.5) / 100 ELSE 0.0 END AS text_quality FROM m""")
def text_quality(spark, d):
    return load(spark, d, "documents").select("doc_id", text.text_quality(F.col("text")).alias("text_quality"))


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(regexp_replace(text, '\[/?[A-Z_]+\]', '', 'g'), '[a-zA-Z]{3,}') AS w FROM documents),
 s AS (SELECT doc_id, text, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(lower(x), '[aeiou]') AND NOT regexp_matches(lower(x), '[^aeiou]{6,}') AND NOT (length(x) - 2 > 2 AND length(regexp_replace(substr(x, 2, length(x) - 2), '[^A-Z]', '', 'g')) > (length(x) - 2) * 0.3))) AS ok FROM w)
 SELECT doc_id, CAST(CASE WHEN length(text) < 20 THEN 0.0 WHEN n < 5 THEN 0.5 WHEN ok / n >= 0.8 THEN 1.0 WHEN ok / n >= 0.6 THEN 0.7 WHEN ok / n >= 0.5 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS semantic_quality FROM s""")
def semantic_quality(spark, d):
    return load(spark, d, "documents").select("doc_id", text.semantic_quality(F.col("text")).alias("semantic_quality"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[/?[A-Z_]+\]', '', 'g'), '\(cid:\d+\)', '', 'g'), '[^\x20-\x7E\n\t]', ' ', 'g'),
 '[^A-Za-z0-9_\t\n\f\r\v .,;:!?\-''"()/&@#+%]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\t\n\f\r\v ]+|[\t\n\f\r\v ]+$', '', 'g')) AS clean_sha256 FROM documents""")
def clean_for_ranking(spark, d):
    return load(spark, d, "documents").select("doc_id", text.content_hash(text.clean_for_ranking(F.col("text"))).alias("clean_sha256"))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents")
def exact_dedup(spark, d):
    return dedup.exact_duplicates(load(spark, d, "documents"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def dedup_audit(spark, d):
    return dedup.duplicate_groups(load(spark, d, "documents"))


@query("SELECT c_custkey AS id, sha256(lower(c_name) || '|' || array_to_string(list_sort(list_distinct([lower(c_mktsegment), 'b', 'a'])), ',')) AS fingerprint FROM customer")
def profile_fingerprints(spark, d):
    skills = F.transform(F.array("c_mktsegment", F.lit("b"), F.lit("a"), F.lit("B")), lambda s: F.lower(s))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), dedup.profile_fingerprint(F.col("c_name"), skills).alias("fingerprint"))


@query(None)
def duplicate_blocks(spark, d):
    out = dedup.drop_repeated_blocks(load(spark, d, "documents"))
    return out.select("id", text.content_hash(F.col("text")).alias("sha256"))


# -- matching
_HAVE = """have AS (SELECT DISTINCT o_custkey AS id, unnest([p_name, p_brand, p_type]) AS skill FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_WANTED = f"wanted AS (SELECT * FROM {values(fixtures.WANTED, 'jd_id, jd_pos, jd_skill, must')})"
_NORM = "translate(regexp_replace(trim(lower({})), '\\.js$', 'js'), '.-/ ', '')"
_MATCH = f"({_NORM.format('skill')} = {_NORM.format('jd_skill')} OR (length({_NORM.format('skill')}) > 2 AND length({_NORM.format('jd_skill')}) > 2 AND (contains({_NORM.format('skill')}, {_NORM.format('jd_skill')}) OR contains({_NORM.format('jd_skill')}, {_NORM.format('skill')}))))"
_PAIRS = f"{_HAVE}, {_WANTED}, pairs AS (SELECT id, skill, jd_id, jd_pos, jd_skill, must FROM have, wanted WHERE {_MATCH})"


@query(f"""WITH {_PAIRS}, ids AS (SELECT DISTINCT id FROM have)
 SELECT ids.id, CAST(w.jd_id AS INT) AS jd_id, CAST(w.jd_pos AS INT) AS jd_pos, w.jd_skill, EXISTS (SELECT 1 FROM pairs p WHERE p.id = ids.id AND p.jd_id = w.jd_id AND p.jd_skill = w.jd_skill) AS found FROM ids, wanted w""")
def skill_matches(spark, d):
    have = fixtures.have(spark, d)
    return matching.matched(have, fixtures.wanted(spark), have)


@query(f"WITH {_HAVE}, {_WANTED}, used AS (SELECT DISTINCT skill FROM (SELECT DISTINCT skill FROM have), wanted WHERE {_MATCH}) SELECT id, skill, 0 AS pos FROM have WHERE skill NOT IN (SELECT skill FROM used)")
def extra_skills(spark, d):
    return matching.extra_skills(fixtures.have(spark, d), fixtures.wanted(spark)).select("id", "skill", "pos")


_ALIAS_NAMES = sorted(R.SKILL_ALIASES)
_ALIASES = values(sorted(R.SKILL_ALIASES.items()), "alias, canonical")
_SPELLED = f"upper([{', '.join(repr(a) for a in _ALIAS_NAMES)}][p_partkey % {len(_ALIAS_NAMES)} + 1]) || CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN ' x' ELSE '' END"


@query(f"""WITH c AS (SELECT p_partkey AS id, {_SPELLED} AS skill FROM part), n AS (SELECT *, {_NORM.format('skill')} AS normal FROM c)
 SELECT id, skill, coalesce(canonical, normal) AS canonical FROM n LEFT JOIN {_ALIASES} ON alias = normal""")
def alias_resolve(spark, d):
    key = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(a) for a in _ALIAS_NAMES]), (key % len(_ALIAS_NAMES) + 1).cast("int"))
    skill = F.concat(F.upper(name), F.when(key % 3 == 0, "-").when(key % 3 == 1, " x").otherwise(""))
    rows = load(spark, d, "part").select(key.alias("id"), skill.alias("skill"))
    return rows.select("id", "skill", matching.resolve(text.normalize_skill(F.col("skill"))).alias("canonical"))


INFER_NAMES = ("Django", "MySQL", "Kotlin", "Typescript", "Docker", "Photoshop", "Flask", "PyTorch")
INFER_WANTED = ((1, 0, "Python"), (1, 1, "PostgreSQL"), (1, 2, "Java"), (1, 3, "Kubernetes"), (1, 4, "JavaScript"), (1, 5, "TensorFlow"))
_EDGES = values([(a, b, "implies") for a, b in R.IMPLIES] + [x for a, b in R.RELATED for x in ((a, b, "related"), (b, a, "related"))], "src, dst, kind")


@query(f"""WITH have AS (SELECT DISTINCT o_custkey AS id, CAST(o_orderkey % 8 AS INT) AS pos, [{', '.join(repr(n) for n in INFER_NAMES)}][o_orderkey % 8 + 1] AS skill FROM orders),
 asked AS (SELECT * FROM {values(INFER_WANTED, 'jd_id, jd_pos, jd_skill')}),
 m AS (SELECT *, 'explicit' AS match_type, 1 AS priority FROM have, asked WHERE contains(lower(skill), lower(jd_skill)) OR contains(lower(jd_skill), lower(skill))
  UNION ALL SELECT h.*, w.*, CASE kind WHEN 'implies' THEN 'inferred' ELSE 'related' END, CASE kind WHEN 'implies' THEN 3 ELSE 4 END FROM have h JOIN {_EDGES} ON src = lower(skill) JOIN asked w ON dst = lower(jd_skill)),
 b AS (SELECT *, row_number() OVER (PARTITION BY id, jd_skill ORDER BY priority, pos, skill) AS n FROM m)
 SELECT id, CAST(jd_id AS INT) AS jd_id, CAST(jd_pos AS INT) AS jd_pos, jd_skill, skill AS source, match_type, CAST(CASE priority WHEN 1 THEN 1.0 WHEN 3 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS weight FROM b WHERE n = 1""")
def skill_inference(spark, d):
    at = F.col("o_orderkey") % 8
    skill = F.element_at(F.array(*[F.lit(n) for n in INFER_NAMES]), (at + 1).cast("int"))
    have = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), at.cast("int").alias("pos"), skill.alias("skill")).distinct()
    asked = spark.createDataFrame([*INFER_WANTED], "jd_id int, jd_pos int, jd_skill string")
    return matching.infer(have, asked, R.skill_edges(spark))


_IDF_SQL = f"""{_PAIRS}, n AS (SELECT count(DISTINCT id) AS n FROM have), df AS (SELECT jd_id, jd_skill, count(DISTINCT id) AS df FROM pairs GROUP BY ALL),
 idf AS (SELECT w.jd_id, w.jd_skill, coalesce(df, 0) AS df, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1.0) AS idf FROM (SELECT DISTINCT jd_id, jd_skill FROM wanted) w LEFT JOIN df USING (jd_id, jd_skill), n)"""
_BM_SQL = f"""{_IDF_SQL}, dl AS (SELECT id, CAST(count(*) AS DOUBLE) AS dl FROM have GROUP BY id), tf AS (SELECT jd_id, id, jd_skill, CAST(count(*) AS DOUBLE) AS tf FROM pairs GROUP BY ALL),
 bm AS (SELECT jd_id, id, least(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avg(dl) FROM dl)))) / max(best) * 100, 100.0) AS raw
  FROM tf JOIN idf USING (jd_id, jd_skill) JOIN dl USING (id) JOIN (SELECT jd_id, sum(idf) AS best FROM idf GROUP BY jd_id) USING (jd_id) GROUP BY jd_id, id)"""


@query(f"WITH {_IDF_SQL} SELECT CAST(jd_id AS INT) AS jd_id, jd_skill, df, {half_up('idf', 6)} AS idf FROM idf")
def skill_idf(spark, d):
    have, asked = fixtures.have(spark, d), fixtures.wanted(spark)
    return relevance.skill_idf(have, matching.match_pairs(have, asked), asked).withColumn("idf", text.round_half_up(F.col("idf"), 6))


@query(f"WITH {_BM_SQL} SELECT CAST(jd_id AS INT) AS jd_id, id, {half_up('raw', 6)} AS score FROM bm")
def bm25_skills(spark, d):
    have, asked = fixtures.have(spark, d), fixtures.wanted(spark)
    return relevance.bm25_skills(have, matching.match_pairs(have, asked), asked).select("jd_id", "id", text.round_half_up(F.col("raw"), 6).alias("score"))


# -- dates and intervals
_SPANS = "spans AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 90 AS e FROM orders)"
_UNION = f"""{_SPANS}, r AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r),
 years AS (SELECT id, {half_up('sum(days) / 365.25', 1)} AS total_years FROM (SELECT id, island, max(e) - min(s) AS days FROM g GROUP BY id, island) GROUP BY id)"""


@query(f"WITH {_UNION} SELECT id, total_years FROM years")
def interval_union_years(spark, d):
    return intervals.union_years(fixtures.spans(spark, d))


@query(f"""WITH {_SPANS}, n AS (SELECT *, lead(s) OVER (PARTITION BY id ORDER BY s, e) AS nxt FROM spans), g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, e) AS k FROM n WHERE nxt - e > 180)
 SELECT id, e AS gap_start, CAST(nxt - e AS INT) AS gap_days, CAST((nxt - e) // 30 AS BIGINT) AS gap_months FROM g WHERE k = 1""")
def employment_gap(spark, d):
    return intervals.first_gap(fixtures.spans(spark, d))


@query(f"WITH {_SPANS} SELECT id, max(e) AS latest_end FROM spans GROUP BY id")
def latest_end(spark, d):
    return intervals.latest_end(fixtures.spans(spark, d))


_RECENT = "CASE WHEN d <= 0.5 THEN 100.0 WHEN d <= 2 THEN 85.0 WHEN d <= 5 THEN 60.0 ELSE 30.0 END"


@query(f"WITH {_SPANS} SELECT c_custkey AS id, CAST(CASE WHEN max(e) IS NULL THEN 20.0 ELSE (SELECT {_RECENT} FROM (SELECT (DATE '{fixtures.AS_OF}' - max(e)) / 365.25 AS d)) END AS DOUBLE) AS recency FROM customer LEFT JOIN spans ON id = c_custkey GROUP BY c_custkey")
def recency(spark, d):
    last = intervals.latest_end(fixtures.spans(spark, d))
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(last, "id", "left")
    return rows.select("id", dates.recency_score(F.col("latest_end"), F.col("latest_end").isNotNull(), F.lit(fixtures.AS_OF).cast("date")).alias("recency"))


_FORMS = ("d MMMM yyyy", "MMM yyyy", "MM/yyyy", "yyyy/MM", "MMM''yy", "yyyy", "dd/MM/yyyy")


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 AS form FROM orders)
 SELECT id, CASE form WHEN 0 THEN make_date(year(d), month(d), least(day(d), 28)) WHEN 5 THEN make_date(year(d), 6, 1)
  WHEN 6 THEN CASE WHEN day(d) > 12 THEN make_date(year(d), month(d), least(day(d), 28)) ELSE make_date(year(d), day(d), least(month(d), 28)) END
  ELSE make_date(year(d), month(d), 1) END AS parsed FROM o""")
def parse_dates(spark, d):
    day, form = F.to_date("o_orderdate"), F.col("o_orderkey") % len(_FORMS)
    raw = F.coalesce(*[F.when(form == i, F.date_format(day, f)) for i, f in enumerate(_FORMS)])
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))
    return rows.select("id", dates.parse_date(F.col("raw"), F.lit(fixtures.AS_OF).cast("date")).alias("parsed"))


# -- classification
KEYWORDS = (("prose", 0, "the", 1.0), ("prose", 0, "of", 0.5), ("prosa", 1, "der", 1.0), ("prosa", 1, "und", 1.5), ("prose_fr", 2, "les", 1.25), ("prosa_es", 3, "que", 1.25))
_VOTES = f"votes AS (SELECT doc_id AS id, domain, domain_ord, sum(weight) AS votes FROM documents, {values(KEYWORDS, 'domain, domain_ord, keyword, weight')} WHERE contains(lower(coalesce(text, '')), keyword) GROUP BY ALL)"


@query(f"""WITH {_VOTES}, b AS (SELECT *, sum(votes) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY votes DESC, domain_ord) AS n FROM votes)
 SELECT id, domain, {half_up('CAST(votes AS DOUBLE) / CAST(total AS DOUBLE)', 3)} AS confidence FROM b WHERE n = 1""")
def domain_vote(spark, d):
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(1.0).alias("factor"))
    return classify.vote(classify.keyword_votes(texts, spark.createDataFrame([*KEYWORDS], "domain string, domain_ord int, keyword string, weight double")))


SIGNALS = [("secrets", r"password=|token = ", 2.0), ("licence", r"All rights reserved|Licensed under", 1.5), ("contact", r"\(\d{3}\) \d{3}-\d{4}", 1.0)]
_SIG = [f"least(len(regexp_extract_all(coalesce(text, ''), '{p}')), 3) * {w}" for _, p, w in SIGNALS]


@query(f"""WITH s AS (SELECT doc_id AS id, [{', '.join(f'CAST({x} AS DOUBLE)' for x in _SIG)}] AS s FROM documents)
 SELECT id, CASE WHEN list_sum(s) > 0 THEN ['secrets', 'licence', 'contact'][list_position(s, list_max(s))] ELSE 'unknown' END AS kind, CASE WHEN list_sum(s) > 0 THEN {half_up('list_max(s) / list_sum(s)', 3)} ELSE 0.0 END AS confidence FROM s""")
def doctype_vote(spark, d):
    return classify.pattern_votes(load(spark, d, "documents"), SIGNALS, id_col="doc_id")


_PEN = values([(a, b, p) for a, row in zip(R.DOMAINS, R.PENALTIES, strict=True) for b, p in zip(R.DOMAINS, row, strict=True)], "jd_domain, cand_domain, penalty")
_DOMS = "['" + "','".join((*R.DOMAINS, "education", "unknown")) + "']"
_DPAIRS = f"dp AS (SELECT c_custkey AS id, {_DOMS}[c_custkey % 9 + 1] AS jd_domain, 0.3 + c_custkey % 4 * 0.1 AS jd_conf, {_DOMS}[(c_custkey * 5 + c_nationkey) % 9 + 1] AS cand_domain, 0.9 AS cand_conf FROM customer)"


def _domain_pairs(spark, d):
    names = F.array(*[F.lit(x) for x in (*R.DOMAINS, "education", "unknown")])
    n = F.col("c_custkey")
    jd, own = (n % 9 + 1).cast("int"), ((n * 5 + F.col("c_nationkey")) % 9 + 1).cast("int")
    return load(spark, d, "customer").select(
        n.alias("id"), F.element_at(names, jd).alias("jd_domain"), (F.lit(0.3) + n % 4 * 0.1).alias("jd_conf"), F.element_at(names, own).alias("cand_domain"), F.lit(0.9).alias("cand_conf")
    )


def _free(least: float) -> str:
    return f"jd_domain = cand_domain OR jd_domain = 'unknown' OR cand_domain = 'unknown' OR jd_conf < {least} OR cand_conf < {least}"


@query(f"WITH {_DPAIRS} SELECT id, jd_domain, cand_domain, CAST(CASE WHEN {_free(0.35)} THEN 0 ELSE coalesce(penalty, -50) END AS INT) AS penalty FROM dp LEFT JOIN {_PEN} USING (jd_domain, cand_domain)")
def penalty_lookup(spark, d):
    return classify.with_penalty(_domain_pairs(spark, d), R.domain_penalties(spark), 0.35).select("id", "jd_domain", "cand_domain", "penalty")


@query(f"WITH {_DPAIRS} SELECT id FROM dp LEFT JOIN {_PEN} USING (jd_domain, cand_domain) WHERE CASE WHEN {_free(0.35)} THEN 0 ELSE coalesce(penalty, -50) END > -60")
def domain_prefilter(spark, d):
    return classify.prefilter(_domain_pairs(spark, d), R.domain_penalties(spark)).select("id")


DEGREE_NAMES = ("PhD", "M.Sc", "MBA", "B.Tech", "Diploma", "High School", "10th", "Bachelor of Arts", "member", "")
_LEVEL = " ".join(f"WHEN contains(lower(degree), '{k}') THEN {level}" for k, level in R.DEGREES)


@query(f"""WITH c AS (SELECT c_custkey AS id, [{', '.join(repr(n) for n in DEGREE_NAMES)}][c_custkey % 10 + 1] || ' ' || c_mktsegment AS degree FROM customer)
 SELECT id, CAST(CASE {_LEVEL} ELSE 0 END AS INT) AS level FROM c""")
def degree_levels(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in DEGREE_NAMES]), (F.col("c_custkey") % 10 + 1).cast("int"))
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(name, F.lit(" "), "c_mktsegment").alias("degree"))
    return rows.select("id", classify.degree_level(F.col("degree")).alias("level"))


# -- ranking
_JDS = f"jds AS (SELECT * FROM {values([j[:4] for j in fixtures.JDS], 'jd_id, min_years, max_years, required_level')})"
_KEYS = "keys AS (SELECT * FROM " + values([(j[0], k) for j in fixtures.JDS for k in j[4]], "jd_id, kw") + ")"
_INFER = "met AS (SELECT DISTINCT jd_id, id, jd_skill FROM pairs WHERE must)"
RANK_SQL = f"""WITH {_UNION}, {_BM_SQL}, {_JDS}, {_KEYS}, {_INFER},
 p AS (SELECT c_custkey AS id, c_nationkey % 6 AS level, c_mktsegment AS text FROM customer), last AS (SELECT id, max(e) AS e, count(*) AS entries FROM spans GROUP BY id),
 x AS (SELECT j.jd_id, p.id, coalesce(total_years, 0.0) AS ty, coalesce(entries, 0) AS entries, level, min_years, max_years, required_level, coalesce(raw, 0.0) AS sk,
  (SELECT count(*) FROM wanted w WHERE w.jd_id = j.jd_id AND must) - (SELECT count(*) FROM met WHERE met.jd_id = j.jd_id AND met.id = p.id) AS missing,
  (SELECT count(*) FROM keys WHERE keys.jd_id = j.jd_id) AS nk, (SELECT count(*) FROM keys WHERE keys.jd_id = j.jd_id AND contains(lower(p.text), lower(kw))) AS hk,
  CASE WHEN last.e IS NULL THEN 20.0 ELSE (SELECT {_RECENT} FROM (SELECT (DATE '{fixtures.AS_OF}' - last.e) / 365.25 AS d)) END AS rec
  FROM p CROSS JOIN jds j LEFT JOIN years y ON y.id = p.id LEFT JOIN last ON last.id = p.id LEFT JOIN bm ON bm.id = p.id AND bm.jd_id = j.jd_id),
 s AS (SELECT *, CASE WHEN nk > 0 THEN hk / nk * 100 ELSE 0.0 END AS kw,
  CAST(CASE WHEN min_years = 0 AND max_years >= 99 THEN 100.0 WHEN ty >= min_years AND ty <= max_years THEN 100.0 WHEN ty < min_years THEN ty / min_years * 80.0 ELSE 80.0 END AS DOUBLE) * (0.4e0 / 0.6e0) + CAST(rec AS DOUBLE) * (0.2e0 / 0.6e0) AS ex,
  CAST(CASE WHEN required_level <= 0 OR level >= required_level THEN 100.0 WHEN level = required_level - 1 THEN 60.0 WHEN level > 0 THEN 30.0 ELSE 0.0 END AS DOUBLE) AS ed,
  missing > 0 OR (ty < min_years AND entries < 2 AND 0 < min_years AND ty < min_years * 0.5) OR (max_years < 99 AND ty > max_years) OR (required_level > 0 AND level < required_level) AS ko FROM x),
 f AS (SELECT CAST(jd_id AS INT) AS jd_id, id, ko AS knocked_out, CASE WHEN ko THEN 0.0 ELSE {half_up('least(CASE WHEN nk > 0 THEN sk * 0.4e0 + ex * 0.25e0 + kw * 0.2e0 + ed * 0.15e0 ELSE sk * (0.4e0 / 0.8e0) + ex * (0.25e0 / 0.8e0) + ed * (0.15e0 / 0.8e0) END, 100.0)', 1)} END AS final_score FROM s)
 SELECT *, CAST(row_number() OVER (PARTITION BY jd_id ORDER BY knocked_out, final_score DESC, id) AS INT) AS rank,
  CASE WHEN NOT knocked_out AND max(CASE WHEN NOT knocked_out THEN final_score END) OVER (PARTITION BY jd_id) > 0 THEN {half_up('final_score / max(CASE WHEN NOT knocked_out THEN final_score END) OVER (PARTITION BY jd_id) * 100', 1)} ELSE 0.0 END AS percentile FROM f"""


def _ranked_rows(spark, d, plan):
    args = fixtures.jds(spark), fixtures.people(spark, d), fixtures.have(spark, d), fixtures.wanted(spark), fixtures.spans(spark, d), R.skill_edges(spark)
    return plan(*args, F.lit(fixtures.AS_OF).cast("date"))


@query(RANK_SQL)
def final_rank(spark, d):
    return _ranked_rows(spark, d, ranking.rank).select("jd_id", "id", "knocked_out", "final_score", "rank", "percentile")


@query(f"SELECT * FROM ({RANK_SQL}) WHERE rank <= 20 AND NOT knocked_out")
def top20(spark, d):
    return final_rank(spark, d).filter("rank <= 20 and not knocked_out")


@query(f"SELECT jd_id, id, CASE WHEN knocked_out THEN 'knockout' WHEN final_score >= 75 THEN 'strong' WHEN final_score >= 50 THEN 'good' ELSE 'fair' END AS signal FROM ({RANK_SQL})")
def signal_tiers(spark, d):
    return _ranked_rows(spark, d, ranking.score).select("jd_id", "id", views.signal(F.col("final_score"), F.col("knocked_out")).alias("signal"))


@query(f"SELECT jd_id, count(*) AS n, count_if(knocked_out) AS knocked_out, {half_up('coalesce(avg(CASE WHEN NOT knocked_out THEN final_score END), 0.0)', 3)} AS mean FROM ({RANK_SQL}) GROUP BY jd_id")
def ranking_summary(spark, d):
    rows = _ranked_rows(spark, d, ranking.score)  # counts and means need no ranks
    mean = F.avg(F.when(~F.col("knocked_out"), F.col("final_score")))
    return rows.groupBy("jd_id").agg(F.count("*").alias("n"), F.count_if("knocked_out").alias("knocked_out"), text.round_half_up(F.coalesce(mean, F.lit(0.0)), 3).alias("mean"))


# -- sections on ordered lines
@query("""SELECT conv_id, turn, last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
 FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'q' || turn END AS m FROM conversations)""")
def forward_fill_header(spark, d):
    lines = load(spark, d, "conversations").withColumn("m", F.when(F.col("role") == "user", F.concat(F.lit("q"), F.col("turn").cast("string"))))
    return sections.assign(lines, ["conv_id"], "turn", "m", "section").select("conv_id", "turn", "section")


@query("""WITH e AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations))
 SELECT conv_id, CAST(entry AS BIGINT) AS entry, sha256(string_agg(text, ' ' ORDER BY turn, text)) AS text_sha256 FROM e GROUP BY conv_id, entry""")
def continuation_merge(spark, d):
    lines = load(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct()
    out = sections.merge_continuations(lines, ["conv_id"], "turn", F.col("role") == "user", "text")
    return out.select("conv_id", "entry", text.content_hash(F.col("text")).alias("text_sha256"))


@query("SELECT conv_id, turn, lead(text) OVER w AS next_line, lag(text) OVER w AS previous_line FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_lines(spark, d):
    return sections.with_neighbours(load(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "next_line", "previous_line")


_HEADERS = [(h, k) for k, hs in R.SECTIONS.items() for h in hs]
_HLINE = f"CASE o_orderkey % 5 WHEN 0 THEN upper(h) || ':' WHEN 1 THEN '1. ' || h WHEN 2 THEN h || ' 2020' WHEN 3 THEN h || ' of ' || o_orderstatus ELSE '  ' || h || ' - ' END"


@query(f"""WITH l AS (SELECT o_orderkey AS id, {_HLINE} AS line FROM (SELECT *, [{', '.join(repr(h) for h, _ in _HEADERS)}][o_orderkey % {len(_HEADERS)} + 1] AS h FROM orders)),
 k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '^[^a-z]+', ''), '[:\\-\\s]+$', ''), '\\s+', ' ', 'g')) AS key FROM l)
 SELECT id, line, CASE WHEN len(string_split(key, ' ')) <= 6 AND NOT regexp_matches(line, '[0-9]{{4}}') THEN section END AS section FROM k LEFT JOIN {values(_HEADERS, 'header, section')} ON header = key""")
def section_resolve(spark, d):
    key = F.col("o_orderkey")
    h = F.element_at(F.array(*[F.lit(h) for h, _ in _HEADERS]), (key % len(_HEADERS) + 1).cast("int"))
    form = key % 5
    line = F.when(form == 0, F.concat(F.upper(h), F.lit(":"))).when(form == 1, F.concat(F.lit("1. "), h)).when(form == 2, F.concat(h, F.lit(" 2020")))
    line = line.when(form == 3, F.concat(h, F.lit(" of "), "o_orderstatus")).otherwise(F.concat(F.lit("  "), h, F.lit(" - ")))
    lines = load(spark, d, "orders").select(key.alias("id"), line.alias("line"))
    return sections.resolve_headers(lines, R.section_headers(spark)).select("id", "line", "section")


@query("""WITH s AS (SELECT user_id AS id, event_type AS section, CAST(event_id % 3 AS INT) AS priority, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE props END AS text FROM events)
 SELECT id, section, text FROM (SELECT *, row_number() OVER (PARTITION BY id, section ORDER BY priority, length(text) DESC, text) AS n FROM s WHERE trim(text) <> '') WHERE n = 1""")
def section_merge(spark, d):
    body = F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("props"))
    rows = load(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("section"), (F.col("event_id") % 3).cast("int").alias("priority"), body.alias("text"))
    return sections.merge_sources(rows)


@query("SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\t\\n\\f\\r\\v ]+', ' ', 'g'))) AS sha256, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS BIGINT) AS n_links FROM pages")
def html_strip_links(spark, d):
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long")
    return load(spark, d, "pages").select("page_id", text.content_hash(plain).alias("sha256"), links.alias("n_links"))


# -- evaluation
@query(f"""WITH c AS (SELECT count_if(p AND a) AS tp, count_if(p AND NOT a) AS fp, count_if(NOT p AND a) AS fn, count_if(NOT p AND NOT a) AS tn FROM (SELECT length(text) > 1000 AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)))
 SELECT tp, fp, fn, tn, {half_up('(tp + tn) / (tp + fp + fn + tn)', 6)} AS accuracy, {half_up('tp / (tp + fp)', 6)} AS precision, {half_up('tp / (tp + fn)', 6)} AS recall, {half_up('2 * tp / (2 * tp + fp + fn)', 6)} AS f1 FROM c""")
def confusion_matrix(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.char_length("text").alias("n")).join(load(spark, d, "labels"), "doc_id")
    return evaluate.confusion(rows, F.col("n") > 1000, F.col("quality") == 1)


@query(f"""SELECT field, present, {half_up('present / n * 100', 1)} AS rate FROM (SELECT count(*) AS n, count_if(regexp_matches(text, '{text.EMAIL}')) AS email, count(text) AS text FROM documents) UNPIVOT (present FOR field IN (email, text))""")
def field_rates(spark, d):
    return evaluate.field_rates(load(spark, d, "documents"), {"email": text.email(F.col("text")), "text": F.col("text")})


@query(f"""WITH x AS (SELECT sum(CAST(o_orderkey % 101 AS DOUBLE) * o_totalprice) / sum(o_totalprice) AS x FROM orders)
 SELECT {half_up('x', 1)} AS overall, CASE WHEN x >= 85 THEN 'ready' WHEN x >= 70 THEN 'usable' ELSE 'not ready' END AS verdict FROM x""")
def scorecard(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 101).cast("double").alias("score"), F.col("o_totalprice").alias("weight"))
    return evaluate.scorecard(rows)


# -- tables
@query("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_version(spark, d):
    return store.latest(load(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT user_id, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark, d):
    return progress.status_counts(load(spark, d, "events").withColumnRenamed("event_type", "status"), ("user_id", "status"))


_UP = """SELECT source AS job_id, CAST(doc_id AS VARCHAR) || CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '.pdf' END AS name,
 CASE doc_id % 9 WHEN 0 THEN 'image/png' ELSE 'application/pdf' END AS content_type, n_chars * 1000 AS size, sha256(text) AS content_hash FROM documents"""


@query(f"""WITH u AS ({_UP}), r AS (SELECT *, CASE WHEN NOT ends_with(lower(name), '.pdf') THEN 'not a PDF name' WHEN content_type NOT IN ('application/pdf', 'application/octet-stream') THEN 'not a PDF type'
  WHEN size > {store.MOST_BYTES} THEN 'too large' WHEN size = 0 THEN 'empty' END AS reason FROM u)
 SELECT name, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY job_id, content_hash ORDER BY reason IS NOT NULL, name) > 1 THEN 'duplicate' END) AS reason FROM r""")
def upload_gate(spark, d):
    i = F.col("doc_id")
    name = F.concat(i.cast("string"), F.when(i % 7 == 0, ".txt").when(i % 7 == 1, ".PDF").otherwise(".pdf"))
    kind = F.when(i % 9 == 0, "image/png").otherwise("application/pdf")
    files = load(spark, d, "documents").select(
        F.col("source").alias("job_id"), name.alias("name"), kind.alias("content_type"), (F.col("n_chars") * 1000).alias("size"), text.content_hash(F.col("text")).alias("content_hash")
    )
    return store.upload_gate(files).select("name", "reason")


@query("""WITH t AS (SELECT user_id, max(event_id) AS version, max_by(event_type, event_id) AS status, max(event_id) % 7 AS n FROM events GROUP BY user_id)
 SELECT user_id, version + 1 AS version, 'done' AS status, n FROM t WHERE user_id % 3 <> 0""")
def optimistic_update(spark, d):
    table = load(spark, d, "events").select("user_id", F.col("event_id").alias("version"), F.col("event_type").alias("status"), (F.col("event_id") % 7).alias("n"))
    seen = table.groupBy("user_id").agg(F.max("version").alias("version"))
    expected = F.when(F.col("user_id") % 3 == 0, F.col("version") - 1).otherwise(F.col("version"))  # a third of them are too late
    changes = seen.select("user_id", expected.alias("expected"), F.lit("done").alias("status"), F.lit(None).cast("long").alias("n"))
    return store.optimistic_update(table, changes, ["user_id"])


@query("SELECT c_nationkey AS nation, min(c_custkey) AS id, upper(c_mktsegment) AS segment FROM customer GROUP BY 1, 3")
def distinct_ignoring_case(spark, d):
    spelled = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = load(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), spelled.alias("segment"), F.col("c_custkey").alias("id"))
    return dedup.distinct_ignoring_case(rows, ["nation"], "segment", "id").withColumn("segment", F.upper("segment"))


# -- records: plans whose parts are tested one by one
@query()
def record_rank(spark, d):
    out = scoring.rank_records(fixtures.record_jds(spark), fixtures.records(spark, d), F.lit(fixtures.AS_OF).cast("date"))
    return out.select("jd_id", "id", "knocked_out", "final_score", "domain", "sub_domain", "domain_penalty", "matched_must", "missing_must", "matched_nice", "rank", "percentile")


@query()
def record_prefilter(spark, d):
    return scoring.prefiltered(fixtures.record_jds(spark), fixtures.records(spark, d), F.lit(fixtures.AS_OF).cast("date"))


@query()
def extract_records(spark, d):
    return extraction.extract_records(load(spark, d, "documents"), R.section_headers(spark))


@query()
def extraction_audit(spark, d):
    return extraction.audit(extract_records(spark, d))


_LINE = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"""WITH l AS (SELECT doc_id, trim(line) AS s FROM ({_LINE})), k AS (SELECT doc_id, s, len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) AS w FROM l)
 SELECT doc_id, count_if(regexp_matches(s, '^[a-z]') OR contains(s, '%') OR length(s) > 100 OR regexp_matches(s, '^\\s*[•·▪▸►✓✔*\\-]\\s*') OR w > 12) AS n FROM k GROUP BY doc_id""")
def description_lines(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.count_if(extract.is_description(F.col("line"))).alias("n"))


@query(f"""SELECT doc_id, {half_up("least(6.0, CAST(doc_id % 2 + CASE WHEN regexp_matches(text, '" + text.EMAIL + "') THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 >= 3 THEN 1.0 WHEN doc_id % 5 > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE)) / 6", 2)} AS quality FROM documents""")
def extraction_quality(spark, d):
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    score = record.extraction_quality(F.when(i % 2 == 1, "a name"), text.email(F.col("text")), none, i % 5, F.lit(0), F.lit(0))
    return load(spark, d, "documents").select("doc_id", score.alias("quality"))


@query("""WITH e AS (SELECT o_custkey AS id, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'intern' WHEN 1 THEN '' ELSE 'Lead' END AS role, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_clerk END AS company, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '2019' END AS s FROM (SELECT *, 'Clerk' AS o_clerk FROM orders))
 SELECT id, sum(CAST(0.5 + CASE WHEN role = 'Lead' THEN 2.0 ELSE 0.0 END + CASE WHEN company <> '' THEN 2.0 ELSE 0.0 END + CASE WHEN s <> '' THEN 1.0 ELSE 0.0 END AS DOUBLE)) AS score FROM e GROUP BY id""")
def experience_set_scores(spark, d):
    k = F.col("o_orderkey")
    entry = F.struct(
        F.when(k % 4 == 0, "intern").when(k % 4 == 1, "").otherwise("Lead").alias("role"), F.when(k % 3 == 0, "").otherwise("Clerk").alias("company"), F.when(k % 5 == 0, "").otherwise("2019").alias("start"),
        F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("achievements"),
    )
    rows = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(entry).alias("e"))
    return rows.select("id", record.experience_set_score(F.col("e")).alias("score"))


@query("""WITH c AS (SELECT c_custkey AS id, ['Google India', 'Acme', 'Meta Labs', 'Google UK'][c_custkey % 4 + 1] AS a, ['Acme', 'IBM', 'Google', 'Oracle Corp'][c_nationkey % 4 + 1] AS b FROM customer),
 m AS (SELECT id, list_distinct(list_filter([CASE WHEN contains(a, 'Google') THEN 'google' WHEN contains(a, 'Meta') THEN 'meta' END, CASE b WHEN 'IBM' THEN 'ibm' WHEN 'Google' THEN 'google' WHEN 'Oracle Corp' THEN 'oracle' END], lambda x: x IS NOT NULL)) AS h FROM c)
 SELECT id, CAST(least(len(h) * 2.0, 4.0) AS DOUBLE) AS bonus FROM m""")
def prestige_bonuses(spark, d):
    def pick(names, at):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (at % 4 + 1).cast("int"))

    own = F.array(pick(("Google India", "Acme", "Meta Labs", "Google UK"), F.col("c_custkey")), pick(("Acme", "IBM", "Google", "Oracle Corp"), F.col("c_nationkey")))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), bonus.prestige_bonus(own).alias("bonus"))


@query("""WITH w AS (SELECT event_id, user_id AS doc_id, CAST(event_id % 3 AS INT) AS page, event_id % 9 * 60 AS x0 FROM events WHERE user_id IS NOT NULL),
 s AS (SELECT DISTINCT doc_id, page, CAST(x0 AS DOUBLE) AS x FROM w WHERE x0 BETWEEN 60 AND 450), g AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page ORDER BY x) - x AS gap FROM s),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY gap DESC, x) AS n FROM g WHERE gap >= 20)
 SELECT doc_id, page, x + gap / 2 AS split FROM b WHERE n = 1""")
def column_splits(spark, d):
    e = F.col("event_id")
    words = load(spark, d, "events").filter("user_id is not null").select(F.col("user_id").alias("doc_id"), (e % 3).cast("int").alias("page"), (e % 9 * 60).cast("double").alias("x0"))
    return layout.column_split(words, 600.0)


@query("""SELECT user_id AS job_id, event_id AS document_id, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY user_id) THEN 'complete' ELSE 'progress' END AS type, CAST(row_number() OVER w AS INT) AS current,
 count(*) OVER (PARTITION BY user_id) AS total, sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS succeeded,
 row_number() OVER w - sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def progress_feed(spark, d):
    done = load(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("document_id"), F.col("ts").alias("at"), F.coalesce(F.col("value") > 5, F.lit(False)).alias("ok"))
    return progress.progress_events(done)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship: persons ranked for every request."""
    return final_rank(spark, sf_dir)


def _add(module) -> None:
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)


_add(profiles)
_add(audits)
