"""Whole records against requests: a case worked out by hand, knockouts, guard rails, skill pairs, and ranks."""

import pytest
from pyspark.sql import functions as F

from sieverank.operators import scoring as S
from sieverank.plans import scoring as P

RECORD = """id int, name string, skills array<string>, summary string,
 experience array<struct<role:string,company:string,start:string,end:string,description:string,achievements:array<string>>>,
 education array<struct<degree:string,institution:string>>, projects array<struct<name:string,description:string,technologies:array<string>>>,
 certifications array<struct<name:string,issuer:string>>, raw_text_sections map<string,string>, extraction_quality double"""
REQUEST = (1, "Senior Python Backend", "Engineering", "Senior Python backend engineer", ["Python"], ["Docker", "AWS"], 3, 15, "bachelor", "CS", ["backend", "api"], None)


def person(i, skills, role="Backend Developer", description="Built backend APIs", text="5 years of experience in Python backend development", **more):
    entry = {"role": role, "company": "TestCo", "start": "January 2020", "end": "Present", "description": description, "achievements": []}
    return {
        "id": i, "name": f"P{i}", "skills": skills, "summary": None, "experience": [entry], "education": [{"degree": "Bachelor of Computer Science", "institution": "MIT"}],
        "projects": [], "certifications": [], "raw_text_sections": {"full_text": text}, "extraction_quality": 0.8, **more,
    }


def rank(spark, people, jds=(REQUEST,)):
    rows = P.rank_records(spark.createDataFrame([*jds], P.JD), spark.createDataFrame(people, RECORD), F.lit("2026-06-24").cast("date"))
    return {(r.jd_id, r.id): r for r in rows.collect()}


def test_case_by_hand(spark):
    r = rank(spark, [person(1, ["Python", "Docker", "AWS"])])[1, 1]
    assert not r.knocked_out and r.matched_must == ["Python"] and r.total_years == 6.5 and r.rank == 1 and r.percentile == 100.0
    assert (r.domain, r.sub_domain, r.domain_penalty) == ("engineering", "software", -30)
    assert abs(r.skill_score - 70) < 1e-9 and abs(r.experience_score - 84.495) < 1e-2 and r.keyword_score == 50 and r.education_score == 60
    assert r.final_score == 68.1 and r.best_title == "Backend Developer" and r.missing_keywords == ["api"]


def test_knockouts(spark):
    java = person(2, ["Java", "Spring Boot", "Docker"], role="Java Developer", description="Built Java APIs", text="5 years of experience in Java backend development")
    django = person(3, ["Django", "Docker", "PostgreSQL"], text="")
    late = person(4, ["Python"], experience=[{"role": "Dev", "company": "", "start": "2024", "end": "2025", "description": "", "achievements": []}], text="", education=[])
    got = rank(spark, [java, django, late])
    assert got[1, 2].knocked_out and got[1, 2].reasons == ["Missing must-have skills: Python"] and got[1, 2].final_score == 0 and got[1, 2].skill_score > 0
    assert not got[1, 3].knocked_out and got[1, 3].matched_inferred == ["Python"] and [m.explanation for m in got[1, 3].skill_matches][0] == "Python ← inferred from Django"
    assert got[1, 4].reasons[0].startswith("Insufficient experience") and got[1, 4].reasons[1].startswith("Degree")
    assert [got[1, i].rank for i in (3, 2, 4)] == [1, 2, 3]


def test_prefilter_drops_far_domains(spark):
    nurse = person(5, ["Nursing"], role="Staff Nurse", description="clinical work with patients in a hospital", text="")
    jds = spark.createDataFrame([REQUEST], P.JD)
    people = spark.createDataFrame([nurse, person(1, ["Python"])], RECORD)
    gone = P.prefiltered(jds, people, F.lit("2026-06-24").cast("date")).collect()
    assert [(r.id, r.domain) for r in gone] == [(5, "healthcare")]


@pytest.mark.parametrize(
    ("own", "asked", "least", "most"),
    [("Next.js", "React", 0.75, 1), ("NestJS", "Node.js", 0.75, 1), ("Django", "Python", 0.75, 1), ("TypeScript", "JavaScript", 0.75, 1), ("React Native", "React", 0.75, 1), ("Express.js", "Node.js", 0.75, 1),
     ("JS", "JavaScript", 1, 1), ("Docker", "Docker", 1, 1), ("SEO", "Python", 0, 0), ("Nursing", "React", 0, 0), ("Python", "Java", 0, 0)],
)
def test_skill_pairs(spark, own, asked, least, most):
    w = spark.range(1).select(S.weight_of(S.skill_results(S.prepared(F.array(F.lit(own))), S.prepared(F.array(F.lit(asked)))), F.lit(asked)).alias("w")).first().w
    assert least <= w <= most


def test_variants_text_and_bonus(spark):
    r = spark.range(1).select(
        S.search_variants(F.lit("Node.js")).alias("v"), S.search_variants(F.lit("backend")).alias("k"), S.cosine(F.lit("a b b"), F.lit("b c")).alias("c"),
        S.named_in(F.lit("we use k8s and c++"), F.array(F.lit("k8s"), F.lit("c++"))).alias("n"), S.request_subdomain(F.lit("Structural lead"), F.lit(None).cast("string")).alias("sub"),
    ).first()
    assert {"node.js", "nodejs", "node"} <= set(r.v) and "server-side" in r.k and abs(r.c - 2 / 10**0.5) < 1e-12 and r.n and r["sub"] == "civil"
    work = [{"role": "Dev", "company": c, "start": "2019", "end": "2021", "description": "", "achievements": []} for c in ("Google India", "Google UK", "Acme")]
    win = person(7, ["Python"], experience=work, certifications=[{"name": "AWS Cloud Practitioner", "issuer": None}, {"name": "Hackathon winner", "issuer": "x"}], projects=[{"name": "Shop", "description": "in docker", "technologies": ["Python 3"]}])
    got = rank(spark, [win, person(8, [], experience=[], education=[], text="")])
    assert (got[1, 7].prestige_bonus, got[1, 7].cert_bonus, got[1, 7].project_bonus) == (2.0, 1.3, 4.0)
    assert got[1, 8].total_years == 0 and "FRESHER" in got[1, 8].anomalies[0]


def test_empty_and_null_records(spark):
    bare = dict.fromkeys(("name", "skills", "summary", "raw_text_sections", "extraction_quality")) | {"id": 1, "experience": [], "education": [], "projects": [], "certifications": []}
    got = rank(spark, [bare])
    assert got[1, 1].knocked_out and got[1, 1].domain == "unknown"
    people = spark.createDataFrame([], RECORD)
    assert P.rank_records(spark.createDataFrame([REQUEST], P.JD), people, F.lit("2026-06-24").cast("date")).count() == 0
