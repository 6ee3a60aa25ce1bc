"""Record assembly on one row of cases."""

from pyspark.sql import functions as F

from sieverank.operators import record as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_record(spark):
    lit, empty = F.lit, F.array().cast("array<string>")
    entry = F.struct(lit("Lead").alias("role"), lit("").alias("company"), lit("2019").alias("start"), lit(None).cast("string").alias("description"), empty.alias("achievements"))
    bare = F.struct(lit("").alias("role"), lit("").alias("company"), lit("").alias("start"), lit("x").alias("description"), empty.alias("achievements"))
    r = one(
        spark,
        first=R.first_nonempty(empty, F.array(lit("a"))), longer=R.prefer_longer(lit("ab"), lit("abcdefg")), score=R.experience_set_score(F.array(entry)), best=R.arbitrate(F.array(entry), F.array(bare))[0]["role"],
        header=R.header_score(lit("SKILLS"), lit(True), lit(3)), swap=R.role_or_company(lit("Acme Ltd"), lit("Engineer")), conf=F.array(*[R.name_confidence(lit(x)) for x in ("Resume", "Ann", "Ann Lee")]),
        file=R.name_of_file(lit("/x/CV_ann_LEE.pdf")), reason=F.array(R.missing_name_reason(lit(""), lit(0.0), lit(0.0), lit("")), R.missing_name_reason(lit("x" * 60), lit(1.0), lit(1.0), lit("Ann Lee")), R.missing_name_reason(lit("x" * 60), lit(0.4), lit(1.0), lit(""))),
        dob=R.date_of_birth(lit("DOB: 12/03/1990")), langs=R.human_languages(lit("speaks german, English")), place=F.array(R.plausible_location(lit("Oslo"), lit("Ann")), R.plausible_location(lit("Python, Oslo"), lit("Ann"))),
        sections=R.section_report(F.create_map(lit("skills"), lit("x"), lit("summary"), lit(" ")), F.array(lit("skills"), lit("summary"))), fallback=R.fallback_text(F.create_map(lit("a"), lit("[X]t"), lit("b"), lit(""))),
        skills=R.known_skill_parts(F.array(lit("Java / SQL"), lit("sql"), lit("R & D"), lit("go")), F.array(lit("java"), lit("sql"), lit("go"))), q=R.extraction_quality(lit("a"), lit("b"), lit(None).cast("string"), lit(2), lit(1), lit(0)),
    )
    assert r.first == ["a"] and r.longer == "abcdefg" and r.score == 3.5 and r.best == "Lead" and abs(r.header - 1.0) < 1e-9
    assert tuple(r.swap) == ("Engineer", "Acme Ltd") and r.conf == [0.0, 0.6, 0.95] and r.file == "Ann Lee"
    assert r.reason == ["EMPTY_DOCUMENT", None, "OCR_FAILURE"] and r.dob == "12/03/1990" and r.langs == ["English", "German"] and r.place == ["Oslo", None]
    assert (r.sections.found, r.sections.missing) == (["skills"], ["summary"]) and r.fallback == {"a": "t"}
    assert r.skills == ["Java", "SQL", "go", "R & D"] and r.q == 0.58


def test_links_and_audit(spark):
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "id int, at int, name string")
    x = spark.createDataFrame([(1, 5, "u")], "id int, ord int, uri string")
    assert sorted((r.name, r.link) for r in R.assign_links(p, x).collect()) == [("a", "u"), ("b", None)]
    assert {r.issue: r.n for r in R.audit(p, {"odd": F.col("at") > 0, "none": F.lit(False)}).collect()} == {"odd": 1, "none": 0}
