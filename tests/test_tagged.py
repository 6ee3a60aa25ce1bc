"""Tagged text, sidebars and spans, worked out by hand."""

from pyspark.sql import functions as F

from sieverank.operators import layout
from sieverank.operators import tagged as T

MAIN = """[PROFILE]
Chef with [DATE]x[/DATE] ten years
[EMPLOYMENT HISTORY]
[DATE]Jan 2001 - Feb 2002[/DATE]
[JOB_TITLE]Nutritional Consultant (Part-Time) , WIC  Port Washington  ||LOC:Port Washington[/JOB_TITLE]
[DATE]Jan 2021 — Present[/DATE]
plain description
goes on
[BULLET]• First bullet[/BULLET]
continues
[BULLET]- Second[/BULLET]
[JOB_TITLE]DaVita Delmas[/JOB_TITLE]
late body
[DATE]Jan 2020 - Feb 2021[/DATE]
[JOB_TITLE]Education[/JOB_TITLE]
[EDU_LINE]Master of Science in Dietary Education, Golden Valley  ||LOC:Golden Valley[/EDU_LINE]
[JOB_TITLE]University[/JOB_TITLE]
[DATE]Aug 2015 – May 2017[/DATE]
[JOB_TITLE]Associates Degree in Nutrition, St. Louis University Louisville  ||LOC:Louisville[/JOB_TITLE]
[EDU_LINE]No school word here[/EDU_LINE]
[COURSES]
[JOB_TITLE]Certified Head Nutrition Consultant , Food Sciences[/JOB_TITLE]
[JOB_TITLE]Council  ||LOC:Paris[/JOB_TITLE]
[DATE]Jul 2021 — Jul 2021[/DATE]
[AWARDS]
[BULLET]* won[/BULLET]
twice
[ACCOMPLISHMENTS]
[BULLET]also[/BULLET]
[SKILLS]
Python, Go
[PROJECTS]
[JOB_TITLE]Shop[/JOB_TITLE]
[DATE]Jul 2020 - Now[/DATE]
[SKILLS]
Rust
"""
SIDE = """hello@x.org
[ADDRESS]
12 Main St
Paris
[PHONE]
5551234567
[SKILLS]
Kitchen equipment
operation
,
Cooking, Baking
[LINKS]
LinkedIn
linkedin
Pinterest
[GITHUB]
g.example
[LANGUAGES]
English; French, German
"""


def test_assemble(spark):
    rows = [(1, "[NAME]Ann\nLee[/NAME]\n[TITLE] Chef [/TITLE]", SIDE, MAIN, "clash"), (2, None, None, None, None), (2, "", "", "", ""), (None, "", "902 Elm\nOH 12345 x\nIndia", "x", "")]
    df = spark.createDataFrame(rows, "doc_id long, header_text string, sidebar_text string, main_text string, employment string")
    found = T.assemble(df).collect()
    one = next(r for r in found if r.id == 1).asDict(True)
    assert one["personal_info"] == {"name": "Ann\nLee", "title": "Chef", "address": "12 Main St, Paris", "phone": "5551234567", "email": "hello@x.org", "place_of_birth": None, "driving_license": None, "links": ["LinkedIn", "g.example"]}
    assert one["profile"] == "Chef with  ten years"
    assert (one["skills_raw"], one["languages"], one["hobbies"]) == (["Kitchen equipment operation", "Cooking", "Baking"], ["English", "French", "German"], [])
    job = dict(role="Nutritional Consultant (Part-Time)", company="WIC", location="Port Washington", start="Jan 2021", end="Present", description="plain description goes on", achievements=["First bullet continues", "Second"])
    assert one["employment"] == [job, dict(role="DaVita Delmas", company=None, location=None, start=None, end=None, description="late body", achievements=[])]
    assert one["education"] == [
        dict(degree="Master of Science", field="Dietary Education", institution="Golden Valley University", location="Golden Valley", start="Aug 2015", end="May 2017"),
        dict(degree="Associates", field="Nutrition", institution="St. Louis University", location="Louisville", start=None, end=None),
        dict(degree=None, field=None, institution=None, location=None, start=None, end=None),
    ]
    assert one["courses"] == [dict(name="Certified Head Nutrition Consultant Food Sciences Council", issuer="Paris", start="Jul 2021", end="Jul 2021")]
    assert one["accomplishments"] == ["won twice", "also"]
    assert (one["skills_section_text"], one["projects_raw_text"]) == ("Rust", "Shop\nJul 2020 - Now")  # [SKILLS] begins anew
    empty = [r for r in found if r.id == 2]
    assert len(empty) == 2 and all(r.employment is None and r.profile is None and r.skills_raw == [] for r in empty)
    assert next(r for r in found if r.id is None).personal_info.address == "902 Elm, OH 12345 x, India"
    assert T.assemble(df.limit(0)).count() == 0


def test_a_long_section(spark):
    lines = "\n".join(f"[JOB_TITLE]Clerk {i}, Shop[/JOB_TITLE]\n[BULLET]sold {i}[/BULLET]\nmore" for i in range(3000))
    df = spark.createDataFrame([(1, "", "", "[EXPERIENCE]\n" + lines)], "doc_id long, header_text string, sidebar_text string, main_text string")
    jobs = T.assemble(df).first().employment
    assert len(jobs) == 3000 and jobs[2999].role == "Clerk 2999" and jobs[17].achievements == ["sold 17 more"]


def test_split_by_sidebar(spark):
    rows = [
        ("Profile\nSkills / Tools\nEducation", "me\na@b\nl1\nl2\nl3\nl4\nl5", ""),
        ("Profile\nSkills", "SUMMARY\nx\ny\nSkills\nz\nSummary\nw", "top"),
        ("Skills\nskills", "a\nb", ""),
        (None, None, None),
        ("Profile\nSkills", None, None),
        ("Profile\nSkills\nAwards", "one", ""),
    ]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(rows, "s string, m string, f string").select(T.split_by_sidebar(F.col("s"), F.col("m"), F.col("f"))).collect()]
    assert got == [[("summary", "l1"), ("skills", "l2"), ("education", "l3\nl4\nl5")], [("summary", "x\ny\nw"), ("skills", "z")], [], [], [], [("summary", "one")]]


def test_sidebar_education(spark):
    text = "x [EDUCATION]\nMBA: DIATM, MAKAUT (PURSUING)\nBCA: MID\nCGPA: 7.0\nClass 12th: HIGH SCHOOL, [WBBSE]\nGPA: 81%\nClass 10th:\nMBA: consumed,\nCBSE\nScore 9\nnone\n[SKILLS]\nMBA: no"
    got = [r[0] for r in spark.createDataFrame([(text,), ("",), (None,), ("MBA: x",)], "s string").select(T.sidebar_education(F.col("s"))).collect()]
    assert [tuple(x) for x in got[0]] == [
        ("MBA (Pursuing)", "DIATM, MAKAUT", "Present", None),
        ("BCA", "MID", None, "7.0"),
        ("Class 12th", "HIGH SCHOOL,", None, "81%"),
        ("Class 10th", "MBA: consumed, CBSE", None, "9"),
    ]
    assert got[1:] == [[], [], []]


def test_words_of_spans(spark):
    rows = [(1, 0, 0, " ab  c ", 10.0, 0.0, 80.0, 9.0, "X-Bold", 9.0), (1, 0, 1, "P R O  F I L", 0.0, 0.0, 70.0, 9.0, None, None), (1, 0, 2, "(cid:1)", 0.0, 0.0, 1.0, 1.0, "", 1.0), (None, 0, 3, None, 0.0, 0.0, 1.0, 1.0, "", 1.0), (1, 0, 4, "one", 1.0, 0.0, None, 9.0, "", 1.0)]
    spans = spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double")
    got = [(r.seq, r.text, r.x0, r.x1, r.bold, r.size) for r in layout.words_of_spans(spans).collect()]
    assert got == [(0, "ab", 20.0, 40.0, True, 9.0), (0, "c", 60.0, 70.0, True, 9.0), (1, "PRO", 0.0, 30.0, False, 0.0), (1, "FIL", 40.0, 70.0, False, 0.0), (4, "one", 1.0, None, False, 1.0)]


def test_spaced_letters_only_in_spans_that_may_hold_them(spark, tmp_path):
    from sieverank.plans import profiles

    spark.createDataFrame([(1, "Ü ä. one two. a  b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = profiles.span_lines(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.line, r.text) for r in lines) == [(1, 0, "Ü ä"), (1, 1, "one two"), (1, 2, "a b")]
    assert [(r.n_words, r.width) for r in profiles.span_words(spark, str(tmp_path)).collect()] == [(6, 80.0)]


def test_records_of_tagged_pages(spark):
    from sieverank import registries as R
    from sieverank.plans import extraction

    rows = [
        (1, "[NAME]Ann Lee[/NAME]", SIDE, MAIN),
        (2, "Bob Ray\nbob@example.com", "[EDUCATION]\nMBA: Oslo (PURSUING)\n[SKILLS]\nPython", "EXPERIENCE\nLead, Acme\nMar 2018 - Apr 2020"),
        (3, None, None, None),
        (None, "x", "y", "z"),
    ]
    pages = spark.createDataFrame(rows, "doc_id long, header_text string, sidebar_text string, main_text string")
    got = {r.id: r for r in extraction.extract_tagged(pages, R.section_headers(spark)).collect()}
    assert set(got) == {1, 2, 3}
    one, two, three = got[1], got[2], got[3]
    assert (one.personal_info.name, one.personal_info.email, one.personal_info.location) == ("Ann Lee", "hello@x.org", "12 Main St, Paris")
    assert tuple(one.sources) == ("tags", "tags", "tags") and one.experience[0].company == "WIC" and one.education[0].degree == "Master of Science in Dietary Education"
    assert one.skills[:3] == ["Kitchen equipment operation", "Cooking", "Baking"] and one.certifications[0].date == "Jul 2021" and one.languages == ["English", "French", "German"]
    assert two.sources.experience == "text" and two.sources.education == "sidebar" and [(e.degree, e.end) for e in two.education] == [("MBA (Pursuing)", "Present")]
    assert two.experience[0].role == "Lead" and two.personal_info.email == "bob@example.com" and "Python" in two.skills
    assert three.experience == [] and three.education == [] and three.summary is None and tuple(three.sources) == (None, None, None)
    assert extraction.extract_tagged(pages.limit(0), R.section_headers(spark)).count() == 0
