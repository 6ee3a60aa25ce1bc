"""Fields of records, on one profile and on single cases; odd rows."""

from pyspark.sql import functions as F

from sieverank import registries as R
from sieverank.operators import extract as X
from sieverank.plans import extraction as E

PROFILE = """Jane van Doe | jane@example.com | (555) 123-4567
Springfield, IL
PROFESSIONAL SUMMARY
Nationality: Norwegian
Engineer who has built data systems for many years.
WORK EXPERIENCE
Backend Engineer, Acme Corp
Jan 2019 - Mar 2021
• Built an API with Python and Docker for the shop
• Led a team
Data Analyst at Beta Bank
2016 - 2018
Reports and figures
EDUCATION
Master of Science in Biology, Lund University
2012 - 2014
GPA: 3.8
SKILLS
Languages: Python, SQL, Java/Docker
Vue Redux TypeScript
x
CERTIFICATIONS
- AWS Cloud Practitioner - Amazon
LANGUAGES
English, German"""


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_profile(spark):
    docs = spark.createDataFrame([(1, PROFILE, 7), (2, None, 7), (3, "", 7), (None, "x", 7), (4, "only a line", 7)], "doc_id long, text string, section int")
    got = {r.id: r for r in E.extract_records(docs, R.section_headers(spark)).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[1]
    assert (r.personal_info.name, r.personal_info.email, r.personal_info.location) == ("Jane van Doe", "jane@example.com", "Springfield, IL")
    assert r.summary == "Engineer who has built data systems for many years."
    assert {"Python", "SQL", "Java", "Docker"} <= set(r.skills) and "x" not in r.skills and "TypeScript" in r.skills
    assert [(e.role, e.company, e.start, e.end) for e in r.experience] == [("Backend Engineer", "Acme Corp", "Jan 2019", "Mar 2021"), ("Data Analyst", "Beta Bank", "2016", "2018")]
    assert r.experience[0].achievements == ["Built an API with Python and Docker for the shop", "Led a team"] and r.experience[1].description == "Reports and figures"
    assert [(e.degree, e.institution, e.start, e.end, e.grade) for e in r.education] == [("Master of Science in Biology", "Lund University", "2012", "2014", "3.8")]
    assert [(c.name, c.issuer) for c in r.certifications] == [("AWS Cloud Practitioner", "Amazon")]
    assert r.languages == ["English", "German"] and [p.technologies for p in r.projects] == [["Docker", "Python"]]
    assert r.extraction_quality == 1.0 and r.raw_text_sections["full_text"].startswith("Jane van Doe") and r.raw_text_sections["education"].startswith("Master of Science")
    assert r.status == "EXTRACTED" and got[3].status == got[2].status == "EXTRACTION_FAILED" and got[3].missing_name_reason == "EMPTY_DOCUMENT"
    issues = {x.issue: x.n for x in E.audit(E.extract_records(docs, R.section_headers(spark))).collect()}
    assert issues["failed"] == 2 and issues["no_name"] == 3 and len(issues) == 9
    assert E.extract_records(docs.limit(0), R.section_headers(spark)).count() == 0
    assert E.field_counts(E.extract_records(docs, R.section_headers(spark))).filter("n_experience = 2").count() == 1


def test_names_places_and_skills(spark):
    lit, known = F.lit, F.array(*[F.lit(x) for x in ("python", "sql", "git", "teamwork", "vue", "redux")])
    names = ["Ann Lee", "PROJECT MANAGER", "Work Experience", "Ann", "ann lee", "Tata Services Ltd.", "Maria de Souza", "Python Java", "Ann L33"]
    skills = ["Python", "9ogdegd xx", "hobbies", "es E", "AI", "Xy", "Machine Learning", "pgltnx foo", "Vue Redux Git", "naïve"]
    r = one(
        spark,
        names=F.array(*[X.is_name_line(lit(n)) for n in names]), contact=X.name_of_contact_line(lit("Kiran Malhotra Email : k@m.com")), tail=X.without_location_tail(lit("Acme Corp, Boston, MA")),
        places=F.array(*[X.location(lit(t)) for t in ("12 Main St, Boston, MA 02110", "Address: Oslo Norway", "a@b.co | 938212857 | Mejia", "[ADDRESS]\nLane 4\nOslo\n[X]", "nothing")]),
        skills=X.clean_skills(F.array(*[lit(s) for s in skills]), known), raw=X.raw_skills(lit("DATABASES\nTools: Git, SQL\n• Go • R\nA | Bash")),
        looks=F.array(*[X.looks_like_skill(lit(s)) for s in ("Data Mining", "worked with the team", "12", "Boston, MA", "a''b")]),
        bundles=X.split_bundles(F.array(*[lit(s) for s in ("Vue Redux TypeScript", "Git/SQL", "Teamwork & Sports", "python", "Python", "Plain Talk")]), known),
        joined=X.joined_words(F.array(F.struct(lit("a").alias("text"), lit(0.0).alias("x0"), lit(5.0).alias("x1")), F.struct(lit("b").alias("text"), lit(5.5).alias("x0"), lit(9.0).alias("x1")), F.struct(lit("c").alias("text"), lit(12.0).alias("x0"), lit(15.0).alias("x1")))),
    )
    assert r.names == [True, False, False, False, False, False, True, False, False] and r.contact == "Kiran Malhotra" and r.tail == "Acme Corp"
    assert r.places == ["Main St, Boston", "Oslo Norway", "Mejia", "Lane 4, Oslo", None]
    assert r.skills == ["Python", "AI", "Machine Learning"] and r.raw == ["Git", "SQL", "Go", "Bash"] and r.looks == [True, False, False, False, False]
    assert r.bundles == ["Git", "Python", "Redux", "SQL", "Teamwork", "Vue", "Plain Talk", "Sports", "TypeScript"] and r.joined == "ab c"


def test_entries(spark):
    lit = F.lit
    bad = lambda role, company: F.struct(lit(role).alias("role"), lit(company).alias("company"), lit("2019").alias("start"), lit("2020").alias("end"), lit(None).cast("string").alias("location"), lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("achievements"))
    r = one(
        spark,
        fixed=X.repaired_experience(F.array(bad("Developed a site", "Acme"), bad("Cook at Inn", ""), bad("Dev, Acme, Oslo", ""), bad("", ""), bad("Dev||LOC:Rome", "• Acme"))),
        parts=X.degree_parts(lit("Master of Science in Dietary Education, Golden Valley")), none=X.degree_parts(lit("no such thing")), cut=X.degree_institution(lit("TESOL Masters Degree, Cambridge University 2014")), clean=X.clean_degree(lit("• Completed a Bachelor of Arts||LOC:Rome")),
        certs=X.certifications(lit("• Six Sigma Belt, ASQ\n2019\nabc\nScrum Master")), summary=F.array(X.clean_summary(lit("Gender: x\nshort\nA long enough line of text\nmore")), X.clean_summary(lit("x"))),
        desc=F.array(X.is_description(lit("grew by 5%")), X.is_description(lit("Acme Corp"))), since=X.since_entries(lit("Engineer, Acme since 2015")), kind=X.with_structure(lit("letter"), lit(0.2), lit("Work Experience and Education")),
        found=X.recovered_projects(lit("a\nProjects:\nShop\n- built it\n\nEducation\nz")), projects=X.project_entries(lit("Shop | python\n- sells things https://shop.example.com\n\nBlog site here\ngithub.com/me/blog text"), F.array(lit("python"))),
    )
    assert [(e.role, e.company, e.description) for e in r.fixed] == [(None, "Acme", "Developed a site"), ("Cook", "Inn", None), ("Dev", "Acme, Oslo", None), ("Dev", "Acme", None)]
    assert tuple(r.parts) == ("Master of Science", "Dietary Education", "Golden Valley") and r.none.degree is None and tuple(r.cut) == ("TESOL Masters Degree", "Cambridge University") and r.clean == "Bachelor of Arts"
    assert [(c.name, c.issuer) for c in r.certs] == [("Six Sigma Belt", "ASQ"), ("Scrum Master", None)] and r.summary == ["A long enough line of text\nmore", None] and r.desc == [True, False]
    assert [(e.role, e.company, e.start, e.end) for e in r.since] == [("Engineer", "Acme", "2015", "Present")] and tuple(r.kind) == ("resume", 0.6) and r.found == "Shop\n- built it"
    assert [(p.name, p.technologies, p.demo, p.github) for p in r.projects] == [("Shop", ["python"], "https://shop.example.com", None), ("Blog site here", [], None, "github.com/me/blog")]


def test_strip_record(spark):
    df = spark.createDataFrame([(1, "[TITLE]x", ["a||LOC:b"], {"k": "[X]y"}, ("[Z]q", 3))], "id int, t string, a array<string>, m map<string,string>, s struct<u:string,v:int>")
    r = X.strip_record(df).first()
    assert (r.t, r.a, r.m, r.s.u, r.s.v) == ("x", ["a"], {"k": "y"}, "q", 3)


def test_contacts_are_read_once(spark):
    """Of the expressions that name them several times, each read the address and the place anew."""
    from sieverank import registries as R
    from sieverank.plans import extraction

    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = extraction.extract_records(docs, R.section_headers(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("linkedin\\.com|(?:programming") == 1
