"""Parsers and layout on inline cases."""

from sieverank.operators import layout, parse

TAGGED = """[NAME]Ada Byron[/NAME]
[EXPERIENCE]
[JOB_TITLE]Lead Engineer, Acme Corp  ||LOC: Oslo[/JOB_TITLE]
[DATE]Jan 2019 - Present[/DATE]
Built things
[BULLET]• Shipped the engine[/BULLET]
and kept it running
[BULLET]- Wrote tests[/BULLET]
[JOB_TITLE]Intern, Foo[/JOB_TITLE]
[DATE]2017 – 2018[/DATE]
[EDU_LINE]B.Sc Physics[/EDU_LINE]
University of Somewhere
[DATE]2013 to 2016[/DATE]"""


def test_tagged_text(spark):
    toks = parse.tokens(parse.lines_of(spark.createDataFrame([(1, TAGGED), (2, None)], "doc_id int, text string"))).cache()
    jobs = sorted(parse.employment(toks.filter("kind <> 'EDU_LINE' and at < 11")).collect())
    assert [(j.role, j.company, j.location, j.start, j.end) for j in jobs] == [("Lead Engineer", "Acme Corp", "Oslo", "Jan 2019", "Present"), ("Intern", "Foo", None, "2017", "2018")]
    assert jobs[0].description == "Built things" and jobs[0].achievements == ["Shipped the engine and kept it running", "Wrote tests"] and jobs[1].achievements == []
    (edu,) = parse.education(toks).collect()
    assert (edu.degree, edu.institution, edu.start, edu.end) == ("B.Sc Physics", "University of Somewhere", "2013", "2016")


def test_plain_text(spark):
    docs = spark.createDataFrame([(1, "Ada Byron\nLead, Acme\nMar 2018 - Apr 2020\nCook, Bar (2010 - 2012)\nsince 2021")], "doc_id int, text string")
    lines = parse.lines_of(docs)
    got = [(r.role, r.company, r.start, r.end) for r in sorted(parse.dated_entries(lines).collect(), key=lambda r: r["at"])]
    assert got[0] == ("Lead", "Acme", "Mar 2018", "Apr 2020") and got[1][2:] == ("2010", "2012") and got[2][2:] == ("2021", "Present")
    assert [(r.id, r.name) for r in parse.name_line(lines).collect()] == [(1, "Ada Byron")]


def test_dictionary(spark):
    names = spark.createDataFrame([("Machine Learning", "machine learning"), ("C++", "c++"), ("Python", "python"), ("Kubernetes", "kubernetes")], "canonical string, lower string")
    docs = spark.createDataFrame([(1, "We use Python, machine learning and C++ daily"), (2, "pythonic code"), (3, None)], "doc_id int, text string")
    assert sorted((r.id, r.canonical) for r in parse.dictionary_scan(docs, names).collect()) == [(1, "C++"), (1, "Machine Learning"), (1, "Python")]
    typed = spark.createDataFrame([("Kubernets",), ("machine lerning",), ("Cobol",)], "raw string")
    assert sorted((r.raw, r.canonical) for r in parse.fuzzy_names(typed, names).collect()) == [("Kubernets", "Kubernetes"), ("machine lerning", "Machine Learning")]


def test_layout(spark):
    words = [(1, 0, 0, "WORK", 60.0, 90.0, 10.0, 20.0, True, 12.0), (1, 0, 1, "HISTORY", 95.0, 130.0, 12.0, 20.0, True, 12.0), (1, 0, 2, "right", 300.0, 330.0, 30.0, 40.0, False, 10.0), (1, 0, 3, "•", 62.0, 64.0, 31.0, 40.0, False, 10.0)]
    df = spark.createDataFrame(words, "doc_id long, page int, seq int, text string, x0 double, x1 double, top double, bottom double, bold boolean, size double")
    lines = layout.line_roles(layout.page_lines(df)).orderBy("line").collect()
    assert [(r.text, r.role) for r in lines] == [("WORK HISTORY", "header"), ("• right", "bullet")]
    (split,) = layout.column_split(df, 500.0).collect()
    assert split.split == 95 + (300 - 95) / 2


def test_fuzzy_names_equal_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcdeinorst .+#") for _ in range(rng.randrange(1, 22))).strip() for _ in range(300)} | {"machine learning", "kubernetes", "go", "c++", "aaaaaaaaaaaa"} - {""})
    typed = {"", "ab", "Machine Lerning", "aaaaaaaaaabb"}
    for n in rng.sample(names, 120):
        letters = list(n)
        for _ in range(rng.randrange(4)):
            letters[rng.randrange(len(letters))] = rng.choice("abcxyz ")
        typed.add("".join(letters).title() if rng.random() < 0.5 else "".join(letters))
    want = {}
    for raw in typed:
        best = None
        for n in names:
            if len(raw) >= 3 and abs(len(raw) - len(n)) <= 3 and abs(len(raw.split(" ")) - len(n.split(" "))) <= 1:
                ratio = SequenceMatcher(None, raw.lower(), n).ratio()
                if ratio >= (0.85 if len(raw) < 10 else 0.65):
                    best = max(best or (0, ""), (ratio, n))
        if best:
            want[raw] = (best[1], round(best[0], 9))
    found = parse.fuzzy_names(spark.createDataFrame([(t,) for t in typed] + [(None,)], "raw string"), spark.createDataFrame([(n, n) for n in names], "canonical string, lower string"))
    assert {r.raw: (r.canonical, round(r.ratio, 9)) for r in found.collect()} == want
    assert len(want) > 60


def test_scan_text(spark):
    from pyspark.sql import functions as F

    names = F.array(*[F.lit(x) for x in ("C++", "go", "machine learning", "node.js", ".net", "R")])
    df = spark.createDataFrame([("c++11 and C++, GO-lang, Go. machine  learning",), ("machine learning; node.js .NET r",), ("mango ago_go",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(parse.scan_text(F.col("t"), names)).collect()] == [["C++", "go"], ["machine learning", "node.js", ".net", "R"], [], [], []]


def test_records_take_garbled_and_named_skills(spark):
    from sieverank import registries as R
    from sieverank.plans import extraction

    docs = spark.createDataFrame([(1, "Ada Byron\nSKILLS\nPythom Djnagoo, kubernetez, Docker\nEXPERIENCE\nwrote typescript, not a gopher"), (2, None)], "doc_id long, text string")
    found = {r.id: r.skills for r in extraction.extract_records(docs, R.section_headers(spark), names=("python", "kubernetes", "docker", "typescript", "go")).collect()}
    assert "kubernetes" in found[1] and "Docker" in found[1] and "typescript" in found[1] and "go" not in found[1] and "kubernetez" not in found[1]
    assert found[2] == []


def test_nodes_of_a_graph(spark, tmp_path):
    import json

    from sieverank.operators import matching
    from sieverank.sources import tables

    graph = {"___note": {}, "reactjs": {"aliases": ["React.js", "React"]}, "risk": {"aliases": ["React", None]}, "deal_flow": {}}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes = tables.read_graph_nodes(spark, str(tmp_path / "g.json"))
    assert [(r.key, r.aliases) for r in nodes.orderBy("at").collect()] == [("reactjs", ["React.js", "React"]), ("risk", ["React", None]), ("deal_flow", [])]
    names = spark.createDataFrame([("react",), ("React.JS",), ("Deal Flow",), ("deal-flow",), ("none",), (None,), ("react",)], "skill string")
    got = {r.skill: r.key for r in matching.graph_keys(names, nodes).collect()}
    assert got == {"react": "risk", "React.JS": "reactjs", "Deal Flow": "deal_flow"}  # the later node has the alias
    assert matching.graph_keys(names, nodes.limit(0)).count() == 0
