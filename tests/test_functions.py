"""Scalar functions on inline cases."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from sieverank.functions import dates, text


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "Present": dt.date(2024, 1, 15), "till date": dt.date(2024, 1, 15), "1 June 2020": dt.date(2020, 6, 1), "31 Jan 2020": dt.date(2020, 1, 28),
        "January 2021": dt.date(2021, 1, 1), "Jan. 2021": dt.date(2021, 1, 1), "Summer 2020": dt.date(2020, 1, 1), "Jan.2020": dt.date(2020, 1, 1),
        "Jan'20": dt.date(2020, 1, 1), "Dec'99": dt.date(1999, 12, 1), "Jan-20": dt.date(2020, 1, 1), "25/12/2019": dt.date(2019, 12, 25),
        "01/06/2020": dt.date(2020, 1, 6), "06/2020": dt.date(2020, 6, 1), "2020/06": dt.date(2020, 6, 1), "2021": dt.date(2021, 6, 1),
        "13/2020": None, "": None, None: None, "soon": None, "1800": None, "May 9999": None,
    }
    got = column(spark, list(cases), lambda x: dates.parse_date(x, F.lit(dt.date(2024, 1, 15))))
    assert dict(zip(cases, got, strict=True)) == cases


def test_normal_forms(spark):
    assert column(spark, ["React.js", "Node JS", "CI/CD", None], text.normalize_skill) == ["reactjs", "nodejs", "cicd", None]
    assert column(spark, ["C++", "C#", "ASP.NET", "Financial Modeling", "Vue.js"], text.normalize_graph_key) == ["cplusplus", "csharp", "aspdotnet", "financial_modeling", "vuejs"]


def test_contacts(spark):
    assert column(spark, ["write to A.B@x.org now", "none"], text.email) == ["a.b@x.org", None]
    assert column(spark, ["call +1 (639) 555-4981 ok", "9876543210", "12"], text.phone) == ["+1 (639) 555-4981", "9876543210", None]
    assert column(spark, ["https://github.com/some-one", "github.com/topics"], text.github) == ["some-one", None]
    assert column(spark, ["7+ years of experience", "x"], text.years_stated) == [7, None]


def test_quality(spark):
    good = "This is a plain sentence with words that anybody can read without trouble."
    assert column(spark, [good, "x", None, "(cid:12)(cid:13)(cid:14) 123 456"], text.text_quality)[:3] == [1.0, 0.0, 0.0]
    assert column(spark, [good, "bcdfghj klmnpqr stvwxzb cdfghjk lmnpqrs tv", "short"], text.semantic_quality) == [1.0, 0.2, 0.0]


def test_cleaning(spark):
    assert column(spark, ["[TITLE]Lead[/TITLE] ||LOC: Oslo", "D E T A I L S"], lambda x: text.collapse_spaced_letters(text.strip_tags(x))) == ["Lead", "DETAILS"]
    assert column(spark, ["a (cid:9) é   b\n\n\n\nc [X]"], text.clean_for_ranking) == ["a b\n\nc"]


@pytest.mark.parametrize("strict", [False, True])
def test_matched_names_are_those_of_all_pairs(spark, strict):
    from sieverank.operators import matching

    names = ["Python", "py", "Java", "JavaScript", "js", "React.js", "reactjs", "C", "c++", "", "Ü ä ö", "äö", "k8s", "Kubernetes", "SQL", "MySQL", "postgres", "PostgreSQL", "ab", "abc", "abcabc", None]
    have = spark.createDataFrame([*enumerate(names)], "id int, skill string").coalesce(1).withColumn("pos", F.lit(0))
    wanted = have.select(F.lit(1).alias("jd_id"), F.col("id").alias("jd_pos"), F.col("skill").alias("jd_skill"))
    got = sorted((r.id, r.jd_pos) for r in matching.match_pairs(have, wanted, strict).collect())
    every = have.crossJoin(wanted).filter(matching.skills_match(F.col("skill"), F.col("jd_skill"), strict))
    assert got == sorted((r.id, r.jd_pos) for r in every.collect())
    assert matching.match_pairs(have, wanted.limit(0), strict).count() == 0


def test_lines_and_counts_are_worked_out_once(spark):
    """Each way to a place read all lines anew; each character that was counted became a string."""
    from sieverank.operators import extract

    assert str(extract.location(F.col("text"))).count("split(coalesce(text") == 1
    assert str(text.text_quality(F.col("text"))).count("regexp_count") == 3
    cases = ["Ünïcode \U0001d400 text $$$ ab ###% \x01\x02 (cid:3) [TAG] $$", "###a$$$ %%% words", "a1b22c333d4444 (((", "\x0b \x85 words here and there"]
    want = []
    for x in cases:
        x = re.sub(r"\[/?[A-Z_]+\]", "", x)
        blank = "[ \t\n\x0b\f\r]"
        letters, mean = sum(c.isalpha() for c in x) / len(x), len(re.sub(blank, "", x)) / len(re.findall(f"[^{blank[1:]}+", x))
        value = 1.0 - (0.5 if letters < 0.4 else 0.2 if letters < 0.6 else 0) - (0.3 if mean < 2 else 0.1 if mean < 3 else 0)
        value -= 2 * len(re.findall(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", x)) / len(x) + min(0.5, 0.1 * len(re.findall(r"\(cid:\d+\)", x)))
        value -= min(0.3, 0.02 * len(re.findall(r"[^a-zA-Z \t\n\x0b\f\r,.\-:;()]{3,}", x)))
        want.append(math.floor(max(0.0, min(1.0, value)) * 100 + 0.5) / 100)
    assert column(spark, cases, text.text_quality) == want
