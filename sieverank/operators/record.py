"""Assembly and repair of records: fallbacks, scores of entry sets, header scores, names, languages, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.text import round_half_up, strip_tags, text_of

#: Names of human languages that are looked for.
LANGUAGES = tuple(
    "english french german spanish hindi tamil telugu arabic mandarin japanese italian portuguese russian dutch korean bengali urdu marathi gujarati kannada "
    "malayalam punjabi cantonese chinese swedish norwegian danish finnish polish turkish greek hebrew thai vietnamese indonesian malay tagalog swahili czech hungarian romanian".split()
)
BLACKLISTED_NAMES = ("resume", "curriculum vitae", "cv", "profile", "objective", "summary", "contact", "skills", "education", "experience")
ROLE_WORDS, COMPANY_WORDS = r"(?i)\b(engineer|developer|manager|analyst|intern|lead|director|consultant|designer|officer)\b", r"(?i)\b(inc|ltd|llc|corp|gmbh|pvt|technologies|solutions|systems|university|bank|group)\b"


def first_nonempty(*lists: Column) -> Column:
    """The first list that has an entry; an empty list if none has."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], lists[0])


def prefer_longer(main: Column, side: Column, factor: float = 2.0) -> Column:
    """`side` where `main` is empty or `side` is more than `factor` times as long."""
    a, b = F.length(text_of(main)), F.length(text_of(side))
    return F.when((a == 0) & (b > 0) | (b > a * factor), side).otherwise(main)


def _filled(x: Column) -> Column:
    return F.trim(text_of(x)) != ""


#: Roles that name none.
GENERIC_ROLES = ("intern", "trainee", "employee", "worker", "staff")


def _set_score(entries: Column, parts) -> Column:
    def one(e: Column) -> Column:
        return sum((F.when(c, w).otherwise(0.0) for c, w in parts(e)), F.lit(0.5))

    return F.aggregate(F.transform(entries, one), F.lit(0.0), lambda a, x: a + x)


def experience_set_score(entries: Column) -> Column:
    """2 for a role that names one, 2 for a company, 1 for a start, 0.5 for a description or achievements, 0.5 for each entry."""
    def parts(e: Column):
        told = _filled(e["description"]) | (F.coalesce(F.size(e["achievements"]), F.lit(0)) > 0)
        return (_filled(e["role"]) & ~F.lower(F.trim(text_of(e["role"]))).isin(*GENERIC_ROLES), 2.0), (_filled(e["company"]), 2.0), (_filled(e["start"]), 1.0), (told, 0.5)

    return _set_score(entries, parts)


def education_set_score(entries: Column) -> Column:
    """2 for a degree, 2 for an institution, 1 for a date, 0.5 for a grade, 0.5 for each entry."""
    return _set_score(entries, lambda e: ((_filled(e["degree"]), 2.0), (_filled(e["institution"]), 2.0), (_filled(e["start"]) | _filled(e["end"]), 1.0), (_filled(e["grade"]), 0.5)))


def arbitrate(first: Column, second: Column, score=experience_set_score) -> Column:
    """The entry set with the higher score; the second on ties."""
    return F.when(score(first) > score(second), first).otherwise(second)


def header_score(line: Column, known: Column, line_number: Column) -> Column:
    """0 to 1: in the registry 0.5, capitals 0.15, up to 30 characters 0.15 or 50 0.05, after the first three lines 0.1,
    one to three words 0.1."""
    n, words = F.length(line), F.size(F.split(F.trim(line), r"\s+"))
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    score = F.when(known, 0.5).otherwise(0.0) + F.when((letters != "") & (F.upper(letters) == letters), 0.15).otherwise(0.0)
    score = score + F.when(n <= 30, 0.15).when(n <= 50, 0.05).otherwise(0.0) + F.when(line_number >= 3, 0.1).otherwise(0.0)
    return F.least(score + F.when((F.trim(line) != "") & (words <= 3), 0.1).otherwise(0.0), F.lit(1.0))


def role_score(x: Column) -> Column:
    """How much a text looks like a job title."""
    t = text_of(x)
    words = F.size(F.split(F.trim(t), r"\s+"))
    score = F.regexp_count(t, F.lit(ROLE_WORDS)) * 0.4 + F.when(words <= 6, 0.3).when(words > 8, -0.3).otherwise(0.0)
    score = score + F.when(t.rlike(r"^\p{Lu}"), 0.1).otherwise(0.0) - F.when(t.rlike(COMPANY_WORDS), 0.3).otherwise(0.0)
    return F.when(t == "", 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def company_score(x: Column) -> Column:
    """How much a text looks like the name of a company."""
    t = text_of(x)
    words = F.size(F.split(F.trim(t), r"\s+"))
    score = F.regexp_count(t, F.lit(COMPANY_WORDS)) * 0.4 + F.when(words <= 8, 0.2).when(words > 10, -0.2).otherwise(0.0)
    score = score + F.when(t.rlike(r",\s*[A-Z]"), 0.2).otherwise(0.0) + F.when(t.rlike(r"^\p{Lu}"), 0.1).otherwise(0.0) - F.when(t.rlike(ROLE_WORDS), 0.2).otherwise(0.0)
    return F.when(t == "", 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def role_or_company(role: Column, company: Column) -> Column:
    """struct<role, company>: swapped where the two scores say so by more than 0.2."""
    swap = (role_score(company) + company_score(role)) - (role_score(role) + company_score(company)) > 0.2
    return F.struct(F.when(swap, company).otherwise(role).alias("role"), F.when(swap, role).otherwise(company).alias("company"))


def name_confidence(name: Column) -> Column:
    """0 for section words, 0.6 for one word, 0.95 for two to four, 0.4 above five, else 0.7."""
    n = F.size(F.split(F.trim(name), r"\s+"))
    return F.when(~_filled(name) | F.lower(F.trim(name)).isin(*BLACKLISTED_NAMES), 0.0).when(n == 1, 0.6).when(n <= 4, 0.95).when(n > 5, 0.4).otherwise(0.7)


def name_of_file(path: Column) -> Column:
    """First and last name of a file such as CV_First_Last.pdf; null if it has not two words of letters."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", "")
    words = F.filter(F.split(stem, r"[_\-\s]+"), lambda w: w.rlike("^[A-Za-z]+$") & ~F.lower(w).isin("cv", "resume", "final", "updated", "new"))
    return F.when(F.size(words) >= 2, F.initcap(F.array_join(F.slice(words, 1, 3), " ")))


def missing_name_reason(text: Column, text_quality: Column, semantic_quality: Column, name: Column) -> Column:
    n = F.length(F.trim(text_of(text)))
    return F.when(_filled(name) & ~F.lower(F.trim(name)).isin(*BLACKLISTED_NAMES), F.lit(None)).when(n == 0, "EMPTY_DOCUMENT").when(n < 50, "IMAGE_PDF").when(needs_ocr(text_quality, semantic_quality), "OCR_FAILURE").when(_filled(name), "BLACKLISTED_TITLE").otherwise("NO_NAME_FOUND")


def needs_ocr(text_quality: Column, semantic_quality: Column) -> Column:
    return (text_quality < 0.5) | (semantic_quality < 0.5) | ((text_quality < 0.75) & (semantic_quality < 0.9))


def date_of_birth(text: Column) -> Column:
    found = F.regexp_extract(text_of(text), r"(?i)(?:date\s+of\s+birth|d\.?o\.?b\.?|born(?:\s+on)?)\s*[:\-]?\s*(\d{1,2}[/.\- ](?:\d{1,2}|[A-Za-z]{3,9})[/.\- ]\d{2,4})", 1)
    return F.nullif(found, F.lit(""))


def human_languages(text: Column) -> Column:
    """Names of languages that occur as words, in the order of the list."""
    words = F.regexp_extract_all(F.lower(text_of(text)), F.lit("[a-z]+"), F.lit(0))
    return F.transform(F.filter(F.array(*[F.lit(x) for x in LANGUAGES]), lambda x: F.array_contains(words, x)), lambda x: F.initcap(x))


def plausible_location(location: Column, name: Column) -> Column:
    """The location, unless it holds a word of technology or of job titles, or the person's own name."""
    low = F.lower(text_of(location))
    bad = low.rlike(r"\b(python|java|sql|react|node|aws|docker|engineer|developer|manager|analyst)\b") | (_filled(name) & F.contains(low, F.lower(text_of(name))))
    return F.when(_filled(location) & ~bad, location)


def section_report(found: Column, expected: Column) -> Column:
    """struct<found, missing>: sections with text, and those that were expected beside them."""
    present = F.map_keys(F.map_filter(found, lambda _, v: _filled(v)))
    return F.struct(F.array_sort(present).alias("found"), F.array_sort(F.array_except(expected, present)).alias("missing"))


def fallback_text(sections: Column) -> Column:
    """Cleaned text of each section that has any."""
    return F.map_filter(F.transform_values(sections, lambda _, v: strip_tags(text_of(v))), lambda _, v: v != "")


def known_skill_parts(skills: Column, known: Column) -> Column:
    """Skills with bundles taken apart: "a / b", "a & b" become their parts where all parts are known names; repeats
    in other spelling go, known names come first, each in alphabetical order."""
    def parts(s: Column) -> Column:
        split = F.transform(F.split(s, r"\s*[/&]\s*"), lambda p: F.trim(p))
        return F.when((F.size(split) > 1) & F.forall(split, lambda p: F.array_contains(known, F.lower(p))), split).otherwise(F.array(F.trim(s)))

    flat = F.filter(F.flatten(F.transform(skills, parts)), lambda s: s != "")
    once = F.filter(F.transform(flat, lambda s, i: F.when(F.array_position(F.transform(flat, lambda x: F.lower(x)), F.lower(s)) == i + 1, s)), lambda s: s.isNotNull())
    first, rest = F.filter(once, lambda s: F.array_contains(known, F.lower(s))), F.filter(once, lambda s: ~F.array_contains(known, F.lower(s)))
    return F.concat(F.array_sort(first), F.array_sort(rest))


def assign_links(projects: DataFrame, links: DataFrame) -> DataFrame:
    """projects(id, at, name) with `link`: the k-th project gets the k-th link of links(id, ord, uri)."""
    p = projects.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    x = links.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).select("id", "k", F.col("uri").alias("link"))
    return p.join(x, ["id", "k"], "left").drop("k")


def audit(records: DataFrame, issues: dict[str, Column]) -> DataFrame:
    """issue, n: how many records have each issue."""
    counted = records.agg(*[F.count_if(c).alias(k) for k, c in issues.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in issues])).alias("x")).select("x.*")


def extraction_quality(name: Column, email: Column, phone: Column, n_skills: Column, n_experience: Column, n_education: Column) -> Column:
    """0 to 1 over six signals; contacts and lists count fully, few skills half."""
    score = F.when(_filled(name), 1.0).otherwise(0.0) + F.when(_filled(email), 1.0).otherwise(0.0) + F.when(_filled(phone), 1.0).otherwise(0.0)
    score = score + F.when(n_skills >= 3, 1.0).when(n_skills > 0, 0.5).otherwise(0.0) + F.when(n_experience > 0, 1.0).otherwise(0.0) + F.when(n_education > 0, 1.0).otherwise(0.0)
    return round_half_up(score / 6, 2)
