"""Texts to records: one plan from the text of a profile to the fields of PERSON.

Lines meet their text once, to be dealt to sections; everything else is worked out in the record's own row. A row that
cannot be read is no error of the job: its fields stay empty and `status` says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank import registries as R
from sieverank.functions import literals
from sieverank.functions.text import email, github, let, linkedin, phone, semantic_quality, strip_tags, text_of, text_quality
from sieverank.operators import extract as X
from sieverank.operators import record, tagged
from sieverank.operators.parse import fuzzy_names, lines_of, scan_text
from sieverank.operators.sections import assign, resolve_headers

#: Names that count as known skills where no dictionary is given.
KNOWN = tuple(sorted({*R.SKILL_ALIASES, *R.SKILL_ALIASES.values(), *X.TECHNICAL, *(k for ks in R.SUBDOMAIN_KEYWORDS.values() for k in ks)}))

#: Names that are looked for in texts where no dictionary is given: the technical ones that are not parts of names only.
NAMES = tuple(k for k in X.TECHNICAL if k not in ("rest", "api"))


def sections_of(docs: DataFrame, headers: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sections: map of section to its lines; what stands before the first header is "header"; chunks of one section
    are joined by a blank line."""
    marked = resolve_headers(lines_of(docs, id_col, text_col), headers)
    dealt = assign(marked, ["id"], "at", "section", "part").filter("section is null")
    chunks = assign(marked.withColumn("chunk", F.when(F.col("section").isNotNull(), F.col("at"))), ["id"], "at", "chunk", "n").select("id", "at", "n")
    rows = dealt.join(chunks, ["id", "at"]).select("id", "at", F.coalesce("part", F.lit("header")).alias("part"), F.coalesce("n", F.lit(-1)).alias("n"), "line")
    texts = rows.groupBy("id", "part", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("t"))
    joined = texts.groupBy("id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n\n").alias("t"))
    return joined.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", "t"))).alias("sections"))


def garbled_skills(rows: DataFrame, known: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """id, meant: map of names in a record's skills section that are no known name to the known name that they are most
    like. Each spelling is looked up once, however many records have it; records without such a name have no row."""
    section = text_of(F.try_element_at("sections", F.lit("skills")))
    unknown = F.filter(X.raw_skills(section), lambda s: ~F.array_contains(literals.array(known), F.lower(F.trim(s))))
    raw = rows.select("id", F.explode(F.array_distinct(unknown)).alias("raw"))
    dictionary = rows.sparkSession.range(1).select(F.explode(literals.array(names)).alias("canonical"))
    meant = fuzzy_names(raw.select("raw"), dictionary.withColumn("lower", F.lower("canonical"))).select("raw", "canonical")
    return raw.distinct().join(meant, "raw").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("raw", "canonical"))).alias("meant"))


def _named_skills(section: Column, dictionary: Column) -> Column:
    """The names of a skills section, garbled ones as what they mean, and known names that section or text hold; a known
    name that the section spells in its own way keeps that spelling."""
    meant = F.coalesce("meant", F.create_map().cast("map<string,string>"))
    own = F.transform(X.raw_skills(section), lambda s: F.coalesce(F.try_element_at(meant, s), s))
    told = F.array_union(scan_text(section, dictionary), scan_text(F.col("text"), dictionary))
    more = lambda own: F.concat(own, F.filter(told, lambda k: ~F.exists(own, lambda s: F.lower(s) == F.lower(k))))
    return let(own, more)


def extract_records(docs: DataFrame, headers: DataFrame, known: tuple[str, ...] = KNOWN, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = NAMES) -> DataFrame:
    """A record for each row with an id: contacts, sections, skills, work, education, projects, certificates, languages, scores, warnings.

    `known`: names that are valid as they stand, in lower case; `names`: the dictionary of skills, which garbled names
    stand for and which are looked for in the whole text.

    Rows that share an id share their sections; rows without an id have none of their own and are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text")).filter("id is not null")
    rows = rows.join(sections_of(docs, headers, id_col, text_col), "id", "left")
    dictionary = literals.array(known)
    rows = rows.join(garbled_skills(rows, known, names), "id", "left")
    part = lambda name: text_of(F.try_element_at("sections", F.lit(name)))
    top = F.slice(X.lines("text"), 1, 5)
    named = F.get(F.filter(F.transform(top, X.name_of_contact_line), X.is_name_line), F.lit(0))
    # Contacts are columns of their own: within the expressions below, which name them several times, each would be read anew.
    contacts = {"mail": email(F.col("text")), "call": phone(F.col("text")), "place": X.location(F.col("text"))}
    rows = rows.withColumns({"name": named, "tq": text_quality(F.col("text")), "sq": semantic_quality(F.col("text")), **contacts})
    work = record.first_nonempty(X.dated_blocks(part("experience")), X.since_entries(part("experience")))
    taught = record.first_nonempty(X.education_entries(part("education")), X.education_entries(part("header")))
    rows = rows.withColumns(
        {
            "skills": X.split_bundles(X.clean_skills(_named_skills(part("skills"), literals.array(names)), dictionary), dictionary),
            "experience": X.repaired_experience(work),
            "education": taught,
            "certifications": X.certifications(part("certifications")),
            "languages": record.human_languages(part("languages")),
            "summary": X.clean_summary(part("summary")),
        }
    )
    told = F.coalesce(F.nullif(part("projects"), F.lit("")), X.recovered_projects(F.col("text")))
    rows = rows.withColumn("projects", record.first_nonempty(X.project_entries(told, dictionary), X.implicit_projects(F.col("experience"), F.col("skills"))))
    mail, call = F.col("mail"), F.col("call")
    quality = record.extraction_quality(F.col("name"), mail, call, F.size("skills"), F.size("experience"), F.size("education"))
    place = record.plausible_location(F.col("place"), F.col("name"))
    contacts = F.struct(F.col("name").alias("name"), mail.alias("email"), call.alias("phone"), linkedin(F.col("text")).alias("linkedin"), github(F.col("text")).alias("github"), place.alias("location"), record.date_of_birth(F.col("text")).alias("dob"))
    rows = rows.withColumns({"personal_info": contacts, "extraction_quality": quality})
    return rows.select(
        "id", F.col("id").cast("string").alias("document_id"), "personal_info", "summary", "skills", "experience", "education", "projects", "certifications", "languages",
        record.fallback_text(F.map_concat(F.coalesce("sections", F.create_map().cast("map<string,string>")), F.create_map(F.lit("full_text"), F.col("text")))).alias("raw_text_sections"), "extraction_quality",
        X.warnings(F.col("name"), mail, F.col("experience"), F.col("skills"), F.col("extraction_quality")).alias("warnings"),
        record.missing_name_reason(F.col("text"), F.col("tq"), F.col("sq"), F.col("name")).alias("missing_name_reason"), record.needs_ocr(F.col("tq"), F.col("sq")).alias("needs_ocr"),
        F.when(F.trim("text") == "", "EXTRACTION_FAILED").otherwise("EXTRACTED").alias("status"),
    )


def field_counts(records: DataFrame) -> DataFrame:
    """A row for each record with what was found, to be kept and compared with a later run."""
    size: dict[str, Column] = {c: F.size(c) for c in ("experience", "education", "skills", "certifications", "projects", "languages")}
    info = {c: F.col(f"personal_info.{c}") for c in ("name", "email", "phone", "location")}
    return records.select("id", *[v.alias(k) for k, v in info.items()], F.col("summary").isNotNull().alias("has_summary"), *[v.alias(f"n_{k}") for k, v in size.items()])


#: What an audit of records looks for.
ISSUES = {
    "no_name": "personal_info.name is null", "no_email": "personal_info.email is null", "no_phone": "personal_info.phone is null", "no_skills": "size(skills) = 0",
    "no_experience": "size(experience) = 0", "no_education": "size(education) = 0", "no_projects": "size(projects) = 0", "low_quality": "extraction_quality < 0.5", "failed": "status <> 'EXTRACTED'",
}


def audit(records: DataFrame) -> DataFrame:
    """issue, n for the nine kinds of issues."""
    return record.audit(records, {k: F.expr(v) for k, v in ISSUES.items()})


def extract_tagged(pages: DataFrame, headers: DataFrame, known: tuple[str, ...] = KNOWN, names: tuple[str, ...] = NAMES, id_col: str = "doc_id") -> DataFrame:
    """A record for each row of pages(id, header_text, sidebar_text, main_text) whose lines a layout step has tagged.

    What the tags say comes first: name, contacts of the sidebar, jobs, schools, courses. What they leave empty comes from
    the same page as plain text, read by `extract_records`; schools also from the lines of the sidebar, and the summary
    from the sections that the sidebar lists. Skills are united, those of the sidebar first, each once whatever the case.
    `sources` names the way that gave jobs, schools and the summary. Rows without an id are left out; rows that share an
    id share what plain text and sidebar give.
    """
    parts = ("header_text", "sidebar_text", "main_text")
    rows = pages.select(F.col(id_col).alias("doc_id"), *parts).filter("doc_id is not null")
    plain = F.concat_ws("\n", *(strip_tags(text_of(F.col(c))) for c in parts))
    read = extract_records(rows.select("doc_id", plain.alias("text")), headers, known, names=names).dropDuplicates(["id"])
    others = rows.select(
        F.col("doc_id").alias("id"),
        tagged.sidebar_education(F.col("sidebar_text")).alias("schools"),
        tagged.split_by_sidebar(F.col("sidebar_text"), F.col("main_text"), F.col("header_text")).alias("listed"),
    ).dropDuplicates(["id"])
    own = tagged.assemble(rows)
    own = own.select("id", F.struct(*[c for c in own.columns if c != "id"]).alias("t"))
    both = own.join(read, "id").join(others, "id")
    none = lambda c: F.array().cast(dict(read.dtypes)[c])
    jobs = F.transform("t.employment", lambda e: F.struct(e["role"], e["company"], e["start"], e["end"], e["location"], e["description"], e["achievements"]))
    degree = lambda e: F.nullif(F.concat_ws(" in ", e["degree"], e["field"]), F.lit(""))
    taught = F.transform("t.education", lambda e: F.struct(degree(e).alias("degree"), e["institution"], e["start"], e["end"], F.lit(None).cast("string").alias("grade")))
    schools = F.transform("schools", lambda e: F.struct(e["degree"], e["institution"], F.lit(None).cast("string").alias("start"), e["end"], e["grade"]))
    courses = F.transform("t.courses", lambda c: F.struct(c["name"], c["issuer"], c["start"].alias("date")))
    listed = F.get(F.filter("listed", lambda x: x["section"] == "summary"), F.lit(0))["text"]
    ways = {
        "experience": {"tags": jobs, "text": F.col("experience")},
        "education": {"tags": taught, "sidebar": schools, "text": F.col("education")},
        "summary": {"tags": F.col("t.profile"), "sections": listed, "text": F.col("summary")},
    }
    filled = lambda x, c: F.coalesce(x, F.lit("")) != "" if c == "summary" else F.coalesce(F.size(x), F.lit(0)) > 0

    def chosen(c: str, value) -> Column:
        cases = [F.when(filled(x, c), value(way, x)) for way, x in ways[c].items()]
        return F.coalesce(*cases)

    skills = F.concat(F.col("t.skills_raw"), F.col("skills"))
    low = F.transform(skills, F.lower)
    info = F.struct(
        F.coalesce("t.personal_info.name", "personal_info.name").alias("name"),
        F.coalesce("t.personal_info.email", "personal_info.email").alias("email"),
        F.coalesce("t.personal_info.phone", "personal_info.phone").alias("phone"),
        "personal_info.linkedin",
        "personal_info.github",
        F.coalesce("t.personal_info.address", "personal_info.location").alias("location"),
        "personal_info.dob",
    )
    out = both.select(
        "id",
        "document_id",
        info.alias("personal_info"),
        chosen("summary", lambda way, x: x).alias("summary"),
        let(low, lambda low: F.filter(skills, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)).alias("skills"),
        *[F.coalesce(chosen(c, lambda way, x: x.cast(dict(read.dtypes)[c])), none(c)).alias(c) for c in ("experience", "education")],
        "projects",
        F.when(filled(courses, "certifications"), courses.cast(dict(read.dtypes)["certifications"])).otherwise(F.col("certifications")).alias("certifications"),
        F.when(F.size("t.languages") > 0, F.col("t.languages")).otherwise(F.col("languages")).alias("languages"),
        F.coalesce("t.accomplishments", F.array().cast("array<string>")).alias("accomplishments"),
        "raw_text_sections",
        F.struct(*[chosen(c, lambda way, x: F.lit(way)).alias(c) for c in ways]).alias("sources"),
        "needs_ocr",
        "status",
    )
    found = {c: F.col(f"personal_info.{c}") for c in ("name", "email", "phone")}
    quality = record.extraction_quality(found["name"], found["email"], found["phone"], F.size("skills"), F.size("experience"), F.size("education"))
    out = out.withColumn("extraction_quality", quality)
    return out.withColumn("warnings", X.warnings(found["name"], found["email"], F.col("experience"), F.col("skills"), F.col("extraction_quality")))
