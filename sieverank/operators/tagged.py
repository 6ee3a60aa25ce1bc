"""Tagged text to the parts of a record, in the record's own row.

A layout step marks lines: [JOB_TITLE]Role, Company  ||LOC:City[/JOB_TITLE], [EDU_LINE], [DATE], [BULLET], and [SECTION
NAME] alone on a line; other lines are body text. Lines become typed tokens, the array of tokens is cut where an entry
opens, and each piece is read on its own, so nothing is shuffled and the work grows with the text.

Texts may be null (read as empty). A section that is missing gives null, one without entries an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieverank import registries as R
from sieverank.functions import literals
from sieverank.functions.text import let, strip_tags, text_of, trim_blank

_MONTH_YEAR = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.?\s+\d{4}"
#: Ranges of months, words of a degree, marks of a bullet.
SPAN = rf"(?i)({_MONTH_YEAR})\s*[–—\-]+\s*({_MONTH_YEAR}|Present|Current|Now)"
DEGREE = r"\b(?:Bachelors?|Masters?|Ph\.?D|MBA|M\.?S\.?|B\.?S\.?|B\.?A\.?|M\.?A\.?|Associates?|Diploma|Certificate|Doctor)\b"
MARK = r"^[•·▪▸►✓✔*\-]\s*"
SECTION_LINE = r"^\[([A-Z][A-Z\s]+)\]$"
TAGGED_LINE = r"^\[([A-Z_]+)\](.+?)\[/\1\]$"
#: Sections that hold a profile, in order of preference.
PROFILES = ("PROFILE", "SUMMARY", "OBJECTIVE", "ABOUT ME", "ABOUT", "PROFESSIONAL SUMMARY", "CAREER OBJECTIVE", "OVERVIEW")
#: Labels of links in a sidebar, and links that a template leaves there.
LINK_LABELS = ("LINKS", "SOCIAL", "LINKEDIN", "GITHUB")
TEMPLATE_LINKS = ("resume templates", "build this template", "pinterest", "resumeviking")
COUNTRIES = ("United States", "United Kingdom", "Canada", "India")
PREAMBLE = "__PREAMBLE__"


def segments(items: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """The pieces of an array that begin where opens(item, index) holds; items before the first opener belong to none."""
    starts = F.filter(F.transform(items, lambda x, i: F.when(opens(x, i), i)), lambda i: i.isNotNull())
    return let(
        starts,
        lambda at: F.transform(at, lambda s, k: F.slice(items, s + 1, F.coalesce(F.get(at, k + 1), F.size(items)) - s)),
    )


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(text), "\n"), trim_blank), lambda s: s != "")


def _empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _texts(toks: Column, glue: str) -> Column:
    return F.array_join(F.transform(toks, lambda t: t["raw"]), glue)


def token(line: Column) -> Column:
    """struct<kind, raw, location, role, company, start, end> of a line; kind is null for name and title lines.

    kind is SECTION, JOB_TITLE, EDU_LINE, DATE, BULLET or BODY. A date tag without a range of months is BODY, as are
    unknown tags. A job title is cut at its first comma; its company ends at two blanks.
    """

    def build(parts: Column) -> Column:
        plain, tag, start = parts["plain"], parts["tag"], parts["start"]
        named = F.split(plain, r"\s*,\s*", 2)
        job, dated = tag == "JOB_TITLE", F.coalesce(start != "", F.lit(False))
        kind = F.when(parts["section"] != "", "SECTION").when(tag.isin("JOB_TITLE", "EDU_LINE", "BULLET"), tag).when(dated, "DATE").when(~tag.isin("NAME", "TITLE"), "BODY")
        raw = F.when(parts["section"] != "", parts["section"]).when(tag == "BULLET", trim_blank(F.regexp_replace(plain, MARK, ""))).when(tag != "", plain)
        return F.struct(
            kind.alias("kind"),
            F.coalesce(raw, parts["line"]).alias("raw"),
            F.when(tag.isin("JOB_TITLE", "EDU_LINE"), parts["location"]).alias("location"),
            F.when(job, trim_blank(F.get(named, F.lit(0)))).alias("role"),
            F.when(job, trim_blank(F.get(F.split(F.get(named, F.lit(1)), r"\s{2,}"), F.lit(0)))).alias("company"),
            F.when(dated, start).alias("start"),
            F.when(dated, F.regexp_extract(plain, SPAN, 2)).alias("end"),
        )

    def placed(parts: Column) -> Column:
        pieces, located = F.split(parts["content"], r"\|\|LOC:", 2), F.contains(parts["content"], F.lit("||LOC:"))
        plain = F.when(located, trim_blank(F.regexp_replace(trim_blank(F.get(pieces, F.lit(0))), ",+$", ""))).otherwise(parts["content"])
        place = F.when(located, trim_blank(F.get(pieces, F.lit(1))))
        whole = F.struct(parts["line"].alias("line"), parts["section"].alias("section"), parts["tag"].alias("tag"), plain.alias("plain"), place.alias("location"))
        return let(whole, dated)

    def dated(parts: Column) -> Column:
        start = F.when(parts["tag"] == "DATE", F.regexp_extract(parts["plain"], SPAN, 1))
        return let(parts.withField("start", start), build)

    marked = F.startswith(line, F.lit("["))
    found = F.struct(
        line.alias("line"),
        F.when(marked, trim_blank(F.regexp_extract(line, SECTION_LINE, 1))).otherwise("").alias("section"),
        F.when(marked, F.regexp_extract(line, TAGGED_LINE, 1)).otherwise("").alias("tag"),
        F.when(marked, trim_blank(F.regexp_extract(line, TAGGED_LINE, 2))).otherwise("").alias("content"),
    )
    return let(found, placed)


def tokens(lines: Column) -> Column:
    """The tokens of an array of lines without blank ones; name and title lines are left out."""
    return F.filter(F.transform(lines, token), lambda t: t["kind"].isNotNull())


def _is(kind: str) -> Callable[[Column, Column], Column]:
    return lambda t, i: t["kind"] == kind


def _date(tok: Column, name: str) -> Column:
    return F.when(tok["kind"] == "DATE", tok[name]).alias(name)


def employment(toks: Column) -> Column:
    """array<struct<role, company, location, start, end, description, achievements>>: one entry for each job title.

    Only a date right after the title is its date. Body lines before the first bullet are the description, later ones
    continue their bullet; a section line ends the entry. Entries without role and company are left out.
    """

    def entry(piece: Column) -> Column:
        head, second = F.get(piece, F.lit(0)), F.get(piece, F.lit(1))
        rest = F.slice(piece, F.when(second["kind"] == "DATE", 3).otherwise(2), F.size(piece))
        end = F.array_position(F.transform(rest, lambda t: t["kind"]), "SECTION")
        body = F.filter(F.when(end > 0, F.slice(rest, 1, end.cast("int") - 1)).otherwise(rest), lambda t: t["kind"].isin("BODY", "BULLET"))

        def filled(body: Column) -> Column:
            first = F.array_position(F.transform(body, lambda t: t["kind"]), "BULLET").cast("int")
            told = _texts(F.slice(body, 1, F.when(first > 0, first - 1).otherwise(F.size(body))), " ")
            bullets = F.transform(segments(body, _is("BULLET")), lambda b: trim_blank(_texts(b, " ")))
            return F.struct(
                head["role"].alias("role"),
                head["company"].alias("company"),
                head["location"].alias("location"),
                _date(second, "start"),
                _date(second, "end"),
                _empty_to_null(trim_blank(told)).alias("description"),
                F.filter(bullets, lambda b: b != "").alias("achievements"),
            )

        return let(body, filled)

    jobs = F.transform(segments(toks, _is("JOB_TITLE")), entry)
    return F.filter(jobs, lambda j: (F.coalesce(j["role"], F.lit("")) != "") | (F.coalesce(j["company"], F.lit("")) != ""))


def degree_line(text: Column) -> Column:
    """struct<degree, field, institution>: up to the word of a degree and what it is "of", what it is in, and what follows
    the last comma."""
    cut = rf"(?is)^(.*?{DEGREE})(.*)$"
    prefix, after = trim_blank(F.regexp_extract(text, cut, 1)), trim_blank(F.regexp_extract(text, cut, 2))
    last = F.when(F.contains(text, F.lit(",")), trim_blank(F.regexp_extract(text, r"(?s)^.*,(.*)$", 1)))

    def build(p: Column) -> Column:
        rest = trim_blank(F.substr(p["after"], F.length(p["of"]) + 1))
        field = trim_blank(F.regexp_extract(rest, r"(?i)^(?:Degree\s+)?(?:in\s+|of\s+)?([^,]+?)(?:,|$)", 1))
        field = trim_blank(F.regexp_replace(field, r"(?i)^(?:Degree\s+)?(?:in|of)\s+", ""))
        known = p["prefix"] != ""
        return F.struct(
            F.when(known, F.concat_ws(" ", p["prefix"], _empty_to_null(p["of"]))).alias("degree"),
            F.when(known, _empty_to_null(field)).alias("field"),
            p["last"].alias("institution"),
        )

    parts = F.struct(prefix.alias("prefix"), after.alias("after"), F.regexp_extract(after, r"^of\s+\w+", 0).alias("of"), last.alias("last"))
    return let(parts, build)


def education(toks: Column) -> Column:
    """array<struct<degree, field, institution, location, start, end>>: an entry opens at a degree line, or at a job title
    that names a degree; a job title of up to four words right after it continues the institution, then its date."""
    taught = lambda t: F.coalesce(t["raw"], F.lit("")).rlike(f"(?i){DEGREE}")

    def entry(piece: Column) -> Column:
        head, second = F.get(piece, F.lit(0)), F.get(piece, F.lit(1))
        continued = (second["kind"] == "JOB_TITLE") & (F.size(F.split(text_of(second["role"]), r"\s+")) <= 4)
        more = F.when(continued, trim_blank(F.coalesce(_empty_to_null(second["role"]), second["raw"])))
        date = F.get(piece, F.when(continued, 2).otherwise(1))

        def build(p: Column) -> Column:
            whole = trim_blank(F.concat_ws(" ", _empty_to_null(p["line"]["institution"]), _empty_to_null(p["more"])))
            place = text_of(head["location"])
            shorter = trim_blank(F.regexp_replace(trim_blank(F.substr(whole, F.lit(1), F.length(whole) - F.length(place))), ",+$", ""))
            cut = (place != "") & F.endswith(whole, place) & (whole != place) & (F.length(shorter) > 3)
            return F.struct(
                p["line"]["degree"].alias("degree"),
                p["line"]["field"].alias("field"),
                _empty_to_null(F.when(cut, shorter).otherwise(whole)).alias("institution"),
                head["location"].alias("location"),
                _date(date, "start"),
                _date(date, "end"),
            )

        return let(F.struct(degree_line(head["raw"]).alias("line"), more.alias("more")), build)

    return F.transform(segments(toks, lambda t, i: (t["kind"] == "EDU_LINE") | ((t["kind"] == "JOB_TITLE") & taught(t))), entry)


def courses(toks: Column) -> Column:
    """array<struct<name, issuer, start, end>>: titles and body lines in a row are one name, a date right after them its
    date, the last place among them the issuer."""
    names = ("JOB_TITLE", "BODY")

    def entry(piece: Column) -> Column:
        named = F.filter(piece, lambda t: t["kind"].isin(*names))
        chunk = lambda t: F.when(t["kind"] == "BODY", t["raw"]).otherwise(
            F.coalesce(_empty_to_null(F.concat_ws(" ", _empty_to_null(t["role"]), _empty_to_null(t["company"]))), t["raw"])
        )
        parts = F.filter(F.transform(named, chunk), lambda c: c != "")
        name = trim_blank(F.array_join(F.transform(parts, lambda c: F.regexp_replace(c, ",+$", "")), " "))
        places = F.filter(F.transform(named, lambda t: t["location"]), lambda x: F.coalesce(x, F.lit("")) != "")
        date = F.get(piece, F.size(named))
        return F.struct(name.alias("name"), F.get(places, F.size(places) - 1).alias("issuer"), _date(date, "start"), _date(date, "end"))

    first = lambda t, i: t["kind"].isin(*names) & ~F.coalesce(F.get(toks, i - 1)["kind"].isin(*names), F.lit(False))
    return F.transform(segments(toks, first), entry)


def accomplishments(toks: Column) -> Column:
    """array<string>: each bullet with the body lines that follow it."""
    kept = F.filter(toks, lambda t: t["kind"].isin("BULLET", "BODY"))
    return F.filter(F.transform(segments(kept, _is("BULLET")), lambda b: trim_blank(_texts(b, " "))), lambda s: s != "")


def raw_text(toks: Column, kinds: tuple[str, ...]) -> Column:
    return trim_blank(_texts(F.filter(toks, lambda t: t["kind"].isin(*kinds)), "\n"))


def sections_of_tagged(text: Column, headers: tuple[str, ...] = R.SECTION_NAMES) -> Column:
    """array<struct<name, lines>>: the lines under each header, in the order in which headers first occur; what stands
    before them is __PREAMBLE__. Sections without lines are left out.

    A header is [NAME], or a job title that is the name of a section. [NAME] starts its section anew, a title goes on
    with it.
    """
    known = literals.array(headers)
    title = r"^\[JOB_TITLE\](.*?)\[/JOB_TITLE\]$"

    def mark(line: Column) -> Column:
        alone, titled = trim_blank(F.regexp_extract(line, SECTION_LINE, 1)), F.upper(trim_blank(F.regexp_extract(line, title, 1)))
        named = F.when((titled != "") & F.array_contains(known, titled), titled)
        return F.struct(F.coalesce(_empty_to_null(alone), named).alias("name"), (alone != "").alias("anew"), line.alias("line"))

    start = F.array(F.struct(F.lit(PREAMBLE).alias("name"), F.lit(True).alias("anew"), F.lit("").alias("line")))
    marked = F.concat(start, F.transform(nonblank_lines(text), mark))

    def deal(pieces: Column) -> Column:
        names = F.array_distinct(F.transform(pieces, lambda p: F.get(p, F.lit(0))["name"]))

        def section(name: Column) -> Column:
            own = F.filter(pieces, lambda p: F.get(p, F.lit(0))["name"] == name)
            last = F.array_max(F.transform(own, lambda p, i: F.when(F.get(p, F.lit(0))["anew"], i).otherwise(0)))
            bodies = F.transform(F.slice(own, last + 1, F.size(own)), lambda p: F.transform(F.slice(p, 2, F.size(p)), lambda x: x["line"]))
            return F.struct(name.alias("name"), F.flatten(bodies).alias("lines"))

        return F.filter(F.transform(names, section), lambda s: F.size(s["lines"]) > 0)

    return let(let(marked, lambda m: segments(m, lambda x, i: x["name"].isNotNull())), deal)


def lines_under(sections: Column, names: tuple[str, ...]) -> Column:
    """The lines of the first of the named sections that there is; empty without one."""
    named = lambda n: F.filter(sections, lambda s: s["name"] == n)
    return F.coalesce(*(F.get(named(n), F.lit(0))["lines"] for n in names), F.array().cast("array<string>"))


def _routed(sections: Column, part: str, routes: dict[str, str]) -> Column:
    """The lines of all sections that belong to a part of the record."""
    names = [n for n, p in routes.items() if p == part]
    return F.flatten(F.transform(F.filter(sections, lambda s: s["name"].isin(*names)), lambda s: s["lines"]))


def merged_skills(lines: Column) -> Column:
    """array<string>: a line that begins in lower case continues the skill before it; other lines are cut at commas."""
    parts = lambda s: F.filter(F.transform(F.split(s, ","), trim_blank), lambda x: x != "")
    kept = F.filter(lines, lambda s: F.size(parts(s)) > 0)
    first = lambda s: F.substring(s, 1, 1)
    opens = lambda s, i: (i == 0) | (F.lower(first(s)) != first(s)) | (F.upper(first(s)) == first(s))

    def join(piece: Column) -> Column:
        own, more = parts(F.get(piece, F.lit(0))), F.slice(piece, 2, F.size(piece))
        last = F.array_join(F.concat(F.slice(own, F.size(own), 1), more), " ")
        return F.concat(F.slice(own, 1, F.size(own) - 1), F.array(last))

    return let(kept, lambda k: F.flatten(F.transform(segments(k, opens), join)))


def listed(lines: Column) -> Column:
    """The items of lines that are cut at commas and semicolons."""
    items = F.flatten(F.transform(lines, lambda s: F.transform(F.split(s, "[,;]"), trim_blank)))
    return F.filter(items, lambda x: x != "")


def sidebar(sections: Column) -> Column:
    """struct of address, phone, email, place_of_birth, driving_license, links, skills, hobbies and languages of the
    sections of a sidebar. Without an address section, lines that look like a street, a state with its code or a country
    are the address. Links are distinct whatever their case, in the order of their labels."""
    every = F.flatten(F.transform(sections, lambda s: s["lines"]))
    text = F.array_join(every, "\n")
    own = lines_under(sections, ("ADDRESS",))
    looks = F.filter(every, lambda s: s.rlike(r"^\d{3,5}\s+\w") | s.rlike(r"\b[A-Z]{2}\s+\d{5}\b") | s.isin(*COUNTRIES))
    links = F.filter(F.flatten(F.array(*(lines_under(sections, (n,)) for n in LINK_LABELS))), lambda s: ~F.lower(s).isin(*TEMPLATE_LINKS))
    distinct = let(links, lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, F.lower), F.lower(x)) == i + 1))
    value = lambda name: _empty_to_null(F.array_join(lines_under(sections, (name,)), " "))
    return F.struct(
        _empty_to_null(F.array_join(F.when(F.size(own) > 0, own).otherwise(looks), ", ")).alias("address"),
        _empty_to_null(F.regexp_extract(text, r"\b\d{7,15}\b", 0)).alias("phone"),
        _empty_to_null(F.regexp_extract(text, r"(?i)\b[\w._%+\-]+@[\w.\-]+\.[a-z]{2,}\b", 0)).alias("email"),
        value("PLACE OF BIRTH").alias("place_of_birth"),
        value("DRIVING LICENSE").alias("driving_license"),
        distinct.alias("links"),
        merged_skills(lines_under(sections, ("SKILLS",))).alias("skills"),
        listed(lines_under(sections, ("HOBBIES",))).alias("hobbies"),
        listed(lines_under(sections, ("LANGUAGES",))).alias("languages"),
    )


def profile_text(sections: Column) -> Column:
    """The text of the first profile section without tags; null for an empty one."""
    raw = F.array_join(lines_under(sections, PROFILES), "\n")
    clean = F.regexp_replace(F.regexp_replace(raw, r"(?s)\[[A-Z_]+\].*?\[/[A-Z_]+\]", ""), r"\[[^\]]+\]", "")
    return _empty_to_null(trim_blank(clean))


def assemble(pages: DataFrame, id_col: str = "doc_id", header: str = "header_text", side: str = "sidebar_text", main: str = "main_text") -> DataFrame:
    """id and the parts of a record for each row: personal_info, profile, skills_raw (of the sidebar), skills_section_text,
    hobbies, languages, languages_section, employment, education, courses, accomplishments, projects_raw_text.

    Rows are independent: repeated or null ids give a row each, other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).alias("id"), text_of(F.col(header)).alias("top"), sections_of_tagged(F.col(side)).alias("aside"), sections_of_tagged(F.col(main)).alias("body"))
    routes = {name: R.RECORD_PARTS.get(section, section) for name, section in zip(R.SECTION_NAMES, R.SECTION_OF, strict=True)}
    # Bound in the expression itself: a filter on the result, pushed below, then works tokens out once and not for each use.
    read = lambda p, value: let(tokens(_routed(F.col("body"), p, routes)), value).alias(p)
    entries = lambda p, value: read(p, lambda t: F.when(F.size(t) > 0, value(t)))
    told = ("JOB_TITLE", "BODY", "BULLET")
    rows = rows.withColumn("side", sidebar(F.col("aside")))
    named = [_empty_to_null(trim_blank(F.regexp_extract("top", rf"(?s)\[{t}\](.*?)\[/{t}\]", 1))).alias(t.lower()) for t in ("NAME", "TITLE")]
    info = [F.col(f"side.{c}").alias(c) for c in ("address", "phone", "email", "place_of_birth", "driving_license", "links")]
    return rows.select(
        "id",
        F.struct(*named, *info).alias("personal_info"),
        profile_text(F.col("body")).alias("profile"),
        F.col("side.skills").alias("skills_raw"),
        read("skills", lambda t: raw_text(t, told)).alias("skills_section_text"),
        "side.hobbies",
        "side.languages",
        read("languages", lambda t: _texts(t, "\n")).alias("languages_section"),
        entries("employment", employment),
        entries("education", education),
        entries("courses", courses),
        entries("accomplishments", accomplishments),
        read("projects", lambda t: raw_text(t, (*told, "DATE"))).alias("projects_raw_text"),
    )


# -- sections of a page whose headers stand in the sidebar only


def resolved(line: Column) -> Column:
    """The section that a line names, in any case, itself or without what follows its last sign; null for other lines."""
    names, sections = literals.array(R.SECTION_NAMES), literals.array(R.SECTION_OF)
    plain = F.upper(trim_blank(line))
    shorter = trim_blank(F.regexp_replace(plain, r"[/\-|&]+\s*\S*$", ""))
    at = lambda x: F.get(sections, F.nullif(F.array_position(names, x), F.lit(0)).cast("int") - 1)
    return F.coalesce(at(plain), at(shorter))


def split_by_sidebar(side: Column, main: Column, full: Column) -> Column:
    """array<struct<section, text>> for a page whose sidebar lists the sections, two at least, else empty.

    Where two or more lines of the content are headers themselves, each section is what follows its headers. Else the
    content after its first contact lines is dealt to the sections in the order of the sidebar, in equal numbers of lines,
    the last taking what is left. Sections without text are left out.
    """
    ordered = F.array_distinct(F.filter(F.transform(F.split(text_of(side), "\n"), resolved), lambda s: s.isNotNull()))
    content = trim_blank(F.concat(strip_tags(text_of(full)), F.lit("\n"), strip_tags(text_of(main))))
    marked = F.transform(F.split(content, "\n"), lambda s: F.struct(resolved(s).alias("section"), s.alias("line")))
    texts = lambda rows: trim_blank(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"))

    def by_markers(rows: Column) -> Column:
        pieces = F.transform(
            segments(rows, lambda x, i: x["section"].isNotNull()),
            lambda p: F.struct(F.get(p, F.lit(0))["section"].alias("section"), texts(F.slice(p, 2, F.size(p))).alias("text")),
        )

        def joined(pieces: Column) -> Column:
            names = F.array_distinct(F.transform(pieces, lambda p: p["section"]))
            own = lambda n: F.array_join(F.transform(F.filter(pieces, lambda p: p["section"] == n), lambda p: p["text"]), "\n")
            return F.transform(names, lambda n: F.struct(n.alias("section"), own(n).alias("text")))

        return let(F.filter(pieces, lambda p: p["text"] != ""), joined)

    def by_shares(rows: Column, names: Column) -> Column:
        noise = r"(?i)@|phone|license|driving|nationality|\d{4,}|make this resume|resume templates|build this"
        skipped = F.array_max(F.transform(F.slice(rows, 1, 8), lambda x, i: F.when(x["line"].rlike(noise), i + 1).otherwise(0)))

        def dealt(left: Column) -> Column:
            share = F.greatest(F.lit(1), F.floor(F.size(left) / F.size(names)).cast("int"))
            size = lambda i: F.when(i == F.size(names) - 1, F.size(left)).otherwise(share)
            return F.transform(names, lambda n, i: F.struct(n.alias("section"), texts(F.slice(left, i * share + 1, size(i))).alias("text")))

        return F.filter(let(F.slice(rows, skipped + 1, F.size(rows)), dealt), lambda p: p["text"] != "")

    none = F.array().cast("array<struct<section: string, text: string>>")

    def split(x: Column) -> Column:
        headers = F.size(F.filter(x["rows"], lambda r: r["section"].isNotNull()))
        return F.when(F.size(x["names"]) < 2, none).when(headers >= 2, by_markers(x["rows"])).otherwise(by_shares(x["rows"], x["names"]))

    return let(F.struct(ordered.alias("names"), marked.alias("rows")), split)


# -- education in a sidebar

_GRADE = r"(?i)^(?:CGPA|GPA|Grade|Percentage|Score)[:\s]*([\d.]+%?)"
#: Degrees and school years that open an entry, boards that examine schools, sections that end the list.
_DEGREES = r"(?i)^(MBA|BCA|B\.?Tech|M\.?Tech|B\.?Sc|M\.?Sc|B\.?Com|M\.?Com|B\.?A|M\.?A|B\.?E|M\.?E|Ph\.?D|Diploma|Certificate)\s*:\s*(.+)"
_SCHOOL = r"(?i)^(?:Class\s+)?(10th|12th|X|XII|10|12)(?:\s*(?:Standard|Class))?\s*:?\s*(.*)"
BOARDS = ("WBBSE", "CBSE", "ICSE", "ISC", "STATE BOARD")
_ENDS = r"(?is)\[(?:SKILLS|LANGUAGES|HOBBIES|INTERESTS|LINKS|CONTACT|CERTIFICATIONS)\].*$"


def sidebar_education(text: Column) -> Column:
    """array<struct<degree, institution, end, grade>> of the [EDUCATION] part of a sidebar.

    "MBA: School (PURSUING)" or "Class 12th: School" opens an entry. A school may stand on the next line, a board on the
    one after; a grade may follow either kind. What an entry takes does not open one itself, so entries are picked by a
    fold over the lines.
    """
    after = F.regexp_extract(text_of(text), r"(?is)^.*?\[EDUCATION\](.*)$", 1)
    part = F.regexp_replace(F.regexp_replace(after, _ENDS, ""), r"\[/?(?:WBBSE|CBSE|ICSE|ISC|BOARD)\]", "")

    def entries(lines: Column) -> Column:
        def read(line: Column, i: Column) -> Column:
            ahead = lambda k: F.coalesce(F.get(lines, i + k), F.lit(""))
            grade = lambda k: F.regexp_extract(ahead(k), _GRADE, 1)
            degree, place = F.regexp_extract(line, _DEGREES, 1), F.regexp_extract(line, _DEGREES, 2)
            pursuing = F.contains(F.lower(place), F.lit("(pursuing)"))
            clean = trim_blank(F.regexp_replace(place, r"(?i)\s*\(pursuing\)", ""))
            studied = F.struct(
                F.concat(degree, F.when(pursuing, " (Pursuing)").otherwise("")).alias("degree"),
                clean.alias("institution"),
                F.when(pursuing, "Present").alias("end"),
                _empty_to_null(grade(1)).alias("grade"),
                F.when(grade(1) != "", 2).otherwise(1).alias("used"),
            )
            year, rest = F.regexp_extract(line, _SCHOOL, 1), trim_blank(F.regexp_extract(line, _SCHOOL, 2))
            below = trim_blank(F.regexp_replace(ahead(1), ",+$", ""))
            taken = (rest == "") & (ahead(1) != "") & ~below.rlike(r"(?i)^(?:GPA|CGPA|Grade|Percentage|Score)")
            used = F.when(taken, 2).otherwise(1)

            def schooled(p: Column) -> Column:
                board = F.when(F.upper(ahead(p["used"])).isin(*BOARDS), ahead(p["used"]))
                at = p["used"] + F.when(board.isNotNull(), 1).otherwise(0)
                return F.struct(
                    F.concat(F.lit("Class "), p["year"]).alias("degree"),
                    _empty_to_null(F.concat_ws(", ", _empty_to_null(p["school"]), board)).alias("institution"),
                    F.lit(None).cast("string").alias("end"),
                    _empty_to_null(grade(at)).alias("grade"),
                    (at + F.when(grade(at) != "", 1).otherwise(0)).alias("used"),
                )

            school = let(F.struct(year.alias("year"), F.when(taken, below).otherwise(rest).alias("school"), used.alias("used")), schooled)
            return F.when(degree != "", studied).when(line.rlike(_SCHOOL), school)

        def pick(read_lines: Column) -> Column:
            start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("picked"))
            at = F.sequence(F.lit(0), F.size(read_lines) - 1)
            step = lambda s, i: F.when((i < s["next"]) | F.get(read_lines, i).isNull(), s).otherwise(
                F.struct((i + F.get(read_lines, i)["used"]).alias("next"), F.concat(s["picked"], F.array(i)).alias("picked"))
            )
            return F.transform(F.aggregate(at, start, step, lambda s: s["picked"]), lambda i: F.get(read_lines, i).dropFields("used"))

        return let(F.transform(lines, read), pick)

    none = F.array().cast("array<struct<degree: string, institution: string, end: string, grade: string>>")
    return let(nonblank_lines(part), lambda x: F.when(F.size(x) > 0, entries(x)).otherwise(none))
