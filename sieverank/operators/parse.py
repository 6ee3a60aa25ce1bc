"""Text to records: lines, typed tokens of tagged text, employment and education entries, skills of a dictionary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions.text import let

MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
MOMENT = rf"(?:{MONTH}\s*'?\d{{2,4}}|\d{{1,2}}[/.-]\d{{4}}|(?:19|20)\d{{2}})"
DATE_RANGE = rf"(?i)({MOMENT})\s*(?:-|–|—|to|until)\s*({MOMENT}|present|current|now|ongoing|till date|to date)"
SINCE = r"(?i)\bsince\s+((?:19|20)\d{2})"
BULLET = r"^\s*[•·▪▸►✓✔*\-]\s*"
TAGGED = r"^\[([A-Z_]+)\](.*)\[/\1\]$"


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, at, line: the lines of each text that are not blank."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "line"))
    return rows.withColumn("line", F.trim("line")).filter("line <> ''")


def date_range(x: Column) -> Column:
    """struct<start, end>: the first range of dates, or "since YYYY" to the present; nulls without one."""
    start, end, since = (F.nullif(F.regexp_extract(x, p, i), F.lit("")) for p, i in ((DATE_RANGE, 1), (DATE_RANGE, 2), (SINCE, 1)))
    return F.struct(F.coalesce(start, since).alias("start"), F.when(start.isNotNull(), end).when(since.isNotNull(), "Present").alias("end"))


def split_role_company(x: Column) -> Column:
    """struct<role, company>: before and after the first comma; a company ends at two blanks."""
    parts = F.split(x, r"\s*,\s*", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("role"), F.trim(F.get(F.split(F.get(parts, F.lit(1)), r"\s{2,}"), F.lit(0))).alias("company"))


def tokens(lines: DataFrame) -> DataFrame:
    """id, at, kind, raw, location, role, company, start, end for each line of tagged text.

    kind is SECTION, JOB_TITLE, EDU_LINE, DATE, BULLET or BODY; a date tag without a range is BODY; name and title lines
    are left out.
    """
    tag = F.regexp_extract("line", TAGGED, 1)
    content = F.trim(F.regexp_extract("line", TAGGED, 2))
    located = F.split(content, r"\|\|LOC:", 2)
    plain = F.trim(F.regexp_replace(F.trim(F.get(located, F.lit(0))), ",$", ""))
    section = F.nullif(F.regexp_extract("line", r"^\[([A-Za-z][A-Za-z_ &]*)\]$", 1), F.lit(""))
    rows = lines.select("id", "at", "line", tag.alias("tag"), plain.alias("plain"), F.trim(F.get(located, F.lit(1))).alias("location"), section.alias("section")).filter("tag not in ('NAME', 'TITLE')")
    span = date_range(F.col("plain"))
    rows = rows.withColumn("span", F.when(F.col("tag") == "DATE", span))
    kind = (
        F.when(F.col("section").isNotNull(), "SECTION")
        .when(F.col("tag").isin("JOB_TITLE", "EDU_LINE", "BULLET"), F.col("tag"))
        .when((F.col("tag") == "DATE") & F.col("span.start").isNotNull(), "DATE")
        .otherwise("BODY")
    )
    raw = F.coalesce("section", F.when(F.col("tag") == "BULLET", F.trim(F.regexp_replace("plain", BULLET, ""))), F.when(F.col("tag") != "", F.col("plain")), F.col("line"))
    parts = F.when(F.col("tag") == "JOB_TITLE", split_role_company(F.col("plain")))
    return rows.select("id", "at", kind.alias("kind"), raw.alias("raw"), "location", parts["role"].alias("role"), parts["company"].alias("company"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def _entries(rows: DataFrame, opener: str) -> DataFrame:
    """Tokens with `entry`: the number of openers so far; those before the first opener belong to none."""
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("entry", F.sum(F.when(F.col("kind") == opener, 1).otherwise(0)).over(w)).filter("entry > 0")


def _first(column: str, kind: str) -> Column:
    return F.min_by(F.when(F.col("kind") == kind, F.col(column)), F.when((F.col("kind") == kind) & F.col(column).isNotNull(), F.col("at")))


def employment(toks: DataFrame) -> DataFrame:
    """id, entry, role, company, location, start, end, description, achievements: one row for each job title.

    A body line after a bullet continues it; body lines before the first bullet are the description.
    """
    rows = _entries(toks, "JOB_TITLE")
    w = Window.partitionBy("id", "entry").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bullet", F.sum(F.when(F.col("kind") == "BULLET", 1).otherwise(0)).over(w))
    text = rows.filter("kind in ('BULLET', 'BODY')").groupBy("id", "entry", "bullet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), " ").alias("raw"))
    bodies = text.groupBy("id", "entry").agg(F.max(F.when(F.col("bullet") == 0, F.col("raw"))).alias("description"), F.transform(F.array_sort(F.collect_list(F.when(F.col("bullet") > 0, F.struct("bullet", "raw")))), lambda x: x["raw"]).alias("achievements"))
    heads = rows.groupBy("id", "entry").agg(*[_first(c, "JOB_TITLE").alias(c) for c in ("role", "company", "location")], *[_first(c, "DATE").alias(c) for c in ("start", "end")])
    return heads.join(bodies, ["id", "entry"], "left").withColumn("achievements", F.coalesce("achievements", F.array().cast("array<string>")))


def education(toks: DataFrame) -> DataFrame:
    """id, entry, degree, institution, start, end: a degree line, the body line after it, its dates."""
    rows = _entries(toks, "EDU_LINE")
    return rows.groupBy("id", "entry").agg(_first("raw", "EDU_LINE").alias("degree"), _first("raw", "BODY").alias("institution"), *[_first(c, "DATE").alias(c) for c in ("start", "end")])


def dated_entries(lines: DataFrame) -> DataFrame:
    """id, at, role, company, start, end for plain text: each line with a range of dates is an entry; its own other
    words or, without any, the line before name role and company."""
    w = Window.partitionBy("id").orderBy("at")
    rows = lines.withColumn("span", date_range(F.col("line"))).withColumn("before", F.lag("line").over(w)).filter("span.start is not null")
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", DATE_RANGE, ""), SINCE, ""), r"[|(),–—-]+\s*$", ""))
    named = split_role_company(F.coalesce(F.nullif(rest, F.lit("")), F.col("before")))
    return rows.withColumn("n", named).select("id", "at", "n.role", "n.company", "span.start", "span.end")


def name_line(lines: DataFrame, first: int = 5) -> DataFrame:
    """id, name, confidence: the first of the first lines that has two to four capitalised words and nothing else."""
    ok = (F.col("at") < first) & F.col("line").rlike(r"^(?:\p{Lu}[\p{L}'.-]*)(?:\s+\p{Lu}[\p{L}'.-]*){1,3}$") & ~F.lower("line").rlike(r"\b(resume|curriculum|vitae|profile|experience|education|skills|university|engineer|manager|developer)\b")
    return lines.filter(ok).groupBy("id").agg(F.min_by("line", "at").alias("name")).withColumn("confidence", F.lit(0.95))


def dictionary_scan(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 5) -> DataFrame:
    """id, canonical: names(canonical, lower) that occur in a text as whole words, whatever the case.

    Runs of one to `most` words are joined to the dictionary by equality, so the cost does not grow with its size.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[a-z0-9+#./_-]*[a-z0-9+#]"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    runs = [F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), _run(n))).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)]
    grams = rows.select("id", F.explode(F.array_distinct(F.concat(*runs))).alias("lower"))
    return grams.join(names, "lower").select("id", "canonical").distinct()


def _run(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


#: Lower-case letters, rare ones first; signs and digits count as rarer still.
RARE_FIRST = "zqjxkvbpygfwmucldrhsinoate"
#: Names whose lengths differ by more are not compared.
LENGTH_GAP = 3


def scan_text(text: Column, dictionary: Column) -> Column:
    """The names of an array that a text holds, whatever the case, with no letter, digit, hyphen or underscore beside."""
    whole = lambda low, k: F.regexp_like(low, F.concat(F.lit(r"(?<![a-z0-9\-_])\Q"), F.lower(k), F.lit(r"\E(?![a-z0-9\-_])")))
    found = lambda low: F.filter(dictionary, lambda k: F.contains(low, F.lower(k)) & whole(low, k))
    return let(F.lower(F.coalesce(text, F.lit(""))), found)


def _letters(x: Column) -> Column:
    """The letters of a string, each with its count so far, in one order for all strings: high counts, then rare letters."""
    at = F.sequence(F.lit(1), F.length(x))
    letter = lambda i: F.substr(x, i, F.lit(1))
    count = lambda i: F.length(F.substr(x, F.lit(1), i)) - F.length(F.replace(F.substr(x, F.lit(1), i), letter(i), F.lit("")))
    keyed = F.transform(at, lambda i: F.struct((-count(i)).alias("k"), F.instr(F.lit(RARE_FIRST), letter(i)).alias("r"), letter(i).alias("c")))
    return F.transform(F.array_sort(keyed), lambda t: F.concat(t["c"], (-t["k"]).cast("string")))


def _prefix(letters: Column, ratio: Column) -> Column:
    """What a string must share a letter of with any string of at least this ratio: all but the letters that it must have
    in common, and one more."""
    n = F.size(letters)
    common = F.ceil(ratio * (2 * n - LENGTH_GAP) / 2 - 1e-9).cast("int")
    return F.slice(letters, 1, F.least(n, F.greatest(n - common + 1, F.lit(1))))


def fuzzy_names(found: DataFrame, names: DataFrame, least: float = 0.65, least_short: float = 0.85) -> DataFrame:
    """raw, canonical, ratio: the most similar dictionary name (Ratcliff-Obershelp ratio), at least `least`, or
    `least_short` below ten characters; of equal ones the last by alphabet. Names of fewer than three characters, and of
    lengths or word counts that differ by more than three or one, are not compared.

    The ratio is at most the share of letters, counted, that two names have in common. So two names of a high ratio share
    one of their first letters in an order by rarity (an equality join that loses no pair), and enough of all letters;
    only pairs that do are compared.
    """
    size = lambda rows, col: rows.withColumn("size", F.length(col)).withColumn("words", F.size(F.split(col, " "))).withColumn("letters", _letters(F.col(col)))
    a = found.select("raw", F.lower("raw").alias("low")).filter(F.length("raw") >= 3).distinct()
    a = size(a, "low").withColumn("limit", F.when(F.length("raw") < 10, least_short).otherwise(least))
    b = size(names.select("canonical", "lower").filter(F.length("lower") > 0).distinct(), "lower").withColumn("limit", F.when(F.length("lower") + LENGTH_GAP < 10, least_short).otherwise(least))
    b = b.select("canonical", "lower", F.col("size").alias("size_b"), F.col("words").alias("words_b"), F.col("letters").alias("letters_b"), F.explode(_prefix(F.col("letters"), F.col("limit"))).alias("letter"))
    met = a.withColumn("letter", F.explode(_prefix(F.col("letters"), F.col("limit")))).join(b, "letter")
    near = met.filter((F.abs(F.col("size") - F.col("size_b")) <= LENGTH_GAP) & (F.abs(F.col("words") - F.col("words_b")) <= 1))
    near = near.filter(2 * F.size(F.array_intersect("letters", "letters_b")) >= F.col("limit") * (F.col("size") + F.col("size_b")) - 1e-9)
    pairs = near.select("raw", "low", "canonical", "lower", "limit").distinct()

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for p in batches:
            ratio = [SequenceMatcher(None, x, y).ratio() for x, y in zip(p["low"], p["lower"], strict=True)]
            yield pd.DataFrame({"raw": p["raw"], "canonical": p["canonical"], "ratio": ratio, "limit": p["limit"]})

    scored = pairs.mapInPandas(compare, "raw string, canonical string, ratio double, limit double")
    best = scored.filter("ratio >= limit").groupBy("raw").agg(F.max(F.struct("ratio", "canonical")).alias("m"))
    return best.select("raw", F.col("m.canonical").alias("canonical"), F.col("m.ratio").alias("ratio"))
