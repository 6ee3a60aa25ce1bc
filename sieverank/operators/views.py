"""Views of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signal(score: Column, knocked_out: Column) -> Column:
    return F.when(knocked_out, "knockout").when(score >= 75, "strong").when(score >= 50, "good").otherwise("fair")


def top_skills(must: Column, nice: Column, extra: Column) -> Column:
    return F.slice(F.concat(must, nice, F.slice(extra, 1, 5)), 1, 8)


def flag_level(flag: Column) -> Column:
    return F.when(flag.contains("LOW_QUALITY") | flag.contains("GAP"), "warning").otherwise("info")


#: Order of names as people expect it: letters first, then accents, then case.
LOCALE = "UNICODE"


def visible(rows: DataFrame, wanted: str = "all", show_knockouts: bool = False, search: str = "", sort: str = "score", locale: str = LOCALE) -> DataFrame:
    """Rows of a list view (columns signal, name, skills, score; `matched` if there), filtered and sorted; knockouts hidden
    unless shown. A search that is not blank keeps rows whose name or one of whose skills holds it, whatever the case."""
    if not show_knockouts:
        rows = rows.filter(F.col("signal") != "knockout")
    if wanted != "all":
        rows = rows.filter(F.col("signal") == wanted)
    if search.strip():
        low = F.lit(search.lower())
        holds = lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), low)
        lists = [c for c in ("skills", "matched") if c in rows.columns]
        kept = holds(F.col("name"))
        for c in lists:
            kept = kept | F.coalesce(F.exists(c, holds), F.lit(False))
        rows = rows.filter(kept)
    return rows.orderBy(*by_name(locale), "id") if sort == "name" else rows.orderBy(F.col("score").desc(), "id")


def by_name(locale: str = LOCALE, name: str = "name") -> list[Column]:
    """Sort keys of a name in a locale's order; names that are equal there come by code points, nulls first."""
    return [F.collate(F.col(name), locale), F.col(name)]


def search_names(rows: DataFrame, text: str, locale: str = "UNICODE_CI_AI", name: str = "name") -> DataFrame:
    """Rows whose name holds the text under a collation: by default whatever the case and the accents."""
    return rows.filter(F.contains(F.collate(F.col(name), locale), F.collate(F.lit(text), locale)))


def distinct_names(rows: DataFrame, locale: str = "UNICODE_CI_AI", name: str = "name") -> DataFrame:
    """name, n: names that are equal under a collation as one, in the spelling that comes first by code points."""
    groups = rows.groupBy(F.collate(F.col(name), locale).alias("_key")).agg(F.min(F.collate(F.col(name), "UTF8_BINARY")).alias(name), F.count("*").alias("n"))
    return groups.select(name, "n")


def knockout_checks(missing: Column, reasons: Column, total_years: Column, degree: Column) -> Column:
    """array<struct<label, passed, detail>>: skills, experience and education as the reasons say."""
    def named(*words: str) -> Column:
        return F.exists(reasons, lambda r: F.lower(r).rlike("|".join(words)))

    met, short, low = F.size(missing) == 0, named("experience"), named("degree", "education")
    years = F.concat(total_years.cast("string"), F.lit(" years"))
    rows = (
        ("Must-have skills", met, F.when(met, "All required skills matched").otherwise(F.concat(F.lit("Missing: "), F.array_join(missing, ", ")))),
        ("Minimum experience", ~short, F.when(short, F.concat(years, F.lit(" (insufficient)"))).otherwise(years)),
        ("Education requirement", ~low, F.coalesce(F.nullif(degree, F.lit("")), F.lit("Not specified"))),
    )
    return F.array(*[F.struct(F.lit(label).alias("label"), passed.alias("passed"), detail.alias("detail")) for label, passed, detail in rows])


def with_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows of a view with the latest status and note that a reader gave: notes(id, at, status, note)."""
    last = notes.groupBy("id").agg(F.max_by(F.struct("status", "note"), "at").alias("n")).select("id", F.col("n.status").alias("status"), F.col("n.note").alias("note"))
    return rows.join(last, "id", "left")


def weights_are_whole(weights: Column) -> Column:
    """Whether the weights of a request, in percent, add up to 100 within 0.01."""
    return F.abs(F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x) - 100) <= 0.01
