"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits: the same in every engine for non-negative scores."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def text_of(x: Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(x, F.lit(""))


def normalize_skill(x: Column) -> Column:
    """Lower case without blanks, dots, hyphens and slashes; a final .js becomes js."""
    return F.translate(F.regexp_replace(F.trim(F.lower(x)), r"\.js$", "js"), ".-/ ", "")


def normalize_graph_key(x: Column) -> Column:
    """Key of the skill graph before aliases: names with signs are spelled out, blanks become underscores."""
    s = F.trim(F.lower(x))
    for sign, word in (("c++", "cplusplus"), ("c#", "csharp"), (".net", "dotnet")):
        s = F.replace(s, F.lit(sign), F.lit(word))
    return F.replace(F.translate(F.regexp_replace(s, r"\.js$", "js"), ".-/", ""), F.lit(" "), F.lit("_"))


def tokenize(x: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text."""
    return F.regexp_extract_all(F.lower(text_of(x)), F.lit("[a-z0-9]+"), F.lit(0))


def strip_tags(x: Column) -> Column:
    """Text without bracketed markers such as [TITLE] and without location markers."""
    for pattern in (r"\[/[A-Z_]+\]", r"\[[A-Z][A-Z_]*\]", r"\[[A-Z][A-Za-z\s&]+\]", r"\s*\|{0,2}LOC:[^\n]*"):
        x = F.regexp_replace(x, pattern, "")
    return trim_blank(x)


def trim_blank(x: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_for_ranking(x: Column) -> Column:
    """ASCII text with plain punctuation and single blanks, without markers and font artefacts."""
    x = F.regexp_replace(F.regexp_replace(text_of(x), r"\[/?[A-Z_]+\]", ""), r"\(cid:\d+\)", "")
    x = F.regexp_replace(x, r"[^\x20-\x7E\n\t]", " ")
    x = F.regexp_replace(x, r"""[^A-Za-z0-9_\s.,;:!?\-'"()/&@#+%]""", " ")
    return trim_blank(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_cid(x: Column) -> Column:
    return F.regexp_replace(x, r"\(cid:\d+\)", "")


def collapse_spaced_letters(x: Column) -> Column:
    """A line such as `D E T A I L S` as one word; other lines stay."""
    spaced = x.rlike(r"^\s*(?:[A-Z] ){3,}[A-Z]\s*$")
    return F.when(spaced, F.regexp_replace(x, r"\s+", "")).otherwise(x)


def nonempty(x: Column) -> Column:
    return F.when(x != "", x)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONES = (r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}", r"\(\d{3}\) ?\d{3}[ .-]?\d{4}", r"\b\d{10}\b")


def email(x: Column) -> Column:
    """First address, lower case; null if there is none."""
    return F.lower(nonempty(F.regexp_extract(text_of(x), EMAIL, 0)))


def phone(x: Column) -> Column:
    """First number by the first pattern that occurs and has seven digits or more."""
    found = [nonempty(F.regexp_extract(text_of(x), p, 0)) for p in PHONES]
    return F.coalesce(*[F.when(F.length(F.regexp_replace(f, r"\D", "")) >= 7, f) for f in found])


def linkedin(x: Column) -> Column:
    return nonempty(F.regexp_extract(text_of(x), r"(?i)linkedin\.com/in/([A-Za-z0-9_-]+)", 1))


def github(x: Column) -> Column:
    """Handle of a profile address; paths of the site itself are none."""
    handle = nonempty(F.regexp_extract(text_of(x), r"(?i)github\.com/([A-Za-z0-9_-]+)", 1))
    return F.when(~F.lower(handle).isin("features", "topics", "login", "join", "about", "pricing", "explore", "settings", "orgs"), handle)


def years_stated(x: Column) -> Column:
    """N of "N+ years of experience"; null if not stated."""
    n = F.regexp_extract(F.lower(text_of(x)), r"(\d{1,3})\+?\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience|exp)", 1)
    return nonempty(n).cast("int")


def content_hash(x: Column) -> Column:
    return F.sha2(text_of(x).cast("binary"), 256)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def count_chars(x: Column, kind: str) -> Column:
    """How many characters of x are of a class. regexp_count would make a string of each."""
    return F.char_length(x) - F.char_length(F.regexp_replace(x, f"{kind}+", ""))


def text_quality(x: Column) -> Column:
    """0 to 1: share of letters, mean word length, control characters, font artefacts and runs of signs."""
    def score(clean: Column) -> Column:
        n = F.char_length(clean).cast("double")
        letters = count_chars(clean, r"\p{L}") / n
        filled = n - count_chars(clean, r"\s")
        control = count_chars(clean, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]") / n
        cid = F.least(F.regexp_count(clean, F.lit(r"\(cid:\d+\)")) * 0.1, F.lit(0.5))
        # Words as single blanks part the runs of signs as they did, and leave little for the wide class to look at.
        bare = F.regexp_replace(clean, "[a-zA-Z ]+", " ")
        signs = F.least(F.regexp_count(bare, F.lit(r"[^a-zA-Z\s,.\-:;()]{3,}")) * 0.02, F.lit(0.3))
        mean = filled / F.regexp_count(clean, F.lit(r"\S+")).cast("double")
        counts = F.struct(letters.alias("letters"), mean.alias("mean"))  # each is read twice

        def graded(v: Column) -> Column:
            value = F.lit(1.0) - F.when(v["letters"] < 0.4, 0.5).when(v["letters"] < 0.6, 0.2).otherwise(0.0) - F.when(v["mean"] < 2.0, 0.3).when(v["mean"] < 3.0, 0.1).otherwise(0.0)
            value = value - control * 2 - cid - signs
            return round_half_up(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)), 2)

        return F.when(F.trim(clean).rlike(r"\S"), let(counts, graded)).otherwise(0.0)

    scored = let(F.regexp_replace(x, r"\[/?[A-Z_]+\]", ""), score)
    return F.when(F.char_length(text_of(x)) >= 10, scored).otherwise(0.0)


def plausible_word(w: Column) -> Column:
    """Has a vowel, at most five consonants in a row, and few capitals inside."""
    low = F.lower(w)
    inner = F.length(w) - 2
    between = F.substring(w, F.lit(2), inner)
    capitals = F.length(F.regexp_replace(between, "[^A-Z]", ""))
    return low.rlike("[aeiou]") & ~low.rlike("[^aeiou]{6,}") & ~((inner > 2) & between.rlike("[A-Z]") & (capitals > inner * 0.3))


def semantic_quality(x: Column) -> Column:
    """1, 0.7, 0.5 or 0.2 by the share of plausible words; 0.5 with fewer than five words, 0 for very short texts."""
    clean = F.regexp_replace(text_of(x), r"\[/?[A-Z_]+\]", "")
    words = F.regexp_extract_all(clean, F.lit("[a-zA-Z]{3,}"), F.lit(0))
    share = F.size(F.filter(words, plausible_word)).cast("double") / F.size(words)
    graded = F.when(share >= 0.8, 1.0).when(share >= 0.6, 0.7).when(share >= 0.5, 0.5).otherwise(0.2)
    return F.when(F.char_length(text_of(x)) < 20, 0.0).when(F.size(words) < 5, 0.5).otherwise(graded)
