"""Bonuses of projects, companies and certificates, and keyword scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieverank.functions import literals
from sieverank.functions.text import round_half_up
from sieverank.operators.scoring import as_word, prepared, same_skill, strings
from sieverank.registries import CERTIFICATE_FIELDS, CERTIFICATE_ISSUERS, CONTEST_WORDS, PRESTIGE_COMPANIES, PRIZE_WORDS

def project_bonus(projects: Column, wanted: Column, asked: Column | None = None) -> Column:
    """Up to 5: six times the share of the wanted skills that some project uses, in its technologies (fuzzy match) or as a
    word of its text. `asked`: the wanted skills, prepared, where they are at hand."""
    told = lambda p: F.lower(F.concat_ws(" ", p["name"], p["description"], F.array_join(strings(p["technologies"]), " ")))
    made = F.transform(projects, lambda p: F.struct(prepared(p["technologies"]).alias("skills"), told(p).alias("text")))

    def used(made: Column) -> Column:
        uses = lambda a: F.exists(made, lambda p: F.exists(p["skills"], lambda t: same_skill(t, a)) | as_word(p["text"], F.lower(a["s"])))
        return F.size(F.array_distinct(F.transform(F.filter(prepared(wanted) if asked is None else asked, uses), lambda a: a["s"])))

    share = F.element_at(F.transform(F.array(made), used), 1) / F.when(F.size(wanted) > 0, F.size(wanted))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(round_half_up(F.least(share * 6, F.lit(5.0)), 1))


def prestige_matches(companies: Column, known: tuple[str, ...] = PRESTIGE_COMPANIES) -> Column:
    """The known names in the companies (of each the longest, then the first by alphabet), each name once."""
    ordered = literals.array(k for k in sorted(known, key=lambda k: (-len(k), k)) if len(k) >= 3)
    hits = F.transform(companies, lambda c: F.get(F.filter(ordered, lambda k: F.contains(F.lower(F.coalesce(c, F.lit(""))), k)), F.lit(0)))
    return F.array_distinct(F.filter(hits, lambda h: h.isNotNull()))


def prestige_bonus(companies: Column, known: tuple[str, ...] = PRESTIGE_COMPANIES) -> Column:
    """2 for each known name, 4 at most."""
    return F.least(F.size(prestige_matches(companies, known)) * 2.0, F.lit(4.0))


def _has(x: Column, words) -> Column:
    return F.exists(literals.array(words), lambda w: F.contains(x, w))


def relevant_words(request_text: Column, skills: Column, keywords: Column, fields: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Words by which a certificate fits a request: all words of each field that the request names, else its own skills
    and keywords."""
    low = F.lower(F.concat_ws(" ", request_text, F.array_join(skills, " ")))
    named = F.concat(*[F.when(_has(low, ws), literals.array(ws)).otherwise(F.array().cast("array<string>")) for ws in (CERTIFICATE_FIELDS if fields is None else fields).values()])
    own = F.transform(F.concat(skills, keywords), lambda w: F.lower(w))
    return F.when(F.size(named) > 0, F.concat(named, F.transform(skills, lambda w: F.lower(w)))).otherwise(own)


def cert_bonus(certificates: Column, relevant: Column, raw_text: Column | None = None) -> Column:
    """Up to 5: .25 for a relevant certificate of a known issuer, .15 for another relevant one; once 1 for a contest won
    or .5 for one taken part in, as certificates or the raw text say."""
    def value(c: Column) -> Column:
        low = F.lower(F.concat_ws(" ", c["name"], c["issuer"]))
        fits = (F.coalesce(c["name"], F.lit("")) != "") & F.exists(relevant, lambda w: F.contains(low, w))
        return F.when(fits & _has(low, CERTIFICATE_ISSUERS), 0.25).when(fits, 0.15).otherwise(0.0)

    names = F.transform(certificates, lambda c: F.lower(F.coalesce(c["name"], F.lit(""))))
    told = F.concat(names, F.array(F.lower(F.coalesce(raw_text, F.lit(""))) if raw_text is not None else F.lit("")))
    contest = F.when(F.exists(told, lambda t: _has(t, CONTEST_WORDS) & _has(t, PRIZE_WORDS)), 1.0).when(F.exists(told, lambda t: _has(t, CONTEST_WORDS)), 0.5).otherwise(0.0)
    total = F.aggregate(F.transform(certificates, value), F.lit(0.0), lambda a, x: a + x)
    return round_half_up(F.least(total + contest, F.lit(5.0)), 1)


def keyword_found(text: Column, variants: list[str]) -> Column:
    """Whether one of the spellings occurs: single words as words, others anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = [v for v in variants if " " not in v and "-" not in v]
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    hit = F.lit(False)
    for v in variants:
        plain = v in one and v.replace("_", "").isalnum()
        hit = hit | (F.array_contains(words, v) if plain else F.contains(low, F.lit(v)))
    return hit


def keyword_score(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Percent of keywords (name -> spellings) that occur; 0 without keywords."""
    if not keywords:
        return F.lit(0.0)
    hits = [keyword_found(text, variants).cast("int") for variants in keywords.values()]
    return sum(hits[1:], hits[0]) / len(hits) * 100
