"""Scores of one profile against one request, as column expressions: nothing is exploded or shuffled.

A profile has skills, experience, education, projects and certifications as arrays; a request has must, nice and
keywords. Skills are compared in prepared form (`prepared`): the name, its normal form, its canonical form and its key
in the skill graph.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieverank import registries as R
from sieverank.functions.dates import parse_date
from sieverank.functions import literals
from sieverank.functions.text import let, normalize_skill, round_half_up, text_of, tokenize
from sieverank.operators.classify import degree_level
from sieverank.operators.matching import WEIGHTS, graph_key, normal_match, resolve

STRINGS = "array<string>"


def strings(x: Column) -> Column:
    """The array, or an empty one for null."""
    return F.coalesce(x, F.array().cast(STRINGS))


def literal_map(table: dict[str, tuple[str, ...]]) -> Column:
    return literals.mapping(table)


# -- skills
def prepared(skills: Column) -> Column:
    """array<struct<s, n, c, key>> of an array of names."""
    return F.transform(strings(skills), lambda s: F.struct(s.alias("s"), normalize_skill(s).alias("n"), resolve(normalize_skill(s)).alias("c"), graph_key(s).alias("key")))


def same_skill(a: Column, b: Column) -> Column:
    return normal_match(a["n"], b["n"], a["c"], b["c"])


def search_variants(term: Column) -> Column:
    """All spellings under which a skill or keyword is looked for in a text."""
    low = F.lower(F.trim(term))
    normal = normalize_skill(term)
    forms = {}
    for alias, canonical in R.SKILL_ALIASES.items():
        forms.setdefault(canonical, {canonical}).add(alias)
    by_alias = literal_map({alias: tuple(sorted(forms[canonical])) for alias, canonical in R.SKILL_ALIASES.items()})
    none = F.array().cast(STRINGS)
    dotted = F.when(low.endswith(".js"), F.array(F.replace(low, F.lit(".js"), F.lit("js")), F.replace(low, F.lit(".js"), F.lit(""))))
    base = F.substring(low, F.lit(1), F.length(low) - 2)
    plain = F.when(low.endswith("js") & (F.length(low) > 2), F.array(base, F.concat(base, F.lit(".js"))))
    keyword = F.coalesce(F.try_element_at(literal_map(R.KEYWORD_ALIASES), low), none)
    return F.array_distinct(F.concat(F.array(low), keyword, F.coalesce(F.try_element_at(by_alias, normal), none), F.coalesce(dotted, plain, none)))


def with_variants(asked: Column) -> Column:
    """Prepared skills with `v`, the spellings to look for: worked out once for a request, not for each record."""
    return F.transform(asked, lambda a: a.withField("v", search_variants(a["s"])))


def as_word(text: Column, word: Column) -> Column:
    """Whether the text holds the word between word boundaries."""
    return F.contains(text, word) & F.regexp_like(text, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b")))


def named_in(text: Column, variants: Column) -> Column:
    return F.exists(variants, lambda v: (F.length(v) >= 3) & as_word(text, v))


def skill_text(p: dict[str, Column]) -> Column:
    """What of a profile speaks of skills: the list, sections on skills and summaries, descriptions, projects; lower case."""
    sections = p["raw_text_sections"]
    keys = ("skills", "technical_skills", "core_competencies", "technologies", "tools", "summary", "objective", "profile", "about")
    told = F.transform(p["experience"], lambda e: e["description"])
    built = F.flatten(F.transform(p["projects"], lambda x: F.array(F.array_join(strings(x["technologies"]), " "), x["description"])))
    return F.lower(F.concat_ws(" ", F.array_join(strings(p["skills"]), " "), *[F.try_element_at(sections, F.lit(k)) for k in keys], F.array_join(F.coalesce(told, F.array().cast(STRINGS)), " "), F.array_join(F.coalesce(built, F.array().cast(STRINGS)), " ")))


def augmented(own: Column, asked: Column, text: Column) -> Column:
    """Prepared skills, and each asked skill (with variants) that none of them matches but the text names; what is added
    counts at once."""
    def step(acc: Column, a: Column) -> Column:
        known = F.exists(acc, lambda s: same_skill(s, a))
        return F.when(~known, F.concat(acc, F.array(a.dropFields("v")))).otherwise(acc)

    return F.aggregate(F.filter(asked, lambda a: named_in(text, a["v"])), own, step)


def _targets(edges: tuple[tuple[str, str], ...]) -> Column:
    table: dict[str, list[str]] = {}
    for a, b in edges:
        table.setdefault(a, []).append(b)
    return literal_map({k: tuple(v) for k, v in table.items()})


def skill_results(own: Column, asked: Column, implies=R.IMPLIES, related=R.RELATED) -> Column:
    """array<struct<skill, source, match_type, weight, explanation>>, one for each asked skill that has a match: fuzzy
    match, same graph key, a skill that implies it, a related one; within a kind the first of the profile's list."""
    onward, beside = _targets(implies), _targets((*related, *((b, a) for a, b in related)))

    def first(kept) -> Column:
        return F.get(F.filter(own, kept), F.lit(0))["s"]

    def leads(table: Column, s: Column, a: Column) -> Column:
        return F.array_contains(F.coalesce(F.try_element_at(table, s["key"]), F.array().cast(STRINGS)), a["key"])

    def one(a: Column) -> Column:
        kinds = (
            ("explicit", first(lambda s: same_skill(s, a)), F.concat(a["s"], F.lit(" ✓ matched directly"))),
            ("alias", first(lambda s: s["key"] == a["key"]), F.concat(a["s"], F.lit(" ✓ alias of "))),
            ("inferred", first(lambda s: leads(onward, s, a)), F.concat(a["s"], F.lit(" ← inferred from "))),
            ("related", first(lambda s: leads(beside, s, a)), F.concat(a["s"], F.lit(" ~ related to "))),
        )
        found = [F.when(source.isNotNull(), F.struct(a["s"].alias("skill"), source.alias("source"), F.lit(kind).alias("match_type"), F.lit(WEIGHTS[kind]).alias("weight"), (said if kind == "explicit" else F.concat(said, source)).alias("explanation"))) for kind, source, said in kinds]
        return F.coalesce(*found)

    return F.filter(F.transform(asked, one), lambda m: m.isNotNull())


def weight_of(results: Column, skill: Column) -> Column:
    return F.coalesce(F.get(F.filter(results, lambda m: m["skill"] == skill), F.lit(0))["weight"], F.lit(0.0))


def bm25(results: Column, asked: Column, idf: Column, length: Column, average: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 of the asked skills with match weights as term frequencies, in percent of every skill matched fully."""
    norm = F.when(average > 0, 1 - b + b * F.greatest(length, F.lit(1)) / F.when(average > 0, average)).otherwise(1.0)

    def value(tf: Column) -> Column:
        return tf * (k1 + 1) / (tf + k1 * norm)

    of = F.transform(asked, lambda a: F.struct(F.coalesce(F.try_element_at(idf, a["s"]), F.lit(0.0)).alias("i"), weight_of(results, a["s"]).alias("w")))
    got = F.aggregate(of, F.lit(0.0), lambda acc, x: acc + x["i"] * value(x["w"]))
    best = F.aggregate(of, F.lit(0.0), lambda acc, x: acc + x["i"] * value(F.lit(1.0)))
    return F.when(F.size(asked) == 0, 100.0).when(best > 0, F.least(got / F.when(best > 0, best) * 100, F.lit(100.0))).otherwise(0.0)


# -- experience
def spans(experience: Column, as_of: Column) -> Column:
    """Start and end of the entries that have both, in order; entries that end before they start are left out."""
    dated = F.transform(experience, lambda e: F.struct(let(e["start"], lambda x: parse_date(x, as_of)).alias("start"), let(e["end"], lambda x: parse_date(x, as_of)).alias("end")))
    return F.array_sort(F.filter(dated, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["end"] >= s["start"])))


def total_years(dated: Column) -> Column:
    """Length of the union of ordered spans in years, one decimal."""
    nothing = F.struct(F.lit(0).alias("days"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"))

    def step(a: Column, s: Column) -> Column:
        apart = F.struct((a["days"] + F.datediff(a["end"], a["start"])).alias("days"), s["start"].alias("start"), s["end"].alias("end"))
        joined = F.struct(a["days"].alias("days"), a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"))
        first = F.struct(F.lit(0).alias("days"), s["start"].alias("start"), s["end"].alias("end"))
        return F.when(a["end"].isNull(), first).when(s["start"] <= a["end"], joined).otherwise(apart)

    return F.aggregate(dated, nothing, step, lambda a: round_half_up((a["days"] + F.coalesce(F.datediff(a["end"], a["start"]), F.lit(0))) / F.lit(365.25), 1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two texts; 0 if one has no word."""
    def count(words: Column, w: Column) -> Column:
        return F.size(F.filter(words, lambda v: v == w)).cast("double")

    def total(words: Column, of) -> Column:
        return F.aggregate(F.array_distinct(words), F.lit(0.0), lambda acc, w: acc + of(w))

    def likeness(x: Column, y: Column) -> Column:
        norms = F.sqrt(total(x, lambda w: count(x, w) * count(x, w)) * total(y, lambda w: count(y, w) * count(y, w)))
        return F.when(norms > 0, total(x, lambda w: count(x, w) * count(y, w)) / F.when(norms > 0, norms)).otherwise(0.0)

    return let(tokenize(a), lambda x: let(tokenize(b), lambda y: likeness(x, y)))


def best_title(experience: Column, title: Column) -> Column:
    """struct<sim, role>: the role most like the title, the first one on ties; no role without likeness."""
    nothing = F.struct(F.lit(0.0).alias("sim"), F.lit("").alias("role"))
    scored = F.transform(experience, lambda e: F.struct(cosine(e["role"], title).alias("sim"), text_of(e["role"]).alias("role")))
    return F.aggregate(scored, nothing, lambda a, x: F.when(x["sim"] > a["sim"], x).otherwise(a))


def title_score(sim: Column) -> Column:
    return F.least(sim * 1.5, F.lit(1.0)) * 100.0


# -- keywords, education
def matched_keywords(text: Column, own: Column, keywords: Column) -> Column:
    """The keywords (prepared, with variants) that occur in a spelling, single words as words, others anywhere, or that
    match a skill."""
    def found(k: Column) -> Column:
        loose = lambda v: F.contains(v, F.lit(" ")) | F.contains(v, F.lit("-"))
        said = F.exists(k["v"], lambda v: F.contains(text, v) & (loose(v) | as_word(text, v)))
        return said | F.exists(own, lambda s: same_skill(s, k))

    return F.transform(F.filter(keywords, found), lambda k: k["s"])


def best_degree(education: Column) -> Column:
    """struct<level, degree>: the highest degree, the first one on ties; level 0 without any."""
    nothing = F.struct(F.lit(0).alias("level"), F.lit("").alias("degree"))
    scored = F.transform(education, lambda e: F.struct(degree_level(e["degree"]).alias("level"), text_of(e["degree"]).alias("degree")))
    return F.aggregate(scored, nothing, lambda a, x: F.when(x["level"] > a["level"], x).otherwise(a))


def stated_level(text: Column, required: Column) -> Column:
    """Level of the first degree word in a lower-case text that would do; 0 without one."""
    return F.coalesce(*[F.when((F.lit(level) >= required) & F.contains(text, F.lit(k)), F.lit(level)) for k, level in R.DEGREES], F.lit(0))


def field_score(education: Column, field: Column, text: Column) -> Column:
    """100 where no field is asked, else 130 times the best likeness (0.7 at least if the text names it), 100 at most."""
    low = F.lower(text_of(field))
    sims = F.transform(education, lambda e: cosine(F.concat_ws(" ", e["degree"], e["institution"]), field))
    best = F.greatest(F.coalesce(F.array_max(sims), F.lit(0.0)), F.when(F.contains(text, low), 0.7).otherwise(0.0))
    return F.when(low.isin("any", "", "related"), 100.0).otherwise(F.least(best * 130.0, F.lit(100.0)))


# -- domains
def _keyword_hits(texts: list[tuple[Column, float]], keywords: Column) -> Column:
    """array<struct<ord, votes>>; texts of fewer than five characters say nothing."""
    def of(text: Column, factor: float) -> Column:
        found = let(text, lambda t: F.filter(keywords, lambda k: (F.length(t) >= 5) & F.contains(t, k["keyword"])))
        return F.transform(found, lambda k: F.struct(k["ord"].alias("ord"), (k["weight"] * factor).alias("votes")))

    return F.concat(*[of(F.lower(text_of(t)), f) for t, f in texts])


def keyword_table(table: dict[str, tuple] | None = None) -> Column:
    found = R.DOMAIN_KEYWORDS if table is None else table
    return literals.structs(((i, k, w) for i, ks in enumerate(found.values()) for k, w in ks), ("ord", "keyword", "weight"))


def domain_of(hits: Column, names: tuple[str, ...] = tuple(R.DOMAIN_KEYWORDS)) -> Column:
    """struct<domain, confidence>: most votes (the first in order on ties) and their share."""
    votes = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.aggregate(F.filter(hits, lambda h: h["ord"] == i), F.lit(0.0), lambda a, h: a + h["votes"]))

    def judged(v: Column) -> Column:
        total, best = F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.array_max(v)
        name = F.element_at(literals.array(names), F.array_position(v, best).cast("int"))
        share = round_half_up(best / F.when(total > 0, total), 3)
        return F.struct(F.when(total > 0, name).otherwise("unknown").alias("domain"), F.when(total > 0, share).otherwise(0.0).alias("confidence"))

    return F.element_at(F.transform(F.array(votes), judged), 1)


def _skill_hits(own: Column, weight: float, domains: dict[str, str]) -> Column:
    names = list(R.DOMAIN_KEYWORDS)
    at = literals.mapping({k: names.index(d) for k, d in domains.items()})
    known = F.filter(F.transform(own, lambda s: F.try_element_at(at, s["key"])), lambda i: i.isNotNull())
    return F.transform(known, lambda i: F.struct(i.alias("ord"), F.lit(weight).alias("votes")))


def profile_domain(p: dict[str, Column], own: Column, domains: dict[str, str] | None = None) -> Column:
    """Votes of roles (3), whole entries (1.5), projects (2) and skills (1)."""
    keywords = keyword_table()
    entry = lambda e: F.concat_ws(" ", e["role"], e["company"], e["description"], F.array_join(strings(e["achievements"]), " "))
    built = lambda x: F.concat_ws(" ", x["name"], x["description"], F.array_join(strings(x["technologies"]), " "))
    work = F.flatten(F.transform(p["experience"], lambda e: _keyword_hits([(e["role"], 3.0), (entry(e), 1.5)], keywords)))
    made = F.flatten(F.transform(p["projects"], lambda x: _keyword_hits([(built(x), 2.0)], keywords)))
    return domain_of(F.concat(work, made, _skill_hits(own, 1.0, R.SKILL_DOMAINS if domains is None else domains)))


def request_domain(title: Column, department: Column, description: Column, asked: Column, domains: dict[str, str] | None = None) -> Column:
    """Votes of the title (4), the department (3), skills (1.5) and the description (1)."""
    hits = _keyword_hits([(title, 4.0), (department, 3.0), (description, 1.0)], keyword_table())
    return domain_of(F.concat(hits, _skill_hits(asked, 1.5, R.SKILL_DOMAINS if domains is None else domains)))


def profile_subdomain(p: dict[str, Column], table: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The branch of engineering with most keywords in the profile, two at least; software without any."""
    table = R.SUBDOMAIN_KEYWORDS if table is None else table
    told = F.flatten(F.transform(p["experience"], lambda e: F.concat(F.array(e["role"], e["description"]), strings(e["achievements"]))))
    text = F.lower(F.concat_ws(" ", F.array_join(strings(p["skills"]), " "), F.array_join(told, " "), F.array_join(F.transform(p["education"], lambda e: e["degree"]), " ")))
    def best(t: Column) -> Column:
        hits = [F.struct(F.size(F.filter(literals.array(ks), lambda k: F.contains(t, k))).alias("n"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, (name, ks) in enumerate(table.items())]
        return F.array_max(F.filter(F.array(*hits), lambda h: h["n"] >= 2))["name"]

    return F.coalesce(let(text, best), F.lit("software"))


def request_subdomain(title: Column, department: Column) -> Column:
    """The branch of the first word of the table that the title or department holds; software without any."""
    text = F.lower(F.concat_ws(" ", text_of(title), text_of(department)))
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in R.TITLE_SUBDOMAINS], F.lit("software"))


def domain_penalty(jd: Column, own: Column, jd_sub: Column, own_sub: Column) -> Column:
    """Percent (0 or less): between sure, known, different domains by the table; within engineering by branches."""
    table = literals.mapping({f"{a}>{b}": v for a, row in zip(R.DOMAINS, R.PENALTIES, strict=True) for b, v in zip(R.DOMAINS, row, strict=True)})
    between = F.coalesce(F.try_element_at(table, F.concat(jd["domain"], F.lit(">"), own["domain"])), F.lit(R.DEFAULT_PENALTY))
    free = (jd["confidence"] < 0.4) | (own["confidence"] < 0.4) | (jd["domain"] == own["domain"]) | (jd["domain"] == "unknown") | (own["domain"] == "unknown")
    first = F.when(free, 0).otherwise(between)
    subs = literals.mapping({f"{a}>{b}": v for a, row in R.SUBDOMAIN_PENALTIES.items() for b, v in row.items()})
    within = F.when(jd_sub == own_sub, 0).otherwise(F.coalesce(F.try_element_at(subs, F.concat(jd_sub, F.lit(">"), own_sub)), F.lit(R.DEFAULT_SUB_PENALTY)))
    return F.when((jd["domain"] == "engineering") & (own["domain"] == "engineering") & (first == 0), F.least(within, F.lit(0))).otherwise(first)


def far_apart(jd: Column, own: Column, least: float = 0.35, limit: int = -60) -> Column:
    """Whether the pre-filter drops the pair: both sure and known, not construction beside engineering, at -60 or less."""
    table = literals.mapping({f"{a}>{b}": v for a, row in zip(R.DOMAINS, R.PENALTIES, strict=True) for b, v in zip(R.DOMAINS, row, strict=True)})
    pair = F.concat(jd["domain"], F.lit(">"), own["domain"])
    sure = (jd["confidence"] >= least) & (own["confidence"] >= least) & (jd["domain"] != own["domain"]) & (jd["domain"] != "unknown") & (own["domain"] != "unknown")
    related = pair.isin("engineering>construction", "construction>engineering")
    return sure & ~related & (F.coalesce(F.try_element_at(table, pair), F.lit(R.DEFAULT_PENALTY)) <= limit)


# -- reasons and flags
def knockout(missing: Column, years: Column, entries: Column, stated: Column, level: Column, jd: dict[str, Column]) -> Column:
    required = jd["required"]
    low = F.lower(text_of(jd["required_degree"]))
    short = (jd["min_years"] > 0) & (years < jd["min_years"]) & (entries < 2) & (F.coalesce(stated, F.lit(0)) < jd["min_years"]) & (years < jd["min_years"] * 0.5)
    return F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("Missing must-have skills: "), F.array_join(missing, ", "))),
            F.when(short, F.concat(F.lit("Insufficient experience: "), years.cast("string"), F.lit("yr vs "), jd["min_years"].cast("string"), F.lit("yr required"))),
            F.when((jd["max_years"] < 99) & (years > jd["max_years"]), F.concat(F.lit("Exceeds maximum experience: "), years.cast("string"), F.lit("yr vs "), jd["max_years"].cast("string"), F.lit("yr max"))),
            F.when(~low.isin("any", "none", "") & (required > 0) & (level < required), F.concat(F.lit("Degree requirement not met: has level "), level.cast("string"), F.lit(", needs "), required.cast("string"))),
        )
    )


def first_gap(dated: Column, days: int = 180) -> Column:
    """Days of the first gap of more than `days` between ordered spans; null without one."""
    after = F.slice(dated, F.lit(2), F.greatest(F.size(dated) - 1, F.lit(0)))
    gaps = F.zip_with(F.slice(dated, F.lit(1), F.size(after)), after, lambda a, b: F.datediff(b["start"], a["end"]))
    return F.get(F.filter(gaps, lambda g: g > days), F.lit(0))
