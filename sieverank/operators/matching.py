"""Skill matching: fuzzy predicate, semi and anti matches, aliases, one-hop graph inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieverank.functions import literals
from sieverank.functions.text import normalize_graph_key, normalize_skill
from sieverank.registries import SKILL_ALIASES
from sieverank.session import ROWS_A_TASK, ensure_checkpoint_dir, parts_for

WEIGHTS = {"explicit": 1.0, "alias": 1.0, "inferred": 0.75, "related": 0.5}
MUST_WEIGHT = 0.75


def alias_map(aliases: dict[str, str] | None = None) -> Column:
    return literals.mapping(SKILL_ALIASES if aliases is None else aliases)


def resolve(normal: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical form of a normalised skill; itself where there is no alias."""
    return F.coalesce(F.try_element_at(alias_map(aliases), normal), normal)


def normal_match(a: Column, b: Column, a_canonical: Column, b_canonical: Column, strict: bool = False) -> Column:
    """Match of two normalised skills: equal, one canonical form, or (from three letters on) one inside the other."""
    inside = F.lit(False) if strict else (F.length(a) > 2) & (F.length(b) > 2) & (F.contains(a, b) | F.contains(b, a))
    return (a == b) | (a_canonical == b_canonical) | inside


def skills_match(a: Column, b: Column, strict: bool = False) -> Column:
    """The same for raw names."""
    x, y = normalize_skill(a), normalize_skill(b)
    return normal_match(x, y, resolve(x), resolve(y), strict)


def match_pairs(have: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """id, pos, skill, jd_id, jd_pos, jd_skill, kind for every matching pair.

    have(id, pos, skill), wanted(jd_id, jd_pos, jd_skill). The names of `have` are matched once for each distinct name,
    and by one join of equal keys: a whole name, its canonical form, and (not if strict) its pieces of the lengths that
    the other side has, so that the work grows with the names and not with their pairs.
    """
    return have.join(name_pairs(have, wanted, strict), "skill").join(wanted, "jd_skill")


def name_pairs(have: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """skill, jd_skill: the distinct names of the two that match."""
    ensure_checkpoint_dir(have.sparkSession)
    # A name is a small row with much work: by bytes alone, adaptive execution would give many names to one task.
    spread = have.sparkSession.sparkContext.defaultParallelism
    names = have.select("skill").distinct().repartition(spread, "skill").checkpoint().withColumn("n", normalize_skill(F.col("skill"))).withColumn("c", resolve(F.col("n")))
    asked = wanted.select("jd_skill").distinct().withColumn("n", normalize_skill(F.col("jd_skill"))).withColumn("c", resolve(F.col("n")))
    left, right = _match_keys(names, "skill", asked, "in", "of", strict), _match_keys(asked, "jd_skill", names, "of", "in", strict)
    return left.join(right, ["way", "key"]).select("skill", "jd_skill").distinct()


def _match_keys(names: DataFrame, name: str, others: DataFrame, own: str, theirs: str, strict: bool) -> DataFrame:
    """name, way, key of names(n, c): two names match if they share a way and key. `own` is the way of a name as a whole
    inside a name of `others`, `theirs` that of its pieces as a whole name there."""
    n, way = F.col("n"), lambda rows, w, x: rows.select(name, F.lit(w).alias("way"), x.alias("key"))
    keys = way(names, "equal", n).unionByName(way(names, "canonical", F.col("c")))
    if not strict:
        long = names.filter(F.length(n) > 2)
        lengths = others.select(F.length("n").alias("l")).filter("l > 2").agg(F.collect_set("l")).scalar()
        sized = long.withColumn("l", F.explode(lengths)).filter(F.col("l") <= F.length(n))
        pieces = sized.withColumn("i", F.explode(F.sequence(F.lit(1), F.length(n) - F.col("l") + 1)))
        keys = keys.unionByName(way(long, own, n)).unionByName(way(pieces, theirs, F.substr(n, F.col("i"), F.col("l"))))
    return keys.filter("key is not null")


def matched(have: DataFrame, wanted: DataFrame, ids: DataFrame) -> DataFrame:
    """id, jd_id, jd_skill, found for every requested skill of every id (the semi and anti match in one table)."""
    hits = match_pairs(have, wanted).select("id", "jd_id", "jd_skill").distinct().withColumn("hit", F.lit(True))
    asked = wanted.groupBy().agg(F.collect_list(F.struct("jd_id", "jd_pos", "jd_skill")).alias("asked"))
    every = ids.select("id").distinct().withColumn("asked", asked.scalar()).select("id", F.explode("asked").alias("a")).select("id", "a.*")
    return every.join(hits, ["id", "jd_id", "jd_skill"], "left").select("id", "jd_id", "jd_pos", "jd_skill", F.coalesce("hit", F.lit(False)).alias("found"))


def extra_skills(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `have` that match no requested skill."""
    used = name_pairs(have, wanted).select("skill").distinct()
    return have.join(used, "skill", "left_anti")


def graph_key(skill: Column) -> Column:
    """Key of a skill in the graph: by alias of its normal form, else of its graph form, else the graph form."""
    g = normalize_graph_key(skill)
    table = alias_map()
    return F.coalesce(F.try_element_at(table, normalize_skill(skill)), F.try_element_at(table, F.replace(g, F.lit("_"), F.lit(""))), g)


def alias_index(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """alias, key of a graph's nodes(at, key, aliases): the normal forms of each node's aliases, and its key. Of equal
    forms the later node counts, within a node the key itself."""
    forms = F.concat(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_skill), F.array("key"))
    rows = nodes.select("key", "at", F.posexplode(forms).alias("n", "alias")).filter("alias is not null")
    rows = rows.repartition(parts, "alias") if parts else rows
    return rows.groupBy("alias").agg(F.max_by("key", F.struct("at", "n")).alias("key"))


def graph_keys(skills: DataFrame, nodes: DataFrame) -> DataFrame:
    """skill, key for the distinct names of `skills` that the graph knows: by the alias of their normal form, else as a
    key in graph form, else by the alias of that form. Each way is a join by equality, whatever the size of the graph."""
    n = max(parts_for(rows, ROWS_A_TASK // 4) for rows in (skills, nodes))
    index, own = alias_index(nodes, n), nodes.select("key").repartition(n, "key").distinct()
    names = skills.select("skill").filter("skill is not null").repartition(n, "skill").distinct().withColumn("n", normalize_skill(F.col("skill"))).withColumn("g", normalize_graph_key(F.col("skill")))
    by_form = names.repartition(n, "n").join(index.select(F.col("alias").alias("n"), F.col("key").alias("k1")), "n", "left")
    by_key = by_form.repartition(n, "g").join(own.select(F.col("key").alias("g"), F.col("key").alias("k2")), "g", "left")
    by_both = by_key.join(index.select(F.col("alias").alias("g"), F.col("key").alias("k3")), "g", "left")
    return by_both.select("skill", F.coalesce("k1", "k2", "k3").alias("key")).filter("key is not null")


def infer(have: DataFrame, wanted: DataFrame, edges: DataFrame, pairs: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Best match of every requested skill for every id that has one: id, jd_id, jd_skill, source, match_type, weight.

    Order: fuzzy match, same graph key, a skill that implies it, a related one; then the position in the id's list.
    Each kind is an equi-join on graph keys; the union is ranked once. `pairs`: match_pairs of the two, if at hand.
    `nodes`: the nodes of a graph (at, key, aliases); names that it does not know have no key then. Without it, keys come
    from the aliases of the registry.
    """
    direct = (match_pairs(have, wanted) if pairs is None else pairs).select("id", "pos", "skill", "jd_id", "jd_pos", "jd_skill", F.lit("explicit").alias("match_type"), F.lit(1).alias("priority"))
    # Keys are worked out and met once for each distinct name, not for each row that has it.
    if nodes is None:
        named, w = have.select("skill").distinct().withColumn("key", graph_key(F.col("skill"))), wanted.withColumn("jd_key", graph_key(F.col("jd_skill")))
    else:
        named = graph_keys(have, nodes)
        w = wanted.join(graph_keys(wanted.select(F.col("jd_skill").alias("skill")), nodes).withColumnsRenamed({"skill": "jd_skill", "key": "jd_key"}), "jd_skill")
    columns = ["skill", "jd_id", "jd_pos", "jd_skill"]
    same = named.join(w, F.col("key") == F.col("jd_key")).select(*columns, F.lit("alias").alias("match_type"), F.lit(2).alias("priority"))
    hop = named.join(edges, F.col("key") == F.col("src")).join(w, F.col("dst") == F.col("jd_key"))
    kind = F.when(F.col("kind") == "implies", "inferred").otherwise("related")
    near = hop.select(*columns, kind.alias("match_type"), F.when(F.col("kind") == "implies", 3).otherwise(4).alias("priority"))
    linked = have.join(same.unionByName(near), "skill").select("id", "pos", *columns, "match_type", "priority")
    best = Window.partitionBy("id", "jd_id", "jd_skill").orderBy("priority", "pos", "skill")
    ranked = direct.unionByName(linked).withColumn("n", F.row_number().over(best)).filter("n = 1")
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return ranked.select("id", "jd_id", "jd_pos", "jd_skill", F.col("skill").alias("source"), "match_type", weight[F.col("match_type")].alias("weight"))
