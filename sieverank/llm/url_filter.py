"""Verdicts on addresses by host and path rules, carried over redirects and canonical links.

A page's own rule decides. A page without one takes the decision of its aliases: addresses that redirects, meta
refreshes and canonical links connect form components, the rules judge every address in them (pages or not), and a
component is allowed if one of its addresses is, else blocked if one is blocked. What nothing decides is allowed.

Only DataFrame functions are used. Rules are joined by equality on host suffixes, one join for each number of labels that
rule hosts have, so a page stays one row; components are joins and grouped minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieverank.llm.graph import components
from sieverank.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Comments and scripts are skipped as wholes; the rest are tags that can name another address.
MARKUP = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<(?:link|meta|base)\b(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
#: Query parameters that name where a visitor came from, not what is shown.
TRACKING = "^(?:utm_[a-z]+|gclid|fbclid)(?:=|$)"
#: Rows of one component that share a decision are dealt out under so many numbers.
SALTS = 16

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """action, host, path of the given rules."""
    rows = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("action", "host", "path"), r, strict=True))) for r in (RULES if rules is None else rules)]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(k) for k in ("action", "host", "path")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, A to Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """The path with . and .. segments worked out; / for an empty one."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    ends = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    worked = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), ends), "/+$", "/")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), worked).when(path == "", F.lit("/")).otherwise(path)


def address(url: Column) -> Column:
    """One name for the forms of an address that show the same: host, path and query, without scheme, fragment and
    tracking parameters. Null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    host = host_of(url)
    return F.when(host != "", F.concat(host, _without_dots(path_of(url)), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))))


def _attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*(F.regexp_extract(tag, value, k) for k in (1, 2, 3))))


def _resolved(target: Column, base: Column) -> Column:
    """An absolute form of a link found on a page; null for none, and for schemes other than http and https."""
    plain = F.regexp_replace(target, "(?i)&amp;|&#38;|&#x26;", "&")
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when((origin == "") & ~plain.rlike("(?i)^https?://"), F.lit(None))
        .when((plain == "") | plain.startswith("#"), F.lit(None))
        .when(plain.rlike("(?i)^https?://"), plain)
        .when(plain.startswith("//"), F.concat(F.lit("http:"), plain))
        .when(plain.startswith("/"), F.concat(origin, plain))
        .when(plain.startswith("?"), F.concat(origin, path_of(base), plain))
        .when(plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), plain))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """source, target (addresses) for the canonical links and meta refreshes of each page, relative ones resolved."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(f"({MARKUP})"), F.lit(1))
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.filter(tags, lambda t: t.rlike("(?i)^<[lmb]")).alias("tags"))
    rows = rows.filter(F.exists("tags", lambda t: t.rlike("(?i)canonical|refresh")))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<b")), lambda t: _attribute(t, "href")), lambda h: h != "")
    rows = rows.withColumn("base", F.coalesce(_resolved(F.get(bases, F.lit(0)), F.col("url")), F.col("url")))
    canonical = F.when(_attribute(F.col("tag"), "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"), _attribute(F.col("tag"), "href"))
    later = F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", later)
    found = rows.select("url", "base", F.explode("tags").alias("tag"))
    target = F.when(F.col("tag").rlike("(?i)^<l"), canonical).when(F.col("tag").rlike("(?i)^<m"), refresh)
    pairs = found.select("url", "base", target.alias("target")).filter("target <> ''")
    pairs = pairs.select(address(F.col("url")).alias("source"), address(_resolved(F.col("target"), F.col("base"))).alias("target"))
    return pairs.filter("source <> target")


def _fitting(path: str):
    return lambda rule: F.startswith(F.col(path), rule["path"])


def judge(rows: DataFrame, rules: DataFrame, host: str, paths: dict[str, str]) -> DataFrame:
    """`rows` with a column for each entry of `paths` (new column: path column): the rule that fits host and path, a
    struct of action and rule, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest (host and path) wins, of
    equal ones the longer host, then allow. Rules without host, path or a known action never fit. The numbers of labels
    of rule hosts are collected, a host name has at most 127.
    """
    known = rules.filter("host <> '' and path is not null and action in ('allow', 'block')")
    known = known.select("action", F.translate("host", UPPER, LOWER).alias("host"), "path").distinct()
    depths = sorted(r[0] for r in known.select(F.size(F.split("host", r"\."))).distinct().collect())
    fits = F.struct(
        F.length(F.concat("host", "path")).alias("size"),
        F.length("host").alias("host_size"),
        (F.col("action") == "allow").cast("int").alias("allow"),
        F.concat("host", "path").alias("rule"),
        F.col("path").alias("path"),
    )
    for depth in depths:
        of_depth = known.filter(F.size(F.split("host", r"\.")) == depth)
        by_host = of_depth.groupBy("host").agg(F.collect_list(fits).alias(f"_rules{depth}")).withColumnRenamed("host", f"_suffix{depth}")
        labels = F.split(F.col(host), r"\.")
        suffix = F.array_join(F.slice(labels, F.size(labels) - depth + 1, depth), ".")
        rows = rows.withColumn(f"_suffix{depth}", F.when(F.size(labels) >= depth, suffix)).join(by_host, f"_suffix{depth}", "left")
    for name, path in paths.items():
        best = [F.array_max(F.filter(f"_rules{d}", _fitting(path))) for d in depths]
        if best:
            top = F.array_max(F.array(*best))
            value = F.when(top.isNotNull(), F.struct(F.when(top["allow"] == 1, "allow").otherwise("block").alias("action"), top["rule"].alias("rule")))
        else:
            value = F.lit(None).cast("struct<action: string, rule: string>")
        rows = rows.withColumn(name, value)
    return rows.drop(*(f"_{x}{d}" for d in depths for x in ("suffix", "rules")))


def decisions(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """address, decision for every address in a component that holds one with a rule: allow comes first.

    Decisions are combined before their shuffle, one row a component; the rows of a component are dealt out under
    numbers before they meet it, as one may hold a large part of all addresses.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    found = components(edges, "source", "target")
    named = found.withColumn("host", F.regexp_extract("node", "^[^/?#]*", 0)).withColumn("path", F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1))
    judged = judge(named, rules, "host", {"own": "path"}).select("root", "own.action")
    # `allow` sorts before `block`.
    by_root = judged.filter("action is not null").groupBy("root").agg(F.min("action").alias("decision"))
    dealt = by_root.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = found.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return rows.join(dealt, ["root", "salt"]).select(F.col("node").alias("address"), "decision")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, url, host, path, rule, verdict (allow or block), decided_by (rule, alias or default) for each row.

    `redirects` (source, target: urls) adds what a crawler recorded to the canonical links and refreshes in the pages.
    A page's own rule wins over its aliases; an allowed alias over a blocked one. An address whose path is empty or holds
    dot segments is an alias of the worked-out form, so it takes that form's rule if it has none itself. A null url, or
    one without ://, has empty host and path, no rule and no alias: allow. Ids may be null or repeat, each row gives one
    row; rows of one url get one verdict; null or empty html has no links; other columns are not looked at.
    """
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        ends = [address(F.col(c).cast("string")).alias(c) for c in ("source", "target")]
        edges = edges.unionByName(redirects.select(*ends).filter("source <> target"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "address": address(F.col("url"))})
    rows = rows.withColumn("worked", _without_dots(F.col("path")))
    judged = judge(rows, rules, "host", {"own": "path", "other": "worked"}).join(decisions(edges, rules), "address", "left")
    by_alias = F.coalesce(F.col("decision"), F.col("other.action"))
    return judged.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.action"), by_alias, F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(by_alias.isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )
