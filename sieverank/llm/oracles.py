"""DuckDB SQL for those queries of this folder that SQL can express."""

from __future__ import annotations

from sieverank.llm import secret_scan as S
from sieverank.llm import url_filter as U

SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM n WHERE n >= 100)),
 r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
 g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM r WHERE k > 1),
 runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
 cuts AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, n, n FROM n),
 kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b) AS k FROM (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS before FROM cuts) JOIN n USING (doc_id) GROUP BY doc_id)
 SELECT n.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
 FROM n JOIN kept ON kept.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id) x ON x.doc_id = n.doc_id"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''").replace(r"\x20", " ") + "'"


def _spans(kind: int, pattern: str, keep: str) -> str:
    """doc_id, rank, start, stop, token of the matches of a pattern; `keep` is a condition on m and g (the value)."""
    q = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS rank, start, start + length(m) AS stop, m AS token FROM (
  SELECT doc_id, m, g, length(p) + coalesce(sum(length(p)) OVER before, 0) + coalesce(sum(length(m)) OVER before, 0) AS start FROM (
   SELECT doc_id, unnest(regexp_extract_all(t, {q}, 0)) AS m, unnest(regexp_extract_all(t, {q}, {2 if kind == 0 else 0})) AS g, unnest(regexp_split_to_array(t, {q})[:len(regexp_extract_all(t, {q}, 0))]) AS p,
    unnest(range(len(regexp_extract_all(t, {q}, 0)))) AS k FROM d WHERE regexp_matches(t, {q}))
  WINDOW before AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE {keep}"""


_TAIL = "CASE WHEN {z} > 0 THEN 0.5e0 * exp(-({z}) * ({z}) / 2) ELSE 1.0e0 END"
_SIZE = "length(regexp_replace(token, '[^A-Za-z0-9]', '', 'g'))"
_CLASSES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '[^A-Za-z0-9]', '', 'g'), '[A-Z][a-z]', 'aa', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g')"
_BAND = "CASE " + " ".join(f"WHEN stop - start < {b} THEN {i}" for i, b in enumerate(S.BANDS)) + f" ELSE {len(S.BANDS)} END"
_RATE = "CASE " + " ".join(f"WHEN k = {k} THEN {rate}e0" for k, rate in S.CHANGE_RATES.items()) + " END"
_ATANH = "0.5e0 * ln((1 + {x}) / (1 - {x}))"

SECRET_SCAN = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 base AS ({_spans(0, S.ASSIGN, f"length(g) >= {S.ASSIGN_VALUE}")} UNION ALL {_spans(1, S.LONG_ACCESS, "true")} UNION ALL {_spans(2, S.LONG_HEX, "true")}),
 seen AS ({_spans(3, "[A-Za-z0-9+/_-]{16,}={0,2}", "true")}),
 free AS (SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)),
 a AS (SELECT *, CAST(length(token) AS DOUBLE) AS n, CAST(greatest({_SIZE}, 4) AS DOUBLE) AS size, {_CLASSES} AS cl, {_BAND} AS band,
  CAST(CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 10 WHEN regexp_matches(token, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN 16 WHEN regexp_matches(token, '^(?:[a-z]+|[A-Z]+)$') THEN 26 WHEN regexp_matches(token, '^[A-Z2-7]+=*$') THEN 32
   WHEN regexp_matches(token, '^(?:[a-z0-9]+|[A-Z0-9]+)$') THEN 36 WHEN regexp_matches(token, '^[A-Za-z0-9]+$') THEN 62 ELSE 64 END AS DOUBLE) AS k,
  list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: power(CAST(length(token) - length(replace(token, c, '')) AS DOUBLE), 2))) AS squares FROM free),
 b AS (SELECT *, k * squares / n - n AS chi, (n - 1) * (k * {S.COINCIDENCE}e0 - 1) AS excess, greatest(len(regexp_extract_all(cl, 'a+|A+|0+')) - 1, 0) / (size - 1) AS rate, {_RATE} AS usual,
  power((size - length(replace(cl, 'a', ''))) / size, 2) + power((size - length(replace(cl, 'A', ''))) / size, 2) + power((size - length(replace(cl, '0', ''))) / size, 2) AS chance FROM a),
 c AS (SELECT *, CASE WHEN excess > 0 THEN {_TAIL.format(z="((k - 1 + excess - chi) / sqrt(2 * (k - 1) + 4 * greatest(excess, 0)))")} ELSE 1.0e0 END AS chi_p,
  CASE WHEN rate > usual THEN exp(-(size - 1) * (rate * ln(greatest(rate, 1e-12) / usual) + (1 - rate) * ln(greatest(1 - rate, 1e-12) / (1 - usual)))) ELSE 1.0e0 END AS runs_p,
  CASE WHEN chance > 0.999 THEN 0.999e0 ELSE greatest(least((1 - rate - chance) / (1 - chance), 0.999e0), -0.999e0) END AS r FROM b),
 e AS (SELECT *, least(chi_p, runs_p, {_TAIL.format(z=f"(({_ATANH.format(x=f'{S.COMPOSED_CORRELATION}e0')} - {_ATANH.format(x='r')}) * sqrt(greatest(least(2 * (1 - chance), 1.0e0) * size - 3, 0.0e0)))")}) AS p FROM c),
 f AS (SELECT doc_id, start, stop, band * 100 + CAST(k AS INT) AS stratum, CAST(least(floor(-log10(greatest(least(3 * p, 1.0e0), 1e-60)) / {S.BIN}e0), {S.MAX_BIN}) AS INT) AS bin FROM e),
 h AS (SELECT stratum, bin, sum(count(*)) OVER (PARTITION BY stratum) AS m, sum(count(*)) OVER (PARTITION BY stratum ORDER BY bin DESC) AS r FROM f GROUP BY stratum, bin),
 levels AS (SELECT stratum, min(bin) AS least_bin FROM h WHERE power(10.0e0, -bin * {S.BIN}e0) <= {S.FDR}e0 * r / m GROUP BY stratum),
 spans AS (SELECT doc_id, rank, start, stop FROM base UNION ALL SELECT doc_id, 3, start, stop FROM f JOIN levels USING (stratum) WHERE bin >= least_bin),
 named AS (SELECT *, ['assign', 'access', 'hex', 'random'][rank + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM spans)
 SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans FROM d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id"""

FILTER_AUDIT = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, part FROM t),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
   (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
   + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
   + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first < f.doc_id, false)::INT AS fails FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
 g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
 c AS (SELECT part, s, sum(n) FILTER (fails & s = 0) AS n, sum(good) FILTER (fails & s = 0) AS good, sum(toxic) FILTER (fails & s = 0) AS toxic
   FROM g, (SELECT unnest(range(32))::INT AS s) GROUP BY part, s),
 k AS (SELECT part, s, coalesce(n, 0) AS n, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM c),
 letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 p AS (SELECT o, step, coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(substr(o, j, 1)) - 65))), 0)::INT AS before,
   1 << (ascii(substr(o, step, 1)) - 65) AS own FROM o, (SELECT unnest(range(1, 6)) AS step)),
 q AS (SELECT b.part AS part, o AS filter_order, step, own, a.n AS kept, b.n - a.n AS removed, z.n - y.n - (b.n - a.n) AS redundant, x.n - v.n AS unique_fails,
   b.good - a.good AS good_lost, b.toxic - a.toxic AS toxic_lost
   FROM p JOIN k b ON b.s = before JOIN k a ON a.part = b.part AND a.s = before | own JOIN k z ON z.part = b.part AND z.s = 0
   JOIN k y ON y.part = b.part AND y.s = own JOIN k x ON x.part = b.part AND x.s = 31 - own JOIN k v ON v.part = b.part AND v.s = 31)
 SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM q"""

_HOST = "translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_DOTS = r"""CASE WHEN regexp_matches({0}, '/\.\.?(?:/|$)') THEN regexp_replace('/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[],
   list_transform(string_split({0}, '/')[2:], lambda s: [s])), lambda d, s: CASE WHEN s[1] = '.' THEN d WHEN s[1] = '..' THEN d[:greatest(len(d) - 1, 0)] ELSE d || s END), '/')
   || CASE WHEN regexp_matches({0}, '/\.\.?$') THEN '/' ELSE '' END, '/+$', '/') WHEN {0} = '' THEN '/' ELSE {0} END"""
_MARKUP = U.MARKUP.replace("]*+", "]*").replace("]++)*+", "]+)*").replace("'", "''")


def _attribute(name: str) -> str:
    value = rf"""'(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))'"""
    return "trim(" + " || ".join(f"regexp_extract(tag, {value}, {k})" for k in (1, 2, 3)) + ")"


def _ampersands(value: str) -> str:
    return f"regexp_replace({value}, '(?i)&amp;|&#38;|&#x26;', '&', 'g')"


def _address(url: str) -> str:
    query = rf"regexp_extract({url}, '(?s)^.*?://[^?#]*\?([^#]*)', 1)"
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{U.TRACKING}')), '&')"
    host, path = _HOST.format(url), _DOTS.format(_PATH.format(url))
    return f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END END"


def _resolved(target: str, base: str) -> str:
    origin, path = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", _PATH.format(base)
    return rf"""CASE WHEN {origin} = '' AND NOT regexp_matches({target}, '(?i)^https?://') THEN NULL WHEN {target} = '' OR {target} LIKE '#%' THEN NULL
   WHEN regexp_matches({target}, '(?i)^https?://') THEN {target} WHEN {target} LIKE '//%' THEN 'http:' || {target} WHEN {target} LIKE '/%' THEN {origin} || {target}
   WHEN {target} LIKE '?%' THEN {origin} || {path} || {target} WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
   ELSE {origin} || CASE WHEN {path} = '' THEN '/' ELSE regexp_replace({path}, '[^/]*$', '') END || {target} END"""


def _rule(host: str, path: str) -> str:
    """Number of the longest rule that fits."""
    return f"(SELECT arg_max(r, length(h) + length(p)) FROM rules WHERE ({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, p))"


URL_FILTER = rf"""WITH RECURSIVE rules(r, action, h, p) AS (VALUES {", ".join(f"({i}, '{a}', '{h}', '{p}')" for i, (a, h, p) in enumerate(U.RULES))}),
 u AS (SELECT page_id, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_address("url")} AS address FROM pages),
 t AS (SELECT url, list_filter(regexp_extract_all(coalesce(html, ''), '{_MARKUP}'), lambda x: regexp_matches(x, '(?i)^<[lmb]')) AS tags FROM pages),
 b AS (SELECT url, tags, list_filter(list_transform(list_filter(tags, lambda x: regexp_matches(x, '(?i)^<b')), lambda tag: {_attribute("href")}), lambda x: x <> '')[1] AS b0
  FROM t WHERE len(list_filter(tags, lambda x: regexp_matches(x, '(?i)canonical|refresh'))) > 0),
 b1 AS (SELECT url, tags, {_ampersands("b0")} AS b FROM b),
 x AS (SELECT url, coalesce({_resolved("b", "url")}, url) AS base, unnest(tags) AS tag FROM b1),
 y0 AS (SELECT url, base, CASE WHEN regexp_matches(tag, '(?i)^<l') AND regexp_matches({_attribute("rel")}, '(?i)(?:^|\s)canonical(?:\s|$)') THEN {_attribute("href")}
   WHEN regexp_matches(tag, '(?i)^<m') AND lower({_attribute("http-equiv")}) = 'refresh'
   THEN regexp_extract({_attribute("content")}, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS target FROM x),
 y AS (SELECT url, base, {_ampersands("target")} AS target FROM y0 WHERE target <> ''),
 yr AS (SELECT url, {_resolved("target", "base")} AS target FROM y),
 e AS (SELECT DISTINCT {_address("url")} AS a, {_address("target")} AS b FROM yr),
 e2 AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
 reach(a, b) AS (SELECT a, b FROM e2 UNION SELECT reach.a, e2.b FROM reach JOIN e2 ON reach.b = e2.a),
 ends AS (SELECT DISTINCT b, regexp_extract(b, '^[^/?#]*') AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
 judged AS (SELECT b, {_rule("host", "path")} AS r FROM ends),
 decided AS (SELECT reach.a AS address, min(action) AS decision FROM reach JOIN judged ON judged.b = reach.b JOIN rules ON rules.r = judged.r GROUP BY reach.a),
 v AS (SELECT page_id, host, path, address, {_rule("host", "path")} AS r, {_rule("host", _DOTS.format("path"))} AS r2 FROM u)
 SELECT page_id, host, path, own.h || own.p AS rule, coalesce(own.action, decision, other.action, 'allow') AS verdict,
  CASE WHEN own.r IS NOT NULL THEN 'rule' WHEN decision IS NOT NULL OR other.r IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
 FROM v LEFT JOIN rules own ON own.r = v.r LEFT JOIN rules other ON other.r = v.r2 LEFT JOIN decided ON decided.address = v.address"""

ORACLE_SQL = {
    "op1_secret_scan": SECRET_SCAN,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op11_url_filter": URL_FILTER,
    "op13_filter_audit": FILTER_AUDIT,
}
