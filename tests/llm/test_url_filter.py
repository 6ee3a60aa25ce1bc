"""Rules and aliases against a plain search over a plain graph."""

import random

from sieverank.llm import url_filter as U


def page(page_id, url, html=""):
    return (page_id, url, html, "clash", "clash")


SCHEMA = "page_id long, url string, html string, host string, verdict string"


def verdicts(spark, rows, rules=None, redirects=None):
    pages = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in U.filter_urls(pages, U.rule_table(spark, rules), redirects).select("page_id", "host", "path", "rule", "verdict", "decided_by").collect()]


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("http://A.Example.COM/en/x?y=://z#t", "a.example.com", "/en/x", "example.com/en/", "block"),
        2: ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        4: ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        5: ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        6: ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        7: ("http://a.net/FR/", "a.net", "/FR/", None, "allow"),
        8: ("no scheme", "", "", None, "allow"),
        9: (None, "", "", None, "allow"),
        10: ("http://", "", "", None, "allow"),
        11: ("http://a.net?x=/es/", "a.net", "", None, "allow"),
        12: ("x://y://z.com/", "y:", "//z.com/", None, "allow"),
        13: ("", "", "", None, "allow"),
        14: ("http:///es/", "", "/es/", None, "allow"),
        15: ("http://É.net/es/é\n?", "É.net", "/es/é\n", "net/es/", "block"),
        16: ("http://a.com", "a.com", "", None, "allow"),
        17: ("http://a.net/x/../es/1", "a.net", "/x/../es/1", None, "block"),
    }
    got = {r[0]: r[1:5] for r in verdicts(spark, [page(i, u[0]) for i, u in urls.items()])}
    assert got == {i: u[1:] for i, u in urls.items()}


def test_links_of_pages(spark):
    html = {
        "http://a.org/d/p": '<link rel="canonical" href="https://A.org/real?utm_source=x&amp;k=1#f">',
        "http://b.org/d/p": "<LINK href='../up/./x' REL=Canonical>",
        "http://c.org/d/p": '<base href="//cdn.org/b/"><meta http-equiv="Refresh" content="0; URL=\'next\'">',
        "http://d.org/d/p": '<!-- <link rel=canonical href=/no> --><script>"<link rel=canonical href=/no>"</script><link rel="alternate canonical" href=/yes>',
        "http://e.org/d/p": '<link rel=canonical href="mailto:x@y"><link rel=canonical href="#top"><link rel=canonical href><meta http-equiv=refresh content=5>',
        "http://f.org/d/p": '<link rel=canonical href="?q=2"><link data-href=/no rel=canonical><link rel=stylesheet href=/no>',
        "http://g.org/d/p": "<link rel=canonical href=http://g.org/d/p#same>",
        "http://h.org/d/p": "<!-- <link rel=canonical href=/no>",
    }
    pages = spark.createDataFrame([page(i, u, h) for i, (u, h) in enumerate(html.items())] + [page(99, None, html["http://a.org/d/p"]), page(98, "http://x.org/", None)], SCHEMA)
    got = sorted((r.source, r.target) for r in U.links(pages).collect())
    assert got == [
        ("a.org/d/p", "a.org/real?k=1"),
        ("b.org/d/p", "b.org/up/x"),
        ("c.org/d/p", "cdn.org/b/next"),
        ("d.org/d/p", "d.org/yes"),
        ("f.org/d/p", "f.org/d/p?q=2"),
    ]


def test_aliases_take_the_verdict_and_allow_comes_first(spark):
    rows = [
        page(1, "http://shop.org/a", '<link rel=canonical href="http://bad.net/es/a">'),
        page(2, "http://other.org/b", '<meta http-equiv=refresh content="0;url=http://shop.org/a">'),
        page(3, "http://good.com/c", '<link rel=canonical href="http://bad.net/es/a2">'),
        page(4, "http://free.org/d", '<link rel=canonical href="http://good.com/c">'),
        page(5, "http://bad.net/es/a2"),
        page(6, "http://alone.org/"),
        page(7, "https://OTHER.org/b?utm_medium=m#x"),
        page(7, "https://OTHER.org/b?utm_medium=m#x"),
        page(None, "http://recorded.org/1"),
    ]
    redirects = spark.createDataFrame([("http://recorded.org/1", "http://recorded.org/2"), ("http://recorded.org/2", "https://shop.org/a"), (None, "http://x.org/")], "source string, target string")
    got = [(r[0], r[4], r[5]) for r in verdicts(spark, rows, redirects=redirects)]
    want = [(None, "block", "alias"), (1, "block", "alias"), (2, "block", "alias"), (3, "allow", "rule"), (4, "allow", "alias")]
    want += [(5, "block", "rule"), (6, "allow", "default"), (7, "block", "alias"), (7, "block", "alias")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_random_graphs(spark):
    rng = random.Random(7)
    rules = [("block", "h1.org", "/"), ("allow", "h1.org", "/p1"), ("allow", "h2.org", "/p"), ("block", "org", "/p3"), ("block", "h1.org", "/p1"), ("deny", "org", "/"), ("block", "", "/")]
    names = [f"http://h{rng.randrange(40)}.org/p{rng.randrange(12)}" for _ in range(300)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(140)] + [(names[0], n) for n in names[-40:]]
    rows = [page(i, u, "".join(f'<link rel="canonical" href="{b}">' for a, b in links if a == u)) for i, u in enumerate(names)]

    def own(url):
        host, path = url[7:].split("/", 1)
        fits = [(len(h + p), len(h), a == "allow", h + p) for a, h, p in rules if a != "deny" and h and (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits) if fits else None

    label = {u: u for u in names}
    for _ in range(300):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = []
    for i, u in enumerate(names):
        mine = own(u)
        others = [own(v)[2] for v in set(names) if label[v] == label[u] and own(v)]
        want.append((i, mine[3] if mine else None, "allow" if (mine[2] if mine else any(others) or not others) else "block"))
    got = [(r[0], r[3], r[4]) for r in verdicts(spark, rows, rules)]
    assert sorted(got) == want
    assert {r[2] for r in want} == {"allow", "block"}


def test_empty_tables(spark):
    assert verdicts(spark, []) == []
    assert [r[3:] for r in verdicts(spark, [page(1, "http://a.com/")], rules=[])] == [(None, "allow", "default")]
