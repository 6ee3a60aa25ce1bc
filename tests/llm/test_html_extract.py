"""Marginals against brute force over all states, held-out accuracy, and the fixture's pages by their layout."""

import html
import itertools
import math
import re

from sieverank.llm import html_extract as H


def test_marginals_equal_enumeration():
    model = H.default_model()
    root = H.parse('<body><nav><a href="/">x</a></nav><article><p>Some longer text of a page.</p><div class="ad">Buy</div></article></body>')
    nodes = H.in_order(root)
    assert len(nodes) == 9
    weights = {}
    for states in itertools.product((0, 1), repeat=len(nodes)):
        of = {id(n): s for n, s in zip(nodes, states, strict=True)}
        w = sum(model.potential(n)[2 * of[id(n.parent)] + of[id(n)]] for n in nodes if n.parent)
        weights[states] = math.exp(w)
    total = sum(weights.values())
    got = model.marginals(root)
    for i, n in enumerate(nodes):
        if n.tag == "#text":
            want = sum(w for s, w in weights.items() if s[i]) / total
            assert abs(got[id(n)] - want) < 1e-9


def test_held_out_labelled_pages():
    model = H.default_model()
    right = total = 0
    for page in H.labelled_pages(150, seed=99):
        root = H.parse(page, labelled=True)
        chance = model.marginals(root)
        for node in H.in_order(root):
            if node.tag == "#text":
                up = node.parent
                while up is not None and up.label is None:
                    up = up.parent
                total += 1
                right += (chance[id(node)] > 0.5) == bool(up is not None and up.label)
    assert right / total > 0.97


def test_fixture_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
        assert got[r.page_id].text == "\n".join(w for w in want if w)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_broken_mark_up_and_odd_rows(spark):
    model = H.default_model()
    long = "A sentence that is long enough to be read as a part of the article itself, again and again."
    assert H.extract(f"<article><p>{long}<p>{long} &amp; &lt;b&gt;&nbsp;x</article>", model) == f"{long}\n{long} & <b> x"
    assert H.extract(f'<article><p title="a > b">{long}</p><script>"</p>"</script><p>{long}', model) == f"{long}\n{long}"
    assert H.extract(f'<article><p class="a>{long}</p><p>{long}</p></article>', model).endswith(long)
    assert H.extract("<" * 5000 + "<div" * 3000, model) is not None
    assert H.extract("<div>" * 5000 + long, model) is not None
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", "", "t"), (None, "u", f"<article><p>{long}</p></article>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in H.main_text(df).collect()) == [0, 0, len(long)]
    assert H.main_text(df.limit(0)).count() == 0


def test_elements_that_are_not_closed_lose_no_page():
    model = H.default_model()
    long = "A sentence that is long enough to be read as a part of the article itself, again and again."
    body = f"<article><h1>A title of the page</h1><p>{long}</p><p>{long}</p></article>"
    want = H.extract(f"<html><body>{body}</body></html>", model)
    assert want.count(long) == 2
    for broken in (
        f'<html><head><title>t</title><meta charset="u"><body>{body}',  # a head without an end
        f'<html><head><title>t</title><link rel="x">{body}',
        f"<body><div><select><option>one<option>two</div>{body}",
        f"<body><button>menu<div></div>{body}",
        f'<body><svg viewBox="0 0 1 1"/>{body}',
        f"<body><svg><path d='m'>{body}",
        f'<body><iframe src="x"/>{body}',
        f'<body><iframe src="x">{body}',
        f"<body><svg><svg><text>a</text></svg><text>b</text></svg>{body}",
        f"<body><template><template><p>x</p></template><p>{long}</p></template>{body}",
    ):
        assert H.extract(broken, model) == want, broken
    assert H.extract(f'<div data-state="open"><p data-state="x">{long}</p></div>' + body, model).count(long) >= 2
    assert H.extract(f"<body><script>var a = '<script>';</script>{body}", model) == want
