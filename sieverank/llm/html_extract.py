"""Main-text extraction with a tree-structured graphical model.

A page is parsed into a tree of block elements whose leaves are text blocks. Each node has a hidden state, content or
not. A potential on each parent and child ties the child's state and its looks (tag, words of class, id and role, link
share, length of a text block, tags beneath) to the parent's state. Sum-product messages go up from the
leaves and down from the root; the product at a node is its exact marginal, as the graph is a tree. Text blocks whose
marginal of content is over one half are the main text.

All potentials are smoothed counts over labelled pages. The labelled pages are made by `labelled_pages`: page layouts
put together at random from the ways in which sites mark up articles, menus, adverts, notices and so on, with the
state of each element known; their number is a parameter and does not depend on the corpus.

Defined results: a null or empty page gives an empty text; so does a page without content. White space inside a block
(line breaks of <br> included) becomes one space, blocks are joined by one line feed in page order, nothing else is
dropped. Repeated rows are extracted row by row; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieverank.llm.batching import tidy

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NESTED = frozenset("svg math template canvas object audio video".split())
CHOICES = frozenset("select option button datalist".split())
METADATA = frozenset("head meta link base".split())
DROPPED = RAW | NESTED | CHOICES
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input acronym data ruby rt rp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^>]*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
WORD = re.compile(r"[a-z]+")
PAGES, SEED, SMOOTHING = 600, 11, 0.5


class Node:
    """A block element, or a text block (tag "#text")."""

    __slots__ = ("tag", "marks", "children", "parts", "linked", "chars", "parent", "label", "under")

    def __init__(self, tag: str, marks: frozenset, parent: Node | None, label: int | None = None):
        self.tag, self.marks, self.parent, self.label = tag, marks, parent, label
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.linked = self.chars = 0  # characters in links and in all, of the whole subtree once parsed


@lru_cache(maxsize=64)
def _tag(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?![^\s/>])[^>]*>", re.I)


BLOCK_START = re.compile(rf"<(?:/?(?:{'|'.join(sorted(CLOSES_P | {'body', 'html', 'tr', 'td', 'th', 'li', 'dt', 'dd'}))}))(?![^\s/>])", re.I)


def after_dropped(page: str, tag: str, at: int, self_closed: bool) -> int:
    """Where a page goes on after the start tag of an element that shows no text.

    Code goes on to its end tag, or to the end of the page. Elements that nest end at the tag that balances them, others
    at their first end tag unless another of them opens before. One that is never closed is only its start tag; a choice
    or button that is never closed ends before the next block.
    """
    if self_closed and tag in NESTED:
        return at
    if tag in ("script", "style"):
        over = next((m for m in _tag(tag).finditer(page, at) if m[1]), None)
        return over.end() if over else len(page)
    depth, first = 1, None
    for m in _tag(tag).finditer(page, at):
        if m[1]:
            first = first or m
            depth -= 1
            if depth == 0:
                return m.end()
        elif tag not in NESTED:
            break
        elif not m[0].endswith("/>"):
            depth += 1
    if first is not None:
        return first.end()
    if tag in CHOICES:
        block = BLOCK_START.search(page, at)
        return block.start() if block else len(page)
    return at


def parse(page: str | None, labelled: bool = False) -> Node:
    """The tree of a page; unclosed and misnested tags are closed as browsers do for blocks. Only a labelled page's
    states are read from it."""
    root = Node("#root", frozenset(), None)
    page = page or ""
    stack = [root]
    open_text: Node | None = None
    links, at = 0, 0
    last = page.rfind(">")  # nothing after the last ">" can be a tag

    def text(raw: str) -> None:
        nonlocal open_text
        if open_text is None:
            if not raw.strip():
                return
            open_text = Node("#text", frozenset(), stack[-1])
            stack[-1].children.append(open_text)
        value = html.unescape(raw) if "&" in raw else raw
        open_text.parts.append(value)
        open_text.chars += len(value)
        if links:
            open_text.linked += len(value)

    def close(i: int) -> None:
        nonlocal open_text
        del stack[i:]
        open_text = None

    end = len(page)
    while at < end:
        found = TOKEN.search(page, at) if at <= last else None
        stop = found.start() if found else end
        if stop > at:
            text(page[at:stop])
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        tag = name.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                text(" ")
            elif tag not in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        links = 0
                        break
            continue
        if tag in METADATA:  # a head is not always closed; what it holds shows no text
            continue
        if tag in DROPPED:
            at = after_dropped(page, tag, at, attributes.endswith("/"))
            continue
        if tag == "a":
            links = 1
            continue
        if tag == "br":
            text(" ") if open_text is not None else None
            continue
        if tag in INLINE:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table", "button", "li") and tag != "p":
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPES[tag]:
                    break
                if stack[i].tag in SIBLINGS[tag]:
                    close(i)
                    break
        if tag == "body" or tag == "html":
            if any(n.tag == tag for n in stack):
                continue
        open_text, links = None, 0
        marks, label = set(), None
        if attributes:
            for key, value in ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id", "role", "itemprop", "aria-label"):
                    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
                    marks.update(WORD.findall(spaced.lower()))
                elif labelled and key == "data-state":
                    label = int(value.strip("\"'"))
        node = Node(tag, frozenset(marks), stack[-1], label)
        stack[-1].children.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    for node in reversed(in_order(root)):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return root


def block_text(node: Node) -> str:
    return " ".join("".join(node.parts).split())


def features(node: Node) -> list[str]:
    """What a node looks like; none of it depends on the state."""
    share = node.linked / max(1, node.chars)
    if node.tag != "#text":
        paragraphs = min(3, sum(c.tag == "p" for c in node.children))
        out = [f"tag:{node.tag}:{0 if share == 0 else 1 if share < 0.5 else 2}", f"p:{paragraphs}"]
        out += [f"mark:{m}" for m in node.marks] or [f"unmarked:{node.tag}"]
        if node.tag in ("header", "footer", "aside", "form", "nav") and node.parent is not None:
            out.append(f"in:{'body' if node.parent.tag in ('body', 'html', '#root') else 'other'}>{node.tag}")
        return out
    value = block_text(node)
    n = len(value)
    size = 0 if n < 25 else 1 if n < 80 else 2 if n < 200 else 3
    ended = value[-1:] in ".!?…。\"”’"
    return [f"link:{min(3, int(share * 4))}", f"size:{size}", f"ended:{ended}"]


def in_order(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


class Model:
    """edge[kind] and looks[feature]: log potentials as tables [state of the parent][state of the node].

    What a node looks like is counted by both states: a heading within a comment list and one within an article are
    different things, and the parent's state tells them apart.
    """

    def __init__(self, pages: Iterable[str]):
        looks: dict[str, list[list[float]]] = {}
        total = [[0.0, 0.0], [0.0, 0.0]]
        edges: dict[str, list[list[float]]] = {}
        for page in pages:
            nodes = in_order(parse(page, labelled=True))
            for node in reversed(nodes):  # unlabelled elements hold content if something beneath does; text as its element
                if node.tag == "#text":
                    up = node.parent
                    while up is not None and up.label is None:
                        up = up.parent
                    node.under = up.label if up is not None else 0
                else:
                    below = any(c.under for c in node.children)
                    node.under = node.label if node.label == 0 else int(below)
            for node in nodes:
                if node.parent is not None:
                    i, j = node.parent.under, node.under
                    total[i][j] += 1
                    for f in features(node):
                        looks.setdefault(f, [[0.0, 0.0], [0.0, 0.0]])[i][j] += 1
                    edges.setdefault(kind(node), [[0.0, 0.0], [0.0, 0.0]])[i][j] += 1
        spread = SMOOTHING * len(looks)
        self.looks = {f: [[math.log((c[i][j] + SMOOTHING) / (total[i][j] + spread)) for j in (0, 1)] for i in (0, 1)] for f, c in looks.items()}
        self.edge = {k: [[math.log((c[i][j] + SMOOTHING) / (sum(c[i]) + 1)) for j in (0, 1)] for i in (0, 1)] for k, c in edges.items()}

    def potential(self, node: Node) -> tuple[float, float, float, float]:
        """Log potential of a node and its parent: states (0, 0), (0, 1), (1, 0), (1, 1)."""
        (a, b), (c, d) = self.edge[kind(node)]
        for f in features(node):
            known = self.looks.get(f)
            if known is not None:
                (w, x), (y, z) = known
                a, b, c, d = a + w, b + x, c + y, d + z
        return a, b, c, d

    def marginals(self, root: Node) -> dict[int, float]:
        """id of each text node -> probability of content, by messages up and down the tree."""
        nodes = in_order(root)
        tie = {id(n): self.potential(n) for n in nodes if n.parent is not None}
        belief = {id(n): [0.0, 0.0] for n in nodes}
        up: dict[int, tuple[float, float]] = {}  # message of a node to its parent, by the parent's state
        for node in reversed(nodes):
            if node.parent is None:
                continue
            b0, b1 = belief[id(node)]
            a, b, c, d = tie[id(node)]
            message = up[id(node)] = (_add(a + b0, b + b1), _add(c + b0, d + b1))
            parent = belief[id(node.parent)]
            parent[0] += message[0]
            parent[1] += message[1]
        out = {}
        for node in nodes:
            own = belief[id(node)]
            if node.parent is not None:
                p, m = belief[id(node.parent)], up[id(node)]
                q0, q1 = p[0] - m[0], p[1] - m[1]  # the parent without what this node told it
                a, b, c, d = tie[id(node)]
                own[0] += _add(a + q0, c + q1)
                own[1] += _add(b + q0, d + q1)
            if node.tag == "#text":
                out[id(node)] = 1 / (1 + math.exp(max(-700.0, min(700.0, own[0] - own[1]))))
        return out


def kind(node: Node) -> str:
    return "#text" if node.tag == "#text" else "#element"


def _add(a: float, b: float) -> float:
    top, low = (a, b) if a > b else (b, a)
    return top + math.log1p(math.exp(low - top))


# -- labelled pages: vocabulary of mark-up, as fixed values
CONTENT_BOXES = ["article", "main", "section", 'div class="{}"', 'div id="{}"', 'article class="{}"']
CONTENT_MARKS = "content article post entry story text body main page-content entry-content article-body post-content story-body post-body article__body main-content markdown prose".split()
BOILERPLATE = {
    "nav": ["nav", 'div class="{}"', 'ul class="{}"', 'div id="{}"', 'nav class="{}"', 'div role="navigation"'],
    "header": ["header", 'div class="{}"', 'div id="{}"', 'header class="{}"'],
    "footer": ["footer", 'div class="{}"', 'div id="{}"', 'footer class="{}"'],
    "side": ["aside", 'div class="{}"', 'div id="{}"', 'aside class="{}"', 'section class="{}"'],
    "ad": ['div class="{}"', 'div id="{}"', 'aside class="{}"', 'section class="{}"'],
    "notice": ['div class="{}"', 'div id="{}"', 'p class="{}"', 'section class="{}"'],
    "form": ["form", 'form class="{}"', 'div class="{}"'],
    "comments": ['div id="{}"', 'section class="{}"', 'div class="{}"', 'ol class="{}"', 'section id="{}"'],
}
MARKS = {
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs pagination pager toc links tabs site-nav".split(),
    "header": "header site-header masthead topbar top-bar page-header branding logo banner-top".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer credits".split(),
    "side": "sidebar side widget widgets related related-posts aside recommended more-stories trending popular share social author-box tags rail".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner promoted ad-slot google-ad adbox commercial".split(),
    "notice": "notice cookie cookies cookie-banner consent alert gdpr popup modal newsletter subscribe paywall disclaimer warning message".split(),
    "form": "form search login signup contact-form search-form subscribe-form".split(),
    "comments": "comments comment commentlist discussion responses replies comment-list disqus reader-comments respond".split(),
}


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[str]:
    """Pages whose elements carry data-state: 1 for content, 0 for anything else."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def sentence(least: int, most: int, stop: bool = True) -> str:
        s = " ".join(word() for _ in range(rng.randint(least, most))).capitalize()
        return s + rng.choice(".....!?") if stop else s

    def box(forms: list[str], marks: list[str], state: int, inside: str) -> str:
        opening = rng.choice(forms).format(rng.choice(marks))
        return f'<{opening} data-state="{state}">{inside}</{opening.split()[0]}>'

    def links(k: int) -> str:
        return "".join(f'<li data-state="0"><a href="/">{sentence(1, 4, rng.random() < 0.2)}</a></li>' for _ in range(k))

    def boilerplate(kind: str) -> str:
        if kind == "nav":
            body = links(rng.randint(2, 9))
            body = body if rng.random() < 0.3 else f'<ul data-state="0">{body}</ul>'
        elif kind == "form":
            body = f'<div data-state="0">{sentence(1, 4, False)} <input name="q"></div>' + (f'<p data-state="0">{sentence(3, 15)}</p>' if rng.random() < 0.5 else "")
        elif kind == "comments":
            each = rng.choice(['<li class="comment" data-state="0">{}</li>', '<div class="comment" data-state="0">{}</div>', '<article class="comment" data-state="0">{}</article>'])
            body = f'<h3 data-state="0">{sentence(1, 3, False)}</h3>' + "".join(each.format(f'<p data-state="0">{sentence(4, 60)}</p>') for _ in range(rng.randint(1, 5)))
        elif kind == "side":
            body = rng.choice([f'<h3 data-state="0">{sentence(1, 4, False)}</h3><ul data-state="0">{links(rng.randint(2, 6))}</ul>', f'<p data-state="0">{sentence(4, 40)}</p>'])
        elif kind == "header":
            body = rng.choice([f'<a href="/">{sentence(1, 3, False)}</a>', f'<div data-state="0">{sentence(1, 6, False)}</div>', f'<p data-state="0">{sentence(2, 9)}</p>', f'<h1 data-state="0"><a href="/">{sentence(1, 3, False)}</a></h1>'])
        else:
            body = rng.choice([sentence(2, 30), f'<p data-state="0">{sentence(2, 40)}</p>', f'<p data-state="0"><a href="/">{sentence(2, 9, False)}</a></p>', f'&copy; {sentence(2, 14)}', f'<div data-state="0">{sentence(2, 14)}</div>'])
        return box(BOILERPLATE[kind], MARKS[kind], 0, body)

    def block() -> str:
        r = rng.random()
        if r < 0.72:
            own = sentence(4, 90)
            if rng.random() < 0.25:
                own += f' <a href="/">{sentence(1, 5, False)}</a> ' + sentence(2, 20)
            own = "<b>" + own + "<br>" if rng.random() < 0.12 else own
            return f'<p data-state="1">{own}' + ("</p>" if rng.random() < 0.85 else "")
        if r < 0.82:
            h = rng.choice(["h2", "h3", "h4"])
            return f'<{h} data-state="1">{sentence(1, 8, False)}</{h}>'
        if r < 0.90:
            return '<ul data-state="1">' + "".join(f'<li data-state="1">{sentence(2, 20, rng.random() < 0.5)}</li>' for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.94:
            return f'<blockquote data-state="1"><p data-state="1">{sentence(4, 40)}</p></blockquote>'
        if r < 0.97:
            return '<table data-state="1">' + "".join(f'<tr data-state="1"><td data-state="1">{sentence(1, 5, False)}</td><td data-state="1">{sentence(1, 5, False)}</td></tr>' for _ in range(rng.randint(1, 4))) + "</table>"
        return rng.choice([f'<pre data-state="1">{sentence(3, 30)}</pre>', f'<figure data-state="1"><figcaption data-state="1">{sentence(3, 15)}</figcaption></figure>', f'<div data-state="1">{sentence(8, 60)}</div>'])

    for _ in range(n):
        title = f'<h1 data-state="1">{sentence(2, 12, rng.random() < 0.4)}</h1>'
        if rng.random() < 0.2:
            title = f'<header data-state="1">{title}</header>'
        body = [block() for _ in range(rng.choice([1, 2, 4, 8, 15, 25]))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            body.insert(rng.randint(0, len(body)), boilerplate(rng.choice(["ad", "side", "notice", "form", "nav", "footer"])))
        if rng.random() < 0.15:
            body.append(boilerplate("comments"))
        article = box(CONTENT_BOXES, CONTENT_MARKS, 1, title * (rng.random() < 0.85) + "".join(body))
        for _ in range(rng.choice([0, 0, 1, 2])):
            article = rng.choice(['<div data-state="1">{}</div>', '<main data-state="1">{}</main>', '<div class="container" data-state="1">{}</div>', '<div id="wrapper" data-state="1">{}</div>']).format(article + (boilerplate("side") if rng.random() < 0.4 else ""))
        before = [boilerplate(k) for k in ("notice", "header", "nav", "ad") if rng.random() < 0.6]
        after = [boilerplate(k) for k in ("comments", "side", "ad", "form", "footer", "notice") if rng.random() < 0.4]
        yield "<html><body>" + "".join(before) + article + "".join(after) + "</body></html>"


@lru_cache(maxsize=1)
def default_model() -> Model:
    return Model(labelled_pages())


def extract(page: str | None, model: Model) -> str:
    if not page:
        return ""
    root = parse(page)
    chance = model.marginals(root)
    return "\n".join(t for n in in_order(root) if n.tag == "#text" and chance[id(n)] > 0.5 and (t := block_text(n)))


def main_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; no shuffle."""
    model = model or default_model()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h, model) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(tidy(run), "page_id long, url string, text string, n_chars long")
