"""HTML extraction: gradient-boosted trees over DOM nodes, with a decoding that keeps ancestors and descendants in line.

A page is parsed to a tree of block elements. Two models tell for every node whether all of its text is the article's,
and whether none of it is, from its size, text and link density, attribute words, depth and siblings. Decoding picks for
the whole tree the likeliest labels in which everything below a kept node is kept and below a dropped one dropped.
The models are trained here, on pages that fixed generators write with known articles (their number is the bound): pages
of sections with names, and of other makes, with tables for layout, without a body, without names, with headers in articles.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.boosting import BoostedTrees
from granary.llm.common import Shipped, pick

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br picture source svg path".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object select title".split())
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(?=[A-Za-z/])[^>]*(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MAIN_TAGS, ASIDE_TAGS = ("article", "main"), ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head")
GROUPS = (
    frozenset("article content main post entry story body text prose copy blog news paragraph".split()),
    frozenset("nav menu navbar navigation breadcrumb breadcrumbs toc links tabs pagination pager topbar skip".split()),
    frozenset("footer header masthead copyright legal colophon bottom site".split()),
    frozenset("ad ads advert advertisement banner sponsor sponsored promo promotion adsense".split()),
    frozenset("sidebar aside related widget recommended popular trending more tags archive share social".split()),
    frozenset("comment comments reply replies discussion respond disqus thread".split()),
    frozenset("cookie cookies consent notice alert modal popup overlay newsletter subscribe signup login form search gdpr warning".split()),
)


#: What is said under pages and over them, more than in them, in texts of so many characters at most.
SHORT = 300
SAID = re.compile(r"(?i)©|\b(?:copyright|all rights reserved|cookies?|subscribe|sign (?:in|up)|log ?in|privacy|terms of|powered by|advertisement)\b")


class Node:
    __slots__ = ("children", "depth", "links", "marks", "parent", "tag", "texts", "words")

    def __init__(self, tag: str, words: set, parent: Node | None) -> None:
        self.tag, self.words, self.parent, self.depth = tag, words, parent, parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.texts: list[tuple[int, str]] = []  # block number in the page, text
        self.links = self.marks = 0


def parse(page: str) -> list[Node]:
    """Block elements in page order, the root first. Unclosed and crossed tags are mended as browsers do, in the main."""
    root = Node("#root", set(), None)
    nodes, here, at, block, link = [root], root, 0, 0, 0
    pending: list[str] = []

    def flush() -> None:
        nonlocal block
        text = " ".join(entities.unescape("".join(pending)).split())
        pending.clear()
        if text:
            here.texts.append((block, text))
            block += 1

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            pending.append(text)
            if link:
                here.links += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if tag in INLINE and tag not in RAW:
            if tag == "br":
                pending.append(" ")
            elif tag == "a":
                link = 0 if m[1] else 1
            here.marks += 1
            continue
        if tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
            continue
        flush()
        link = 0
        if m[1]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        while here is not root and tag in CLOSES.get(here.tag, ()):
            here = here.parent
        if tag in VOID:
            continue
        words = {w.lower() for x in NAMED.findall(m[3]) for w in WORD.findall("".join(x))} if m[3] else set()
        node = Node(tag, words, here)
        here.children.append(node)
        nodes.append(node)
        here = node
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node: size, densities, attribute words (its own and its ancestors'), depth, siblings."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([index[id(x.parent)] if x.parent else 0 for x in nodes])
    own = np.array([[sum(len(t) for _, t in x.texts), len(x.texts), x.links, x.marks, 1, sum(t.count(".") + t.count(",") for _, t in x.texts), x.tag == "p", x.tag in ("li", "a"), any(w in GROUPS[0] for w in x.words)] for x in nodes], float).reshape(n, 9)
    sums = own.copy()
    for i in range(n - 1, 0, -1):  # children stand after their parents
        sums[parent[i]] += sums[i]
    above = np.zeros((n, len(GROUPS) + 2))
    flags = np.array([[*(bool(x.words & g) for g in GROUPS), x.tag in MAIN_TAGS, x.tag in ASIDE_TAGS] for x in nodes], float).reshape(n, -1)
    for i in range(1, n):
        above[i] = np.maximum(above[parent[i]], flags[parent[i]])
    # Tags of asides that stand in a main one, the nearest of the two, and whether a heading is below.
    main, aside = flags[:, -2] > 0, flags[:, -1] > 0
    nearest, within = np.zeros(n), np.zeros(n)
    for i in range(n):
        nearest[i] = 1 if main[i] else -1 if aside[i] else nearest[parent[i]]
        within[i] = within[parent[i]] or (aside[i] and above[parent[i], -2] + flags[parent[i], -2] > 0)
    heads = np.array([[x.tag in ("h1", "h2"), sum(len(t) <= SHORT and SAID.search(t) is not None for _, t in x.texts), max((len(t) for _, t in x.texts), default=0)] for x in nodes], float).reshape(n, 3)
    longest = heads[:, 2].copy()
    for i in range(n - 1, 0, -1):
        heads[parent[i], :2] += heads[i, :2]
        longest[parent[i]] = max(longest[parent[i]], longest[i])
    more = np.column_stack([nearest, within, heads[:, 0] > 0, heads[:, 1] / np.maximum(1, sums[:, 1]), np.log1p(longest), longest / max(1.0, longest[0])])
    brothers = np.array([len(x.parent.children) if x.parent else 1 for x in nodes])
    position = np.zeros(n)
    for x in nodes:
        for j, c in enumerate(x.children):
            position[index[id(c)]] = j / max(1, len(x.children) - 1)
    length = sums[:, 0]
    of_page, of_parent = length / max(1.0, length[0]), length / np.maximum(1, length[parent])
    depth = np.array([x.depth for x in nodes])
    heading = np.array([x.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for x in nodes])
    block = np.array([x.tag in ("p", "blockquote", "pre", "td", "figcaption", "dd") for x in nodes])
    lists = np.array([x.tag in ("ul", "ol", "li", "dl") for x in nodes])
    return np.column_stack([np.log1p(length), np.log1p(own[:, 0]), sums[:, 2] / np.maximum(1, length), length / sums[:, 4], sums[:, 5] / np.maximum(1, length), np.log1p(sums[:, 6]), np.log1p(sums[:, 7]), of_page, of_parent, depth, brothers, position, heading, block, lists, np.array([x.tag == "div" for x in nodes]), flags, above, np.log1p(sums[:, 8]), more])


def decode(nodes: list[Node], keep: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Which nodes' own text is kept: the likeliest labels with all below a kept node kept and all below a dropped one dropped."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    k, d = np.log(np.clip(keep, 1e-4, 1)), np.log(np.clip(none, 1e-4, 1))
    m = np.log(np.clip(1 - keep - none, 1e-4, 1))
    best = np.zeros(n)
    all_k, all_d, mixed = k.copy(), d.copy(), m.copy()
    for i in range(n - 1, -1, -1):
        if not nodes[i].children:
            mixed[i] = -np.inf if not nodes[i].texts else m[i]
        best[i] = max(all_k[i], all_d[i], mixed[i])
        if i:
            p = index[id(nodes[i].parent)]
            all_k[p] += all_k[i]
            all_d[p] += all_d[i]
            mixed[p] += best[i]
    out = np.zeros(n, bool)
    state = np.zeros(n, np.int8)  # 1 kept, -1 dropped, 0 mixed
    for i in range(n):
        above = state[index[id(nodes[i].parent)]] if i else 0
        state[i] = above or (1 if all_k[i] >= best[i] else -1 if all_d[i] >= best[i] else 0)
        out[i] = state[i] == 1 or (state[i] == 0 and keep[i] > none[i])
    return out


def outside(nodes: list[Node], lean: np.ndarray) -> np.ndarray:
    """For a page of which nothing would be kept: the nodes outside of everything that by its tag or names isn't the article, which aren't links, and which don't lean towards none much more than the best of them."""
    index = {id(x): i for i, x in enumerate(nodes)}
    shut, out = np.zeros(len(nodes), bool), np.full(len(nodes), -np.inf)
    for i, x in enumerate(nodes):
        shut[i] = (i and shut[index[id(x.parent)]]) or x.tag in ASIDE_TAGS or any(x.words & g for g in GROUPS[1:])
        size = sum(len(t) for _, t in x.texts)
        if size and not shut[i] and x.links * 2 < size and not all(len(t) <= SHORT and SAID.search(t) for _, t in x.texts):
            out[i] = lean[i]
    return (out > -np.inf) & (out >= out.max() - 0.3)


def write_page(r: random.Random) -> tuple[str, set[str]]:
    """A made-up page and the blocks of its article. Every block is told apart by a number in it."""
    words = [("".join(r.choices("aeioulnrstdm", k=r.randint(2, 9)))) for _ in range(60)]
    count = [0]

    def say(a: int, b: int) -> str:
        count[0] += 1
        return " ".join(r.choices(words, k=r.randint(a, b))).capitalize() + f" {count[0]}{r.choice(['.', '', '.', ','])}"

    blocks: set[str] = set()

    def main(text: str) -> str:
        blocks.add(text)
        return text

    attribute = lambda *names: r.choice(["", *(f' {r.choice(["class", "class", "id"])}="{x}{r.choice(["", " box", "-1", " clearfix"])}"' for x in names * 2)])
    link_list = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(n)) + "</ul>"
    semantic = r.random() < 0.7
    tag = lambda name: name if semantic and r.random() < 0.9 else "div"

    def wrap(name: str, names: tuple, inner: str) -> str:
        t = tag(name)
        attributes = attribute(*names)
        if t == "div" and not attributes:
            attributes = f' class="{r.choice(names)}"'
        return f"<{t}{attributes}>{inner}</{t}>"

    def noise() -> str:
        return r.choice([
            lambda: f'<div class="{r.choice(["ad", "ads", "banner", "sponsored", "advert", "promo"])}">{say(2, 25)}</div>',
            lambda: wrap("aside", ("sidebar", "related", "widget", "share"), r.choice([link_list(r.randint(2, 5)), f"<p>{say(3, 25)}</p>"])),
            lambda: f'<div class="{r.choice(["cookie-notice", "newsletter", "alert", "consent", "popup"])}"><p>{say(4, 25)}</p></div>',
            lambda: f'<form{attribute("search", "login", "signup")}><label>{say(1, 4)}</label><input name="q"><button>{say(1, 2)}</button></form>',
            lambda: wrap("nav", ("menu", "nav", "breadcrumb", "pagination"), link_list(r.randint(2, 7))),
        ])()

    def paragraph() -> str:
        text = main(say(1, 90) if r.random() < 0.9 else say(1, 3))
        shown = f"<b>{text}</b>" if r.random() < 0.2 else f'<a href="/x">{text}</a>' if r.random() < 0.05 else text
        return r.choice([f"<p>{shown}</p>"] * 8 + [f"<p>{shown}", f"<p><b>{text}<br>", f"<blockquote><p>{text}</p></blockquote>", f"<div>{text}</div>", f"<pre>{text}</pre>"])

    def content() -> str:
        kind = r.random()
        if kind < 0.78:
            return paragraph()
        if kind < 0.85:
            return f"<h{r.randint(2, 4)}>{main(say(1, 8))}</h2>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{main(say(2, 15))}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if kind < 0.95:
            return f"<table><tr><td>{main(say(1, 5))}</td><td>{main(say(1, 5))}</td></tr></table>"
        return noise()

    inner = (f"<h1>{main(say(3, 12))}</h1>" if r.random() < 0.9 else "") + "".join(content() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12])))
    if r.random() < 0.1:
        inner += main(say(4, 40))
    body = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"]) if semantic else '<div class="' + r.choice(["content", "post", "entry-content", "article-body", "story", "main"]) + '">{}</div>'
    page = [wrap("header", ("header", "masthead", "top"), say(1, 5)) if r.random() < 0.4 else "", wrap("nav", ("nav", "menu"), link_list(r.randint(2, 8))) if r.random() < 0.8 else ""]
    page += [noise() for _ in range(r.randint(0, 3))] + [body.format(inner)] + [noise() for _ in range(r.randint(0, 2))]
    if r.random() < 0.35:
        page.append(f'<{tag("section")} class="{r.choice(["comments", "comment-list", "discussion"])}">' + "".join(f'<div class="comment"><p>{say(3, 50)}</p></div>' for _ in range(r.randint(1, 4))) + "</section>")
    page.append(wrap("footer", ("footer", "copyright"), r.choice([f"&copy; {say(2, 30)}", f"<p>{say(2, 30)}</p>"])) if r.random() < 0.9 else "")
    return "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><!-- x -->" + "".join(page) + "</body></html>", blocks


def write_other_page(r: random.Random) -> tuple[str, set[str]]:
    """A page of another make, and the blocks of its article."""
    words = [("".join(r.choices("aeioulnrstdm", k=r.randint(2, 9)))) for _ in range(60)]
    count, blocks = [0], set()
    legal = lambda: r.choice(["&copy; 2019", "Copyright 2003", "All rights reserved.", "Privacy", "Powered by", "Cookies"])
    many = lambda n, f, glue="": glue.join(f() for _ in range(n))

    def say(a: int, b: int) -> str:
        count[0] += 1
        return " ".join(r.choices(words, k=r.randint(a, b))).capitalize() + f" {count[0]}{r.choice(['.', '', '.', ','])}"

    def main(text: str) -> str:
        blocks.add(text)
        return text

    def paragraph() -> str:
        text = main(say(3, 90) + r.choice([""] * 20 + [" You may subscribe to it.", " Their cookies were sold."]))
        return r.choice(["<p>{}</p>"] * 6 + ["<p>{}", "<P>{}", "<p><font size=2>{}</font></p>", "<div>{}</div>", "<blockquote>{}</blockquote>"]).format(text if r.random() < 0.9 else f"<i>{text}</i>")

    def title(tags: tuple) -> str:
        return r.choice(tags).format(main(say(2, 12)))

    def links(n: int) -> str:
        return many(n, lambda: f'<a href="/{count[0]}">{say(1, 3)}</a>', r.choice([" | ", "<br>", " ", " &middot; "]))

    def body() -> str:
        more = lambda: paragraph() if r.random() < 0.9 else "<ul>" + many(r.randint(2, 4), lambda: f"<li>{main(say(2, 15))}</li>") + "</ul>" if r.random() < 0.5 else f"<h3>{main(say(1, 6))}</h3>"
        return many(r.choice([1, 2, 2, 3, 4, 6, 9]), more)

    foot = lambda: f"{legal()} {say(1, 12)}"
    kind = r.choice(["bare", "bare", "table", "table", "header", "header", "plain", "plain"])
    if kind == "bare":
        top = r.choice(["", "", f"<p>{links(r.randint(2, 6))}</p>", f"<div>{links(r.randint(2, 6))}</div>", f"{links(3)}<hr>"])
        end = r.choice(["", "", f"<hr><p><small>{foot()}</small></p>", f"<address>{foot()}</address>", f"<hr><p>{links(3)}</p>"])
        inner = top + (title(("<h1>{}</h1>", "<h2>{}</h2>", "<center><h1>{}</h1></center>", "<p><b>{}</b></p>")) if r.random() < 0.6 else "") + body() + end
        page = r.choice(["{}", "{}", "<html>{}</html>", "<html><head><title>t</title></head><body>{}</body></html>", '<BODY BGCOLOR="#ffffff">{}</BODY>']).format(inner)
    elif kind == "table":
        shown = title(("<h1>{}</h1>", "<font size=5><b>{}</b></font><p>", "<b>{}</b><br><p>", "<h2>{}</h2>")) if r.random() < 0.7 else ""
        text = body() if r.random() < 0.7 else main(say(20, 120)) if not shown or "<p>" not in shown else "<p>" + main(say(20, 120))
        inner = f"<td{r.choice(['', ' valign=top', ' width=600'])}>{shown}{text}</td>"
        side = lambda: f"<td{r.choice(['', ' width=120', ' bgcolor=#eeeeee'])}>{r.choice([links(r.randint(3, 8)), '<ul>' + many(4, lambda: f'<li><a href=/x>{say(1, 3)}</a></li>') + '</ul>'])}</td>"
        rows = [f"<tr><td colspan=3>{r.choice([say(1, 4), links(4), f'<b>{say(1, 3)}</b>'])}</td></tr>" if r.random() < 0.6 else "", "<tr>" + (side() if r.random() < 0.7 else "") + inner + (side() if r.random() < 0.2 else "") + "</tr>", f"<tr><td colspan=3>{r.choice([foot(), f'<font size=1>{foot()}</font>'])}</td></tr>" if r.random() < 0.6 else ""]
        table = "<table border=0>" + "".join(rows) + "</table>"
        page = r.choice(["<html><body>{}</body></html>", "{}", "<html><head><title>t</title></head><body bgcolor=white><center>{}</center></body></html>"]).format(table)
    elif kind == "header":
        head = f"<header>{title(('<h1>{}</h1>', '<h1>{}</h1>', '<h2>{}</h2>'))}{f'<p>{main(say(5, 25))}</p>' if r.random() < 0.4 else ''}</header>"
        tail = f"<footer>{r.choice([links(3), f'<ul><li><a href=/t>{say(1, 2)}</a></li></ul>'])}</footer>" if r.random() < 0.3 else ""
        name = r.choice(["article", "article", "main"])
        inner = f"<{name}>{head}{body()}{tail}</{name}>"
        site = f"<header>{r.choice([say(1, 4), f'<h1>{say(1, 4)}</h1>' if r.random() < 0.3 else say(1, 4)])}{f'<nav>{links(4)}</nav>' if r.random() < 0.5 else ''}</header>" if r.random() < 0.6 else ""
        page = f"<html><body>{site}{inner}{f'<footer><p>{foot()}</p></footer>' if r.random() < 0.7 else ''}</body></html>"
        page = page if r.random() < 0.8 else inner
    else:
        name = lambda: r.choice(["", "", f' class="{"".join(r.choices("abcdefghx0123", k=6))}"', f' id="c{r.randint(1, 99)}"'])
        parts = [f"<div{name()}>{r.choice([say(1, 4), links(5), f'<a href=/>{say(1, 3)}</a>'])}</div>" if r.random() < 0.7 else "", f"<div{name()}>{links(r.randint(3, 8))}</div>" if r.random() < 0.5 else ""]
        inner = f"<div{name()}>{title(('<h1>{}</h1>', '<h2>{}</h2>', '<div><b>{}</b></div>')) if r.random() < 0.8 else ''}{body()}</div>"
        parts += [inner if r.random() < 0.6 else f"<div{name()}>{inner}</div>", f"<div{name()}><ul>" + many(r.randint(3, 6), lambda: f"<li><a href=/y>{say(1, 5)}</a></li>") + "</ul></div>" if r.random() < 0.4 else "", f"<div{name()}>{foot()}</div>" if r.random() < 0.7 else ""]
        page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>"
    return page, blocks


def train(pages: int = 500, seed: int = 11, others: int = 500) -> tuple[BoostedTrees, BoostedTrees]:
    """Models of nodes whose text is all, and none, the article's, from so many written pages, and so many of other makes."""
    r, r2 = random.Random(seed), random.Random(seed + 1)
    x, all_main, no_main = [], [], []
    for k in range(pages + others):
        page, blocks = write_page(r) if k < pages else write_other_page(r2)
        nodes = parse(page)
        index = {id(v): i for i, v in enumerate(nodes)}
        of = np.array([[sum(len(t) for _, t in v.texts if t in blocks), sum(len(t) for _, t in v.texts)] for v in nodes], float)
        for i in range(len(nodes) - 1, 0, -1):
            of[index[id(nodes[i].parent)]] += of[i]
        some = of[:, 1] > 0
        share = of[some, 0] / of[some, 1]
        x.append(features(nodes)[some])
        all_main.append(share == 1)
        no_main.append(share == 0)
    x = np.concatenate(x)
    return tuple(BoostedTrees().fit(x, np.concatenate(y).astype(float)) for y in (all_main, no_main))


def extract(page: str, models: tuple[BoostedTrees, BoostedTrees]) -> str:
    return extract_all([page], models)[0]


def extract_all(pages: list[str], models: tuple[BoostedTrees, BoostedTrees]) -> list[str]:
    """Main texts; the models are asked once for the nodes of all pages."""
    trees = [parse(p) for p in pages]
    x = np.concatenate([features(t) for t in trees])
    keep, none = (m.probability(x) for m in models)
    out, at = [], 0
    for nodes in trees:
        end = at + len(nodes)
        kept = decode(nodes, keep[at:end], none[at:end])
        if not any(k and v.texts for v, k in zip(nodes, kept, strict=True)):
            kept = outside(nodes, keep[at:end] - none[at:end])
        at = end
        out.append("\n\n".join(t for _, t in sorted(t for v, k in zip(nodes, kept, strict=True) if k for t in v.texts)))
    return out


def _extracted(shared: object) -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = extract_all([x or "" for x in part.column("html").to_pylist()], shared.value)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return f


def main_text(pages: DataFrame, models: tuple[BoostedTrees, BoostedTrees] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the article of every page, its blocks joined by an empty line.

    Null and empty html give an empty text; very long pages are read whole. White space is what Unicode says it is, a decoded
    no-break space included. A page of which nothing would be kept gives its text outside of menus, forms and their like. Where keeping and leaving out a node weigh the same, it is decided by its children. Rows with
    null or repeated ids are read like any other. Other columns are ignored; no rows give no rows.
    """
    shared = Shipped(pages.sparkSession, models or train())  # a few hundred small trees
    return pick(pages, page_id="long", url="string", html="string").mapInArrow(_extracted(shared), "page_id long, url string, text string, n_chars long")
