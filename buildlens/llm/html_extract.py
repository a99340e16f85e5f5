"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

Block elements are the nodes.  Trees judge from tag, attribute tokens, depth, siblings
and subtree densities whether a node is part of the article.  Decoding then finds the
likeliest consistent choice: outside the article, inside it, or cut out of it, where a
path from the root may only go from outside to inside to cut out.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from buildlens.llm.common import bound_batches, column, slices, table
from buildlens.llm.gbt import Tree, boost, raw_scores

#: Fixed values of HTML: elements without content, with raw content, inline, and those that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
FOREIGN = frozenset(("svg", "math"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
TAGS = "html body div section article main p h1 h2 h3 h4 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form button address details".split()
#: Tokens of class, id and role, by what they tell.
TOKENS = {
    "ad": "ad ads advert advertisement adbox banner sponsor sponsored promo promotion".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs pagination pager toc".split(),
    "foot": "footer foot copyright legal colophon bottom contentinfo".split(),
    "head": "header masthead banner logo brand top sitename".split(),
    "side": "sidebar side aside rail widget complementary related recommended trending popular more".split(),
    "note": "cookie cookies notice alert consent gdpr popup modal newsletter subscribe signup overlay toast dialog".split(),
    "talk": "comment comments reply replies respond discussion disqus thread".split(),
    "share": "share social sharing follow tags meta byline tools".split(),
    "form": "form search login contact input".split(),
    "main": "content main article post entry story body text prose page blog document".split(),
}
_TOKEN = {w: k for k, words in enumerate(TOKENS.values()) for w in words}
_TAG = {t: k for k, t in enumerate(TAGS)}
_PIECE = re.compile(r"<!--(?:.*?-->|.*)|</([a-zA-Z][^\s>]*)[^>]*>|<[!?][^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)", re.S)
_PLAIN = re.compile(r"[^>\"']*")
_NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*>", re.I) for t in RAW}


@dataclass
class Dom:
    """Nodes in document order; parts are text pieces: (node, text), breaks between blocks are known by the node."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)  # one past the last node of the subtree
    bits: list[int] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    marks: list[bool] = field(default_factory=list)  # of generated pages: the truth
    parts: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, run (pieces of one run are one block)


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Place of the > that ends the tag whose name ends at `at`, quoted values passed over; -1 if a quote or the tag isn't closed.

    `unclosed` keeps the quotes that no later place of the page has.
    """
    while True:
        at = _PLAIN.match(page, at).end()
        if at == len(page):
            return -1
        if page[at] == ">":
            return at
        before = at - 1
        while page[before].isspace():
            before -= 1
        if page[before] != "=":
            at += 1  # a stray quote opens no value
            continue
        close = -1 if page[at] in unclosed else page.find(page[at], at + 1)
        if close < 0:
            unclosed.add(page[at])
            return -1
        at = close + 1


def read_dom(page: str) -> Dom:
    """A forgiving parser: unknown, unclosed and stray tags and cut-off pages are all right.

    The depths at which each name is open are kept, so that nesting of any depth costs a tag no
    more.  What a template holds is no text of the page.
    """
    dom, stack, link, run = Dom(), [], 0, 0
    names: list[str] = []
    opened: dict[str, list[int]] = {}

    def open_node(name: str, attrs: str) -> None:
        k = len(dom.tag)
        bits = 0
        if attrs:
            for m in _ATTR.finditer(attrs):
                for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()):
                    if w in _TOKEN:
                        bits |= 1 << _TOKEN[w]
        dom.tag.append(_TAG.get(name, len(TAGS)))
        dom.parent.append(stack[-1] if stack else -1)
        dom.end.append(0)
        dom.bits.append(bits)
        dom.hidden.append(bool(attrs and _HIDDEN.search(attrs)))
        dom.marks.append("data-main" in attrs)
        dom.links.append(0)
        dom.link_chars.append(0)
        opened.setdefault(name, []).append(len(names))
        stack.append(k)
        names.append(name)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            dom.end[stack.pop()] = len(dom.tag)
            opened[names.pop()].pop()

    open_node("html", "")
    at, size = 0, len(page)
    unclosed: set[str] = set()
    while at < size:
        if (tag := _NAME.match(page, at)) and (end := _tag_end(page, tag.end(), unclosed)) >= 0:
            name, attrs, text, closed = tag[1], page[tag.end() : end], None, None
            at = end + 1
        else:
            m = _PIECE.match(page, at)
            at = m.end()
            closed, name, attrs, text = m[1], m[2], m[3], m[4]
        if text == "<" and page[at : at + 1].isalpha() | (page[at : at + 1] in ("/", "!", "?")) and page.find(">", at) < 0:
            break  # an unclosed tag at the end of a cut-off page
        if text is not None:
            if opened.get("template"):
                continue
            if not text.isspace():
                dom.parts.append((stack[-1], text, run))
                if link:
                    dom.link_chars[stack[-1]] += len(text)
            else:
                dom.parts.append((stack[-1], " ", run))
        elif name is not None:
            name = name.lower()
            if name in RAW:
                if not attrs.endswith("/"):
                    close = _RAW_END[name].search(page, at)
                    at = close.end() if close else size
                continue
            if name == "a":
                link = 1
                dom.links[stack[-1]] += 1
                continue
            if name in INLINE:
                continue
            run += 1
            if name in ("html", "head") or name in VOID:
                continue
            if attrs.endswith("/") and (name in FOREIGN or any(opened.get(x) for x in FOREIGN)):
                continue  # only in these a slash closes an element
            if name == "body" and len(stack) > 1:
                continue
            if name in CLOSES_P and opened.get("p"):
                close_to(opened["p"][-1])
            if name in _SCOPE:
                deepest = lambda some: max((opened[x][-1] for x in some if opened.get(x)), default=0)
                if (kin := deepest(_KIN.get(name, (name,)))) > deepest(_SCOPE[name]):
                    close_to(kin)
            open_node(name, attrs)
            link = 0
        elif closed is not None:
            name = closed.lower()
            if name == "a":
                link = 0
            elif name not in INLINE and name not in VOID:
                run += 1
                if opened.get(name) and name not in ("body", "html"):
                    close_to(opened[name][-1])
    close_to(0)
    return dom


#: An item closes the open one of its kind, but not beyond these.
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_KIN = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}


FEATURE_COUNT = 2 * (len(TAGS) + 1) + 2 * len(TOKENS) + 22


def node_features(doms: list[Dom]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of some pages, and the pages' offsets."""
    sizes = [len(d.tag) for d in doms]
    rows = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n = int(rows[-1])
    if not n:
        return np.zeros((0, FEATURE_COUNT)), rows
    flat = lambda k: np.fromiter((x for d in doms for x in getattr(d, k)), np.int64, n)
    shift = np.repeat(rows[:-1], sizes)
    tag, bits, links, link_chars, hidden = flat("tag"), flat("bits"), flat("links"), flat("link_chars"), flat("hidden")
    parent = flat("parent")
    parent = np.where(parent < 0, -1, parent + shift)
    end = flat("end") + shift
    own, stops = np.zeros(n), np.zeros(n)
    for k, d in enumerate(doms):
        for node, text, _ in d.parts:
            own[rows[k] + node] += len(text)
            stops[rows[k] + node] += text.count(".") + text.count(",")
    here = np.arange(n)
    depth = np.zeros(n)
    kids = np.zeros(n)
    place = np.zeros(n)
    same = np.zeros(n)
    seen: dict[tuple[int, int], int] = {}
    for i, (p, t) in enumerate(zip(parent.tolist(), tag.tolist())):
        if p >= 0:
            depth[i] = depth[p] + 1
            place[i] = kids[p]
            kids[p] += 1
            seen[p, t] = seen.get((p, t), 0) + 1
    for i, (p, t) in enumerate(zip(parent.tolist(), tag.tolist())):
        same[i] = seen.get((p, t), 1)

    def below(v: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0.0], np.cumsum(v)])
        return s[end] - s[here]

    top = shift
    text, link_text, n_links, n_stops = below(own), below(link_chars), below(links), below(stops)
    nodes, paragraphs, items = (end - here).astype(float), below(tag == _TAG["p"]), below(tag == _TAG["li"])
    long_p = below((tag == _TAG["p"]) & (own > 80))
    total = np.maximum(text[top], 1)
    before = np.concatenate([[0.0], np.cumsum(own)])[here] - np.concatenate([[0.0], np.cumsum(own)])[top]
    up = np.maximum(parent, 0)
    all_bits = bits.copy()  # tokens of the node and its ancestors
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            all_bits[i] |= all_bits[p]
    tags = np.zeros((n, 2 * (len(TAGS) + 1)))
    tags[here, tag] = 1
    with_parent = parent >= 0
    tags[here[with_parent], len(TAGS) + 1 + tag[up[with_parent]]] = 1
    tokens = np.stack([(b >> k) & 1 for b in (bits, all_bits) for k in range(len(TOKENS))], axis=1).astype(float)
    safe = np.maximum(text, 1)
    numbers = [
        np.minimum(depth, 20), np.log1p(text), np.log1p(own), text / total, link_text / safe, np.log1p(n_links), n_links / nodes, n_stops / safe, text / nodes, np.log1p(nodes), np.log1p(paragraphs), np.log1p(items),
        np.log1p(long_p), items / nodes, place / np.maximum(kids[up], 1), np.minimum(kids, 50), np.minimum(same, 50), before / total, text / np.maximum(text[up], 1), hidden.astype(float), link_chars / np.maximum(own, 1), long_p / np.maximum(long_p[top], 1),
    ]
    return np.concatenate([tags, tokens, np.stack(numbers, axis=1)], axis=1), rows


def decode(dom: Dom, p: np.ndarray) -> np.ndarray:
    """The likeliest consistent state of every node: 0 outside, 1 inside, 2 cut out."""
    n = len(p)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    best = [[no[i], yes[i], no[i]] for i in range(n)]
    parent = dom.parent
    for i in range(n - 1, 0, -1):
        out, inside, cut = best[i]
        up = best[parent[i]]
        up[0] += max(out, inside)
        up[1] += max(inside, cut)
        up[2] += cut
    state = np.zeros(n, dtype=np.int8)
    state[0] = 1 if best[0][1] > best[0][0] else 0
    for i in range(1, n):
        out, inside, cut = best[i]
        s = state[parent[i]]
        state[i] = 2 if s == 2 else (1 if inside >= cut else 2) if s == 1 else (1 if inside > out else 0)
    return state


def text_of(dom: Dom, state: np.ndarray) -> str:
    """Blocks of inside nodes in page order, white space folded, joined by one space."""
    runs: list[list[str]] = []
    last = None
    for node, text, run in dom.parts:
        if state[node] != 1:
            continue
        if (node, run) != last:
            runs.append([])
            last = (node, run)
        runs[-1].append(text)
    out = []
    for pieces in runs:
        s = "".join(pieces)
        s = " ".join((entities.unescape(s) if "&" in s else s).split())
        if s:
            out.append(s)
    return " ".join(out)


# --- generated pages ---

_WORD_LIST = "time people water river stone light house garden paper winter summer morning evening letter table window street music number answer story record island engine market bridge winter silver yellow".split()


class _Page:
    """A random page; elements of the article bear data-main, which no feature reads."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, lo: int, hi: int) -> str:
        r = self.rng
        w = [r.choice(_WORD_LIST) + (r.choice([".", ",", ""]) if r.random() < 0.15 else "") for _ in range(r.randint(lo, hi))]
        return " ".join(w).capitalize() + r.choice([".", "", "?", "."])

    def attr(self, *names: str, weight: float = 0.8) -> str:
        r = self.rng
        if r.random() > weight:
            return r.choice(["", f' class="c{r.randint(1, 99)}"', f' id="x{r.randint(1, 99)}"'])
        kind = r.choice(["class", "class", "id"])
        extra = r.choice(["", "-box", "-wrap", " c1", "_inner"])
        return f' {kind}="{r.choice(names)}{extra}"'

    def anchors(self, lo: int, hi: int) -> str:
        r = self.rng
        links = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(r.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.7 else " | ".join(links)

    def menu(self) -> str:
        tag = self.rng.choice(["nav", "nav", "div", "ul"])
        body = self.anchors(2, 12)
        return f"<{tag}{self.attr('nav', 'menu', 'navbar', 'breadcrumb', weight=0.6 if tag == 'nav' else 0.95)}>{body}</{tag}>"

    def header(self) -> str:
        tag = self.rng.choice(["header", "header", "div"])
        inner = self.rng.choice([f"<h1>{self.words(1, 5)}</h1>", f"<p>{self.words(2, 8)}</p>", self.words(1, 6), f"<div>{self.words(2, 5)}</div>" + self.menu()])
        return f"<{tag}{self.attr('header', 'masthead', 'topbar', 'logo', weight=0.5 if tag == 'header' else 0.95)}>{inner}</{tag}>"

    def footer(self) -> str:
        tag = self.rng.choice(["footer", "footer", "div"])
        inner = self.rng.choice(["&copy; ", ""]) + self.words(3, 30)
        inner = self.rng.choice([inner, f"<p>{inner}</p>", inner + self.anchors(1, 6)])
        return f"<{tag}{self.attr('footer', 'copyright', 'legal', weight=0.5 if tag == 'footer' else 0.95)}>{inner}</{tag}>"

    def advert(self) -> str:
        tag = self.rng.choice(["div", "div", "aside", "section", "p"])
        return f"<{tag}{self.attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', weight=1)}>{self.words(3, 40)}</{tag}>"

    def notice(self) -> str:
        inner = self.rng.choice([f"<p>{self.words(5, 40)}</p>", self.words(5, 40)]) + self.rng.choice(["", "<button>OK</button>"])
        return f"<div{self.attr('cookie', 'notice', 'alert', 'consent', 'newsletter', 'popup', weight=1)}>{inner}</div>"

    def sidebar(self) -> str:
        tag = self.rng.choice(["aside", "aside", "div", "section"])
        inner = "".join(self.rng.choice([f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.words(4, 50)}</p>", self.anchors(2, 8), f"<div>{self.words(4, 20)}</div>"]) for _ in range(self.rng.randint(1, 4)))
        return f"<{tag}{self.attr('sidebar', 'widget', 'related', 'rail', 'trending', weight=0.6 if tag == 'aside' else 1)}>{inner}</{tag}>"

    def form(self) -> str:
        return f"<form{self.attr('search', 'login', 'contact', weight=0.4)}><label>{self.words(1, 4)}</label><input name=q>{self.rng.choice(['', f'<p>{self.words(3, 15)}</p>'])}<button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        tag = self.rng.choice(["section", "div", "div", "ol"])
        item = "li" if tag == "ol" else self.rng.choice(["div", "article", "p"])
        inner = f"<h3>{self.words(1, 3)}</h3>" * self.rng.randint(0, 1)
        for _ in range(self.rng.randint(1, 6)):
            body = self.words(4, 60)
            inner += f"<{item}{self.attr('comment', 'reply', weight=0.6)}>{self.rng.choice([body, f'<p>{body}</p>' if item != 'p' else body])}</{item}>"
        return f"<{tag}{self.attr('comments', 'respond', 'discussion', weight=1)}>{inner}</{tag}>"

    def share(self) -> str:
        return f"<div{self.attr('share', 'social', 'tags', weight=1)}>{self.anchors(2, 5)}</div>"

    def block(self) -> str:
        r, m = self.rng, " data-main"
        pick = r.random()
        if pick < 0.7:
            body = self.words(1, 150)
            if r.random() < 0.2:
                body = f"<b>{body}" + r.choice(["</b>", ""]) + r.choice(["", "<br>"])
            if r.random() < 0.2:
                body += f' <a href="#">{self.words(1, 5)}</a> ' + self.words(1, 20)
            return f"<p{m}>{body}" + ("</p>" if r.random() < 0.85 else "")
        if pick < 0.8:
            t = r.choice(["h2", "h3", "h4"])
            return f"<{t}{m}>{self.words(1, 8)}</{t}>"
        if pick < 0.88:
            t = r.choice(["ul", "ol"])
            return f"<{t}{m}>" + "".join(f"<li{m}>{self.words(2, 25)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"
        if pick < 0.92:
            return f"<blockquote{m}><p{m}>{self.words(5, 60)}</p></blockquote>"
        if pick < 0.95:
            return f"<table{m}>" + "".join(f"<tr{m}>" + "".join(f"<td{m}>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if pick < 0.98:
            return f"<div{m}>{self.words(5, 80)}</div>"
        return f"<figure{m}><img src=x><figcaption{m}>{self.words(3, 15)}</figcaption></figure>"

    def article(self) -> str:
        r, m = self.rng, " data-main"
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        inner = f"<h1{m}>{self.words(2, 12)}</h1>" * (r.random() < 0.85)
        if r.random() < 0.15:
            inner += self.share()
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            inner += self.block()
            if r.random() < 0.05:
                inner += r.choice([self.advert, self.sidebar, self.share, self.notice, self.form])()
        if r.random() < 0.1:
            inner = f"<div{self.attr('body', 'text', 'prose', weight=0.5)}{m}>{inner}</div>"
        if r.random() < 0.15:
            inner += r.choice([self.comments, self.share, self.sidebar])()
        weight = 0.3 if tag in ("article", "main") else 0.85
        return f"<{tag}{self.attr('content', 'article', 'post', 'entry', 'story', 'main', weight=weight)}{m}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.rng
        top = [f() for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.8), (self.advert, 0.5), (self.form, 0.15)) if r.random() < p]
        middle = [self.article()] if r.random() < 0.97 else []
        middle += [f() for f, p in ((self.sidebar, 0.4), (self.comments, 0.35), (self.advert, 0.2)) if r.random() < p]
        if r.random() < 0.2:
            middle.insert(0, self.sidebar())
        if r.random() < 0.3:
            middle = [f"<div{self.attr('page', 'wrapper', 'container', 'layout', weight=0.7)}>{''.join(middle)}</div>"]
        out = "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(top + middle) + (self.footer() if r.random() < 0.85 else "") + self.notice() * (r.random() < 0.1) + "</body></html>"
        return out if r.random() < 0.9 else out[: r.randint(len(out) // 2, len(out))]


@lru_cache(maxsize=1)
def trained(pages: int = 600, trees: int = 40, depth: int = 4, seed: int = 5) -> tuple[float, list[Tree]]:
    """Trees fitted on generated pages."""
    rng = random.Random(seed)
    doms = [read_dom(_Page(rng).page()) for _ in range(pages)]
    x, _ = node_features(doms)
    y = np.array([float(m) for d in doms for m in d.marks])
    return boost(x, y, trees, depth, rate=0.25)


def extract(page: str, model: tuple[float, list[Tree]]) -> str:
    dom = read_dom(page)
    x, _ = node_features([dom])
    return text_of(dom, decode(dom, 1 / (1 + np.exp(-raw_scores(*model, x)))))


def extract_text(pages: DataFrame, model: tuple[float, list[Tree]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; null or empty html gives an empty text.

    Pages of any length are read whole, one after the other within a task.  A node that is as
    likely inside as outside the article stays outside; one below the article stays inside.
    Repeated rows give repeated results, an empty table an empty one; null ids and urls
    stay null; other columns are not read.
    """
    bound_batches(pages.sparkSession)
    model = model or trained()
    pages = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) __html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html"):
                doms = [read_dom(h or "") for h in column(part, "__html").to_pylist()]
                x, rows = node_features(doms)
                p = 1 / (1 + np.exp(-raw_scores(*model, x)))
                texts = [text_of(d, decode(d, p[a:b])) for d, a, b in zip(doms, rows[:-1], rows[1:])]
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {"op10_html_extract": op10_html_extract}
