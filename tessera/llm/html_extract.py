"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded hierarchically.

A page becomes a tree of block elements with runs of text as leaves. Each node has features of its tag, its attributes'
tokens, its ancestors, its subtree (text, links, density), its depth and its siblings. Tokens are hashed to SLOTS; what a
slot tells for or against main text is learned with the trees, from how often blocks of either kind have it. Trees, boosted on
logistic loss, give the log-odds that a node holds main text. Decoding maximises the sum over the tree under the rule that below a
rejected node everything is rejected, so an ancestor and a descendant never contradict each other; runs of accepted
parents that are accepted themselves are the text.

No page has labels, so the trees are trained on layouts drawn from a small grammar of article and chrome blocks, whose
labels are known (LAYOUTS of them, a fixed seed), with class names from a vocabulary of usual ones and from made-up ones. Null or empty html gives an empty text. Broken markup is read as
browsers do in the plain cases: `<p>` ends an open paragraph, stray end tags are skipped, unclosed elements end with their
parent. Text of buttons, selects, objects, templates and drawings is left out; without an end tag, only up to the next block
or, in a drawing, the next element of HTML (a template then holds the rest of the page, as in browsers). A tag that the page's end cuts off is dropped. Nodes whose
scores tie at 0 are rejected. Texts of any length are read whole, in time that grows with their length. Repeated rows are read one by
one; only html is read, other columns stay, and the result takes the place of a column of its name. An empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import small_batches

LAYOUTS, TREES, DEPTH, RATE, BINS = 400, 40, 3, 0.25, 32
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
CUT = re.compile("<[a-zA-Z/!?]")
WORD = re.compile("[a-z]+")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
HIDDEN = frozenset("template select button svg object".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre figcaption dd td".split())
CLOSES_P = frozenset("p div ul ol dl table section article main nav header footer aside form h1 h2 h3 h4 h5 h6 blockquote pre hr fieldset figure address menu".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}
SCOPE = frozenset("ul ol dl table article section div body html td".split())
BREAKOUT = CLOSES_P | frozenset("b big body br center code dd dt em embed head i img li meta nobr ruby s small span strong strike sub sup tt u var".split())
POINTS = frozenset("foreignobject desc title".split())
# Usual class names, by what such a block is; the grammar of layouts draws from them.
CLASSES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar".split(),
    "advert": "ad ads advert advertisement adverts banner promo promoted sponsor sponsored popup".split(),
    "aside": "side sidebar widget related recommend tags".split(),
    "share": "share sharing social search".split(),
    "notice": "cookie cookies consent gdpr notice notices newsletter overlay modal subscribe signup login form".split(),
    "comment": "comment comments reply respond disqus feedback".split(),
    "header": "header masthead".split(),
    "footer": "footer copyright".split(),
    "main": "article body content entry main page post prose story text".split(),
}
#: Slots of attribute tokens, and the count that is added to both kinds.
SLOTS, PRIOR = 1 << 12, 4.0


@dataclass
class Page:
    """Nodes in document order; a node's subtree is node:end[node]."""

    tag: list[str]
    parent: list[int]
    end: list[int]
    text: list[str | None]
    links: list[int]
    tokens: list[tuple[int, ...]]


def slot(token: str) -> int:
    return zlib.crc32(token.encode()) & (SLOTS - 1)


def raw_end(source: str, at: int, tag: str) -> int:
    """Behind the end tag; what has none goes on to the end. `source` ends with the last `>` of the page."""
    found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
    return found.end() if found else len(source)


def hidden_ends(source: str) -> dict[int, int]:
    """Where to read on after each start tag of HIDDEN, by the tag's end: behind its own end tag; without one, at the next
    block (a drawing: at the next element of HTML, or its parent's end)."""
    ends: dict[int, int] = {}
    names: list[str] = []
    starts: list[int] = []
    labels: list[int] = []

    def last(tag: str) -> int | None:
        if tag not in names:
            return None
        k = len(names) - 1 - names[::-1].index(tag)
        return None if "template" in names[k + 1 :] else k

    def drop(k: int, stop: int) -> None:
        ends.update((a, stop) for a, name in zip(starts[k:], names[k:], strict=True) if name == "svg")
        del starts[k:], names[k:]

    def label(stop: int) -> None:
        for a in labels:
            ends.setdefault(a, stop)
        labels.clear()

    def drawing() -> int | None:
        k = last("svg") if "svg" in names else None
        return None if k is None or not POINTS.isdisjoint(names[k + 1 :]) else k

    at, n = 0, len(source)
    while m := TAG.search(source, at):
        at = m.end()
        if ended := m[1]:
            ended = ended.lower()
            if ended in INLINE or ended in VOID:
                continue
            if drawing() is None and ended not in ("option", "optgroup"):
                label(m.start())
            k = last(ended)
            if k is not None:
                own = starts[k]
                drop(k, m.start())
                if ended in HIDDEN:
                    ends[own] = at
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        closed = (m[3] or m[5] or "").endswith("/")
        while (k := drawing()) is not None and tag in BREAKOUT:
            drop(k, m.start())
        if k is not None:
            if closed:
                if tag == "svg":
                    ends[at] = at
            elif tag in ("script", "style"):
                at = raw_end(source, at, tag)
            elif tag == "svg" or tag in POINTS:
                names.append(tag)
                starts.append(at)
            continue
        if tag == "svg" and closed:
            ends[at] = at
            continue
        over = last("select" if tag in ("input", "textarea") else tag) if tag in ("button", "select", "input", "textarea") else None
        if over is not None:
            label(m.start())
            drop(over, m.start())
        if tag in RAW:
            at = raw_end(source, at, tag)
            continue
        if tag in INLINE or tag in VOID:
            continue
        if tag not in ("option", "optgroup", "svg", "object", "template"):
            label(m.start())
        names.append(tag)
        starts.append(at)
        if tag in ("button", "select", "object"):
            labels.append(at)
    label(n)
    ends.update((a, n) for a, name in zip(starts, names, strict=True) if name in ("svg", "template"))
    return ends


def parse(source: str) -> Page:
    p = Page([], [], [], [], [], [])
    last = source.rfind(">") + 1  # no tag ends behind it, so no search need look there
    cut = CUT.search(source, last)
    tail = source[last : cut.start() if cut else None]
    source = source[:last]
    opened: dict[str, int] = {}
    stack: list[int] = []
    names: list[str] = []
    piece: list[str] = []
    linked = 0
    in_link = 0
    skips: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if piece:
            body = "".join(piece)
            piece.clear()
            if not body.isspace():
                add("#run", "", body)
                p.links[-1] = linked
                p.end[-1] = len(p.tag)
        linked = 0

    def add(tag: str, attrs: str, text: str | None) -> None:
        p.tag.append(tag)
        p.parent.append(stack[-1] if stack else -1)
        p.end.append(0)
        p.text.append(text)
        p.links.append(0)
        p.tokens.append(tuple({slot(t) for m in ATTRIBUTE.finditer(attrs) for t in WORD.findall((m[1] or m[2] or m[3] or "").lower())}) if attrs else ())

    def ended_there(tag: str, m: re.Match) -> bool:
        """Whether an element that reaches up to the last tag ends with it, or takes the text behind as well."""
        closed = (m[3] or m[5] or "").endswith("/") and tag == "svg"
        return closed or bool(re.search(rf"</{tag}(?=[\s/>])[^>]*>\Z", source[max(m.end(), len(source) - 1000) :], re.I))

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            p.end[stack.pop()] = len(p.tag)
            opened[names.pop()] -= 1

    def close_to(wanted: frozenset | set) -> None:
        for k in range(len(names) - 1, -1, -1):
            if names[k] in wanted:
                return close(k)
            if names[k] in SCOPE:
                return None
        return None

    at, n, skipped = 0, len(source), False
    while True:
        m = TAG.search(source, at) if at < n else None
        stop = m.start() if m else n
        t = source[at:stop] + (tail if not m and not skipped else "")
        if t:
            t = entities.unescape(t) if "&" in t else t
            piece.append(t)
            if in_link:
                linked += len(t)
        if not m:
            break
        at = m.end()
        if ended := m[1]:
            ended = ended.lower()
            if ended == "a":
                in_link = 0
            elif ended not in INLINE and opened.get(ended):
                k = len(names) - 1
                while names[k] != ended:
                    k -= 1
                close(k)
            continue
        tag = m[2] or m[4]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 1
        if tag in INLINE:
            continue
        if tag in RAW:
            at = raw_end(source, at, tag)
            skipped = at == n and not ended_there(tag, m)
            continue
        if tag in HIDDEN:
            skips = hidden_ends(source) if skips is None else skips
            at = skips.get(at, at)
            skipped = at == n and not ended_there(tag, m)
            continue
        if tag in VOID:
            if tag == "br":
                piece.append("\n")
            else:
                flush()
            continue
        flush()
        in_link = 0
        if tag in CLOSES_P:
            close_to({"p"})
        if tag in CLOSES:
            close_to(set(CLOSES[tag].split()))
        add(tag, m[3] or m[5] or "", None)
        stack.append(len(p.tag) - 1)
        names.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
    close(0)
    return p


def features(p: Page, told: np.ndarray) -> np.ndarray:
    """told: for each slot, the log-odds for main text."""
    n = len(p.tag)
    ids = np.arange(n)
    parent, end = np.array(p.parent), np.array(p.end)
    own = np.array([len(t) if t else 0 for t in p.text], float)
    links = np.array(p.links, float)
    stops = np.array([t.count(".") + t.count(",") if t else 0 for t in p.text], float)
    is_ = lambda s: np.array([t in s for t in p.tag], float)
    chrome, main = is_(CHROME), is_(MAIN)
    least = np.array([min((told[t] for t in x), default=0.0) for x in p.tokens])
    most = np.array([max((told[t] for t in x), default=0.0) for x in p.tokens])
    runs = is_({"#run"})
    depth, above_chrome, above_main, above_least, above_most = (np.zeros(n) for _ in range(5))
    for k in range(n):
        u = p.parent[k]
        if u >= 0:
            depth[k] = depth[u] + 1
            above_chrome[k] = max(above_chrome[u], chrome[u])
            above_main[k] = max(above_main[u], main[u])
            above_least[k] = min(above_least[u], least[u])
            above_most[k] = max(above_most[u], most[u])

    def below(x: np.ndarray) -> np.ndarray:
        acc = np.concatenate([[0], np.cumsum(x)])
        return acc[end] - acc[ids]

    chars, link_chars, marks, nodes = below(own), below(links), below(stops), end - ids
    up = np.maximum(parent, 0)
    total = max(1.0, own.sum())
    kin = np.bincount(up, minlength=n)[up].astype(float)
    order = np.zeros(n)
    same = np.zeros(n)
    seen: dict[int, int] = {}
    kinds: dict[tuple[int, str], int] = {}
    for k in range(n):
        order[k] = seen.get(p.parent[k], 0)
        seen[p.parent[k]] = seen.get(p.parent[k], 0) + 1
        kinds[p.parent[k], p.tag[k]] = kinds.get((p.parent[k], p.tag[k]), 0) + 1
    for k in range(n):
        same[k] = kinds[p.parent[k], p.tag[k]] / seen[p.parent[k]]
    safe = np.maximum(chars, 1)
    return np.stack([
        chrome, main, is_(HEADINGS), is_(PROSE), is_({"li", "ul", "ol"}), runs, least, most, above_chrome, above_main, above_least, above_most, np.log1p(chars), np.log1p(own), link_chars / safe, chars / nodes, marks / safe,
        chars / total, depth, order / np.maximum(kin, 1), kin, same,
    ], 1)


class Trees:
    """Boosted regression trees on logistic loss, over binned features; full trees of one depth, kept as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = self.bin(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.feature, self.cut, self.leaf = [], [], []
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, feature, cut = np.zeros(len(y), int), [], []
            for level in range(DEPTH):
                for k in range(1 << level):
                    at = np.flatnonzero(node == k)
                    f, c = self._split(bins[at], g[at], h[at])
                    feature.append(f)
                    cut.append(c)
                first = (1 << level) - 1
                f, c = np.array(feature[first:])[node], np.array(cut[first:])[node]
                node = 2 * node + (bins[np.arange(len(y)), f] > c)
            leaf = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
            z = z + leaf[node]

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], 1)

    @staticmethod
    def _split(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        best = (0.0, 0, BINS)
        for j in range(bins.shape[1]):
            gs, hs = np.cumsum(np.bincount(bins[:, j], g, BINS + 1)), np.cumsum(np.bincount(bins[:, j], h, BINS + 1))
            gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (gain[k], j, k)
        return best[1:]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self.bin(x), np.arange(len(x))
        z = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            feature, cut = np.array(feature), np.array(cut)
            for level in range(DEPTH):
                k = node + (1 << level) - 1
                node = 2 * node + (bins[rows, feature[k]] > cut[k])
            z += leaf[node]
        return z


def layout(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of the training grammar; the flag of each of its texts, in order, is whether it is main text."""
    flags: list[bool] = []
    pick = lambda *x: x[rng.integers(len(x))]
    made_up = lambda: "".join(pick(*"bcdfghklmnprstvz") + pick(*"aeiou") for _ in range(int(rng.integers(1, 4))))

    def named(kind: str | None = None) -> str:
        """An attribute with a class name of that kind, alone or with made-up ones around it; without a kind, made up."""
        if kind is None:
            return f' {pick("class", "id")}="{made_up()}-{int(rng.integers(1, 13))}"' if rng.random() < 0.3 else ""
        name = pick(*CLASSES[kind])
        name = pick(name, name, f"{name}-{made_up()}", f"{made_up()}_{name}", f"{made_up()} {name}", f"{name}{int(rng.integers(1, 9))}")
        return f' {pick("class", "class", "id")}="{name}"'

    def words(lo: int, hi: int) -> str:
        n = int(rng.integers(lo, hi + 1))
        return " ".join("x" * int(rng.integers(1, 11)) + ("." if rng.random() < 0.1 else "," if rng.random() < 0.06 else "") for _ in range(n)) or "x"

    def text(lo: int, hi: int, good: bool) -> str:
        flags.append(good)
        return words(lo, hi)

    def links(n: int) -> str:
        return "".join(f'<li><a href="#">{text(1, 3, False)}</a></li>' for _ in range(n))

    def prose(n: int, good: bool) -> str:
        out = []
        for _ in range(n):
            kind, lo = rng.random(), pick(1, 10, 40)
            if kind < 0.75:
                out.append(f"<p>{text(lo, lo * 4, good)}</p>")
            elif kind < 0.85:
                out.append(f"<h2>{text(1, 8, good)}</h2>")
            elif kind < 0.93:
                out.append("<ul>" + "".join(f"<li>{text(3, 25, good)}</li>" for _ in range(3)) + "</ul>")
            else:
                out.append(f"<blockquote>{text(5, 60, good)}</blockquote>")
        return "".join(out)

    def chrome() -> str:
        kind = rng.integers(9)
        if kind == 0:
            return f"<nav{named()}><ul>{links(int(rng.integers(2, 12)))}</ul></nav>"
        if kind == 1:
            return f"<div{named('menu')}><ul>{links(int(rng.integers(2, 12)))}</ul></div>"
        if kind == 2:
            return f"<{(t := pick('div', 'section', 'p'))}{named('advert')}>{text(2, 30, False)}</{t}>"
        if kind == 3:
            return f"<aside{named(pick(None, 'aside'))}>{prose(2, False)}</aside>"
        if kind == 4:
            return f"<div{named(pick('aside', 'share'))}>{prose(2, False)}</div>"
        if kind == 5:
            return f"<div{named('notice')}><p>{text(5, 40, False)}</p></div>"
        if kind == 6:
            return f"<form{named()}><p>{text(1, 12, False)}</p><input></form>"
        if kind == 7:
            name = named("comment")
            return f"<{(t := pick('section', 'div', 'ol'))}{name}>" + "".join(f"<div{pick(name, '')}><p>{text(3, 80, False)}</p></div>" for _ in range(int(rng.integers(1, 6)))) + f"</{t}>"
        return f"<{(t := pick('header', 'header', 'div'))}{named('header') if t == 'div' else named(pick(None, 'header'))}><h1>{text(1, 6, False)}</h1><p>{text(1, 10, False)}</p></{t}>"

    def inner() -> str:
        parts = [f"<h1>{text(2, 14, True)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(int(rng.integers(1, 4))):
            parts.append(prose(int(rng.integers(1, 8)), True))
            if rng.random() < 0.25:
                parts.append(chrome())
        return "".join(parts)

    out = [chrome() for _ in range(int(rng.integers(0, 4)))]
    head, tail = pick(
        (f"<article{named()}>", "</article>"), ("<article>", "</article>"), (f"<main{named()}>", "</main>"), (f"<div{named('main')}>", "</div>"), (f"<div{named('main')}><div{named('main')}>", "</div></div>"),
        ("<main><article>", "</article></main>"), (f"<div{named()}><div>", "</div></div>"), (f"<section{named('main')}>", "</section>"),
    )
    out.append(head + inner() + tail)
    out += [chrome() for _ in range(int(rng.integers(0, 3)))]
    if rng.random() < 0.8:
        foot = f"&copy; {text(1, 15, False)}"
        out.append(f"<footer>{foot}</footer>" if rng.random() < 0.7 else f"<div{named('footer')}><p>{foot}</p></div>")
    return f"<html><body>{''.join(out)}</body></html>", flags


@dataclass
class Model:
    told: np.ndarray
    trees: Trees

    def odds(self, pages: list[Page]) -> np.ndarray:
        return self.trees.score(np.concatenate([features(p, self.told) for p in pages])) if pages else np.zeros(0)


@functools.cache
def model() -> Model:
    rng = np.random.default_rng(11)
    pages, ys = [], []
    for _ in range(LAYOUTS):
        source, flags = layout(rng)
        p = parse(source)
        y = np.zeros(len(p.tag))
        y[[k for k, t in enumerate(p.tag) if t == "#run"]] = flags
        for k in range(len(y) - 1, 0, -1):
            if p.parent[k] >= 0:
                y[p.parent[k]] = max(y[p.parent[k]], y[k])
        pages.append(p)
        ys.append(y)
    seen = np.full((2, SLOTS), PRIOR)
    for p, y in zip(pages, ys, strict=True):
        for k, tokens in enumerate(p.tokens):
            for t in tokens:
                seen[int(y[k]), t] += 1
    told = np.log(seen[1] / seen[0])
    return Model(told, Trees(np.concatenate([features(p, told) for p in pages]), np.concatenate(ys)))


def decode(p: Page, odds: np.ndarray) -> list[int]:
    """The accepted runs. Scores are log-odds against rejection; a subtree is rejected whole, for 0, or its root is accepted
    for its own score plus the best of each child."""
    best = odds.tolist()
    for k in range(len(best) - 1, -1, -1):
        u = p.parent[k]
        if u >= 0 and best[k] > 0:
            best[u] += best[k]
    out, k, n = [], 0, len(best)
    while k < n:
        if best[k] <= 0:
            k = p.end[k]
            continue
        if p.text[k] is not None:
            out.append(k)
        k += 1
    return out


def extract_all(sources: list[str | None], trees: Model) -> list[str]:
    pages = [parse(s or "") for s in sources]
    full = [p for p in pages if p.tag]
    odds = trees.odds(full)
    out, at = [], 0
    for p in pages:
        z = odds[at : at + len(p.tag)]
        at += len(p.tag)
        out.append(" ".join(w for k in decode(p, z) for w in p.text[k].split()))
    return out


def extract(pages: DataFrame, html: str = "html", column: str = "main_text") -> DataFrame:
    """Adds the main text of each page."""
    trees = model()
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            source = part.tolist()
            yield pd.Series([t for lo in range(0, len(source), 200) for t in extract_all(source[lo : lo + 200], trees)], dtype=object)

    return pages.withColumn(column, run(F.col(html)))


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
