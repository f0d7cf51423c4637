"""HTML extraction: gradient-boosted trees over DOM nodes, then a consistent choice over the tree.

A page is read into a tree of elements (void and implied ends, unclosed tags).
Each element gets features: its tag and that of its parent, what its tag and
attribute tokens name (and those of any ancestor; a class like "has-sidebar", or one of what
holds nearly all text, names no part), depth, text and link density of its subtree, titles and
legal lines in it, and its place, kind and share of the text among its siblings. Boosted trees, trained here on pages built from templates
with known parts, give the probability that an element is unwanted by itself.
Decoding walks the tree once from the leaves: an element is kept or cut with
everything below it, whichever is likelier for the whole subtree, so nothing
is kept inside something that is cut.

Defined results: a null or empty page has the empty text; malformed markup is
read as far as it goes; a page without elements is its text; repeated rows are
alike; where keeping and cutting are equally likely, the element is kept; very long pages are read whole; an empty table gives no
rows; further columns are not looked at.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

#: Quotes hold a value only after "="; a value with "<" in it counts only if what follows its end can follow a value.
_ATTRIBUTES = r"""(?>=\s*(?:"[^"<]*"|'[^'<]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))|[^>])*"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAMING = {"class", "id", "role", "type", "itemprop", "aria-label"}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: With one of these a class speaks of what is around, or isn't: "has-sidebar", "no-comments", "ad-free".
MODIFIERS = {"has", "have", "with", "without", "no", "not", "non", "hide", "free", "open", "closed", "enabled", "disabled", "visible", "layout"}
LEGAL = re.compile(r"©|\(c\) *[12]\d\d\d|\b(?:copyright|all rights reserved|impressum|datenschutz|privacy policy|terms of (?:use|service)|legal notice)\b", re.I)
#: Elements by kind, in their HTML meaning.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Never text of the page.
UNSEEN = {"script", "style", "noscript", "template", "iframe", "head", "title", "textarea", "svg", "object", "select", "option", "button", "input"}
#: What may stand in ``head``; anything else ends it.
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
P_ENDS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "details"}
SAME_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "words", "parent", "kids", "chars", "links", "size", "titles", "legal")

    def __init__(self, tag: str, words: list[str], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.kids: list = []  # nodes and strings
        self.chars = self.links = self.legal = 0
        self.size, self.titles = 1, int(tag == "h1")


def attribute_words(attributes: str) -> list[str]:
    """Words of the attributes that name an element's part, in lower case; "hidden" for one that isn't shown."""
    out = []
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in NAMING:
            for part in value.strip("\"'").split():
                words = [w.lower() for w in NAME.findall(part)]
                out += words if MODIFIERS.isdisjoint(words) else ()
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.append("hidden")
    return out


def parse(page: str) -> Node:
    """The tree of a page; strings have their character references decoded."""
    root = top = Node("#root", [], None)
    at = 0
    raw_end = None

    def text(piece: str) -> None:
        if piece:
            top.kids.append(entities.unescape(piece))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                top.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            up = top
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root and not (tag in INLINE and _crosses(top, up)):
                top = up.parent
            elif tag == "p" and up is root:
                top.kids.append(Node("p", [], top))
            continue
        top = _implied(top, tag, root)
        words = attribute_words(m[3]) if m[3] else []
        node = Node(tag, words, top)
        top.kids.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div", "a", "span"):
            continue
        if tag in RAW:
            raw_end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            content = page[at : raw_end.start() if raw_end else len(page)]
            node.kids.append(content)
            at = raw_end.end() if raw_end else len(page)
            continue
        top = node
    text(page[at:])
    return root


def _crosses(top: Node, up: Node) -> bool:
    """Whether a block is open inside the inline element ``up``: then its end closes nothing."""
    while top is not up:
        if top.tag not in INLINE:
            return True
        top = top.parent
    return False


def _implied(top: Node, tag: str, root: Node) -> Node:
    """Where ``tag`` begins, after the ends that it implies."""
    if tag not in IN_HEAD:
        up = top
        while up is not root and up.tag != "head":
            up = up.parent
        if up is not root:
            top = up.parent
    if tag in P_ENDS:
        up = top
        while up is not root and up.tag != "p" and up.tag in INLINE:
            up = up.parent
        return up.parent if up.tag == "p" else top
    if tag in SAME_ENDS:
        ends, stops = SAME_ENDS[tag]
        up, found = top, None
        while up is not root and up.tag not in stops:
            if up.tag in ends:
                found = up
            up = up.parent
        return found.parent if found else top
    return top


def nodes_of(root: Node) -> list[Node]:
    """Elements in page order, with the characters, linked characters, elements, h1 elements and legal lines of their subtrees."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in reversed(n.kids) if type(k) is Node]
    for n in reversed(out):
        for k in n.kids:
            if type(k) is Node:
                n.chars, n.size, n.titles, n.legal = n.chars + k.chars, n.size + k.size, n.titles + k.titles, n.legal + k.legal
                n.links += k.chars if k.tag == "a" else k.links
            elif n.tag not in UNSEEN:
                n.chars += len(k.strip())
                n.legal += LEGAL.search(k) is not None
    return out


TAGS = ("html", "body", "div", "p", "section", "article", "main", "aside", "nav", "header", "footer", "ul", "ol", "li", "a", "h1", "h2", "h3", "h4", "form", "table", "tr", "td", "span", "b", "blockquote", "figure", "img", "button", "dialog")
_TAG = {t: i for i, t in enumerate(TAGS)}
#: What a tag or an attribute token says of a part of a page: words in common use, by kind.
KINDS = {
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promoted promotion banner",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar skip tabs",
    "header": "header masthead topbar logo",
    "footer": "footer copyright legal colophon contentinfo",
    "side": "aside sidebar widget rail related recommended recommendations trending popular teaser complementary",
    "comments": "comment comments reply replies respond disqus discussion commentlist responses",
    "notice": "dialog cookie cookies consent gdpr notice alert popup modal overlay toast alertdialog",
    "form": "form newsletter subscribe subscription signup login search",
    "share": "share sharing social follow tags",
    "hidden": "hidden",
    "content": "article main content post entry story body text prose articlebody",
}
_KIND = {w: i for i, words in enumerate(KINDS.values()) for w in words.split()}
N_NUMBERS = 20
N_FEATURES = N_NUMBERS + 2 * (len(TAGS) + 1) + 2 * len(KINDS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row a node: numbers, then tag, parent's tag, kinds named by itself, kinds named by any ancestor.

    What holds nearly all text, or the title and half of it, is no part beside the text: of its kinds only that of content counts.
    """
    n_tags, n_kinds = len(TAGS) + 1, len(KINDS)
    a, b = N_NUMBERS, N_NUMBERS + n_tags
    c = b + n_tags
    d = c + n_kinds
    x = np.zeros((len(nodes), N_FEATURES), np.float32)
    place = {id(n): i for i, n in enumerate(nodes)}
    up_of = np.array([place[id(n.parent)] if n.parent else -1 for n in nodes])
    chars, links, size = (np.array([getattr(n, k) for n in nodes], np.float64) for k in ("chars", "links", "size"))
    tag = np.array([_TAG.get(n.tag, len(TAGS)) for n in nodes])
    depth, among = np.zeros(len(nodes)), np.zeros(len(nodes))
    kin, most, alike = np.zeros(len(nodes)), np.zeros(len(nodes)), Counter()  # child elements and the longest of them, for each parent
    whole, content = 0.0, [*KINDS].index("content")
    heads, before = np.array([n.titles for n in nodes]), 0  # h1 elements in each subtree, and those that ended or began before
    last = np.zeros(len(nodes))
    for i, (n, up) in enumerate(zip(nodes, up_of.tolist())):  # parents come before their children, siblings in page order
        found = [_KIND[w] for w in (n.tag, *n.words) if w in _KIND]
        if n.tag in ("html", "body") or n.chars >= (0.5 if n.titles else 0.9) * max(1, nodes[0].chars):
            found = [k for k in found if k == content]
        # whether the last h1 of the page is in it
        last[i] = n.titles > 0 and before + n.titles == nodes[0].titles
        before += n.tag == "h1"
        if found:
            x[i, [c + k for k in found]] = 1
        if n.tag in ("article", "main"):
            whole = 1.0
        if up >= 0:
            depth[i] = depth[up] + 1
            among[i] = kin[up]
            kin[up] += 1
            most[up] = max(most[up], chars[i])
            alike[up, n.tag] += 1
            x[i, d:] = np.maximum(x[up, c:d], x[up, d:])
    over = np.maximum(up_of, 0)
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = np.minimum(depth, 30), np.log1p(chars), links / np.maximum(1, chars), np.log1p(size)
    x[:, 4], x[:, 5], x[:, 6] = np.log1p(chars / size), chars / max(1, chars[0]), whole
    x[:, 7], x[:, 8], x[:, 9] = chars / np.maximum(1, chars[over]), links[over] / np.maximum(1, chars[over]), np.log1p(kin[over])
    x[:, 10] = [alike[up, n.tag] / max(1, kin[up]) if up >= 0 else 0 for n, up in zip(nodes, up_of.tolist())]
    x[:, 11], x[:, 12] = among / np.maximum(1, kin[over]), chars / np.maximum(1, most[over])
    x[:, 13], x[:, 14], x[:, 15] = kin, np.log1p(chars[over]), chars[over] / max(1, chars[0])
    x[:, 16], x[:, 17] = heads, last
    x[:, 18], x[:, 19] = min(3, nodes[0].titles), [n.legal > 0 and n.chars < 400 for n in nodes]
    x[np.arange(len(nodes)), a + tag] = 1
    x[np.arange(1, len(nodes)), b + tag[over[1:]]] = 1
    x[0, 7:16] = 0
    return x


class Boosted:
    """Boosted regression trees for the logistic loss, as arrays; leaves are marked by feature -1."""

    def __init__(self, bias: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.bias, self.trees = bias, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, rounds: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 16, ridge: float = 1.0) -> Boosted:
        x = np.asarray(x, np.float64)
        cuts = np.full((x.shape[1], bins), np.inf)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            found = values[:-1] if len(values) <= bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 2)[1:-1], method="nearest"))
            cuts[f, : len(found)] = found
        n, wide = x.shape[1], bins + 1
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(n)], 1)  # x <= cut j  <=>  bin <= j
        cells = binned + np.arange(n) * wide
        base = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        z, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            feature, cut, value = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1), np.zeros(2 ** (depth + 1) - 1)
            at = np.zeros(len(y), np.int64)
            for level in range(depth + 1):
                first, count = 2**level - 1, 2**level
                live = at >= first
                gs, hs = (np.bincount(at[live] - first, w[live], count) for w in (g, h))
                value[first : first + count] = -rate * gs / (hs + ridge)
                if level == depth:
                    break
                where = ((at[live] - first) * (n * wide))[:, None] + cells[live]
                lg, lh = (np.bincount(where.ravel(), np.repeat(w[live], n), count * n * wide).reshape(count, n, wide).cumsum(2)[:, :, :-1] for w in (g, h))
                gain = lg**2 / (lh + ridge) + (gs[:, None, None] - lg) ** 2 / (hs[:, None, None] - lh + ridge) - (gs**2 / (hs + ridge))[:, None, None]
                gain[:, ~np.isfinite(cuts)] = -1
                best = gain.reshape(count, -1).argmax(1)
                for k in range(count):
                    if gain[k].flat[best[k]] > 1e-3:
                        feature[first + k], cut[first + k] = best[k] // bins, cuts.flat[best[k]]
                f = feature[at]
                go = live & (f >= 0)
                at[go] = 2 * at[go] + 1 + (x[go, f[go]] > cut[at[go]])
            z += value[at]
            trees.append((feature, cut, value))
        return cls(base, trees)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                right = x[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(go, 2 * at + 1 + right, at)
            z += value[at]
        return z


#: Training pages: parts that belong to no article, as (tag, attributes, kind of content); the words in attributes are those in common use.
UNWANTED = (
    ("nav", "", "links"), ("nav", "", "links"), ("div", "menu", "links"), ("ul", "menu", "links"), ("header", "", "short"), ("header", "", "links"), ("div", "header", "links"), ("div", "header", "short"),
    ("footer", "", "short"), ("footer", "", "links"), ("footer", "", "text"), ("div", "footer", "short"), ("div", "footer", "links"),
    ("aside", "", "text"), ("aside", "", "links"), ("aside", "side", "links"), ("div", "side", "text"), ("div", "side", "links"), ("section", "side", "links"), ("section", "side", "text"),
    ("div", "advert", "short"), ("div", "advert", "text"), ("div", "advert", "plain"), ("aside", "advert", "text"), ("section", "advert", "text"), ("p", "advert", "plain"), ("span", "advert", "plain"),
    ("div", "notice", "text"), ("div", "notice", "short"), ("div", "notice", "plain"), ("dialog", "", "text"), ("section", "notice", "text"), ("p", "notice", "plain"),
    ("form", "", "form"), ("form", "form", "form"), ("div", "form", "form"), ("div", "share", "links"), ("ul", "share", "links"),
    ("div", "comments", "comments"), ("section", "comments", "comments"), ("ol", "comments", "comments"), ("ul", "comments", "comments"), ("div", "comments", "text"), ("div", "comments", "form"), ("div", "hidden", "text"), ("p", "hidden", "plain"), ("div", "hidden", "plain"),
    ("div", "", "links"), ("ul", "", "links"), ("div", "", "links"),
    ("p", "", "legal"), ("div", "", "legal"), ("div", "other", "legal"), ("table", "", "legal"), ("div", "footer", "legal"),
)
#: What boxes of a title are called.
TITLES = ("article-header", "entry-header", "post-header", "page-header", "content-header", "header", "banner", "hero", "title", "headline", "masthead", "top", "intro", "promo-header")
#: Classes of what holds the page or the article that speak of other parts.
AROUND = ("right-sidebar", "left-sidebar", "sidebar-right", "header-fixed", "footer-dark", "footer-widgets", "admin-bar", "cookie-notice", "header-layout-2", "nav-down", "comments-area-below", "two-columns", "logged-in", "menu-top")
ARTICLES = (("article", ""), ("article", "content"), ("main", ""), ("div", "content"), ("div", "content"), ("section", "content"), ("div", ""), ("div", "other"), ("section", "other"), ("td", ""), ("", ""))
#: Class names that say nothing of a part.
OTHER = "row col container wrapper page inner outer grid box block section left right clearfix site app root large small dark fluid x1 lead".split()


class Templates:
    """Pages with known parts: every element of an unwanted part is marked with the attribute data-x."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("aeiourstlnmdé") for _ in range(r.randrange(1, 10))) for _ in range(r.randrange(low, high))).capitalize() + "."

    def named(self, kind: str) -> str:
        """Attributes with a word of ``kind``, among others that say nothing."""
        r = self.rng
        said = [r.choice(KINDS[kind].split())] if kind in KINDS else [r.choice(OTHER)] * (kind == "other")
        if kind == "hidden":
            return r.choice(("hidden", 'style="display:none"', 'class="hidden"'))
        said += r.sample(OTHER, r.choice((0, 0, 0, 1, 2)))
        r.shuffle(said)
        return f'{r.choice(("class", "class", "id"))}="{r.choice(("-", " ", "_")).join(said)}"' if said else ""

    def part(self, tag: str, kind: str, content: str) -> str:
        r, w = self.rng, self.words
        link = lambda: f'<a data-x href="/{r.randrange(99)}">{w(1, 4)}</a>'
        if content == "plain":
            inner = w(4, 30)
        elif content == "links":
            item = "li" if tag in ("ul", "ol") or r.random() < 0.5 else r.choice(("div", "span", ""))
            one = lambda: f"<{item} data-x>{link()}</{item}>" if item else link()
            inner = r.choice(("", " ", " | ")).join(one() for _ in range(r.randrange(2, 14)))
            inner = f"<ul data-x>{inner}</ul>" if item == "li" and tag not in ("ul", "ol") else inner
            inner = f"<h3 data-x>{w(1, 4)}</h3>" * (tag not in ("ul", "ol") and r.random() < 0.3) + inner
        elif content == "legal":
            said = r.choice(("&copy; {}", "© {} All rights reserved.", "Copyright {}. All rights reserved.", "(c) 2019 {}", '<a data-x href="/i">Impressum</a> {}', '<a data-x href="/p">Privacy policy</a> <a data-x href="/t">Terms of use</a> {}'))
            inner = said.format(f"{r.randrange(1990, 2025)} {w(1, 6)}")
            inner = r.choice((inner, f"<small data-x>{inner}</small>", f"<p data-x>{inner}</p>")) if tag != "p" else inner
            inner = f"<tr data-x><td data-x>{inner}</td></tr>" if tag == "table" else inner
        elif content == "short":
            inner = r.choice((w(2, 14), f"<p data-x>{w(2, 14)}</p>", f"&copy; 2024 {w(2, 10)}", f"<h2 data-x>{w(1, 4)}</h2>", f"<h1 data-x>{w(1, 4)}</h1>", link() + w(1, 5)))
        elif content == "form":
            inner = f"<label data-x>{w(1, 5)}</label><input data-x name=q><button data-x>{w(1, 2)}</button>" + f"<p data-x>{w(3, 20)}</p>" * r.randrange(2)
            inner = f"<form data-x>{inner}</form>" if tag != "form" else inner
        elif content == "comments":
            item = "li" if tag in ("ol", "ul") else r.choice(("div", "article", "p"))
            one = lambda: f"<{item} data-x {self.named(r.choice(('comments', '')))}>" + (w(3, 60) if item == "p" else f"<b data-x>{w(1, 2)}</b><p data-x>{w(3, 60)}</p>") + f"</{item}>"
            inner = f"<h2 data-x>{w(1, 3)}</h2>" * (tag not in ("ol", "ul") and r.random() < 0.5) + "".join(one() for _ in range(r.randrange(1, 8)))
        else:
            inner = f"<h3 data-x>{w(1, 4)}</h3>" * (r.random() < 0.3) + ("".join(f"<p data-x>{w(4, 60)}</p>" for _ in range(r.randrange(1, 4))) if r.random() < 0.7 else w(5, 60))
        return f"<{tag} data-x {self.named(kind)}>{inner}</{tag}>"

    def blocks(self) -> list[str]:
        r, w = self.rng, self.words
        out = []
        for _ in range(r.choice((1, 2, 2, 4, 8, 16, 60))):
            kind = r.random()
            if kind < 0.55:
                out.append(f"<p>{w(1, r.choice((2, 4, 12, 40, 120)))}</p>")
            elif kind < 0.61:
                out.append(f"<p><b>{w(1, r.choice((3, 40)))}<br>")
            elif kind < 0.67:
                out.append(f"<h2>{w(1, 8)}</h2>")
            elif kind < 0.72:
                out.append("<ul>" + "".join(f"<li>{w(2, 25)}</li>" for _ in range(r.randrange(2, 7))) + "</ul>")
            elif kind < 0.76:
                out.append(f"<blockquote><p>{w(5, 40)}</p></blockquote>")
            elif kind < 0.81:
                out.append(f'<p>{w(3, 20)} <a href="/x">{w(1, 5)}</a> {w(3, 20)} <em>{w(1, 3)}</em></p>')
            elif kind < 0.84:
                out.append("<table>" + "".join(f"<tr><td>{w(1, 4)}</td><td>{w(1, 4)}</td></tr>" for _ in range(r.randrange(2, 5))) + "</table>")
            elif kind < 0.87:
                out.append(f"<section><h3>{w(1, 6)}</h3><p>{w(10, 60)}</p></section>")
            elif kind < 0.90:
                out.append(f"<div {self.named('other') if r.random() < 0.5 else ''}>{r.choice((w(10, 80), f'<p>{w(10, 80)}</p>', f'<span>{w(10, 80)}</span>'))}</div>")
            elif kind < 0.92:
                out.append(f'<figure><img src="/i.png"><figcaption>{w(3, 15)}</figcaption></figure>')
            elif kind < 0.925:
                out.append(f"{w(10, 60)}<br><br>{w(10, 60)}<br>")
            elif kind < 0.955:  # inside an article such a line is the author's
                out.append(f"<p>{r.choice(('All rights reserved.', 'Copyright ' + w(1, 6), '(c) 2019 ' + w(1, 4), w(2, 9) + ' All rights reserved.'))}</p>")
            else:
                out.append(self.part(*r.choice([u for u in UNWANTED if u[2] != "legal"])))
        return out

    def article(self) -> str:
        r, w = self.rng, self.words
        tag, kind = r.choice(ARTICLES)
        title = f"<h1>{w(1, 12)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.25:
            box = r.choice(("div", "div", "section", "header"))
            title = f'<{box} class="{r.choice(TITLES)}">{title}{r.choice(("", "", f"<p>{w(2, 30)}</p>"))}</{box}>'
        elif title and tag in ("article", "main") and r.random() < 0.2:
            title = f"<header>{title}{r.choice(('', f'<p>{w(2, 12)}</p>'))}</header>"
        inner = "".join(self.blocks())
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            inner = f"<div {self.named(r.choice(('', 'other', 'content')))}>{inner}</div>"
        if not tag:
            return title + inner
        if tag == "td":
            legal = r.choice(("", "", f"<tr data-x><td data-x>Copyright {r.randrange(1990, 2025)} {w(1, 6)} All rights reserved.</td></tr>", f"<tr data-x><td data-x><font data-x>&copy; {w(1, 6)}</font></td></tr>"))
            return f"<table><tr><td>{title}{inner}</td></tr>{legal}</table>"
        return f"<{tag} {self.named(kind)}>{title}{inner}</{tag}>"

    def page(self) -> str:
        r = self.rng
        parts = [self.part(*r.choice(UNWANTED)) for _ in range(r.choice((0, 1, 2, 2, 3, 4, 6, 8)))]
        article, at = self.article(), r.randrange(len(parts) + 1)
        titled = "<h1>" in article
        # other parts have an h1 only before the one of the article: the last one is the title
        parts = [p if titled and k < at else p.replace("h1", "h2") for k, p in enumerate(parts)]
        parts.insert(at, article.replace("<h1 data-x", "<h2 data-x"))
        if r.random() < 0.15:  # columns of a row
            parts = [f"<div {self.named('other')}>{p}</div>" if "data-x" not in p[:60] else p for p in parts]
        body = "".join(parts)
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            body = f"<div {self.around() if r.random() < 0.3 else self.named(r.choice(('', 'other', 'content')))}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body {self.around() if r.random() < 0.3 else ''}>{body}</body></html>"

    def around(self) -> str:
        """The class of what holds a page."""
        r, kinds = self.rng, [k for k in KINDS if k not in ("hidden", "content")]
        said = [f"{r.choice(('has', 'with', 'no', 'without'))}-{r.choice(KINDS[r.choice(kinds)].split())}" for _ in range(r.randrange(3))]
        return f'class="{" ".join([*said, *r.sample(AROUND, r.randrange(3)), *r.sample(OTHER, 1)])}"'


def train(pages: int = 800, seed: int = 10) -> Boosted:
    """The model, trained on pages from the templates; the same everywhere."""
    made, xs, ys = Templates(seed), [], []
    for _ in range(pages):
        page = made.page()
        marked = parse(re.sub(r'<(\w+) data-x ?', r'<\1 itemprop="zzmarked" ', page))
        nodes = nodes_of(marked)
        ys.append(np.array(["zzmarked" in n.words for n in nodes], float))
        for n in nodes:
            n.words = [w for w in n.words if w != "zzmarked"]
        xs.append(features(nodes))
    return Boosted.fit(np.concatenate(xs), np.concatenate(ys))


def decode(nodes: list[Node], log_odds: np.ndarray) -> set[int]:
    """ids of the elements to cut: of all choices with nothing kept below a cut, the likeliest."""
    place = {id(n): i for i, n in enumerate(nodes)}
    keep, cut = -np.logaddexp(0, log_odds), -np.logaddexp(0, -log_odds)  # log probabilities of wanted and unwanted
    best, gone = keep.copy(), cut.copy()
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        up = place[id(nodes[i].parent)]
        best[up] += max(best[i], gone[i])
        gone[up] += gone[i]
    out: set[int] = set()
    for i, n in enumerate(nodes):
        if n.parent is not None and id(n.parent) not in out and gone[i] > best[i] and n.tag not in ("html", "body"):
            out.add(id(n))
        elif n.parent is not None and id(n.parent) in out:
            out.add(id(n))
    return out


def text_of(root: Node, cut: set[int]) -> str:
    """Blocks in page order, each with single spaces, joined by one space."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        n = stack.pop()
        if type(n) is str:
            out.append(n)
        elif n.tag not in UNSEEN and id(n) not in cut:
            around = "" if n.tag in INLINE else " "
            stack += [around, *reversed(n.kids), around]
    return " ".join("".join(out).split())


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(p or "") for p in pages]
    each = [nodes_of(t) for t in trees]
    if not each:
        return []
    odds = model.log_odds(np.concatenate([features(n) for n in each]))
    out, at = [], 0
    for tree, nodes in zip(trees, each):
        out.append(text_of(tree, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_text(pages: DataFrame, model: Boosted, *, id_cols: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``id_cols``, text and n_chars of every page."""
    rows = pages.select(*id_cols, F.col(html).alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                texts = extract(b["__html"].to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in id_cols), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*id_cols, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), train())
