"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Every block-level element is a node with features of its subtree, attributes, place and
siblings. Boosted trees give the chance that a node belongs to the main text; decoding
then picks the likeliest choice in which nothing is kept below an element that is dropped.
The trees are fitted on pages that are made from words of the table in many layouts, so
each of their nodes has a known label.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset address details summary center hr".split()
)
HIDDEN_TAGS = frozenset("head script style noscript template svg math iframe object select button textarea canvas audio video map title".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
_SCOPES = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}

# Attribute words that tell what an element is for.
LEXICON = {
    "content": "article content main post body story entry text prose blog news single page detail description",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pager pagination tabs tab sitemap links skip",
    "head": "header head masthead logo topbar top brand hero branding",
    "foot": "footer foot bottom colophon copyright legal credits imprint",
    "side": "sidebar side rail aside widget widgets complementary column secondary",
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted commercial teaser affiliate",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay paywall message disclaimer privacy dialog",
    "comment": "comment comments reply replies respond discussion disqus responses thread reviews review feedback user",
    "form": "form login signin signup register subscribe subscription newsletter search searchbox input contact",
    "share": "share sharing social facebook twitter follow tools actions meta tags tag byline author date",
    "related": "related recommended recommendation more popular trending similar latest recent next prev also read",
}
_GROUPS = {word: i for i, words in enumerate(LEXICON.values()) for word in words.split()}
_TAG_GROUPS = ["p", "li", "h", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "list", "table", "quote", "other"]
_TAG_GROUP = {"p": 0, "li": 1, **{h: 2 for h in _HEADINGS}, "div": 3, "section": 4, "article": 5, "main": 6, "nav": 7, "aside": 8, "header": 9, "footer": 10, "form": 11, "fieldset": 11}
_TAG_GROUP |= {t: 12 for t in ("ul", "ol", "dl")} | {t: 13 for t in ("table", "tr", "td", "th", "tbody", "thead", "tfoot")} | {t: 14 for t in ("blockquote", "pre", "figure", "figcaption")}
_word_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: tuple[int, ...]
    place: int  # among the parent's block children
    label: int | None = None
    children: list[int] = field(default_factory=list)


class Dom(HTMLParser):
    """Block-level nodes and the runs of text that lie directly in them, in page order.

    Unclosed and stray tags are taken as browsers do in the common cases: a block ends an
    open paragraph, items and cells end their like, an end tag without a start is ignored.
    The head ends at the first tag or text that it cannot hold. A hidden element that is
    not closed ends at the next block tag, or where the block ends that it stands in.
    ``labels`` reads ``data-label``, which made pages have.
    """

    def __init__(self, page: str, labels: bool = True):
        super().__init__(convert_charrefs=True)
        self.labels = labels
        self.head = False
        self.events: list[tuple[str, str, list[tuple[str, str | None]] | None]] = []
        self.nodes = [Node("html", -1, 0, (), 0)]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # where each tag stands among the open ones
        self.hidden: list[str] = []
        self.loose = False  # the hidden element is not closed
        self.link = False
        self.parts: list[str] = []
        self.link_chars = 0
        self.feed(page)
        self.close()
        unclosed = self._unclosed()
        for i, (kind, value, attrs) in enumerate(self.events):
            if kind == "start":
                self._start(value, attrs, i in unclosed)
            elif kind == "end":
                self._end(value)
            else:
                self._data(value)
        self.events = []
        self._flush()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.events.append(("start", tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("end", tag, None))

    def handle_data(self, data: str) -> None:
        self.events.append(("data", data, None))

    def _unclosed(self) -> set[int]:
        """Places of the hidden elements without an end tag in the block they stand in."""
        out, stack, depth = set(), [], {}
        for i, (kind, tag, _) in enumerate(self.events):
            if tag == "head" or tag in VOID_TAGS or kind == "data" or tag not in BLOCK_TAGS and tag not in HIDDEN_TAGS:
                continue
            if kind == "start":
                stack.append((tag, i))
                depth[tag] = depth.get(tag, 0) + 1
            elif depth.get(tag):
                while stack:
                    top, at = stack.pop()
                    depth[top] -= 1
                    if top == tag:
                        break
                    if top in HIDDEN_TAGS:
                        out.add(at)
        return out | {at for tag, at in stack if tag in HIDDEN_TAGS}

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.runs.append((self.open[-1], text, min(self.link_chars, len(text))))
            self.parts, self.link_chars = [], 0

    def _cut(self, i: int) -> None:
        """Close the open nodes from place ``i`` on."""
        for node in self.open[i:]:
            self.at[self.nodes[node].tag].pop()
        del self.open[i:]

    def _close(self, tags: frozenset[str], scope: frozenset[str]) -> None:
        """Close the innermost of ``tags`` unless one of ``scope`` stands further in. Only the
        last place of each tag is looked at, however deep the page."""
        last = lambda names: max((self.at[t][-1] for t in names if self.at.get(t)), default=0)
        i = last(tags)
        if i and i >= last(scope):
            self._cut(i)
            self.link = False

    def _start(self, tag: str, attrs: list[tuple[str, str | None]], unclosed: bool) -> None:
        if self.hidden and self.loose and tag in BLOCK_TAGS:
            self.hidden.clear()
        if self.hidden:
            if tag == self.hidden[-1] and not unclosed and not self.loose:
                self.hidden.append(tag)
            return
        if tag == "head":
            self.head = True
            return
        if self.head and tag not in HEAD_TAGS:
            self.head = False
        if tag in HIDDEN_TAGS:
            self.hidden.append(tag)
            self.loose = unclosed
            return
        if tag not in BLOCK_TAGS:
            if tag == "a":
                self.link = True
            elif tag == "br":
                self.parts.append(" ")
            elif tag in ("img", "input"):
                self.parts.append("")
            return
        self._flush()
        if tag == "html":
            return
        self._close(frozenset(["p"]), frozenset(["td", "th", "table", "body", "article"]))
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _SCOPES[tag])
        elif tag in _HEADINGS and self.nodes[self.open[-1]].tag in _HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in VOID_TAGS:
            return
        label, groups = None, []
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                groups += [_GROUPS[w] for w in map(str.lower, _word_parts(value)) if w in _GROUPS]
            elif self.labels and name == "data-label" and value:
                label = int(value)
        parent = self.open[-1]
        self.nodes.append(Node(tag, parent, self.nodes[parent].depth + 1, tuple(groups), len(self.nodes[parent].children), label))
        self.nodes[parent].children.append(len(self.nodes) - 1)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.nodes) - 1)

    def _end(self, tag: str) -> None:
        if tag in ("head", "body", "html"):
            self.head = False
        if self.hidden and self.loose and tag in BLOCK_TAGS:
            self.hidden.clear()
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag == "a":
            self.link = False
        elif tag in BLOCK_TAGS and tag not in ("html", "body"):
            self._flush()
            self._close(frozenset([tag]), frozenset())

    def _data(self, data: str) -> None:
        if not self.hidden:
            if self.head:
                if not data.strip():
                    return
                self.head = False
            self.parts.append(data)
            if self.link:
                self.link_chars += len(data)


_TOKENS = len(LEXICON)
WIDTH = len(_TAG_GROUPS) + 2 * _TOKENS + 7 + 17


def features(dom: Dom) -> np.ndarray:
    """A row per node."""
    nodes, size = dom.nodes, len(dom.nodes)
    chars, links, runs, marks, words = ([0] * size for _ in range(5))
    own, first = [0] * size, [0] * size
    seen = 0
    for node, text, link in dom.runs:
        chars[node] += len(text)
        own[node] += len(text)
        links[node] += link
        runs[node] += 1
        marks[node] += text.count(". ") + text.count(",") + (text[-1] in ".!?")
        words[node] += text.count(" ") + 1
        first[node] = first[node] or seen + 1
        seen += len(text)
    blocks = [1] * size
    for i in range(size - 1, 0, -1):  # children come after parents
        p = nodes[i].parent
        for sums in (chars, links, runs, marks, words, blocks):
            sums[p] += sums[i]
        if first[i] and (not first[p] or first[i] < first[p]):
            first[p] = first[i]
    alike: list[dict[str, int]] = [{} for _ in nodes]  # children of each node by tag
    for n in nodes[1:]:
        alike[n.parent][n.tag] = alike[n.parent].get(n.tag, 0) + 1
    total = max(seen, 1)
    out = np.zeros((size, WIDTH), np.float32)
    above: list[tuple[np.ndarray, np.ndarray]] = []
    base, inner = len(_TAG_GROUPS), len(_TAG_GROUPS) + _TOKENS
    kept = [7, 8, 9, 10, 11, 5, 6]  # nav aside header footer form article main
    for i, n in enumerate(nodes):
        row = out[i]
        group = _TAG_GROUP.get(n.tag, 15)
        row[group] = 1
        for g in n.groups:
            row[base + g] = 1
        tokens, tags = (above[n.parent][0].copy(), above[n.parent][1].copy()) if i else (np.zeros(_TOKENS, np.float32), np.zeros(len(kept), np.float32))
        row[inner: inner + _TOKENS] = tokens
        row[inner + _TOKENS: inner + _TOKENS + 7] = tags
        for g in n.groups:
            tokens[g] = 1
        if group in kept:
            tags[kept.index(group)] = 1
        above.append((tokens, tags))
        parent = nodes[n.parent] if i else n
        before = parent.children[n.place - 1] if i and n.place else None
        after = parent.children[n.place + 1] if i and n.place + 1 < len(parent.children) else None
        c = max(chars[i], 1)
        row[-17:] = (
            np.log1p(chars[i]), links[i] / c, marks[i] / c * 100, words[i] / max(runs[i], 1), c / (chars[i] and blocks[i] or 1), blocks[i], n.depth, n.place, len(parent.children),
            chars[i] / total, (first[i] - 1) / total if first[i] else 1.0, own[i] / c, np.log1p(own[i]),
            links[before] / max(chars[before], 1) if before is not None else -1, links[after] / max(chars[after], 1) if after is not None else -1,
            chars[i] / max(chars[n.parent], 1) if i else 1, alike[n.parent if i else 0].get(n.tag, 0) / max(len(parent.children), 1),
        )
    return out


@dataclass
class Boosted:
    """Regression trees of one depth as arrays: feature, threshold and leaf value."""

    start: float
    depth: int
    splits: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for split, cut, leaf in zip(self.splits, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, split[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Boosted:
    """Gradient boosting of the logistic loss with histogram splits."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    logit, inner = np.full(len(y), start), 2**depth - 1
    splits, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        gradient, hessian = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            chosen = np.full(count, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = (at - low) * bins + binned[:, f]
                g = np.bincount(key, gradient, count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(key, hessian, count * bins).reshape(count, bins).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = gain[:, : len(e)]
                b = gain.argmax(axis=1)
                value = gain[np.arange(count), b]
                better = value > best
                best[better], chosen[better] = value[better], f
                cuts[t, low: low + count][better] = e[b[better]]
            splits[t, low: low + count] = np.maximum(chosen, 0)
            cuts[t, low: low + count][chosen < 0] = np.inf
            at = 2 * at + 1 + (x[np.arange(len(y)), splits[t, at]] > cuts[t, at])
        leaf = at - inner
        value = np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + ridge)
        leaves[t] = rate * value
        logit += leaves[t, leaf]
    return Boosted(start, depth, splits, cuts, leaves)


def decode(dom: Dom, logits: np.ndarray) -> np.ndarray:
    """The likeliest keep or drop of all nodes in which what lies below a dropped node is
    dropped: bottom-up, dropping a subtree against keeping its root and each child's best."""
    nodes, size = dom.nodes, len(dom.nodes)
    weight = np.ones(size)
    for node, text, _ in dom.runs:
        weight[node] += np.log1p(len(text)) / 2
    keep = -np.logaddexp(0, -logits) * weight
    drop = -np.logaddexp(0, logits) * weight
    for i in range(size - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    chosen = np.zeros(size, bool)
    chosen[0] = True
    for i in range(1, size):
        chosen[i] = chosen[nodes[i].parent] and keep[i] >= drop[i]
    return chosen


class PageMaker:
    """Pages in many layouts from given words; ``data-label`` tells what is main text."""

    def __init__(self, words: list[str], seed: int):
        self.words, self.r = words or ["word"], random.Random(seed)

    def text(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.text(2, 22).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(low, high)))

    def tag(self, tag: str, inside: str, label: int, names: str = "", closed: bool = True) -> str:
        attrs = f' {self.r.choice(["class", "class", "class", "id"])}="{self.r.choice(names.split())}"' if names and self.r.random() < 0.8 else ""
        return f'<{tag}{attrs} data-label="{label}">{inside}' + (f"</{tag}>" if closed else "")

    def any(self, tags: str, inside: str, label: int, names: str = "") -> str:
        tag = self.r.choice(tags.split())
        return self.tag(tag, inside, label, names if tag == "div" or self.r.random() < 0.3 else "")

    def links(self, low: int, high: int) -> str:
        return self.tag("ul", "".join(self.tag("li", f'<a href="/x">{self.text(1, 4)}</a>', 0) for _ in range(self.r.randint(low, high))), 0)

    def nav(self) -> str:
        flat = " ".join(f'<a href="/x">{self.text(1, 2)}</a>' for _ in range(self.r.randint(3, 9)))
        return self.any("nav nav div ul", self.links(3, 12) if self.r.random() < 0.7 else flat, 0, "menu nav navbar main-menu top-nav breadcrumb navigation links")

    def advert(self) -> str:
        inside = self.sentences(1, 3) if self.r.random() < 0.6 else f'<a href="/x">{self.sentences(1, 2)}</a>'
        return self.tag(self.r.choice(["div", "div", "aside", "section"]), inside if self.r.random() < 0.6 else self.tag("p", inside, 0), 0, "ad ads advert sponsored promo ad-box banner advertisement")

    def notice(self) -> str:
        return self.any("div div section aside", self.tag("p", self.sentences(1, 3), 0) + "<button>x</button>" if self.r.random() < 0.6 else self.sentences(1, 2), 0, "cookie-notice notice consent alert gdpr popup cookie-banner message")

    def side(self) -> str:
        parts = [self.tag("h3", self.text(1, 3), 0) + (self.links(3, 8) if self.r.random() < 0.6 else self.tag("p", self.sentences(1, 3), 0)) for _ in range(self.r.randint(1, 3))]
        return self.any("aside aside div", "".join(parts), 0, "sidebar side widget related rail recommended popular")

    def form(self) -> str:
        return self.tag("form", self.tag("p", self.sentences(1, 2), 0) * self.r.randint(0, 1) + f"<label>{self.text(1, 5)}</label><input>" + self.tag("div", self.text(1, 4), 0), 0, "search newsletter login subscribe-form")

    def comments(self) -> str:
        one = lambda: self.tag(self.r.choice(["div", "li", "article"]), self.tag("p", self.text(1, 3), 0) * self.r.randint(0, 1) + self.tag("p", self.sentences(1, 4), 0), 0, "comment reply comment-body user-comment")
        body = "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.tag(self.r.choice(["section", "div", "div", "ol"]), self.tag("h3", self.text(1, 3), 0) * self.r.randint(0, 1) + body, 0, "comments comments discussion responses reviews comment-list")

    def header(self) -> str:
        return self.any("header header div", (self.tag("div", self.text(1, 4), 0, "logo brand") if self.r.random() < 0.6 else self.tag("p", self.sentences(1, 1), 0)) + self.nav() * self.r.randint(0, 1), 0, "header site-header masthead top")

    def footer(self) -> str:
        text = f"&copy; {self.text(1, 2)} &middot; {self.sentences(1, 3)}"
        return self.any("footer footer div", text if self.r.random() < 0.5 else self.tag("p", text, 0) + self.links(2, 8) * self.r.randint(0, 1), 0, "footer site-footer bottom colophon copyright")

    def body(self) -> str:
        parts, loose = [], self.r.random() < 0.3
        if self.r.random() < 0.06:
            same = self.sentences(1, 1)
            return self.tag("h1", same, 1) + self.tag("p", same, 1)
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 14])):
            kind = self.r.random()
            if kind < 0.72:
                text = self.sentences(1, self.r.choice([1, 2, 5, 9]))
                if self.r.random() < 0.2:
                    text = text[: len(text) // 2] + f'<a href="/x">{self.text(1, 3)}</a>' + text[len(text) // 2:]
                if self.r.random() < 0.2:
                    text = "<b>" + text + ("<br>" if loose else "</b>")
                parts.append(self.tag("p", text, 1, closed=not loose))
            elif kind < 0.8:
                parts.append(self.tag(self.r.choice(["h2", "h3"]), self.text(1, 8), 1))
            elif kind < 0.87:
                parts.append(self.tag(self.r.choice(["ul", "ol"]), "".join(self.tag("li", self.sentences(1, 2), 1) for _ in range(self.r.randint(2, 6))), 1))
            elif kind < 0.9:
                parts.append(self.tag("blockquote", self.tag("p", self.sentences(1, 3), 1), 1))
            elif kind < 0.93:
                parts.append(self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.text(1, 3), 1) for _ in range(3)), 1) for _ in range(self.r.randint(1, 4))), 1))
            elif kind < 0.95:
                parts.append(self.tag("div", self.sentences(1, 4), 1))
            else:
                parts.append(self.r.choice([self.advert, self.advert, self.side, self.form, self.notice])())
        title = self.tag(self.r.choice(["h1", "h1", "h1", "h2"]), self.text(1, 12), 1) if self.r.random() < 0.9 else ""
        if title and self.r.random() < 0.15:
            title = self.tag("header", title, 1)
        return title + "".join(parts)

    def article(self) -> str:
        inside = self.body()
        if self.r.random() < 0.2:
            inside += self.comments()
        names = "article content post entry story article-body main-content post-content text"
        out = self.any("article article main div div section", inside, 1, names)
        while self.r.random() < 0.25:
            out = self.tag(self.r.choice(["div", "main", "section"]), out, 1, "main content container wrapper page")
        return out

    def page(self) -> str:
        some = lambda chance, *makers: [self.r.choice(makers)() for _ in range(self.r.random() < chance)]
        before = some(0.5, self.header) + some(0.8, self.nav) + some(0.3, self.notice) + some(0.5, self.advert) + some(0.15, self.form)
        middle = some(0.25, self.side) + [self.article()] + some(0.4, self.side) + some(0.2, self.advert)
        after = some(0.3, self.comments) + some(0.2, self.side, self.form) + some(0.85, self.footer) + some(0.15, self.notice)
        if self.r.random() < 0.3:
            middle = [self.tag("div", "".join(middle), 1, "container wrapper main page layout row")]
        return f'<!DOCTYPE html><html><head><title>{self.text(1, 5)}</title><script>var t="</p>";</script></head><body data-label="1">' + "".join(before + middle + after) + ("</body></html>" if self.r.random() < 0.9 else "")


def fit_extractor(pages: DataFrame, id: str = "page_id", html: str = "html", sample: int = 200, made: int = 900, seed: int = 11) -> Boosted:
    """Fit the trees on ``made`` pages in varied layouts, with words of the ``sample`` pages
    whose hashed id is smallest (at most 300 words each). Both bounds are parameters; what
    the trees are then applied to is not bounded."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[w for _, text, _ in Dom(x or "", labels=False).runs for w in text.split()][:300] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["words"])

    rows = pages.select(F.col(id).alias("id"), F.col(html).cast("string").alias("html")).orderBy(F.xxhash64("id"), "id").limit(sample).select("html")
    vocabulary = [w for r in rows.mapInArrow(words, "words array<string>").collect() for w in r.words]
    x, y = [], []
    for k in range(made):
        dom = Dom(PageMaker(vocabulary, seed * 100_003 + k).page())
        known = [i for i, n in enumerate(dom.nodes) if n.label is not None]
        x.append(features(dom)[known])
        y += [dom.nodes[i].label for i in known]
    return boost(np.concatenate(x), np.array(y, float))


def main_text(dom: Dom, kept: np.ndarray) -> str:
    return "\n".join(text for node, text, _ in dom.runs if kept[node])


def extract_main_text(pages: DataFrame, model: Boosted, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` and ``n_chars`` (code points).

    Character references are decoded; white space within a block is one space; blocks are
    joined in page order by ``\\n``. A null or empty page, or one without main text, gives an
    empty text. Rows are independent; null and repeated ids are kept as they are; other
    columns are ignored.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                doms = [Dom(x or "", labels=False) for x in part.column(2).to_pylist()]
                logits = shared.value.logit(np.concatenate([features(d) for d in doms]))
                cut = np.cumsum([len(d.nodes) for d in doms])[:-1]
                texts = [main_text(d, decode(d, v)) for d, v in zip(doms, np.split(logits, cut), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return rows.mapInArrow(extract, schema).withColumnRenamed("id", id)
