"""Main-text extraction with a tree-structured graphical model over DOM nodes.

Each block element of a page is a node with one of three states: content, neutral (it only holds
others) or boilerplate. A node's features give its state potentials; each parent-child edge has a
potential for every pair of states. Sum-product messages go up from the leaves and down from the
root and give exact marginals. An edge to a child that is marked as a kind of block of its own (a form, a
list of related pages) has other potentials than one to a plain child, so that such blocks inside an article
say little of the article; nodes know whether they stand inside an article. A block of text is kept where content is the likeliest state. The weights
are those of highest likelihood on labelled pages, which ``training_pages`` composes from a seed:
the tables hold no labels, so layouts with known states stand in for them. A batch of pages is one
forest, and messages are computed level by level with numpy.

Edge cases: null and empty html, and pages without content, give an empty text; unclosed, stray and
misnested tags are repaired by implied ends; character references do not reach across tags; equal pages
get equal texts; extra columns are never read. Time is in proportion to the page, whatever its nesting.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches

CONTENT, NEUTRAL, BOILERPLATE = range(3)
TRAIN_PAGES, SEED, STEPS, RATE, DECAY = 600, 3, 250, 0.3, 1e-4

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without markup inside, up to their end tag or the end of the page.
RAW = frozenset("script style textarea title iframe xmp".split())
#: Elements whose contents are no text of the page; without an end tag they are empty.
SKIPPED = frozenset("noscript template svg select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br object"
    " math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom mspace semantics annotation".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements whose start ends an open element of the named kinds, up to a boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"datalist"}), "body": ({"head"}, {"html"}),
}
#: Words of class, id and role attributes that speak for a kind of block.
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer copyright legal colophon contentinfo",
    "sidebar": "sidebar side aside complementary widget widgets rail",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner_ad adsense dfp",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog disclaimer paywall",
    "comment": "comment comments commentlist reply replies respond discussion disqus reactions",
    "share": "share sharing social follow tags",
    "related": "related recommended recommendations more trending popular latest teaser",
    "form": "form search login signup signin register newsletter subscribe subscription contact",
    "content": "content article post entry story body main text page prose markdown hentry blog",
}
_HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
#: Words that speak for a kind of block as part of a longer one, too.
_STEMS = re.compile("nav(?=$|bar|menu)|menu$|header$|footer|sidebar|comments?$|advert|cookie|sharing|related|newsletter")


@lru_cache(4096)
def _hint_of(word: str) -> str | None:
    if word in _HINT_OF:
        return _HINT_OF[word]
    part = _STEMS.search(word)
    return _HINT_OF[part[0]] if part else None


_TAGS = {
    "p": "p", "h1": "h1", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "li": "li", "dt": "li", "dd": "li", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "div": "div", "section": "section",
    "article": "article", "main": "main", "nav": "nav", "aside": "aside", "header": "header", "footer": "footer", "form": "form", "fieldset": "form", "button": "button", "dialog": "aside", "table": "table", "tbody": "table", "thead": "table",
    "tr": "table", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "body": "body", "html": "root", "head": "head", "#": "root", "address": "p",
}
FEATURES = ["bias", *(f"tag {t}" for t in sorted({*_TAGS.values(), "other"})), *(f"hint {h}" for h in HINTS), *(f"text {n}" for n in ("none", "short", "some", "long")), *(f"links {n}" for n in ("some", "most")), "sentence", "items", "inside", "inside header", "outside header", "inside links", "inside plain", "alone", "wrapper"]
#: Kinds of blocks that stand for themselves wherever they are.
_MARKED = frozenset(("aside", "form", "nav", "footer", "header", "button"))
_COLUMN = {f: i for i, f in enumerate(FEATURES)}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Marks of the training pages; other pages' attributes of this name mean nothing.
_STATE = re.compile(r"\bdata-y=(\d)")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(32)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


class Page:
    """The block elements of a page: parent, tag, hints, own text; and its text blocks in order.

    ``labelled``: whether it is a training page, whose elements may bear their states.
    """

    def __init__(self, source: str, labelled: bool = False):
        self.parent, self.tag, self.hints, self.label, self.inside = [-1], ["#"], [frozenset()], [NEUTRAL], [False]
        self.text_chars, self.link_chars, self.sentence, self.items = [0], [0], [False], [0]
        self.blocks: list[tuple[int, str]] = []
        self.labelled = labelled
        self._parse(source)

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        hints, label = frozenset(), self.label[parent]
        if attributes and "=" in attributes:
            words = set()
            for _, *values in _ATTRIBUTE.findall(attributes):
                words.update(_NAME.findall(_CAMEL.sub(" ", "".join(values)).lower()))
            hints = frozenset(h for h in map(_hint_of, words) if h)
            if self.labelled and (state := _STATE.search(attributes)):
                label = int(state[1])
        self.parent.append(parent)
        self.inside.append(self.inside[parent] or self.tag[parent] in ("article", "main"))
        self.tag.append(tag)
        self.hints.append(hints)
        self.label.append(label)
        for held, first in ((self.text_chars, 0), (self.link_chars, 0), (self.sentence, False), (self.items, 0)):
            held.append(first)
        if tag == "li":
            self.items[parent] += 1
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements and the block each belongs to
        places: dict[str, list[int]] = defaultdict(list)  # where in the stack each kind of element is open
        solid = [0]  # where the elements are that are not inline
        pieces: list[str] = []
        at, end, linked = 0, len(source), 0  # linked: characters of the pieces inside links

        def say(piece: str):
            nonlocal linked
            pieces.append(html.unescape(piece) if "&" in piece else piece)
            if places["a"]:
                linked += len(piece)

        def flush():
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                node = stack[-1][1]
                if text:
                    self.blocks.append((node, text))
                    self.text_chars[node] += len(text)
                    self.link_chars[node] += min(linked, len(text))
                    self.sentence[node] |= text[-1] in ".!?…:;\"'”»" or "," in text
                linked = 0

        def push(tag: str, block: int):
            places[tag].append(len(stack))
            if tag not in INLINE:
                solid.append(len(stack))
            stack.append((tag, block))

        def pop_to(k: int):
            if solid[-1] >= k:
                flush()
            while len(stack) > k:
                tag, _ = stack.pop()
                places[tag].pop()
                if solid[-1] == len(stack):
                    solid.pop()

        def innermost(kinds) -> int:
            return max((places[t][-1] for t in kinds if places[t]), default=0)

        while m := _MARKUP.search(source, at):
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if places[tag] and tag not in ("body", "html"):
                    pop_to(places[tag][-1])
                elif tag in ("p", "br"):
                    flush()
                continue
            if tag in RAW or tag in SKIPPED:
                close = _end_of(tag).search(source, at)
                at = close.end() if close else end if tag in RAW else at
                pieces.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                pieces.append(" ")
                continue
            if tag in CLOSES_P and stack[solid[-1]][0] == "p":
                pop_to(solid[-1])
            if tag in IMPLIED:
                kinds, bounds = IMPLIED[tag]
                while (k := innermost(kinds)) > innermost(bounds):
                    pop_to(k)
                    if tag not in ("tr", "tbody"):
                        break
            if tag not in INLINE:
                flush()
            push(tag, stack[-1][1] if tag in INLINE else self._add(stack[-1][1], tag, m[3]))
        if at < end:
            say(source[at:])
        flush()

    def marked(self) -> list[bool]:
        """Which nodes are marked as blocks of a kind of their own."""
        return [_TAGS.get(tag) in _MARKED or bool(hints - {"content"}) for tag, hints in zip(self.tag, self.hints, strict=True)]

    def rows(self) -> list[list[int]]:
        """The columns of the features that hold, for each node."""
        out, few = [], len(self.blocks) < 3
        for tag, hints, n, linked, sentence, items, inside, marked in zip(self.tag, self.hints, self.text_chars, self.link_chars, self.sentence, self.items, self.inside, self.marked(), strict=True):
            kind = _TAGS.get(tag, "other")
            row = [0, _COLUMN[f"tag {kind}"], _COLUMN["text " + ("none" if not n else "short" if n < 30 else "some" if n < 120 else "long")]]
            row += [_COLUMN[f"hint {h}"] for h in hints]
            if n and linked > 0.25 * n:
                row.append(_COLUMN["links most" if linked > 0.6 * n else "links some"])
            if sentence:
                row.append(_COLUMN["sentence"])
            if items > 2:
                row.append(_COLUMN["items"])
            if inside:
                row.append(_COLUMN["inside"])
                if kind == "header" or "header" in hints:
                    row.append(_COLUMN["inside header"])
                elif not marked:
                    row.append(_COLUMN["inside links" if n and linked > 0.6 * n else "inside plain"])
            elif kind == "header" or "header" in hints:
                row.append(_COLUMN["outside header"])
            if not n and not hints and kind == "div":
                row.append(_COLUMN["wrapper"])
            if n and few and not marked:
                row.append(_COLUMN["alone"])
            out.append(row)
        return out


class Forest:
    """Pages as one forest, its nodes in levels of equal depth."""

    def __init__(self, pages: list[Page]):
        self.first = np.cumsum([0, *(len(p.parent) for p in pages)])
        parent, rows = [], []
        for base, p in zip(self.first.tolist(), pages, strict=False):
            parent += [-1 if q < 0 else q + base for q in p.parent]
            rows += p.rows()
        self.parent = np.array(parent, np.int64)
        self.kind = np.array([m for p in pages for m in p.marked()], np.int64)
        counts = np.array([len(r) for r in rows])
        self.owner, self.feature = np.repeat(np.arange(len(rows)), counts), np.array([c for r in rows for c in r], np.int64)
        depth = np.zeros(len(parent), np.int64)
        for i, q in enumerate(parent):  # parents come before their children
            if q >= 0:
                depth[i] = depth[q] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.owner, weights[self.feature, s], len(self.parent)) for s in range(3)], 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


#: Levels of fewer nodes are taken node by node.
NARROW = 6


def _sums(rows: list[list[float]]) -> list[float]:
    """Logarithms of the sums of exponentials of each row."""
    out = []
    for row in rows:
        top = max(row)
        out.append(top + math.log(sum(math.exp(x - top) for x in row)))
    return out


def marginals(forest: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals of nodes, and of (parent, child) states for each node's edge to its parent. ``edge``:
    potentials of (parent, child) states for each kind of child, or for all."""
    kind = forest.kind if edge.ndim == 3 else np.zeros(len(unary), np.int64)
    edge = edge if edge.ndim == 3 else edge[None]
    inner, up, parent = unary.copy(), np.zeros_like(unary), forest.parent
    across, along = edge.tolist(), edge.transpose(0, 2, 1).tolist()
    for level in reversed(forest.levels[1:]):  # upward
        if len(level) < NARROW:
            for i in level.tolist():
                own = inner[i].tolist()
                up[i] = _sums([[e + x for e, x in zip(row, own, strict=True)] for row in across[kind[i]]])
                inner[parent[i]] += up[i]
            continue
        up[level] = _log_sum(edge[kind[level]] + inner[level][:, None, :], 2)
        np.add.at(inner, parent[level], up[level])
    belief = inner.copy()
    for level in forest.levels[1:]:  # downward
        outside = belief[parent[level]] - up[level]
        if len(level) < NARROW:
            for i, rest in zip(level.tolist(), outside.tolist(), strict=True):
                belief[i] += _sums([[e + x for e, x in zip(row, rest, strict=True)] for row in along[kind[i]]])
            continue
        belief[level] += _log_sum(outside[:, :, None] + edge[kind[level]], 1)
    child = np.flatnonzero(parent >= 0)
    pairs = np.zeros((len(unary), 3, 3))
    pairs[child] = (belief[parent[child]] - up[child])[:, :, None] + edge[kind[child]] + inner[child][:, None, :]
    flat = pairs.reshape(len(pairs), 9)
    return belief - _log_sum(belief, 1)[:, None], (flat - _log_sum(flat, 1)[:, None]).reshape(-1, 3, 3)


def fit(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of highest likelihood: observed minus expected counts of features and edges."""
    forest = Forest(pages)
    y = np.array([v for p in pages for v in p.label])
    n, child = len(y), np.flatnonzero(forest.parent >= 0)
    truth = np.eye(3)[y]
    kind = forest.kind[child]
    seen_edge = np.zeros((2, 3, 3))
    np.add.at(seen_edge, (kind, y[forest.parent[child]], y[child]), 1)
    weights, edge = np.zeros((len(FEATURES), 3)), np.zeros((2, 3, 3))
    first, second = [np.zeros_like(weights), np.zeros_like(edge)], [np.zeros_like(weights), np.zeros_like(edge)]
    for step in range(1, STEPS + 1):
        node, pair = marginals(forest, forest.unary(weights), edge)
        gap = truth - np.exp(node)
        got = np.stack([np.bincount(forest.feature, gap[forest.owner, s], len(FEATURES)) for s in range(3)], 1)
        held = np.exp(pair[child])
        expected = np.stack([held[kind == k].sum(axis=0) for k in (0, 1)])
        grads = (got / n - DECAY * weights, (seen_edge - expected) / n - DECAY * edge)
        for k, (p, g) in enumerate(zip((weights, edge), grads, strict=True)):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p += RATE * (1 - step / (STEPS + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return weights, edge


def _words(rng: random.Random, n: int) -> str:
    made = ["".join(rng.choice("aeiourstnlmdpkbg") for _ in range(rng.randint(2, 9))) for _ in range(max(1, n))]
    return " ".join(made)


def _prose(rng: random.Random, sentences: int) -> str:
    return " ".join(f"{_words(rng, rng.randint(2, 22)).capitalize()}{rng.choice(['.', '.', '.', '?', ', ' + _words(rng, 3) + '.'])}" for _ in range(sentences))


def _links(rng: random.Random, n: int, each: str = "li") -> str:
    return "".join(f"<{each}><a href='/{i}'>{_words(rng, rng.randint(1, 7))}</a></{each}>" for i in range(n))


def training_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """Pages of varied layouts; ``data-y`` gives an element's state and that of all below it."""
    rng = random.Random(seed)
    pick = lambda words: rng.choice(words.split())

    def block(kind: str) -> str:
        y = f"data-y={BOILERPLATE}"
        tag, name = rng.choice(("div", "div", "section", "aside")), f"{rng.choice(('class', 'id'))}='{rng.choice(('', 'site-', 'x_'))}{pick(HINTS[kind])}'"
        if kind == "nav" and rng.random() < 0.2:
            return f"<div {y}>{rng.choice((' | ', ' ', ' &middot; ')).join(f'<a href=/{i}>{_words(rng, rng.randint(1, 2))}</a>' for i in range(rng.randint(2, 7)))}</div>"
        if kind == "nav":
            opened = rng.choice((f"nav {y}", f"div {y} {name}", f"ul {y} {name}"))
            inner = _links(rng, rng.randint(2, 9))
            return f"<{opened}>{inner if opened[0] == 'u' else f'<ul>{inner}</ul>'}</{opened.split()[0]}>"
        if kind in ("header", "footer"):
            opened = rng.choice((kind, "div"))
            inner = rng.choice((f"<h1>{_words(rng, rng.randint(1, 4))}</h1>", f"<h1><a href=/>{_words(rng, 2)}</a></h1>", f"<h1>{_words(rng, 3)}</h1><p>{_words(rng, 6)}</p>", f"&copy; {_words(rng, 4)} &middot; {_prose(rng, 1)}", f"<p>{_prose(rng, 2)}</p><ul>{_links(rng, 4)}</ul>", f"<div>{_words(rng, 3)}</div>"))
            return f"<{opened} {y} {name if opened == 'div' else ''}>{inner}</{opened}>"
        if kind == "form":
            return f"<form {y} action='/x'><p>{_prose(rng, 1)}</p><label>{_words(rng, 2)}</label><input name=q><button>{_words(rng, 1)}</button></form>" if rng.random() < 0.6 else f"<div {y} {name}><h3>{_words(rng, 3)}</h3><p>{_prose(rng, 2)}</p></div>"
        if kind == "comment":
            each = "".join(f"<{t}><b>{_words(rng, 1)}</b><p>{_prose(rng, rng.randint(1, 6))}</p></{t}>" for t in [rng.choice(("li", "div", "article"))] * rng.randint(1, 5))
            return f"<{tag} {y} {name}><h3>{_words(rng, 2)}</h3>{each}</{tag}>"
        if kind in ("related", "sidebar"):
            inner = rng.choice((f"<ul>{_links(rng, rng.randint(2, 7))}</ul>", f"<p>{_prose(rng, rng.randint(1, 5))}</p>", _links(rng, 4, "p"), f"{_prose(rng, 2)}"))
            return rng.choice((f"<{tag} {y} {name}><h3>{_words(rng, 2)}</h3>{inner}</{tag}>", f"<aside {y}><h4>{_words(rng, 3)}</h4>{inner}</aside>"))
        inner = rng.choice((_prose(rng, rng.randint(1, 3)), f"<p>{_prose(rng, rng.randint(1, 4))}</p>", _words(rng, rng.randint(1, 4)), f"<a href='#'>{_words(rng, 4)}</a>"))
        return f"<{tag} {y} {name}>{inner}</{tag}>"

    def some(chance: float, *kinds: str) -> str:
        return "".join(block(k) for k in kinds if rng.random() < chance)

    def body_block() -> str:
        roll = rng.random()
        if roll < 0.55:
            text = _prose(rng, rng.randint(1, 9)) if rng.random() < 0.85 else _words(rng, rng.randint(1, 3))
            return f"<p>{'<b>' if rng.random() < 0.15 else ''}{text}{'<br>' if rng.random() < 0.15 else '</p>'}"
        if roll < 0.58:
            return f"<{rng.choice(('p', 'div', 'address'))} class={rng.choice(('byline', 'author', 'meta', 'dateline', 'lead'))}>{_words(rng, rng.randint(2, 6))}</p>".replace("</p>", "")
        if roll < 0.61:
            return f"<div>{'<br>'.join(_prose(rng, rng.randint(1, 3)) for _ in range(rng.randint(1, 4)))}</div>"
        if roll < 0.63:
            return "<ul>" + _links(rng, rng.randint(2, 6)) + "</ul>"
        if roll < 0.72:
            level = rng.choice("2234")
            return f"<h{level}>{_words(rng, rng.randint(1, 7))}</h{level}>"
        if roll < 0.8:
            return "<ul>" + "".join(f"<li>{_prose(rng, 1)}" for _ in range(rng.randint(2, 6))) + "</ul>"
        if roll < 0.86:
            return f"<blockquote><p>{_prose(rng, 2)}</p></blockquote>"
        if roll < 0.9:
            return "<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 1)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if roll < 0.93:
            return f"<figure><img src=x><figcaption>{_words(rng, 6)}</figcaption></figure>"
        if roll < 0.96:
            return f"<pre>{_words(rng, 12)}</pre>"
        return some(0.5, "ad", "share", "related", "form", "notice") or f"<div>{_prose(rng, 3)}</div>"

    def page() -> str:
        title = f"<h1>{_words(rng, rng.randint(2, 12))}</h1>" if rng.random() < 0.8 else ""
        c = f"data-y={CONTENT}"
        if title and rng.random() < 0.2:
            title = f"<header {c}>{title}{rng.choice(('', f'<p>{_words(rng, 5)}</p>', f'<p class=byline>{_words(rng, 3)}</p>'))}</header>"
        blocks = [body_block() for _ in range(1 if rng.random() < 0.2 else rng.randint(1, 12))]
        if rng.random() < 0.12:  # many short paragraphs among long ones
            blocks += [f"<p>{_words(rng, rng.randint(1, 4)).capitalize()}{rng.choice('...,?')}</p>" for _ in range(rng.randint(10, 60))]
            rng.shuffle(blocks)
        inner = title + "".join(blocks)
        if rng.random() < 0.25:  # blocks of other kinds at the end of an article, however short that is
            inner += some(0.6, *rng.sample(("share", "related", "form", "ad", "notice"), 3))
        name = f"{rng.choice(('class', 'id'))}='{rng.choice(('', 'the-', 'post-'))}{pick(HINTS['content'])}'"
        shape = rng.random()
        if shape < 0.4:
            main = f"<article {c}>{inner}</article>"
        elif shape < 0.5:
            main = f"<main {c}>{inner}</main>"
        elif shape < 0.6:
            main = f"<main data-y={NEUTRAL}>{some(0.3, 'nav', 'share')}<article {c}>{inner}</article>{some(0.4, 'comment', 'related')}</main>"
        elif shape < 0.8:
            main = f"<div {c} {name}>{inner}</div>"
        elif shape < 0.88:
            main = f"<section {c}>{inner}</section>"
        elif shape < 0.95:
            main = f"<div {c}>{inner}</div>"
        else:
            main = re.sub(r"<(p|h\d|ul|blockquote|table|figure|pre|div)(?=>)", rf"<\1 {c}", inner)
        if rng.random() < 0.35:
            depth = rng.choice((1, 2, 3, 5, 12, 40))
            main = "<div>" * depth + main + some(0.2, "share", "related", "footer") + "</div>" * depth
        lone = rng.random()
        if lone < 0.08:  # a fragment by itself
            return rng.choice((main, f"<div {c}>{_prose(rng, rng.randint(1, 3))}</div>", f"<div {c}><p>{_prose(rng, rng.randint(1, 2))}</p></div>", f"<p {c}>{_prose(rng, 1)}</p>"))
        if lone < 0.16:  # text in the body itself, or in plain blocks of it
            text = rng.choice((_prose(rng, rng.randint(1, 6)), "<br>".join(_prose(rng, 2) for _ in range(rng.randint(1, 5))), f"<div>{_prose(rng, rng.randint(1, 3))}</div>", f"<div><p>{_prose(rng, 1)}</p></div>"))
            return f"<html><head><title>t</title></head><body {c}>{some(0.3, 'nav', 'notice')}{text}{some(0.3, 'footer', 'ad')}</body></html>"
        wrapped = some(0.5, "notice", "ad") + main + some(0.35, "sidebar", "related", "comment", "share", "form", "ad")
        if rng.random() < 0.3:
            wrapped = f"<div class='{pick('wrapper container page row layout')}'>{wrapped}</div>"
        head = "<head><title>t</title><style>p{}</style><script>x('</p>')</script></head>"
        ends = "" if rng.random() < 0.2 else "</body></html>"
        return f"<!DOCTYPE html><html>{head}<body>{some(0.7, 'nav')}{some(0.6, 'header')}{some(0.4, 'ad', 'nav', 'notice')}{wrapped}{some(0.7, 'footer')}{ends}"

    return [page() for _ in range(count)]


@lru_cache(1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    return fit([Page(x, labelled=True) for x in training_pages()])


def extract(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    parsed = [Page(x or "") for x in pages]
    forest = Forest(parsed)
    node, _ = marginals(forest, forest.unary(model[0]), model[1])
    content = node.argmax(axis=1) == CONTENT
    return [" ".join(text for i, text in p.blocks if content[base + i]) for base, p in zip(forest.first.tolist(), parsed, strict=False)]


def main_text(pages: DataFrame, html_col: str = "html") -> Column:
    """The main text of each row's page."""
    bound_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        texts, out = sources.tolist(), []
        at = 0
        while at < len(texts):  # a few hundred pages, or some millions of characters, make one forest
            end, size = at, 0
            while end < len(texts) and (end == at or (end - at < 200 and size < 2_000_000)):
                size += len(texts[end] or "")
                end += 1
            out += extract(texts[at:end], held.value)
            at = end
        return pd.Series(out, dtype=object)

    return run(F.col(html_col))
