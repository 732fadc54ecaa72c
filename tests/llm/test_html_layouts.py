"""Main texts of layouts that the training composer does not write."""

import numpy as np
import pytest

from millrace.llm import html_extract

S = "A sentence of the story, which is long enough to read. And another one follows it here."
T = "Short story line."
LAYOUTS = {
    "form share related in article": (f"<html><body><nav><a href=/>Home</a></nav><article><p>{S}</p><form action=/s><input><p>Sign up now for news.</p><button>Go</button></form><div class=share><a href=#>Share</a></div><div class=related><ul><li><a href=/1>Other story</a></li><li><a href=/2>One more</a></li></ul></div></article></body></html>", S),
    "short article + address": (f"<article><p>{T}</p><address>12 Some Street, Town</address></article>", f"{T} 12 Some Street, Town"),
    "body div": (f"<body><div>{S}</div></body>", S),
    "div br": (f"<div>{T}<br>{S}<br>{T}</div>", f"{T} {S} {T}"),
    "div p": (f"<div><p>{S}</p></div>", S),
    "div p short": (f"<div><p>{T}</p></div>", T),
    "deep": ("<div>"*600+f"<article><h1>Title words</h1><p>{S}</p></article>", f"Title words {S}"),
    "deeper": ("<div>"*5000+f"<article><h1>Title words</h1><p>{S}</p></article>", f"Title words {S}"),
    "math": (f"<article><p>{S} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><object><p>{S}</p></object></article>", f"{S} x=1 holds. {S}"),
    "byline": (f"<article><h1>Title words</h1><p class=byline>By Some One</p><div class=author>Some One writes</div><p>{S}</p></article>", f"Title words By Some One Some One writes {S}"),
    "header h1": (f"<body><header><a href=/>Site</a></header><article><header><h1>Title words here</h1></header><p>{S}</p><p>{S}</p></article><footer>c 2020 Site</footer></body>", f"Title words here {S} {S}"),
    "link list": (f"<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>{S}</p><ul><li><a href=/1>First paper cited</a></li><li><a href=/2>Second paper</a></li></ul><p>{S}</p></article>", f"Title {S} First paper cited Second paper {S}"),
    "main div": (f"<body><div id=nav><a href=/>a</a> <a href=/b>b</a></div><main><div><p>{S}</p><p>{S}</p></div></main><footer><p>Copyright, all rights reserved.</p></footer></body>", f"{S} {S}"),
    "table layout": (f"<table><tr><td class=menu><a href=/>Home</a><br><a href=/n>News</a></td><td class=content><h2>Title words</h2><p>{S}</p><p>{S}</p></td></tr></table>", f"Title words {S} {S}"),
    "comments": (f"<article><p>{S}</p></article><section id=comments><h3>2 comments</h3><article><p>{S}</p></article><article><p>I agree with it.</p></article></section>", S),
    "section": (f"<body><header>My site</header><section class=post><h2>Head</h2><p>{S}</p><aside>Ad text here, buy it now.</aside><p>{S}</p></section></body>", f"Head {S} {S}"),
    "plain text": (S, S),
    "body p": (f"<html><body><p>{S}</p><p>{T}</p></body></html>", f"{S} {T}"),
    "dl": (f"<main><dl><dt>Term one</dt><dd>{S}</dd></dl></main>", f"Term one {S}"),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(name):
    source, want = LAYOUTS[name]
    assert html_extract.extract([source], html_extract.trained()) == [want]


def test_depth_changes_nothing():
    page = f"<article><h1>Title words</h1><p>{S}</p><div class=share><a href=#>Share</a></div></article><footer>All rights reserved, by us.</footer>"
    got = html_extract.extract(["<div>" * n + page for n in (1, 2, 511, 512, 513, 3000)], html_extract.trained())
    assert set(got) == {f"Title words {S}"}


def test_narrow_levels_equal_wide_ones(monkeypatch):
    pages = [html_extract.Page(x, labelled=True) for x in html_extract.training_pages(12, seed=5)]
    forest, model = html_extract.Forest(pages), html_extract.trained()
    unary = forest.unary(model[0])
    node, pair = html_extract.marginals(forest, unary, model[1])
    for narrow in (0, 10**6):
        monkeypatch.setattr(html_extract, "NARROW", narrow)
        again, pairs = html_extract.marginals(forest, unary, model[1])
        assert np.allclose(node, again) and np.allclose(pair, pairs)
    child = np.flatnonzero(forest.parent >= 0)
    assert np.allclose(np.exp(pair[child]).sum(axis=1), np.exp(node[child]))  # pairs sum to the child's marginal


def test_held_out_characters():
    """At least 0.95 of the characters of unseen composed pages are on the right side."""
    pages = [html_extract.Page(x, labelled=True) for x in html_extract.training_pages(150, seed=901)]
    forest, model = html_extract.Forest(pages), html_extract.trained()
    content = html_extract.marginals(forest, forest.unary(model[0]), model[1])[0].argmax(axis=1) == html_extract.CONTENT
    right = total = 0
    for base, p in zip(forest.first.tolist(), pages, strict=False):
        for i, text in p.blocks:
            total += len(text)
            right += len(text) * (content[base + i] == (p.label[i] == html_extract.CONTENT))
    assert right / total >= 0.95
