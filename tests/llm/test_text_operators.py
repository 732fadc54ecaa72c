"""Mixing, chat, decontamination, language ID, toxicity and HTML on small rows and edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, html_extract, langid, mixing, toxicity
from millrace.llm.common import PLAIN_WORD, lower_ascii

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, score string, report string"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with extra columns whose names clash."""
    full = [(r[0], r[1], *(list(r[2:]) + ["en", "s"][len(r) - 2 :])[:2], None if r[1] is None else len(r[1]), "c", "x", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


# Mixing


def test_mix_counts_follow_poisson(spark):
    df = docs(spark, [(i, f"t{i}", "en", "big" if i % 3 else "small") for i in range(6000)])
    got = mixing.mix(df, {"big": 1.0, "small": 3.0})
    by = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert by["big"] == pytest.approx(1500, rel=0.12) and by["small"] == pytest.approx(4500, rel=0.12)
    counts = [r["n"] for r in got.filter("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    rate = 4500 / 2000
    assert 2000 - len(counts) == pytest.approx(2000 * math.exp(-rate), rel=0.25)  # documents without a copy
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "report", "copy", "mix_key"]


def test_mix_is_repeatable_and_handles_edges(spark):
    df = docs(spark, [(1, None, None, None), (None, "x", "en", "a"), (2, "", "en", "a"), (2, "", "en", "a"), (3, "y" * 10**6, "en", "b")])
    once, twice = (sorted((r["doc_id"] or 0, r["source"] or "", r["copy"]) for r in mixing.mix(df).collect()) for _ in range(2))
    assert once == twice
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df, {}).count() == 0 and mixing.mix(df, {"none": 1.0}).count() == 0
    only = mixing.mix(df, {"b": 1.0})
    assert {r["doc_id"] for r in only.collect()} <= {3}


def test_mix_large_rate_and_join_path(spark, monkeypatch):
    df = docs(spark, [(i, "t", "en", "rare" if i == 0 else "most") for i in range(400)])
    got = {r["source"]: r["n"] for r in mixing.mix(df).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert 130 <= got["rare"] <= 275
    want = sorted((r["doc_id"], r["copy"]) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r["doc_id"], r["copy"]) for r in mixing.mix(df).collect()) == want


def test_mix_large_rates_are_poisson(spark):
    df = spark.createDataFrame([(i, "rare" if i < 100 else "most") for i in range(50_000)], "doc_id long, source string")
    n = np.array([r["n"] for r in mixing.mix(df, {"rare": 1.0}).groupBy("doc_id").agg(F.count("*").alias("n")).collect()])
    assert len(n) == 100 and n.mean() == pytest.approx(500, rel=0.02) and n.var() == pytest.approx(500, rel=0.35)


# Chat

CONTROLS = st.sampled_from([*chat.FOREIGN, chat.TURN, chat.TEXT, chat.END, "\\", "<", "|", "<\\|turn|>", "[\\INST]", "a", "\n", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(CONTROLS, max_size=8).map("".join))
def test_escape_round_trip(text):
    held = chat.escape(text)
    assert chat.unescape(held) == text and not any(c in held for c in (chat.TURN, chat.TEXT, chat.END, *chat.FOREIGN))


def test_chat_examples_and_digest(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u</s>"), (1, 2, "assistant", "a1"), (1, 3, "user", None), (1, 4, "assistant", "a2[INST]"), (1, 5, "user", "tail"), (2, 0, "user", "only"), (None, 1, None, "x"), (3, 0, "assistant", "y" * 100_000), (4, 1, "assistant", "b"), (4, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.format_examples(turns)
    of = {}
    for r in examples.collect():
        of.setdefault(r["conv_id"], []).append(r)
    one = sorted(of[1], key=lambda r: r["example"])
    assert [chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) for r in one] == ["a1", "a2[INST]", ""]
    assert chat.parse(one[0]["formatted"]) == [("system", "s"), ("user", "u</s>"), ("assistant", "a1")]
    assert chat.parse(one[2]["formatted"]) == [("system", "s"), ("user", "u</s>"), ("assistant", "a1"), ("user", ""), ("assistant", "a2[INST]"), ("user", "tail")]
    assert len(of[2]) == 1 and of[2][0]["loss_start"] == of[2][0]["loss_end"]
    got = {r["conv_id"]: r for r in chat.digest(examples).collect()}
    assert set(got) == {1, 2, 3, 4, None} and got[4]["n_turns"] == 2 and got[4]["loss_chars"] == 2
    assert got[1]["loss_sha256"] == hashlib.sha256(b"a1a2[INST]").hexdigest() and got[3]["loss_chars"] == 100_000
    assert chat.digest(chat.format_examples(turns.limit(0))).count() == 0


# Decontamination


def brute(text, items, window=10):
    words = PLAIN_WORD.findall(lower_ascii(text)) if text else []
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = PLAIN_WORD.findall(lower_ascii(t)) if t else []
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[j : j + n]:
                    found.add(item)
                    hit[i : i + n] = [True] * n
    return len(words), sum(hit), sorted(found)


@pytest.mark.parametrize("most", [10**6, 0])
def test_scan_both_paths_against_brute_force(spark, most):
    rng = random.Random(4)
    word = lambda: rng.choice("ab cd ef gh ij Kl mÉ no".split())
    items = [(i, " ".join(word() for _ in range(rng.choice((3, 9, 10, 14))))) for i in range(12)] + [(90, None), (91, "... !!"), (92, "ZZ top"), (92, "ZZ top")]
    texts = [" ".join(word() for _ in range(60)) + rng.choice(["", ". zz TOP!", f", {items[i % 12][1].upper()}?"]) for i in range(25)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "!!", texts[0]])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["report"] for r in decontaminate.scan(docs(spark, rows), bench, max_windows=most).collect()}
    for i, t in rows:
        n, hit, found = brute(t, items)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) == (n, hit, len(found), sha, hit > 0)


def test_a_benchmark_in_capitals_is_counted_whole(spark):
    bench = spark.createDataFrame([(1, " ".join(["WORD"] * 400))], "item_id long, text string")
    assert decontaminate._collect_items(bench, "item_id", "text", 10, 100) is None
    assert len(decontaminate._collect_items(bench, "item_id", "text", 10, 401)) == 1


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontaminate_cuts_and_keeps(spark, most):
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{long}. {passage.upper()}! End."), (2, long), (3, passage), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, rows), bench, max_windows=most).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1]["text"] == f"{long}. ! End." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == long and got[2]["report"] is None
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).count() == 5
    assert decontaminate.decontaminate(docs(spark, rows).limit(0), bench).count() == 0


# Language ID


def test_langid(spark):
    rng = random.Random(1)
    letters = {"aa": "aeioult", "bb": "bdkzgrw", "cc": "жшщцкви"}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))
    train = docs(spark, [(i, text(x, 60), x) for i, x in enumerate(list(letters) * 30)] + [(999, None, "aa"), (998, "abc", None)])
    profiles = langid.fit(train, max_per_lang=20)
    assert profiles.langs == ["aa", "bb", "cc"]
    tests = docs(spark, [(i, text(x, 12), x) for i, x in enumerate(list(letters) * 10)] + [(100, None), (101, ""), (102, "123 -- !"), (103, text("cc", 60_000))])
    got = {r["doc_id"]: r["p"] for r in tests.select("doc_id", langid.predict(tests, profiles).alias("p")).collect()}
    assert all(got[i]["lang_pred"] == x for i, x in enumerate(list(letters) * 10))
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102)) and got[103]["lang_pred"] == "cc" and 0 < got[103]["score"] <= 1
    kept = langid.keep_identified(tests, profiles)
    assert kept.columns == tests.columns and kept.count() == 31
    nothing = langid.fit(train.limit(0))
    assert {r["p"]["lang_pred"] for r in tests.select(langid.predict(tests, nothing).alias("p")).collect()} == {"und"}


def test_bundle_is_what_its_definition_says():
    b = langid.Bundler(64)
    text = "Abba, b!"
    codes = b.codes(text).tolist()
    want = np.zeros(64)
    for i in range(len(codes) - 2):
        v = np.ones(64)
        for place, c in enumerate(reversed(codes[i : i + 3])):
            v *= np.roll(langid.letter_vector(c, 64), place)
        want += v
    assert np.allclose(b.bundle([text])[0], want)


# Toxicity


def test_gradient_matches_differences():
    rng = np.random.Generator(np.random.PCG64(0))
    net = toxicity.Network(["ab", "cde"], rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at = np.array([[0, 1, 2, 3], [2, 1, 3, 3]])
    words = ["ab", "cde", "xyz"]

    def loss():
        return float(net.forward(net.project(net.inputs(words)[0]), at).sum())

    x, how = net.inputs(words)
    pre = net.project(x)
    _, kept = net.forward(pre, at, keep=True)
    grads = net.backward(pre, at, kept, np.ones(2), x, np.ones((3, 1)), how)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for i in np.flatnonzero(np.abs(g.reshape(-1)) > 1e-6)[:6]:
            kept_value, step = flat[i], 1e-3
            flat[i] = kept_value + step
            up = loss()
            flat[i] = kept_value - step
            down = loss()
            flat[i] = kept_value
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=2e-3)


def test_toxicity_learns_and_scores_whole_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    clean = lambda n: [word() for _ in range(n)]

    def bad(n):
        w = clean(n)
        w[rng.randrange(n)] = rng.choice(("zonk", "zonkers", "zonkish"))
        return w

    texts = [(i, " ".join(bad(40) if i % 2 else clean(40)), i % 2) for i in range(480)]
    model = toxicity.train([t for _, t, _ in texts], [y for *_, y in texts])
    held = [(i, " ".join(bad(50) if i % 2 else clean(50))) for i in range(40)] + [(100, None), (101, ""), (102, " ".join([*clean(3000), "zonkly"])), (103, " ".join(clean(200)))]
    df = docs(spark, held)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", toxicity.score(df, model).alias("s")).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(40)]) >= 0.8
    assert got[100] == got[101] < 0.5 and got[102] > got[103]
    assert toxicity.train(["a"], [1]) == 1.0 and toxicity.train([], []) == 0.0
    assert df.select(toxicity.score(df, 0.25).alias("s")).distinct().count() == 1


def test_windows_overlap_and_cover():
    for n in (0, 1, 64, 65, 112, 1000):
        begins = toxicity.windows_of(n)
        assert begins[0] == 0 and begins[-1] + toxicity.WINDOW >= n
        assert all(b - a < toxicity.WINDOW for a, b in zip(begins, begins[1:], strict=False))


def test_passages_of_half_a_window_lie_whole_in_one():
    for n in (64, 65, 112, 333):
        begins, size = toxicity.windows_of(n), toxicity.WINDOW // 2
        assert all(any(b <= i and i + size <= b + toxicity.WINDOW for b in begins) for i in range(n - size + 1))


# HTML


def test_extraction_on_held_out_layouts():
    model = html_extract.trained()
    pages = [html_extract.Page(x, labelled=True) for x in html_extract.training_pages(80, seed=77)]
    forest = html_extract.Forest(pages)
    node, _ = html_extract.marginals(forest, forest.unary(model[0]), model[1])
    right = total = 0
    for base, p in zip(forest.first, pages, strict=False):
        for i, text in p.blocks:
            right += len(text) * ((node[base + i].argmax() == html_extract.CONTENT) == (p.label[i] == html_extract.CONTENT))
            total += len(text)
    assert right / total >= 0.95


def test_marginals_equal_enumeration():
    page = html_extract.Page("<body><div><p>a</p></div><p>b</p></body>")
    forest = html_extract.Forest([page])
    rng = np.random.default_rng(0)
    unary, edge = rng.normal(size=(len(page.parent), 3)), rng.normal(size=(3, 3))
    from itertools import product

    n, want = len(page.parent), np.zeros((len(page.parent), 3))
    for s in product(range(3), repeat=n):
        w = math.exp(sum(unary[i, s[i]] for i in range(n)) + sum(edge[s[page.parent[i]], s[i]] for i in range(1, n)))
        for i in range(n):
            want[i, s[i]] += w
    node, _ = html_extract.marginals(forest, unary, edge)
    assert np.allclose(np.exp(node), want / want.sum(axis=1, keepdims=True))


ARTICLE = "<article><h1>Title &amp; more</h1><p><b>First  line,\n with a break.<br><p>Second &lt;p&gt; here, quite long enough to be a text. </p><div class='ad'>Buy now</div></article>"
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><script>var x = "</p>";</script><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><!-- c -->
<div class="cookie-notice"><p>We use cookies, as every page does. Please accept them all.</p></div>{ARTICLE}
<aside class="sidebar"><p>Words in a sidebar that go on for a while, and longer.</p></aside><div id="comments"><div><p>I like this article, it is well written and very long.</p></div></div>
<form><p>Sign up for letters, they come every day.</p><input></form><footer>&copy; Someone</footer>"""


def test_extract_pages(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<div>" * 5000 + "deep"), (5, "<p>unclosed <b>bold, with text that goes on for some time"), (6, PAGE), (7, PAGE.replace("Second", "Second " * 50_000))]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("x"))
    got = {r["page_id"]: r["t"] for r in df.select("page_id", html_extract.main_text(df).alias("t")).collect()}
    assert got[1] == "Title & more First line, with a break. Second <p> here, quite long enough to be a text."
    assert got[2] == got[3] == "" and got[6] == got[1] and got[7].count("Second") == 50_000
    assert df.limit(0).select(html_extract.main_text(df)).count() == 0


TAIL = "<article><h1>Title of it</h1><p>It is a text, and it goes on for a good while. It has two sentences.</p></article>"
SAID = "Title of it It is a text, and it goes on for a good while. It has two sentences."

#: Pages of other layouts than those of the training pages.
BY_HAND = [
    (f"<body><script>var s='<!--';</script>{TAIL}</body>", SAID),
    (f"<body><script>for(i=0;i<n;i++){{ /* don't stop */ }}</script>{TAIL}</body>", SAID),
    (f"<body><style>a>b::before{{content:'<p>'}}</style ><div data-y='12px' data-y=2></div>{TAIL}", SAID),
    (f"<body><select><option>One<option>Two{TAIL}", f"One Two {SAID}"),  # an unclosed select is no text of its own, what follows is
    (TAIL.replace("a text", "&am<b>p;</b> text"), SAID.replace("a text", "&amp; text").replace("&amp;", "&amp;")),
    ("<body><div id=topnav><a href=/>Start</a> | <a href=/x>More</a></div><div class=entry-content><h2>On rivers</h2><p>Rivers run down, as rivers do, for a very long way.</p><p>Then they end, in a sea or in a lake somewhere.</p></div><div class=site-footer>All rights reserved</div>", "On rivers Rivers run down, as rivers do, for a very long way. Then they end, in a sea or in a lake somewhere."),
    ("<body><header><h1>The Daily</h1></header><main><article><h1>Rain</h1><p>It rained all day, and all night, in the whole country.<ul><li>Wind, in the north of it.<li>Hail, in the south of it.</ul></article><section class=comments><p>I was there and it was wet, so wet.</p></section></main><footer>Imprint</footer>", "Rain It rained all day, and all night, in the whole country. Wind, in the north of it. Hail, in the south of it."),
]


def test_pages_by_hand():
    got = html_extract.extract([x for x, _ in BY_HAND], html_extract.trained())
    assert [g for g in got if g] == got
    assert got[:3] == [want for _, want in BY_HAND[:3]] and got[4:] == [want for _, want in BY_HAND[4:]]
    assert SAID in got[3]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<", "<div", ">", "</", "<script>", "</script>", "<!--", "-->", "<a href='", '"', "&", "&#x", "data-y=", "<p>", "<li>", "<td>", "</div>", "<![CDATA["]), st.text(max_size=4)), max_size=25).map("".join))
def test_any_text_is_a_page(text):
    (got,) = html_extract.extract([text], html_extract.trained())
    assert isinstance(got, str)


def test_parsing_takes_time_in_proportion():
    import time

    shapes = ["<div>" * 100_000 + "</x>" * 100_000, "<p><x>" + "<b>" * 60_000 + "<div></div>" * 60_000, "<li><ul>" + "<div>" * 60_000 + "<li></li>" * 60_000, "<b>" * 100_000 + "<p></p>" * 60_000]
    for shape in shapes:
        began = time.perf_counter()
        html_extract.extract([shape], html_extract.trained())
        assert time.perf_counter() - began < 10


def test_html_query_contract(spark):
    from millrace.llm import queries
    from tests.conftest import SMALL

    out = queries.op2_html(spark, SMALL)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    rows, pages = out.collect(), spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert len(rows) == pages and all(r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split()) for r in rows)
