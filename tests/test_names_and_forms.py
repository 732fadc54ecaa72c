"""Name masking, near spellings, trimming of replies and rounding against plain loops and known values."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import formats, speech, stats, text
from millrace.functions.vectors import cosine_pairs
from millrace.operators import names, recurrences, smoothing


def test_near_spellings_by_known_values():
    assert names.winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and names.winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert names.winkler("ab", "cd") == 0 and names.equal_share("", "") == 1 and names.equal_share("kitten", "sitting") == pytest.approx(8 / 13)


def test_near_spellings_equal_all_pairs(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("aeioulnt") for _ in range(rng.randint(5, 11))) for _ in range(25)]
    tokens = sorted({"".join(x) for p in pool for x in (list(p), [*p, "x"], list(p)[1:], [*p[:3], "z", *p[4:]])} | {"".join(rng.choice("bdfg") for _ in range(7)) for _ in range(9)})
    want = {w for w in tokens if len(w) >= 5 for n in pool if names.equal_share(w, n) >= 0.9 or (len(w) >= 6 and names.winkler(w, n) >= 0.93)}
    df = lambda ws: spark.createDataFrame([(w,) for w in ws], "w string")
    assert {r["w"] for r in names.near_spellings(df(tokens), df(pool)).collect()} == want


def test_masks_and_their_exceptions(spark):
    df = lambda ws, s="w string": spark.createDataFrame([w if isinstance(w, tuple) else (w,) for w in ws], s)
    listed = df([("nora", "exact"), ("will", "exact"), ("nk12", "id")], "w string, kind string")
    rows = [(1, "Will you ask Nora's friend nk12?"), (2, "We saw Will Nora there, will he go?"), (3, None), (4, ""), (5, "nothing of it"), (6, "Prof. Lindqvist left, Dr Zed too.")]
    out = names.mask_names(spark.createDataFrame(rows, "i long, t string"), "i", "t", listed, df(["pedro"]), df("will you ask friend we saw there he go nothing of it left too".split()))
    got = {r["id"]: (r["masked"], r["n"]) for r in out.collect()}
    assert got[1] == ("Will you ask [student]'s friend [student]?", 2) and got[2] == ("We saw [student] there, will he go?", 2)
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[5] == ("nothing of it", 0) and got[6] == ("Prof. [person] left, Dr [person] too.", 2)


def test_telephone_numbers_inside_other_numbers_stay(spark):
    rows = ["call 412-555-0199 now", "x1412-555-0199", "v3.412-555-01995", "(412) 555-0199 or +1 412 555 0199,", "412-555-0199.5"]
    got = [r["m"] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.mask_numbers_and_addresses(F.col("t")).alias("m")).collect()]
    phone = re.compile(r"(?<![\w.])(?:\+\d{1,3}[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]\d{4}(?![\w.])")
    assert got == [phone.sub("[number]", r) for r in rows]


def test_trimming_equals_a_loop(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + rng.choice(["", "", ".", "!", '."', ","]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "No end at all", "One. " * 30]

    def loop(t, words=12, chars=60, least=6):
        if len(t.split()) <= words and len(t) <= chars:
            return t
        kept = raw = ""
        for s in re.findall(r"[^.!?]+(?:[.!?]+[\"'”’)\]]*|$)\s*", t):
            raw += s
            if len(raw.split()) > words or len(raw.strip()) > chars:
                break
            kept = raw.strip()
        return kept if kept and kept[-1] in ".!?\"'”’)]" and len(kept.split()) >= least else None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", speech.trim_to_sentences(F.col("t"), 12, 60).alias("a"), speech.trim_to_cap(F.col("t"), 12, 60).alias("b")).collect()
    assert all(r["a"] == loop(r["t"]) and r["b"] == (loop(r["t"], least=1) or r["t"]) for r in rows)


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(2)
    xs = [2.675, 1.005, 0.125, 0.375, -0.125, -2.675, 1e15 + 0.3, 0.0, 1234567.885, *(rng.uniform(-1000, 1000) for _ in range(500)), *(k / 8 for k in range(-40, 40)), *(k / 1000 for k in range(0, 3000, 5))]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert all(r["y"] == round(r["x"], 2) for r in df.select("x", formats.round_exact(F.col("x"), 2).alias("y")).collect())


def test_best_pairs_of_each_chunk(spark):
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(5, 8)), rng.normal(size=(300, 8))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, [float("nan")] * 8)], "row_idx long, vector array<double>")
    whole = cosine_pairs(asked, held, block=2)
    assert whole.count() == 5 * 302
    few = {(r["qid"], r["row_idx"]): r["score"] for r in cosine_pairs(asked, held, k=4).collect()}
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    for i in range(5):
        for j in np.argsort(-s[i])[:4]:
            assert few[i, int(j)] == pytest.approx(s[i, j])
    assert cosine_pairs(asked.limit(0), held).count() == 0


def test_ranks_by_value_in_parts(spark):
    values = [round(random.Random(5).gauss(0, 3), 1) for _ in range(1)] + [float(v) for v in np.round(np.random.default_rng(5).normal(size=900), 1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["r"] for r in stats.ranks_by_value(df, "v", "r", parts=7).collect()}
    ordered = np.sort(values)
    assert all(got[v] == pytest.approx((np.searchsorted(ordered, v, "left") + np.searchsorted(ordered, v, "right") + 1) / 2) for v in set(values))


def test_highlights_of_a_narration():
    shown = [(w, float(y)) for y, line in enumerate(["gradient descent step", "loss step", "step size", "gradient noise", "step"]) for w in line.split()]
    said = lambda *sentences: [(w, n) for n, s in enumerate(sentences) for w in s.split()]
    assert recurrences.highlights(said("gradient descent step helps"), shown) == [(0, 0, 2)]  # the longest run, once
    assert recurrences.highlights(said("noise", "noise"), shown) == [(0, 8, 8)]  # a lit word does not fire again
    assert recurrences.highlights(said("step"), shown) == []  # too often on the slide
    assert recurrences.highlights(said("gradient", "descent"), shown) == [(0, 0, 0), (1, 1, 1)]  # no run across sentences
    assert recurrences.highlights(said("loss step gradient noise"), shown) == [(0, 3, 4), (2, 7, 8)]  # after the last place
    assert recurrences.highlights([], shown) == [] and recurrences.highlights(said("x"), []) == []


def test_highlights_are_runs_of_equal_words():
    rng = random.Random(0)
    for _ in range(200):
        shown = [(rng.choice(["aaaa", "bbbb", "cccc", "dd"]), float(rng.randrange(4))) for _ in range(rng.randrange(12))]
        said = [(rng.choice(["aaaa", "bbbb", "cccc", "dd"]), i // 5) for i in range(rng.randrange(15))]
        found, covered = recurrences.highlights(said, shown), -1
        assert len({(a, b) for _, a, b in found}) == len(found)
        for i, a, b in found:
            k = b - a + 1
            assert i > covered and [w for w, _ in said[i : i + k]] == [w for w, _ in shown[a : b + 1]] and len({n for _, n in said[i : i + k]}) == 1
            longest = max(next((n for n in range(k + 1, 0, -1) if [w for w, _ in shown[j : j + n]] == [w for w, _ in said[i : i + n]] and len(shown[j : j + n]) == n and len({s for _, s in said[i : i + n]}) == 1), 0) for j in range(len(shown)))
            assert longest == k
            covered = i + k - 1


def test_smoothing_by_known_values(spark):
    cases = {
        "Damn it, HELL no, hello": ("Darn it, HECK no, hello", 2), "an idiot and a stupid trash can": ("a silly person and an odd trash can", 2), "A Stupid day": ("An Odd day", 1),
        "trash, worthless": ("clutter, of little use", 2), "scummy": ("scummy", 0), "": ("", 0), None: (None, 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: (r["s"]["text"], r["s"]["n"]) for r in df.select("t", smoothing.smooth(F.col("t")).alias("s")).collect()} == cases
