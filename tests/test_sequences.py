"""Sorted passes, components and admission against loops."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import recurrences
from millrace.operators.admission import Quota, admit
from millrace.operators.graphs import components
from millrace.operators.scratch import Scratch
from millrace.operators.segments import emitted, segmented


def test_pass_over_keys_and_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, i long")

    def step(state, t):
        state.append(t)
        return len(state), state[0]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)  # keys go over many batches
    try:
        got = segmented(df, ["k"], ["t", "i"], ["t"], list, step, "n int, first long").collect()
        last = emitted(df, ["k"], ["t", "i"], ["t"], lambda: [0], lambda s, t: s.__setitem__(0, s[0] + t) or [], lambda s: [(s[0],)], "total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])
        want = sorted((t, i) for x, t, i in rows if x == k)
        assert [(r["t"], r["i"]) for r in mine] == want and {r["first"] for r in mine} == {want[0][0]}
    assert {r["k"]: r["total"] for r in last} == {k: sum(t for x, t, _ in rows if x == k) for k in {r[0] for r in rows}}
    assert segmented(df.limit(0), ["k"], ["t"], ["t"], list, step, "n int, first long").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long").select(F.col("u").cast(kind), F.col("v").cast(kind))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    name = str if kind == "string" else int
    for u, v in edges:
        if u != v:
            a, b = sorted((find(name(u)), find(name(v))))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in parent}


def brute_admit(rows, quotas):
    """rows: dicts with id, t, amount and keys, in order of time."""
    used, out = {}, {}
    for r in rows:
        t, a = r["t"], r["a"]
        if t is None or a is None or t != t or a < 0:
            out[r["id"]] = False
            continue
        wanted = [(i, tuple(r[c] for c in q.columns), t // q.window) for i, q in enumerate(quotas) if all(r[c] is not None for c in q.columns)]
        ok = all(used.get(w, 0) + a <= quotas[w[0]].cap for w in wanted)
        for w in wanted if ok else ():
            used[w] = used.get(w, 0) + a
        out[r["id"]] = ok
    return out


@pytest.mark.parametrize("seed, hot", [(3, False), (4, True)])
def test_admission(spark, seed, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        address = 1 if hot and rng.random() < 0.4 else rng.choice([None, *range(30)])
        rows.append({"id": i, "t": rng.choice([None, float("nan")]) if rng.random() < 0.01 else rng.random() * 200_000, "v": rng.choice([None, *range(60)]), "ad": address, "pool": rng.choice("xy"), "a": rng.choice([None, -1.0, *[1.0] * 30, *[4.0] * 10, 9.0])})
    quotas = [Quota(("v",), 3600.0, 2), Quota(("v",), 86400.0, 8), Quota(("ad",), 3600.0, 9), Quota(("ad",), 86400.0, 20), Quota(("pool",), 86400.0, 330 if hot else 10**6), Quota((), 86400.0, 10**6)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, t double, v int, ad int, pool string, a double").withColumns({"key": F.lit("x"), "allowed": F.lit(3)})
    got = {r["id"]: r["allowed"] for r in admit(df, "id", ["t", "id"], "t", quotas, "a").collect()}
    want = brute_admit(sorted(rows, key=lambda r: (r["t"] is None or r["t"] != r["t"], r["t"] or 0, r["id"])), quotas)
    assert got == want and 50 < sum(got.values()) < 850
    assert admit(df.limit(0), "id", ["t", "id"], "t", quotas, "a").count() == 0


def test_null_times_and_amounts(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 3.0), (2, 1, None, 3.0), (3, 1, 5.0, None), (4, 1, 6.0, 3.0)], "i long, k long, t double, a double")
    allowed = lambda out: [r["allowed"] for r in out.orderBy("i").collect()]
    assert allowed(recurrences.multi_window_admission(df, "k", ["t", "i"], "t", {60.0: 2})) == [True, False, True, False]
    assert allowed(recurrences.capped_counter(df, ["k"], ["i"], "a", 10.0)) == [True, True, False, True]
    assert allowed(recurrences.capped_counter(df, ["k"], ["t", "i"], "a", 10.0, "t", 100.0)) == [True, False, False, True]
    assert [r["repeat"] for r in recurrences.dedupe_alerts(df, ["k"], ["t", "i"], "t", 60.0).orderBy("i").collect()] == [False, False, True, True]


def test_duplicate_frames(spark):
    rng = random.Random(7)
    groups = {p: [q for q in range(12) if q % 4 == p % 4] if p % 4 < 3 else [p] for p in range(12)}
    rows = [(k, i, rng.choice([None, -1, *range(12)])) for k in range(5) for i in range(80)]
    df = spark.createDataFrame([(k, i, p, groups.get(p)) for k, i, p in rows], "k long, i long, page int, alike array<int>")
    got = {(r["k"], r["i"]): r["resolved"] for r in recurrences.resolve_duplicates(df, ["k"], ["i"], "page", "alike").collect()}
    last = {}
    for k, i, p in rows:
        want = p
        if p is not None and p >= 0:
            ref = last.get(k, p)
            want = min(groups[p], key=lambda g: (abs(g - ref - 0.5), g)) if len(groups[p]) > 1 else p
            last[k] = want
        assert got[k, i] == want


def test_spans(spark):
    rows = [(0.0, True, False), (5.0, False, False), (6.0, False, True), (7.0, False, False), (8.0, True, True), (9.0, False, False), (90.0, True, False), (91.0, False, False), (None, True, None)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k long, i long, t double, o boolean, c boolean")
    got = [r["inside"] for r in recurrences.mark_spans(df, ["k"], ["i"], "t", "o", "c", 60.0).orderBy("i").collect()]
    # The span from 8.0 on goes on after its own closing word; the row at 90.0 ends it and opens none.
    assert got == [True, True, True, False, True, True, False, False, False]


def test_word_places(spark):
    text = "The k-means cat sat, then the cat ran. " + "x " * 60 + "far"
    said = ["The", "k-means,", None, "dog", "cat", "cat", " ", "far", "ran"]
    df = spark.createDataFrame([(1, i, text, float(10 - i) if i < 2 else float(i), w) for i, w in enumerate(said)], "k long, i long, text string, t double, w string")
    got = [(r["seconds"], r["place"]) for r in recurrences.word_places(df, ["k"], ["i"], "text", "t", "w").orderBy("place").collect()]
    assert got == [(10.0, 0), (10.0, 4), (10.0, 12), (10.0, 30), (10.0, 34)]
    once = recurrences.word_places(df.withColumn("text", F.when(F.col("i") == 0, F.col("text"))), ["k"], ["i"], "text", "t", "w")
    assert [(r["seconds"], r["place"]) for r in once.orderBy("place").collect()] == got
    assert "Window" not in once._jdf.queryExecution().toString()  # no text is sorted beside each of its words


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_word_diff_bounds_what_a_worker_holds(spark):
    """A batch of many parts makes no objects that outlive their text."""
    import tracemalloc

    import pyarrow as pa

    text = lambda i: " ".join(f"{'abc'[(i + k) % 3]}{k}" for k in range(150))
    recurrences.word_diff(F.lit("a"), F.lit("b"))
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert int(most.rstrip("b")) <= 8 << 20
    a, b = (pa.array([text(i + s) for i in range(300)]) for s in (0, 1))
    tracemalloc.start()
    parts = recurrences.parts_of(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) == 300 and len(parts.flatten()) > 40_000 and peak < 2 << 20


def test_word_diff(spark):
    assert recurrences.diff_parts("a b c", "a x c") == [("=", "a "), ("-", "b"), ("+", "x"), ("=", " c")]
    assert recurrences.diff_parts("", "") == [] and recurrences.diff_parts("", "a") == [("+", "a")]
    assert recurrences.diff_parts("a\nb\nc\n", "a\nz\nc\n", most=9) == [("=", "a\n"), ("-", "b\n"), ("+", "z\n"), ("=", "c\n")]
    assert recurrences.diff_parts("a\nb\nc", "d\ne\nf", most=1) == [("-", "a\nb\nc"), ("+", "d\ne\nf")]
    rng = random.Random(8)
    text = lambda: "".join(rng.choice(["a", "b", "c", "dd"]) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 25)))
    pairs = [(text(), text()) for _ in range(60)] + [(None, "x"), ("same", "same")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", recurrences.word_diff(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        a, b, parts = r["a"] or "", r["b"] or "", [(p["op"], p["text"]) for p in r["p"]]
        joined = lambda ops: "".join(t for op, t in parts if op in ops)  # noqa: B023, E731
        assert joined("=+") == b and joined("=-") == a
        import re

        kept = sum(len(re.findall(r"\s+|\S+", t)) for op, t in parts if op == "=")
        assert kept == longest(*(re.findall(r"\s+|\S+", x) for x in (a, b)))


def test_word_diff_of_long_texts_is_by_words(spark):
    """However long two texts are, no word that both have in order is lost, and what is held stays small."""
    import tracemalloc

    a = " ".join(f"w{i % 700}" for i in range(2500))
    words = a.split(" ")
    words[7], words[900:902], words[2100] = "x", [], "y z"
    b = "v " + " ".join(words)
    tracemalloc.start()
    parts = recurrences.diff_parts(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [p for p in parts if p[0] != "="] == [("+", "v "), ("-", "w7"), ("+", "x"), ("-", "w200 w201 "), ("-", "w2"), ("+", "y z")]
    assert "".join(t for op, t in parts if op in "=+") == b and "".join(t for op, t in parts if op in "=-") == a
    assert peak < 12 << 20
    other = " ".join(f"w{i * 37 % 701}" for i in range(2500))
    kept = sum(len(t.replace(" ", " x ").split()) for op, t in recurrences.diff_parts(a, other) if op == "=")
    assert kept > 2500
    row = spark.createDataFrame([(a, b)], "a string, b string").select(recurrences.word_diff(F.col("a"), F.col("b")).alias("p")).first()
    assert [tuple(p) for p in row["p"]] == parts


@pytest.mark.parametrize("held", [1, 40, 1 << 22])
def test_word_diff_is_that_of_the_whole_table(monkeypatch, held):
    """Rows that are kept, made again or made in one block give the same runs: removals before additions."""
    import re

    monkeypatch.setattr(recurrences, "TABLE_BYTES", held)

    def slow(a, b):
        n, m = len(a), len(b)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < n or j < m:
            if i < n and j < m and a[i] == b[j]:
                out.append(("=", a[i]))
                i, j = i + 1, j + 1
            elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
                out.append(("-", a[i]))
                i += 1
            else:
                out.append(("+", b[j]))
                j += 1
        return out

    rng = random.Random(held)
    for _ in range(150):
        a, b = (["^", *(rng.choice("abcdef") for _ in range(rng.randint(0, 70)))] for _ in range(2))
        a, b = a + ["x"], b + ["y"]  # nothing to cut at the ends but the first
        tokens = lambda ts: " ".join(ts)
        want = slow(*(re.findall(r"\s+|\S+", tokens(t)) for t in (a, b)))
        runs = []
        for op, t in want:
            runs = [*runs[:-1], (op, runs[-1][1] + t)] if runs and runs[-1][0] == op else [*runs, (op, t)]
        assert recurrences.diff_parts(tokens(a), tokens(b)) == runs


def test_pairs_of_a_small_table_are_dealt_out(spark):
    """Both sides are dealt by number, or the file of a small table would be compared in one task."""
    from millrace.plans import stream_queries
    from tests.conftest import SMALL

    plan = stream_queries.r01_word_diff(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_admission_passes_flat_counters(spark, monkeypatch):
    from millrace.operators import admission

    seen, segmented = [], admission.segmented
    monkeypatch.setattr(admission, "segmented", lambda df, *rest: seen.append(dict(df.dtypes)) or segmented(df, *rest))
    rows = [(1, 0.0, "a", "x"), (2, 9.5, "a", None), (3, 9.9, "b", "x"), (4, 10.0, "a", "x"), (5, 10.0, "c", "x"), (6, None, "a", "x")]
    asked = spark.createDataFrame(rows, "i long, t double, who string, place string")
    quotas = [admission.Quota(("who",), 10.0, 1), admission.Quota(("place",), 20.0, 2)]
    got = admission.admit(asked, "i", ["t", "i"], "t", quotas)
    assert {r["i"]: r["allowed"] for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    assert not any("struct" in kind for kind in seen[0].values())
