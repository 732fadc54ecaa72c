"""Near-duplicates, line deduplication, nearest neighbours, components and WARC against brute force."""

import gzip
import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, line_dedup, linking, minhash, warc
from millrace.llm.common import BLANK_WORD, Workspace, lower_ascii
from millrace.llm.components import connected


def union_find(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 50)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == union_find({x for e in edges for x in e}, edges)
    assert connected(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).count() == 0


def shingles(text, n):
    w = BLANK_WORD.findall(lower_ascii(text)) if text else []
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def edited(rng, words, share):
    return [rng.choice("uvwxyz") * rng.randint(1, 4) if rng.random() < share else w for w in words]


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for base in range(6):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(rng.choice((4, 7, 30, 120)))]
        rows += [" ".join(edited(rng, words, rng.choice((0, 0, 0.02, 0.05, 0.1)))) for _ in range(12)]
    return [*rows, None, "", "  \n", "one", "ONE", "one two", "x" * 50_000]


@pytest.mark.parametrize("n", [2, 5])
@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_minhash_equals_brute_force(spark, n, broadcast, monkeypatch):
    monkeypatch.setattr(linking.join_ids, "__defaults__", (broadcast,))
    rows = [(i * 3 % 101, t) for i, t in enumerate(near_copies(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_shingles": F.lit("x"), "kept": F.lit(1)})
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(sets, links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, shingle_words=n).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (want[i] == i) for i, s in sets.items())


def test_minhash_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    out = minhash.near_duplicates(df)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out.collect()) == [(0, 0, True), (0, 0, True), (3, 3, True), (5, 3, False), (9, 9, True)]
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 3, 9]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_one_of_each(df.limit(0)).count() == 0


def test_a_chain_without_a_centre_is_found(spark):
    """Neighbours are similar, the ends of the chain are not: no star covers it."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(20)]
    sets = {i: shingles(t, 2) for i, t in rows}
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]) > 100 * len(sets[0] & sets[6])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n, keep in ((12, 10), (400, 350)):
        same = []
        for _ in range(60):
            x = rng.integers(0, 2**64, n, np.uint64)
            y = np.concatenate((x[:keep], rng.integers(0, 2**64, n - keep, np.uint64)))
            a, b = linking.densify(linking.signatures([np.unique(x), np.unique(y)], 128))
            same.append((a == b).mean())
        assert np.mean(same) == pytest.approx(keep / (2 * n - keep), abs=0.06)
    assert (linking.densify(np.full((1, 8), linking.EMPTY)) == linking.EMPTY).all()


def test_empty_bins_take_the_first_filled_pick():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2**63, (40, 72), np.uint64)
    sig[rng.random(sig.shape) < rng.random((40, 1))] = linking.EMPTY
    sig[0], sig[1, 1:] = linking.EMPTY, linking.EMPTY
    picks = np.random.Generator(np.random.PCG64(72)).integers(0, 72, (4096, 72))
    want = sig.copy()
    for i, b in zip(*np.nonzero(sig == linking.EMPTY), strict=True):
        filled = sig[i, picks[:, b]] != linking.EMPTY
        if filled.any():
            want[i, b] = sig[i, picks[filled.argmax(), b]]
    assert (linking.densify(sig) == want).all()


def test_unlike_members_of_a_block_are_told_apart_by_their_bits(monkeypatch):
    """A bucket of 60 sets, 50 of them unlike all others and 10 alike: only the alike ones, and few besides,
    are compared hash by hash, and no pair that ``likeness`` would take is lost."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**32, n, np.uint32)) for n in rng.integers(200, 240, 50)]
    base = np.unique(rng.integers(0, 2**32, 400, np.uint32))
    sets += [np.unique(np.concatenate((base[:360], rng.choice(base, 20), rng.integers(0, 2**32, 8, np.uint32)))) for _ in range(10)]
    i, j = np.triu_indices(60, 1)
    for percent, whole in ((80, True), (80, False), (30, True), (30, False)):
        marks = np.full(60, whole)
        kept = linking.may_be_like(i, j, *linking.set_maps(sets), marks, percent)
        like = np.array([linking.likeness(sets[a], sets[b], whole, percent) > 0 for a, b in zip(i, j, strict=True)])
        assert not (like & ~kept).any() and kept.sum() <= like.sum() + 20
    calls, plain = [], linking.likeness
    monkeypatch.setattr(linking, "likeness", lambda *a: calls.append(1) or plain(*a))
    bands = np.zeros((60, 18), np.int64)
    bands[:, 0] = 64
    rows = {"id": range(60), "key": [64] * 60, "a": [0] * 60, "b": [0] * 60, "block": [0] * 60, "c": range(60), "n": [len(s) for s in sets]}
    rows |= {"low": [s.tobytes() for s in sets], "bands": [r.tobytes() for r in bands], "large": [1] * 60}
    out = list(linking._across(80, 1, 1024, False)(iter([pa.RecordBatch.from_pydict({k: list(v) for k, v in rows.items()})])))
    assert sum(b.num_rows for b in out) == 45 and len(calls) < 70


def test_line_sets_are_those_of_their_texts():
    lines = ["short", "", "12345678", "aaaaaaaaaaaaaaaa", "a line of some length", "ünïcödé line \u2028 of words", "x" * 250_000]
    for line, held in zip(lines, line_dedup.shingle_sets(lines), strict=True):
        assert len(held) == len(line_set(line)) and (np.diff(held.astype(object)) > 0).all()
    assert (line_dedup.shingle_sets(["ü" + lines[4], lines[4]])[1] == line_dedup.shingle_sets([lines[4]])[0]).all()


@pytest.mark.parametrize("least", [1, 2])
def test_buckets_of_two_count_with_larger_ones(spark, least):
    """1 and 2 are alike and share one bucket of four and one of two; 3, unlike them, is the weightiest; 8
    and 9 are alike and share two buckets of two, 10 and 11 only one."""
    rng = np.random.default_rng(6)
    draw = lambda: np.unique(rng.integers(0, 2**63, 40, np.uint64))
    sets = {i: draw() for i in range(1, 12)}
    sets[2], sets[9], sets[11] = sets[1], sets[8], sets[10]
    groups = [(1, 2, 3, 4), (1, 2), (3, 5, 6, 7), (3, 5, 6, 7), (8, 9), (8, 9), (10, 11)]
    keys = np.array([[(k + 1) << 8 | band for band, k in enumerate(range(7))]], np.int64).ravel()
    own = iter(range(10**6, 10**7))
    rows = np.array([[keys[b] if i in groups[b] else next(own) << 16 | b for b in range(7)] for i in sets], np.int64)
    packed = spark.createDataFrame(linking.local_stars(rows, np.array(list(sets), np.int64)), "part int, blob binary")
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "id long, s binary")
    out = linking.link(packed, lambda ids: frame.join(ids, "id"), 7, 80, Workspace(spark, "twos"), least=least)
    want = {1: 1, 2: 1, 8: 8, 9: 8} | ({10: 10, 11: 10} if least == 1 else {})
    assert {r["node"]: r["component"] for r in out.collect()} == want


def test_small_blocks_give_the_same_groups(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(near_copies(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, shingle_words=2).collect()}
    monkeypatch.setattr(linking, "BLOCK", 3)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, shingle_words=2).collect()} == want


# Lines


def line_set(x):
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lines_equal_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    monkeypatch.setattr(line_dedup, "CHUNK_CHARS", 2000)
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdefghij ") for _ in range(rng.choice((5, 30, 90, 300)))) for _ in range(12)]

    def line():
        x = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2))):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        return rng.choice(("", "  ")) + "".join(x) + rng.choice(("", "\r", " "))

    rows = [(i, "\n".join(rng.choice((line(), line(), "", " ")) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    rows[0] = (0, f"a first line of its own, long enough\n{rows[0][1]}")
    rows += [(100, None), (101, ""), (102, rows[0][1]), (None, rows[1][1]), (103, "z" * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text"), "no": F.lit("x"), "rk": F.lit(1)})
    blanks = " \t\r\x0b\f"
    places = sorted(((-1 if i is None else i), k, x.strip(blanks)) for i, t in rows if t for k, x in enumerate(t.split("\n")) if x.strip(blanks))
    kinds = sorted({x for *_, x in places})
    sets = {x: line_set(x) for x in kinds}
    links = [(a, b) for a, b in combinations(kinds, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = union_find(kinds, links)
    first = {}
    for i, k, x in places:
        first.setdefault(group[x], (i, k))
    gone = {(i, k) for i, k, x in places if first[group[x]] != (i, k)}
    out = line_dedup.dedup_lines(df, counts=True)
    assert out.columns == [*df.columns, "__n_lines", "__n_removed"]
    for r in out.collect():
        i, t = r["doc_id"], dict(rows)[r["doc_id"]]
        want = t if not t else "\n".join(x for k, x in enumerate(t.split("\n")) if (-1 if i is None else i, k) not in gone)
        assert r["text"] == want and (want is None or r["n_chars"] == len(want))
    left = line_dedup.dedup_lines(df, drop_emptied=True)
    assert left.columns == df.columns and left.filter("doc_id IN (100, 101)").count() == 2 and left.filter("doc_id = 102").count() == 0
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_keys_from_sets_and_texts_agree():
    lines = ["short", "a line of some length, with words", "é" * 30, "x" * 5000]
    from_sets = linking.band_keys(linking.densify(linking.signatures(line_dedup.shingle_sets(lines), line_dedup.BANDS * line_dedup.ROWS)), line_dedup.BANDS)
    assert (line_dedup.line_bands(lines) == from_sets).all()


def test_lines_at_the_threshold_are_found(spark):
    """Isolated pairs of similarity 0.804: 10 bands of which two must agree miss one in about 130."""
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    pairs = [(x, x[:-21] + draw(21)) for x in (draw(200) for _ in range(2000))]
    rows = [(i, "\n".join(p[k] for p in pairs[j : j + 50])) for i, (k, j) in enumerate((k, j) for k in (0, 1) for j in range(0, 2000, 50))]
    near = sum(100 * len(line_set(a) & line_set(b)) >= 80 * len(line_set(a) | line_set(b)) for a, b in pairs)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True)
    assert near > 1900 and near - 2 <= out.agg(F.sum("__n_removed")).first()[0] <= near


# Nearest neighbours


def test_ann_recall_and_edges(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_POINTS", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] + [1.0] * 15), (2400, [float("inf")] * 16), (None, [1.0] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = {}
    for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 50))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q]) ** 2).sum(axis=1))
        want = sorted((i for i in range(900) if i != q), key=lambda i: (d[i], i))[:10]
        hits += len({i for i, _ in found} & set(want))
        assert len(found) == 10 and all(s == pytest.approx(d[i], abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda f: (f[1], f[0]))
    assert hits / (10 * len(got)) >= 0.97
    assert [i for i, _ in got[50]] == list(range(51, 61))  # copies: ties to the smaller ids
    few = ann.nearest(df.filter("vec_id IN (1, 2, 50)"), F.col("id") % 50 == 0).collect()
    assert len(few) == 2 and ann.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["offset", "huge", "tiny", "clusters", "mixed"])
def test_ann_on_hard_scales(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "SHARD_POINTS", 400)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 24))
    if kind == "offset":
        x += 1e4
    elif kind == "huge":
        x *= 1e20
    elif kind == "tiny":
        x *= 1e-30
    elif kind == "clusters":
        x[::2] += 1e7
    else:
        x *= 10.0 ** rng.integers(-6, 7, (1200, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("id") % 40 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1200, 40):
        gap = np.abs(x - x[q])
        top = gap.max()
        d = top * np.sqrt(((gap / top) ** 2).sum(axis=1))
        want = sorted((i for i in range(1200) if i != q), key=lambda i: (d[i], i))[:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(d[i], rel=1e-9) for i, s in got[q])
        hits += len({i for i, _ in got[q]} & set(want))
    assert hits / 300 >= 0.95


def test_ann_ids_with_several_vectors(spark):
    rows = [(1, [0.0, 1.0]), (1, [9.0, 9.0]), (2, [0.0, 2.0]), (2, [8.0, 9.0]), (3, [5.0, 5.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 1).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1.0), (3, pytest.approx(32**0.5))]


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "long text " * 20 + "</p>"
    rows = [(7, "http://a/é b", big), (3, "http://b", big), (9, None, big), (3, "http://b", big), (4, "http://c", "short"), (5, "http://d", "short"), (6, "http://e", None), (8, "http://f", ""), (None, "http://g", big)]
    rows += [(100 + i, f"http://h/{i}", f"<p>{'x' * 2000}{i}</p>" + "é" * 500) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = []
    for run in ("a", "b"):
        root = f"file://{tmp_path}/{run}"
        manifest = warc.write_archives(pages, root, roll_bytes=1500)
        got.append(sorted((r["file"], r["sha256"], r["records"]) for r in manifest.collect()))
        assert len(got[-1]) > 3 and sum(n for *_, n in got[-1]) == len(rows)
    assert got[0] == got[1]  # equal bytes
    out = [r.asDict() for r in warc.read_archives(spark, root, manifest, with_payload=True).collect()]
    assert len(out) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in out if (r["page_id"] or 0) < 100)
    assert kinds == [(0, "response", None), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 3), (8, "response", None), (9, "revisit", 3)]
    text = {i: (h or "").encode() for i, _, h in rows}
    for r in out:
        assert r["payload_digest"] == hashlib.sha256(text[r["page_id"]]).hexdigest() and r["payload_bytes"] == len(text[r["page_id"]])
        assert r["payload"] is None or bytes(r["payload"]) == text[r["page_id"]]
    name = got[1][0][0]
    assert gzip.decompress((tmp_path / "b" / name).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and warc.read_archives(spark, f"file://{tmp_path}/e", empty).count() == 0
    cut = tmp_path / "b" / name
    cut.write_bytes(cut.read_bytes()[:-5])
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, root, manifest).count()


def test_warc_ranges_follow_from_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 40) for i in range(64)], "page_id long, url string, html string")
    few = warc.write_archives(pages, f"file://{tmp_path}/few").count()
    many = warc.write_archives(pages, f"file://{tmp_path}/many", range_bytes=1000)
    assert few <= int(spark.conf.get("spark.sql.shuffle.partitions")) < many.count()
    out = warc.read_archives(spark, f"file://{tmp_path}/many", many)
    assert sorted(r["page_id"] for r in out.collect()) == list(range(64))
