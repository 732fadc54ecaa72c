"""Fingerprints, the Merkle manifest and lexical search against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical, merkle, queries, sketches
from tests.conftest import SMALL

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE = re.compile(rf"(?:[^\s]+[ \t]*){{1,{sketches.RUN_WORDS}}}", re.A)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(text):
    return {re.sub(r"[ \t]+$", "", m.group()) for m in PIECE.finditer(text)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(rows, got):
    """rows: (id, text) in order; got: result rows in the same order."""
    texts = [t or "" for _, t in rows]
    prints = {}
    for i, (text, r) in enumerate(zip(texts, got, strict=True)):
        follower = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + follower[: len(text) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert r["near_edited"] == pytest.approx(jaccard(pieces(text), pieces(edited)), abs=1e-12)
        assert r["near_next"] == pytest.approx(jaccard(pieces(text), pieces(follower)), abs=1e-12)
        for t, fp in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(t, fp) == fp
    return prints


def test_fingerprint_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    out = queries.op11_fingerprints(spark, SMALL)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    prints = check_fingerprints(rows, sorted(out.collect(), key=lambda r: r["doc_id"]))
    assert len(set(prints.values())) >= 0.99 * len({frozenset(pieces(t)) for t in prints})


def fingerprints(df):
    pairs = sketches.edited_pairs(df)
    out = sketches.compare_versions(pairs, "text", {"edited": "near_edited", "next": "near_next"})
    return out.withColumns({"n_chars": F.length("text"), "edited_sha256": F.sha2("edited", 256), "fingerprint": F.col("fp_text"), "edited_fingerprint": F.col("fp_edited")})


def test_fingerprints_of_odd_rows(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(6))
    long = "\n".join(f"line {i} of a very long text" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "\n".join(line() for _ in range(40))), (5, long), (6, long + "\none more"), (8, "é😀 ü" * 50), (9, "x"), (12, "same"), (13, "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, __keys string, slice int")
    check_fingerprints(rows, sorted(fingerprints(df).collect(), key=lambda r: r["id"]))
    assert fingerprints(df.limit(0)).count() == 0
    alone = fingerprints(df.filter("doc_id = 4")).collect()
    check_fingerprints([rows[3]], alone)


def test_next_rows_where_ids_repeat_or_are_null(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 7, 7, 7, *range(40)]), f"text {i}") for i in range(400)] + [(3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = sorted((str(a[0]), a[1], order[(i + 1) % len(order)][1]) for i, a in enumerate(order))
    got = sorted((str(r["id"]), r["text"], r["next"]) for r in sketches.with_next(df).collect())
    assert got == want


def test_peeling_recovers_or_fails(spark):
    rng = random.Random(7)
    keys = [rng.getrandbits(63) for _ in range(600)]
    cases = [(keys[:n], keys[n - shared : 2 * n - shared]) for n, shared in ((0, 0), (1, 0), (1, 1), (5, 2), (9, 0), (60, 57), (120, 30), (300, 0))]
    df = spark.createDataFrame(cases, "a array<long>, b array<long>")
    cells = df.select("*", sketches.sketch(F.col("a")).alias("ca"), sketches.sketch(F.col("b")).alias("cb"))
    out = cells.select("a", "b", sketches.peel(sketches.subtract(F.col("ca"), F.col("cb")), F.lit(0)).alias("p"), sketches.differing(F.col("a"), F.col("b"), F.col("ca"), F.col("cb")).alias("d")).collect()
    for r in out:
        n = len(set(r["a"]) ^ set(r["b"]))
        assert r["d"] == n  # retried until all came out
        assert not r["p"]["ok"] or r["p"]["d"] == n
    assert not all(r["p"]["ok"] for r in out) and any(r["p"]["ok"] for r in out)


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); id -> (leaf, subroot, root, proof, folded, verified)."""
    of = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def up(nodes):
        """Root of a list and, for each, its steps (siblings before, after)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            runs = [level[i : i + 8] for i in range(0, len(level), 8)]
            for i, p in enumerate(at):
                run, s = runs[p // 8], p % 8
                paths[i].append(("".join(run[:s]), "".join(run[s + 1 :])))
            level, at = [sha("".join(r)) for r in runs], [p // 8 for p in at]
        return level[0], paths

    leaf = lambda r: sha("".join(map(of, r)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    if not rows:
        return []
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        held[g] = up([leaf(r) for r in groups[g]])
    root, tops = up([held[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for r, path in zip(groups[g], held[g][1], strict=True):
            steps = path + top
            text = r[4].translate(str.maketrans(UP, LOW)) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
            h = leaf((*r[:4], text))
            for before, after in steps:
                h = sha(before + h + after)
            out.append((str(r[0]), leaf(r), held[g][0], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out)


@pytest.mark.parametrize("case", ["many", "one", "group of one", "nine groups", "empty"])
def test_manifest(spark, tmp_path, case):
    rng = random.Random(8)
    row = lambda i, lang: (i, rng.choice([None, "s", ""]), lang, rng.choice([None, 3]), rng.choice([None, "", "Text É", "text", "AB" * 500]))
    rows = {
        "many": [row(rng.choice([None, i, 7]), rng.choice(["en", "en", None, "", "é"])) for i in range(700)],
        "one": [row(5, "en")],
        "group of one": [row(i, "de") for i in range(65)] + [row(999, "en"), row(1000, None)],
        "nine groups": [row(i, f"l{i % 9}") for i in range(30)] + [(1, "s", "l1", 1, "t")] * 3,
        "empty": [],
    }[case]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.select(*df.columns, F.lit("x").alias("hash"), F.lit(1).alias("place"), F.lit(1).alias("__at"))
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_merkle(spark, str(tmp_path))
    got = sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in out.collect())
    if case == "many":  # ids repeat: rows equal in all fields may change places, with them their proofs
        drop = lambda rs: sorted((*r[:4], r[6]) for r in rs)
        got, want = drop(got), drop(brute_manifest(rows))
    else:
        want = brute_manifest(rows)
    assert got == want


def brute_rank(docs, items, k=10):
    terms = lambda t: lexical.TERM.findall((t or "").translate(str.maketrans(UP, LOW)))
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in held:
            score = sum(lexical.weight(n_docs, df[t]) * lexical.impact(w.count(t), len(w), n_docs, total) for t in terms(text) if t in w)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("shape", [{}, {"shard": 50, "few": 0, "block": 40}])
def test_rank(spark, monkeypatch, shape):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["É", "É", "ß9", "the", "the", "the", "A1"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30, 80]))) for i in range(150)] + [(None, "the w1 w2"), (7, "w1 w2"), (7, "w1 w2"), (200, None), (201, "--"), (202, "rare " * 3000)]
    items = [(i, text(rng.choice([0, 1, 3, 20]))) for i in range(25)] + [(3, "the the w1"), (None, "w1 w5"), (50, None), (51, "nowhere"), (52, "rare the")]
    if shape:
        monkeypatch.setattr(lexical, "SHARD_POSTINGS", shape["shard"])
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, id string, rank int").repartition(3)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, score int")
    got = sorted(repr(tuple(r)) for r in lexical.rank(d, b, block_terms=shape.get("block", lexical.BLOCK_TERMS)).collect())
    assert got == brute_rank(docs, items)
    assert lexical.rank(d.limit(0), b).count() == 0 and lexical.rank(d, b.limit(0)).count() == 0


def test_walk_ends_early_and_is_exact():
    rng = np.random.default_rng(10)
    docs, terms = 3000, 12
    dense = rng.random((docs, terms)) < 0.3
    doc, term = np.nonzero(dense)
    parts = rng.integers(1, 400, len(doc)) ** 2
    shard = lexical.Shard(np.arange(docs), parts, doc, term, terms)
    weights = rng.integers(0, 900, terms)
    full = np.zeros(docs, np.int64)
    np.add.at(full, doc, parts * weights[term])
    for few in (0, 54):
        ids, scores = shard.best(np.arange(terms), weights, 10, few)
        order = np.lexsort((np.arange(docs), -full))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
