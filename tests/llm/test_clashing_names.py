"""Columns of the input that bear an operator's own names, and rows that share an id."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, line_dedup, minhash, mixing


def words(rng, n):
    return " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(6)) for _ in range(n))


@pytest.fixture
def docs(spark):
    rng = random.Random(11)
    shared = words(rng, 15)
    rows = [(i, words(rng, 40) + ("\n" + shared if i % 3 == 0 else ""), "en" if i % 2 else "de", f"s{i % 4}") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["src", "rate", "draws", "times", "chunk", "__rate", "__n", "__u", "__chunk", "__lang", "__report", "__doc", "__rk", "__gone", "__new", "__id", "__h", "__clash", "id", "t", "n", "k"]
    return df.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in names))


@pytest.mark.parametrize("stage", ["mixing", "language", "lines", "near", "benchmark"])
def test_extra_columns_pass_through(spark, docs, stage):
    bench = spark.createDataFrame([(1, docs.first()["text"])], "item_id long, text string")
    out = {
        "mixing": lambda: mixing.mix(docs),
        "language": lambda: langid.keep_identified(docs, langid.fit(docs)),
        "lines": lambda: line_dedup.dedup_lines(docs),
        "near": lambda: minhash.keep_one_of_each(docs),
        "benchmark": lambda: decontaminate.decontaminate(docs, bench),
    }[stage]()
    held = {r["doc_id"]: r.asDict() for r in docs.collect()}
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and rows
    assert all(r[c] == held[r["doc_id"]][c] for r in rows for c in extra)


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, c), (3, b), (4, c), (5, words(rng, 60)), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in minhash.keep_one_of_each(df).collect())
    want = sorted([("1", a), ("3", b), ("2", c), ("5", rows[6][1]), ("None", a)])
    assert got == want
