"""The pipeline's stages on the smallest tables, each against what its input says."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, queries
from millrace.llm.decontaminate import item_windows, words_of
from tests.conftest import SMALL, rows_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    got, want = queries.queries()[name](spark, SMALL).toPandas(), duck.execute(queries.oracle_sql()[name]).fetch_df()
    assert rows_of(got) == rows_of(want)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "mixture"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == COLUMNS
        held[name] = (docs, out.cache())
        docs = out
    before, after = held["language"]
    assert after.count() == before.filter(F.regexp_like("text", F.lit(r"\p{L}"))).count()
    before, after = held["near_duplicates"]
    assert 0 < after.count() <= before.count()
    before, after = held["benchmark"]
    windows = {w for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() for w in item_windows(words_of(r["text"]), 10)}
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    clean = {r["doc_id"]: r["text"] for r in before.collect() if not item_windows(words_of(r["text"]), 10) & windows}
    assert all(texts[i] == t for i, t in clean.items())
    left = [i for i, t in texts.items() if len(words_of(t)) >= 10 and item_windows(words_of(t), 10) & windows]
    assert not left
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert mixed.columns == [*COLUMNS, "copy", "mix_key"] and {r["doc_id"] for r in mixed.collect()} <= set(texts)


def test_a_text_passes_python_once(spark):
    docs, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    held = {
        "lines": corpus_pipeline.drop_repeated_lines(spark, docs, SMALL),
        "benchmark": corpus_pipeline.remove_benchmark_passages(spark, docs, SMALL),
        "benchmark by join": decontaminate.decontaminate(docs, benchmark, max_windows=0),
    }
    for name, out in held.items():  # the filters on what Python returns must not call it again
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1, name


def test_run_and_edges(spark, tmp_path):
    rng = random.Random(0)
    text = lambda: "\n".join(" ".join("".join(rng.choice("aeioulnt") for _ in range(5)) for _ in range(12)) for _ in range(4))
    copies = text()
    rows = [(i, text(), "en", "a", None, "x") for i in range(20)] + [(30, copies, "en", None, 1, "x"), (31, copies, None, "b", 1, "x"), (31, copies, None, "b", 1, "x")]
    rows += [(40, None, "en", "a", None, "x"), (41, "", "en", "a", 0, "x"), (42, "123", "de", "a", 3, "x"), (None, text(), "en", "a", 5, "x")]
    long = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(150_000))
    rows += [(50, long, "de", "a", len(long), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, "never there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {*range(20), 30, 50, None}
    kept = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.filter("doc_id = 50").first()["text"] == long, name  # read whole, left whole
        assert kept.filter("doc_id = 31").count() == (2 if name == "language" else 0), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
