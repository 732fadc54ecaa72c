"""Readers on files written here, and streams against their batch twins."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import recurrences
from millrace.sources import readers
from millrace.streaming import jobs


def put(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_index_both_shapes(spark, tmp_path):
    records = [{"id": "1-s01-001", "kind": "slide", "session": 1, "related_code": ["c1"]}, {"id": "c1", "kind": "code", "source": "x = 1"}]
    a, b = put(tmp_path / "a.json", json.dumps(records)), put(tmp_path / "b.json", json.dumps({"records": records}))
    for path in (a, b):
        assert [r["id"] for r in readers.read_index(spark, path).orderBy("row_idx").collect()] == ["1-s01-001", "c1"]
    with pytest.raises(ValueError, match="2 records but 1 vectors"):
        readers.read_index(spark, a, spark.createDataFrame([(0, [1.0])], "row_idx int, vector array<double>"))


def test_optional_and_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert readers.optional(spark, str(tmp_path / "none.json"), schema).count() == 0
    path = put(tmp_path / "x.jsonl", '{"a": 1}\nnot json\n\n{"a": 2}\n')
    good, bad = readers.read_jsonl(spark, path, schema, strict=False)
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["line"] for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, path, schema)[0].collect()


def test_vtt(spark, tmp_path):
    path = put(tmp_path / "a.vtt", "WEBVTT\r\n\r\n1\r\n00:00:01.000 --> 00:00:02.500\r\n<v A>Hello\r\nthere\r\n\r\n01:02.000 --> 01:03.250\nAnn Lee: Bye\n\nNOTE x\n")
    got = [(r["start"], r["end"], r["text"]) for r in readers.read_vtt(spark, path).orderBy("cue").collect()]
    assert got == [(1.0, 2.5, "Hello there"), (62.0, 63.25, "Bye")]


def test_roster(spark, tmp_path):
    path = put(tmp_path / "r.csv", 'Student Name,E-mail,Section\n"Lee, Ann",ANN@x.org,A\nBob van Dyk,,B\n')
    got = [(r["first"], r["last"], r["email"]) for r in readers.read_roster(spark, path).collect()]
    assert got == [("Ann", "Lee", "ann@x.org"), ("Bob van", "Dyk", None)]


def test_notebook_and_html(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": ["# Intro"]}, {"cell_type": "code", "source": ["x = 1\n", "y = 2"]}, {"cell_type": "code", "source": [" "]}]
    got = readers.read_notebooks(spark, put(tmp_path / "n.ipynb", json.dumps({"cells": cells}))).collect()
    assert [(r["cell"], r["source"], r["above"]) for r in got] == [(1, "x = 1\ny = 2", "# Intro")]
    assert readers.html_to_text("<p>A&amp;B<ul><li>one<li>two</ul><script>x</script>") == "A&B\n\n- one\n- two"
    page = "<table><tr><th>a<td>b &lt; c</table><a href='https://x.org/y'>out</a>, <a href='https://home/z'>in</a><a href=/q>here</a><iframe>no</iframe>"
    assert readers.html_to_text(page, "home") == "| a | b < c\nout (https://x.org/y), inhere"
    assert readers.html_to_text(None) == ""


def test_csv_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("ok", 2)], "a string, b int")
    readers.write_csv(df, str(tmp_path / "out"))
    assert sorted(r["a"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()) == ["'=1+1", "ok"]
    root = str(tmp_path / "snap")
    first = readers.write_snapshot(df, root, "b", "a")
    assert readers.write_snapshot(df, root, "b", "a") == first
    assert spark.read.parquet(f"{root}/version={first}").count() == 2


@pytest.fixture
def event_files(spark, tmp_path):
    rows = [(i, i % 3, (i * 37 % 23) * 600.0, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, k long, t double, a double").orderBy("i")
    for n in range(3):
        df.filter((F.col("i") >= n * 20) & (F.col("i") < n * 20 + 20)).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    return df, stream, tmp_path


def counted(spark, work, files, late="0 seconds"):
    """The stream over what is in ``files``, from its checkpoint on."""
    schema = "i long, k long, ts timestamp, a double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(files)
    return jobs.run_to_end(jobs.capped_counter(stream, "k", ["i"], "ts", "a", 8.0, 3600.0, late), str(work / "o"), str(work / "c"))


def test_counters_expire_and_go_on_from_a_checkpoint(spark, tmp_path):
    files = str(tmp_path / "in")
    at = lambda minutes: F.timestamp_seconds(F.lit(10**9) + minutes * 60)
    rows = [[(1, 1, 0.0, 5.0), (2, 1, 10.0, 4.0), (3, 1, 20.0, 3.0), (4, 2, 30.0, 8.0), (5, 2, 31.0, None)], [(6, 1, 59.0, 1.0), (7, 1, 60.0, 8.0), (8, 2, 89.0, 1.0), (9, 2, 90.0, 1.0)], [(10, 3, 400.0, 1.0), (11, 1, 401.0, 8.5)]]
    out = None
    for n, part in enumerate(rows):
        df = spark.createDataFrame(part, "i long, k long, m double, a double").select("i", "k", at(F.col("m")).alias("ts"), "a")
        df.coalesce(1).write.parquet(f"{files}/{n}")
        out = counted(spark, tmp_path, files)  # each run starts from the checkpoint of the last one
    got = {r["i"]: (r["allowed"], r["count"]) for r in out.collect()}
    want = {1: (True, 5.0), 2: (False, 5.0), 3: (True, 8.0), 4: (True, 8.0), 5: (False, 8.0), 6: (False, 8.0), 7: (True, 8.0), 8: (False, 8.0), 9: (True, 1.0), 10: (True, 1.0), 11: (False, 0.0)}
    assert got == want
    batch = spark.createDataFrame([r for part in rows for r in part], "i long, k long, m double, a double").withColumn("s", F.col("m") * 60)
    twin = recurrences.capped_counter(batch, ["k"], ["s", "i"], "a", 8.0, "s", 3600.0)
    assert {r["i"]: (r["allowed"], r["count"]) for r in twin.collect()} == want
    state = spark.read.format("statestore").option("stateVarName", "counter").load(str(tmp_path / "c"))
    assert {r["key"]["k"] for r in state.collect()} <= {1, 3}  # the counters of key 2 have ended and are gone


def test_stream_dedupe_and_queue(spark, event_files):
    df, stream, work = event_files
    out = jobs.run_to_end(jobs.dedupe_alerts(stream, "k", "i", "t", 3600.0), str(work / "o2"), str(work / "c2"))
    assert out.count() == 60 and out.filter("NOT repeat").count() >= 3
    seen, rebuilt = [], []
    for _ in range(2):  # the second run finds nothing new
        jobs.work_queue(stream, str(work / "c3"), lambda b: seen.extend(r["i"] for r in b.collect()), lambda: rebuilt.append(1))
    assert sorted(seen) == list(range(60)) and len(rebuilt) == 3


def test_appends_leave_out_what_the_target_lacks(spark, event_files):
    _, stream, work = event_files
    held = []

    def put(df):
        if "a" in df.columns:
            raise ValueError("no column a")
        held.extend(df.columns for _ in range(df.count()))

    log = stream.withColumn("q", F.lit("mail me at a.b@c.org"))
    left_out = jobs.question_log(log, "q", str(work / "c4"), put, [["t"], ["a"]])
    assert left_out == 2 and held == [["i", "k", "q"]] * 60
    with pytest.raises(ValueError, match="no column a"):
        jobs.append_degrading(spark.range(1).withColumn("a", F.lit(1)), put, [])
