"""Replies of judges: what is wrong with them, and what they say."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import replies

FINE = {"scores": {"style": 4, "depth": "2.5", "scope": None}, "verdict": " PASS", "rationale": "good\n work", "issues": ["a  b", None, ""]}


def _read(spark, reply):
    frame = spark.createDataFrame([(reply,)], "reply string")
    return frame.select(replies.judgement(F.col("reply"), ["style", "depth", "scope"]).alias("r")).first()["r"].asDict(recursive=True)


def test_a_whole_reply(spark):
    want = {"problem": None, "scores": {"style": 4, "depth": 2, "scope": None}, "verdict": "pass", "rationale": "good work", "issues": ["a b", ""]}
    text = json.dumps(FINE)
    for reply in (text, f"```json\n{text}\n```", f"Here it is: {text} Done."):
        assert _read(spark, reply) == want


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"scores": 3}, "reply has no scores object"), ({"scores": {"style": "high"}}, "score style is not a number"), ({"scores": {"style": "4d"}}, "score style is not a number"),
        ({"scores": {"style": [4]}}, "score style is not a number"), ({"scores": {"depth": 0}}, "score depth is outside 1 to 5"), ({"scores": {"depth": 5.5}}, "score depth is outside 1 to 5"),
        ({"scores": {"depth": False}}, "score depth is outside 1 to 5"), ({"verdict": "maybe"}, "verdict must be pass or fail"), ({"verdict": None}, "verdict must be pass or fail"),
    ],
)
def test_what_is_wrong(spark, change, problem):
    assert _read(spark, json.dumps(FINE | change)) == {"problem": problem, "scores": None, "verdict": None, "rationale": None, "issues": None}


@pytest.mark.parametrize("reply", [None, "", "no braces", '{"scores": {"style": 4}, "verdict": "pass"', "{'scores': 1}"])
def test_no_json(spark, reply):
    assert _read(spark, reply)["problem"] == "reply is not JSON"


def test_bounds(spark):
    got = _read(spark, json.dumps({"scores": {"style": True, "depth": 4.5}, "verdict": "fail", "rationale": "x" * 601, "issues": ["y" * 201] * 9}))
    assert got["scores"] == {"style": 1, "depth": 4, "scope": None}
    assert got["rationale"] == "x" * 599 + "…" and got["issues"] == ["y" * 199 + "…"] * 8
    assert _read(spark, json.dumps({"scores": {}, "verdict": "fail", "issues": "only one"}))["issues"] == ["only one"]
    assert _read(spark, json.dumps({"scores": {}, "verdict": "fail"}))["issues"] == []


def test_records_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from millrace.functions import replies

    line = '{"question": "What is it?", "category": "view", "month": "2026-01", "type": "concept", "expected_slides": ["70445-s06-001"], "must_not": [%s]}'
    df = spark.createDataFrame([(line % '"no"',), (line % '"12345678"',), (line % "null",), ("[",), (None,)], "t string")
    told = df.select(replies.record_problem(F.col("t"), ["VIEW"], ["concept"]).alias("p"))
    assert [r["p"] for r in told.collect()] == [None, "must_not leaks", None, "question is empty", "not a JSON object"]
    assert told._jdf.queryExecution().analyzed().toString().count("from_json") == 1
