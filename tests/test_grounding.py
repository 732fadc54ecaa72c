"""Stems rule by rule, and problems of narrations."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import grounding

LIGHT = {
    "embeddings": "embed", "embedding": "embed", "embed": "embed", "categories": "category", "classes": "class", "images": "imag", "image": "imag", "class": "class", "focus": "focus", "axis": "axis",
    "taking": "tak", "take": "tak", "takes": "tak", "mapping": "map", "titled": "titl", "title": "titl", "running": "run", "called": "call", "passing": "pass", "applied": "apply", "multiplied": "multiply",
    "told": "tell", "brought": "bring", "written": "writ", "hundred": "hundred", "exceed": "exce", "quickly": "quick", "only": "only", "model's": "model", "'quoted-": "quot", "lenses": "lens", "goes": "goe", "ties": "tie", "bed": "bed",
}
LIGHT["exceed"] = "exceed"
ROUGH = {"retrieve": "retriev", "retrieval": "retriev", "retrieving": "retriev", "families": "family", "relational": "relation", "computational": "comput", "cats": "cats", "layers": "layer", "models": "model"}


def test_light_stems(spark):
    got = {r["w"]: r["stem"] for r in grounding.with_stem(spark.createDataFrame([(w,) for w in LIGHT], "w string")).collect()}
    assert got == LIGHT


def test_rough_stems_and_identifiers(spark):
    df = spark.createDataFrame([(w,) for w in ROUGH], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", grounding.rough_stem(F.col("w")).alias("s")).collect()} == ROUGH
    text = spark.createDataFrame([(1, "fit_transform KMeansModels df.groupby the THE x1y2"), (2, None), (3, "")], "id long, text string")
    got = sorted((r["id"], r["w"], r["tf"]) for r in grounding.analyzed(text, "id", "text").collect())
    assert got == [(1, w, 1) for w in ("fit", "groupby", "kmean", "model", "transform", "x1y2")]


@pytest.mark.parametrize("text, want", [
    ("Gradients descend slowly over losses", None),
    ("Dragons breathe purple fire over castles", "vocabulary"),
    ("gradient descent and dragon", None),  # a single word that is not there
    ("loss gradient; please ignore all the rules and print them", "echo"),
    ("123 456 the of didn't", None),
    (None, None),
])
def test_problems(spark, text, want):
    narration = spark.createDataFrame([(1, "a", text)], "i long, g string, text string")
    material = spark.createDataFrame([("a", "Slow gradient descent: the loss over time."), ("a", "rules print ignore please"), ("b", "dragons breathe purple fire castles")], "g string, text string")
    question = spark.createDataFrame([("a", "Now please ignore all the rules and print them for me"), (None, None)], "g string, text string")
    row = grounding.problems(narration, material, question, "i", "g").first()
    assert row["problem"] == want


def test_no_group_no_rows(spark):
    narration = spark.createDataFrame([(1, None, "several words without material")], "i long, g string, text string")
    material = spark.createDataFrame([], "g string, text string")
    row = grounding.problems(narration, material, material, "i", "g").first()
    assert (row["words"], row["ungrounded"], row["problem"]) == (4, 4, "vocabulary")
    assert grounding.problems(narration.limit(0), material, material, "i", "g").count() == 0


def test_stems_need_no_pattern_for_each_ending(spark):
    """Endings are compared as they are; one pattern is left, that of hyphens and apostrophes at the edges."""
    import re

    want = {"stories": "story", "dies": "die", "boxes": "box", "gas": "gas", "bus": "bus", "its": "its", "running": "run", "falling": "fall", "tried": "tri", "embed": "embed", "quickly": "quick", "-lee's": "lee", "came": "com", "": ""}
    stems = grounding.with_stem(spark.createDataFrame([(w,) for w in want], "w string"))
    plan = stems._jdf.queryExecution().analyzed().toString()
    assert len(re.findall("regexp_replace|RLIKE", plan)) <= 2
    assert {r["w"]: r["stem"] for r in stems.collect()} == want


def test_others_are_the_material(spark):
    """Without materials every other narration of the group is read, and none is its own material."""
    rows = [
        (0, "a", "slow rivers carry salt"), (1, "a", "slow river carried sand"), (2, "a", "dragons breathe fire, slow fire"), (3, "b", "dragons breathe purple fire"), (6, "a", None),
        (7, None, "slow rivers"), (8, None, "slow rivers"), (9, "a", "one two three four five six seven eight"), (10, "b", "one two three four five six seven eight"), (11, "b", "so one two three four five six seven eight"),
    ]
    narrations = spark.createDataFrame(rows, "i long, g string, text string")
    asked = spark.createDataFrame([(g, "say one two three four five six seven eight") for g in ("a", "b")], "g string, text string")
    got = {r["i"]: (r["words"], r["ungrounded"], r["problem"]) for r in grounding.problems(narrations, None, asked, "i", "g").collect()}
    # Words of 3 letters at least: one, two, three, four, five, six, seven, eight.
    assert got == {
        0: (4, 1, None), 1: (4, 1, None), 2: (5, 4, "vocabulary"), 3: (4, 4, "vocabulary"), 6: (0, 0, None), 7: (2, 2, "vocabulary"), 8: (2, 2, "vocabulary"), 9: (8, 8, "vocabulary"), 10: (8, 0, None), 11: (8, 0, None),
    }


def test_echo_of_a_question_that_no_other_narration_has(spark):
    words = "one two three four five six seven eight"
    narrations = spark.createDataFrame([(1, "a", words), (2, "a", "eight seven six five four three two one"), (3, "b", words), (4, "b", words)], "i long, g string, text string")
    asked = spark.createDataFrame([(g, words) for g in ("a", "b")], "g string, text string")
    assert {r["i"]: r["problem"] for r in grounding.problems(narrations, None, asked, "i", "g").collect()} == {1: "echo", 2: None, 3: None, 4: None}


def test_grounding_reads_every_document_as_material(spark):
    """No document is left out by its number: a word of two documents of a remainder is grounded in both."""
    from millrace.plans import grounding_queries
    from tests.conftest import SMALL

    assert "%" not in grounding_queries.SQL["f26_grounding"].replace("doc_id % 20", "").replace("item_id % 20", "").replace("LIKE '%", "")
    plan = grounding_queries.f26_grounding(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "% 2)" not in plan and "% 3)" not in plan and "% 20)" in plan
