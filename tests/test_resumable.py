"""Runs that are stopped, refused, raced for and taken up again."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import resumable
from millrace.operators.resumable import REFUSED, Run, evaluate, plan_tasks

GENERATORS = [("a:1", "a"), ("b:1", "b"), ("b:2", "b")]
KEY = ["qid", "generator", "rep"]


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(i, "hard" if i % 3 == 0 else "easy") for i in range(12)], "qid long, kind string")


def _ask(refusing=()):
    def ask(df):
        bad = F.col("provider").isin(*refusing) if refusing else F.lit(False)
        return df.withColumns({"status": F.when(bad, REFUSED).when(F.col("qid") == 5, "error").otherwise("ok"), "cost": F.when(bad, 0.0).otherwise(0.5), "answer": F.col("qid") * 10})

    return ask


def _keys(df):
    return sorted((r["qid"], r["generator"], r["rep"]) for r in df.select(*KEY).collect())


def test_plan(spark, questions):
    plan = plan_tasks(questions.unionByName(spark.createDataFrame([(99, None)], questions.schema)), GENERATORS, 2, "kind = 'hard'")
    want = sorted((q, g, r) for q in [*range(12), 99] for g, _ in GENERATORS for r in ((1, 2) if q % 3 == 0 and q < 12 else (1,)))
    assert _keys(plan) == want


def test_killed_run_goes_on_without_repeats(spark, questions, tmp_path):
    now = [0.0]
    plan = plan_tasks(questions, GENERATORS, 2, "kind = 'hard'")
    run = Run(spark, str(tmp_path / "run"), KEY, lease=60, clock=lambda: now[0])
    assert run.results() is None and run.progress() == (0, 0, 0)
    chunks = run.extend(plan, 2, first="rep")
    assert chunks == 4 and run.extend(plan, 2, first="rep") == 0  # nothing is planned twice
    assert run.work(_ask(), most=1).stopped == "most"
    asked = []

    def dies(df):
        asked.extend(_keys(df))
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        run.work(dies)
    before = _keys(run.results())
    again = Run(spark, run.root, KEY, lease=60, clock=lambda: now[0])
    told = again.work(_ask())
    assert (told.held, told.chunks) == (1, 2)  # the dead worker's lease is still running
    now[0] = 61.0
    assert again.work(_ask()).chunks == 1
    assert again.work(_ask()).chunks == 0
    assert asked and not set(asked) & set(before)
    assert _keys(again.results()) == _keys(plan)
    assert again.progress() == (plan.count(), plan.count(), 0)
    assert again.spent() == plan.count() * 0.5
    assert {r["rep"] for r in spark.createDataFrame(before, "qid long, generator string, rep int").collect()} == {1}  # the first repetition comes first


def test_two_workers_on_one_chunk_count_once(spark, questions, tmp_path):
    now = [0.0]
    plan = plan_tasks(questions, GENERATORS, 1)
    slow, fast = (Run(spark, str(tmp_path / "run"), KEY, lease=10, clock=lambda: now[0]) for _ in range(2))
    slow.extend(plan, 1)

    def overtaken(df):
        now[0] = 11.0  # the lease runs out while this worker is asking
        assert fast.work(_ask()).rows == plan.count()
        return _ask()(df)

    told = slow.work(overtaken)
    assert (told.chunks, told.late) == (0, 1)
    assert _keys(fast.results()) == _keys(plan)
    assert len(list((tmp_path / "run" / "answers").iterdir())) == 1


def test_entry_that_cannot_be_read(spark, questions, tmp_path):
    now = [0.0]
    plan = plan_tasks(questions, GENERATORS, 1)
    run = Run(spark, str(tmp_path / "run"), KEY, lease=10, clock=lambda: now[0])
    run.extend(plan, 1)
    chunk = next(run._chunks())[0]
    assert run._take(chunk) == 1 and run._take(chunk) is None
    run.files.put(f"log/{chunk}/000001.json", "{")
    assert run.work(_ask()).held == 1
    now[0] = 11.0
    assert run.work(_ask()).rows == plan.count()
    assert _keys(run.results()) == _keys(plan)


def test_refusing_provider_is_left_alone_and_asked_again(spark, questions, tmp_path):
    plan = plan_tasks(questions, GENERATORS, 1)
    run = Run(spark, str(tmp_path / "run"), KEY)
    run.extend(plan, 3)
    calls = []

    def ask(df):
        calls.append(df.filter("provider = 'b'").count())
        return _ask(["b"])(df)

    told = run.work(ask)
    assert told.down == ("b",) and told.rows == plan.count()
    assert calls[0] > 0 and calls[1:] == [0, 0]
    assert {r["generator"] for r in run.results().select("generator").distinct().collect()} == {"a:1"}
    assert run.progress() == (36, 12, 24)
    assert run.results(refused=True).count() == 36
    seen = []

    def second(df):
        seen.extend(_keys(df))
        return _ask()(df)

    run.work(second)
    assert sorted(seen) == _keys(plan.filter("provider = 'b'"))
    assert _keys(run.results()) == _keys(run.results(refused=True)) == _keys(plan)
    assert run.progress() == (36, 36, 0)


def test_budget_and_rows_that_get_no_answer(spark, questions, tmp_path):
    plan = plan_tasks(questions, GENERATORS, 1)
    run = Run(spark, str(tmp_path / "run"), KEY)
    run.extend(plan, 4)
    told = run.work(_ask(), budget=0.5)
    assert told.stopped == "budget" and told.chunks == 1
    assert run.work(lambda df: _ask()(df).filter("qid <> 7")).stopped == "done"
    lost = [k for k in _keys(plan) if k not in _keys(run.results())]
    run.work(_ask())
    assert all(q == 7 for q, _, _ in lost) and _keys(run.results()) == _keys(plan)


def test_null_and_repeated_keys_and_late_questions(spark, tmp_path):
    rows = spark.createDataFrame([(None, "x"), (None, "y"), (1, "x"), (1, "x")], "qid long, kind string")
    run = Run(spark, str(tmp_path / "run"), KEY)
    run.extend(plan_tasks(rows, GENERATORS[:1], 1), 2)
    run.work(_ask())
    assert sorted(map(str, [r["qid"] for r in run.results().collect()])) == ["1", "None"]
    more = rows.unionByName(spark.createDataFrame([(2, "z")], rows.schema))
    assert run.extend(plan_tasks(more, GENERATORS[:1], 1), 2) == 1
    assert run.work(_ask()).rows == 1
    assert run.extend(plan_tasks(more.filter("false"), GENERATORS, 1), 2) == 0


def test_judges(spark, questions, tmp_path):
    answers, verdicts = Run(spark, str(tmp_path / "a"), KEY), Run(spark, str(tmp_path / "v"), [*KEY, "judge"])
    plan = plan_tasks(questions, GENERATORS[:2], 1)
    answers.extend(plan, 1)
    judges = [("j1", "a"), ("j2", "c")]

    def judge(refusing):
        return lambda df: df.withColumns({"status": F.when(F.col("provider").isin(*refusing), REFUSED).otherwise("ok"), "cost": F.lit(0.1), "pass": F.col("answer") > 30})

    evaluate(answers, verdicts, _ask(["b"]), judge(["c"]), judges, 1)
    assert {(r["generator"], r["judge"]) for r in verdicts.results().collect()} == {("a:1", "j1")}
    evaluate(answers, verdicts, _ask(), judge(["none"]), judges, 1)
    got = sorted((r["qid"], r["generator"], r["judge"], r["pass"]) for r in verdicts.results().collect())
    assert got == sorted((q, g, j, q * 10 > 30) for q in range(12) if q != 5 for g in ("a:1", "b:1") for j in ("j1", "j2"))
    assert resumable.judge_tasks(answers.results(), judges).filter("qid = 5").count() == 0  # errors are not judged
