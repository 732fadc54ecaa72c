"""Versioned tables: races, broken entries, history, and the last good version."""

import pytest
from pyspark.sql import functions as F

from millrace.sources.versions import Conflict, Files, Reader, VersionedTable


def rows(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v string")


def values(df):
    return [r["v"] for r in df.orderBy("id").collect()]


def test_objects(spark, tmp_path):
    files = Files(spark, str(tmp_path / "o"))
    assert files.get("a/b") is None and files.list("a") == []
    assert files.put("a/b", "é1") and not files.put("a/b", "2", overwrite=False) and files.get("a/b") == "é1"
    assert files.put("a/b", "3") and files.get("a/b") == "3" and files.list("a") == ["b"]
    assert files.delete("a/b") and not files.exists("a/b")


def test_two_writers(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.commit(rows(spark, "a"), expected=0)
    seen = two.latest().number  # two reads, one writes first
    one.commit(rows(spark, "a", "b"), expected=seen)
    with pytest.raises(Conflict):
        two.commit(rows(spark, "c"), expected=seen)
    assert values(two.read()) == ["a", "b"] and len(two.files.list("data")) == 2  # what lost has left nothing
    assert two.commit(rows(spark, "c"), expected=two.latest().number).number == 3
    assert two.commit(rows(spark, "d")).number == 4  # without an expectation it takes the next number


def test_update_is_tried_again_on_what_came_first(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.commit(rows(spark, "a", "b"))
    commit, came = VersionedTable.commit, []

    def slow(self, df, note="", expected=None):
        if self is two and not came:  # between reading and writing another writer adds a row
            came.append(commit(one, rows(spark, "a", "b", "a")))
        return commit(self, df, note, expected)

    monkeypatch.setattr(VersionedTable, "commit", slow)
    entry, changed = two.update(F.col("v") == "a", {"v": F.lit("z")})
    assert (entry.number, changed) == (3, 2) and values(two.read()) == ["z", "b", "z"]
    assert two.update(F.col("v") == "q", {"v": F.lit("z")}) == (None, 0) and two.latest().number == 3


def test_broken_entries_and_history(spark, tmp_path):
    held = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no version"):
        held.read()
    held.commit(rows(spark, "a"), "  the\nfirst ")
    held.commit(rows(spark, "b"), "x" * 500)
    held.files.put("log/000000000003.json", '{"number": 3, "data"')  # cut short
    held.files.put("log/000000000004.json", '{"number": 4, "data": "gone", "rows": 1}')  # its rows never came
    assert held.latest().number == 2 and values(held.read()) == ["b"]
    assert held.restore(1).number == 5 and values(held.read()) == ["a"]
    assert [(e.number, e.restored) for e in held.history()] == [(5, 1), (2, None), (1, None)]
    assert held.history(1)[0].number == 5 and held.history()[2].note == "the first" and len(held.history()[1].note) == 300
    with pytest.raises(ValueError, match="no whole version 3"):
        held.restore(3)


def test_reader_keeps_the_last_good_version(spark, tmp_path, monkeypatch):
    held, now = VersionedTable(spark, str(tmp_path / "t")), [0.0]
    reader = Reader(held, 60.0, lambda: now[0])
    with pytest.raises(ValueError):
        reader.get()
    held.commit(rows(spark, "a"))
    assert values(reader.get()[1]) == ["a"]
    held.commit(rows(spark, "b"))
    now[0] = 59.0
    assert reader.get()[0].number == 1  # not looked up yet
    now[0] = 60.0
    assert values(reader.get()[1]) == ["b"]
    held.commit(rows(spark, "c"))
    monkeypatch.setattr(VersionedTable, "read", lambda *_: 1 / 0)
    now[0] = 120.0
    assert values(reader.get()[1]) == ["b"]  # the new one can't be read
    monkeypatch.undo()
    now[0] = 180.0
    assert values(reader.get()[1]) == ["c"]
