"""Versioned tables: an optimistic log of commits over immutable snapshots.

A commit writes its rows to a folder of their own and then creates the log entry of the next number, which only one
writer can: an entry that is there already means that somebody else came first, and the commit is tried again on top
of that or given up. Readers take the newest entry that is whole (it parses, and its snapshot is complete), so
a writer that died half way changes nothing. Entries name their snapshot, so restoring an old version
is a new entry for the same files.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


class Files:
    """Objects below a root in any file system that Hadoop knows: get, put, create once, list, delete."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str) -> list[str]:
        """Names in a folder, sorted; none where there is no folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def get(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str, overwrite: bool = True) -> bool:
        """Whether it was written; without ``overwrite`` not where something is there."""
        try:
            out = self.fs.create(self._path(name), overwrite)
        except Exception as error:
            if not overwrite and self.exists(name):
                return False
            raise error
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Entry:
    """A version: its number, the folder of its rows, how many they are, what was noted."""

    number: int
    data: str
    rows: int
    note: str = ""
    restored: int | None = None


class VersionedTable:
    """A table below ``root``; versions count from 1. Notes are cut to ``NOTE_CHARS`` characters."""

    NOTE_CHARS = 300

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _entry(self, name: str) -> Entry | None:
        try:
            held = Entry(**json.loads(self.files.get(f"log/{name}") or ""))
        except (ValueError, TypeError):  # cut short, or something else
            return None
        return held if self.files.exists(f"data/{held.data}/_SUCCESS") else None

    def _names(self) -> list[str]:
        return [n for n in self.files.list("log") if re.fullmatch(r"\d{12}\.json", n)]

    def history(self, limit: int = 50) -> list[Entry]:
        """Whole versions, the newest first."""
        out = []
        for name in reversed(self._names()):
            if len(out) == limit:
                break
            if entry := self._entry(name):
                out.append(entry)
        return out

    def latest(self) -> Entry | None:
        return next(iter(self.history(1)), None)

    def version(self, number: int) -> Entry:
        entry = self._entry(f"{number:012d}.json")
        if entry is None:
            raise ValueError(f"there is no whole version {number}")
        return entry

    def read(self, number: int | None = None) -> DataFrame:
        entry = self.latest() if number is None else self.version(number)
        if entry is None:
            raise ValueError("the table has no version")
        return self.spark.read.parquet(f"{self.root}/data/{entry.data}")

    def _log(self, data: str, rows: int, note: str, expected: int | None, restored: int | None = None, tries: int = 20) -> Entry:
        note = re.sub(r"\s+", " ", note).strip()[: self.NOTE_CHARS]
        for _ in range(tries):
            names = self._names()
            last = int(names[-1][:-5]) if names else 0  # broken entries keep their numbers
            newest = self.latest()
            if expected is not None and (newest.number if newest else 0) != expected:
                raise Conflict(f"version {expected} is not the newest any more")
            entry = Entry(last + 1, data, rows, note, restored)
            if self.files.put(f"log/{entry.number:012d}.json", json.dumps(asdict(entry)), overwrite=False):
                return entry
        raise Conflict(f"other writers came first {tries} times")

    def commit(self, df: DataFrame, note: str = "", expected: int | None = None) -> Entry:
        """A new version of these rows. With ``expected`` only on top of that version (0: of none), else a
        Conflict; the rows that were written are removed then."""
        data = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{data}")
        rows = self.spark.read.parquet(f"{self.root}/data/{data}").count()
        try:
            return self._log(data, rows, note, expected)
        except Conflict:
            self.files.delete(f"data/{data}")
            raise

    def restore(self, number: int, note: str = "") -> Entry:
        """An old version once more, as a new one."""
        old = self.version(number)
        return self._log(old.data, old.rows, note or f"Restored version {number}.", None, restored=number)

    def update(self, match: Column, values: dict[str, Column], note: str = "", tries: int = 5) -> tuple[Entry | None, int]:
        """Compare and set: ``values`` where ``match`` holds, as one commit on top of the version that was read; tried
        anew on the newest one after a conflict. (entry, rows changed); no commit where no row matches."""
        for attempt in range(1, tries + 1):
            newest = self.latest()
            rows = self.read(newest.number if newest else None)
            changed = rows.filter(match).count()
            if not changed:
                return None, 0
            new = rows.withColumns({c: F.when(match, v).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, v in values.items()})
            try:
                return self.commit(new, note, expected=newest.number), changed
            except Conflict:
                if attempt == tries:
                    raise
        raise Conflict("not reached")


class Reader:
    """The newest version of a table, looked up again every ``every`` seconds; a version that cannot be read
    leaves the last good one in place, and only the first look may fail."""

    def __init__(self, table: VersionedTable, every: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.table, self.every, self.clock = table, every, clock
        self.held: tuple[Entry, DataFrame] | None = None
        self.looked = 0.0

    def get(self) -> tuple[Entry, DataFrame]:
        now = self.clock()
        if self.held and now - self.looked < self.every:
            return self.held
        self.looked = now
        try:
            newest = self.table.latest()
            if newest is None:
                raise ValueError("the table has no version")
            if self.held is None or newest.number != self.held[0].number:
                self.held = (newest, self.table.read(newest.number))
        except Exception:
            if self.held is None:
                raise
        return self.held
