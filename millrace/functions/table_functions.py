"""Rules over ordered rows as table functions for SQL: called with PARTITION BY and ORDER BY, one row at a time.

    SELECT * FROM label_runs(TABLE(SELECT user_id, t, event_type FROM e) PARTITION BY user_id ORDER BY t)
    SELECT * FROM greedy_chunks(TABLE(SELECT doc_id, i, words FROM parts) PARTITION BY doc_id ORDER BY (i), 400)

Each holds what the current run or chunk needs and no more. The DataFrame forms are ``series.islands`` and
``recurrences.greedy_batches``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="key: bigint, run: int, label: string, first: double, last: double, n: int")
class LabelRuns:
    """Runs of equal labels of rows (key, place, label): their number, first and last place, and size; a null
    label is one like others."""

    def __init__(self) -> None:
        self.held: tuple | None = None
        self.run = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        key, at, label = row[0], float(row[1]), row[2]
        if self.held and self.held[1] == label:
            key, label, first, _, n = self.held
            self.held = (key, label, first, at, n + 1)
            return
        if self.held:
            yield self._close()
        self.held = (key, label, at, at, 1)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self._close()

    def _close(self) -> tuple:
        key, label, first, last, n = self.held
        self.run += 1
        return key, self.run - 1, label, first, last, n


@udtf(returnType="key: bigint, chunk: int, first: bigint, last: bigint, size: bigint")
class GreedyChunks:
    """Chunks of rows (key, place, size): a new one where the next row would pass ``most``; a null size is 0."""

    def __init__(self) -> None:
        self.held: list | None = None
        self.chunk = 0

    def eval(self, row: Row, most: int) -> Iterator[tuple]:
        key, at, size = row[0], row[1], row[2] or 0
        if self.held and not (self.held[3] and self.held[3] + size > most):
            self.held[2:] = [at, self.held[3] + size]
            return
        if self.held:
            yield self._close()
        self.held = [key, at, at, size]

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield self._close()

    def _close(self) -> tuple:
        self.chunk += 1
        key, first, last, size = self.held
        return key, self.chunk - 1, first, last, size


def register(spark: SparkSession) -> None:
    spark.udtf.register("label_runs", LabelRuns)
    spark.udtf.register("greedy_chunks", GreedyChunks)
