"""Rules whose next step depends on the last one, in one sorted pass over each task's rows.

Rows are dealt by key and sorted inside their tasks; a task then reads its keys one after the other, a batch
at a time, and carries the state of the rule from row to row and from batch to batch. So a task never holds
more than a batch and one state, however many rows a key has, and a task with many small keys makes no frame
for each. Rows of one key are taken in order by one task, since the rule itself is sequential.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _fields(more: str) -> list[T.StructField]:
    return list(T._parse_datatype_string(more))


def segmented(df: DataFrame, key: list[str], order: list[str], args: list[str], start: Callable[[], Any], step: Callable[..., tuple], more: str) -> DataFrame:
    """``df`` with the columns of ``more``: what ``step(state, *args)`` returns for each row, in ``order``
    within its key. ``start()`` makes the state of a key; step changes it in place.

    Null keys are one key; nulls among ``order`` come first. Rows that tie in ``order`` come in any order.
    """
    out = T.StructType([*df.schema.fields, *_fields(more)])
    kinds = to_arrow_schema(out)

    def run(batches):
        held, state = None, None
        for batch in batches:
            names = batch.schema.names
            read = lambda cols: zip(*(batch.column(names.index(c)).to_pylist() for c in cols), strict=True)  # noqa: E731, B023
            values = read(args) if args else iter(() for _ in range(batch.num_rows))
            rows = []
            for k, v in zip(read(key), values, strict=True):
                if state is None or k != held:
                    held, state = k, start()
                rows.append(step(state, *v))
            new = [pa.array([r[i] for r in rows], kinds.field(len(df_columns) + i).type) for i in range(len(kinds) - len(df_columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, *kinds.names[len(df_columns) :]])

    df_columns = df.columns
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out)


def emitted(df: DataFrame, key: list[str], order: list[str], args: list[str], start: Callable[[], Any], step: Callable[..., list[tuple]], end: Callable[[Any], list[tuple]], more: str) -> DataFrame:
    """(key, columns of ``more``): the rows that ``step(state, *args)`` gives out for each row of a key, and
    ``end(state)`` after its last one."""
    kept = df.select(*dict.fromkeys([*key, *order, *args]))
    out = T.StructType([*(df.schema[k] for k in key), *_fields(more)])
    kinds = to_arrow_schema(out)

    def run(batches):
        held, state = None, None
        for batch in batches:
            names = batch.schema.names
            read = lambda cols: zip(*(batch.column(names.index(c)).to_pylist() for c in cols), strict=True)  # noqa: E731, B023
            rows = []
            for k, v in zip(read(key), read(args), strict=True):
                if state is None or k != held:
                    rows += [(*held, *r) for r in end(state)] if state is not None else []
                    held, state = k, start()
                rows += [(*k, *r) for r in step(state, *v)]
            yield _batch(rows, kinds)
        if state is not None:
            yield _batch([(*held, *r) for r in end(state)], kinds)

    return kept.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)
