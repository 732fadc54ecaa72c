"""Structured Streaming: metering windows, capped counters, alert deduplication and a work queue.

Each job takes a streaming DataFrame and returns one, or runs a source to its end; batch twins of the
stateful rules are in operators.recurrences, and tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """A file source over Parquet; zone-less times become timestamps, which watermarks need."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    ntz = {f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)}
    return raw.withColumns(ntz) if ntz else raw


def metering(stream: DataFrame, ts: str, dims: list[str], amount: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Sums per window and dimensions, with a watermark that bounds the state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *dims).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


#: State that grows with the number of keys lives on disk, and is saved as what has changed.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Counter(StatefulProcessor):
    """A counter with a cap: its total and the time when it ends, in seconds of the event's clock."""

    def __init__(self, order: list[str], seconds: str, amount: str, cap: float, ttl: float, columns: list[str]):
        self.order, self.seconds, self.amount, self.cap, self.ttl, self.columns = order, seconds, amount, cap, ttl, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "total double, until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        total, until = self.counter.get() if self.counter.exists() else (0.0, None)
        pdf = pd.concat(list(rows)).sort_values([self.seconds, *self.order], kind="stable", na_position="first")
        had, allowed, counts = until, [], []
        for t, a in zip(pdf[self.seconds], pdf[self.amount], strict=True):
            if t == t and (until is None or t >= until):
                total, until = 0.0, t + self.ttl
            ok = t == t and a == a and total + a <= self.cap
            total += a if ok else 0.0
            allowed.append(ok)
            counts.append(total)
        if until is not None:
            self.counter.update((total, until))
            if until != had:
                for timer in ([] if had is None else [int(had * 1000)]):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(until * 1000))
        yield pdf.assign(allowed=allowed, count=counts)[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.counter.clear()
        return iter(())

    def close(self) -> None:
        pass


def capped_counter(stream: DataFrame, key: str, order: list[str], time: str, amount: str, cap: float, ttl: float, late: str = "0 seconds") -> DataFrame:
    """(key, order, seconds, amount, allowed, count): increments with a cap on counters that live ``ttl``
    seconds from their first one on, by the timestamp column ``time``.

    A counter is one row of state, kept in RocksDB and removed by a timer once the watermark (``late``
    behind the newest time) has passed its end, so the state holds the counters that are alive and no more.
    Rows of one micro-batch are taken in order of time, then ``order``; rows behind the watermark
    are dropped, and a null time or amount is refused. ``recurrences.capped_counter`` is the batch twin.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.unix_micros(time) / 1e6
    rows = stream.withWatermark(time, late).select(key, *order, time, at.alias("seconds"), F.col(amount).cast("double").alias(amount))
    columns = [key, *order, "seconds", amount, "allowed", "count"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"allowed": "boolean", "count": "double"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return rows.groupBy(key).transformWithStateInPandas(_Counter(order, "seconds", amount, cap, ttl, columns), schema, "append", "eventTime")


def dedupe_alerts(stream: DataFrame, key: str, order: str, seconds: str, within: float) -> DataFrame:
    """(key, order, seconds, repeat): a row repeats the last alert if it follows within ``within``
    seconds; only rows that are no repeats move the anchor."""

    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values([seconds, order], kind="stable")
        rows = []
        for o, t in zip(pdf[order], pdf[seconds], strict=True):
            again = anchor is not None and t - anchor <= within
            anchor = anchor if again else t
            rows.append((keys[0], o, float(t), again))
        state.update((anchor,))
        yield pd.DataFrame(rows, columns=[key, order, seconds, "repeat"])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{seconds}` double, repeat boolean"
    return stream.select(key, order, seconds).groupBy(key).applyInPandasWithState(step, schema, "anchor double", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet (exactly once) and read the result."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregation over what is there now; each batch overwrites the whole result."""

    def put(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(path)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def work_queue(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame], None], rebuild: Callable[[], None]) -> int:
    """Handle every new row once, then rebuild once for each batch that had rows: the checkpoint takes
    the place of claims, so a crashed run goes on where it was. Returns the number of batches."""
    done = 0

    def batch(df: DataFrame, _: int) -> None:
        nonlocal done
        if df.limit(1).count():
            handle(df)
            rebuild()
            done += 1

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done


def append_degrading(df: DataFrame, put: Callable[[DataFrame], None], optional: list[list[str]]) -> int:
    """Append rows by ``put``, without more and more of the optional columns while that fails.

    ``optional``: groups of columns that a target may lack, the newest first. Returns how many groups
    were left out; where even the last try fails its error is raised. For use in foreachBatch.
    """
    for tried in range(len(optional) + 1):
        gone = {c for group in optional[:tried] for c in group}
        try:
            put(df.select(*(c for c in df.columns if c not in gone)))
            return tried
        except Exception:  # whatever the target raises for a column that it lacks
            if tried == len(optional):
                raise
    return len(optional)


def question_log(stream: DataFrame, text_col: str, checkpoint: str, put: Callable[[DataFrame], None], optional: list[list[str]], most: int = 500) -> int:
    """Append a stream of questions to a log: scrubbed and cut before anything is written."""
    from millrace.functions import text

    clean = stream.withColumn(text_col, F.substring(text.scrub(F.col(text_col)), 1, most))
    left_out = 0

    def batch(df: DataFrame, _: int) -> None:
        nonlocal left_out
        left_out = max(left_out, append_degrading(df, put, optional))

    query = clean.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return left_out
