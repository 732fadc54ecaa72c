"""Islands, intervals, as-of and point-in-window joins. Every range join has an equi key, and wide
ranges are cut into buckets of time, so Spark plans hash or sort-merge joins with a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, part: list[str], order: list[str], label: str) -> DataFrame:
    """Adds ``run``: the number of the run of equal labels, from 0 in each partition."""
    w = Window.partitionBy(*part).orderBy(*order)
    changed = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    return df.withColumn("__c", F.when(first, 0).otherwise(changed)).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def smooth_labels(df: DataFrame, part: list[str], order: list[str], label: str, least: int) -> DataFrame:
    """Bridge single missing frames (-1) between equal neighbours, then drop runs below ``least``."""
    w = Window.partitionBy(*part).orderBy(*order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    bridged = df.withColumn("smooth", F.when((F.col(label) < 0) & (before == after) & (before >= 0), before).otherwise(F.col(label)))
    runs = islands(bridged, part, order, "smooth")
    size = F.count("*").over(Window.partitionBy(*part, "run"))
    return runs.withColumn("smooth", F.when((F.col("smooth") >= 0) & (size < least), -1).otherwise(F.col("smooth"))).drop("run")


def merge_windows(df: DataFrame, part: list[str], start: str, end: str, gap: float, closed: bool = True) -> DataFrame:
    """Windows merged while the next one starts within ``gap`` of what came before."""
    w = Window.partitionBy(*part).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    far = (F.col(start) > reach + gap) if closed else (F.col(start) >= reach + gap)
    marked = df.withColumn("__new", F.coalesce(far.cast("int"), F.lit(0)))
    grouped = marked.withColumn("piece", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*part, "piece").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def complement(df: DataFrame, part: list[str], start: str, end: str, total: Column) -> DataFrame:
    """What of [0, total) no window covers, in each partition."""
    cover = merge_windows(df, part, start, end, 0.0)
    w = Window.partitionBy(*part).orderBy(start)
    gaps = cover.select(*part, F.coalesce(F.lag(end).over(w), F.lit(0.0)).alias("a"), F.col(start).alias("b"))
    last = cover.groupBy(*part).agg(F.max(end).alias("a")).withColumn("b", total.cast("double"))
    return gaps.unionByName(last).select(*part, F.greatest("a", F.lit(0.0)).alias("gap_start"), F.least("b", total).alias("gap_end")).filter("gap_start < gap_end")


def point_in_window(points: DataFrame, windows: DataFrame, part: list[str], at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points joined to the half-open windows [start, end) that hold them.

    Windows are spread over the buckets of width ``bucket`` that they touch, so the join has a key
    of time beside ``part`` and one busy partition does not meet all its windows.
    """
    spread = windows.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    keyed = points.withColumn("__b", F.floor(F.col(at) / bucket))
    return keyed.join(spread, [*part, "__b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def overlaps(left: DataFrame, right: DataFrame, part: list[str], bucket: float, pad: float = 0.0) -> DataFrame:
    """Pairs of left (ls, le) and right (rs, re) intervals with le > rs - pad and ls < re + pad, each once."""
    cells = lambda a, b: F.sequence(F.floor(a / bucket), F.floor(b / bucket))
    a = left.withColumn("__b", F.explode(cells(F.col("ls"), F.col("le"))))
    b = right.withColumn("__b", F.explode(cells(F.col("rs") - pad, F.col("re") + pad)))
    first = F.floor(F.greatest(F.col("ls"), F.col("rs") - pad) / bucket)
    pairs = a.join(b, [*part, "__b"]).filter((F.col("le") > F.col("rs") - pad) & (F.col("ls") < F.col("re") + pad))
    return pairs.filter(F.col("__b") == first).drop("__b")


def asof(df: DataFrame, part: list[str], order: list[str], anchor: Column, value: str) -> DataFrame:
    """Adds prev and next: ``value`` of the nearest anchor row strictly before and after each row."""
    w = Window.partitionBy(*part).orderBy(*order)
    held = F.when(anchor, F.col(value))
    before = F.last(held, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(held, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumns({"prev": before, "next": after})


def equal_chunks(df: DataFrame, start: str, end: str, longest: float, shortest: float) -> DataFrame:
    """Stretches cut into equal chunks of at most ``longest``; stretches below ``shortest`` go."""
    span = F.col(end) - F.col(start)
    n = F.greatest(F.ceil(span / longest), F.lit(1))
    rows = df.filter(span >= shortest).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    step = (F.col(end) - F.col(start)) / F.col("n")
    return rows.withColumns({"chunk_start": F.col(start) + F.col("i") * step, "chunk_end": F.col(start) + (F.col("i") + 1) * step})


def prefix_share(df: DataFrame, part: list[str], order: list[str], weight: str) -> DataFrame:
    """Adds ``share``: the weight before a row as a share of its partition's."""
    w = Window.partitionBy(*part).orderBy(*order)
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("share", F.try_divide(before, F.sum(weight).over(Window.partitionBy(*part))))
