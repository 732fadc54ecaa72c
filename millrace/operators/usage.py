"""Counter keys, calendars, spend series and price joins of usage analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.quantiles import at_places

LOCAL_ZONE, MAX_SERIES, TOP_N = "America/New_York", 7, 20


def key_part(value: Column) -> Column:
    """A key's part: unsafe characters become underscores, at most 80 characters."""
    return F.substring(F.regexp_replace(value, "[^A-Za-z0-9._/~@+:-]", "_"), 1, 80)


def usage_key(family: str, day: Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(family), F.date_format(day, "yyyy-MM-dd"), *(key_part(p) for p in parts))


def parse_usage_key(key: Column) -> Column:
    """struct(family, day, purpose, provider, model, metric): read from the left, the metric from the
    right, so that a model may hold colons."""
    p = F.split(key, ":")
    n = F.size(p)
    model = F.array_join(F.slice(p, 5, F.greatest(n - 5, F.lit(0))), ":")
    return F.struct(p[0].alias("family"), F.to_date(p[1]).alias("day"), p[2].alias("purpose"), p[3].alias("provider"), model.alias("model"), F.element_at(p, -1).alias("metric"))


def local_hour(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """The hour of a zone-less UTC time in ``zone``."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts))


def calendar(df: DataFrame, day_col: str) -> DataFrame:
    """Every day from the first to the last one of ``df``."""
    span = df.agg(F.min(day_col).alias("a"), F.max(day_col).alias("b")).filter("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias(day_col))


def densify(counts: DataFrame, slots: DataFrame, on: list[str], fill: list[str]) -> DataFrame:
    """``counts`` for every row of ``slots``, 0 where there is none."""
    joined = slots.join(counts, on, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in fill})


def top_n_and_other(df: DataFrame, series: str, slot: str, value: str, n: int = MAX_SERIES) -> DataFrame:
    """(slot, series, value) with the ``n`` largest series by their total and the rest as "Other"."""
    sums = df.groupBy(slot, series).agg(F.sum(value).alias(value))
    totals = sums.groupBy(series).agg(F.sum(value).alias("t")).filter("t > 0")
    top = totals.orderBy(F.desc(F.round("t", 6)), series).limit(n).select(series, F.lit(True).alias("is_top"))
    named = sums.join(F.broadcast(top), series, "left")  # n rows
    named = named.withColumn(series, F.when(F.col("is_top"), F.col(series)).otherwise("Other"))
    return named.groupBy(slot, series).agg(F.sum(value).alias(value))


def with_price(counts: DataFrame, saved: DataFrame, fallback: DataFrame, on: list[str]) -> DataFrame:
    """Counts with the saved price, else the fallback's, else none (``unpriced``)."""
    out = counts.join(saved.select(*on, F.col("price").alias("p1")), on, "left").join(fallback.select(*on, F.col("price").alias("p2")), on, "left")
    out = out.withColumn("price", F.coalesce("p1", "p2")).drop("p1", "p2")
    return out.withColumn("unpriced", F.col("price").isNull())


def override_union(saved: DataFrame, defaults: DataFrame, key: list[str]) -> DataFrame:
    """All saved rows and the defaults that have none."""
    return saved.unionByName(defaults.join(saved.select(*key).distinct(), key, "left_anti"))


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def running_budget(df: DataFrame, part: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Rows until the running total has reached the budget; the row that reaches it is the last."""
    before = F.sum(cost).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("spent_before", F.coalesce(before, F.lit(0.0))).filter(F.col("spent_before") < budget)


def upper_median(values: Column) -> Column:
    """The element at index n div 2 of the sorted array."""
    held = F.array_sort(values)
    return F.get(held, F.floor(F.size(held) / 2).cast("int"))


def index_rank(df: DataFrame, part: list[str], value: str, at: Column) -> DataFrame:
    """The value at a 0-based place of each group's sorted values, by selection: ``at`` is an expression
    over ``n``, the group's size. Adds ``picked``."""
    return at_places(df, part, value, {"picked": at}).select(*part, "picked", "n").filter("picked IS NOT NULL")
