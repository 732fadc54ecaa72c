"""Exact order statistics by distributed selection: no task sorts a whole group.

Approximate percentiles cut a group's values into slices; counts of the slices, combined where rows are read, tell
which one holds the wanted place. The slice is cut again until it is small, or is one repeated value, which
a cut takes out as a slice of its own. Rounds grow with the logarithm of the largest group to the base of the
number of cuts; each reads the narrow table of values once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scratch import Scratch

CUTS = 256
#: Values of a slice that are ranked in one task.
SMALL = 4096
#: Rows of wanted places that are broadcast; beyond that they are joined by shuffle.
BROADCAST_ROWS = 10_000


def count_below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` (``most`` at most) are below ``value``, by halving."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]

    def half(low: Column, step: Column) -> Column:
        return F.when(F.get(cuts, low + step - 1) < value, low + step).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), half)


def at_places(df: DataFrame, part: list[str], value: str, places: dict[str, Column], cuts: int = CUTS, small: int = SMALL) -> DataFrame:
    """(part, n, a column for each of ``places``): the values at 0-based places of each group's sorted values.

    A place is an expression over ``n``, how many values the group has; outside of 0 to n - 1 it gives null.
    Null values are left out, and so are groups without any; NaN is the largest value. ``part`` may be empty.
    """
    scratch = Scratch(df.sparkSession, "places")
    group = F.struct(*part) if part else F.lit(0)
    values = scratch.save(df.filter(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).alias("v")))
    sizes = scratch.save(values.groupBy("g").agg(F.count("*").alias("n")))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at.cast("long").alias("k")) for name, at in places.items())))
    kind = values.schema["v"].dataType
    none = F.lit(None).cast(kind)
    want = sizes.select("g", F.col("n").alias("m"), wanted.alias("w")).select("g", "w.*", "m", none.alias("lo"), none.alias("hi"), none.alias("found"))
    want, done = want.filter((F.col("k") >= 0) & (F.col("k") < F.col("m"))), None

    def within(some: DataFrame) -> DataFrame:
        """The values between the bounds of each wanted place."""
        held = some.select(F.col("g").alias("__g"), "name", "k", "lo", "hi")
        rows = values.join(F.broadcast(held) if some.count() <= BROADCAST_ROWS else held, F.col("g").eqNullSafe(F.col("__g")))
        return rows.filter((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))).drop("__g")

    while True:
        want = scratch.save(want)
        ready = want.filter(F.col("found").isNotNull() | (F.col("m") <= small))
        done = ready if done is None else done.union(ready)
        large = want.filter(F.col("found").isNull() & (F.col("m") > small))
        if not large.count():
            break
        rows = within(large)
        at = rows.groupBy("g", "name").agg(F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 20 * cuts).alias("cuts"))
        at = scratch.save(at.withColumn("cuts", F.array_sort(F.array_distinct("cuts"))))
        held = at.select(F.col("g").alias("__g"), F.col("name").alias("__name"), "cuts")
        held = F.broadcast(held) if at.count() <= BROADCAST_ROWS else held
        rows = rows.join(held, F.col("g").eqNullSafe(F.col("__g")) & (F.col("name") == F.col("__name")))
        rows = rows.withColumn("i", count_below(F.col("cuts"), F.col("v"), cuts))
        rows = rows.withColumn("same", F.coalesce(F.get("cuts", F.col("i")) == F.col("v"), F.lit(False)).cast("int"))
        slices = rows.groupBy("g", "name", "i", "same").agg(F.count("*").alias("m"), F.first("k").alias("k"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("v").alias("v"))
        order = Window.partitionBy("g", "name").orderBy("i", "same")  # slices of one place
        slices = slices.withColumn("before", F.sum("m").over(order) - F.col("m"))
        slices = slices.filter((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("m")))
        slices = slices.join(held, F.col("g").eqNullSafe(F.col("__g")) & (F.col("name") == F.col("__name")))
        lo = F.when(F.col("i") == 0, F.col("lo")).otherwise(F.get("cuts", F.col("i") - 1))
        hi = F.coalesce(F.get("cuts", F.col("i")), F.col("hi"))
        want = slices.select("g", "name", (F.col("k") - F.col("before")).alias("k"), "m", lo.alias("lo"), hi.alias("hi"), F.when(F.col("same") == 1, F.col("v")).otherwise(none).alias("found"))

    done = scratch.save(done)
    rank = F.row_number().over(Window.partitionBy("g", "name").orderBy("v")) - 1  # of at most ``small`` values
    ranked = within(done.filter("found IS NULL")).withColumn("i", rank).filter("i = k").select("g", "name", F.col("v").alias("found"))
    found = ranked.union(done.filter("found IS NOT NULL").select("g", "name", "found"))
    wide = found.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in places))
    out = sizes.join(wide.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g")), "left")
    return out.select(*(F.col(f"g.{c}").alias(c) for c in part), "n", *places)


def median(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """(part, n, median): the mean of the two middle values."""
    n = F.col("n")
    both = at_places(df, part, value, {"__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2)})
    return both.select(*part, "n", ((F.col("__low") + F.col("__high")) / 2).alias("median"))
