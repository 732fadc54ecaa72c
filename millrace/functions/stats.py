"""Reliability statistics as aggregate expressions and grouped queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom, then the normal's.
T95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
Z95 = 1.96


def t95(n: Column) -> Column:
    """The critical value for a sample of n."""
    table = F.array(*(F.lit(t) for t in T95))
    return F.when(n - 1 <= len(T95), F.get(table, (n - 2).cast("int"))).otherwise(F.lit(Z95))


def mean_ci(value: str, low: float | None = None, high: float | None = None, digits: int = 3) -> list[Column]:
    """mean, low, high (95 %, within the scale) and n, as aggregates; one value is its own interval."""
    m, n = F.avg(value), F.count(value)
    half = F.when(n == 1, 0.0).otherwise(t95(n) * F.stddev_samp(value) / F.sqrt(n))
    lo, hi = m - half, m + half
    lo = F.greatest(lo, F.lit(low)) if low is not None else lo
    hi = F.least(hi, F.lit(high)) if high is not None else hi
    none = n == 0
    return [F.round(m, digits).alias("mean"), F.when(~none, F.round(lo, digits)).alias("low"), F.when(~none, F.round(hi, digits)).alias("high"), n.alias("n")]


def cohen_kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: kappa, n; both labels may be of any type, pairs with a null are left out."""
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    rows = cells.groupBy(F.col("a").alias("k")).agg(F.sum("c").alias("ra"))
    cols = cells.groupBy(F.col("b").alias("k")).agg(F.sum("c").alias("cb"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    by_chance = rows.join(cols, "k").agg(F.sum(F.col("ra") * F.col("cb")).alias("x"))
    both = total.crossJoin(by_chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.coalesce("x", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(F.col("n") < 2, None).when(pe >= 1 - 1e-12, F.when(po == 1, 1.0)).otherwise(F.round((po - pe) / (1 - pe), 3))
    return both.select(kappa.alias("kappa"), "n")


def icc_2_1(scores: DataFrame, target: str = "target", rater: str = "rater", score: str = "score") -> DataFrame:
    """One row: ICC(2,1) of the targets that every rater scored (two-way random effects, single rater)."""
    raters = scores.filter(F.col(score).isNotNull()).agg(F.countDistinct(rater).alias("k"))
    full = scores.filter(F.col(score).isNotNull()).groupBy(target).agg(F.count("*").alias("m")).crossJoin(raters).filter("m = k").select(target, "k")
    x = scores.join(full, target).select(F.col(target).alias("t"), F.col(rater).alias("r"), F.col(score).cast("double").alias("x"), "k")
    whole = x.agg(F.count("*").alias("cells"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.max("k").alias("k"))
    by_t = x.groupBy("t").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("tt"), F.count("*").alias("n"))
    by_r = x.groupBy("r").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("rr"))
    one = whole.crossJoin(by_t).crossJoin(by_r)
    n, k, mean = F.col("n"), F.col("k"), F.col("s") * F.col("s") / F.col("cells")
    rows, cols = F.col("tt") / k - mean, F.col("rr") / n - mean
    rest = F.col("ss") - mean - rows - cols
    msr, msc, mse = rows / (n - 1), cols / (k - 1), rest / ((n - 1) * (k - 1))
    below = msr + (k - 1) * mse + k * (msc - mse) / n
    return one.select(F.when((n >= 2) & (k >= 2) & (F.abs(below) > 1e-12), F.round((msr - mse) / below, 3)).alias("icc"), n.alias("n"))


def average_rank(value: str, part: list[str] | None = None) -> Column:
    """The rank of a value with ties averaged."""
    by = Window.partitionBy(*(part or []))
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy(*(part or []), value)) - 1) / 2


def ranks_by_value(df: DataFrame, value: str, name: str, parts: int = 64) -> DataFrame:
    """(value, name): average ranks from counts of distinct values, so that no task sorts all rows.

    The values are cut at approximate percentiles; each part is ranked by itself and moved up by the
    counts of the parts below it, a table of ``parts`` rows at most.
    """
    bounds = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)])).first()[0] or []
    part = F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<double>"), lambda b: b < F.col(value)))
    counts = df.groupBy(value).agg(F.count("*").alias("c")).withColumn("__part", part)
    below = counts.groupBy("__part").agg(F.sum("c").alias("s"))
    below = below.select("__part", F.coalesce(F.sum("s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    before = F.sum("c").over(Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", before).join(below, "__part").select(value, (F.col("below") + F.coalesce("before", F.lit(0)) + (F.col("c") + 1) / 2).alias(name))


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pearson, spearman, n of the pairs without a null (null below three pairs)."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = rows.join(ranks_by_value(rows, "a", "ra"), "a").join(ranks_by_value(rows, "b", "rb"), "b")
    n = F.count("*")
    return ranked.agg(F.when(n >= 3, F.round(F.corr("a", "b"), 3)).alias("pearson"), F.when(n >= 3, F.round(F.corr("ra", "rb"), 3)).alias("spearman"), n.alias("n"))


def krippendorff_ordinal(scores: DataFrame, unit: str = "unit", score: str = "score") -> DataFrame:
    """One row: Krippendorff's alpha with the ordinal distance, from a coincidence table of values.

    Values are scale points, so the tables after the first aggregation are tiny.
    """
    rows = scores.filter(F.col(score).isNotNull()).select(F.col(unit).alias("u"), F.col(score).cast("double").alias("v"))
    counts = rows.groupBy("u", "v").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("u").agg(F.sum("c").alias("m")).filter("m >= 2")
    counts = counts.join(sizes, "u")
    other = counts.select("u", F.col("v").alias("w"), F.col("c").alias("cw"))
    pairs = counts.join(other, "u").withColumn("o", F.col("c") * (F.col("cw") - (F.col("v") == F.col("w")).cast("int")) / (F.col("m") - 1))
    o = pairs.groupBy("v", "w").agg(F.sum("o").alias("o"))
    marginal = o.groupBy("v").agg(F.sum("o").alias("n"))
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    m = marginal.withColumn("upto", upto)
    a, b = m.select(F.col("v").alias("v"), F.col("n").alias("na"), F.col("upto").alias("ua")), m.select(F.col("v").alias("w"), F.col("n").alias("nb"), F.col("upto").alias("ub"))
    between = F.when(F.col("v") <= F.col("w"), F.col("ub") - F.col("ua") + F.col("na")).otherwise(F.col("ua") - F.col("ub") + F.col("nb"))
    delta = F.pow(between - (F.col("na") + F.col("nb")) / 2, 2)
    grid = a.crossJoin(b).join(o, ["v", "w"], "left").select("na", "nb", F.coalesce("o", F.lit(0.0)).alias("o"), delta.alias("d"))  # scale points squared
    total = marginal.agg(F.sum("n").alias("n"))
    sums = grid.agg(F.sum(F.col("o") * F.col("d")).alias("od"), F.sum(F.col("na") * F.col("nb") * F.col("d")).alias("ed")).crossJoin(total)
    observed, expected = F.col("od") / F.col("n"), F.col("ed") / (F.col("n") * (F.col("n") - 1))
    return sums.select(F.when(expected > 1e-12, F.round(1 - observed / expected, 3)).alias("alpha"), F.round("n", 6).alias("values"))
