"""Distributed selection against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles


@pytest.mark.parametrize("cuts, small", [(256, 4096), (4, 5), (16, 1)])
def test_places(spark, cuts, small):
    rng = random.Random(cuts)
    groups = {
        "spread": [rng.gauss(0, 50) for _ in range(900)],
        "ties": [float(rng.randint(0, 3)) for _ in range(700)],
        "heavy": [5.0] * 500 + [rng.random() * 10 for _ in range(60)],
        "odd": [float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 1e300] * 9,
        "one": [3.0],
        None: [1.0, 2.0],
    }
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("none", None, "x"), ("one", None, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, x double, name string").repartition(6)
    n = F.col("n")
    places = {"low": F.lit(0), "mid": F.floor(n / 2), "p90": F.least(n - 1, F.floor(n * 9 / 10)), "beyond": n}
    got = {r["kind"]: r for r in quantiles.at_places(df, ["kind"], "x", places, cuts, small).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        held = sorted(values, key=lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v))
        size = len(held)
        want = [held[0], held[size // 2], held[min(size - 1, size * 9 // 10)]]
        assert got[g]["n"] == size and got[g]["beyond"] is None
        for name, w in zip(("low", "mid", "p90"), want, strict=True):
            assert got[g][name] == w or math.isnan(got[g][name]) and math.isnan(w), (g, name)


def test_median_of_all_and_of_nothing(spark):
    df = spark.range(10_001).select(F.pmod(F.col("id") * 7919, F.lit(10_001)).alias("v"))
    assert quantiles.median(df, [], "v").first()["median"] == 5000
    assert quantiles.median(df.filter("v < 10000"), [], "v").first()["median"] == 4999.5
    assert quantiles.median(df.limit(0), [], "v").count() == 0
