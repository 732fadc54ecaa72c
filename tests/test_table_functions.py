"""Table functions equal the DataFrame forms."""

import random

from pyspark.sql import functions as F

from millrace.functions import table_functions
from millrace.operators import recurrences, series


def test_runs_and_chunks(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 6), float(i), rng.choice(["a", "b", None]), rng.choice([None, 0, 5, 40, 900])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t double, label string, size long")
    table_functions.register(spark)
    df.createOrReplaceTempView("rows")
    runs = spark.sql("SELECT * FROM label_runs(TABLE(SELECT k, t, label FROM rows) PARTITION BY k ORDER BY t)")
    want = series.islands(df, ["k"], ["t"], "label").groupBy("k", "run", "label").agg(F.min("t"), F.max("t"), F.count("*"))
    assert sorted(map(repr, map(tuple, runs.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    chunks = spark.sql("SELECT * FROM greedy_chunks(TABLE(SELECT k, CAST(t AS BIGINT) AS t, size FROM rows) PARTITION BY k ORDER BY (t), 100)")
    want = recurrences.greedy_batches(df, ["k"], ["t"], "size", 100).groupBy("k", "batch").agg(F.min("t").cast("long"), F.max("t").cast("long"), F.coalesce(F.sum("size"), F.lit(0)))
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT * FROM label_runs(TABLE(SELECT k, t, label FROM rows WHERE k > 99) PARTITION BY k ORDER BY t)").count() == 0
