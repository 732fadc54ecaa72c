"""Time-series queries over events and conversations; seconds are counted from the first day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import table_functions
from millrace.operators import series, usage
from millrace.session import table

_DAY0 = 1_704_067_200


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return e.withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - _DAY0).cast("double"))


def _windows(spark, sf_dir):
    """Around each purchase of a user: from one hour before it to a while after, by its value."""
    e = _events(spark, sf_dir).filter("event_type = 'purchase'")
    return e.select("user_id", F.col("event_id").alias("window_id"), (F.col("t") - 3600.0).alias("start"), (F.col("t") + 3600.0 * (1 + F.floor(F.col("value") % 12))).alias("end"))


def w10_runs(spark, sf_dir):
    runs = series.islands(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type")
    return runs.groupBy("user_id", "run", "event_type").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


def x11_runs_in_sql(spark, sf_dir):
    """The same runs by the table function, from SQL."""
    table_functions.register(spark)
    _events(spark, sf_dir).createOrReplaceTempView("millrace_events")
    return spark.sql("SELECT key AS user_id, run, label AS event_type, first, last, n FROM label_runs(TABLE(SELECT user_id, t, event_type, event_id FROM millrace_events) PARTITION BY user_id ORDER BY (t, event_id))")


def x11_chunks_in_sql(spark, sf_dir):
    """Turns of a conversation in chunks of at most 800 characters."""
    table_functions.register(spark)
    table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "length(text) AS size").createOrReplaceTempView("millrace_turns")
    return spark.sql("SELECT key AS conv_id, chunk, first, last, size FROM greedy_chunks(TABLE(SELECT conv_id, turn, CAST(size AS BIGINT) AS size FROM millrace_turns) PARTITION BY conv_id ORDER BY (turn), 800)")


def w07_raw_labels(spark, sf_dir):
    label = F.when((F.col("value") >= 50) | ((F.col("value") >= 20) & (F.col("event_id") % 3 == 0)), (F.col("user_id") % 4).cast("int")).otherwise(-1)
    return _events(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def w09_smooth(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("label", F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 1).otherwise(2))
    out = series.smooth_labels(e, ["user_id"], ["t", "event_id"], "label", 2)
    return out.select("event_id", "label", "smooth")


def w11_merge_windows(spark, sf_dir):
    return series.merge_windows(_windows(spark, sf_dir).drop("window_id"), ["user_id"], "start", "end", 5 * 3600.0)


def w12_complement(spark, sf_dir):
    return series.complement(_windows(spark, sf_dir).drop("window_id"), ["user_id"], "start", "end", F.lit(30 * 86400.0))


def w14_chunks(spark, sf_dir):
    merged = series.merge_windows(_windows(spark, sf_dir).drop("window_id"), ["user_id"], "start", "end", 0.0)
    return series.equal_chunks(merged, "start", "end", 7200.0, 3600.0).select("user_id", "i", F.round("chunk_start", 3).alias("chunk_start"), F.round("chunk_end", 3).alias("chunk_end"))


def w18_usable_spans(spark, sf_dir):
    """Runs of events without errors: an error splits a user's span."""
    e = _events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    runs = series.islands(e, ["user_id"], ["t", "event_id"], "ok").filter("ok")
    return runs.groupBy("user_id", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"))


def w19_longest(spark, sf_dir):
    spans = w18_usable_spans(spark, sf_dir).withColumn("length", F.col("last") - F.col("first"))
    return usage.first_wins(spans, ["user_id"], [F.desc("length"), F.col("first")])


def w23_prefix_timings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("weight"))
    out = series.prefix_share(c, ["conv_id"], ["turn"], "weight")
    return out.select("conv_id", "turn", F.round("share", 6).alias("share"))


def w28_reading_order(spark, sf_dir):
    """Lines by rounded top, words by place within a line."""
    e = _events(spark, sf_dir).withColumn("top", F.round(F.col("value") / 100, 1))
    line = F.dense_rank().over(Window.partitionBy("user_id").orderBy("top"))
    return e.select("event_id", line.alias("line"), F.row_number().over(Window.partitionBy("user_id", "top").orderBy("t", "event_id")).alias("word"))


def j09_point_in_window(spark, sf_dir):
    points = _events(spark, sf_dir).select("user_id", "event_id", "t")
    joined = series.point_in_window(points, _windows(spark, sf_dir), ["user_id"], "t", "start", "end", 6 * 3600.0)
    return joined.groupBy("event_id").agg(F.count("*").alias("windows"), F.min("window_id").alias("first_window"))


def j10_override_labels(spark, sf_dir):
    """Closed ranges override a label; the later range wins."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "t")
    ranges = _windows(spark, sf_dir).withColumn("end", F.col("end") + 0.001)
    hit = series.point_in_window(e, ranges, ["user_id"], "t", "start", "end", 6 * 3600.0).groupBy("event_id").agg(F.max("window_id").alias("by"))
    return e.join(hit, "event_id", "left").groupBy(F.coalesce(F.concat(F.lit("override"), (F.col("by") % 3).cast("string")), "event_type").alias("label")).agg(F.count("*").alias("n"))


def j11_overlap(spark, sf_dir):
    w = _windows(spark, sf_dir)
    left = w.select("user_id", F.col("window_id").alias("a"), F.col("start").alias("ls"), F.col("end").alias("le"))
    right = w.select("user_id", F.col("window_id").alias("b"), F.col("start").alias("rs"), F.col("end").alias("re"))
    return series.overlaps(left, right, ["user_id"], 6 * 3600.0, 60.0).filter("a < b").select("user_id", "a", "b")


def j15_asof_prev_next(spark, sf_dir):
    """The purchases before and after each error of a user."""
    out = series.asof(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], F.col("event_type") == "purchase", "event_id")
    return out.filter("event_type = 'error'").select("event_id", F.coalesce("prev", F.lit(-1)).alias("prev"), F.coalesce("next", F.lit(-1)).alias("next"))


def j21_repeat_within(spark, sf_dir):
    """Events within two hours of the previous one of the same user and kind."""
    w = Window.partitionBy("user_id", "event_type").orderBy("t", "event_id")
    e = _events(spark, sf_dir).withColumn("since", F.col("t") - F.lag("t").over(w))
    return e.groupBy((F.coalesce("since", F.lit(1e12)) <= 7200.0).alias("repeat")).agg(F.count("*").alias("n"))


def j24_locate(spark, sf_dir):
    """The part of a whole that a place lies in: cumulative offsets and a range join."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = c.select("conv_id", "turn", before.alias("start"), (before + F.col("size")).alias("end"))
    places = parts.groupBy("conv_id").agg(F.max("end").alias("end")).select("conv_id", F.explode(F.array(F.floor(F.col("end") / 3).cast("double"), F.floor(F.col("end") / 2).cast("double"))).alias("at"))
    return series.point_in_window(places, parts, ["conv_id"], "at", "start", "end", 1000.0).select("conv_id", "at", "turn")


def a38_minutes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.round(F.sum(F.length("text")) / 60.0, 6).alias("minutes"))


def a40_motion(spark, sf_dir):
    """Share of neighbouring events whose value changed by more than 10, and a weighted mean."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _events(spark, sf_dir).withColumn("step", F.abs(F.col("value") - F.lag("value").over(w)))
    return e.groupBy("user_id").agg(F.round(F.avg((F.col("step") > 10).cast("int")), 6).alias("motion"), F.round(F.try_divide(F.sum(F.col("value") * (F.col("event_id") % 5)), F.sum(F.col("event_id") % 5)), 6).alias("weighted"))


QUERIES = {
    f.__name__: f
    for f in (
        w10_runs, x11_runs_in_sql, x11_chunks_in_sql, w07_raw_labels, w09_smooth, w11_merge_windows, w12_complement, w14_chunks, w18_usable_spans, w19_longest, w23_prefix_timings, w28_reading_order, j09_point_in_window, j10_override_labels, j11_overlap, j15_asof_prev_next,
        j21_repeat_within, j24_locate, a38_minutes, a40_motion,
    )
}

_E = f"e AS (SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) / 1000000.0::DOUBLE - {_DAY0} AS t FROM events)"
_W = f"{_E}, w AS (SELECT user_id, event_id AS window_id, t - 3600.0 AS start, t + 3600.0 * (1 + floor(value % 12)) AS \"end\" FROM e WHERE event_type = 'purchase')"


def _islands(label: str, name: str = "i", source: str = "e") -> str:
    order = "PARTITION BY user_id ORDER BY t, event_id"
    return f"{name}0 AS (SELECT *, CASE WHEN row_number() OVER ({order}) = 1 THEN 0 WHEN {label} IS DISTINCT FROM lag({label}) OVER ({order}) THEN 1 ELSE 0 END AS ch FROM {source}), {name} AS (SELECT *, (sum(ch) OVER ({order} ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM {name}0)"


def _merge(gap: str) -> str:
    order = 'PARTITION BY user_id ORDER BY start, "end"'
    return f"""m0 AS (SELECT *, coalesce((start > max("end") OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap})::INT, 0) AS new FROM w),
m1 AS (SELECT *, (sum(new) OVER ({order} ROWS UNBOUNDED PRECEDING))::BIGINT AS piece FROM m0), m AS (SELECT user_id, piece, min(start) AS start, max("end") AS "end", count(*) AS n FROM m1 GROUP BY ALL)"""


_SPANS = f"{_E.replace('FROM events', 'FROM events')}, k AS (SELECT *, event_type <> 'error' AS ok FROM e), {_islands('ok', source='k')}, s AS (SELECT user_id, run, min(t) AS first, max(t) AS last FROM i WHERE ok GROUP BY ALL)"
SQL = {
    "x11_runs_in_sql": f"WITH {_E}, {_islands('event_type')} SELECT user_id, run, event_type, min(t) AS first, max(t) AS last, count(*)::INTEGER AS n FROM i GROUP BY ALL",
    "x11_chunks_in_sql": """WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, size, size AS total, 0 AS chunk FROM s WHERE i = 1
  UNION ALL SELECT s.conv_id, s.turn, s.i, s.size, CASE WHEN r.total > 0 AND r.total + s.size > 800 THEN s.size ELSE r.total + s.size END, r.chunk + (r.total > 0 AND r.total + s.size > 800)::INTEGER FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
SELECT conv_id, chunk, min(turn) AS first, max(turn) AS last, sum(size)::BIGINT AS size FROM r GROUP BY conv_id, chunk""",
    "w10_runs": f"WITH {_E}, {_islands('event_type')} SELECT user_id, run, event_type, min(t) AS first, max(t) AS last, count(*) AS n FROM i GROUP BY ALL",
    "w07_raw_labels": f"WITH {_E} SELECT CASE WHEN value >= 50 OR (value >= 20 AND event_id % 3 = 0) THEN (user_id % 4)::INTEGER ELSE -1 END AS label, count(*) AS n FROM e GROUP BY 1",
    "w09_smooth": f"""WITH {_E}, l AS (SELECT *, CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 1 ELSE 2 END AS label FROM e),
b AS (SELECT *, CASE WHEN label < 0 AND lag(label) OVER w = lead(label) OVER w AND lag(label) OVER w >= 0 THEN lag(label) OVER w ELSE label END AS sm FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), {_islands('sm', source='b')}
SELECT event_id, label, CASE WHEN sm >= 0 AND count(*) OVER (PARTITION BY user_id, run) < 2 THEN -1 ELSE sm END AS smooth FROM i""",
    "w11_merge_windows": f"WITH {_W}, {_merge('18000.0')} SELECT * FROM m",
    "w12_complement": f"""WITH {_W}, {_merge('0.0')}, g AS (SELECT user_id, coalesce(lag("end") OVER (PARTITION BY user_id ORDER BY start), 0) AS a, start AS b FROM m UNION ALL SELECT user_id, max("end"), 2592000.0 FROM m GROUP BY 1)
SELECT user_id, greatest(a, 0) AS gap_start, least(b, 2592000.0) AS gap_end FROM g WHERE greatest(a, 0) < least(b, 2592000.0)""",
    "w14_chunks": f"""WITH {_W}, {_merge('0.0')}, c AS (SELECT *, greatest(ceil(("end" - start) / 7200.0), 1) AS k FROM m WHERE "end" - start >= 3600.0), x AS (SELECT *, unnest(range(k::BIGINT))::INTEGER AS i FROM c)
SELECT user_id, i, round(start + i * (("end" - start) / k), 3) AS chunk_start, round(start + (i + 1) * (("end" - start) / k), 3) AS chunk_end FROM x""",
    "w18_usable_spans": f"WITH {_SPANS} SELECT * FROM s",
    "w19_longest": f"WITH {_SPANS} SELECT *, last - first AS length FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last - first DESC, first) = 1",
    "w23_prefix_timings": "SELECT conv_id, turn, round(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(length(text)) OVER (PARTITION BY conv_id)::DOUBLE, 6) AS share FROM conversations",
    "w28_reading_order": f"WITH {_E}, l AS (SELECT *, round(value / 100, 1) AS top FROM e) SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY top)::INTEGER AS line, row_number() OVER (PARTITION BY user_id, top ORDER BY t, event_id)::INTEGER AS word FROM l",
    "j09_point_in_window": f'WITH {_W} SELECT event_id, count(*) AS windows, min(window_id) AS first_window FROM e JOIN w ON e.user_id = w.user_id AND t >= start AND t < "end" GROUP BY 1',
    "j10_override_labels": f"""WITH {_W}, h AS (SELECT event_id, max(window_id) AS b FROM e JOIN w ON e.user_id = w.user_id AND t >= start AND t < "end" + 0.001 GROUP BY 1)
SELECT coalesce('override' || (b % 3), event_type) AS label, count(*) AS n FROM e LEFT JOIN h USING (event_id) GROUP BY 1""",
    "j11_overlap": f'WITH {_W} SELECT x.user_id, x.window_id AS a, y.window_id AS b FROM w x JOIN w y ON x.user_id = y.user_id AND x.window_id < y.window_id AND x."end" > y.start - 60 AND x.start < y."end" + 60',
    "j15_asof_prev_next": f"""WITH {_E}, a AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM e)
SELECT event_id, coalesce(p, -1) AS prev, coalesce(n, -1) AS next FROM a WHERE event_type = 'error'""",
    "j21_repeat_within": f"WITH {_E}, s AS (SELECT t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS since FROM e) SELECT coalesce(since, 1e12) <= 7200.0 AS repeat, count(*) AS n FROM s GROUP BY 1",
    "j24_locate": """WITH c AS (SELECT conv_id, turn, length(text)::DOUBLE AS size FROM conversations), p AS (SELECT conv_id, turn, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM c),
a AS (SELECT conv_id, unnest([floor(max(e) / 3), floor(max(e) / 2)]) AS place FROM p GROUP BY 1) SELECT a.conv_id, place AS "at", turn FROM a JOIN p ON a.conv_id = p.conv_id AND place >= s AND place < e""",
    "a38_minutes": "SELECT role, round(sum(length(text)) / 60.0::DOUBLE, 6) AS minutes FROM conversations GROUP BY 1",
    "a40_motion": f"WITH {_E}, s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS step FROM e) SELECT user_id, round(avg((step > 10)::INT), 6) AS motion, round(CASE WHEN sum(event_id % 5) > 0 THEN sum(value * (event_id % 5)) / sum(event_id % 5)::DOUBLE END, 6) AS weighted FROM s GROUP BY 1",
}
