"""Query-log and spend analytics over events and the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import quantiles, usage
from millrace.plans.common import EVENTS_SQL, events_log
from millrace.session import table


def a01_by_day(spark, sf_dir):
    e = events_log(spark, sf_dir)
    counts = e.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return usage.densify(counts, usage.calendar(e, "day"), ["day"], ["n", "errors"]).withColumn("day", F.col("day").cast("string"))


def a01_by_hour(spark, sf_dir):
    e = events_log(spark, sf_dir)
    counts = e.groupBy(usage.local_hour(F.col("ts")).alias("hour")).agg(F.count("*").alias("n"))
    return usage.densify(counts, spark.range(24).select(F.col("id").cast("int").alias("hour")), ["hour"], ["n"])


def a01_by_kind(spark, sf_dir):
    return events_log(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def a02_kpis(spark, sf_dir):
    e, covered = events_log(spark, sf_dir), F.col("event_type") != "error"
    sums = e.agg(
        F.count("*").alias("total"), F.round(100.0 * F.count_if(covered) / F.count("*"), 6).alias("covered_pct"),
        F.round(F.avg("value"), 6).alias("mean_value"), F.countDistinct("user_id").alias("users"),
    )
    middle = quantiles.median(e, [], "value").select(F.round("median", 6).alias("median_value"))
    return sums.join(middle, how="left").select("total", "covered_pct", "mean_value", "median_value", "users")  # one row each


def a03_counter_pivot(spark, sf_dir):
    """Counter keys are built, parsed back and pivoted; a model's name holds a colon."""
    e = events_log(spark, sf_dir)
    key = usage.usage_key("usage", F.col("day"), F.col("event_type"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("m:"), (F.col("k") % 4).cast("string")), F.when(F.col("event_id") % 2 == 0, "in").otherwise("out"))
    counters = e.groupBy(key.alias("key")).agg(F.count("*").alias("count"))
    parsed = counters.withColumn("p", usage.parse_usage_key(F.col("key"))).select("p.*", "count")
    out = parsed.groupBy("purpose", "provider", "model").pivot("metric", ["in", "out"]).agg(F.sum("count"))
    return out.select("purpose", "provider", "model", F.coalesce("in", F.lit(0)).alias("n_in"), F.coalesce("out", F.lit(0)).alias("n_out"))


def _priced(spark, sf_dir):
    """Line items as counters, brands as models: large parts have a saved price, some brands none."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_retailprice")
    saved = part.filter("p_size > 25").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("price"))
    saved = saved.filter(F.ascii(F.substring("p_brand", -1, 1)) % 3 != 0)
    fallback = part.groupBy("p_brand").agg(F.min("p_retailprice").alias("price")).filter(F.ascii(F.substring("p_brand", -1, 1)) % 5 != 0)
    counts = line.join(part.select("l_partkey", "p_brand"), "l_partkey").groupBy("p_brand", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_quantity").alias("quantity"))
    return usage.with_price(counts, saved, fallback, ["p_brand"])


def a04_spend_rollup(spark, sf_dir):
    rows = _priced(spark, sf_dir).withColumn("cost", F.col("quantity") * F.col("price"))
    rows.createOrReplaceTempView("millrace_priced")
    return spark.sql("""SELECT p_brand, month, grouping_id() AS level, round(sum(cost), 2) AS cost, sum(quantity) AS quantity, count_if(unpriced) AS unpriced
        FROM millrace_priced GROUP BY p_brand, month GROUPING SETS ((p_brand), (month), (p_brand, month), ())""").withColumn("level", F.col("level").cast("bigint"))


def a05_topn_other(spark, sf_dir):
    rows = _priced(spark, sf_dir).withColumn("cost", F.coalesce(F.col("quantity") * F.col("price"), F.lit(0.0)))
    return usage.top_n_and_other(rows, "p_brand", "month", "cost").withColumn("cost", F.round("cost", 2))


def a06_topics_rollup(spark, sf_dir):
    """Region, nation and segment counts of orders, with the ten largest segments of each nation."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "r_name", "n_name", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    by_customer = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    rolled = by_customer.join(c, "o_custkey").rollup("r_name", "n_name", "c_mktsegment").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))
    w = Window.partitionBy("r_name", "n_name").orderBy(F.desc("n"), F.asc_nulls_first("c_mktsegment"))
    return rolled.withColumn("place", F.row_number().over(w)).filter("place <= 11")


def a07_gaps(spark, sf_dir):
    """Texts grouped by their normalised wording: count, newest wording, largest size; the top 20."""
    d = table(spark, sf_dir, "documents")
    norm = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    groups = d.groupBy(F.md5(norm).alias("norm")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"), F.max_by(F.md5("text"), "doc_id").alias("newest"), F.max("n_chars").alias("largest"))
    return groups.orderBy(F.desc("n"), F.desc("last_id")).limit(usage.TOP_N)


def a09_summary(spark, sf_dir):
    """Per kind: rows, mean and the upper median (index n div 2)."""
    e = events_log(spark, sf_dir)
    stats = e.groupBy("event_type").agg(F.count("*").alias("rows"), F.round(F.avg("value"), 6).alias("mean"))
    upper = usage.index_rank(e, ["event_type"], "value", F.floor(F.col("n") / 2)).select("event_type", F.round("picked", 6).alias("upper_median"))
    return stats.join(upper, "event_type", "left")


def a15_percentiles(spark, sf_dir):
    """Per kind: the value at index min(n - 1, floor(0.9 n))."""
    e = events_log(spark, sf_dir)
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 9 / 10))
    return usage.index_rank(e, ["event_type"], "value", at).select("event_type", F.round("picked", 6).alias("p90"), "n")


def a25_mean_ci(spark, sf_dir):
    from millrace.functions.stats import mean_ci

    return events_log(spark, sf_dir).groupBy("event_type").agg(*mean_ci("value", 0.0, 1000.0))


def a41_catalog(spark, sf_dir):
    """Distinct brands with their first part and sorted sizes."""
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("first_name"), F.array_join(F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x.cast("string")), ",").alias("sizes"))


def a42_fixed_slots(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view", "other"]
    e = events_log(spark, sf_dir).groupBy("day").pivot("event_type", kinds).agg(F.count("event_id"))
    return e.select(F.col("day").cast("string").alias("day"), *(F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in kinds))


def a44_budget(spark, sf_dir):
    e = events_log(spark, sf_dir)
    kept = usage.running_budget(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value", 120.0)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("spent"))


def a47_tally(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem")
    return o.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("tokens"), F.count("*").alias("calls"))


def p05_test_traffic(spark, sf_dir):
    """Recorded kind wins; else an exact wording marks inferred test traffic."""
    e = events_log(spark, sf_dir)
    source = F.when(F.col("user_id") % 4 == 0, None).otherwise(F.col("event_type"))
    is_test = F.when(source.isNotNull(), source.isin("signup", "error")).otherwise(F.trim("props") == '{"k": 7}')
    return e.groupBy(is_test.alias("is_test"), (source.isNull() & is_test).alias("inferred")).agg(F.count("*").alias("n"))


def p06_infer_kind(spark, sf_dir):
    e = events_log(spark, sf_dir)
    kind = F.when(F.col("k") % 5 != 0, F.col("event_type")).when(F.col("value") >= 50, "course_content").when(F.col("value") > 0, "not_covered").otherwise("unknown")
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def f53_bucket_keys(spark, sf_dir):
    """Minute, day and 900-second buckets of a rate limiter."""
    e = events_log(spark, sf_dir)
    quarter = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 900).cast("bigint")
    return e.groupBy("user_id", quarter.alias("bucket")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("buckets"))


def f60_json_props(spark, sf_dir):
    """Typed JSON extraction with a validity column; nothing fails on odd values."""
    e = table(spark, sf_dir, "events")
    p = F.from_json("props", "k INT, extra STRING")
    score = p["k"] % 7
    valid = score.between(1, 5)
    return e.select("event_id", p["k"].alias("k"), F.when(valid, score).otherwise(-1).alias("score"), F.coalesce(valid, F.lit(False)).alias("valid"))


def f65_usage_payload(spark, sf_dir):
    """Missing or odd usage numbers count as 0, and negative ones too."""
    e = table(spark, sf_dir, "events")
    read = lambda path: F.greatest(F.coalesce(F.expr(f"try_cast(get_json_object(props, '{path}') AS BIGINT)"), F.lit(0)) - 20, F.lit(0))
    return e.agg(F.sum(read("$.k")).alias("tokens_in"), F.sum(read("$.none")).alias("tokens_out"))


def o08_newest(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type")


def p29_draft_gaps(spark, sf_dir):
    """Of the newest 200 rows, the uncovered ones by wording without other signs (blanks stay)."""
    e = events_log(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).filter("event_type = 'error'")
    return e.groupBy(F.regexp_replace(F.lower("props"), "[^a-z0-9 ]", "").alias("norm")).agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last")).orderBy(F.desc("n"), F.desc("last"), "norm").limit(20)


def s13_counters_since(spark, sf_dir):
    """Counters of wanted families from a day on; the day is read from the key."""
    e = events_log(spark, sf_dir)
    counters = e.groupBy(usage.usage_key("usage", F.col("day"), F.col("event_type")).alias("key")).agg(F.count("*").alias("count"))
    return counters.filter(F.col("key").startswith("usage:") & (F.split("key", ":")[1] >= "2024-01-15"))


def st05_charged_plays(spark, sf_dir):
    """The first play of a day is charged, then three repeats are free, then every one is charged."""
    e = events_log(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id", "day", "event_type").orderBy("ts", "event_id"))
    return e.withColumn("n", n).groupBy(((F.col("n") <= 1) | (F.col("n") > 4)).alias("charged")).agg(F.count("*").alias("n"))


def st01_capped_counter(spark, sf_dir):
    """Equal amounts: an increment is allowed while its number in the window is within the cap."""
    e = events_log(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return e.withColumn("n", n).groupBy("user_id").agg(F.count_if(F.col("n") <= 2).alias("allowed"), F.count_if(F.col("n") > 2).alias("refused"))


def st07_login_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    w = e.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "15 minutes")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", (F.col("n") > 1).alias("blocked"))


def st16_client_events(spark, sf_dir):
    return events_log(spark, sf_dir).filter(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type").agg(F.least(F.count("*"), F.lit(5)).alias("counted"))


def u01_override_union(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    saved = p.filter("p_size >= 40").groupBy("p_brand").agg(F.max("p_retailprice").alias("price")).filter(F.ascii(F.substring("p_brand", -1, 1)) % 2 == 0).withColumn("origin", F.lit("saved"))
    defaults = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("price")).withColumn("origin", F.lit("default"))
    return usage.override_union(saved, defaults, ["p_brand"])


def u02_first_wins(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice")
    return usage.first_wins(p, ["p_brand", "p_type"], [F.col("p_partkey")])


def w22_latest_per_kind(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return usage.first_wins(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def w13_round_robin(spark, sf_dir):
    """Round robin over kinds by frequency: first rows of every kind, then second ones."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    size = e.groupBy("event_type").agg(F.count("*").alias("n"))
    place = size.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "event_type"))).select("event_type", "rank")  # a row for each kind
    nth = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return e.withColumn("nth", nth).filter("nth <= 40").join(place, "event_type").orderBy("nth", "rank").limit(60).select("event_id", "event_type", "nth", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        a01_by_day, a01_by_hour, a01_by_kind, a02_kpis, a03_counter_pivot, a04_spend_rollup, a05_topn_other, a06_topics_rollup, a07_gaps, a09_summary, a15_percentiles, a25_mean_ci, a41_catalog, a42_fixed_slots, a44_budget, a47_tally,
        p05_test_traffic, p06_infer_kind, f53_bucket_keys, f60_json_props, f65_usage_payload, o08_newest, p29_draft_gaps, s13_counters_since, st05_charged_plays, st01_capped_counter, st07_login_window, st16_client_events, u01_override_union, u02_first_wins, w22_latest_per_kind, w13_round_robin,
    )
}

_PRICED = """part2 AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part),
saved AS (SELECT p_brand, round(avg(p_retailprice), 2) AS price FROM part2 WHERE p_size > 25 GROUP BY 1 HAVING ascii(right(p_brand, 1)) % 3 <> 0),
fb AS (SELECT p_brand, min(p_retailprice) AS price FROM part2 GROUP BY 1 HAVING ascii(right(p_brand, 1)) % 5 <> 0),
cnt AS (SELECT p_brand, strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity) AS quantity FROM lineitem JOIN part2 ON p_partkey = l_partkey GROUP BY ALL),
pr AS (SELECT cnt.*, coalesce(saved.price, fb.price) AS price, coalesce(saved.price, fb.price) IS NULL AS unpriced FROM cnt LEFT JOIN saved USING (p_brand) LEFT JOIN fb USING (p_brand))"""
SQL = {
    "a01_by_day": f"WITH {EVENTS_SQL}, c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e), n AS (SELECT day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM e GROUP BY day) SELECT c.day::VARCHAR AS day, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM c LEFT JOIN n USING (day)",
    "a01_by_hour": "WITH h AS (SELECT hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1) SELECT s.hour::INTEGER AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS hour) s LEFT JOIN h USING (hour)",
    "a01_by_kind": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "a02_kpis": "SELECT count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*), 6) AS covered_pct, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, count(DISTINCT user_id) AS users FROM events",
    "a03_counter_pivot": f"WITH {EVENTS_SQL} SELECT event_type AS purpose, 'p' || (user_id % 3) AS provider, 'm:' || (k % 4) AS model, count(*) FILTER (event_id % 2 = 0) AS n_in, count(*) FILTER (event_id % 2 <> 0) AS n_out FROM e GROUP BY ALL",
    "a04_spend_rollup": f"WITH {_PRICED}, x AS (SELECT *, quantity * price AS cost FROM pr) SELECT p_brand, month, grouping_id(p_brand, month)::BIGINT AS level, round(sum(cost), 2) AS cost, sum(quantity) AS quantity, count(*) FILTER (unpriced) AS unpriced FROM x GROUP BY GROUPING SETS ((p_brand), (month), (p_brand, month), ())",
    "a05_topn_other": f"WITH {_PRICED}, x AS (SELECT p_brand, month, sum(coalesce(quantity * price, 0)) AS cost FROM pr GROUP BY ALL), t AS (SELECT p_brand FROM x GROUP BY p_brand HAVING sum(cost) > 0 ORDER BY round(sum(cost), 6) DESC, p_brand LIMIT 7) SELECT month, CASE WHEN p_brand IN (FROM t) THEN p_brand ELSE 'Other' END AS p_brand, round(sum(cost), 2) AS cost FROM x GROUP BY ALL",
    "a06_topics_rollup": """WITH c AS (SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_name, n_name ORDER BY n DESC, c_mktsegment NULLS FIRST)::INTEGER AS place FROM c) WHERE place <= 11""",
    "a07_gaps": "SELECT md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS norm, count(*) AS n, max(doc_id) AS last_id, md5(arg_max(text, doc_id)) AS newest, max(n_chars) AS largest FROM documents GROUP BY 1 ORDER BY n DESC, last_id DESC LIMIT 20",
    "a09_summary": "SELECT event_type, count(*) AS rows, round(avg(value), 6) AS mean, round(list_sort(list(value))[count(*) // 2 + 1], 6) AS upper_median FROM events GROUP BY 1",
    "a15_percentiles": "SELECT event_type, round(list_sort(list(value))[least(count(*), count(*) * 9 // 10 + 1)], 6) AS p90, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "a25_mean_ci": "WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events GROUP BY 1) SELECT event_type, round(m, 3) AS mean, round(greatest(0, m - 1.96 * s / sqrt(n)), 3) AS low, round(least(1000, m + 1.96 * s / sqrt(n)), 3) AS high, n FROM s",
    "a41_catalog": "SELECT p_brand, arg_min(p_name, p_partkey) AS first_name, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes FROM part GROUP BY 1",
    "a42_fixed_slots": f"WITH {EVENTS_SQL} SELECT day::VARCHAR AS day, {', '.join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ('click', 'error', 'purchase', 'signup', 'view', 'other'))} FROM e GROUP BY day",
    "a44_budget": "WITH s AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) SELECT user_id, count(*) AS n, round(sum(value), 6) AS spent FROM s WHERE b < 120 GROUP BY 1",
    "a47_tally": "SELECT l_orderkey, sum(l_quantity) AS tokens, count(*) AS calls FROM lineitem GROUP BY 1",
    "p05_test_traffic": """WITH s AS (SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END AS source, props FROM events), t AS (SELECT CASE WHEN source IS NOT NULL THEN source IN ('signup', 'error') ELSE trim(props) = '{"k": 7}' END AS is_test, source FROM s)
SELECT is_test, source IS NULL AND is_test AS inferred, count(*) AS n FROM t GROUP BY ALL""",
    "p06_infer_kind": f"WITH {EVENTS_SQL} SELECT CASE WHEN k % 5 <> 0 THEN event_type WHEN value >= 50 THEN 'course_content' WHEN value > 0 THEN 'not_covered' ELSE 'unknown' END AS kind, count(*) AS n FROM e GROUP BY 1",
    "f53_bucket_keys": "WITH b AS (SELECT user_id, epoch_us(ts) // 900000000 AS bucket, count(*) AS n FROM events GROUP BY ALL) SELECT n, count(*) AS buckets FROM b GROUP BY n",
    "f60_json_props": f"WITH {EVENTS_SQL} SELECT event_id, k::INTEGER AS k, CASE WHEN k % 7 BETWEEN 1 AND 5 THEN (k % 7)::INTEGER ELSE -1 END AS score, coalesce(k % 7 BETWEEN 1 AND 5, false) AS valid FROM e",
    "f65_usage_payload": f"WITH {EVENTS_SQL} SELECT sum(greatest(coalesce(k, 0) - 20, 0))::BIGINT AS tokens_in, 0::BIGINT AS tokens_out FROM e",
    "o08_newest": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 50",
    "p29_draft_gaps": "WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT regexp_replace(lower(props), '[^a-z0-9 ]', '', 'g') AS norm, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM r WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, last DESC, norm LIMIT 20",
    "s13_counters_since": f"WITH {EVENTS_SQL} SELECT 'usage:' || strftime(day, '%Y-%m-%d') || ':' || event_type AS key, count(*) AS count FROM e WHERE strftime(day, '%Y-%m-%d') >= '2024-01-15' GROUP BY 1",
    "st05_charged_plays": f"WITH {EVENTS_SQL}, s AS (SELECT row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY ts, event_id) AS n FROM e) SELECT n <= 1 OR n > 4 AS charged, count(*) AS n FROM s GROUP BY 1",
    "st01_capped_counter": f"WITH {EVENTS_SQL}, s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS n FROM e) SELECT user_id, count(*) FILTER (n <= 2) AS allowed, count(*) FILTER (n > 2) AS refused FROM s GROUP BY 1",
    "st07_login_window": "SELECT user_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) > 1 AS blocked FROM events WHERE event_type = 'signup' GROUP BY ALL",
    "st16_client_events": "SELECT user_id, event_type, least(count(*), 5) AS counted FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL",
    "u01_override_union": "WITH s AS (SELECT p_brand, max(p_retailprice) AS price, 'saved' AS origin FROM part WHERE p_size >= 40 GROUP BY 1 HAVING ascii(right(p_brand, 1)) % 2 = 0), d AS (SELECT p_brand, min(p_retailprice) AS price, 'default' AS origin FROM part GROUP BY 1) FROM s UNION ALL SELECT * FROM d WHERE p_brand NOT IN (SELECT p_brand FROM s)",
    "u02_first_wins": "SELECT p_brand, p_type, min(p_partkey) AS p_partkey, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY ALL",
    "w22_latest_per_kind": "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY events.ts DESC, event_id DESC) = 1",
    "w13_round_robin": """WITH r AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type)::INTEGER AS rank FROM events GROUP BY 1), n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INTEGER AS nth FROM events)
SELECT event_id, event_type, nth, rank FROM n JOIN r USING (event_type) ORDER BY nth, rank LIMIT 60""",
}
