"""Join shapes, snapshots and set operations over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import snapshots
from millrace.operators.scratch import shared_folder
from millrace.session import table
from millrace.sources.versions import VersionedTable


def j01_last_wins_left(spark, sf_dir):
    """Customers with their last order: of several rows of one key the last one counts."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    last = snapshots.last_wins(o, ["c_custkey"], F.col("o_orderkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(last, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), F.coalesce("o_totalprice", F.lit(0.0)).alias("price"))


def j02_related_in_order(spark, sf_dir):
    """A list of ids exploded, those that exist kept, and put together in their order."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array((F.col("p_partkey") * 7 % 5000), F.col("p_size").cast("bigint"), (F.col("p_partkey") + 1)).alias("related"))
    rows = p.select("p_partkey", F.posexplode("related").alias("i", "r"))
    have = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("r")).filter("r % 3 <> 0")
    kept = rows.join(have, "r", "left_semi").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("l"))  # three at most
    return kept.select("p_partkey", F.array_join(F.transform("l", lambda x: x["r"].cast("string")), ",").alias("related"))


def j03_price_fallback(spark, sf_dir):
    """Brands' line items priced by the saved list, then by the live one, else not at all."""
    from millrace.plans.log_queries import _priced

    return _priced(spark, sf_dir).groupBy("p_brand").agg(F.max("price").alias("price"), F.sum("quantity").alias("quantity"), F.max("unpriced").alias("unpriced")).withColumn("price", F.coalesce("price", F.lit(-1.0)))


def j04_left_titles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey", "left").groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment")).agg(F.sum("n").alias("n"))


def j05_full_outer_catalog(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("customers")).filter("key % 4 <> 0")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("suppliers")).filter("key % 3 <> 0")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name").filter("key % 5 <> 0")
    out = n.join(c, "key", "full_outer").join(s, "key", "full_outer")
    return out.select("key", F.coalesce("n_name", F.lit("?")).alias("name"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def j17_anti(spark, sf_dir):
    """Customers without a large order of the first priority."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%' AND o_totalprice > 100000")
    return table(spark, sf_dir, "customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def _customers(spark, sf_dir) -> VersionedTable:
    """Customers as a versioned table: committed, updated twice where a condition holds, and once in vain."""
    out = VersionedTable(spark, shared_folder(spark, "versions"))
    out.commit(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "first")
    low = F.col("c_acctbal") < 0
    out.update(low, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.concat(F.lit("low "), F.col("c_mktsegment"))}, "no debts")
    out.update(F.col("c_mktsegment").startswith("low ") & (F.col("c_custkey") % 2 == 0), {"c_acctbal": F.lit(1.5)}, "a gift")
    out.update(low, {"c_acctbal": F.lit(9.0)}, "never")
    return out


def s08_conditional_update(spark, sf_dir):
    return _customers(spark, sf_dir).read()


def r04_history(spark, sf_dir):
    """Versions after an older one was restored, the newest first."""
    held = _customers(spark, sf_dir)
    held.restore(1)
    rows = [(e.number, e.rows, e.note, e.restored or 0) for e in held.history()]
    sums = {n: held.read(n).agg(F.round(F.sum("c_acctbal"), 2)).first()[0] for n, *_ in rows}
    return spark.createDataFrame([(*r, sums[r[0]]) for r in rows], "version int, rows long, note string, restored int, total double")


def j18_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def j23_expected_shown(spark, sf_dir):
    """Brands two customers' segments have in common, as arrays."""
    p = table(spark, sf_dir, "part")
    a = p.groupBy("p_type").agg(F.collect_set("p_brand").alias("b"))
    first = p.filter("p_size <= 10").groupBy("p_type").agg(F.collect_set("p_brand").alias("e"))
    return a.join(first, "p_type").select("p_type", F.size(F.array_intersect("b", "e")).alias("common"), F.size(F.array_except("b", "e")).alias("other"))


def j22_best_match(spark, sf_dir):
    """For each part type the supplier nation nearest in size of name (ties: the first)."""
    t = table(spark, sf_dir, "part").select("p_type").distinct()
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    best = t.crossJoin(F.broadcast(n)).withColumn("gap", F.abs(F.length("p_type") - F.length("n_name")))  # 25 nations
    return best.groupBy("p_type").agg(F.min_by("n_nationkey", F.struct("gap", "n_nationkey")).alias("n_nationkey"))


def s16_base_and_delta(spark, sf_dir):
    """A base table and the delta rows that it lacks."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    base, delta = e.filter("event_id % 3 <> 0"), e.filter("event_id % 2 = 0")
    out = base.unionByName(snapshots.missing(delta, base, ["event_id"]))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def s17_override(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = snapshots.upsert(e, e.filter("event_id % 5 = 0").withColumn("event_type", F.lit("own")), ["event_id"])
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def s18_replay(spark, sf_dir):
    """Lines with their last edit, and lines that edits add."""
    e = table(spark, sf_dir, "events")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), F.col("c_mktsegment").alias("record"))
    edits = e.select((F.col("user_id") * 11).alias("line"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("record"))
    return snapshots.replay(base, edits, "line", "ord", "record")


def s30_cache(spark, sf_dir):
    """Texts not in a cache, each once, by content."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.lit("model-a"), "text"), 256).alias("key"))
    cache = d.filter("doc_id % 2 = 0").select("key").distinct()
    return snapshots.missing(d, cache, ["key"]).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def s32_publish_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 7 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    new = d.filter("doc_id % 13 <> 0").select("doc_id", F.md5("text").alias("h"))
    return snapshots.diff(old, new, "doc_id", "h")


def s36_course_facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return o.groupBy("o_orderstatus", "year").agg(F.count("*").alias("sessions"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"))


def st11_latest_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def u07_sets(spark, sf_dir):
    """Users who view and buy, who view and do not, by INTERSECT and EXCEPT."""
    e = table(spark, sf_dir, "events")
    who = lambda k: e.filter(F.col("event_type") == k).groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 12").select("user_id")
    views, buys = who("view"), who("purchase")
    return views.intersect(buys).withColumn("set", F.lit("both")).unionByName(views.exceptAll(buys).withColumn("set", F.lit("views")))


def q_star_revenue(spark, sf_dir):
    """Revenue by region and year over the whole star."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per_order = line.groupBy("o_orderkey").agg(F.sum("revenue").alias("revenue"))
    return per_order.join(o, "o_orderkey").join(c, "o_custkey").join(n, "n_nationkey").groupBy("r_name", "year").agg(F.round(F.sum("revenue"), 0).alias("revenue"))


def w21_anchors(spark, sf_dir):
    """Rows between two anchors count where both sides are as far apart in place as in rank."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    anchor = F.when(F.col("role") == "assistant", F.col("turn"))
    prev = F.coalesce(F.last(anchor, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    after = F.first(anchor, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return c.select("conv_id", "turn", (F.coalesce(after, F.col("turn") + 1) - prev).alias("span"))


QUERIES = {
    f.__name__: f
    for f in (
        j01_last_wins_left, j02_related_in_order, j03_price_fallback, j04_left_titles, j05_full_outer_catalog, j17_anti, s08_conditional_update, r04_history, j18_semi, j22_best_match, j23_expected_shown, s16_base_and_delta, s17_override, s18_replay, s30_cache, s32_publish_diff,
        s36_course_facts, st11_latest_status, u07_sets, q_star_revenue, w21_anchors,
    )
}

from millrace.plans.log_queries import _PRICED  # noqa: E402

SQL = {
    "j01_last_wins_left": "WITH l AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) SELECT c_custkey, c_name, coalesce(k, -1) AS o_orderkey, coalesce(p, 0) AS price FROM customer LEFT JOIN l ON o_custkey = c_custkey",
    "j02_related_in_order": "WITH r AS (SELECT p_partkey, unnest([0, 1, 2]) AS i, unnest([p_partkey * 7 % 5000, p_size::BIGINT, p_partkey + 1]) AS r FROM part) SELECT r.p_partkey, string_agg(r::VARCHAR, ',' ORDER BY i) AS related FROM r WHERE r IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0) GROUP BY 1",
    "j03_price_fallback": f"WITH {_PRICED} SELECT p_brand, coalesce(max(price), -1) AS price, sum(quantity) AS quantity, bool_or(unpriced) AS unpriced FROM pr GROUP BY 1",
    "j04_left_titles": "SELECT coalesce(c_mktsegment, 'unknown') AS segment, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey GROUP BY 1",
    "j05_full_outer_catalog": """WITH c AS (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1 HAVING k % 4 <> 0), s AS (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1 HAVING k % 3 <> 0), n AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey % 5 <> 0)
SELECT coalesce(n.k, c.k, s.k) AS key, coalesce(n_name, '?') AS name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM n FULL JOIN c ON n.k = c.k FULL JOIN s ON s.k = coalesce(n.k, c.k)""",
    "s08_conditional_update": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low ' ELSE '' END || c_mktsegment AS c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN 1.5 ELSE 0 END::DOUBLE AS c_acctbal FROM customer",
    "r04_history": """WITH s AS (SELECT count(*) AS n, sum(c_acctbal) AS a, sum(greatest(c_acctbal, 0)) AS b, sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN 1.5 ELSE 0 END) AS c FROM customer),
v(version, note, restored) AS (VALUES (1, 'first', 0), (2, 'no debts', 0), (3, 'a gift', 0), (4, 'Restored version 1.', 1))
SELECT version, n AS rows, note, restored, round(CASE version WHEN 2 THEN b WHEN 3 THEN c ELSE a END, 2)::DOUBLE AS total FROM v, s""",
    "j17_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 100000)",
    "j18_semi": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1",
    "j22_best_match": "SELECT p_type, arg_min(n_nationkey, (abs(length(p_type) - length(n_name)), n_nationkey)) AS n_nationkey FROM (SELECT DISTINCT p_type FROM part), nation GROUP BY 1",
    "j23_expected_shown": "WITH a AS (SELECT DISTINCT p_type, p_brand FROM part), e AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size <= 10) SELECT p_type, count(e.p_brand)::INTEGER AS common, (count(*) - count(e.p_brand))::INTEGER AS other FROM a LEFT JOIN e USING (p_type, p_brand) WHERE p_type IN (SELECT p_type FROM e) GROUP BY 1",
    "s16_base_and_delta": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0 GROUP BY 1",
    "s17_override": "SELECT CASE WHEN event_id % 5 = 0 THEN 'own' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1",
    "s18_replay": "WITH e AS (SELECT user_id * 11 AS line, arg_max(event_type, (ts, event_id)) AS record FROM events GROUP BY 1) SELECT coalesce(c_custkey, line) AS line, coalesce(record, c_mktsegment) AS record FROM customer FULL JOIN e ON c_custkey = line",
    "s30_cache": "WITH d AS (SELECT doc_id, sha256(concat_ws('|', 'model-a', text)) AS key FROM documents) SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM d WHERE key NOT IN (SELECT key FROM d WHERE doc_id % 2 = 0) GROUP BY 1",
    "s32_publish_diff": "WITH o AS (SELECT doc_id, md5(text || CASE WHEN doc_id % 11 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 13 <> 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h",
    "s36_course_facts": "SELECT o_orderstatus, year(o_orderdate)::INTEGER AS year, count(*) AS sessions, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders GROUP BY ALL",
    "st11_latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1",
    "u07_sets": "WITH w AS (SELECT user_id, count(*) FILTER (event_type = 'view') >= 12 AS v, count(*) FILTER (event_type = 'purchase') >= 12 AS b FROM events GROUP BY 1) SELECT user_id, CASE WHEN b THEN 'both' ELSE 'views' END AS set FROM w WHERE v",
    "q_star_revenue": "SELECT r_name, year(o_orderdate)::INTEGER AS year, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
    "w21_anchors": """WITH a AS (SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS p,
  first_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM conversations) SELECT conv_id, turn, coalesce(n, turn + 1) - p AS span FROM a""",
}
