"""Streams over the events table run to their end, and rules that are sequential for each key."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import recurrences
from millrace.operators.admission import Quota, admit
from millrace.operators.scratch import shared_folder
from millrace.plans.common import events_log
from millrace.plans.series_queries import _DAY0, _events
from millrace.session import table
from millrace.sources import readers
from millrace.streaming import jobs


def _work(spark) -> str:
    return shared_folder(spark, "stream")


def _stream(spark, sf_dir):
    return jobs.event_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")


def st08_metering_window(spark, sf_dir):
    """Daily sums by kind from a file stream; they equal the batch result."""
    work = _work(spark)
    out = jobs.run_complete(jobs.metering(_stream(spark, sf_dir), "ts", ["event_type"], "value"), f"{work}/out", f"{work}/cp")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def st17_sessions(spark, sf_dir):
    """Session windows: an extension, the rules above have none."""
    work = _work(spark)
    out = jobs.run_to_end(jobs.sessions(_stream(spark, sf_dir), "ts", "user_id", "6 hours", "0 seconds"), f"{work}/out", f"{work}/cp")
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


def st02_amount_cap(spark, sf_dir):
    """Unequal amounts with a cap of 300 for each user: a refused one uses nothing up."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "t", "value")
    return recurrences.capped_counter(e, ["user_id"], ["t", "event_id"], "value", 300.0).select("event_id", "allowed", F.round("count", 6).alias("count"))


def st01_expiring_counter(spark, sf_dir):
    """A cap of 150 on counters of users that live two days: a stream run to its end."""
    work = _work(spark)
    out = jobs.run_to_end(jobs.capped_counter(_stream(spark, sf_dir), "user_id", ["event_id"], "ts", "value", 150.0, 2 * 86400.0), f"{work}/out", f"{work}/cp")
    return out.select("event_id", "allowed", F.round("count", 6).alias("count"))


def st01_expiring_batch(spark, sf_dir):
    """The same by the batch twin, for each kind of event and three days."""
    e = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "t", "value")
    out = recurrences.capped_counter(e, ["user_id", "event_type"], ["t", "event_id"], "value", 100.0, "t", 3 * 86400.0)
    return out.select("event_id", "allowed", F.round("count", 6).alias("count"))


def _requests(spark, sf_dir):
    """Events as requests: the user is the visitor, the number in props the address."""
    e = events_log(spark, sf_dir).select("event_id", "user_id", F.col("k").alias("address"), "event_type", "value", "ts")
    return e.withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - _DAY0).cast("double"))


def st03_address_windows(spark, sf_dir):
    """Visitors and their addresses, an hour and a day each: all four windows or none."""
    quotas = [Quota(("user_id",), 3600.0, 1), Quota(("user_id",), 86400.0, 2), Quota(("address",), 3600.0, 2), Quota(("address",), 86400.0, 3)]
    return admit(_requests(spark, sf_dir), "event_id", ["t", "event_id"], "t", quotas).select("event_id", "allowed")


def st04_voice_pools(spark, sf_dir):
    """Characters of two pools a day, of which a visitor and an address may use a quarter each."""
    r = _requests(spark, sf_dir).withColumns({"pool": F.when(F.col("event_type") == "view", "free").otherwise("voice"), "chars": (1 + F.floor("value")).cast("long")})
    quotas = [Quota(("pool", "user_id"), 86400.0, 75), Quota(("pool", "address"), 86400.0, 75), Quota(("pool",), 86400.0, 300)]
    return admit(r, "event_id", ["t", "event_id"], "t", quotas, "chars").select("event_id", "chars", "allowed")


def st03_admission(spark, sf_dir):
    """One request an hour and three a day, both or neither."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "t")
    return recurrences.multi_window_admission(e, "user_id", ["t", "event_id"], "t", {3600.0: 1, 86400.0: 3}).select("event_id", "allowed")


def st06_alert_dedupe(spark, sf_dir):
    """Repeats within a day of the last alert of the same user and kind."""
    e = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "t")
    return recurrences.dedupe_alerts(e, ["user_id", "event_type"], ["t", "event_id"], "t", 86400.0).select("event_id", "repeat")


def w15_merge_cues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 9).alias("end"), "text")
    return recurrences.merge_cues(c, ["conv_id"], "start", "end", "text", 1.5, 400).select("conv_id", "start", "end", F.length("text").alias("n"))


def w26_monotone_path(spark, sf_dir):
    """Turns of a conversation aligned with the quarters of its words, never going back."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("chunk"), F.length("text").alias("n"))
    cells = c.withColumn("page", F.explode(F.array(*(F.lit(i) for i in range(4))))).withColumn("score", ((F.col("n") * (F.col("page") + 3)) % 17).cast("double") / 17)
    return recurrences.align_monotone(cells, "conv_id", "chunk", "page", "score", 0.05)


def w08_duplicate_frames(spark, sf_dir):
    """Events as frames, whose pages look alike in threes; errors show no page."""
    page = F.when(F.col("event_type") == "error", -1).otherwise((F.col("value") % 9).cast("int"))
    e = _events(spark, sf_dir).select("user_id", "event_id", "t", page.alias("page"))
    first = F.floor(F.col("page") / 3).cast("int") * 3
    e = e.withColumn("alike", F.when(F.col("page") >= 0, F.sequence(first, first + 2)))
    return recurrences.resolve_duplicates(e, ["user_id"], ["t", "event_id"], "page", "alike").select("event_id", "page", "resolved")


def w16_spans(spark, sf_dir):
    """Events between a signup and the next purchase of a user, three days at most."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "t", (F.col("event_type") == "signup").alias("opens"), (F.col("event_type") == "purchase").alias("closes"))
    return recurrences.mark_spans(e, ["user_id"], ["t", "event_id"], "t", "opens", "closes", 3 * 86400.0).select("event_id", "inside")


def w24_word_places(spark, sf_dir):
    """The words of each turn, every third one left out, found again in its text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    said = c.select("conv_id", "turn", "text", F.posexplode(F.split("text", r"\s+")).alias("i", "word")).filter("i % 3 <> 2")
    said = said.withColumn("text", F.when(F.col("i") == 0, F.col("text")))
    out = recurrences.word_places(said.withColumn("t", F.col("i") / 2.0), ["conv_id", "turn"], ["i"], "text", "t", "word")
    return out.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.sum("place").alias("places"))


def r01_word_diff(spark, sf_dir):
    """Each document against the one before: words kept, removed and added, and whether the parts give the
    later text back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = d.join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before")).hint("merge"), "doc_id")
    held = pairs.select("doc_id", "text", F.explode(F.array(recurrences.word_diff(F.col("before"), F.col("text")))).alias("parts"))
    joined = lambda ops: F.array_join(F.transform(F.filter("parts", lambda p: p["op"].isin(*ops)), lambda p: p["text"]), "")
    count = lambda op: F.regexp_count(F.array_join(F.transform(F.filter("parts", lambda p: p["op"] == op), lambda p: p["text"]), " "), F.lit(r"\S+"))
    return held.select("doc_id", count("=").alias("kept"), count("-").alias("removed"), count("+").alias("added"), (joined(["=", "+"]) == F.col("text")).alias("whole"))


def w30_highlights(spark, sf_dir):
    """Words of a turn that light up while the next turn of its conversation is read."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    read = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("spoken"))
    return recurrences.read_along(c.join(read, ["conv_id", "turn"]), ["conv_id", "turn"], "spoken", "text")


def w27_batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return recurrences.greedy_batches(c, ["conv_id"], ["turn"], "size", 800).select("conv_id", "turn", "batch")


def f28_html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", readers.html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


QUERIES = {f.__name__: f for f in (st08_metering_window, st17_sessions, st01_expiring_counter, st01_expiring_batch, st02_amount_cap, st03_admission, st03_address_windows, st04_voice_pools, st06_alert_dedupe, w15_merge_cues, w26_monotone_path, w27_batches, w08_duplicate_frames, w16_spans, w24_word_places, r01_word_diff, w30_highlights, f28_html_text)}

def _expiring_sql(keys: str, cap: int, ttl: int) -> str:
    """Counters that begin again when they have lived ``ttl`` seconds."""
    return f"""WITH RECURSIVE {_E}, s AS (SELECT event_id, {keys}, t, value, row_number() OVER (PARTITION BY {keys} ORDER BY t, event_id) AS i FROM e),
r AS (SELECT event_id, {keys}, i, t + {ttl} AS until, value <= {cap} AS allowed, CASE WHEN value <= {cap} THEN value ELSE 0 END::DOUBLE AS c FROM s WHERE i = 1
  UNION ALL SELECT event_id, {keys}, i, until, c + value <= {cap}, CASE WHEN c + value <= {cap} THEN c + value ELSE c END FROM (
    SELECT s.*, CASE WHEN s.t >= r.until THEN s.t + {ttl} ELSE r.until END AS until, CASE WHEN s.t >= r.until THEN 0 ELSE r.c END AS c FROM r JOIN s USING ({keys}) WHERE s.i = r.i + 1))
SELECT event_id, allowed, round(c, 6) AS count FROM r"""


def _admission_sql(rows: str, counters: list[tuple[str, int]], amount: str, shown: str) -> str:
    """Day by day, since no window is longer: what the day's counters have given out so far is a list."""
    keys = ", ".join(f"{k} AS k{i}" for i, (k, _) in enumerate(counters))
    used = lambda i: f"coalesce(list_sum(list_transform(list_filter(held, lambda x: x.k = k{i}), lambda x: x.a)), 0)"
    ok = " AND ".join(f"(k{i} IS NULL OR {used(i)} + a <= {cap})" for i, (_, cap) in enumerate(counters))
    taken = ", ".join(f"{{'k': k{i}, 'a': a}}" for i in range(len(counters)))
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, (props::JSON->>'k')::BIGINT AS address, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS t FROM events), q AS ({rows}),
s AS (SELECT *, {keys}, {amount} AS a, floor(t / 86400) AS d, row_number() OVER (PARTITION BY floor(t / 86400) ORDER BY t, event_id) AS i FROM q),
z AS (SELECT [{{'k': '', 'a': 0::BIGINT}}] AS held),
r AS (SELECT d, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS allowed, held FROM (SELECT DISTINCT d FROM s), z
  UNION ALL SELECT d, i, event_id, ok, CASE WHEN ok THEN list_concat(held, [{taken}]) ELSE held END FROM (SELECT s.*, r.held, {ok} AS ok FROM r JOIN s ON s.d = r.d AND s.i = r.i + 1))
SELECT {shown} FROM r JOIN q USING (event_id)"""


_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0::DOUBLE - 1704067200 AS t FROM events)"
SQL = {
    "st08_metering_window": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    # Sessions that the watermark, the last time of all, has passed.
    "st17_sessions": """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 21600000000 AS far FROM e),
s AS (SELECT user_id, t, sum(coalesce(far, false)::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(t) AS start, count(*) AS n FROM s GROUP BY user_id, s HAVING max(t) + 21600000000 <= (SELECT max(t) FROM e)""",
    "st01_expiring_counter": _expiring_sql("user_id", 150, 172800),
    "st01_expiring_batch": _expiring_sql("user_id, event_type", 100, 259200),
    "st03_address_windows": _admission_sql(
        "SELECT * FROM e",
        [("'v' || user_id || ':' || floor(t / 3600)", 1), ("'v' || user_id", 2), ("'a' || address || ':' || floor(t / 3600)", 2), ("'a' || address", 3)],
        "1::BIGINT",
        "event_id, allowed",
    ),
    "st04_voice_pools": _admission_sql(
        "SELECT *, CASE WHEN event_type = 'view' THEN 'free' ELSE 'voice' END AS pool, (1 + floor(value))::BIGINT AS chars FROM e",
        [("pool || 'v' || user_id", 75), ("pool || 'a' || address", 75), ("pool", 300)],
        "chars",
        "event_id, chars, allowed",
    ),
    "st03_admission": f"""WITH RECURSIVE {_E}, s AS (SELECT event_id, user_id, floor(t / 3600) AS h, floor(t / 86400) AS d, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
r AS (SELECT event_id, user_id, i, h, d, 1 AS in_h, 1 AS in_d, true AS allowed FROM s WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, h, d, nh + ok::INT, nd + ok::INT, ok FROM (SELECT *, nh < 1 AND nd < 3 AS ok FROM (
    SELECT s.*, CASE WHEN s.h = r.h THEN r.in_h ELSE 0 END AS nh, CASE WHEN s.d = r.d THEN r.in_d ELSE 0 END AS nd FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)))
SELECT event_id, allowed FROM r""",
    "w08_duplicate_frames": f"""WITH RECURSIVE {_E}, s AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN -1 ELSE trunc(value % 9)::INTEGER END AS page, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::INTEGER AS page, NULL::INTEGER AS resolved, -1 AS last FROM (SELECT DISTINCT user_id FROM s)
  UNION ALL SELECT user_id, i, event_id, page, CASE WHEN page < 0 THEN page ELSE near END, CASE WHEN page < 0 THEN last ELSE near END FROM (
    SELECT s.*, last, list_min(list_transform([0, 1, 2], lambda k: {{'d': abs(s.page // 3 * 3 + k - CASE WHEN last >= 0 THEN last ELSE s.page END - 0.5), 'p': s.page // 3 * 3 + k}})).p AS near FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1))
SELECT event_id, page, resolved FROM r WHERE i > 0""",
    "w16_spans": f"""WITH RECURSIVE {_E}, s AS (SELECT event_id, user_id, event_type, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS since, false AS inside FROM (SELECT DISTINCT user_id FROM s)
  UNION ALL SELECT s.user_id, s.i, s.event_id, CASE WHEN since IS NULL THEN CASE WHEN event_type = 'signup' THEN t END WHEN t - since > 259200 OR event_type = 'purchase' THEN NULL ELSE since END,
    CASE WHEN since IS NULL THEN event_type = 'signup' ELSE t - since <= 259200 END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT event_id, inside FROM r WHERE i > 0""",
    "w15_merge_cues": """WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, i, turn AS a, turn AS b, n, 0 AS g FROM s WHERE i = 1
  UNION ALL SELECT conv_id, i, CASE WHEN ok THEN a ELSE turn END, turn, CASE WHEN ok THEN total ELSE n END, g + (NOT ok)::INT FROM (
    SELECT s.conv_id, s.i, s.turn, s.n, r.a, r.g, r.n + 1 + s.n AS total, s.turn = r.b + 1 AND r.n + 1 + s.n <= 400 AS ok FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1))
SELECT conv_id, min(a) * 10.0::DOUBLE AS start, max(b) * 10.0::DOUBLE + 9 AS end, max(n)::INTEGER AS n FROM r GROUP BY conv_id, g""",
    "w26_monotone_path": """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
s AS (SELECT conv_id, turn, i, (n * 3 % 17)::DOUBLE / 17 AS s0, (n * 4 % 17)::DOUBLE / 17 AS s1, (n * 5 % 17)::DOUBLE / 17 AS s2, (n * 6 % 17)::DOUBLE / 17 AS s3 FROM c),
r AS (SELECT conv_id, i, s0 AS b0, s1 - 0.05::DOUBLE * 1 AS b1, s2 - 0.05::DOUBLE * 2 AS b2, s3 - 0.05::DOUBLE * 3 AS b3, [0] AS p0, [1] AS p1, [2] AS p2, [3] AS p3 FROM s WHERE i = 1
  UNION ALL SELECT conv_id, i, s0 + t0, s1 + t1 - 0.05::DOUBLE * 1, s2 + t2 - 0.05::DOUBLE * 2, s3 + t3 - 0.05::DOUBLE * 3, list_append(q0, 0), list_append(q1, 1), list_append(q2, 2), list_append(q3, 3) FROM (
    SELECT *, greatest(t2, l3) AS t3, CASE WHEN l3 > t2 THEN p3 ELSE q2 END AS q3 FROM (SELECT *, greatest(t1, l2) AS t2, CASE WHEN l2 > t1 THEN p2 ELSE q1 END AS q2 FROM (
      SELECT *, greatest(t0, l1) AS t1, CASE WHEN l1 > t0 THEN p1 ELSE q0 END AS q1 FROM (
        SELECT s.conv_id, s.i, s0, s1, s2, s3, b0 AS t0, p0 AS q0, b1 + 0.05::DOUBLE * 1 AS l1, b2 + 0.05::DOUBLE * 2 AS l2, b3 + 0.05::DOUBLE * 3 AS l3, p1, p2, p3 FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1))))),
f AS (SELECT conv_id, CASE WHEN b0 >= greatest(b1, b2, b3) THEN p0 WHEN b1 >= greatest(b2, b3) THEN p1 WHEN b2 >= b3 THEN p2 ELSE p3 END AS path FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT conv_id, turn::INTEGER AS chunk, path[i]::INTEGER AS page FROM s JOIN f USING (conv_id)""",
    # The anchor moves with alerts only, so the rows of a key are walked by recursion.
    "st06_alert_dedupe": f"""WITH RECURSIVE {_E}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS i FROM e),
r AS (SELECT event_id, user_id, event_type, i, t AS anchor, false AS repeat FROM s WHERE i = 1
  UNION ALL SELECT s.event_id, s.user_id, s.event_type, s.i, CASE WHEN s.t - r.anchor <= 86400 THEN r.anchor ELSE s.t END, s.t - r.anchor <= 86400 FROM r JOIN s ON s.user_id = r.user_id AND s.event_type = r.event_type AND s.i = r.i + 1)
SELECT event_id, repeat FROM r""",
    "st02_amount_cap": f"""WITH RECURSIVE {_E}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
r AS (SELECT event_id, user_id, i, value <= 300 AS allowed, CASE WHEN value <= 300 THEN value ELSE 0 END::DOUBLE AS c FROM s WHERE i = 1
  UNION ALL SELECT s.event_id, s.user_id, s.i, r.c + s.value <= 300, CASE WHEN r.c + s.value <= 300 THEN r.c + s.value ELSE r.c END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT event_id, allowed, round(c, 6) AS count FROM r""",
    "w27_batches": """WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, size AS total, 0 AS batch FROM s WHERE i = 1
  UNION ALL SELECT s.conv_id, s.turn, s.i, CASE WHEN r.total > 0 AND r.total + s.size > 800 THEN s.size ELSE r.total + s.size END, r.batch + (r.total > 0 AND r.total + s.size > 800)::INTEGER FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
SELECT conv_id, turn, batch FROM r""",
}
