"""Predicates, routes, keys and small projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import smoothing, usage
from millrace.plans.common import EVENTS_SQL, JUDGEMENTS_SQL, events_log, judgements
from millrace.session import table

_SCOPE = [("(?i)license|rights", "logistics"), ("(?i)idiot|scum|trash", "off_topic"), ("(?i)the of|and the", "adjacent")]
_ROUTES = [("(?i)^the ", "faq_the"), ("(?i)^und ", "faq_und"), ("(?i)elle", "faq_elle")]


def p01_searchable(spark, sf_dir):
    """Parts that no hidden (brand, type) pair names."""
    p = table(spark, sf_dir, "part")
    hidden = p.filter("p_size >= 49").select("p_brand", "p_type").distinct()
    return p.join(hidden, ["p_brand", "p_type"], "left_anti").groupBy("p_brand").agg(F.count("*").alias("n"))


def p08_key_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", usage.key_part(F.col("url")).alias("part"))


def p09_slide_parts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ids = e.select("vec_id", rules.slide_id(F.col("label") + 10, F.floor(F.col("vec_id") / 100) % 100, F.col("vec_id") % 1000).alias("slide"))
    return ids.select("vec_id", "slide", rules.slide_parts(F.col("slide")).alias("p")).select("vec_id", "slide", "p.course", "p.session", "p.number")


def p14_shapes(spark, sf_dir):
    """A value under one of several names, or in a list."""
    e = table(spark, sf_dir, "events").withColumn("j", F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"x": '), "props", F.lit("}"))).otherwise(F.concat(F.lit("["), "props", F.lit("]")))))
    return e.select("event_id", F.coalesce(*(F.get_json_object("j", p) for p in ("$.k", "$.x.k", "$[0].k"))).cast("bigint").alias("k"))


def p18_allowed(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(rules.allowed(F.col("url"), [r"\.example\.(com|org)/", "^https:"], ["#top$", "/fr/"]).alias("ok")).agg(F.count("*").alias("n"))


def p26_wins(spark, sf_dir):
    e = events_log(spark, sf_dir)
    return e.select("event_id", rules.wins(F.col("value"), F.when(F.col("k") % 10 != 0, F.col("k").cast("double")), 2.5).alias("wins"))


def p27_alert_rule(spark, sf_dir):
    e = events_log(spark, sf_dir)
    decided = F.when(F.col("k") % 7 == 0, F.col("event_type") == "error").otherwise(F.col("value") / 100 >= 0.6)
    return e.groupBy(decided.alias("alert")).agg(F.count("*").alias("n"))


def p28_routes(spark, sf_dir):
    e = events_log(spark, sf_dir)
    routes = F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("event_type").isin("click", "view"), "slides").when(F.col("event_type") == "error", "declined").otherwise("web"))))
    return e.groupBy("user_id").agg(F.array_join(routes, ",").alias("routes"))


def j08_judge_retest(spark, sf_dir):
    """A judge's scores against its second reading of the same answers."""
    j = judgements(spark, sf_dir)
    again = j.select("qid", "judge", F.when(F.col("qid") % 5 == 0, F.least(F.col("score") + 1, F.lit(5.0))).otherwise(F.col("score")).alias("s2"))
    return j.join(again, ["qid", "judge"]).groupBy("judge").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score") == F.col("s2")).cast("int")), 6).alias("same"), F.round(F.avg(F.abs(F.col("score") - F.col("s2"))), 6).alias("gap"))


def j19_listed_words(spark, sf_dir):
    """Capitalised words of documents that a list has and a dictionary has not."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")).distinct()
    common = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^\p{L}])([a-z]+)"), 1)).alias("w")).distinct()
    return smoothing.mask_listed_names(table(spark, sf_dir, "documents"), "doc_id", "text", names, common)


def j25_normalised_lookup(spark, sf_dir):
    norm = lambda c: F.md5(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))
    d = table(spark, sf_dir, "documents").select("doc_id", norm("text").alias("k"))
    stored = table(spark, sf_dir, "documents").filter("source = 'src0'").select(norm("text").alias("k"), F.col("doc_id").alias("topic")).groupBy("k").agg(F.min("topic").alias("topic"))
    return d.join(stored, "k").select("doc_id", "topic")


def j29_first_rule(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role", rules.first_match(F.col("text"), _ROUTES, "none").alias("entry")).agg(F.count("*").alias("n"))


def f17_keyword_scope(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.first_match(F.col("text"), _SCOPE, "none").alias("scope"))


def f05_smooth(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", smoothing.smooth(F.col("text")).alias("s"))
    return d.select("doc_id", F.col("s.n").alias("n"), F.md5("s.text").alias("text_md5"))


def f07_redact_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", rules.redact_sentences(F.col("text"), "(?i)idiot|license", "[redacted]").alias("t"))
    return d.select("doc_id", F.regexp_count("t", F.lit(r"\[redacted\]")).alias("n"), F.length("t").alias("chars"))


def f21_title_score(spark, sf_dir):
    """Words in common with a brand's name: numbers count three, others one, mismatches less."""
    p = table(spark, sf_dir, "part")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_brand")), F.lit("([a-z0-9]+)"), 1))
    asked = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_type", F.lit("brand 12 part"))), F.lit("([a-z0-9]+)"), 1))
    common = F.array_intersect(words, asked)
    score = F.aggregate(common, F.lit(0), lambda acc, w: acc + F.when(F.regexp_like(w, F.lit("^[0-9]+$")), 3).otherwise(1))
    return p.select("p_partkey", score.alias("score"))


def f23_trim_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", rules.trim_to_sentences(F.col("text"), 150).alias("t"))
    return d.select("item_id", F.length("t").alias("n"))


def f32_embed_text(spark, sf_dir):
    parts = [F.nullif(F.trim(F.substring(c, 1, n)), F.lit("")) for c, n in (("source", 4), ("lang", 2), ("text", 200))]
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws("\n\n", *parts)).alias("h"))


def f33_split_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.split("c_name", "#")[0].alias("first"), F.element_at(F.split("c_name", "#"), -1).alias("last"))


def f35_model_family(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    family = F.when(n % 3 == 0, "alpha").when(n % 3 == 1, "beta").otherwise(F.lower(F.regexp_replace("p_brand", "[^A-Za-z]+", "-")))
    return p.groupBy(family.alias("family")).agg(F.countDistinct("p_brand").alias("brands"), F.count("*").alias("n"))


def f44_ranged(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.get_json_object("props", "$.k")))
    return e.select("event_id", F.coalesce(rules.ranged(F.col("raw"), 5, 50), F.lit(-1.0)).alias("v"))


def f52_local_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), "ts")
    return e.select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("due"))


def f69_calibration(spark, sf_dir):
    j = judgements(spark, sf_dir)
    low, high = F.when(F.col("judge") == "style", 2.0).otherwise(1.0), F.when(F.col("judge") == "depth", 3.0).otherwise(5.0)
    misses = F.array_compact(F.array(F.when(F.col("score") < low, "low"), F.when(F.col("score") > high, "high"), F.when(F.col("score").isNull(), "none")))
    return j.select("qid", "judge", F.array_join(misses, ",").alias("misses"))


def a22_report_card(spark, sf_dir):
    """Points in order for each generator: pass rates by category."""
    j = judgements(spark, sf_dir).groupBy("generator", "category").agg(F.round(F.avg(F.col("pass").cast("int")), 3).alias("r"))
    points = F.array_sort(F.collect_list(F.struct("category", "r")))  # a point for each category
    return j.groupBy("generator").agg(F.array_join(F.transform(points, lambda p: F.concat_ws("=", p["category"], F.format_string("%.3f", p["r"]))), ";").alias("points"))


def a34_index_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumns({"session": F.floor(F.col("vec_id") / 20), "thin": F.col("vec_id") % 29 == 0})
    return e.groupBy("label", "session").agg(F.count("*").alias("n"), F.count_if("thin").alias("thin"), F.max(F.size("embedding")).alias("dim"))


def a35_longest_reason(spark, sf_dir):
    e = events_log(spark, sf_dir)
    return e.filter("event_type <> 'purchase'").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("reason"), F.count("*").alias("n"))


def a39_estimate(spark, sf_dir):
    """A sum that is unknown as soon as one of its prices is."""
    p = table(spark, sf_dir, "part").withColumn("price", F.when(F.col("p_size") == 7, None).otherwise(F.col("p_retailprice")))
    known = F.count("price") == F.count("*")
    return p.groupBy("p_brand", "p_type").agg(F.when(known, F.round(F.sum("price"), 2)).alias("cost"), known.alias("known")).withColumn("cost", F.coalesce("cost", F.lit(-1.0)))


def a43_run_stats(spark, sf_dir):
    e = events_log(spark, sf_dir)
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.avg("value"), 6).alias("mean"))


def o10_related(spark, sf_dir):
    """The three highest of each group, and of these what reaches the floor."""
    p = table(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").filter("p_size >= 20").select("p_brand", "p_partkey", "rn")


def o11_pick_links(spark, sf_dir):
    """Up to four links, one for each host, citations before results."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"//([^/]+)", 1).alias("host"), F.regexp_extract("url", r"\.(com|org|net)/", 1).alias("zone"), (F.col("page_id") % 3 == 0).alias("cited"))
    once = usage.first_wins(p, ["zone", "host"], [F.desc("cited"), F.col("page_id")])
    w = Window.partitionBy("zone").orderBy(F.desc("cited"), "page_id")
    return once.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").select("zone", "page_id", "rn")


def r06_options(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("lang").distinct().select(F.lit("lang").alias("filter"), F.col("lang").alias("value")).unionByName(d.select("source").distinct().select(F.lit("source").alias("filter"), F.col("source").alias("value")))


def r09_for_course(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("course", F.when(F.col("doc_id") % 6 == 0, None).otherwise(F.col("lang")))
    return d.filter(F.col("course").isNull() | (F.col("course") == "fr")).groupBy("source").agg(F.count("*").alias("n"))


def st12_offsets(spark, sf_dir):
    """Chunks with own clocks put on one: the sum of the lengths before each."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 15.0).alias("seconds"))
    before = F.sum("seconds").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return c.select("conv_id", "turn", F.round(F.coalesce(before, F.lit(0.0)), 4).alias("offset"))


QUERIES = {
    f.__name__: f
    for f in (
        p01_searchable, p08_key_parts, p09_slide_parts, p14_shapes, p18_allowed, p26_wins, p27_alert_rule, p28_routes, j08_judge_retest, j19_listed_words, j25_normalised_lookup, j29_first_rule, f17_keyword_scope, f05_smooth, f07_redact_sentences,
        f21_title_score, f23_trim_sentences, f32_embed_text, f33_split_name, f35_model_family, f44_ranged, f52_local_text, f69_calibration, a22_report_card, a34_index_stats, a35_longest_reason, a39_estimate, a43_run_stats, o10_related,
        o11_pick_links, r06_options, r09_for_course, st12_offsets,
    )
}


def _case(rules_: list[tuple[str, str]], column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for p, n in rules_) + " ELSE 'none' END"


_NORM = "md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))"
SQL = {
    "p01_searchable": "SELECT p_brand, count(*) AS n FROM part WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM part WHERE p_size >= 49) GROUP BY 1",
    "p08_key_parts": "SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._/~@+:-]', '_', 'g'), 80) AS part FROM pages",
    "p09_slide_parts": "SELECT vec_id, printf('%05d-s%02d-%03d', label + 10, vec_id // 100 % 100, vec_id % 1000) AS slide, printf('%05d', label + 10) AS course, (vec_id // 100 % 100)::INTEGER AS session, (vec_id % 1000)::INTEGER AS number FROM embeddings",
    "p14_shapes": f"WITH {EVENTS_SQL} SELECT event_id, k FROM e",
    "p18_allowed": r"SELECT (regexp_matches(url, '\.example\.(com|org)/') OR regexp_matches(url, '^https:')) AND NOT (regexp_matches(url, '#top$') OR regexp_matches(url, '/fr/')) AS ok, count(*) AS n FROM pages GROUP BY 1",
    "p26_wins": f"WITH {EVENTS_SQL} SELECT event_id, coalesce(round(value - CASE WHEN k % 10 <> 0 THEN k END, 6) >= 2.5, value IS NOT NULL) AS wins FROM e",
    "p27_alert_rule": f"WITH {EVENTS_SQL} SELECT CASE WHEN k % 7 = 0 THEN event_type = 'error' ELSE value / 100 >= 0.6 END AS alert, count(*) AS n FROM e GROUP BY 1",
    "p28_routes": "SELECT user_id, string_agg(DISTINCT r, ',' ORDER BY r) AS routes FROM (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'slides' WHEN event_type = 'error' THEN 'declined' ELSE 'web' END AS r FROM events) GROUP BY 1",
    "j08_judge_retest": f"WITH {JUDGEMENTS_SQL}, r AS (SELECT *, CASE WHEN qid % 5 = 0 THEN CASE WHEN score IS NULL THEN 5.0 ELSE least(score + 1, 5.0) END ELSE score END AS s2 FROM j) SELECT judge, count(*) AS n, round(avg((score = s2)::INT), 6) AS same, round(avg(abs(score - s2)), 6) AS gap FROM r GROUP BY 1",
    "j25_normalised_lookup": f"WITH d AS (SELECT doc_id, source, {_NORM} AS k FROM documents), s AS (SELECT k, min(doc_id) AS topic FROM d WHERE source = 'src0' GROUP BY 1) SELECT doc_id, topic FROM d JOIN s USING (k)",
    "j29_first_rule": f"SELECT role, {_case(_ROUTES, 'text')} AS entry, count(*) AS n FROM conversations GROUP BY ALL",
    "f17_keyword_scope": f"SELECT doc_id, {_case(_SCOPE, 'text')} AS scope FROM documents",
    "j19_listed_words": r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:^|[^\p{L}])([a-z]+)', 1)) AS w FROM conversations),
l AS (SELECT w FROM n WHERE w NOT IN (SELECT w FROM c)), t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}''-]+')) AS raw FROM documents)
SELECT doc_id AS id, count(*) AS n, string_agg(DISTINCT lower(raw), ',' ORDER BY lower(raw)) AS words FROM t WHERE raw <> lower(raw) AND lower(raw) IN (SELECT w FROM l) GROUP BY 1""",
    "f07_redact_sentences": r"""WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^.!?\n]*[.!?\n]*'), lambda s: CASE WHEN regexp_matches(s, '(?i)idiot|license') THEN '[redacted]' ELSE s END) AS p FROM documents), t AS (SELECT doc_id, array_to_string(p, '') AS t FROM p)
SELECT doc_id, len(regexp_extract_all(t, '\[redacted\]'))::INTEGER AS n, length(t)::INTEGER AS chars FROM t""",
    "f23_trim_sentences": r"""WITH s AS (SELECT item_id, regexp_extract_all(text, '[^.!?]+[.!?]+\s*') AS s FROM benchmark), p AS (SELECT item_id, list_transform(range(1, len(s) + 1), lambda i: length(rtrim(array_to_string(s[1:i], '')))) AS n FROM s)
SELECT item_id, coalesce(list_max(list_filter(n, lambda x: x <= 150)), 0)::INTEGER AS n FROM p""",
    "f21_title_score": "WITH w AS (SELECT p_partkey, list_intersect(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(p_type || ' brand 12 part'), '[a-z0-9]+'))) AS c FROM part) SELECT p_partkey, (len(c) + 2 * len(list_filter(c, lambda x: regexp_matches(x, '^[0-9]+$'))))::INTEGER AS score FROM w",
    "f32_embed_text": "SELECT doc_id, md5(concat_ws(chr(10) || chr(10), nullif(trim(left(source, 4)), ''), nullif(trim(left(lang, 2)), ''), nullif(trim(left(text, 200)), ''))) AS h FROM documents",
    "f33_split_name": "SELECT c_custkey, split_part(c_name, '#', 1) AS first, split_part(c_name, '#', -1) AS last FROM customer",
    "f35_model_family": "WITH f AS (SELECT *, regexp_extract(p_brand, '[0-9]+')::INT % 3 AS m FROM part) SELECT CASE m WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE lower(regexp_replace(p_brand, '[^A-Za-z]+', '-', 'g')) END AS family, count(DISTINCT p_brand) AS brands, count(*) AS n FROM f GROUP BY 1",
    "f44_ranged": f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN event_id % 4 <> 0 AND k BETWEEN 5 AND 50 THEN k ELSE -1 END::DOUBLE AS v FROM e",
    "f52_local_text": "SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS due FROM events",
    "f69_calibration": f"WITH {JUDGEMENTS_SQL} SELECT qid, judge, concat_ws(',', CASE WHEN score < CASE judge WHEN 'style' THEN 2 ELSE 1 END THEN 'low' END, CASE WHEN score > CASE judge WHEN 'depth' THEN 3 ELSE 5 END THEN 'high' END, CASE WHEN score IS NULL THEN 'none' END) AS misses FROM j",
    "a22_report_card": f"WITH {JUDGEMENTS_SQL}, p AS (SELECT generator, category, round(avg(pass::INT), 3) AS r FROM j GROUP BY ALL) SELECT generator, string_agg(category || '=' || printf('%.3f', r), ';' ORDER BY category) AS points FROM p GROUP BY 1",
    "a34_index_stats": "SELECT label, vec_id // 20 AS session, count(*) AS n, count(*) FILTER (vec_id % 29 = 0) AS thin, max(len(embedding))::INTEGER AS dim FROM embeddings GROUP BY ALL",
    "a35_longest_reason": "SELECT user_id, arg_max(event_type, (value, event_id)) AS reason, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY 1",
    "a39_estimate": "SELECT p_brand, p_type, CASE WHEN count(*) FILTER (p_size = 7) = 0 THEN round(sum(p_retailprice), 2) ELSE -1 END AS cost, count(*) FILTER (p_size = 7) = 0 AS known FROM part GROUP BY ALL",
    "a43_run_stats": "SELECT user_id, event_type, count(*) AS n, round(min(value), 6) AS low, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "o10_related": "SELECT p_brand, p_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rn FROM part) WHERE rn <= 3 AND p_size >= 20",
    "o11_pick_links": r"""WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, regexp_extract(url, '\.(com|org|net)/', 1) AS zone, page_id % 3 = 0 AS cited FROM pages), o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY zone, host ORDER BY cited DESC, page_id) = 1)
SELECT zone, page_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY cited DESC, page_id)::INTEGER AS rn FROM o) WHERE rn <= 4""",
    "r06_options": "SELECT DISTINCT 'lang' AS filter, lang AS value FROM documents UNION ALL SELECT DISTINCT 'source', source FROM documents",
    "r09_for_course": "SELECT source, count(*) AS n FROM documents WHERE doc_id % 6 = 0 OR lang = 'fr' GROUP BY 1",
    "st12_offsets": "SELECT conv_id, turn, round(coalesce(sum(length(text) / 15.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS \"offset\" FROM conversations",
}
