"""Ranking, selection, routing and text-similarity queries over embeddings and documents.

Each label's mean vector is a question, every vector a record: label is the course, twenty vectors in
the order of their ids a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine_pairs
from millrace.operators import retrieval, similarity
from millrace.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return e.select(
        i.alias("row_idx"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("course"), F.floor(i / 20).alias("session"), (i % 20 + 1).alias("slide_number"),
        F.when(i % 31 == 0, "").otherwise(F.concat(F.lit("w"), (i % 211).cast("string"))).alias("words"), ((i % 29 != 0) & (i % 20 != 0)).alias("leads"),
    )


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = e.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("vector"))  # a vector each
    return whole.select(F.col("label").cast("long").alias("qid"), "vector")


def _ranked(spark: SparkSession, sf_dir: str, floor: float | None = None, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, sf_dir)
    pairs = cosine_pairs(_questions(spark, sf_dir), records, floor, k=k)
    pairs = pairs.withColumn("score", F.round("score", 6))
    return pairs.join(records.drop("vector"), "row_idx"), records.drop("vector")


_BASE = """r AS (SELECT vec_id AS row_idx, embedding::DOUBLE[] AS vector, label::VARCHAR AS course, (vec_id // 20)::BIGINT AS session, vec_id % 20 + 1 AS slide_number,
  CASE WHEN vec_id % 31 = 0 THEN '' ELSE 'w' || (vec_id % 211) END AS words, vec_id % 29 <> 0 AND vec_id % 20 <> 0 AS leads FROM embeddings),
x AS (SELECT label, i AS d, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) g(i) GROUP BY ALL),
q AS (SELECT label::BIGINT AS qid, list(x ORDER BY d) AS vector FROM x GROUP BY label),
p AS (SELECT qid, r.* EXCLUDE (vector), round(greatest(-1, least(1, list_cosine_similarity(r.vector, q.vector))), 6) AS score FROM r, q)"""
_CANDIDATES = """l AS (SELECT *, first_value(score) OVER w AS best, first_value(course) OVER w AS best_course FROM p WHERE leads AND score >= 0.1
  WINDOW w AS (PARTITION BY qid ORDER BY score DESC, row_idx)),
n AS (SELECT *, row_number() OVER (PARTITION BY qid, words ORDER BY score DESC, row_idx) AS nth FROM l WHERE score >= best - 0.12 AND (course = best_course OR score >= best - 0.01)),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_idx) AS rn FROM n WHERE nth = 1 OR words = '') WHERE rn <= 8)"""
_FILLS = """f AS (SELECT * FROM (SELECT a.qid, r.row_idx, r.course, r.session, r.slide_number, (a.score + b.score) / 2 AS score, a.row_idx AS low_idx, b.row_idx AS high_idx,
    row_number() OVER (PARTITION BY a.qid, r.course, r.session, r.slide_number ORDER BY r.row_idx) AS nth
  FROM c a JOIN c b ON a.qid = b.qid AND a.course = b.course AND a.session = b.session AND b.slide_number = a.slide_number + 2
  JOIN r ON r.course = a.course AND r.session = a.session AND r.slide_number = a.slide_number + 1
  WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.qid = a.qid AND z.course = r.course AND z.session = r.session AND z.slide_number = r.slide_number)
    AND NOT EXISTS (SELECT 1 FROM c z WHERE z.qid = a.qid AND z.words = r.words AND z.words <> '')) WHERE nth = 1)"""
_RULES = {"threshold": 0.1}


def w01_rank_cosine(spark, sf_dir):
    ranked, _ = _ranked(spark, sf_dir)
    return retrieval.rank(ranked).select("qid", "row_idx", "score", "rn")


def w02_topk_per_query(spark, sf_dir):
    ranked, _ = _ranked(spark, sf_dir, k=8)
    return retrieval.rank(ranked, 8).select("qid", "row_idx", "score", "rn")


def w03_candidates(spark, sf_dir):
    ranked, _ = _ranked(spark, sf_dir, 0.09)
    return retrieval.candidates(ranked, **_RULES).select("qid", "row_idx", "course", "score", "rn")


def w04_gap_fills(spark, sf_dir):
    """Two courses, and every third record leads nothing, so that candidates have gaps between them."""
    own = {"course": (F.col("label") % 2).cast("string"), "leads": F.col("row_idx") % 3 != 1}
    records = _records(spark, sf_dir).withColumn("label", F.col("course").cast("int")).withColumns(own).drop("label")
    pairs = cosine_pairs(_questions(spark, sf_dir), records).withColumn("score", F.round("score", 6))
    records = records.drop("vector")
    pool = retrieval.candidates(pairs.join(records, "row_idx"), threshold=-0.5, cutoff=2.0, margin=2.0, top=100)
    return retrieval.gap_fills(pool, records).select("qid", "row_idx", F.round("score", 6).alias("score"))


def w06_select_segments(spark, sf_dir):
    ranked, records = _ranked(spark, sf_dir, 0.09)
    out = retrieval.select_segments(ranked, records, **_RULES)
    return out.select("qid", "place", "row_idx", "course", "session", "slide_number", F.round("score", 6).alias("score"), "fill")


def o02_promoted_top(spark, sf_dir):
    ranked, _ = _ranked(spark, sf_dir)
    return retrieval.promoted_top(ranked, F.col("row_idx") % 10 == 3).select("qid", "row_idx", "score", "rn")


def o09_one_course(spark, sf_dir):
    ranked, _ = _ranked(spark, sf_dir)
    return retrieval.one_course(ranked).groupBy("qid", "course").agg(F.count("*").alias("n"), F.max("score").alias("top"))


def a33_threshold_summary(spark, sf_dir):
    ranked, _ = _ranked(spark, sf_dir)
    out = retrieval.threshold_summary(ranked, F.col("course") == F.col("qid").cast("string"), 0.3)
    return out.withColumn("gap", F.round("gap", 6))


def j13_best_feature(spark, sf_dir):
    """For each vector the feature (a label's mean) nearest to it, the score, and its lead over the next."""
    features = _questions(spark, sf_dir).withColumnRenamed("qid", "row_idx")
    frames = _records(spark, sf_dir).select(F.col("row_idx").alias("qid"), "vector")
    top = retrieval.rank(cosine_pairs(frames, features, k=2).withColumn("score", F.round("score", 6)), 2)
    best = top.groupBy("qid").agg(F.max(F.when(F.col("rn") == 1, F.col("row_idx"))).alias("feature"), F.max("score").alias("score"), F.round(F.max("score") - F.min("score"), 6).alias("lead"))
    return best.select(F.col("qid").alias("vec_id"), "feature", "score", "lead")


def p25_routing(spark, sf_dir):
    """Ordered cascade: the first rule that holds names the route of an event."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    route = F.coalesce(
        F.when((F.col("event_type") == "error") & (F.col("value") >= 50), "alert"),
        F.when(F.col("k") < 5, "stored_topic"),
        F.when(F.col("event_type") == "signup", "faq"),
        F.when(F.round(F.col("value") - F.col("k"), 6) >= 30, "course_info"),
        F.when(F.col("value") >= 20, "slides"),
        F.lit("declined"),
    )
    return e.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def f42_tfidf_pairs(spark, sf_dir):
    """The document nearest to each benchmark item by TF-IDF cosine."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    best = similarity.best_by_tfidf(items, docs, "item_id", "doc_id")
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"))


def u06_jaccard(spark, sf_dir):
    """Jaccard of word sets of documents with benchmark items, where at least 0.2."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return similarity.jaccard_at_least(items, docs, 0.2, "item_id", "doc_id").select("item_id", "doc_id", F.round("jaccard", 6).alias("jaccard"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z]+')"
QUERIES = {f.__name__: f for f in (w01_rank_cosine, w02_topk_per_query, w03_candidates, w04_gap_fills, w06_select_segments, o02_promoted_top, o09_one_course, a33_threshold_summary, j13_best_feature, p25_routing, f42_tfidf_pairs, u06_jaccard)}
SQL = {
    "w01_rank_cosine": f"WITH {_BASE} SELECT qid, row_idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_idx)::INTEGER AS rn FROM p",
    "w02_topk_per_query": f"WITH {_BASE} SELECT * FROM (SELECT qid, row_idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_idx)::INTEGER AS rn FROM p) WHERE rn <= 8",
    "w03_candidates": f"WITH {_BASE}, {_CANDIDATES} SELECT qid, row_idx, course, score, rn::INTEGER AS rn FROM c",
    "w04_gap_fills": f"WITH {_BASE.replace('label::VARCHAR AS course', '(label % 2)::VARCHAR AS course').replace('vec_id % 29 <> 0 AND vec_id % 20 <> 0 AS leads', 'vec_id % 3 <> 1 AS leads')}, {_CANDIDATES.replace('best - 0.01', 'best - 2.0').replace('best - 0.12', 'best - 2.0').replace('score >= 0.1', 'score >= -0.5').replace('rn <= 8', 'rn <= 100')}, {_FILLS} SELECT qid, row_idx, round(score, 6) AS score FROM f",
    "w06_select_segments": f"""WITH {_BASE}, {_CANDIDATES}, {_FILLS},
led AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, course, session, slide_number) AS r FROM c),
m AS (SELECT qid, row_idx, course, session, slide_number, score, r, 0 AS fill FROM led
  UNION ALL SELECT f.qid, f.row_idx, f.course, f.session, f.slide_number, f.score, greatest(a.r, b.r), 1 FROM f JOIN led a ON a.qid = f.qid AND a.row_idx = f.low_idx JOIN led b ON b.qid = f.qid AND b.row_idx = f.high_idx),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r, fill, score DESC, course, session, slide_number) AS pick FROM m) WHERE pick <= 5)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY course, session, slide_number, row_idx)::INTEGER AS place, row_idx, course, session, slide_number, round(score, 6) AS score, fill FROM k""",
    "o02_promoted_top": f"""WITH {_BASE}, m AS (SELECT *, row_idx % 10 = 3 AS pr, row_number() OVER (PARTITION BY qid, row_idx % 10 = 3 ORDER BY score DESC, row_idx) AS nth FROM p)
SELECT * FROM (SELECT qid, row_idx, score, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN pr AND nth <= 2 THEN 0 ELSE 1 END, score DESC, row_idx)::INTEGER AS rn FROM m) WHERE rn <= 3""",
    "o09_one_course": f"WITH {_BASE}, t AS (SELECT qid, arg_max(course, (score, -row_idx)) AS c FROM p GROUP BY qid) SELECT p.qid, course, count(*) AS n, max(score) AS top FROM p JOIN t ON t.qid = p.qid AND t.c = p.course GROUP BY ALL",
    "a33_threshold_summary": f"""WITH {_BASE}, t AS (SELECT qid, max(score) FILTER (course = qid::VARCHAR) AS own, max(score) FILTER (course <> qid::VARCHAR) AS other FROM p GROUP BY qid)
SELECT min(own) AS lowest_on, max(other) AS highest_off, round(min(own) - max(other), 6) AS gap, count(*) FILTER (own < 0.3) AS wrong_declines, count(*) FILTER (other >= 0.3) AS wrong_answers FROM t""",
    "j13_best_feature": f"""WITH {_BASE}, t AS (SELECT row_idx, qid, score, row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, qid) AS rn FROM p)
SELECT row_idx AS vec_id, max(qid) FILTER (rn = 1) AS feature, max(score) AS score, round(max(score) - min(score), 6) AS lead FROM t WHERE rn <= 2 GROUP BY row_idx""",
    "p25_routing": """WITH e AS (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events)
SELECT CASE WHEN event_type = 'error' AND value >= 50 THEN 'alert' WHEN k < 5 THEN 'stored_topic' WHEN event_type = 'signup' THEN 'faq' WHEN round(value - k, 6) >= 30 THEN 'course_info'
  WHEN value >= 20 THEN 'slides' ELSE 'declined' END AS route, count(*) AS n, round(avg(value), 6) AS mean_value FROM e GROUP BY 1""",
    "f42_tfidf_pairs": f"""WITH t AS (SELECT 0 AS side, item_id AS id, unnest({_TOKENS}) AS w FROM benchmark UNION ALL SELECT 1, doc_id, unnest({_TOKENS}) FROM documents),
tf AS (SELECT side, id, w, count(*) AS c FROM t GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf WHERE side = 1 GROUP BY w), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT side, id, w, (1 + ln(c)) * (ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1) AS x FROM tf LEFT JOIN df USING (w), n),
norm AS (SELECT side, id, sqrt(sum(x * x)) AS s FROM x GROUP BY ALL),
s AS (SELECT a.id AS item_id, b.id AS doc_id, sum(a.x * b.x) AS dot FROM x a JOIN x b ON a.w = b.w AND a.side = 0 AND b.side = 1 GROUP BY ALL),
r AS (SELECT item_id, doc_id, round(dot / (na.s * nb.s), 6) AS score FROM s JOIN norm na ON na.side = 0 AND na.id = item_id JOIN norm nb ON nb.side = 1 AND nb.id = doc_id)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM r) WHERE rn = 1""",
    "u06_jaccard": f"""WITH a AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS w FROM benchmark), b AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS w FROM documents),
na AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1), c AS (SELECT item_id, doc_id, count(*) AS c FROM a JOIN b USING (w) GROUP BY ALL)
SELECT item_id, doc_id, round(c / (na.n + nb.n - c)::DOUBLE, 6) AS jaccard FROM c JOIN na USING (item_id) JOIN nb USING (doc_id) WHERE c >= 0.2 * (na.n + nb.n - c)""",
}
