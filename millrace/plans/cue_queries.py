"""Cues, characters and seeded choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import series
from millrace.plans.series_queries import _E, _events
from millrace.session import table


def w16_short_cues(spark, sf_dir):
    """A short cue between two of one speaker is that speaker's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"before": F.lag("role").over(w), "after": F.lead("role").over(w)})
    label = F.when((F.length("text") < 150) & (F.col("before") == F.col("after")), F.col("before")).otherwise(F.col("role"))
    return c.select("conv_id", "turn", label.alias("label"))


def w17_clean_segments(spark, sf_dir):
    """Longest stretches of clean events whose pauses are at most a day."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _events(spark, sf_dir).withColumn("clean", F.col("event_type") != "error")
    cut = (~F.col("clean")) | ~F.coalesce(F.lag("clean").over(w), F.lit(False)) | (F.col("t") - F.lag("t").over(w) > 86400)
    runs = e.withColumn("cut", F.coalesce(cut, F.lit(True)).cast("int")).withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("clean")
    return runs.groupBy("user_id", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


def w20_clean_windows(spark, sf_dir):
    """The stretches with a pad at both ends, cut to two days; shorter ones than an hour go."""
    s = w17_clean_segments(spark, sf_dir).withColumns({"a": F.greatest(F.col("first") - 60, F.lit(0.0)), "b": F.col("last") + 60})
    return s.withColumn("b", F.least("b", F.col("a") + 172800)).filter("b - a >= 3600").select("user_id", "a", "b")


def w25_words_of_characters(spark, sf_dir):
    """Words with the place of their first character, from single characters."""
    c = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("i", "ch")).filter("ch <> ''")
    c = c.withColumn("space", F.regexp_like("ch", F.lit(r"\s")))
    runs = series.islands(c, ["item_id"], ["i"], "space").filter("NOT space")
    words = runs.groupBy("item_id", "run").agg(F.min("i").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda x: x["ch"]), "").alias("word"))
    return words.select("item_id", "start", "word")


def w29_merge_boxes(spark, sf_dir):
    """Boxes of one line merged while they touch."""
    e = _events(spark, sf_dir).select((F.col("event_id") % 500).alias("line"), F.floor("value").cast("double").alias("x0"), (F.floor("value") + 3).cast("double").alias("x1"))
    return series.merge_windows(e, ["line"], "x0", "x1", 0.0)


def w33_seeded_sample(spark, sf_dir):
    """A quarter of the rows, chosen by a hash of a seed and the id."""
    e = table(spark, sf_dir, "events")
    return e.filter(F.substring(F.md5(F.concat(F.lit("seed-7:"), F.col("event_id").cast("string"))), 1, 1).isin("0", "1", "2", "3")).select("event_id")


def w34_blind_letters(spark, sf_dir):
    """Letters for the versions of a group in an order drawn by a seed."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.md5(F.concat_ws(":", F.lit("blind"), "p_brand", "p_type"))))
    return p.select("p_brand", "p_type", F.char(n + 64).alias("letter"))


def f16_blank_terms(spark, sf_dir):
    """Listed terms become blanks of the same length, so places in the text stay."""
    out = F.col("text")
    for term in ("MIT License", "All rights reserved"):
        out = F.replace(out, F.lit(term), F.lit(" " * len(term)))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("h"), (F.length(out) == F.length("text")).alias("same_length"))


def f27_split_identifiers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("orderOf"), "c_name").alias("name"))
    return c.select("c_custkey", F.lower(F.regexp_replace(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")).alias("words"))


def f63_validate(spark, sf_dir):
    """A conversation counts only if all its replies do."""
    ok = (F.col("role") != "assistant") | ((F.trim("text") != "") & (F.length("text") <= 1500))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_and(ok).alias("valid"), F.count_if(~ok).alias("bad"))


def f70_clean_lines(spark, sf_dir):
    """Lines without digits, put together again."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.regexp_like(x, F.lit("[0-9]")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("lines"), F.md5(F.array_join(kept, "\n")).alias("h"))


QUERIES = {f.__name__: f for f in (w16_short_cues, w17_clean_segments, w20_clean_windows, w25_words_of_characters, w29_merge_boxes, w33_seeded_sample, w34_blind_letters, f16_blank_terms, f27_split_identifiers, f63_validate, f70_clean_lines)}

_SEGMENTS = f"""{_E}, k AS (SELECT *, event_type <> 'error' AS clean FROM e),
c AS (SELECT *, coalesce(NOT clean OR NOT coalesce(lag(clean) OVER w, false) OR t - lag(t) OVER w > 86400, true)::INT AS cut FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT *, (sum(cut) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM c), s AS (SELECT user_id, run, min(t) AS first, max(t) AS last, count(*) AS n FROM r WHERE clean GROUP BY ALL)"""
SQL = {
    "w16_short_cues": "SELECT conv_id, turn, CASE WHEN length(text) < 150 AND lag(role) OVER w = lead(role) OVER w THEN lag(role) OVER w ELSE role END AS label FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "w17_clean_segments": f"WITH {_SEGMENTS} SELECT * FROM s",
    "w20_clean_windows": f"WITH {_SEGMENTS}, p AS (SELECT user_id, greatest(first - 60, 0) AS a, last + 60 AS b FROM s), q AS (SELECT user_id, a, least(b, a + 172800) AS b FROM p) SELECT * FROM q WHERE b - a >= 3600",
    "w25_words_of_characters": r"""WITH c AS (SELECT item_id, unnest(generate_series(1, length(text))) - 1 AS i, text FROM benchmark), k AS (SELECT item_id, i, text[i + 1] AS ch, regexp_matches(text[i + 1], '\s') AS sp FROM c),
l AS (SELECT *, (sp IS DISTINCT FROM lag(sp) OVER (PARTITION BY item_id ORDER BY i))::INT AS ch0 FROM k), r AS (SELECT *, sum(ch0) OVER (PARTITION BY item_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT item_id, min(i)::INTEGER AS start, string_agg(ch, '' ORDER BY i) AS word FROM r WHERE NOT sp GROUP BY item_id, run""",
    "w29_merge_boxes": """WITH w AS (SELECT event_id % 500 AS line, floor(value) AS x0, floor(value) + 3 AS x1 FROM events), m0 AS (SELECT *, coalesce((x0 > max(x1) OVER (PARTITION BY line ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS new FROM w),
m1 AS (SELECT *, (sum(new) OVER (PARTITION BY line ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING))::BIGINT AS piece FROM m0) SELECT line, piece, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM m1 GROUP BY ALL""",
    "w33_seeded_sample": "SELECT event_id FROM events WHERE left(md5('seed-7:' || event_id), 1) IN ('0', '1', '2', '3')",
    "w34_blind_letters": "SELECT p_brand, p_type, chr((row_number() OVER (PARTITION BY p_brand ORDER BY md5('blind:' || p_brand || ':' || p_type)) + 64)::INTEGER) AS letter FROM (SELECT DISTINCT p_brand, p_type FROM part)",
    "f16_blank_terms": "WITH r AS (SELECT doc_id, text, replace(replace(text, 'MIT License', repeat(' ', 11)), 'All rights reserved', repeat(' ', 19)) AS t FROM documents) SELECT doc_id, md5(t) AS h, length(t) = length(text) AS same_length FROM r",
    "f27_split_identifiers": r"SELECT c_custkey, lower(regexp_replace(regexp_replace('orderOf' || c_name, '([a-z])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')) AS words FROM customer",
    "f63_validate": "WITH c AS (SELECT conv_id, role <> 'assistant' OR (trim(text) <> '' AND length(text) <= 1500) AS ok FROM conversations) SELECT conv_id, bool_and(ok) AS valid, count(*) FILTER (NOT ok) AS bad FROM c GROUP BY 1",
    "f70_clean_lines": "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[0-9]')) AS k FROM documents) SELECT doc_id, len(k)::INTEGER AS lines, md5(array_to_string(k, chr(10))) AS h FROM l",
}
