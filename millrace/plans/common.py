"""Views that several query modules read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import table


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log: the JSON number in props becomes a column, the day that of UTC."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"k": F.get_json_object("props", "$.k").cast("bigint"), "day": F.to_date("ts")})


EVENTS_SQL = "e AS (SELECT *, (props::JSON->>'k')::BIGINT AS k, ts::DATE AS day FROM events)"


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers (documents that have labels) under three judges: pass and a score from 1 to 5, which
    one of them leaves out for some answers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    base = table(spark, sf_dir, "labels").join(docs, "doc_id")
    n, q, t = F.col("n_chars"), F.col("quality"), F.col("toxic")
    depth = F.when(n % 7 == 0, None).otherwise((1 + F.least(F.lit(4), F.floor(n / 1000))).cast("double"))
    judged = F.array(
        F.struct(F.lit("style").alias("judge"), (q == 1).alias("pass"), (1 + 4 * q).cast("double").alias("score")),
        F.struct(F.lit("safety").alias("judge"), (t == 0).alias("pass"), (5 - 4 * t).cast("double").alias("score")),
        F.struct(F.lit("depth").alias("judge"), (n >= 1000).alias("pass"), depth.alias("score")),
    )
    rows = base.select(F.col("doc_id").alias("qid"), F.col("lang").alias("category"), F.col("source").alias("generator"), "n_chars", F.explode(judged).alias("j"))
    return rows.select("qid", "category", "generator", "n_chars", "j.*")


JUDGEMENTS_SQL = """base AS (SELECT l.doc_id AS qid, d.lang AS category, d.source AS generator, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
j AS (SELECT qid, category, generator, n_chars, 'style' AS judge, quality = 1 AS pass, (1 + 4 * quality)::DOUBLE AS score FROM base
  UNION ALL SELECT qid, category, generator, n_chars, 'safety', toxic = 0, (5 - 4 * toxic)::DOUBLE FROM base
  UNION ALL SELECT qid, category, generator, n_chars, 'depth', n_chars >= 1000, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE (1 + least(4, n_chars // 1000))::DOUBLE END FROM base)"""
