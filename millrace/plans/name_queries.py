"""Names in texts: nations stand in for people, and texts about customers name them in known places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import names
from millrace.session import table

_WORDS = "will and go said yes ask not the market for thanks then left mark it here we talk work study indian"
_GIVEN = "mark pedro"


def _name() -> Column:
    """A name for each nation, of the letters of its number."""
    return F.concat(F.lit("Ver"), F.translate(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "0123456789", "aeioubdfgk"), F.lit("nta"))


def _lexicons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    people = nation.join(region, nation.n_regionkey == region.r_regionkey).select(_name().alias("first"), F.col("r_name").alias("last"), F.concat(F.lit("id"), "n_nationkey").alias("id"))
    dictionary = spark.createDataFrame([(w,) for w in _WORDS.split()], "w string")
    return names.scrub_list(people, dictionary), spark.createDataFrame([(w,) for w in _GIVEN.split()], "w string"), dictionary


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = _name()
    kinds = [
        F.concat(F.lit("Will "), n, F.lit(" and Pedro go? "), n, F.lit("'s work said yes.")), F.concat(F.lit("We ask "), n, F.lit("e, not Quimby.")), F.concat(F.lit("Thanks to Dr Quimby, then "), F.lower(n), F.lit(".")),
        F.lit("My name is Zorgon. Then Zorgon left."), F.concat(F.lit("Mark it: Mark "), n, F.lit(" Pedro here.")), F.concat(F.lit("The market id"), F.col("n_nationkey").cast("string"), F.lit(" works. Studied.")),
    ]
    return c.select("c_custkey", F.get(F.array(*kinds), (F.col("c_custkey") % 6).cast("int")).alias("text"))


def f10_mask_names(spark, sf_dir):
    listed, given, dictionary = _lexicons(spark, sf_dir)
    out = names.mask_names(_texts(spark, sf_dir), "c_custkey", "text", listed, given, dictionary)
    return out.select(F.col("id").alias("c_custkey"), "masked", "n")


def f11_context_names(spark, sf_dir):
    """Words of documents that follow an introduction, made of their first two words."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("Well, my name is "), F.initcap(F.regexp_extract(F.lower("text"), "([a-z]+)", 1)), F.lit(".")).alias("t"))
    common = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w"))
    return names.context_names(d, "t", common.distinct())


def f12_scrub_list(spark, sf_dir):
    return _lexicons(spark, sf_dir)[0]


def f13_known_words(spark, sf_dir):
    """Words of documents that are regular inflections of words of the benchmark, or such words."""
    words = lambda t: table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")).distinct()
    return names.known_words(words("documents"), words("benchmark"))


def f14_residual_names(spark, sf_dir):
    listed, given, dictionary = _lexicons(spark, sf_dir)
    return names.residual_names(_texts(spark, sf_dir), "c_custkey", "text", listed.filter("kind = 'exact'").union(given.withColumn("kind", F.lit("given"))), dictionary).withColumnRenamed("id", "c_custkey")


QUERIES = {f.__name__: f for f in (f10_mask_names, f11_context_names, f12_scrub_list, f13_known_words, f14_residual_names)}

_N = "'Ver' || translate(lpad(n_nationkey::VARCHAR, 2, '0'), '0123456789', 'aeioubdfgk') || 'nta'"
SQL = {
    "f10_mask_names": """SELECT c_custkey, ['Will [student] and [person] go? [student]''s work said yes.', 'We ask [student], not Quimby.', 'Thanks to Dr [person], then [student].', 'My name is [person]. Then [person] left.',
  'Mark it: [student] here.', 'The market [student] works. Studied.'][c_custkey % 6 + 1] AS masked, [3, 1, 2, 2, 3, 1][c_custkey % 6 + 1]::BIGINT AS n FROM customer""",
    "f14_residual_names": f"""WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, lower({_N}) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, n AS w, CASE k WHEN 0 THEN 2 ELSE 1 END AS n FROM c WHERE k IN (0, 4) UNION ALL SELECT c_custkey, 'pedro', 1 FROM c WHERE k IN (0, 4)""",
    "f11_context_names": """WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations), n AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]+') AS w FROM documents)
SELECT w FROM n WHERE length(w) >= 3 AND w NOT IN (SELECT w FROM c)""",
    "f12_scrub_list": f"""WITH p AS (SELECT {_N} AS f, r_name AS l, 'id' || n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT lower(f) AS w FROM p UNION SELECT unnest(string_split(lower(l), ' ')) FROM p), f AS (SELECT lower(f) AS f FROM p),
s AS (SELECT DISTINCT left(f, k) AS w FROM f, (VALUES (3), (4), (5)) v(k) WHERE length(f) >= 6 AND k < length(f) - 1),
a AS (SELECT w, 1 AS o, 'exact' AS kind FROM x WHERE length(w) >= 2 UNION ALL SELECT id, 2, 'id' FROM p WHERE length(id) >= 3 UNION ALL SELECT w, 3, 'short' FROM s WHERE w NOT IN ('will', 'and', 'the', 'for', 'mark', 'work', 'talk', 'study', 'india', 'not', 'ask'))
SELECT w, arg_min(kind, o) AS kind FROM a GROUP BY w""",
    # What a word may stem from, ending by ending, and stems that lose a doubled letter.
    "f13_known_words": """WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
e AS (SELECT * FROM (VALUES ('ies', 'y'), ('ied', 'y'), ('es', ''), ('s', ''), ('ed', ''), ('ed', 'e'), ('d', ''), ('ing', ''), ('ing', 'e'), ('ly', ''), ('er', ''), ('ers', ''), ('ers', 'e'), ('ization', 'ize'), ('ation', 'ate'), ('ness', ''), ('ment', '')) v(e, a)),
s AS (SELECT w, e, left(w, length(w) - length(e)) || a AS s FROM d, e WHERE length(w) >= 4 AND w LIKE '%' || e),
t AS (SELECT w, w AS s FROM d UNION SELECT w, s FROM s WHERE length(s) >= 3 UNION SELECT w, left(s, length(s) - 1) FROM s WHERE length(s) >= 4 AND e IN ('ed', 'ing', 'er', 'ers') AND right(s, 1) = right(left(s, length(s) - 1), 1))
SELECT DISTINCT w FROM t JOIN b ON b.w = t.s""".replace("SELECT DISTINCT w FROM t JOIN", "SELECT DISTINCT t.w FROM t JOIN"),
}
