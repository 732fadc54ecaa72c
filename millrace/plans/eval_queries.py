"""Evaluation analytics: labelled documents are answers, sources generators, languages categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import evals, resumable
from millrace.plans.common import JUDGEMENTS_SQL, judgements
from millrace.operators.scratch import shared_folder
from millrace.session import table


def _wide(spark, sf_dir):
    j = judgements(spark, sf_dir)
    return j.groupBy("qid").pivot("judge", ["style", "safety", "depth"]).agg(F.max("score"))


def a08_model_scores(spark, sf_dir):
    """Answers are counted once, judgements as often as they are."""
    return judgements(spark, sf_dir).groupBy("generator").agg(F.countDistinct("qid").alias("answers"), F.count("*").alias("judgements"), evals.rate(F.col("pass")).alias("pass_rate"), F.round(F.avg("score"), 6).alias("mean_score"), F.count("score").alias("scored"))


def a10_judge_summary(spark, sf_dir):
    return judgements(spark, sf_dir).groupBy("judge").agg(F.count("*").alias("n"), evals.rate(F.col("pass")).alias("pass_rate"), F.round(F.avg("score"), 6).alias("mean_score"), F.count("score").alias("scored"))


def a11_by_category(spark, sf_dir):
    """A score of 0 or null does not count."""
    j = judgements(spark, sf_dir).withColumn("scope", F.col("score") - 1)
    return j.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("scope") != 0, F.col("scope"))), 6).alias("scope"))


def a12_judge_agreement(spark, sf_dir):
    return evals.judge_agreement(judgements(spark, sf_dir))


def a13_brier(spark, sf_dir):
    j = judgements(spark, sf_dir).withColumn("p", F.coalesce((F.col("score") - 1) / 4, F.lit(0.5)))
    return evals.brier_against_others(j, "p")


def a14_answer_metrics(spark, sf_dir):
    """Per answer: words of its language expected, words shown, hit, precision and recall."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    expected = F.array(F.lit("the"), F.lit("und"), F.lit("les"), F.lit("los"), F.lit("de"))
    shown = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    common = F.size(F.array_intersect(expected, shown))
    return d.select("doc_id", (common > 0).alias("hit"), F.round(F.try_divide(common, F.size(shown)), 6).alias("precision"), F.round(common / 5, 6).alias("recall"))


def a16_without_same_family(spark, sf_dir):
    """Pass rate without verdicts of a judge on generators of its own family."""
    j = judgements(spark, sf_dir)
    family = F.when(F.regexp_extract("generator", "[0-9]+", 0).cast("int") % 3 == 0, "style").when(F.regexp_extract("generator", "[0-9]+", 0).cast("int") % 3 == 1, "safety").otherwise("none")
    return j.filter(family != F.col("judge")).groupBy("generator").agg(evals.rate(F.col("pass")).alias("pass_rate"), F.count("*").alias("n"))


def a18_category_counts(spark, sf_dir):
    return judgements(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def a19_hardest_first(spark, sf_dir):
    return evals.hardest_first(judgements(spark, sf_dir))


def a20_agreement(spark, sf_dir):
    return evals.majority(judgements(spark, sf_dir))


def a21_matrix_cube(spark, sf_dir):
    return judgements(spark, sf_dir).cube("generator", "judge").agg(F.count("*").alias("n"), evals.rate(F.col("pass")).alias("pass_rate"))


def a21_leniency(spark, sf_dir):
    return evals.leniency(judgements(spark, sf_dir))


def a23_composite(spark, sf_dir):
    return evals.mean_of_means(judgements(spark, sf_dir), ["judge"], ["qid"])


def a25_score_ci(spark, sf_dir):
    """Small groups: Student's t; the interval stays within the scale."""
    return judgements(spark, sf_dir).groupBy("generator", "judge").agg(*stats.mean_ci("score", 1.0, 5.0))


def a26_icc(spark, sf_dir):
    return stats.icc_2_1(judgements(spark, sf_dir), "qid", "judge", "score")


def a27_correlations(spark, sf_dir):
    return stats.correlations(_wide(spark, sf_dir), "style", "depth")


def a28_kappa(spark, sf_dir):
    j = judgements(spark, sf_dir).groupBy("qid").pivot("judge", ["style", "depth"]).agg(F.max("pass"))
    return stats.cohen_kappa(j, "style", "depth")


def a29_alpha(spark, sf_dir):
    return stats.krippendorff_ordinal(judgements(spark, sf_dir), "qid", "score")


def a30_pairwise(spark, sf_dir):
    p = evals.judge_pairs(judgements(spark, sf_dir)).filter("s1 IS NOT NULL AND s2 IS NOT NULL")
    gap = F.abs(F.col("s1") - F.col("s2"))
    return p.agg(F.round(F.avg((gap == 0).cast("int")), 3).alias("exact"), F.round(F.avg((gap <= 1).cast("int")), 3).alias("within_one"), F.count("*").alias("pairs"))


def a32_retrieval_check(spark, sf_dir):
    m = a14_answer_metrics(spark, sf_dir)
    return m.agg(F.count("*").alias("n"), evals.rate(F.col("hit")).alias("hit_rate"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))


def a48_self_grading(spark, sf_dir):
    j = judgements(spark, sf_dir).select("generator", "judge").distinct()
    return j.filter(F.substring("generator", -1, 1) == (F.length("judge") % 10).cast("string"))


def j07_retest(spark, sf_dir):
    """First against second run of a question: documents next to each other, of one language."""
    j = judgements(spark, sf_dir).withColumn("rep", F.col("qid") % 2).groupBy("category", "judge", F.floor(F.col("qid") / 2).alias("pair")).pivot("rep", [0, 1]).agg(F.max("score"))
    j = j.filter("`0` IS NOT NULL AND `1` IS NOT NULL")
    return j.groupBy("judge").agg(F.count("*").alias("n"), evals.rate(F.col("0") != F.col("1")).alias("flip_rate"), F.round(F.avg(F.abs(F.col("0") - F.col("1"))), 6).alias("mean_gap"))


def p10_ok_judgements(spark, sf_dir):
    """Nested judgements filtered in place: those with a score."""
    j = judgements(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.struct("judge", "score")).alias("js"))  # three each
    ok = F.filter("js", lambda x: x["score"].isNotNull())
    return j.select("qid", F.size("js").alias("n"), F.size(ok).alias("ok"), F.array_join(F.array_sort(F.transform(ok, lambda x: x["judge"])), ",").alias("judges"))


def p12_usable(spark, sf_dir):
    j = judgements(spark, sf_dir)
    excluded = j.groupBy("generator").agg(evals.rate(F.col("pass")).alias("r")).filter("r < 0.62").select("generator")
    return j.join(excluded, "generator", "left_anti").groupBy("generator").agg(F.count("*").alias("n"))


def w32_plan_tasks(spark, sf_dir):
    """Tasks in the order of repetition, question, generator."""
    j = judgements(spark, sf_dir)
    gens, cats = j.select("generator").distinct(), j.select("category").distinct()
    return spark.range(2).withColumnRenamed("id", "rep").crossJoin(cats).crossJoin(gens).orderBy("rep", "category", "generator")  # names by names


def r03_calibration(spark, sf_dir):
    j = judgements(spark, sf_dir)
    met = F.col("score").between(2, 5)
    return j.groupBy("judge").agg(F.count_if(met).alias("met"), F.count_if(~F.coalesce(met, F.lit(False))).alias("missed"), F.count("*").alias("done"))


def st15_resumed_run(spark, sf_dir):
    """Labelled documents are questions to three generators, toxic ones twice, and two judges look at the answers. In
    the first session one provider refuses and one worker is stopped after a chunk; later sessions do what is left."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("size"), F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint").alias("sum"))
    questions = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs, "doc_id").withColumnRenamed("doc_id", "qid")
    key = ["qid", "generator", "rep"]
    answers = resumable.Run(spark, shared_folder(spark, "answers"), key)
    verdicts = resumable.Run(spark, shared_folder(spark, "verdicts"), [*key, "judge"])
    answers.extend(resumable.plan_tasks(questions, [("small", "north"), ("large", "north"), ("other", "south")], 2, "toxic = 1"), 2, first="rep")

    def refused(refusing):
        return F.col("provider") == refusing

    def ask(refusing):
        state = F.when(F.col("size") == 0, "error").when(F.col("sum") % 5 == 0, "not_covered").otherwise("ok")
        answer = F.pmod(F.col("sum") + F.length("generator") * F.col("rep"), F.lit(7))
        return lambda df: df.withColumns({"status": F.when(refused(refusing), resumable.REFUSED).otherwise(state), "cost": F.lit(0.0), "answer": answer})

    def judge(refusing):
        return lambda df: df.withColumns({"status": F.when(refused(refusing), resumable.REFUSED).otherwise("ok"), "cost": F.lit(0.0), "pass": F.col("answer") > F.when(F.col("judge") == "strict", 3).otherwise(1)})

    judges = [("strict", "north"), ("mild", "west")]
    answers.work(ask("south"), most=1)
    resumable.evaluate(answers, verdicts, ask("south"), judge("west"), judges, 1)
    resumable.evaluate(answers, verdicts, ask("none"), judge("none"), judges, 1)
    return verdicts.results().select(*key, "judge", "answered", "answer", "pass")


QUERIES = {
    f.__name__: f
    for f in (
        a08_model_scores, a10_judge_summary, a11_by_category, a12_judge_agreement, a13_brier, a14_answer_metrics, a16_without_same_family, a18_category_counts, a19_hardest_first, a20_agreement, a21_matrix_cube, a21_leniency, a23_composite,
        a25_score_ci, a26_icc, a27_correlations, a28_kappa, a29_alpha, a30_pairwise, a32_retrieval_check, a48_self_grading, j07_retest, p10_ok_judgements, p12_usable, w32_plan_tasks, r03_calibration, st15_resumed_run,
    )
}

_J = f"WITH {JUDGEMENTS_SQL}"
_RATE = "round(avg(pass::INT), 6)"
_METRICS = """m AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
c AS (SELECT doc_id, len(list_intersect(w, ['the', 'und', 'les', 'los', 'de'])) AS c, len(w) AS n FROM m),
a14 AS (SELECT doc_id, c > 0 AS hit, CASE WHEN n > 0 THEN round(c / n::DOUBLE, 6) END AS precision, round(c / 5.0::DOUBLE, 6) AS recall FROM c)"""
SQL = {
    "a08_model_scores": f"{_J} SELECT generator, count(DISTINCT qid) AS answers, count(*) AS judgements, {_RATE} AS pass_rate, round(avg(score), 6) AS mean_score, count(score) AS scored FROM j GROUP BY 1",
    "a10_judge_summary": f"{_J} SELECT judge, count(*) AS n, {_RATE} AS pass_rate, round(avg(score), 6) AS mean_score, count(score) AS scored FROM j GROUP BY 1",
    "a11_by_category": f"{_J} SELECT category, count(*) AS n, round(avg(CASE WHEN score - 1 <> 0 THEN score - 1 END), 6) AS scope FROM j GROUP BY 1",
    "a12_judge_agreement": f"{_J} SELECT a.judge AS j1, b.judge AS j2, count(*) AS n, round(avg((a.pass = b.pass)::INT), 6) AS same_verdict, round(avg(abs(a.score - b.score)), 6) AS mean_gap, round(avg((a.score = b.score)::INT), 6) AS exact, round(avg((abs(a.score - b.score) <= 1)::INT), 6) AS within_one FROM j a JOIN j b ON a.qid = b.qid AND a.judge < b.judge GROUP BY ALL",
    "a13_brier": f"""{_J}, o AS (SELECT judge, coalesce((score - 1) / 4, 0.5) AS p, count(*) FILTER (pass) OVER w - pass::INT AS yes, count(*) OVER w - 1 AS n FROM j WINDOW w AS (PARTITION BY qid))
SELECT judge, round(avg(power(p - (yes > n - yes)::INT, 2)), 6) AS brier, count(*) AS n FROM o WHERE yes <> n - yes GROUP BY 1""",
    "a14_answer_metrics": f"WITH {_METRICS} SELECT * FROM a14",
    "a16_without_same_family": f"{_J} SELECT generator, {_RATE} AS pass_rate, count(*) AS n FROM j WHERE judge <> CASE regexp_extract(generator, '[0-9]+')::INT % 3 WHEN 0 THEN 'style' WHEN 1 THEN 'safety' ELSE 'none' END GROUP BY 1",
    "a18_category_counts": f"{_J} SELECT category, count(*) AS n FROM j GROUP BY 1 ORDER BY n DESC, category",
    "a19_hardest_first": f"{_J}, g AS (SELECT category, generator, {_RATE} AS pass_rate, count(*) AS n FROM j GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY category ORDER BY pass_rate NULLS LAST, n DESC, generator)::INTEGER AS place FROM g",
    "a20_agreement": f"{_J}, p AS (SELECT qid, count(*) FILTER (pass) AS y, count(*) FILTER (NOT pass) AS n, max(score) - min(score) AS spread FROM j GROUP BY 1) SELECT qid, CASE WHEN y <> n THEN y > n END AS majority, round(greatest(y, n) / (y + n)::DOUBLE, 6) AS share, least(y, n) = 0 AS unanimous, spread FROM p",
    "a21_matrix_cube": f"{_J} SELECT generator, judge, count(*) AS n, {_RATE} AS pass_rate FROM j GROUP BY CUBE (generator, judge)",
    "a21_leniency": f"{_J}, p AS (SELECT judge, count(*) FILTER (pass) AS y, count(*) AS n FROM j GROUP BY 1) SELECT judge, round(y / n::DOUBLE - (sum(y) OVER () - y) / (sum(n) OVER () - n)::DOUBLE, 6) AS leniency FROM p",
    "a23_composite": f"{_J}, m AS (SELECT qid, judge, avg(score) AS m FROM j GROUP BY ALL) SELECT qid, round(avg(m), 6) AS composite, count(m) AS n FROM m GROUP BY 1",
    "a25_score_ci": f"""{_J}, s AS (SELECT generator, judge, avg(score) AS m, count(score) AS n, CASE WHEN count(score) = 1 THEN 0 ELSE stddev_samp(score) * CASE WHEN count(score) <= 31 THEN {list(stats.T95)}[count(score) - 1] ELSE 1.96 END / sqrt(count(score)) END AS h FROM j GROUP BY ALL)
SELECT generator, judge, round(m, 3) AS mean, CASE WHEN n > 0 THEN round(greatest(1, m - h), 3) END AS low, CASE WHEN n > 0 THEN round(least(5, m + h), 3) END AS high, n FROM s""",
    "a26_icc": f"""{_J}, x AS (SELECT qid, judge, score AS x FROM j WHERE qid IN (SELECT qid FROM j GROUP BY qid HAVING count(score) = 3)),
w AS (SELECT sum(x) AS s, sum(x * x) AS ss, count(*) AS c FROM x), t AS (SELECT sum(s * s) AS tt, count(*)::DOUBLE AS n FROM (SELECT sum(x) AS s FROM x GROUP BY qid)), r AS (SELECT sum(s * s) AS rr FROM (SELECT sum(x) AS s FROM x GROUP BY judge)),
v AS (SELECT n, tt / 3 - s * s / c AS r1, rr / n - s * s / c AS c1, ss - s * s / c AS tot FROM w, t, r), m AS (SELECT n, r1 / (n - 1) AS msr, c1 / 2 AS msc, (tot - r1 - c1) / ((n - 1) * 2) AS mse FROM v)
SELECT round((msr - mse) / (msr + 2 * mse + 3 * (msc - mse) / n), 3) AS icc, n::BIGINT AS n FROM m""",
    "a27_correlations": f"""{_J}, p AS (SELECT qid, max(score) FILTER (judge = 'style') AS a, max(score) FILTER (judge = 'depth') AS b FROM j GROUP BY 1), q AS (SELECT a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM q)
SELECT round(corr(a, b), 3) AS pearson, round(corr(ra, rb), 3) AS spearman, count(*) AS n FROM r""",
    "a28_kappa": f"""{_J}, p AS (SELECT qid, bool_or(pass) FILTER (judge = 'style') AS a, bool_or(pass) FILTER (judge = 'depth') AS b FROM j GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS po, avg(a::INT) * avg(b::INT) + avg((NOT a)::INT) * avg((NOT b)::INT) AS pe FROM p)
SELECT round((po - pe) / (1 - pe), 3) AS kappa, n::BIGINT AS n FROM s""",
    "a29_alpha": f"""{_J}, v AS (SELECT qid, score AS v FROM j WHERE score IS NOT NULL AND qid IN (SELECT qid FROM j GROUP BY qid HAVING count(score) >= 2)), c AS (SELECT qid, v, count(*) AS c FROM v GROUP BY ALL), s AS (SELECT qid, count(*) AS m FROM v GROUP BY 1),
o AS (SELECT a.v AS v, b.v AS w, sum(a.c * (b.c - (a.v = b.v)::INT) / (m - 1)::DOUBLE) AS o FROM c a JOIN c b USING (qid) JOIN s USING (qid) GROUP BY ALL), n AS (SELECT v, sum(o) AS n FROM o GROUP BY v),
d AS (SELECT x.v AS v, y.v AS w, x.n AS nx, y.n AS ny, power((SELECT sum(z.n) FROM n z WHERE z.v BETWEEN least(x.v, y.v) AND greatest(x.v, y.v)) - (x.n + y.n) / 2, 2) AS d FROM n x, n y), t AS (SELECT sum(n) AS n FROM n)
SELECT round(1 - (sum(coalesce(o, 0) * d) / any_value(n)) / (sum(nx * ny * d) / (any_value(n) * (any_value(n) - 1))), 3) AS alpha, round(any_value(n), 6) AS values FROM d LEFT JOIN o USING (v, w), t""",
    "a30_pairwise": f"{_J} SELECT round(avg((a.score = b.score)::INT), 3) AS exact, round(avg((abs(a.score - b.score) <= 1)::INT), 3) AS within_one, count(*) AS pairs FROM j a JOIN j b ON a.qid = b.qid AND a.judge < b.judge WHERE a.score IS NOT NULL AND b.score IS NOT NULL",
    "a32_retrieval_check": f"WITH {_METRICS} SELECT count(*) AS n, round(avg(hit::INT), 6) AS hit_rate, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM a14",
    "a48_self_grading": f"{_J} SELECT DISTINCT generator, judge FROM j WHERE right(generator, 1) = (length(judge) % 10)::VARCHAR",
    "j07_retest": f"{_J}, p AS (SELECT category, judge, qid // 2 AS p, max(score) FILTER (qid % 2 = 0) AS a, max(score) FILTER (qid % 2 = 1) AS b FROM j GROUP BY ALL) SELECT judge, count(*) AS n, round(avg((a <> b)::INT), 6) AS flip_rate, round(avg(abs(a - b)), 6) AS mean_gap FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1",
    "p10_ok_judgements": f"{_J} SELECT qid, count(*)::INTEGER AS n, count(score)::INTEGER AS ok, string_agg(judge, ',' ORDER BY judge) FILTER (score IS NOT NULL) AS judges FROM j GROUP BY 1",
    "p12_usable": f"{_J}, x AS (SELECT generator FROM j GROUP BY 1 HAVING {_RATE} < 0.62) SELECT generator, count(*) AS n FROM j WHERE generator NOT IN (FROM x) GROUP BY 1",
    "w32_plan_tasks": f"{_J} SELECT r AS rep, category, generator FROM (SELECT unnest([0, 1])::BIGINT AS r), (SELECT DISTINCT category FROM j), (SELECT DISTINCT generator FROM j) ORDER BY ALL",
    "r03_calibration": f"{_J} SELECT judge, count(*) FILTER (score BETWEEN 2 AND 5) AS met, count(*) FILTER (NOT coalesce(score BETWEEN 2 AND 5, false)) AS missed, count(*) AS done FROM j GROUP BY 1",
    "st15_resumed_run": """WITH q AS (SELECT doc_id AS qid, toxic, length(coalesce(text, '')) AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT AS s FROM labels JOIN documents USING (doc_id)),
t AS (SELECT q.*, generator, rep FROM q, (VALUES ('small'), ('large'), ('other')) AS g(generator), (VALUES (1), (2)) AS r(rep) WHERE rep = 1 OR toxic = 1)
SELECT qid, generator, rep::INTEGER AS rep, judge, CASE WHEN s % 5 = 0 THEN 'not_covered' ELSE 'ok' END AS answered, (s + length(generator) * rep) % 7 AS answer, (s + length(generator) * rep) % 7 > bar AS pass
FROM t, (VALUES ('strict', 3), ('mild', 1)) AS j(judge, bar) WHERE size > 0""",
}
