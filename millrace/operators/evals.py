"""Agreement, scores and summaries over judgements: rows of qid, generator, category, judge, pass, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(condition: Column, digits: int = 6) -> Column:
    """Share of rows where a condition holds, nulls left out."""
    return F.round(F.avg(condition.cast("int")), digits)


def judge_pairs(j: DataFrame, on: str = "qid") -> DataFrame:
    """Each unordered pair of judges of one answer: j1 < j2 with both verdicts and scores."""
    a = j.select(on, F.col("judge").alias("j1"), F.col("pass").alias("p1"), F.col("score").alias("s1"))
    b = j.select(on, F.col("judge").alias("j2"), F.col("pass").alias("p2"), F.col("score").alias("s2"))
    return a.join(b, on).filter("j1 < j2")


def judge_agreement(j: DataFrame) -> DataFrame:
    """For each pair of judges: answers, share of equal verdicts, mean gap of scores, and shares of
    equal scores and of those within one."""
    gap = F.abs(F.col("s1") - F.col("s2"))
    return judge_pairs(j).groupBy("j1", "j2").agg(
        F.count("*").alias("n"), rate(F.col("p1") == F.col("p2")).alias("same_verdict"), F.round(F.avg(gap), 6).alias("mean_gap"),
        rate(gap == 0).alias("exact"), rate(gap <= 1).alias("within_one"),
    )


def majority(j: DataFrame) -> DataFrame:
    """For each answer the majority verdict (null on a tie), its share, and whether all agree."""
    per = j.groupBy("qid").agg(F.count_if("pass").alias("yes"), F.count_if(~F.col("pass")).alias("no"), (F.max("score") - F.min("score")).alias("spread"))
    most = F.greatest("yes", "no")
    return per.select(
        "qid", F.when(F.col("yes") != F.col("no"), F.col("yes") > F.col("no")).alias("majority"), F.round(most / (F.col("yes") + F.col("no")), 6).alias("share"), (F.least("yes", "no") == 0).alias("unanimous"), "spread",
    )


def brier_against_others(j: DataFrame, p_pass: str) -> DataFrame:
    """For each judge the mean square of its probability against the majority of the other judges;
    answers where these are tied are left out."""
    w = Window.partitionBy("qid")
    yes, all_ = F.count_if("pass").over(w), F.count("*").over(w)
    rows = j.withColumns({"others_yes": yes - F.col("pass").cast("int"), "others": all_ - 1})
    rows = rows.withColumn("others_no", F.col("others") - F.col("others_yes")).filter("others_yes <> others_no")
    y = (F.col("others_yes") > F.col("others_no")).cast("double")
    return rows.groupBy("judge").agg(F.round(F.avg(F.pow(F.col(p_pass) - y, 2)), 6).alias("brier"), F.count("*").alias("n"))


def mean_of_means(j: DataFrame, inner: list[str], outer: list[str], value: str = "score") -> DataFrame:
    """Mean over inner groups of their means: not the mean of all rows."""
    first = j.groupBy(*outer, *inner).agg(F.avg(value).alias("m"))
    return first.groupBy(*outer).agg(F.round(F.avg("m"), 6).alias("composite"), F.count("m").alias("n"))


def hardest_first(j: DataFrame) -> DataFrame:
    """Per question group (category, generator): pass rate and judgements, hardest first, then more judged."""
    g = j.groupBy("category", "generator").agg(rate(F.col("pass")).alias("pass_rate"), F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.asc_nulls_last("pass_rate"), F.desc("n"), "generator")))


def leniency(j: DataFrame) -> DataFrame:
    """Per judge: pass rate less that of all the others' verdicts."""
    per = j.groupBy("judge").agg(F.count_if("pass").alias("yes"), F.count("*").alias("n"))
    whole = per.agg(F.sum("yes").alias("all_yes"), F.sum("n").alias("all_n"))
    return per.crossJoin(whole).select("judge", F.round(F.col("yes") / F.col("n") - (F.col("all_yes") - F.col("yes")) / (F.col("all_n") - F.col("n")), 6).alias("leniency"))  # one row
