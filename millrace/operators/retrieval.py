"""Ranking and rule-based selection of records for each question.

Input of the selection is a ranked table: qid, row_idx, score and the record's course, session,
slide_number, words (normalised; empty for a blank one) and leads (may be chosen for its own score).
All rules are windows over qid, so questions are independent and spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the selection rules.
TOP_K, MAX_SEGMENTS, RELATIVE_CUTOFF, COURSE_MARGIN, NOT_COVERED_THRESHOLD = 8, 5, 0.12, 0.01, 0.52

DECK = ("course", "session", "slide_number")


def best_first() -> tuple[Column, Column]:
    """Score descending, then row: the order of every ranking."""
    return F.desc("score"), F.asc("row_idx")


def normalised_words(*parts: Column) -> Column:
    """Lower-case letter and digit runs of all parts, joined by one space."""
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def rank(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rn, the place in the stable order (score descending, row ascending); ``k`` keeps the first."""
    out = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(*best_first())))
    return out.filter(F.col("rn") <= k) if k else out


def candidates(ranked: DataFrame, threshold: float | None = NOT_COVERED_THRESHOLD, cutoff: float = RELATIVE_CUTOFF, margin: float = COURSE_MARGIN, top: int = TOP_K) -> DataFrame:
    """Leaders near the best one, of its course (or nearly as good), without copies, the first ``top``."""
    rows = ranked.filter("leads AND NOT isnan(score)")
    if threshold is not None:
        rows = rows.filter(F.col("score") >= threshold)
    w = Window.partitionBy("qid").orderBy(*best_first())
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"best": F.first("score").over(first), "best_course": F.first("course").over(first)})
    rows = rows.filter((F.col("score") >= F.col("best") - cutoff) & ((F.col("course") == F.col("best_course")) | (F.col("score") >= F.col("best") - margin)))
    copies = Window.partitionBy("qid", "words").orderBy(*best_first())
    rows = rows.withColumn("nth", F.row_number().over(copies)).filter((F.col("nth") == 1) | (F.col("words") == ""))
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).drop("nth", "best", "best_course")


def gap_fills(pool: DataFrame, records: DataFrame) -> DataFrame:
    """The record between two candidates n and n + 2 of one session, scored as their average, unless
    it is a candidate already or a copy of one."""
    low = pool.select("qid", "course", "session", F.col("slide_number").alias("n"), F.col("score").alias("low"), F.col("row_idx").alias("low_idx"))
    high = pool.select("qid", "course", "session", (F.col("slide_number") - 2).alias("n"), F.col("score").alias("high"), F.col("row_idx").alias("high_idx"))
    gaps = low.join(high, ["qid", "course", "session", "n"]).withColumn("slide_number", F.col("n") + 1)
    gaps = gaps.join(pool.select("qid", *DECK), ["qid", *DECK], "left_anti")
    filled = gaps.join(records.select("row_idx", *DECK, "words"), list(DECK))
    copies = pool.filter("words <> ''").select("qid", "words").distinct()
    filled = filled.join(copies, ["qid", "words"], "left_anti")
    once = Window.partitionBy("qid", *DECK).orderBy("row_idx")
    filled = filled.withColumn("nth", F.row_number().over(once)).filter("nth = 1")
    return filled.select("qid", "row_idx", *DECK, "words", ((F.col("low") + F.col("high")) / 2).alias("score"), "low_idx", "high_idx")


def cut(pool: DataFrame, fills: DataFrame, most: int = MAX_SEGMENTS) -> DataFrame:
    """The best ``most`` by score; a fill enters right after the second of its neighbours."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *DECK)
    led = pool.select("qid", "row_idx", *DECK, "score", F.row_number().over(w).alias("r"))
    places = led.select("qid", F.col("row_idx").alias("i"), "r")
    joined = fills.join(places.select("qid", F.col("i").alias("low_idx"), F.col("r").alias("r1")), ["qid", "low_idx"])
    joined = joined.join(places.select("qid", F.col("i").alias("high_idx"), F.col("r").alias("r2")), ["qid", "high_idx"])
    merged = led.withColumn("fill", F.lit(0)).unionByName(joined.select("qid", "row_idx", *DECK, "score", F.greatest("r1", "r2").alias("r"), F.lit(1).alias("fill")))
    order = Window.partitionBy("qid").orderBy("r", "fill", F.desc("score"), *DECK)
    return merged.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= most).drop("pick", "r")


def select_segments(ranked: DataFrame, records: DataFrame, **rules) -> DataFrame:
    """All rules; ``place`` is the order of presentation (course, session, slide)."""
    pool = candidates(ranked, **rules)
    kept = cut(pool, gap_fills(pool, records))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*DECK, "row_idx")))


def one_course(ranked: DataFrame) -> DataFrame:
    """Only rows of the best hit's course."""
    whole = Window.partitionBy("qid").orderBy(*best_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranked.withColumn("__c", F.first("course").over(whole)).filter("course <=> __c").drop("__c")


def promoted_top(ranked: DataFrame, promoted: Column, n: int = 3, first: int = 2) -> DataFrame:
    """The ``n`` best, with up to ``first`` rows where ``promoted`` holds moved to the front."""
    mark = Window.partitionBy("qid", "p").orderBy(*best_first())
    rows = ranked.withColumn("p", promoted).withColumn("nth", F.row_number().over(mark))
    front = F.when(F.col("p") & (F.col("nth") <= first), 0).otherwise(1)
    order = Window.partitionBy("qid").orderBy(front, *best_first())
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).drop("p", "nth")


def threshold_summary(ranked: DataFrame, on_topic: Column, threshold: float) -> DataFrame:
    """Lowest best score on topic, highest off topic, their gap, and wrong declines and answers."""
    top = ranked.groupBy("qid").agg(F.max("score").alias("top"), F.max(F.when(on_topic, F.col("score"))).alias("own"), F.max(F.when(~on_topic, F.col("score"))).alias("other"))
    return top.agg(
        F.min("own").alias("lowest_on"),
        F.max("other").alias("highest_off"),
        (F.min("own") - F.max("other")).alias("gap"),
        F.count_if(F.col("own") < threshold).alias("wrong_declines"),
        F.count_if(F.col("other") >= threshold).alias("wrong_answers"),
    )
