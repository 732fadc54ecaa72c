"""Masking of people's names with lexicons as tables: word lists, rosters, context and near spellings.

A first pass over the texts learns names from what stands around them; a second masks words by rules on
the word, its neighbours and the lexicons. Only capitalised or listed words are exploded and joined;
their masks come back to the texts as short arrays, in one join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STUDENT, PERSON = "[student]", "[person]"
# Endings of inflected words with what replaces them, titles, phrases before a name, the rule for
# near spellings (share of equal letters for any word, of agreement for longer ones).
ENDINGS = (
    ("ies", "y"), ("ied", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e"), ("d", ""), ("ing", ""), ("ing", "e"), ("ly", ""), ("er", ""), ("ers", ""), ("ers", "e"), ("ization", "ize"), ("ation", "ate"), ("ness", ""), ("ment", ""),
)
DOUBLING = ("ed", "ing", "er", "ers")
TITLES = r"^(?:prof|professor|dr|mr|mrs|ms|mx)$"
BEFORE = r"\b(?i:my name is|name's|meet|named|called on|ask)\s+(\p{Lu}\p{L}+)"
PIECE = r"(\p{L}[\p{L}\p{N}'’-]*|\P{L}+)"
LEAST_RATIO, LEAST_WINKLER = 0.9, 0.93


def stems(word: Column) -> Column:
    """The word and what it may be inflected from."""
    out = [word]
    for end, new in ENDINGS:
        fits = F.endswith(word, F.lit(end)) & (F.length(word) >= 4)
        stem = F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(new))
        out.append(F.when(fits & (F.length(stem) >= 3), stem))
        if end in DOUBLING:
            twice = F.substring(stem, -1, 1) == F.substring(stem, F.length(stem) - 1, F.lit(1))
            out.append(F.when(fits & (F.length(stem) >= 4) & twice, F.substring(stem, F.lit(1), F.length(stem) - 1)))
    return F.array_distinct(F.array_compact(F.array(*out)))


def known_words(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The tokens (column w, lower case) that a dictionary (column w) has, regular inflections included."""
    each = tokens.select("w").distinct().select("w", F.explode(stems(F.col("w"))).alias("stem"))
    return each.join(dictionary.select(F.col("w").alias("stem")).distinct(), "stem", "left_semi").select("w").distinct()


def scrub_list(people: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(w, kind) from people (first, last, id): every part of a name is exact, ids of three characters are
    ids, and openings of three to five letters of a long first name are short forms, if no words."""
    part = lambda c: F.explode(F.split(F.lower(F.col(c)), r"[\s'’-]+"))
    exact = people.select(part("first").alias("w")).union(people.select(part("last"))).filter("length(w) >= 2").distinct()
    ids = people.select(F.lower("id").alias("w")).filter("length(w) >= 3").distinct()
    first = people.select(part("first").alias("f")).filter("length(f) >= 6")
    short = first.select("f", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5))).alias("k")).filter("k < length(f) - 1").select(F.expr("substring(f, 1, k)").alias("w")).distinct()
    short = short.join(known_words(short, dictionary), "w", "left_anti")
    ranked = exact.withColumn("kind", F.lit("1 exact")).union(ids.withColumn("kind", F.lit("2 id"))).union(short.withColumn("kind", F.lit("3 short")))
    return ranked.groupBy("w").agg(F.substring(F.min("kind"), 3, 9).alias("kind"))


def context_names(texts: DataFrame, text_col: str, known: DataFrame) -> DataFrame:
    """(w): names that follow an introduction anywhere, of three letters or more, unless known words."""
    found = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(BEFORE), 1)).alias("n")).select(F.lower("n").alias("w"))
    return found.filter("length(w) >= 3").distinct().join(known, "w", "left_anti")


def equal_share(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def winkler(a: str, b: str) -> float:
    """Jaro's agreement of letters near each other, raised for a common opening of up to four."""
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    m, swapped = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro)


def near_spellings(tokens: DataFrame, pool: DataFrame, least: int = 5) -> DataFrame:
    """(w): tokens of ``least`` letters or more that are spelt nearly like a name of the pool.

    Only pairs with two letter pairs in common are compared; each distinct token is, whatever its number.
    """
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    a = tokens.select("w").distinct().filter(F.length("w") >= least).select("w", F.explode(pairs(F.col("w"))).alias("g"))
    b = pool.select(F.col("w").alias("name")).distinct().filter(F.length("name") >= least).select("name", F.explode(pairs(F.col("name"))).alias("g"))
    met = a.join(b, "g").filter(F.abs(F.length("w") - F.length("name")) <= 4).groupBy("w", "name").agg(F.count("*").alias("n")).filter("n >= 2")

    @F.pandas_udf("boolean")
    def near(ws: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([equal_share(w, n) >= LEAST_RATIO or (len(w) >= 6 and winkler(w, n) >= LEAST_WINKLER) for w, n in zip(ws, names, strict=True)], dtype=bool)

    return met.filter(near("w", "name")).select("w").distinct()


def _bare(word: Column) -> Column:
    """A word in lower case without a possessive ending."""
    return F.regexp_replace(F.lower(word), "['’]s$", "")


def mask_names(texts: DataFrame, id_col: str, text_col: str, listed: DataFrame, given: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, masked, n): texts with listed people as [student], other people as [person], and the masks set.

    ``listed``: (w, kind) of ``scrub_list``; ``given``: (w) given names; ``dictionary``: (w) common words.
    Ids go wherever they stand. Another listed word goes with a capital, or from four letters on, unless it is a common word: that goes only
    with a capital that does not open a sentence, or beside a name. Of other capitalised words go those learned from
    introductions, near spellings of listed names, those after a title, and given names; common ones stay
    where they open a sentence. Neighbouring masks become one. Null texts stay null.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = rows.filter("text IS NOT NULL").select("id", F.regexp_extract_all("text", F.lit(PIECE), 1).alias("p"))
    at = F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("raw"), F.coalesce(F.get("p", i - 1), F.lit("")).alias("gap"), F.coalesce(F.get("p", i - 2), F.lit("")).alias("prev"), F.coalesce(F.get("p", i + 2), F.lit("")).alias("next")))
    words = pieces.select("id", F.explode(F.filter(at, lambda x: F.regexp_like(x["raw"], F.lit(r"^\p{L}")))).alias("t")).select("id", "t.*")
    words = words.withColumns({"w": _bare(F.col("raw")), "cap": F.regexp_like("raw", F.lit(r"^\p{Lu}")), "start": (F.col("i") == 0) | F.regexp_like("gap", F.lit(r"[.?!:;\n]"))})
    caps = words.filter("cap").select("w").distinct()
    common = known_words(words.select("w"), dictionary)
    names = listed.select("w").union(given.select("w")).distinct()
    learned = context_names(texts, text_col, known_words(caps, dictionary))
    near = near_spellings(caps.join(common, "w", "left_anti").join(names, "w", "left_anti"), listed.filter("kind = 'exact'"))
    marks = (
        listed.select("w", F.when(F.col("kind") == "id", "id").otherwise("listed").alias("m"))
        .union(given.select("w", F.lit("given")))
        .union(learned.select("w", F.lit("learned")))
        .union(near.select("w", F.lit("near")))
    )
    marks = marks.groupBy("w").agg(F.collect_set("m").alias("m"))  # five marks at most
    held = words.join(marks, "w", "left").join(common.withColumn("common", F.lit(True)), "w", "left")
    beside = names.withColumn("b", F.lit(True))
    for side in ("prev", "next"):
        held = held.withColumn("__s", F.when(F.regexp_like(side, F.lit(r"^\p{Lu}")), _bare(F.col(side)))).join(beside.withColumnRenamed("b", f"{side}_name").withColumnRenamed("w", "__s"), "__s", "left").drop("__s")
    has = lambda m: F.coalesce(F.array_contains("m", m), F.lit(False))
    is_common, beside_name = F.coalesce("common", F.lit(False)), F.coalesce("prev_name", "next_name", F.lit(False))
    cap, inside = F.col("cap"), ~F.col("start")
    student = F.when(is_common, cap & (inside | beside_name)).otherwise(cap | (F.length("w") >= 4)) & has("listed") | has("id") & ~is_common
    person = cap & ((has("learned") & (~is_common | inside)) | (F.regexp_like(F.lower("prev"), F.lit(TITLES)) & (~is_common | inside)) | (has("given") & (inside | ~is_common | beside_name)))
    mask = F.when(student, STUDENT).when(person & ~has("near"), PERSON).when(cap & has("near"), STUDENT).when(person, PERSON)
    hits = held.withColumn("mask", mask).filter("mask IS NOT NULL").select("id", "i", F.concat("mask", F.regexp_extract("raw", "(['’]s)?$", 1)).alias("mask"))
    of_text = hits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "mask"))).alias("masks"), F.count("*").alias("n"))  # of one text
    back = rows.join(of_text, "id", "left")
    put = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(PIECE), 1), lambda x, i: F.coalesce(F.try_element_at("masks", i), x)), "")
    folded = F.regexp_replace(put, r"(?:\[person\]\s+)*\[student\](?:\s+\[(?:student|person)\])*", STUDENT)
    folded = F.regexp_replace(folded, r"\[person\](?:\s+\[person\])+", PERSON)
    return back.select("id", F.when(F.col("n").isNull(), F.col("text")).otherwise(folded).alias("masked"), F.coalesce("n", F.lit(0)).alias("n"))


def residual_names(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, w, n): listed names that masked texts still hold with a capital, common words left out."""
    found = texts.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"(\p{Lu}[\p{L}'’-]*)"), 1)).alias("raw"))
    found = found.select("id", _bare(F.col("raw")).alias("w"))
    wanted = names.select("w").distinct()
    return found.join(wanted.join(known_words(wanted, dictionary), "w", "left_anti"), "w", "left_semi").groupBy("id", "w").agg(F.count("*").alias("n"))
