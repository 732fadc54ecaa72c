"""Whether texts draw on their material: stems of content words, vocabulary and echo problems.

Words are rows: each text's words are counted before they are stemmed, so a word that a text repeats is handled
once, and the vocabulary of a group's material is a set of stems that the words are joined to. Runs of words are
hashed by nothing and compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as texts

# Past forms that no suffix rule reaches, with the form to use, and words that only look like past forms.
IRREGULAR = {
    "came": "come", "told": "tell", "brought": "bring", "thought": "think", "taught": "teach", "gave": "give",
    "saw": "see", "went": "go", "ran": "run", "found": "find", "felt": "feel", "met": "meet", "built": "build",
    "chose": "choose", "chosen": "choose", "wrote": "write", "written": "write", "spoke": "speak",
    "began": "begin", "begun": "begin", "drew": "draw", "drawn": "draw", "grew": "grow", "grown": "grow",
    "knew": "know", "known": "know", "understood": "understand", "held": "hold", "led": "lead", "lost": "lose",
}
NOT_PAST = ("embed", "hundred", "speed", "seed", "feed", "breed", "proceed", "exceed", "succeed")
# Tokens, contractions, and suffixes of the rough stemmer.
TOKEN = r"[a-z][a-z'\-]*|[0-9][\p{L}\p{N}_.\-]*"
CONTRACTION = r"(?:n't|'d|'ll|'re|'ve|'m)$"
SUFFIXES = ("ational", "ations", "ation", "ings", "ing", "ies", "als", "al", "ers", "er", "es", "ed", "ly", "s", "e")
MAX_UNGROUNDED_SHARE, MIN_UNGROUNDED, ECHO_WORDS = 0.5, 2, 8
#: Function words that say nothing of a text's subject; callers pass the list of their language.
STOP_WORDS = ("the", "and", "for", "that", "this", "with", "are", "was", "were", "from", "have", "has", "not", "but", "you", "your", "our", "their", "its", "can", "will", "into", "which", "what", "when", "there")


def straight(text: Column) -> Column:
    """Lower case, with straight apostrophes."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[’‘ʼ]", "'"))


def with_stem(words: DataFrame, word: str = "w", name: str = "stem") -> DataFrame:
    """``words`` with the light stem of a lower-case word: a plural or third person goes first, then one ending of a
    verb or adverb, then a doubled consonant, then a silent e. Each rule is a projection of its own, so that
    none is evaluated more than once."""
    w, n = F.col(name), F.length(name)
    ends = lambda suffix, least: w.endswith(suffix) & (n >= least + len(suffix))
    less = lambda k: F.substring(w, F.lit(1), n - k)
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    edges = F.regexp_replace(word, r"^['\-]+|['\-]+$", "")
    out = words.withColumn(name, F.when(F.col(word).rlike(r"^['\-]|['\-]$"), edges).otherwise(F.col(word)))
    out = out.withColumn(name, F.when(w.endswith("'s"), less(2)).otherwise(w))
    out = out.withColumn(name, F.coalesce(F.get(F.array(table[w]), F.lit(0)), w))
    out = out.withColumn(name, F.when(ends("ies", 3), F.concat(less(3), F.lit("y"))).otherwise(w))
    out = out.withColumn(name, F.when(ends("es", 3), less(2)).when(ends("s", 3) & ~F.substring(w, -2, 1).isin("s", "u", "i"), less(1)).otherwise(w))
    verb = F.when(ends("ing", 3), less(3)).when(ends("ed", 3), less(2)).when(ends("ly", 4), less(2)).otherwise(w)
    stripped = F.when(w.isin(*NOT_PAST), w).when(ends("ied", 3), F.concat(less(3), F.lit("y"))).otherwise(verb)
    was, long = F.col("__was"), F.length("__was")
    short = (was.endswith("ing") | was.endswith("ed")) & (w != was) & ~(was.endswith("ied") & (long >= 6))
    doubled = (n >= 4) & (F.substring(w, -1, 1) == F.substring(w, -2, 1)) & ~F.substring(w, -1, 1).isin("l", "s", "z")
    out = out.withColumns({"__was": w, name: stripped})
    out = out.withColumn(name, F.when(short & doubled, less(1)).otherwise(w)).drop("__was")
    rest = [c for c in out.columns if c != name]
    # A generator, lest filters on the stem be pushed down and every rule be copied into them.
    return out.select(*rest, F.explode(F.array(F.when(ends("e", 3), less(1)).otherwise(w))).alias(name))


def rough_stem(word: Column) -> Column:
    """Without the longest listed suffix that leaves four letters."""
    rest = [s for s in SUFFIXES if s != "ies"]
    return F.when(word.rlike("^.{4,}ies$"), F.regexp_replace(word, "ies$", "y")).otherwise(F.regexp_replace(word, f"^(.{{4,}}?)(?:{'|'.join(rest)})$", "$1"))


def split_identifiers(text: Column) -> Column:
    """Words of camel case and of dotted or underscored names apart."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"), r"[_./\\]+", " ")


def analyzed(df: DataFrame, id_col: str, text_col: str, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, w, tf): rough stems of a text's identifiers and words, without stop words."""
    words = F.transform(F.regexp_extract_all(split_identifiers(F.col(text_col)), F.lit("[a-zA-Z][a-zA-Z0-9]{2,}"), F.lit(0)), F.lower)
    rows = df.select(F.col(id_col).alias("id"), F.explode(words).alias("w")).filter(~F.col("w").isin(*stop)).groupBy("id", "w").agg(F.count("*").alias("n"))
    return rows.groupBy("id", rough_stem(F.col("w")).alias("w")).agg(F.sum("n").alias("tf"))


def content_words(df: DataFrame, keys: list[str], text_col: str, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(keys, stem, n): a text's content words by stem, with how often they stand there. Numbers, short words,
    stop words (also as stems) and contractions are none."""
    words = F.regexp_extract_all(straight(F.col(text_col)), F.lit(TOKEN), F.lit(0))
    rows = df.select(*keys, F.explode(words).alias("w")).filter((F.length("w") >= 3) & ~F.col("w").isin(*stop) & ~F.col("w").rlike("^[0-9]") & ~F.col("w").rlike(CONTRACTION))
    counted = with_stem(rows.groupBy(*keys, "w").agg(F.count("*").alias("n")))
    return counted.filter((F.col("stem") != "") & ~F.col("stem").isin(*stop)).groupBy(*keys, "stem").agg(F.sum("n").alias("n"))


def _runs(text: Column) -> Column:
    return texts.ngrams(F.regexp_extract_all(straight(text), F.lit("[a-z0-9']+"), F.lit(0)), ECHO_WORDS)


def problems(narrations: DataFrame, materials: DataFrame | None, questions: DataFrame, id_col: str, group_col: str, text_col: str = "text", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, words, ungrounded, problem) of each narration against the material and questions of its group.

    ``vocabulary``: at least two content words, and more than half of them, are not in the material;
    ``echo``: it repeats eight words in a row of a question that the material does not have; else null. The
    first one that holds is named. Null texts have no words; a narration without a group has no material.
    Without ``materials`` the other narrations of its group are each one's material; ids must then be unique and not null.
    """
    held = narrations.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(text_col).alias("text"))
    of_group = lambda df: df.select(F.col(group_col).alias("g"), F.col(text_col).alias("text"))
    # Both uses of the words ask for ids, so that one shuffle serves them.
    counted = content_words(held.filter("id IS NOT NULL"), ["id", "g"], "text", stop)
    asked = of_group(questions).select("g", F.explode(_runs(F.col("text"))).alias("run")).distinct()
    echoes = held.select("id", "g", F.explode(F.array_distinct(_runs(F.col("text")))).alias("run")).join(asked, ["g", "run"], "left_semi")
    if materials is None:
        # What no other narration has is found by counting, without a join; those without a group stay apart.
        alone = counted.groupBy("g", "stem", F.when(F.col("g").isNull(), F.col("id"))).agg(F.count("*").alias("texts"), F.min("id").alias("id"), F.sum("n").alias("n")).filter("texts = 1")
        counted = counted.groupBy("id").agg(F.sum("n").alias("words")).join(alone.groupBy("id").agg(F.sum("n").alias("ungrounded")), "id", "left")
        echoes = echoes.groupBy("g", "run").agg(F.count("*").alias("texts"), F.min("id").alias("id")).filter("texts = 1")
    else:
        vocabulary = content_words(of_group(materials), ["g"], "text", stop).select("g", "stem", F.lit(True).alias("known"))
        counted = counted.join(vocabulary, ["g", "stem"], "left")
        counted = counted.groupBy("id").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("ungrounded"))
        drawn = of_group(materials).select("g", F.explode(_runs(F.col("text"))).alias("run")).join(asked, ["g", "run"], "left_semi")
        echoes = echoes.join(drawn.distinct(), ["g", "run"], "left_anti")
    echoes = echoes.select("id").distinct().withColumn("echo", F.lit(True))
    out = held.select("id").join(counted, "id", "left").join(echoes, "id", "left").na.fill(0, ["words", "ungrounded"])
    vocabulary_problem = (F.col("ungrounded") >= MIN_UNGROUNDED) & (F.col("ungrounded") > MAX_UNGROUNDED_SHARE * F.col("words"))
    return out.select(F.col("id").alias(id_col), "words", "ungrounded", F.when(vocabulary_problem, "vocabulary").when(F.col("echo"), "echo").alias("problem"))
