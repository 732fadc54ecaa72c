"""Guarded word rules over text, in the order of a registry, and lexicon-driven name masking.

Rules overlap and look at what stands around them, so texts go through Arrow in batches; the rule set
is data that callers give, together with a small default.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern, what takes its place, and optionally when: a pattern that must, or must not, follow."""

    pattern: str
    replacement: str
    followed_by: str | None = None
    not_followed_by: str | None = None


#: A default that shows the kinds of rules: plain, guarded, with an article before a vowel.
DEFAULT = (
    Rule(r"damn(?:ed)?", "darn"), Rule(r"hell", "heck", not_followed_by=r"o\b"), Rule(r"crap(?:py)?", "junk"), Rule(r"idiots?", "silly person"), Rule(r"stupid", "odd"), Rule(r"scum", "unkind people"),
    Rule(r"moron", "unwise person"), Rule(r"trash", "clutter", not_followed_by=r"\s+can\b"), Rule(r"worthless", "of little use"), Rule(r"pathetic", "sad"),
)


def _like(word: str, model: str) -> str:
    """The word in the case of the model: ALL, Capitalised or lower."""
    if model.isupper() and len(model) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def smoother(rules: tuple[Rule, ...] = DEFAULT) -> Callable[[str | None], tuple[str | None, int]]:
    """A function from a text to (text, replacements). Earlier rules claim their place first; later ones
    never touch it. "a" and "an" before a replaced word follow its first letter."""
    made = [(re.compile(rf"\b(?:{r.pattern})\b" + (f"(?={r.followed_by})" if r.followed_by else "") + (f"(?!{r.not_followed_by})" if r.not_followed_by else ""), re.I), r.replacement) for r in rules]

    def run(text: str | None) -> tuple[str | None, int]:
        if not text:
            return text, 0
        claimed: list[tuple[int, int, str]] = []
        for pattern, replacement in made:
            for m in pattern.finditer(text):
                if all(m.end() <= a or m.start() >= b for a, b, _ in claimed):
                    claimed.append((m.start(), m.end(), _like(replacement, m[0])))
        out, at = [], 0
        for a, b, word in sorted(claimed):
            before = text[at:a]
            article = re.search(r"\b(an?)(\s+)$", before, re.I)
            if article:
                right = _like("an" if word[:1].lower() in "aeiou" else "a", article[1] if len(article[1]) > 1 or article[1].islower() else article[1] + "x")
                before = before[: article.start()] + right + article[2]
            out += [before, word]
            at = b
        return "".join([*out, text[at:]]), len(claimed)

    return run


def smooth(text: Column, rules: tuple[Rule, ...] = DEFAULT) -> Column:
    """struct(text, n) of each row's text."""
    one = smoother(rules)

    @F.pandas_udf("text string, n int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["text", "n"])

    return run(text)


def mask_listed_names(df: DataFrame, id_col: str, text_col: str, names: DataFrame, common: DataFrame, mark: str = "[name]") -> DataFrame:
    """(id, n, words): occurrences of listed names that are no common words, by joins on tokens.

    ``names`` and ``common`` have a column w of lower-case words; both are joined, not broadcast by
    force, so they may be of any size. Words stand in the order of their first place.
    """
    tokens = df.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([\p{L}'-]+)"), 1)).alias("i", "raw"))
    tokens = tokens.withColumn("w", F.lower("raw")).filter(F.col("raw") != F.col("w"))  # a name is written with a capital
    hits = tokens.join(names.join(common, "w", "left_anti").distinct(), "w", "left_semi")
    return hits.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("w")), ",").alias("words"))
