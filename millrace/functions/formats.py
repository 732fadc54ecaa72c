"""Checked inputs, paths, numbers as texts, rounding, prices and stamps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_question(text: Column, most: int) -> Column:
    """struct(question, problem): white space as single blanks; "empty" or "too long"."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    problem = F.when(plain == "", "empty").when(F.length(plain) > most, "too long")
    return F.struct(F.when(problem.isNull(), plain).alias("question"), problem.alias("problem"))


def clean_course(code: Column, known: list[str]) -> Column:
    """struct(course, problem): null for all courses, "unknown" for codes that are not known."""
    every = code.isNull() | code.isin("", "all")
    return F.struct(F.when(~every & code.isin(*known), code).alias("course"), F.when(~every & ~code.isin(*known), "unknown").alias("problem"))


def safe_filename(name: Column, most: int = 120) -> Column:
    """The last part of a path with letters, digits, dot, dash and underscore alone."""
    last = F.trim(F.regexp_extract(F.regexp_replace(name, r"\\", "/"), r"([^/]*)$", 1))
    kept = F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(kept, 1, most)


def boxes_path(image: Column) -> Column:
    """The word boxes beside a slide's image; null for thumbnails and other files."""
    path = F.regexp_replace(F.coalesce(image, F.lit("")), "^/+", "")
    fits = F.startswith(path, F.lit("slides/")) & F.endswith(path, F.lit(".webp")) & ~F.endswith(path, F.lit("-thumb.webp"))
    return F.when(fits, F.regexp_replace(path, r"\.webp$", ".boxes.json"))


def words_path(audio: Column) -> Column:
    """The word timings beside a clip; null for other files."""
    return F.when(F.endswith(audio, F.lit(".mp3")), F.regexp_replace(audio, r"\.mp3$", ".words.json"))


def session_of_path(path: Column) -> Column:
    """struct(course, session) of paths like .../70445/s06/file; null where they have another form."""
    pattern = r"(?:^|/)(\d{5})/s(\d{2})[^/]*(?:/|$)"
    part = lambda g: F.regexp_extract(path, pattern, g)
    return F.when(F.regexp_like(path, F.lit(pattern)), F.struct(part(1).alias("course"), part(2).cast("int").alias("session")))


_SPLIT = 134217729.0  # 2 ** 27 + 1


def round_exact(x: Column, digits: int) -> Column:
    """Rounded to ``digits`` places by the double's exact value, halves to even.

    The product with a power of ten is taken with its rounding error (by splitting into halves of 26
    bits), so that a value just below a half is not rounded up.
    """
    y = 10.0**digits
    high = x * _SPLIT - (x * _SPLIT - x)
    y_high = y * _SPLIT - (y * _SPLIT - y)
    low, y_low = x - high, y - y_high
    p = x * F.lit(y)
    error = ((high * y_high - p) + high * y_low + low * y_high) + low * y_low
    whole = F.floor(p).cast("double")
    above = (p - whole - 0.5) + error
    up = (above > 0) | ((above == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    return F.when(F.abs(p) >= 2.0**52, x).otherwise((whole + up.cast("int")) / F.lit(y))


def percent_text(rate: Column) -> Column:
    return F.when(rate.isNull(), "n/a").otherwise(F.concat(F.bround(rate * 100, 0).cast("long").cast("string"), F.lit("%")))


def number_text(x: Column, digits: int = 2) -> Column:
    """With a fixed number of places; "n/a" for null."""
    return F.when(x.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", round_exact(x, digits)))


def score_text(name: Column, mean: Column, n: Column) -> Column:
    """A cell of a score table, with the number of scores behind it."""
    none = F.when(name == "grounded", "n/a (no slides)").otherwise("n/a")
    return F.when(mean.isNull(), none).otherwise(F.concat(number_text(mean), F.coalesce(F.concat(F.lit(" (n="), n.cast("string"), F.lit(")")), F.lit(""))))


def to_rubric(share: Column) -> Column:
    """A share from 0 to 1 on the scale from 1 to 5."""
    return round_exact(F.lit(1.0) + F.lit(4.0) * share, 2)


def price_problem(checked: Column, listed: Column, prompt: Column, completion: Column, prompt_cap: float, completion_cap: float) -> Column:
    """Why a model may not be used by its prices a token: the first reason; caps are for a million tokens.

    ``checked``: whether its provider publishes prices; others always pass.
    """
    p, c = prompt * 1_000_000, completion * 1_000_000
    problem = (
        F.when(~F.coalesce(listed, F.lit(False)), "not listed").when(p.isNull() | c.isNull(), "no fixed price").when((p < 0) | (c < 0), "variable price").when((p > prompt_cap) | (c > completion_cap), "too dear")
    )
    return F.when(checked, problem)


def seconds(hours: Column, minutes: Column, secs: Column, millis: Column) -> Column:
    """A time stamp's parts as seconds; no hours count as 0."""
    return F.coalesce(hours, F.lit(0)) * 3600 + minutes * 60 + secs + millis / 1000


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def version_stamp(at: Column, digest: Column) -> Column:
    """UTC time and the start of a content hash."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(digest, 1, 8))


def effective(*sources: tuple[str, Column]) -> Column:
    """struct(value, source): the first value there is, and where it comes from."""
    value = F.coalesce(*(c for _, c in sources))
    named = None
    for name, c in sources:
        named = (F if named is None else named).when(c.isNotNull(), name)
    return F.struct(value.alias("value"), named.alias("source"))


#: What is sent first and last, so that a reader never finds an index without its files.
SENT = ((r"(^|/)manifest\.json$", 3), (r"(^|/)index(\.json|/)", 2), (r"(^|/)topics(\.json|/)", 1))


def sending_turn(path: Column) -> Column:
    """The turn in which a file is sent: media, topics, index, the manifest last."""
    turn = None
    for pattern, n in SENT:
        turn = (F if turn is None else turn).when(F.regexp_like(path, F.lit(pattern)), n)
    return turn.otherwise(0)
