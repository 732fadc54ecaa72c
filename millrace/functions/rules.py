"""Ordered rules as data: the first pattern that matches names the outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first (pattern, name) rule found in the text; one CASE, no join."""
    out = None
    for pattern, name in rules:
        out = (F if out is None else out).when(F.regexp_like(text, F.lit(pattern)), name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def allowed(path: Column, allow: list[str], deny: list[str]) -> Column:
    """Whether some allowed pattern and no denied one is found."""
    hit = lambda patterns: F.coalesce(*(F.when(F.regexp_like(path, F.lit(p)), True) for p in patterns), F.lit(False))
    return hit(allow) & ~hit(deny)


def slide_id(course: Column, session: Column, number: Column) -> Column:
    return F.format_string("%05d-s%02d-%03d", course.cast("int"), session.cast("int"), number.cast("int"))


def slide_parts(text: Column) -> Column:
    """struct(course, session, number), null where the id has another form."""
    pattern = r"^(\d{5})-s(\d{2})-(\d{3})$"
    part = lambda g: F.regexp_extract(text, pattern, g)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.struct(part(1).alias("course"), part(2).cast("int").alias("session"), part(3).cast("int").alias("number")))


def wins(lead: Column, other: Column, margin: float) -> Column:
    """Whether one score leads by the margin, compared at six places."""
    return F.coalesce(F.round(lead - other, 6) >= margin, lead.isNotNull())


def ranged(text: Column, low: float, high: float) -> Column:
    """A number within its range, else null."""
    v = F.expr(f"try_cast({text} AS DOUBLE)") if isinstance(text, str) else text.try_cast("double")
    return F.when(v.between(low, high), v)


def trim_to_sentences(text: Column, most: int) -> Column:
    """Whole sentences from the start while they fit into ``most`` characters."""
    parts = F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]+\s*)"), 1)
    start = F.struct(F.lit("").alias("t"), F.lit(True).alias("open"))

    def step(held, s):
        fits = held["open"] & (F.length(F.rtrim(F.concat(held["t"], s))) <= most)
        return F.struct(F.when(fits, F.concat(held["t"], s)).otherwise(held["t"]).alias("t"), fits.alias("open"))

    return F.rtrim(F.aggregate(parts, start, step)["t"])


def redact_sentences(text: Column, pattern: str, mark: str) -> Column:
    """Sentences with the pattern replaced by a mark; separators stay."""
    parts = F.regexp_extract_all(text, F.lit(r"([^.!?\n]*[.!?\n]*)"), 1)
    return F.array_join(F.transform(parts, lambda s: F.when(F.regexp_like(s, F.lit(pattern)), F.lit(mark)).otherwise(s)), "")
