"""Typed reading and checking of model replies, records and slide specifications in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import speech
from millrace.functions import text as hygiene


def classifier(reply: Column, kinds: list[str], courses: list[str]) -> Column:
    """struct(incident, kind, course, item, confidence); null where there is no flag.

    Unknown kinds and courses are null, confidence is held between 0 and 1 (0 where it is no number).
    """
    j = F.from_json(hygiene.extract_json(reply), "incident boolean, type string, course string, item string, confidence string")
    item = F.nullif(F.substring(F.trim(F.regexp_replace(j["item"], r"\s+", " ")), 1, 120), F.lit(""))
    sure = F.coalesce(F.least(F.greatest(j["confidence"].try_cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    known = lambda c, among: F.when(c.isin(*among), c)
    return F.when(
        j["incident"].isNotNull(), F.struct(j["incident"].alias("incident"), known(j["type"], kinds).alias("kind"), known(j["course"], courses).alias("course"), item.alias("item"), sure.alias("confidence"))
    )


def choice(reply: Column, field: str, among: list[str], reason_chars: int = 200) -> Column:
    """struct(value, reason): a reply that names one of some values; null for any other."""
    j = F.from_json(hygiene.extract_json(reply), f"`{field}` string, reason string")
    return F.when(j[field].isin(*among), F.struct(j[field].alias("value"), F.substring(F.coalesce(j["reason"], F.lit("")), 1, reason_chars).alias("reason")))


def themes(reply: Column, questions: Column, most: int = 8, examples: int = 3) -> Column:
    """Array of struct(label, count, examples), largest first: labels scrubbed, counts within the number of
    questions, examples named by their numbers; null where no theme is usable."""
    j = F.from_json(hygiene.extract_json(reply), "themes array<struct<label: string, count: string, examples: array<int>>>")
    total = F.size(questions)

    def theme(t: Column, i: Column) -> Column:
        label = F.substring(hygiene.scrub(F.trim(F.regexp_replace(F.coalesce(t["label"], F.lit("")), r"\s+", " "))), 1, 80)
        count = F.greatest(F.lit(0), F.least(F.coalesce(t["count"].try_cast("int"), F.lit(0)), total))
        named = F.filter(F.coalesce(t["examples"], F.array().cast("array<int>")), lambda n: (n >= 1) & (n <= total))
        shown = F.slice(F.array_distinct(F.transform(named, lambda n: F.get(questions, n - 1))), 1, examples)
        return F.struct((-count).alias("minus"), i.alias("i"), label.alias("label"), count.alias("count"), shown.alias("examples"))

    found = F.filter(F.transform(F.slice(j["themes"], 1, most), theme), lambda t: t["label"] != "")
    ordered = F.transform(F.array_sort(found), lambda t: F.struct(t["label"].alias("label"), t["count"].alias("count"), t["examples"].alias("examples")))
    return F.when(F.size(ordered) > 0, ordered)


def alignment_words(reply: Column) -> Column:
    """Array of struct(start, word) of a forced alignment; entries without a time or a word go."""
    words = F.from_json(reply, "words array<struct<text: string, start: double>>")["words"]
    pairs = F.transform(F.coalesce(words, F.array().cast("array<struct<text: string, start: double>>")), lambda w: F.struct(w["start"].alias("start"), F.trim(F.coalesce(w["text"], F.lit(""))).alias("word")))
    return F.filter(pairs, lambda w: (w["word"] != "") & w["start"].isNotNull())


#: Kinds of a helper slide, and its sizes.
SLIDE_KINDS, TITLE_MOST, BULLET_MOST, BULLETS = ("bullets", "diagram", "code", "compare"), 80, 120, (3, 5)
_SPEC = "kind string, title string, bullets array<string>, sources array<string>"


def spec_problem(spec: Column) -> Column:
    """The first thing wrong with a slide of bullets (of other kinds: with its kind, title and sources)."""
    j = F.from_json(spec, _SPEC)
    text = lambda t, most, name: F.coalesce(
        speech.first_problem([(t.isNull(), f"{name} must be text"), (speech.clean_speech(t) == "", f"{name} is empty"), (F.length(speech.clean_speech(t)) > most, f"{name} is too long")]),
        F.concat(F.lit(f"{name}: "), speech.speech_problem(t)),
    )
    count = F.coalesce(F.size(j["bullets"]), F.lit(-1))
    counted = F.when(count < 0, "bullets must be a list").when(~count.between(*BULLETS), "wrong number of bullets")
    each = F.get(F.filter(F.transform(j["bullets"], lambda b: text(b, BULLET_MOST, "bullet")), lambda p: p.isNotNull()), F.lit(0))
    links = F.exists(F.coalesce(j["sources"], F.array().cast("array<string>")), lambda u: ~F.regexp_like(F.trim(u), F.lit(r"^https://[^/@\s\"'<>\\`]+(?:/[^\s\"'<>\\`]*)?$")))
    kind = speech.first_problem([(j["kind"].isNull() | ~j["kind"].isin(*SLIDE_KINDS), "unknown kind")])
    return F.coalesce(kind, text(j["title"], TITLE_MOST, "title"), F.when(j["kind"] == "bullets", F.coalesce(counted, each)), F.when(links, "sources must be https links"))


_RECORD = "question string, category string, month string, reference_answer string, type string, expected_slides array<string>, must_include array<string>, must_not array<string>"


def record_problem(line: Column, categories: list[str], types: list[str]) -> Column:
    """The first thing wrong with a question record; the text itself is never named. A line is parsed once for
    all that is asked of it."""
    return F.get(F.transform(F.array(F.from_json(line, _RECORD)), lambda j: _record_problem(j, categories, types)), F.lit(0))


def _record_problem(j: Column, categories: list[str], types: list[str]) -> Column:
    category = F.upper(F.trim(F.coalesce(j["category"], F.lit(""))))
    leaks = lambda t: F.size(F.coalesce(hygiene.leak_reasons(t), F.array().cast("array<string>"))) > 0
    listed = lambda a: F.coalesce(F.exists(a, lambda x: x.isNotNull() & leaks(x)), F.lit(False))
    return speech.first_problem([
        (j.isNull(), "not a JSON object"), (F.trim(F.coalesce(j["question"], F.lit(""))) == "", "question is empty"), (~category.isin(*categories), "unknown category"),
        ((F.coalesce(j["month"], F.lit("")) != "") & ~F.regexp_like(j["month"], F.lit(r"^\d{4}-\d{2}$")), "month must be YYYY-MM"), (leaks(j["question"]), "question leaks"), (leaks(j["reference_answer"]), "reference_answer leaks"),
        (j["type"].isNotNull() & ~j["type"].isin(*types), "unknown type"), (F.coalesce(F.exists(j["expected_slides"], lambda s: ~F.regexp_like(s, F.lit(r"^\d{5}-s\d{2}-\d{3}$"))), F.lit(False)), "expected_slides must be slide ids"),
        (listed(j["must_include"]), "must_include leaks"), (listed(j["must_not"]), "must_not leaks"),
    ])


def response(kind: Column, covered: Column, segments: Column, text: Column, message: Column) -> Column:
    """struct(status, outcome, source, message) of a playlist, as judges see it.

    A web answer is ok and its own source; a covered one with segments is ok; a covered one without is
    ok with what answered as its source; all else is not covered, with the reply's words where the
    FAQ or a referral gave them.
    """
    told = F.when(kind == "faq", F.concat(F.lit("FAQ answer: "), hygiene.clip(text, 700))).when(kind == "logistics", F.concat(F.lit("referral: "), hygiene.clip(message, 300)))
    shown, is_covered = F.coalesce(segments, F.lit(0)) > 0, F.coalesce(covered, F.lit(False))
    is_web = F.coalesce(kind == "web", F.lit(False))
    status = F.when(is_web | is_covered, "ok").otherwise("not_covered")
    source = F.when(is_web, "web").when(is_covered & ~shown, F.coalesce(F.nullif(kind, F.lit("")), F.lit("answer")))
    return F.struct(status.alias("status"), kind.alias("outcome"), source.alias("source"), F.when(status == "not_covered", told).alias("message"))


#: The scale of scores, what a verdict may be, and how much of the words around it is kept.
SCALE, VERDICTS, RATIONALE_MOST, ISSUE_MOST, ISSUES = (1, 5), ("pass", "fail"), 600, 200, 8
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _short(value: Column, most: int) -> Column:
    """One line of at most so many characters, an ellipsis as the last one where some were cut."""
    line = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 1), F.lit("…")))


def judgement(reply: Column, dimensions: list[str]) -> Column:
    """struct(problem, scores, verdict, rationale, issues) of a judge's reply, which may stand in fences or talk.

    ``problem`` names the first thing wrong, and all else is null then: no JSON, no object of scores, a score that
    is no number or outside the scale (by dimension, in their order), no verdict. Scores are rounded, halves
    to even; one that is null or not there is null. Issues that are no list are one issue; null ones go.
    """
    fields = "scores map<string, string>, verdict string, rationale string, issues string"
    read = lambda text: F.struct(F.try_parse_json(text).isNotNull().alias("valid"), F.from_json(text, fields).alias("j"))
    # What was parsed is an argument, so that it is parsed once for all that is asked of it.
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return bound(read(hygiene.extract_json(reply)), lambda r: _judged(r["valid"], r["j"], dimensions))


def _judged(valid: Column, j: Column, dimensions: list[str]) -> Column:
    def score(dimension: str) -> Column:
        raw = j["scores"][dimension]
        number = F.when(F.regexp_like(raw, F.lit(_NUMBER)), F.trim(raw).try_cast("double")).when(raw == "true", 1.0).when(raw == "false", 0.0)
        return F.bround(number, 0)

    faults = []
    for d in dimensions:
        given = j["scores"][d].isNotNull()
        faults += [(given & score(d).isNull(), f"score {d} is not a number"), (given & ~score(d).between(*SCALE), f"score {d} is outside {SCALE[0]} to {SCALE[1]}")]
    verdict = F.lower(F.trim(F.coalesce(j["verdict"], F.lit(""))))
    problem = speech.first_problem([(~valid, "reply is not JSON"), (j["scores"].isNull(), "reply has no scores object"), *faults, (~verdict.isin(*VERDICTS), "verdict must be pass or fail")])
    listed = F.coalesce(F.from_json(j["issues"], "array<string>"), F.when(F.coalesce(j["issues"], F.lit("")) != "", F.array(j["issues"])), F.array().cast("array<string>"))
    issues = F.slice(F.transform(F.filter(listed, lambda i: i.isNotNull()), lambda i: _short(i, ISSUE_MOST)), 1, ISSUES)
    fine = problem.isNull()
    scores = F.struct(*(score(d).cast("int").alias(d) for d in dimensions))
    return F.struct(
        problem.alias("problem"), F.when(fine, scores).alias("scores"), F.when(fine, verdict).alias("verdict"),
        F.when(fine, _short(j["rationale"], RATIONALE_MOST)).alias("rationale"), F.when(fine, issues).alias("issues"),
    )
