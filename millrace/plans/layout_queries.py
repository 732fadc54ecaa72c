"""Laid-out pages: the words of documents are set in pages of 30 lines of 8 words, as the XML of an extractor."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.text_queries import _masked, _named
from millrace.session import table
from millrace.sources import layouts

_WORD = "([!-~\u00c0-\u024f]+)"
_PAGE, _LINE = 240, 8


def _files(spark, sf_dir):
    """(doc_id, xml): each document with words as one file of pages. What stands before a word depends on its place
    on the page alone, so it is looked up; only texts are dealt out, before they grow tenfold."""
    before = []
    for place in range(_PAGE):
        left, top = 64 * (place % _LINE) + 8, 16 * (place // _LINE) + 8
        line = "</line><line>" if place % _LINE == 0 and place else ""
        before.append(f'{line}<word xMin="{left}.000" yMin="{top}.000" xMax="{left + 48}.000" yMax="{top + 12}.000">')
    before[0] = '</line></block></flow></page><page width="640" height="800"><flow><block><line>' + before[0]
    before = F.array(*map(F.lit, before))
    whole = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    words = F.transform(F.regexp_extract_all(whole, F.lit(_WORD), F.lit(1)), lambda w, i: F.concat(F.get(before, i % _PAGE), w, F.lit("</word>")))
    made = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id", "text").select("doc_id", F.array_join(words, "\n").alias("xml")).filter("xml <> ''")
    return made.select("doc_id", F.concat(F.lit("<doc>"), F.expr("substring(xml, 30)"), F.lit("</line></block></flow></page></doc>")).alias("xml"))


def _told(words):
    size = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["x0"] + w["y1"])
    line = F.transform(words, lambda w: w["line"])
    return F.size(words).alias("n"), F.size(F.array_distinct(line)).alias("lines"), F.round(size, 4).alias("places"), F.md5(F.array_join(F.transform(words, lambda w: w["word"]), " ")).alias("words_md5")


def s27_page_words(spark, sf_dir):
    """Words and boxes of every page, in the order of the file."""
    pages = layouts.split_pages(_files(spark, sf_dir), "xml")
    return pages.select("doc_id", "page_no", *_told(F.col("words")))


def s27_publishable_words(spark, sf_dir):
    """The words of every page that may be shown: lines with addresses, numbers, named people or keys go."""
    pages = layouts.split_pages(_files(spark, sf_dir), "xml").withColumn("words", layouts.publishable(F.col("words")))
    return pages.select("doc_id", "page_no", *_told(F.col("words")))


def s27_recognised_order(spark, sf_dir):
    """Words as a recogniser gives them, lines from the bottom up and words from the right, put in reading order."""
    pages = layouts.split_pages(_files(spark, sf_dir), "xml")
    mixed = F.transform(F.reverse("words"), lambda w: w.withField("line", 1000 - w["line"]))
    return pages.select("doc_id", "page_no", layouts.reading_order(mixed).alias("words")).select("doc_id", "page_no", *_told(F.col("words")))


QUERIES = {f.__name__: f for f in (s27_page_words, s27_publishable_words, s27_recognised_order)}

_KEYS = "(sk-[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{5,}|pa-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{30,}|hf_[A-Za-z0-9]{20,}|sk_[a-f0-9]{40,})"
_W = """w0 AS (SELECT doc_id, regexp_extract_all(text, '[!-~\u00c0-\u024f]+') AS ws FROM documents),
w1 AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w0),
w AS (SELECT doc_id, (i // 240)::INTEGER AS page_no, i, w, (i % 240) // 8 AS line, round((64 * (i % 8) + 8) / 640.0::DOUBLE, 4) + round((16 * ((i % 240) // 8) + 20) / 800.0::DOUBLE, 4) AS place FROM w1)"""
_ALL = "SELECT doc_id, page_no, count(*)::INTEGER AS n, count(DISTINCT line)::INTEGER AS lines, round(sum(place), 4) AS places, md5(string_agg(w, ' ' ORDER BY i)) AS words_md5 FROM w GROUP BY ALL"
SQL = {
    "s27_page_words": f"WITH {_W} {_ALL}",
    "s27_recognised_order": f"WITH {_W} {_ALL}",
    "s27_publishable_words": f"""WITH {_W}, l AS (SELECT doc_id, page_no, line, string_agg(w, ' ' ORDER BY i) AS t FROM w GROUP BY ALL), m AS (SELECT *, {_masked("t")} AS t1 FROM l), k AS (SELECT doc_id, page_no, line FROM m WHERE {_named("t1")} = t AND NOT regexp_matches(t, '{_KEYS}')),
f AS (SELECT w.*, k.line IS NOT NULL AS kept FROM w LEFT JOIN k ON w.doc_id = k.doc_id AND w.page_no = k.page_no AND w.line = k.line)
SELECT doc_id, page_no, count(*) FILTER (kept)::INTEGER AS n, count(DISTINCT line) FILTER (kept)::INTEGER AS lines, round(coalesce(sum(place) FILTER (kept), 0), 4) AS places, md5(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (kept), '')) AS words_md5 FROM f GROUP BY ALL""",
}
