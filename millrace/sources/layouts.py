"""Words of laid-out pages with their boxes, from the XML that PDF extractors write for each file.

A file has pages, flows, blocks, lines and words, the places of words as attributes. Each page is parsed in an
Arrow batch into an array of words, and everything after that is functions of arrays: nothing is shuffled, and the
order of lines and words is that of the file. (Spark's own XML parser makes an event reader for each page and is
several times slower.)
"""

from __future__ import annotations

import decimal
import re
from collections.abc import Callable
from functools import lru_cache, reduce
from xml.etree.ElementTree import TreeBuilder
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as texts
from millrace.session import bound_batches

#: A page of one file as text, for each match of it; what lies between tags is passed over in one step.
PAGE = r"(?s)(<page\b[^>]*/>|<page\b[^<]*+(?:<(?!/page\s*>)[^<]*+)*+</page\s*>)"
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity|nan)", re.I | re.A)
#: White space and Unicode's separators at both ends.
_BLANKS = " \t\n\x0b\f\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_TEN_THOUSANDTH = decimal.Decimal("0.0001")
# The forms of keys and tokens that are never shown.
SECRET = (
    r"(sk-[A-Za-z0-9_\-]{16,}|AKIA[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,}"
    r"|pa-[A-Za-z0-9_\-]{20,}|AIza[0-9A-Za-z_\-]{30,}|hf_[A-Za-z0-9]{20,}|sk_[a-f0-9]{40,})"
)
#: What stands in every one of them.
SECRET_SIGNS = ("sk-", "sk_", "AKIA", "ghp_", "gho_", "eyJ", "pa-", "AIza", "hf_")
#: Words that a page keeps at most: a denser one is a table, where no highlight helps.
MAX_WORDS = 600
WORD = "struct<word string, x0 double, y0 double, x1 double, y1 double, line int>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: named in an inner lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache(1 << 16)
def _number(value: str | None) -> float:
    return float(value) if value and _NUMBER.fullmatch(value := value.strip()) else 0.0


@lru_cache(1 << 16)
def _share(value: str | None, of: float) -> float:
    """Part of the page's side, within it, to four digits; halves are rounded up, as Spark does."""
    part = _number(value) / of
    if not 0.0 < part < 1.0:
        return 0.0 if part <= 0.0 else 1.0
    return float(decimal.Decimal(repr(part)).quantize(_TEN_THOUSANDTH, decimal.ROUND_HALF_UP))


def _words_of(xml: str | None) -> list[tuple]:
    """The words of a page: of the path page, flow, block, line, word. Other elements and their text are passed over.
    The parser hands a page's elements to a tree builder without a call of Python for each; names keep their prefixes."""
    tree, parser = TreeBuilder(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = tree.start, tree.end, tree.data
    try:
        parser.Parse(xml or "", True)
    except expat.ExpatError:
        return []
    page = tree.close()
    width, height = _number(page.get("width")), _number(page.get("height"))
    if page.tag != "page" or not (width > 0 and height > 0):
        return []
    words = []
    lines = (line for flow in page.findall("flow") for block in flow.findall("block") for line in block.findall("line"))
    for number, line in enumerate(lines):
        for given in line.findall("word"):
            text = given.text or ""
            if len(given):
                text += "".join(other.tail or "" for other in given)
            if text := text.strip(_BLANKS):
                get = given.get
                words.append((text, _share(get("xMin"), width), _share(get("yMin"), height), _share(get("xMax"), width), _share(get("yMax"), height), number))
    return words


def _read_pages(xml: pa.Array) -> pa.Array:
    ends, words = [0], []
    for x in xml:
        words += _words_of(x.as_py())
        ends.append(len(words))
    kinds = [pa.string(), *[pa.float64()] * 4, pa.int32()]
    held = [pa.array(c, k) for c, k in zip(zip(*words, strict=True) if words else [()] * 6, kinds, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(held, ["word", "x0", "y0", "x1", "y1", "line"]))


def page_words(page: Column) -> Column:
    """array of (word, x0, y0, x1, y1, line) of a page's XML: places as shares of its sides from the top left,
    lines counted from 0, also those without words. Null, broken or sizeless pages have no words; nor has
    a word that is blank. Places that are no numbers are 0."""
    return F.arrow_udf(_read_pages, f"array<{WORD}>")(page)


def split_pages(df: DataFrame, xml: str) -> DataFrame:
    """A row for each page of each file, with ``page_no`` from 0 and ``words`` in place of the XML. Files without
    pages have no rows. A file's XML is one value; it is never parsed as a whole."""
    bound_batches(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c != xml]
    pages = df.select(*rest, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(PAGE), F.lit(1))).alias("page_no", "_page"))
    return pages.withColumn("words", page_words(F.col("_page"))).drop("_page")


def read_page_words(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, words) of every page of the layout files at ``path``, a folder or a pattern."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    return split_pages(files, "xml")


def _line_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["word"]), " ")


def by_line(words: Column) -> Column:
    """array of lines, each an array of its words, in the order in which the lines come first. Where line numbers never
    fall, as in files, lines are cut out as they stand; otherwise each line's words are looked for in the page."""

    def cut(ws: Column, at: Column) -> Column:
        starts = F.transform(F.array_distinct(at), lambda n: F.array_position(at, n).cast("int"))
        return _bound(starts, lambda ps: F.transform(ps, lambda p, i: F.slice(ws, p, F.coalesce(F.get(ps, i + 1), F.size(ws) + 1) - p)))

    def lines(ws: Column, at: Column) -> Column:
        looked = F.transform(F.array_distinct(at), lambda n: F.filter(ws, lambda w: w["line"] == n))
        return F.when((F.sort_array(at) == at) & F.get(at, F.lit(0)).isNotNull(), cut(ws, at)).otherwise(looked)

    return _bound(words, lambda ws: _bound(F.transform(ws, lambda w: w["line"]), lambda at: lines(ws, at)))


def reading_order(words: Column) -> Column:
    """Lines from top to bottom (tops rounded to hundredths, then by their left edge), words from left to right,
    lines counted anew: for recognised text, whose lines come in any order. Full ties keep their order."""
    lines = F.transform(
        by_line(words),
        lambda ws, i: F.struct(F.round(F.array_min(F.transform(ws, lambda w: w["y0"])), 2).alias("top"), F.array_min(F.transform(ws, lambda w: w["x0"])).alias("left"), i.alias("i"), ws.alias("ws")),
    )

    def across(line: Column, number: Column) -> Column:
        placed = F.array_sort(F.transform(line["ws"], lambda w, i: F.struct(w["x0"].alias("left"), i.alias("i"), w.alias("w"))))
        return F.transform(placed, lambda p: p["w"].withField("line", number.cast("int")))

    return F.flatten(F.transform(F.array_sort(lines), across))


def publishable(words: Column, changed: Column | None = None, names: Column | None = None) -> Column:
    """The words that may be shown: no line that scrubbing would change or that holds a secret, no word of ``names``
    (an array of lower-case words, told by their capital letter), and the first ``MAX_WORDS`` of what is left.

    ``changed`` may hold an array of texts of lines that further filters would change; those go as well."""

    def clean(line: Column) -> Column:
        signs = reduce(lambda a, b: a | b, (F.contains(line, F.lit(x)) for x in SECRET_SIGNS))
        same = ~texts.needs_scrub(line) & ~(signs & F.regexp_like(line, F.lit(SECRET)))
        return same if changed is None else same & ~F.array_contains(F.coalesce(changed, F.array().cast("array<string>")), line)

    kept = F.flatten(F.filter(by_line(words), lambda ws: _bound(_line_text(ws), clean)))
    if names is not None:
        listed = F.coalesce(names, F.array().cast("array<string>"))
        bare = lambda w: F.regexp_replace(w["word"], r"^[^\p{L}]+|[^\p{L}]+$", "")
        kept = F.filter(kept, lambda w: ~(F.array_contains(listed, F.lower(bare(w))) & (bare(w) != F.lower(bare(w)))))
    return F.slice(kept, 1, MAX_WORDS)
