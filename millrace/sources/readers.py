"""Readers and writers: index snapshots, JSON lines, transcripts, rosters, notebooks, HTML text.

Missing optional inputs give an empty table with the schema, never an error; rows that cannot be read
are counted or rejected by choice, not dropped in silence.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "kind", "course", "course_title", "session_title", "date", "title", "text", "notes", "ocr_text", "transcript", "image", "thumb", "clip", "hash", "notebook", "source")]
    + [T.StructField(n, T.IntegerType()) for n in ("session", "slide_number", "cell_number")]
    + [T.StructField("thin", T.BooleanType()), T.StructField("related_code", T.ArrayType(T.StringType())), T.StructField("flags", T.ArrayType(T.StringType())), T.StructField("mark_lines", T.ArrayType(T.IntegerType()))]
)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **options) -> DataFrame:
    """The table at ``path``, or an empty one where nothing is there."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_index(spark: SparkSession, index_path: str, vectors: DataFrame | None = None) -> DataFrame:
    """Records of an index file, a bare list or {"records": [...]}; ``vectors`` (row_idx, vector) is
    joined by place, and a count that differs is an error."""
    raw = spark.read.text(index_path, wholetext=True)
    wrapped = F.from_json("value", T.StructType([T.StructField("records", T.ArrayType(RECORD))]))["records"]
    # A list opens with a bracket; from_json of a struct would read its first element only.
    opened = F.regexp_like("value", F.lit(r"^\s*\["))
    rows = raw.select(F.posexplode(F.when(opened, F.from_json("value", T.ArrayType(RECORD))).otherwise(wrapped)).alias("row_idx", "r")).select("row_idx", "r.*")
    if vectors is None:
        return rows
    n, m = rows.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} records but {m} vectors")
    return rows.join(vectors, "row_idx", "left")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines); ``strict`` fails the job on a bad line instead."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), spark.createDataFrame([], "line string")
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.filter("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")
    return good, parsed.filter("r IS NULL OR r._bad IS NOT NULL").select(F.col("value").alias("line"))


#: A speaker's label before the words of a cue.
LABEL = r"^\s*[A-Z][\w.'\- ]{0,38}:\s+"
_STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"


def _seconds(text: Column, which: int) -> Column:
    part = lambda g: F.regexp_extract(text, rf"{_STAMP}\s*-->\s*{_STAMP}", g + 4 * which)
    hours = F.when(part(1) != "", part(1).cast("double")).otherwise(0.0)
    return hours * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + part(4).cast("double") / 1000


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """(file, cue, start, end, text) of WebVTT files; blocks without a time line are skipped, and labels of
    speakers ("Name: ") go, so that no name stays in a transcript."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    blocks = files.select("file", F.posexplode(F.split("v", r"\n\s*\n")).alias("cue", "b")).filter(F.regexp_like("b", F.lit(rf"{_STAMP}\s*-->\s*{_STAMP}")))
    body = F.trim(F.regexp_replace(F.regexp_replace("b", rf"(?s)^.*?{_STAMP}\s*-->\s*{_STAMP}[^\n]*\n?", ""), r"\s+", " "))
    rows = blocks.select("file", "cue", _seconds(F.col("b"), 0).alias("start"), _seconds(F.col("b"), 1).alias("end"), F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), LABEL, "")).alias("text"))
    return rows.filter("text <> ''")


#: Header names of roster files, in the order of preference.
ALIASES = {
    "first": ("first name", "first", "given name", "preferred name"), "last": ("last name", "last", "surname", "family name"), "full": ("name", "full name", "student", "student name"),
    "email": ("email", "e-mail", "email address", "login id"), "section": ("section", "sections", "class"),
}


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(first, last, email, section) of a CSV file with any known headers; a full name is split at
    its comma or its last blank."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = {re.sub(r"[\s_]+", " ", c.strip().lower().lstrip("﻿")): c for c in df.columns}
    pick = lambda k: F.coalesce(*(F.nullif(F.trim(F.col(f"`{known[a]}`")), F.lit("")) for a in ALIASES[k] if a in known), F.lit(None).cast("string"))
    full = pick("full")
    comma = F.contains(full, F.lit(","))
    first = F.when(comma, F.trim(F.element_at(F.split(full, ",", 2), 2))).otherwise(F.trim(F.regexp_extract(full, r"^(.*?)\s*\S+$", 1)))
    last = F.when(comma, F.trim(F.split(full, ",", 2)[0])).otherwise(F.regexp_extract(full, r"(\S+)$", 1))
    return df.select(F.coalesce(pick("first"), first).alias("first"), F.coalesce(pick("last"), last).alias("last"), F.lower(pick("email")).alias("email"), pick("section").alias("section"))


NOTEBOOK = T.StructType([T.StructField("cells", T.ArrayType(T.StructType([T.StructField("cell_type", T.StringType()), T.StructField("source", T.ArrayType(T.StringType()))])))])


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, source, above) of code cells, with the nearest Markdown cell before each."""
    from pyspark.sql import Window

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", NOTEBOOK)["cells"].alias("cells"))
    cells = raw.select("file", F.posexplode("cells").alias("cell", "c")).select("file", "cell", "c.cell_type", F.array_join("c.source", "").alias("source"))
    w = Window.partitionBy("file").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col("cell_type") == "markdown", F.col("source")), ignorenulls=True).over(w)
    return cells.withColumn("above", above).filter("cell_type = 'code' AND trim(source) <> ''").drop("cell_type")


class _Text(HTMLParser):
    """Visible text: a line for each block element, a dash for each list item, a bar before each table
    cell, and the address of an outside link behind its words."""

    BLOCKS = frozenset("p div br hr tr li dt dd h1 h2 h3 h4 h5 h6 ul ol table section article blockquote pre".split())
    HIDDEN = frozenset("script style noscript iframe".split())
    MARKS = {"li": "- ", "td": " | ", "th": " | "}

    def __init__(self, home: str):
        super().__init__(convert_charrefs=True)
        self.home, self.parts, self.hidden, self.links = home, [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
        else:
            self.parts.append("\n" * (tag in self.BLOCKS) + self.MARKS.get(tag, ""))

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.links:
            link = self.links.pop()
            host = re.match(r"https?://([^/?#]*)", link)
            self.parts.append(f" ({link})" if host and host[1] != self.home else "")
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_to_text(source: str | None, home: str = "") -> str:
    """Text of a page: blanks shortened, at most one empty line in a row; ``home`` is the host whose links
    are not named."""
    parser = _Text(home)
    parser.feed(source or "")
    parser.close()
    lines = [re.sub(r"[ \t\r\f\v\xa0\ufeff]+", " ", x).strip() for x in "".join(parser.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return sources.map(html_to_text)

    return run(html)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, cells guarded against being read as formulas."""
    from millrace.functions.text import csv_cell

    guarded = {c: csv_cell(F.col(c)) for c, kind in df.dtypes if kind == "string"}
    df.withColumns(guarded).write.option("header", True).csv(path)


def write_snapshot(df: DataFrame, root: str, key: str, hash_col: str) -> str:
    """Write a versioned snapshot, its manifest last; an unchanged snapshot keeps its version."""
    from millrace.operators.snapshots import version_stamp

    spark = df.sparkSession
    stamp = version_stamp(df, key, hash_col).first()
    path = f"{root}/version={stamp['version']}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(stamp["version"], stamp["rows"])], "version string, rows long").coalesce(1).write.mode("append").json(f"{root}/manifest")
    return stamp["version"]
