"""The corpus pipeline: five filtering and mixing stages over ``documents``, each written and reread.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A row that a stage has no reason to change passes through as it is: extra columns stay,
nulls in any of them do no harm, and an empty table gives an empty result.

Texts of any length are read whole. Rows that repeat in id and text are treated alike by the stages on
language, lines and benchmark, and are one document to that on near duplicates, which keeps one of them.
Ties are settled by ids: the line, and the document of a group, that stays is the one of the smallest id
(null ids first among lines; documents with a null id are in no group and all stay). In the mixture
rows of equal ids draw equal numbers of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, langid, line_dedup, minhash, mixing
from millrace.llm.common import Workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (null text, or no letter in it) go."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are equal or nearly so the first of the corpus stays; a document that had lines
    and has none left goes."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8) stays."""
    return minhash.keep_one_of_each(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut; a document that is half benchmark or more goes."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards equal shares; adds copy and mix_key."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", remove_benchmark_passages),
    ("mixture", mix_sources),
]

#: Language identification and fuzzy lines are not to be had in SQL; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and reread."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
