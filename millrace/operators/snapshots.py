"""Incremental builds: snapshots by content hash, diffs, replayed edits and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*cols: Column) -> Column:
    """SHA-256 over the parts, nulls as empty, with a separator no text holds."""
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def diff(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, change): added, changed or removed between two snapshots."""
    a, b = old.select(key, F.col(hash_col).alias("h0")), new.select(key, F.col(hash_col).alias("h1"))
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def missing(wanted: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(have.select(*key).distinct(), key, "left_anti")


def upsert(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Base rows that the delta does not replace, and the delta."""
    return base.join(delta.select(*key).distinct(), key, "left_anti").unionByName(delta, allowMissingColumns=True)


def last_wins(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order.desc())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def replay(base: DataFrame, edits: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Base lines with each line's last edit applied, and added lines (edits of keys not in base)."""
    last = edits.groupBy(key).agg(F.max_by(value, order).alias("__v"))
    out = base.join(last, key, "full_outer")
    return out.select(key, F.coalesce("__v", value).alias(value))


def version_stamp(df: DataFrame, key: str, hash_col: str) -> DataFrame:
    """One row: rows, and a hash of the snapshot that does not depend on the order of its rows."""
    h = F.xxhash64(key, hash_col)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("s")).select("rows", F.substring(F.sha2(F.concat_ws(":", F.col("x").cast("string"), "s"), 256), 1, 8).alias("version"))
