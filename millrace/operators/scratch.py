"""Intermediate tables of iterative operators, as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """A written table cuts the lineage, so that rounds of an iteration do not pile up in one plan, and
    survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, shared_folder(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
