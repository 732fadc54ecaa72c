"""Session builder and table reader shared by queries, tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC and adaptive execution.

    ``master`` is only set when given, so ``spark-submit`` keeps the last word on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def local_session(cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """The session of the tests and the bench."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(
        master=f"local[{n}]",
        **{
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.host": "127.0.0.1",
        },
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark resolves the path, so any store it can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let no Arrow batch pass ``most`` bytes in this session: what a worker holds of the input at one
    time, besides one row, stays small however long texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(name, "2047m").lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > most:
        spark.conf.set(name, f"{most}b")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each context, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    files = [*sorted((root / "millrace").rglob("*.py")), *root.glob("corpus_pipeline.py")]
    path = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in files:
            out.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
    sc._millrace_shipped = True
