"""What the training-data operators share: intermediate tables, hashes and word rules."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import bound_batches

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words of benchmark matching: everything but ASCII punctuation, controls and blanks.
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of near-duplicate matching: everything but ASCII white space.
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode is a temporary folder made and set where it is unset; on a cluster each machine
    would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    held = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        held = sc.getCheckpointDir()
    return held.rstrip("/")


class Workspace:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    A written table cuts the lineage and survives the loss of any executor. ``sweep`` asks the driver's
    JVM to collect garbage, since Spark frees the shuffle files of finished jobs only when their plans
    have been collected; operators do so where they have shuffled much.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def save(self, df: DataFrame, label: str, sweep: bool = False) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        if sweep:
            self.sweep()
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that ``save`` returned and no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(self.root.split(":", 1)[-1].lstrip("/")):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_FACTOR = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}
#: Words longer than this many bytes are hashed by themselves.
_LONG_WORD = 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of texts whose words are hashed at one time.
BLOCK_BYTES = 1 << 20


def byte_table(pattern: re.Pattern) -> np.ndarray:
    """Which bytes belong to words of ``pattern``, a run of characters not in some ASCII ranges: all
    bytes of other characters do."""
    return np.array([b >= 128 or bool(pattern.fullmatch(chr(b | 32 if 65 <= b <= 90 else b))) for b in range(256)])


def powers(factor: int, count: int) -> np.ndarray:
    """factor ** 0, 1, ... modulo 2 ** 64, ``count`` of them at least."""
    held = _POWERS.get(factor)
    if held is None or len(held) < count:
        held = np.full(max(count, 1 << 16), factor, np.uint64)
        held[0] = 1
        held = _POWERS[factor] = np.cumprod(held)
    return held


def run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the values (64-bit) from each ``begin`` up to ``end``: the difference of two prefix
    sums of a polynomial, brought to the same power."""
    back = pow(_FACTOR, -1, 2**64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_FACTOR, len(values))[: len(values)], out=sums[1:])
    return (sums[end] - sums[begin]) * powers(back, len(values) + 1)[begin]


class Words:
    """The words of some texts in lower case (A-Z only), found and hashed in their UTF-8 bytes.

    ``hashes``: one for each word, equal for equal words in any process; ``first``: the number of the
    first word of each text, and of all words; ``begin`` and ``end``: their places in ``data``.
    """

    def __init__(self, texts: list[str | None], table: np.ndarray):
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        # A line feed belongs to no word, so none goes on from one text to the next.
        self.data = _FOLD[np.frombuffer(b"\n" + b"\n".join(coded) + b"\n", np.uint8)]
        inside = table[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.begin, self.end = edges[0::2], edges[1::2]
        starts = np.cumsum([1, *(len(c) + 1 for c in coded)])
        self.first = np.searchsorted(self.begin, starts)
        self.hashes = mix64(run_hashes(self.data.astype(np.uint64) + np.uint64(1), self.begin, self.end))
        for i in np.flatnonzero(self.end - self.begin > _LONG_WORD).tolist():
            self.hashes[i] = xxhash.xxh64_intdigest(self.word(i), 1)

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()

    def run(self, i: int, n: int) -> bytes:
        """``n`` words from word i on, with one blank between them."""
        return b" ".join(self.word(j) for j in range(i, i + n))


def text_blocks(texts: list[str | None], most: int = BLOCK_BYTES):
    """Slices of ``texts`` of at most ``most`` characters, or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if len(texts) > at:
        yield at, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, in place: spreads every input bit over the output."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def release() -> None:
    """Give a worker's freed memory back to the machine; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def once(udf):
    """``udf`` so that its column is computed once for each row: a filter on a deterministic one would be
    pushed below it with a copy of the call, which takes as many workers and Arrow buffers again."""
    return udf.asNondeterministic()


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, each with underscores before it until no column of ``df`` bears it in any case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def row_key(*cols: str) -> Column:
    """A hash that tells apart rows which share an id but not their content; never null."""
    return F.xxhash64(*cols)


def chunks(pdf, rows: int):
    for at in range(0, len(pdf), rows):
        yield pdf.iloc[at : at + rows]


def first_by_hash(rows: DataFrame, group: str, ident: str, most: int, seed: int, parts: int = 64) -> DataFrame:
    """The first ``most`` rows of each ``group`` by a hash of ``ident``: a fixed sample.

    They are chosen among the first of each of ``parts`` parts of a group, so that the rows of a large
    group are spread over as many tasks, and one sees ``parts * most`` of them at last.
    """
    order = F.xxhash64(ident, F.lit(seed))
    dealt = rows.withColumns({"__order": order, "__part": F.pmod(F.xxhash64(ident, F.lit(seed + 1)), F.lit(parts))})
    for keys in ([group, "__part"], [group]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__order", ident))
        dealt = dealt.withColumn("__rank", rank).filter(F.col("__rank") <= most)
    return dealt.select(*rows.columns)
