"""MinHash near-duplicates of documents: one-permutation hashing, optimal densification, bands.

A document's set holds its distinct word shingles (of a document with fewer words: the whole sequence
as one). Documents with equal sets are one class, met by a 128-bit digest of the set; classes are
linked through banded buckets (``linking``) and every link is confirmed on the full sets. Signatures
of 32 bands of 4 bins put a pair of similarity 0.8 into two common buckets, which is what a test takes,
but for a chance of one in a million.

Edge cases: documents without words or text have an empty set and are linked with nothing; rows that
share an id are one document, and the smallest digest of their sets stands for it; rows with a null id
take no part and are kept; an empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLANK_WORD, Words, Workspace, byte_table, mix64, release, row_key, text_blocks, unused
from millrace.llm.linking import band_keys, densify, join_ids, link, local_stars, signatures

BANDS, ROWS = 32, 4
SHINGLE_WORDS, PERCENT = 5, 80


_BYTES = byte_table(BLANK_WORD)


def shingles_of(row: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, from its words' hashes."""
    if not len(row):
        return np.zeros(0, np.uint64)
    n = min(size, len(row))
    total = np.full(len(row) - n + 1, n, np.uint64)
    for j in range(n):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + row[j : j + len(total)])
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    out = []
    for lo, hi in text_blocks(texts):
        words = Words(texts[lo:hi], _BYTES)
        first = words.first.tolist()
        out += [shingles_of(words.hashes[i:j], size) for i, j in zip(first[:-1], first[1:], strict=True)]
    return out


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    return band_keys(densify(signatures(sets, BANDS * ROWS)), BANDS)


def _sketch(size: int):
    def run(batches):
        for pdf in batches:
            sets = shingle_sets(pdf["t"].tolist(), size)
            yield pd.DataFrame(
                {
                    "id": pdf["id"],
                    "n": [len(s) for s in sets],
                    "k": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "bands": [row.tobytes() if len(s) else b"" for row, s in zip(bands_of(sets), sets, strict=True)],
                }
            )
            release()

    return run


def _pack(batches):
    for pdf in batches:
        keys = np.frombuffer(b"".join(pdf["bands"]), np.int64).reshape(len(pdf), BANDS)
        yield pd.DataFrame(local_stars(keys, pdf["id"].to_numpy(np.int64)), columns=["part", "blob"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: ``id_col``, n_shingles, component_id (the smallest id that can be
    reached over links) and kept (whether the document is that one)."""
    spark = docs.sparkSession
    space = Workspace(spark, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    named = rows.filter("id IS NOT NULL")
    sketches = named.mapInPandas(_sketch(shingle_words), "id long, n long, k binary, bands binary")
    one = sketches.groupBy("id").agg(F.min(F.struct("k", "n", "bands")).alias("s")).select("id", "s.*")
    table = space.save(one, "sketches")
    classes = table.filter("n > 0").groupBy("k").agg(F.min(F.struct("id", "bands")).alias("s")).select("k", "s.*")
    classes = space.save(classes, "classes")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = space.save(classes.select("id", "k").join(ids, "id"), "wanted")

        def sets(batches):
            for pdf in batches:
                held = [s.tobytes() for s in shingle_sets(pdf["t"].tolist(), shingle_words)]
                ok = [xxhash.xxh3_128_digest(s) == bytes(k) for s, k in zip(held, pdf["k"], strict=True)]
                yield pd.DataFrame({"id": pdf["id"], "s": held})[ok]

        found = join_ids(named, wanted, ["id"]).mapInPandas(sets, "id long, s binary")
        return found.groupBy("id").agg(F.min("s").alias("s"))  # repeated rows of one document are equal here

    packed = classes.select("id", "bands").mapInPandas(_pack, "part int, blob binary")
    labels = link(packed, fetch, BANDS, percent, space)
    of_class = classes.select("k", F.col("id").alias("node")).join(labels, "node", "left").select("k", F.coalesce("component", "node").alias("c"))
    # Each class is one row; only groups of copies repeat a key, and those joins can be split.
    full = table.filter("n > 0").select("id", "n", "k").join(of_class, "k", "left").select("id", "n", "c")
    out = full.unionByName(table.filter("n = 0").select("id", "n", F.col("id").alias("c")))
    nameless = rows.filter("id IS NULL").mapInPandas(_sketch(shingle_words), "id long, n long, k binary, bands binary")
    out = out.unionByName(nameless.select("id", "n", F.lit(None).cast("long").alias("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


#: Ids whose rows differ in text, up to which these are broadcast.
BROADCAST_IDS = 100_000


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group; its columns, other rows and texts are unchanged.

    Rows equal in id and text are one document, of which one row stays. Rows that share an id but not
    their text are documents of their own, behind all others in the order of ids, and among themselves in that
    of a hash of id and text. Rows with a null id all stay.
    """
    ident, key, clash = unused(docs, "__id", "__h", "__clash")
    named = docs.filter(F.col(id_col).isNotNull()).withColumns({ident: F.col(id_col).cast("long"), key: row_key(id_col, text_col)})
    several = named.groupBy(ident).agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select(ident)
    several = Workspace(docs.sparkSession, "clashes").save(several, "ids")
    count = several.count()
    if count:
        several = several.withColumn(clash, F.lit(True))
        named = named.join(F.broadcast(several) if count <= BROADCAST_IDS else several, ident, "left")
        own = F.shiftrightunsigned(key, 2).bitwiseOR(F.lit(1 << 62))  # beyond any usual id
        named = named.withColumn(ident, F.when(F.col(clash), own).otherwise(F.col(ident)))
    marks = near_duplicates(named.select(F.col(ident).alias("id"), F.col(text_col).alias("text")), "id", **options)
    kept = marks.filter("kept AND id IS NOT NULL").select(F.col("id").alias(ident))
    stay = named.join(kept, ident, "left_semi").dropDuplicates([ident]).select(*docs.columns)
    return stay.unionByName(docs.filter(F.col(id_col).isNull()))
