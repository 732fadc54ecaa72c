"""Vector scoring in batches: one matrix product for each Arrow batch instead of a loop per pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero and non-finite rows become zero, so that their cosine is 0."""
    x = np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0.0)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1.0)


#: Question sets of up to so many vectors are broadcast; larger ones meet the records by a join on blocks.
BROADCAST_VECTORS = 20_000
#: Scores that are rounded later may swap places within this.
ROUNDING = 1e-6


def _packed(ids: str):
    """Rows (id, vector) of a batch as one row of two binaries."""

    def run(batches):
        for pdf in batches:
            for d, alike in pdf.groupby("d"):
                for lo in range(0, len(alike), 2048):
                    part = alike.iloc[lo : lo + 2048]
                    x = unit_rows(np.array(part["vector"].tolist(), np.float64))
                    yield pd.DataFrame([(d, len(part), part[ids].to_numpy(np.int64).tobytes(), x.tobytes())], columns=["d", "n", "ids", "x"])

    return run


def cosine_pairs(questions: DataFrame, records: DataFrame, floor: float | None = None, block: int = 4096, k: int | None = None) -> DataFrame:
    """(qid, row_idx, score): the cosine of each question (qid, vector) with each record (row_idx,
    vector), clipped to [-1, 1]; with ``floor`` only pairs that reach it become rows.

    Vectors are packed where they lie; each chunk of records meets each block of questions in one
    matrix product, by a join on the block's number. With ``k`` a chunk sends on no more of a question's
    pairs than its ``k`` best, and those that rounding may put level with them. Null vectors take no part,
    and vectors meet those of their own length only; zero vectors and such with a null or non-finite number
    have the cosine 0.
    """
    questions, records = (df.filter(F.col("vector").isNotNull()).withColumn("d", F.size("vector")) for df in (questions, records))
    count = questions.count()
    blocks = max(1, -(-count // block))
    asked = questions.select("qid", "vector", "d", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("b"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q = unit_rows(np.array(pdf["vector"].tolist(), np.float64))
        return pd.DataFrame([(*key, pdf["qid"].to_numpy(np.int64).tobytes(), q.tobytes())], columns=["b", "d", "qids", "q"])

    sides = asked.groupBy("b", "d").applyInPandas(pack, "b int, d int, qids binary, q binary")
    sides = F.broadcast(sides) if count <= BROADCAST_VECTORS else sides
    chunks = records.select("row_idx", "vector", "d").mapInPandas(_packed("row_idx"), "d int, n int, ids binary, x binary")
    met = chunks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(sides, ["b", "d"]).select("n", "ids", "x", "qids", "q")

    def score(batches):
        for pdf in batches:
            for n, ids, x, qids, q in pdf.itertuples(index=False):
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                s = np.clip(np.frombuffer(x).reshape(n, -1) @ np.frombuffer(q).reshape(len(qids), -1).T, -1.0, 1.0)
                keep = np.ones(s.shape, bool) if floor is None else s >= floor
                if k is not None and n > k:
                    keep &= s >= np.partition(s, n - k, axis=0)[n - k] - ROUNDING
                r, c = np.nonzero(keep)
                yield pd.DataFrame({"qid": qids[c], "row_idx": ids[r], "score": s[r, c]})

    return met.mapInPandas(score, "qid long, row_idx long, score double")
