"""Language identification by hyperdimensional profiles.

Each letter has a random bipolar vector, drawn from a seed and its code point. An n-gram's vector
binds (multiplies) the letters' vectors, each permuted (rotated) by its place; a text is the bundle
(sum) of its n-grams, a language the bundle of its training texts, and the prediction the language
whose prototype has the largest cosine with the text.

Edge cases: null text, and text without a letter, is ``und`` with score 0; without training rows
every text is ``und``; ties go to the language that sorts first; every row is scored on its own, so
repeated rows get equal results (those that share an id are all learned from, if that id is chosen). Extra
columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bound_batches, first_by_hash, release, unused

UNDECIDED = "und"
DIM = 512
N = 3
#: The fit reads at most this many texts of each language, in the order of a hash of their ids.
MAX_TRAIN_PER_LANG = 1000
SEED = 7
#: Texts whose n-grams are bundled by one matrix product.
BLOCK = 48
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def letter_vector(code: int, dim: int) -> np.ndarray:
    """The bipolar vector of a letter; code 0 stands for whatever separates words."""
    return np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dim).astype(np.int8) * 2 - 1


class Bundler:
    """Turns texts into bundled n-gram vectors; n-grams' vectors are kept once made."""

    limit = 40_000

    def __init__(self, dim: int = DIM):
        self.dim, self.letters, self.grams = dim, {}, {}
        self.fold = np.zeros(0x110000, np.int32)  # 0: not looked up yet, -1: no letter

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters' code points, with 0 for each run of anything else, 0 at both ends."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        got = self.fold[raw]
        if not got.all():
            for c in np.unique(raw[got == 0]).tolist():
                self.fold[c] = c if chr(c).isalpha() else -1
            got = self.fold[raw]
        got = np.concatenate(([0], np.maximum(got, 0), [0]))
        return got[np.concatenate(([True], (got[1:] != 0) | (got[:-1] != 0)))]

    def gram_vector(self, gram: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for place in range(N):
            code = (gram >> (21 * place)) & 0x1FFFFF
            if code not in self.letters:
                self.letters[code] = letter_vector(code, self.dim)
            out *= np.roll(self.letters[code], place)
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = self.codes(text).astype(np.int64)
        if not codes.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)

    def bundle(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the sum of its n-grams' vectors, as one product of two matrices."""
        parts = [self.counts(t) for t in texts]
        grams = np.unique(np.concatenate([g for g, _ in parts]))
        if len(self.grams) > self.limit:
            self.grams.clear()
        new = [g for g in grams.tolist() if g not in self.grams]
        self.grams.update((g, self.gram_vector(g)) for g in new)
        counts = np.zeros((len(texts), len(grams)), np.float32)
        for i, (g, c) in enumerate(parts):
            counts[i, np.searchsorted(grams, g)] = c
        out, rows = np.zeros((len(texts), self.dim), np.float32), grams.tolist()
        for lo in range(0, len(rows), 4096):  # vectors are bytes; so many at one time become floats
            vectors = np.array([self.grams[g] for g in rows[lo : lo + 4096]], np.int8).astype(np.float32)
            out += counts[:, lo : lo + 4096] @ vectors
        return out


def _blocks(texts: list[str]):
    """Blocks of texts of bounded number and length."""
    block, size = [], 0
    for i, t in enumerate(texts):
        if block and (len(block) == BLOCK or size + len(t) > 400_000):
            yield block
            block, size = [], 0
        block.append(i)
        size += len(t)
    if block:
        yield block


class Profiles:
    """The languages' prototypes, of unit length, in the order of the languages' names."""

    def __init__(self, langs: list[str], vectors: np.ndarray):
        self.langs, norms = langs, np.linalg.norm(vectors, axis=1, keepdims=True) if langs else 1
        self.unit = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32) if langs else vectors

    def predict(self, texts: list[str], bundler: Bundler) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDECIDED, 0.0)] * len(texts)
        if not self.langs:
            return out
        for block in _blocks(texts):
            vectors = bundler.bundle([texts[i] for i in block])
            norms = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ self.unit.T / np.where(norms > 0, norms, 1)[:, None]
            best = cosines.argmax(axis=1)
            for i, norm, k, row in zip(block, norms.tolist(), best.tolist(), cosines, strict=True):
                if norm > 0:
                    out[i] = (self.langs[k], float(min(1.0, max(0.0, row[k]))))
        return out


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_per_lang: int = MAX_TRAIN_PER_LANG, dim: int = DIM) -> Profiles:
    """Prototypes from at most ``max_per_lang`` texts of each non-null language.

    The texts are chosen by a hash of their ids from two narrow columns, first within the parts of a
    language, then among those chosen, so that no task sees many rows of one; then they are bundled
    where they lie: only sums leave the executors.
    """
    bound_batches(train.sparkSession)
    rows = train.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("t").isNotNull())
    chosen = first_by_hash(rows.select("i", "l"), "l", "i", max_per_lang, SEED).distinct()
    langs = sum(1 for _ in chosen.select("l").distinct().toLocalIterator())
    chosen = F.broadcast(chosen) if langs <= 200 else chosen  # max_per_lang short rows for each language
    texts = rows.join(chosen, ["i", "l"], "left_semi").select("l", "t")

    def partial(batches):
        bundler, sums = Bundler(dim), {}
        for pdf in batches:
            for lang, part in pdf.groupby("l"):
                held = part["t"].tolist()
                for block in _blocks(held):
                    v = bundler.bundle([held[i] for i in block])
                    norms = np.linalg.norm(v, axis=1, keepdims=True)
                    sums[lang] = sums.get(lang, 0) + (v / np.where(norms > 0, norms, 1)).sum(axis=0, dtype=np.float64)
        if sums:  # most tasks hold none of the chosen texts
            yield pd.DataFrame({"l": list(sums), "v": [x.tolist() for x in sums.values()]})

    parts = texts.mapInPandas(partial, "l string, v array<double>").selectExpr("l", "posexplode(v) AS (d, x)")
    total: dict[str, np.ndarray] = {}
    for r in parts.groupBy("l", "d").agg(F.sum("x").alias("x")).toLocalIterator():  # languages times dim
        total.setdefault(r["l"], np.zeros(dim))[r["d"]] = r["x"]
    names = sorted(total)
    return Profiles(names, np.array([total[n] for n in names]).reshape(len(names), dim))


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> Column:
    """A struct of ``lang_pred`` and ``score`` for each row of ``docs``."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf(RESULT)
    def run(batches: pd.Series) -> pd.DataFrame:
        got = held.value.predict([t or "" for t in batches], _bundler(held.value))
        release()
        return pd.DataFrame(got, columns=RESULT.names)

    return run(F.col(text_col))


_BUNDLERS: dict[int, Bundler] = {}


def _bundler(profiles: Profiles) -> Bundler:
    """One for each worker process, so that n-grams' vectors outlive a batch."""
    dim = profiles.unit.shape[1]
    return _BUNDLERS.setdefault(dim, Bundler(dim))


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows whose language could be told (with a cosine of ``min_score`` or more), unchanged."""
    (told,) = unused(docs, "__lang")
    held = docs.withColumn(told, predict(docs, profiles, text_col))
    return held.filter((F.col(told)["lang_pred"] != UNDECIDED) & (F.col(told)["score"] >= min_score)).select(*docs.columns)
