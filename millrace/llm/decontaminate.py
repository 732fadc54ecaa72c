"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A document's words are hashed once; rolling window hashes are looked up in the sorted hashes of the
benchmark's windows, and each hit is verified word by word before it counts. The set is broadcast
only up to ``max_windows`` windows of ``WINDOW_BYTES`` bytes on average; a larger benchmark takes the
join path: a fixed-size Bloom filter screens the windows on the documents' side, the survivors meet the
benchmark's windows in a shuffle join, and equal words confirm them. Both paths give the same rows.

Edge cases: null text has no words; an item without words is ignored; an item with fewer words than
a window is one window of its own length; an item without an id bears the empty text as its id;
repeated rows are scanned independently; empty tables give empty or untouched results. Extra columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import PLAIN_WORD, Words, bound_batches, byte_table, lower_ascii, mix64, once, release, row_key, run_hashes, text_blocks, unused

WINDOW = 10
MAX_WINDOWS = 200_000
WINDOW_BYTES = 100
BLOOM_BITS = 1 << 24
#: Leading bits of window hashes that are looked up before the hashes themselves.
SCREEN_BITS = 20
_BYTES = byte_table(PLAIN_WORD)

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def words_of(text: str | None) -> list[str]:
    return PLAIN_WORD.findall(lower_ascii(text)) if text else []


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``n`` words within one text: their first words, and their hashes."""
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :]) if len(owner) >= n else np.zeros(0, np.int64)
    return at, mix64(run_hashes(words.hashes, at, at + n))


def item_windows(words: list[str], window: int) -> set[tuple[str, ...]]:
    if len(words) < window:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


def _sha_of_items(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


class WindowIndex:
    """The benchmark's windows: exact words to items, and sorted hashes for each window length."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        exact: dict[str, list] = defaultdict(list)
        by_length = defaultdict(list)
        for item, words in items:
            for w in item_windows(words, window):
                run = " ".join(w)
                if run not in exact:
                    by_length[len(w)].append(run)
                exact[run].append(item)
        self.exact = {run.encode("utf-8", "surrogatepass"): held for run, held in exact.items()}
        self.sorted, self.screens = {}, {}
        for n, runs in by_length.items():
            known = [window_hashes(Words(runs[lo:hi], _BYTES), n)[1] for lo, hi in text_blocks(runs)]
            self.sorted[n] = np.unique(np.concatenate(known))
            self.screens[n] = np.zeros(1 << SCREEN_BITS, bool)
            self.screens[n][self.sorted[n] >> np.uint64(64 - SCREEN_BITS)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, list[set]]:
        """A mask over the words, and for each text the items whose windows occur."""
        mask, found = np.zeros(len(words.hashes) + 1, np.int32), [set() for _ in range(len(words.first) - 1)]
        for n, known in self.sorted.items():
            at, got = window_hashes(words, n)
            near = self.screens[n][got >> np.uint64(64 - SCREEN_BITS)]
            at, got = at[near], got[near]
            place = np.minimum(np.searchsorted(known, got), len(known) - 1)
            for i in at[known[place] == got].tolist():
                items = self.exact.get(words.run(i, n))
                if items:
                    found[int(np.searchsorted(words.first, i, "right")) - 1].update(items)
                    mask[i] += 1
                    mask[i + n] -= 1
        return np.cumsum(mask)[:-1] > 0, found


def cut_spans(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between neighbours of one run."""
    spans = [m.span() for m in PLAIN_WORD.finditer(lower_ascii(text))]
    kept, at, i = [], 0, 0
    while i < len(spans):
        if hit[i]:
            j = i
            while j + 1 < len(spans) and hit[j + 1]:
                j += 1
            kept.append(text[at : spans[i][0]])
            at, i = spans[j][1], j + 1
        else:
            i += 1
    return "".join([*kept, text[at:]])


def _scanner(held, with_text: bool):
    @F.pandas_udf(REPORT)
    def scan(batch: pd.Series) -> pd.DataFrame:
        index, rows, texts = held.value, [], batch.tolist()
        for lo, hi in text_blocks(texts):
            words = Words(texts[lo:hi], _BYTES)
            hit, found = index.hits(words)
            for text, items, a, b in zip(texts[lo:hi], found, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                n = int(hit[a:b].sum()) if items else 0
                clean = (cut_spans(text, hit[a:b]) if n else text) if with_text else None
                rows.append((b - a, n, len(items), _sha_of_items(items), n > 0, clean))
        release()
        return pd.DataFrame(rows, columns=REPORT.names)

    return once(scan)


def _collect_items(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int):
    """The items (their ids as texts) and their words, or None where they have more windows than ``most``
    or more bytes than ``WINDOW_BYTES`` for each of these.

    The counts come first and run on the executors, so nothing unbounded reaches the driver.
    """
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word_count = F.size(F.regexp_extract_all(lower, F.lit(f"({PLAIN_WORD.pattern})"), 1))
    windows, size = benchmark.agg(F.sum(F.greatest(word_count - (window - 1), F.lit(1)) + window), F.sum(F.octet_length(lower))).first()
    if (windows or 0) > most or (size or 0) > most * WINDOW_BYTES:
        return None
    return [(r[0], words_of(r[1])) for r in benchmark.select(_item(item_col), text_col).toLocalIterator()]


def _item(item_col: str):
    return F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    with_text: bool = False,
    into: str = "report",
) -> DataFrame:
    """``docs`` with a struct column ``into`` of the REPORT fields for each row.

    ``clean_text`` is filled only with ``with_text``. An input column named ``into`` is replaced.
    """
    bound_batches(docs.sparkSession)
    items = _collect_items(benchmark, item_col, item_text_col, window, max_windows)
    if items is None:
        return _scan_by_join(docs, benchmark, text_col, item_col, item_text_col, window, with_text, into)
    held = docs.sparkSession.sparkContext.broadcast(WindowIndex(items, window))
    return docs.withColumn(into, _scanner(held, with_text)(F.col(text_col)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, **options) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut, and a document goes where at least
    ``drop_share`` of its words are hit. Clean rows are untouched. ``n_chars`` follows the text."""
    text_col, (held,) = options.get("text_col", "text"), unused(docs, "__report")
    out = scan(docs, benchmark, with_text=True, into=held, **options)
    out = out.filter(~(F.col(f"{held}.contaminated") & (F.col(f"{held}.n_hit") >= drop_share * F.col(f"{held}.n_words"))))
    hit = F.col(f"{held}.contaminated")
    changed = {text_col: F.when(hit, F.col(f"{held}.clean_text")).otherwise(F.col(text_col))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(hit, F.length(f"{held}.clean_text").cast(kind)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


# The join path, for a benchmark that is too large to broadcast.


def _bloom_slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> np.uint64(8)) % np.uint64(BLOOM_BITS), (hashes >> np.uint64(36)) % np.uint64(BLOOM_BITS)


def _windows_of_items(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    def explode(batches):
        for pdf in batches:
            for item, text in zip(pdf["item"], pdf["t"], strict=True):
                words = words_of(text)
                n = min(window, len(words))
                held = Words([text], _BYTES)
                at, h = window_hashes(held, n) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                _, fresh = np.unique(h, return_index=True)
                at, h = at[np.sort(fresh)], h[np.sort(fresh)]
                a, b = _bloom_slots(h)
                runs = [" ".join(words[i : i + n]) for i in at.tolist()]
                yield pd.DataFrame({"item": np.array([item] * len(runs), object), "n": n, "h": h.view(np.int64), "w": np.array(runs, object), "a": a.astype(np.int64), "b": b.astype(np.int64)})

    return benchmark.select(_item(item_col), F.col(text_col).alias("t")).mapInPandas(explode, "item string, n int, h long, w string, a int, b int")


def _scan_by_join(docs, benchmark, text_col, item_col, item_text_col, window, with_text, into) -> DataFrame:
    from millrace.llm.common import Workspace

    spark = docs.sparkSession
    space = Workspace(spark, "decontaminate")
    windows = space.save(_windows_of_items(benchmark, item_col, item_text_col, window), "windows")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most ``window`` of them
    slots = windows.select(F.explode(F.array("a", "b")).alias("s"))
    words = slots.groupBy(F.expr("s div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, s % 32)")).alias("bits"))
    bloom = np.zeros(BLOOM_BITS // 32, np.uint32)  # of a fixed size, whatever the benchmark's
    for r in words.toLocalIterator():
        bloom[r[0]] = r[1]
    held = spark.sparkContext.broadcast(bloom)

    def candidates(batches):
        bits = held.value
        for pdf in batches:
            texts = pdf["t"].tolist()
            for lo, hi in text_blocks(texts):
                words = Words(texts[lo:hi], _BYTES)
                for n in lengths:
                    at, h = window_hashes(words, n)
                    a, b = (s.astype(np.int64) for s in _bloom_slots(h))
                    ok = (bits[a >> 5] >> (a & 31).astype(np.uint32)) & (bits[b >> 5] >> (b & 31).astype(np.uint32)) & 1
                    at, h = at[ok == 1], h[ok == 1]
                    text = np.searchsorted(words.first, at, "right") - 1
                    rows = pdf.iloc[lo + text][["k1", "k2"]].reset_index(drop=True)
                    runs = [words.run(i, n).decode("utf-8", "surrogatepass") for i in at.tolist()]
                    yield rows.assign(n=n, at=at - words.first[text], h=h.view(np.int64), w=np.array(runs, object))
            release()

    # A text is known by two hashes; copies of one text make the same rows, and are one after ``distinct``.
    keys = {"k1": row_key(text_col), "k2": F.xxhash64(F.lit(1), text_col)}
    keyed = docs.select(*(c.alias(k) for k, c in keys.items()), F.col(text_col).alias("t"))
    found = keyed.mapInPandas(candidates, "k1 long, k2 long, n int, at int, h long, w string").distinct()
    hits = found.join(windows.select("h", "n", "w", "item"), ["h", "n", "w"])
    texts = hits.select("k1", "k2", "item", F.explode(F.sequence("at", F.expr("at + n - 1"))).alias("i"))
    by_text = texts.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_set("i").alias("__hit"), F.collect_set("item").alias("__items"))
    joined = docs.withColumns({f"__{k}": c for k, c in keys.items()}).join(by_text, ["__k1", "__k2"], "left")

    @F.pandas_udf(REPORT)
    def report(texts: pd.Series, hit: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at, found_items in zip(texts, hit, items, strict=True):
            n = len(words_of(text))
            mask = np.zeros(n, bool)
            if at is not None:
                mask[np.asarray(at, np.int64)] = True
            k = int(mask.sum())
            clean = (cut_spans(text, mask) if k else text) if with_text else None
            names = [] if found_items is None else list(found_items)
            rows.append((n, k, len(names), _sha_of_items(names), k > 0, clean))
        return pd.DataFrame(rows, columns=REPORT.names)

    return joined.withColumn(into, once(report)(F.col(text_col), F.col("__hit"), F.col("__items"))).select(*[c for c in docs.columns if c != into], into)
