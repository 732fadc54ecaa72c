"""Ranked lexical search by impact-ordered, score-at-a-time retrieval.

One pass over the documents finds their terms in bytes and writes, for each, its length and the numbers and
counts of those terms that some query has. From that table come the counts of documents and terms (N, L) and
the document frequency of each term. A second pass reads it: each task gathers documents into shards of a
bounded number of postings, orders a shard's postings by term and exact impact, the part of the score that
depends on the document, and groups equal ones. A query walks through its terms' groups by descending impact
(weight of the term times that part), adding to the documents' scores. What the terms' next groups could still
add, summed, bounds every further gain; once that proves that the best k are among a few documents, the
walk ends, and the scores of those are completed from the documents' own terms. Without such a proof it goes
on to the last group, so scores are exact in each case. Tasks keep k hits a query; a window merges them.

Queries are taken in blocks of a bounded number of terms, each against all documents; a block's terms are what
is broadcast. Nothing else reaches the driver but these and their document frequencies.

Terms are matched by a 64-bit hash and their length in bytes; among 10 ** 9 different words of the corpus, two that
agree in both with one of 10 ** 5 query terms have a chance of about 1 in 10 ** 5.

Edge cases: a null text has no term and is no document of N; a query without terms, or whose terms are in no
document, has no rows; rows of equal document ids are ranked apart, null ids stand first among equal scores;
rows of equal item ids are queries of their own. Empty tables give an empty result. Extra columns are never read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Words, Workspace, byte_table, release, text_blocks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = byte_table(TERM)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 10
#: Terms, with repeats, of the queries of one block; a single longer query is a block of its own.
BLOCK_TERMS = 1_000_000
#: Postings of a shard; one document may have more.
SHARD_POSTINGS = 1 << 20
#: Documents whose scores are completed at the end of a walk, at most, beyond the k.
FEW = 54
#: A walk looks at its bounds each time the largest impact left falls to this part of the last.
STEP = 0.7
#: Hits of a query are first merged in so many parts.
MERGE_PARTS = 64
_NO_ID = -(2**63)


def impact(tf, n, docs: int, terms: int):
    """The part of a term's score that depends on the document, in whole numbers."""
    m = 25 + (75 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Queries and their terms: ``hashes`` sorted, with each term's length in bytes; ``queries`` holds the
    query's number, its different terms and how often it has each."""

    hashes: np.ndarray
    sizes: np.ndarray
    queries: list[tuple[int, np.ndarray, np.ndarray]]

    def lookup(self, words: Words) -> np.ndarray:
        """The number of each word's term, -1 where no query has it."""
        if not len(self.hashes) or not len(words.hashes):
            return np.full(len(words.hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == words.hashes) & (self.sizes[at] == words.end - words.begin), at, -1)


def make_block(rows: list) -> Block:
    """Of rows with qid and terms (lists of words)."""
    names = sorted({t for r in rows for t in r["terms"]})
    found = Words(names, _TABLE)  # each text is one term
    order = np.argsort(found.hashes)
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    place = dict(zip(names, number.tolist(), strict=True))
    queries = []
    for r in rows:
        terms, counts = np.unique(np.array([place[t] for t in r["terms"]], np.int64), return_counts=True)
        queries.append((r["qid"], terms, counts))
    return Block(found.hashes[order], (found.end - found.begin)[order], queries)


def _postings(block):
    """Rows (id, n, terms, counts) of the documents that have a term."""

    def run(batches):
        held = block.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_blocks(texts):
                words = Words(texts[a:b], _TABLE)
                n = np.diff(words.first)
                term = held.lookup(words)
                doc = np.repeat(np.arange(b - a), n)
                key, count = np.unique((doc * max(len(held.hashes), 1) + term)[term >= 0], return_counts=True)
                of, term = np.divmod(key, max(len(held.hashes), 1))
                offsets = np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (term, count)]
                out = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), *lists], ["id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))
        release()

    return run


class Shard:
    """Postings of some documents, by term and descending impact, equal ones in groups."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray, doc: np.ndarray, term: np.ndarray, terms: int):
        self.ids, self.terms = ids, terms
        order = np.lexsort((doc, -impacts, term))
        t, q, self.doc = term[order], impacts[order], doc[order]
        starts = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (q[1:] != q[:-1])))) if len(t) else np.zeros(0, np.int64)
        self.begin = np.append(starts, len(t))  # of each group
        self.impact = q[starts]
        self.of_term = np.searchsorted(t[starts], np.arange(terms + 1))  # the first group of each term
        self.key, self.part = doc * terms + term, impacts  # by document, in ascending order
        self.score = np.zeros(len(ids), np.int64)

    def complete(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores from the documents' own postings."""
        want = docs[:, None] * self.terms + terms
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.part[at] * weights, 0).sum(axis=1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents with a score above 0."""
        there = (self.of_term[terms] < self.of_term[terms + 1]) & (weights > 0)
        terms, weights = terms[there], weights[there]
        if not len(terms):
            return self.ids[:0], self.score[:0]
        at, end = self.of_term[terms], self.of_term[terms + 1]
        score, docs = self.score, None
        score[:] = 0
        while True:
            ahead = np.where(at < end, weights * self.impact[np.minimum(at, len(self.impact) - 1)], 0)
            rest = int(ahead.sum())
            if rest == 0:
                docs = np.flatnonzero(score)
                break
            if len(score) > k and int(score.max()) > rest:
                least = int(np.partition(score, len(score) - k)[len(score) - k])  # the k-th best so far
                if least > rest:
                    docs = np.flatnonzero(score + rest >= least)  # no other can reach it
                    if len(docs) <= k + few:
                        break
            bar = max(1, int(ahead.max() * STEP))
            for i in np.flatnonzero(ahead >= bar):
                # Groups of the term whose impact reaches the bar; they descend.
                a = at[i]
                b = a + np.searchsorted(-self.impact[a : end[i]] * weights[i], -bar, side="right")
                counts = np.diff(self.begin[a : b + 1])
                score[self.doc[self.begin[a] : self.begin[b]]] += np.repeat(self.impact[a:b] * weights[i], counts)
                at[i] = b
        full = self.complete(docs, terms, weights) if rest else score[docs]
        order = np.lexsort((self.ids[docs], -full))[:k]
        return self.ids[docs[order]], full[order]


def _search(block, stats, k: int):
    """Rows (qid, id, score) of the k best of a task's documents for each query."""

    def run(batches):
        held, (docs, terms, df) = block.value, stats.value
        weights = np.array([weight(docs, int(d)) for d in df], np.int64)
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(held.queries)
        rows, size = [], 0

        def search():
            table = pa.Table.from_batches(rows).combine_chunks()
            ids = np.asarray(table.column("id").cast(pa.int64()).fill_null(_NO_ID))
            lists, n = table.column("terms").combine_chunks(), np.asarray(table.column("n"))
            count = np.asarray(table.column("counts").combine_chunks().flatten()).astype(np.int64)
            term = np.asarray(lists.flatten()).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
            shard = Shard(ids, impact(count, n[doc], docs, terms), doc, term, len(df))
            for i, (_, which, times) in enumerate(held.queries):
                found, score = shard.best(which, weights[which] * times, k)
                found, score = np.concatenate((top[i][0], found)), np.concatenate((top[i][1], score))
                order = np.lexsort((found, -score))[:k]
                top[i] = (found[order], score[order])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows.append(part)
                size += len(part.column(2).flatten())
                if size >= SHARD_POSTINGS:
                    search()
                    rows, size = [], 0
        if rows:
            search()
        found = np.concatenate([np.zeros(0, np.int64), *(t[0] for t in top)])
        qids = np.repeat(np.array([q for q, _, _ in held.queries], np.int64), [len(t[0]) for t in top])
        scores = np.concatenate([np.zeros(0, np.int64), *(t[1] for t in top)])
        yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(found, mask=found == _NO_ID), pa.array(scores)], ["qid", "id", "score"])
        release()

    return run


def _merge(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with their rank, first in parts of its rows."""
    dealt = hits.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS)))
    for keys in (["qid", "part"], ["qid"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("id")))
        dealt = dealt.withColumn("rank", rank).filter(F.col("rank") <= k)
    return dealt.select("qid", "rank", "id", "score")


def _blocks(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``items`` (qid, terms) with block, dealt by hash so that none has more than ``most`` terms, or it
    holds a single query; and how many blocks there are."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(1.5 * total / most)) if total > most else 1
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(F.sum(F.size("terms")).alias("size"), F.count("*").alias("n"))
        if not sizes.filter((F.col("size") > most) & (F.col("n") > 1)).count():
            return dealt, blocks
        blocks *= 2


def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): the k highest-scoring documents of each item, ties by ascending id."""
    spark = docs.sparkSession
    space, sc = Workspace(spark, "lexical"), spark.sparkContext
    terms = F.regexp_extract_all(F.translate(F.coalesce(F.col(item_text), F.lit("")), UPPER, LOWER), F.lit(TERM.pattern), F.lit(0))
    queries = space.save(items.select(F.monotonically_increasing_id().alias("qid"), F.col(item_col).alias("item"), terms.alias("terms")), "items")
    dealt, blocks = _blocks(queries.select("qid", "terms").filter(F.size("terms") > 0), block_terms)
    source, every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), None
    for i in range(blocks):
        block = make_block(dealt.filter(F.col("block") == i).collect())  # bounded by block_terms
        shared = sc.broadcast(block)
        held = space.save(source.mapInArrow(_postings(shared), "id long, n long, terms array<int>, counts array<int>"), f"postings-{i}")
        count, length = held.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(block.hashes), np.int64)
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each term of the block
            df[r["term"]] = r["count"]
        stats = sc.broadcast((count, length or 0, df))
        hits = space.save(held.mapInArrow(_search(shared, stats, k), "qid long, id long, score long"), f"hits-{i}")
        every = hits if every is None else every.unionByName(hits)
    ranked = _merge(every, k).join(queries.select("qid", "item"), "qid")
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
