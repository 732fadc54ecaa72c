"""Fuzzy line deduplication: MinHash over character shingles, bands, exact Jaccard, union-find.

Lines are compared after trimming blanks at both ends; blank lines are never compared and always
stay. Equal lines are met by their hashes; different lines are linked where the Jaccard similarity
of their sets of 8-character shingles (of a shorter line: the whole line) is 0.8 or more, found by 18
bands of 4 bins (one common bucket makes a candidate: a pair of similarity 0.8 is reached but for a
chance of one in ten thousand, one of 0.85 of one in two million, one of 0.9 of one in ten billion)
and confirmed exactly. Of each component the line that comes first, by document id, row and
place, stays; the others go from their texts.

Edge cases: null and empty texts stay as they are; a document that loses all its lines gets an empty
text (``dedup_lines``) or goes (``drop_emptied``); ties between rows with equal ids are ordered by a
hash of their content; rows equal in id and text are one text and are treated alike; an empty table
gives an empty result. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Workspace, once, release, row_key, unused
from millrace.llm.linking import EMPTY, band_keys, bins_of, densify, join_ids, link, local_stars

SHINGLE_CHARS, PERCENT = 8, 80
BANDS, ROWS = 18, 4
#: Buckets that two lines must share to be compared.
LEAST = 1
#: Characters whose shingles are hashed at one time in a worker.
BLOCK_CHARS = 100_000
#: Lines whose signatures a worker holds at one time.
BLOCK_LINES = 8192
#: Characters of texts whose lines a worker holds at one time.
CHUNK_CHARS = 6_000_000
#: Up to so many removed lines their places are broadcast to the texts; more are joined by shuffle.
BROADCAST_LINES = 1_000_000
_BLANKS = " \t\r\x0b\f"


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash at each character of the lines, of the shingle that begins there; which of them lie inside
    one line; and the lines' lengths, as padded."""
    k = SHINGLE_CHARS
    padded = [x if len(x) >= k else x.ljust(k, "\0") for x in lines]
    joined = "".join(padded)
    codes = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    total = codes.astype(np.uint64)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    factor, span = 0x9E3779B97F4A7C15, 1
    while span < k:  # doubling: a hash of 2 n characters from two of n
        ahead = total[span:]
        total = total[:-span] * np.uint64(factor)
        total += ahead
        factor, span = factor * factor % 2**64, 2 * span
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    inside = np.ones(len(total), bool)  # shingles that begin in one line and end in the next do not count
    ends = np.cumsum(lengths)[:-1]
    for back in range(1, k):
        inside[ends - back] = False
    return total, inside, lengths


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct hashes of each line's shingles."""
    out = []
    for a, b in _blocks(lines):
        hashes, inside, lengths = _shingle_hashes(lines[a:b])
        hashes = hashes[inside]
        ends = np.cumsum(lengths - (SHINGLE_CHARS - 1)).tolist()
        for i, j in zip([0, *ends[:-1]], ends, strict=True):
            hashes[i:j].sort()
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        fresh[ends[:-1]] = True
        upto = np.cumsum(fresh)[np.array(ends) - 1].tolist()
        hashes = hashes[fresh]
        out += [hashes[i:j] for i, j in zip([0, *upto[:-1]], upto, strict=True)]
    return out


def _decode(payloads: list[bytes]) -> list[np.ndarray]:
    return shingle_sets([p.decode("utf-8", "surrogatepass") for p in payloads])


def line_bands(lines: list[str]) -> np.ndarray:
    """The bucket keys of each line, a row of them for each."""
    bins = BANDS * ROWS
    sig = np.full(len(lines) * bins, EMPTY, np.uint64)
    for a, b in _blocks(lines):
        hashes, inside, lengths = _shingle_hashes(lines[a:b])
        hashes[~inside] = EMPTY  # no minimum
        place = np.repeat(np.arange(a * bins, b * bins, bins), lengths)[: len(hashes)]
        place += bins_of(hashes, bins)
        np.minimum.at(sig, place, hashes)
    return band_keys(densify(sig.reshape(len(lines), bins)), BANDS)


def _blocks(lines: list[str]):
    at, size = 0, 0
    for i, x in enumerate(lines):
        if size and size + len(x) > BLOCK_CHARS:
            yield at, i
            at, size = i, 0
        size += len(x)
    if len(lines) > at:
        yield at, len(lines)


def _lines_of(batches):
    """(batch, lines that are not blank, their rows and numbers, first hashes, coded lines), a few
    millions of characters of texts at a time."""
    for batch in batches:
        texts, at = batch.column(batch.schema.get_field_index("t")).to_pylist(), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHUNK_CHARS):
                size += len(texts[end])
                end += 1
            lines, owner, no = [], [], []
            for i in range(at, end):
                for n, raw in enumerate(texts[i].split("\n")):
                    if line := raw.strip(_BLANKS):
                        lines.append(line)
                        owner.append(i)
                        no.append(n)
            coded = [x.encode("utf-8", "surrogatepass") for x in lines]
            h1 = np.fromiter(map(xxhash.xxh64_intdigest, coded), np.uint64, len(lines))
            yield batch, lines, np.array(owner, np.int64), no, h1, coded
            at = end
        release()


def _places(batches):
    """(doc, rk, no, h1, h2) of every line that is not blank."""
    for batch, _, owner, no, h1, coded in _lines_of(batches):
        h2 = np.fromiter(map(xxhash.xxh3_64_intdigest, coded), np.uint64, len(coded))
        rows = pa.array(owner)
        columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(no, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "rk", "no", "h1", "h2"])


def _buckets(batches):
    """(part, blob) with the buckets of the different lines of a chunk."""
    for _, lines, _, _, h1, _ in _lines_of(batches):
        _, fresh = np.unique(h1, return_index=True)
        fresh.sort()
        chosen = [lines[i] for i in fresh.tolist()]
        keys = [line_bands(chosen[a : a + BLOCK_LINES]) for a in range(0, len(chosen), BLOCK_LINES)]
        packed = local_stars(np.concatenate(keys), h1[fresh].view(np.int64)) if keys else []
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())], ["part", "blob"])


def _rebuild(text: Column, gone: Column, counts: bool) -> Column:
    """struct(text, has_lines, n_lines): changed texts without the lines that go; the count is that
    of lines before."""

    @F.pandas_udf("text string, has_lines boolean, n_lines long")
    def run(texts: pd.Series, gone_lines: pd.Series) -> pd.DataFrame:
        rows = []
        for t, gone_here in zip(texts, gone_lines, strict=True):
            lines = t.split("\n") if t and (counts or gone_here is not None) else []
            n = sum(1 for x in lines if x.strip(_BLANKS)) if counts else 0
            if gone_here is None:
                rows.append((None, None, n))
                continue
            out = set(gone_here.tolist())
            kept = [x for i, x in enumerate(lines) if i not in out]
            rows.append(("\n".join(kept), any(x.strip(_BLANKS) for x in kept), n))
        release()
        return pd.DataFrame(rows, columns=["text", "has_lines", "n_lines"])

    return once(run)(text, gone)


#: Stands for a null id, and sorts first as null does.
_NO_ID = -(2**63)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(_doc(id_col), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("t"))
    return rows.filter("t IS NOT NULL")


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rk, no) of every line that goes, as in ``changed_texts``."""
    return changed_texts(docs, id_col, text_col).select("doc", "rk", F.explode("nos").alias("no"))


def changed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rk, nos) of every text that loses lines, ``nos`` being their numbers; ``doc`` is the id and
    ``rk`` ``row_key(id_col, text_col)``, which tells rows of one id apart.

    A line is known by a 64-bit hash, told apart by a second one: different lines that share the
    first are left alone.
    """
    space = Workspace(docs.sparkSession, "lines")
    texts = _texts(docs, id_col, text_col)
    places = space.save(texts.mapInArrow(_places, "doc long, rk long, no int, h1 long, h2 long"), "lines")
    packed = texts.select("t").mapInArrow(_buckets, "part int, blob binary")
    same = places.groupBy("h1").agg(F.min(F.struct("doc", "rk", "no")).alias("first"), F.count("*").alias("n"), F.min("h2").alias("lo"), F.max("h2").alias("hi"))
    distinct = space.save(same.filter("lo = hi").select(F.col("h1").alias("id"), "n", "first.*"), "distinct", sweep=True)

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = distinct.join(ids, "id").groupBy("doc", "rk").agg(F.collect_list(F.struct("no", "id")).alias("want"))  # of one text each
        wanted = space.save(wanted, "wanted")

        def pick(batches):
            for pdf in batches:
                rows = []
                for text, want in zip(pdf["t"], pdf["want"], strict=True):
                    lines = text.split("\n")
                    rows += [(w["id"], lines[w["no"]].strip(_BLANKS).encode("utf-8", "surrogatepass")) for w in want]
                yield pd.DataFrame(rows, columns=["id", "s"])
                release()

        found = join_ids(texts, wanted, ["doc", "rk"]).select("t", "want").mapInPandas(pick, "id long, s binary")
        return found.groupBy("id").agg(F.min("s").alias("s"))  # rows equal in id and text give a line twice

    labels = link(packed, fetch, BANDS, PERCENT, space, _decode, LEAST)
    groups = distinct.join(labels.withColumnRenamed("node", "id"), "id", "left").filter("n > 1 OR component IS NOT NULL")
    groups = space.save(groups.withColumn("component", F.coalesce("component", "id")), "groups")
    keeper = groups.groupBy("component").agg(F.min(F.struct("doc", "rk", "no")).alias("keep"))
    marked = groups.join(keeper, "component").select(F.col("id").alias("h1"), "keep")
    gone = places.drop("h2").join(space.save(marked, "marked"), "h1").filter("doc <> keep.doc OR rk <> keep.rk OR no <> keep.no")
    return space.save(gone.groupBy("doc", "rk").agg(F.collect_set("no").alias("nos")), "gone")  # of one text each


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` without duplicate lines; ``n_chars``, where there is one, follows the text.

    ``counts`` adds __n_lines and __n_removed. ``drop_emptied`` drops documents that had lines and
    have none left.
    """
    gone = changed_texts(docs, id_col, text_col)
    doc, key, out, new = unused(docs, "__doc", "__rk", "__gone", "__new")
    by_row = gone.toDF(doc, key, out)
    by_row = F.broadcast(by_row) if (gone.agg(F.sum(F.size("nos"))).first()[0] or 0) <= BROADCAST_LINES else by_row
    held = docs.withColumns({doc: _doc(id_col), key: row_key(id_col, text_col)}).join(by_row, [doc, key], "left")
    # One Python column, computed once: else it would be copied into all that reads it.
    held = held.withColumn(new, _rebuild(F.col(text_col), F.col(out), counts))
    changed = F.col(out).isNotNull()
    if drop_emptied:
        held = held.filter(~changed | F.col(new)["has_lines"])
    values = {text_col: F.when(changed, F.col(new)["text"]).otherwise(F.col(text_col))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length(F.col(new)["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    if counts:
        values |= {"__n_lines": F.col(new)["n_lines"], "__n_removed": F.coalesce(F.size(out), F.lit(0)).cast("long")}
    return held.withColumns(values).select(*docs.columns, *([c for c in ("__n_lines", "__n_removed") if c not in docs.columns] if counts else []))
