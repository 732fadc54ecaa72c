"""Near-duplicate linking over banded signatures, shared by documents and lines.

Signatures come from one-permutation hashing: a set's hashes fall into bins, the smallest of each bin
stays, and empty bins borrow from filled ones by a fixed sequence of random picks for each bin
(optimal densification). Bands of a few bins are hashed to bucket keys.

Candidate edges are star-shaped: each bucket links its members to one centre, so a bucket of n
members gives n - 1 pairs. Band rows are combined where they are made, so that even a bucket that
holds most of the rows sends one row from each chunk, and travel packed. Every edge is confirmed on
full sets.

A star may miss a pair whose two members both fall short of the centre. So the members of buckets
whose members hang under different centres are compared across these, in blocks of bounded size, by
the smallest hashes of their sets (small sets are there as a whole); only pairs that may be similar
become rows, and these are confirmed on full sets too. In a large bucket the members under its
commonest centre stay where they are, and only the others are copied to every block. No pair that
shares ``least`` buckets goes without a test: a pair that looks sure may spare others between the
same two components, and where such a pair fails on full sets, all is compared again without sparing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Workspace, chunks, mix64, release
from millrace.llm.components import connected

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Id sets up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 500_000
_PICKS = 4096
#: Picks that are looked up at one time.
_HELD_PICKS = 1 << 20
#: Members of a block in the comparison across components.
BLOCK = 1024


def bins_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)


@lru_cache
def _picks(bins: int) -> np.ndarray:
    """For each bin its sequence of random picks."""
    return np.ascontiguousarray(np.random.Generator(np.random.PCG64(bins)).integers(0, bins, (_PICKS, bins)).T)


def densify(sig: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first filled one in that bin's own sequence of picks."""
    bins, picks = sig.shape[1], _picks(sig.shape[1])
    filled = sig != EMPTY
    out = sig.copy()
    r, b = np.nonzero(~filled & filled.any(axis=1)[:, None])
    at = 0
    while len(r) and at < _PICKS:  # as many picks at a time as were seen before
        span = max(1, min(at, _PICKS - at, _HELD_PICKS // len(r)))
        donor = picks[b, at : at + span]
        ok = filled.ravel()[donor + (r * bins)[:, None]]
        first = ok.argmax(axis=1)
        hit = ok[np.arange(len(r)), first]
        out[r[hit], b[hit]] = sig[r[hit], donor[hit, first[hit]]]
        r, b, at = r[~hit], b[~hit], at + span
    for i, j in zip(r.tolist(), b.tolist(), strict=True):
        out[i, j] = sig[i, filled[i].argmax()]
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """For each sorted set the smallest hash of each bin, or EMPTY."""
    sig = np.full((len(sets), bins), EMPTY, np.uint64)
    for i, s in enumerate(sets):
        b = bins_of(s, bins)  # ascending, as the hashes are
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else []
        sig[i, b[first]] = s[first]
    return sig


#: The last bits of a bucket's key are the number of its band.
BAND_BITS = 6


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit bucket key for each band of each signature row, as signed longs."""
    rows = sig.shape[1] // bands
    total = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::rows][:, :bands])
    total &= ~np.uint64((1 << BAND_BITS) - 1)
    return (total | np.arange(bands, dtype=np.uint64)).view(np.int64)


def as_hashes(payloads: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(p, np.uint64) for p in payloads]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |X and Y| >= percent * |X or Y| for sets given as sorted distinct hashes."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


#: Buckets are dealt by so many leading bits of their keys; empty parts cost nothing.
PART_BITS = 12
_ROW = np.dtype([("key", "<i8"), ("id", "<i8")])
_EDGE = np.dtype([("key", "<i8"), ("centre", "<i8"), ("id", "<i8")])


def local_stars(keys: np.ndarray, ids: np.ndarray) -> list[tuple[int, bytes]]:
    """The band rows of one chunk, combined before they are dealt: (part, packed rows).

    ``keys`` has a row of bucket keys for each of ``ids``. A bucket sends its first member on, packed
    with others of its part; further members become edges to that one here (part -1). So a bucket
    that holds most of the rows still sends one row from each chunk.
    """
    k, i = keys.ravel(), np.repeat(ids, keys.shape[1])
    order = np.argsort(k)
    k, i = k[order], i[order]
    first = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    at = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    more = ~first & (i != i[at])
    edges = np.empty(int(more.sum()), _EDGE)
    edges["key"], edges["centre"], edges["id"] = k[more], i[at][more], i[more]
    rows = np.empty(int(first.sum()), _ROW)
    rows["key"], rows["id"] = k[first], i[first]
    part = (rows["key"] >> (64 - PART_BITS)) + (1 << (PART_BITS - 1))  # ascending, as the keys are
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    ends = [*cuts[1:].tolist(), len(rows)]
    out = [(int(part[a]), rows[a:b].tobytes()) for a, b in zip(cuts.tolist(), ends, strict=True)] if len(cuts) else []
    return [*out, (-1, edges.tobytes())] if len(edges) else out


def _meet(batches):
    """(key, centre, id) of buckets with more than one member among the packed rows of some parts."""
    blobs, edges = [], []
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            (edges if part < 0 else blobs).append(blob)
    found = [np.frombuffer(b"".join(edges), _EDGE)] if edges else []
    if blobs:
        rows = np.frombuffer(b"".join(blobs), _ROW)
        order = np.argsort(rows["key"])
        k, i = rows["key"][order], rows["id"][order]
        first = np.concatenate(([True], k[1:] != k[:-1]))
        centre = i[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
        edge = centre != i
        held = np.empty(int(edge.sum()), _EDGE)
        held["key"], held["centre"], held["id"] = k[edge], centre[edge], i[edge]
        found.append(held)
    for part in found:
        for lo in range(0, len(part), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c][lo : lo + 200_000])) for c in _EDGE.names], list(_EDGE.names))
    release()


def bucket_members(packed: DataFrame, space: Workspace) -> DataFrame:
    """(key, id) of every bucket with more than one member, from (part, blob) of ``local_stars``."""
    # Edges made in a chunk need no meeting; they are dealt evenly.
    dealt = packed.repartition(F.when(F.col("part") >= 0, F.col("part")).otherwise(-1 - F.pmod(F.xxhash64("blob"), F.lit(1 << PART_BITS))))
    found = space.save(dealt.select("part", "blob").mapInArrow(_meet, "key long, centre long, id long"), "buckets", sweep=True)
    return found.select("key", "id").union(found.select("key", F.col("centre").alias("id"))).distinct()


def join_ids(rows: DataFrame, ids: DataFrame, on: list[str], most: int = BROADCAST_IDS) -> DataFrame:
    """Rows joined to ``ids``: broadcast while these are at most ``most`` rows, shuffled beyond."""
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, on)


def _confirm(edges: DataFrame, sets: DataFrame, percent: int, decode) -> DataFrame:
    """(u, v, sure, ok): whether the full sets of each edge (u, v, sure) are as similar as wanted."""

    def check(batches):
        for pdf in batches:
            for part in chunks(pdf, 2000):
                distinct = list({*part["su"], *part["sv"]})
                held = dict(zip(distinct, decode(distinct), strict=True))
                ok = [similar(held[a], held[b], percent) for a, b in zip(part["su"], part["sv"], strict=True)]
                yield part[["u", "v", "sure"]].assign(ok=np.array(ok, bool))
            release()

    u, v = sets.select(F.col("id").alias("u"), F.col("s").alias("su")), sets.select(F.col("id").alias("v"), F.col("s").alias("sv"))
    return edges.select("u", "v", "sure").join(v, "v").join(u, "u").mapInPandas(check, "u long, v long, sure boolean, ok boolean")


def _bottom(decode, bottom: int, bands: int):
    """(id, n, low, bands, large): the ``bottom`` smallest hashes of a set, by their upper halves, its
    bucket keys by band (0 where it is alone), and which of these buckets are large."""

    def run(batches):
        for pdf in batches:
            low, sizes, keys, large = [], [], np.zeros((len(pdf), bands), np.int64), []
            for s in decode(pdf["s"].tolist()):
                sizes.append(len(s))
                upper = (s[:bottom] >> np.uint64(32)).astype(np.uint32)  # sorted, as the hashes are
                low.append(upper[np.concatenate(([True], upper[1:] != upper[:-1]))[: len(upper)]].tobytes())
            for i, (held, more) in enumerate(zip(pdf["keys"], pdf["larges"], strict=True)):
                keys[i, np.asarray(held) & ((1 << BAND_BITS) - 1)] = held
                large.append(sum(1 << (int(k) & ((1 << BAND_BITS) - 1)) for k in more))
            yield pd.DataFrame({"id": pdf["id"], "n": sizes, "low": low, "bands": [row.tobytes() for row in keys], "large": np.array(large, np.uint64).view(np.int64)})
            release()

    return run


def likeness(x: np.ndarray, y: np.ndarray, whole: bool, percent: int) -> int:
    """Whether two sets, ``x`` and ``y`` their smallest hashes, are as similar as wanted: 0 no, 1
    perhaps, 2 yes.

    Small sets are here as a whole, so this is exact but for a margin of two hashes. Of larger ones
    the share among the smallest of both is an estimate, which chance takes across the margin on
    either side but once in three hundred thousand times.
    """
    both = np.concatenate((x, y))
    both.sort()
    again = both[1:] == both[:-1]
    twice, union = both[1:][again], both[np.concatenate(([True], ~again))]
    p = percent / 100
    if whole:
        return int(len(twice) + 2 >= p * len(union)) + int(len(twice) - 1 >= p * (len(union) + 1))
    k = min(len(x), len(y))
    common = int(np.searchsorted(twice, union[k - 1], "right"))
    share, spread = common / k, 4.5 * np.sqrt(p * (1 - p) / k)
    return int(share >= p - spread) + int(share >= p + spread)


#: Bits of a set's map.
MAP_BITS = 8192


def set_maps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of bits for each set, one set for each remainder of its hashes; the sets' sizes; and how many
    hashes of each share a bit with another one."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bits = np.zeros((len(sets), MAP_BITS), bool)
    bits[np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) % np.uint32(MAP_BITS)] = True
    maps = np.packbits(bits, axis=1).view(np.uint64)
    return maps, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)


def may_be_like(i: np.ndarray, j: np.ndarray, maps: np.ndarray, sizes: np.ndarray, shared: np.ndarray, whole: np.ndarray, percent: int) -> np.ndarray:
    """False for pairs to which ``likeness`` gives 0 by the bits alone: two sets have no more hashes in
    common than bits, and those of either set that share a bit."""
    common = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1024):
        x, y = i[at : at + 1024], j[at : at + 1024]
        common[at : at + 1024] = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64)
    common += np.minimum(shared[i], shared[j])
    p, least = percent / 100, np.minimum(sizes[i], sizes[j])
    np.minimum(common, least, out=common)
    estimate = common / np.maximum(least, 1) >= p - 4.5 * np.sqrt(p * (1 - p) / np.maximum(least, 1))
    return np.where(whole[i] & whole[j], common + 2 >= p * (sizes[i] + sizes[j] - common), estimate)


def _across(percent: int, least: int, bottom: int, spare: bool):
    """Links (u, v, sure), as far as the smallest hashes tell, between different components within one
    group.

    Rows come sorted by group (key, a, b): with a = b all pairs inside the block count, else those of
    block a with block b. A group has at most two blocks, so what is held is bounded. A pair is
    looked at in the first large bucket that it shares, if it shares ``least`` buckets of any size,
    and unless, with ``spare``, a sure link joins its components in this group already: that adds none.
    """

    def pairs(t, lo, hi):
        key, m = t["key"][lo], hi - lo
        c, n, ids, low, block = (t[x][lo:hi] for x in ("c", "n", "id", "low", "block"))
        if (c == c[0]).all():
            return
        bands = np.frombuffer(b"".join(t["bands"][lo:hi]), np.int64).reshape(m, -1)
        large = (t["large"][lo:hi].view(np.uint64)[:, None] >> np.arange(bands.shape[1], dtype=np.uint64)) & np.uint64(1) == 1
        maps, small, top = None, n <= bottom, {}

        def find(v):
            while v in top:
                v = top[v]
            return v

        both = t["a"][lo] != t["b"][lo]
        step = max(1, 60_000 // m)
        for at in range(0, m, step):  # rows against all that come after them, some rows at a time
            i = np.arange(at, min(m, at + step))
            ok = (c[i][:, None] != c[None]) & (np.arange(m)[None] > i[:, None])
            if both:
                ok &= block[i][:, None] != block[None]
            r, j = np.nonzero(ok)
            i = i[r]
            keep = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[keep], j[keep]
            equal = (bands[i] == bands[j]) & (bands[i] != 0)
            first = (equal & large[i]).argmax(axis=1)
            keep = (equal.sum(axis=1) >= least) & (bands[i, first] == key)
            i, j = i[keep], j[keep]
            if len(i):
                maps = maps or set_maps(low)
                keep = may_be_like(i, j, *maps, small, percent)
                i, j = i[keep], j[keep]
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                a, b = find(c[x]), find(c[y])
                if a == b:
                    continue  # a link between these two components is here already
                like = likeness(low[x], low[y], small[x] and small[y], percent)
                if like:
                    yield min(ids[x], ids[y]), max(ids[x], ids[y]), like == 2
                if spare and like == 2:
                    top[max(a, b)] = min(a, b)

    def run(batches):
        held = None
        for last, batch in _with_last(batches):
            table = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            table = table.combine_chunks()
            t = {x: table[x].to_numpy() for x in ("key", "a", "b", "block", "id", "c", "n", "large")}
            m = len(table)
            t["low"] = [np.frombuffer(x, np.uint32) for x in table["low"].to_pylist()]
            t["bands"] = table["bands"].to_pylist()
            new = np.ones(m, bool)
            new[1:] = (t["key"][1:] != t["key"][:-1]) | (t["a"][1:] != t["a"][:-1]) | (t["b"][1:] != t["b"][:-1])
            ends = [*np.flatnonzero(new).tolist(), m]
            whole = ends if last else ends[:-1]  # the group at the end may go on in the next batch
            out = [p for lo, hi in zip(whole[:-1], whole[1:], strict=True) if hi - lo > 1 for p in pairs(t, lo, hi)]
            held = None if last or not m else table.slice(whole[-1])
            yield pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)), pa.array([p[2] for p in out], pa.bool_())], ["u", "v", "sure"])
            release()

    return run


def _with_last(batches):
    """Each batch with whether it is the last one."""
    held = None
    for batch in batches:
        if held is not None:
            yield False, held
        held = batch
    if held is not None:
        yield True, held


def in_blocks(mixed: DataFrame) -> DataFrame:
    """(key, a, b, block, id, c): the members of mixed buckets dealt to groups of two blocks at most, so
    that any two of different components meet in one group.

    ``mixed``: (key, id, c, size, big), size the members of the bucket and big its commonest component
    with the number of its members, as a struct (n, c). Up to ``BLOCK`` members are one block. Beyond
    that the commonest component has blocks of its own, whose members meet those of the others only:
    a bucket of n members of which m are others makes about n * (m / BLOCK + 1) + m * n / BLOCK rows.
    """
    others = F.col("size") - F.col("big.n")
    whole = F.col("size") <= BLOCK
    held = mixed.withColumn("mine", F.when(whole, 1).otherwise(F.ceil(others / BLOCK)).cast("int"))  # blocks of the others
    held = held.withColumn("theirs", F.when(whole, 0).otherwise(F.ceil(F.col("big.n") / BLOCK)).cast("int"))
    common = ~whole & (F.col("c") == F.col("big.c"))
    place = F.xxhash64("id")
    held = held.withColumn("block", F.when(common, F.col("mine") + F.pmod(place, F.greatest("theirs", F.lit(1)))).otherwise(F.pmod(place, F.col("mine"))).cast("int"))
    upto = F.when(common, F.col("mine")).otherwise(F.col("mine") + F.col("theirs"))
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0), upto - 1)))
    return spread.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "c")


def link(
    packed: DataFrame, fetch: Callable[[DataFrame], DataFrame], bands: int, percent: int, space: Workspace,
    decode: Callable[[list[bytes]], list[np.ndarray]] = as_hashes, least: int = 2, bottom: int = 1024,
) -> DataFrame:
    """(node, component) of ids that are linked with another one.

    ``packed``: (part, blob) of ``local_stars``, with keys of ``bands`` bands. ``fetch``: from a table of ids to (id, s), where
    ``decode`` makes whole sets, as sorted distinct 64-bit hashes, of binaries s. ``least``: the number of
    buckets that a pair must share to be a candidate. ``bottom``: the number of a set's hashes that the
    comparison across components sees.
    """
    members = space.save(bucket_members(packed, space), "members")
    if least > 1:  # whoever is in fewer shared buckets shares too few with anyone
        often = members.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("id")
        held = members.join(often, "id")
        members = space.save(held.join(held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key").select("key", "id"), "often")
    # Most buckets have two members, and alike ones share many of them: these travel as pairs with their number.
    sized = space.save(members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")), "sized")
    shared = [F.count("*").alias("n"), *([F.collect_list("key").alias("keys")] if least > 1 else [])]
    couples = space.save(sized.filter("size = 2").groupBy("lo", "hi").agg(*shared), "couples")
    large = space.save(members.join(sized.filter("size > 2").select("key", "size"), "key"), "large")
    # The centre of a bucket is the member whose buckets hold the most rows: what copies stem from
    # shares more bands with them than they do with each other.
    held = large.select("id", F.col("size").alias("w")).unionAll(couples.select(F.explode(F.array("lo", "hi")).alias("id"), (2 * F.col("n")).alias("w")))
    weight = space.save(held.groupBy("id").agg(F.sum("w").alias("weight")), "weight")
    sets = space.save(fetch(weight.select("id")), "sets", sweep=True)
    weighed = large.join(weight, "id")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
    offered = large.join(centres, "key").select("id", F.struct(F.col("top.weight").alias("w"), F.col("top.minus").alias("minus")).alias("top"), F.lit(1).cast("long").alias("n")).filter("id <> -top.minus")
    ends = couples.join(weight.toDF("lo", "wlo"), "lo").join(weight.toDF("hi", "whi"), "hi")
    low_first = F.col("wlo") >= F.col("whi")
    lesser, greater = F.when(low_first, F.col("hi")).otherwise(F.col("lo")), F.when(low_first, F.col("lo")).otherwise(F.col("hi"))
    offered = offered.unionAll(ends.select(lesser.alias("id"), F.struct(F.greatest("wlo", "whi").alias("w"), (-greater).alias("minus")).alias("top"), "n"))
    if least > 1:
        offered = offered.groupBy("id", "top").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # Each member meets the weightiest centre of its buckets: no more edges than members.
    star = offered.groupBy("id").agg(F.max("top").alias("top")).select("id", (-F.col("top.minus")).alias("centre"))
    star = star.select(F.col("id").alias("u"), F.col("centre").alias("v"), F.lit(False).alias("sure"))
    tested = space.save(_confirm(star, sets, percent, decode), "links", sweep=True)
    links = tested.filter("ok").select("u", "v")

    # What lies in one bucket but hangs under different centres: buckets of two are pairs by
    # themselves, larger ones are compared in blocks of bounded size.
    above = links.select(F.col("u").alias("v"), F.col("v").alias("top"))
    under = links.join(above, "v", "left").select(F.col("u").alias("id"), F.coalesce("top", "v").alias("c"))
    under = space.save(under, "under")
    labelled = large.select("key", "id").join(under, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    counted = labelled.groupBy("key", "c").agg(F.count("*").alias("n"))
    whole = counted.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "c")).alias("big"), F.count("*").alias("parts"))
    mixed = space.save(labelled.join(whole.filter("parts > 1").drop("parts"), "key"), "mixed", sweep=True)
    apart = couples.join(under.toDF("lo", "clo"), "lo", "left").join(under.toDF("hi", "chi"), "hi", "left").filter("coalesce(clo, lo) <> coalesce(chi, hi)")
    twos = apart.filter(F.col("n") >= least).select(F.col("lo").alias("u"), F.col("hi").alias("v"), F.lit(False).alias("sure"))
    # A bucket that two ids of different components share is mixed, so that these are all that count.
    buckets = mixed.select("id", "key", F.lit(True).alias("large"))
    if least > 1:
        buckets = buckets.unionAll(apart.select(F.explode(F.array("lo", "hi")).alias("id"), "keys").select("id", F.explode("keys"), F.lit(False)))
    marks = buckets.groupBy("id").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("large"), F.col("key"))).alias("larges"))
    payload = sets.join(marks.filter(F.size("larges") > 0), "id").mapInPandas(_bottom(decode, bottom, bands), "id long, n long, low binary, bands binary, large long")
    dealt = in_blocks(mixed).join(payload, "id").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "id")

    pairs = tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "ok")

    def across(spare: bool) -> tuple[bool, DataFrame]:
        """Whether a pair that looked sure failed, and the links found."""
        more = dealt.mapInArrow(_across(percent, least, bottom, spare), "u long, v long, sure boolean").union(twos)
        more = space.save(more.groupBy("u", "v").agg(F.max("sure").alias("sure")).join(pairs, ["u", "v"], "left"), "more", sweep=True)
        found = space.save(_confirm(more.filter("ok IS NULL"), sets, percent, decode), "found", sweep=True)
        return more.union(found).filter("sure AND NOT ok").count() > 0, found.filter("ok").select("u", "v")

    failed, extra = across(True)
    if failed:  # what it spared counts after all
        extra = across(False)[1]
    return space.save(connected(links.union(extra), space), "labels")
