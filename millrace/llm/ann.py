"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard.

Equal vectors are one point. Points are dealt to shards of about ``SHARD_POINTS`` by a hash of their
id; in each shard greedy searches from the medoid propose neighbours, and pruning with a relaxed
distance (a candidate goes if a kept neighbour is nearer to it, by the factor alpha, than the point
is) keeps diverse edges. The index is a written table with a row for each shard. Queries go, in blocks
of ``QUERY_BLOCK``, to every shard: a shard's index is dealt once and its blocks stream past it. A beam
search gives each shard's best, whose distances are recomputed in double precision before the merge.

Graphs are built and searched on vectors that are centred and scaled in their shard, in single
precision where that tells neighbours apart and in double precision elsewhere (clusters far from each
other, sizes that differ by many powers of ten).

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, and
neither do rows with a null id; vectors of different length never meet; rows repeated in id and vector
are one; an id with several vectors is as near as the nearest of them (and then a query may get fewer
than ``k``); ties go to the smaller id; an empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Workspace

SHARD_POINTS = 4096
QUERY_BLOCK = 2048
#: Edges of a point, width of the searches that build and that answer, relaxation of the pruning.
DEGREE, BUILD_WIDTH, QUERY_WIDTH, ALPHA = 32, 64, 192, 1.2
_BATCH, _EXPAND = 256, 4
_SEED = 11
#: An index (turn 0: n points x with ids keys) or a block of queries (turn 1: vectors x with ids keys).
_ROW = "shard string, turn int, n int, start int, keys binary, x binary, graph binary"


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x (b, k, d) from q (b, d), by differences: exact however far from the origin."""
    gap = x - q[:, None]
    return np.einsum("bkd,bkd->bk", gap, gap)


class Frame:
    """Centre, scale and precision in which a shard's graph is built and searched."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        top = float(np.abs(x).max(initial=0.0))
        self.power = np.ldexp(1.0, -np.frexp(top)[1]) if top else 1.0  # a power of two: exact
        y = x * self.power
        self.centre = np.median(y, axis=0)
        y = y - self.centre
        spread = float(np.median(np.abs(y).max(axis=1)))
        self.scale = 1.0 / spread if spread > 1e-150 else 1.0
        y = y * self.scale
        # Single precision will do where rounding is small beside the gaps between neighbours.
        few = np.random.Generator(np.random.PCG64(_SEED)).permutation(n)[:48]
        gaps = np.stack([np.sqrt(((y - y[i]) ** 2).sum(axis=1)) for i in few])
        gaps[np.arange(len(few)), few] = np.inf
        least = np.quantile(gaps.min(axis=1), 0.1) if n > 1 else np.inf
        self.dtype = np.float32 if np.abs(y).max(initial=0.0) * x.shape[1] ** 0.5 * 1e-5 < least else np.float64

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.power - self.centre) * self.scale
        return np.clip(y, -1e17, 1e17).astype(self.dtype) if self.dtype == np.float32 else np.clip(y, -1e150, 1e150)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int):
    """For each row of ``q`` the ``width`` nearest points met, nearest first; -1 where there are fewer."""
    n, b = len(x), len(q)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for missing edges
    ids = np.full((b, width), n, np.int64)
    dist = np.full((b, width), np.inf, x.dtype)
    done = np.ones((b, width), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, _distances(x[None, [start]], q)[:, 0], False
    seen[:, start] = True
    rows = np.arange(b)
    while len(rows):
        open_at = np.argsort(done[rows], axis=1, kind="stable")[:, :_EXPAND]
        live = ~np.take_along_axis(done[rows], open_at, 1)
        take = np.where(live, np.take_along_axis(ids[rows], open_at, 1), n)
        done[rows[:, None], open_at] = True
        near = graph[take].reshape(len(rows), -1)
        fresh = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        near = np.sort(np.where(fresh, near, n), axis=1)  # two expanded points may share a neighbour
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near.sort(axis=1)
        near = near[:, : max(1, int((near < n).sum(axis=1).max(initial=0)))]
        real = near < n
        d = _distances(x[np.where(real, near, 0)], q[rows])
        d[~real] = np.inf
        all_d = np.concatenate((dist[rows], d), 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[rows] = np.take_along_axis(all_d, order, 1)
        ids[rows] = np.take_along_axis(np.concatenate((ids[rows], near), 1), order, 1)
        done[rows] = np.take_along_axis(np.concatenate((done[rows], ~real), 1), order, 1)
        rows = rows[~done[rows].all(axis=1)]
    return np.where(ids < n, ids, -1)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point, of its candidates (-1: none)."""
    n = len(x)
    cand = np.sort(np.where((cand == points[:, None]) | (cand < 0), n, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    real = cand < n
    at = np.where(real, cand, 0)
    v = x[at]
    near = _distances(v, x[points])
    near[~real] = np.inf
    order = np.argsort(near, axis=1, kind="stable")
    cand, near, v = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(v, order[..., None], 1)
    alive, rows = cand < n, np.arange(len(points))
    out = np.full((len(points), degree), n, np.int64)
    for k in range(degree):
        pick = alive.argmax(axis=1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        out[ok, k] = cand[rows, pick][ok]
        alive &= ~((alpha * alpha * _distances(v, v[rows, pick]) <= near) & ok[:, None])
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The graph (a row of edges for each point and one, all missing, for "none") and its start."""
    n = len(x)
    rng = np.random.Generator(np.random.PCG64(_SEED))
    start = int(np.einsum("nd,nd->n", x, x).argmin())  # vectors are centred: the point in their midst
    graph = np.full((n + 1, DEGREE), n, np.int64)
    if n > 1:
        first = rng.integers(0, n - 1, (n, min(DEGREE // 2, n - 1)))
        graph[:n, : first.shape[1]] = first + (first >= np.arange(n)[:, None])
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for lo in range(0, n, _BATCH):
            p = order[lo : lo + _BATCH]
            met = beam_search(x, graph, start, x[p], BUILD_WIDTH)
            held = np.where(graph[p] < n, graph[p], -1)
            graph[p] = robust_prune(x, p, np.concatenate((met, held), 1), alpha, DEGREE)
            # Reverse edges: appended while there is room, pruned beyond.
            src, dst = np.repeat(p, DEGREE), graph[p].ravel()
            src, dst = src[dst < n], dst[dst < n]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            nodes, begin, count = np.unique(dst, return_index=True, return_counts=True)
            for size in (32, 64, 128, _BATCH):  # padded to the size of their own kind
                mine = (count <= size) & (count > (0 if size == 32 else size // 2))
                if not mine.any():
                    continue
                t, c = nodes[mine], count[mine]
                grid = begin[mine][:, None] + np.arange(size)[None]
                new = np.where(np.arange(size)[None] < c[:, None], src[np.minimum(grid, len(src) - 1)], -1)
                pool = np.concatenate((np.where(graph[t] < n, graph[t], -1), new), 1)
                distinct = np.sort(pool, axis=1)
                many = ((distinct[:, 1:] != distinct[:, :-1]).sum(axis=1) + 1 - (distinct[:, 0] < 0)) > DEGREE
                for part in np.array_split(np.flatnonzero(many), max(1, many.sum() // _BATCH)):
                    if len(part):
                        graph[t[part]] = robust_prune(x, t[part], pool[part], alpha, DEGREE)
                for i in np.flatnonzero(~many):
                    u = np.unique(pool[i][pool[i] >= 0])
                    graph[t[i], : len(u)], graph[t[i], len(u) :] = u, n
    return graph, start


def usable(vector: str) -> Column:
    """Whether a vector takes part: all components there and finite, and not all zero."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0)


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.array(pdf["v"].tolist(), np.float64)
    graph, start = build_graph(Frame(x)(x))
    rep = pdf["rep"].to_numpy(np.int64)
    row = (pdf["shard"].iloc[0], 0, len(x), start, rep.tobytes(), x.tobytes(), graph.astype(np.int32).tobytes())
    return pd.DataFrame([row], columns=["shard", "turn", "n", "start", "keys", "x", "graph"])


def _search(k: int):
    """Best points of each block of queries in the shard whose index came before it."""

    def run(batches):
        at = None
        for pdf in batches:
            for shard, turn, n, start, keys, x, graph in pdf.itertuples(index=False):
                if turn == 0:
                    at, begin, reps, points = shard, int(start), np.frombuffer(keys, np.int64), np.frombuffer(x, np.float64).reshape(int(n), -1)
                    frame, edges = Frame(points), np.frombuffer(graph, np.int32).reshape(int(n) + 1, -1).astype(np.int64)
                    held = frame(points)
                    continue
                if shard != at:
                    continue  # no points in this shard
                q, keys = np.frombuffer(x, np.float64).reshape(-1, points.shape[1]), np.frombuffer(keys, np.int64)
                for lo in range(0, len(q), _BATCH):
                    part = q[lo : lo + _BATCH]
                    got = beam_search(held, edges, begin, frame(part), QUERY_WIDTH)[:, : 4 * k + 16]
                    near = np.maximum(got, 0)
                    d = euclidean(points[near], part)
                    d[got < 0] = np.inf
                    order = np.lexsort((reps[near], d))[:, : k + 1]
                    ok = np.take_along_axis(got, order, 1) >= 0
                    d, best = np.take_along_axis(d, order, 1), np.take_along_axis(reps[near], order, 1)
                    yield pd.DataFrame({"q": np.broadcast_to(keys[lo : lo + _BATCH, None], d.shape)[ok], "rep": best[ok], "score": d[ok]})

    return run


def euclidean(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of x (b, k, d) from q (b, d), in double precision."""
    gap = x - q[:, None]
    with np.errstate(over="ignore"):
        d = np.sqrt((gap**2).sum(-1))
    big = ~np.isfinite(d) | ((d < 1e-150) & (d > 0))  # squares beyond the range
    if big.any():
        top = np.abs(gap[big]).max(axis=-1, keepdims=True)
        d[big] = top[:, 0] * np.sqrt(((gap[big] / top) ** 2).sum(-1))
    return d


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row where ``is_query`` holds,
    an expression over the column ``id``; score is the Euclidean distance."""
    space = Workspace(vectors.sparkSession, "ann")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v0")).filter("id IS NOT NULL").filter(usable("v0"))
    rows = rows.select("id", F.col("v0").cast("array<double>").alias("v"))
    rows = space.save(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}).dropDuplicates(["id", "h1", "h2"]), "rows")
    # Of equal vectors only the k + 1 smallest ids can be among anyone's nearest.
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    ranked = rows.select("id", "h1", "h2").withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    members = space.save(ranked.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "members")
    points = rows.join(members.select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"]).select("id", "v")
    total = members.count()
    shards = max(1, -(-total // SHARD_POINTS))
    keyed = points.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), F.size("v").alias("dim"), F.col("id").alias("rep"), "v")
    keyed = keyed.withColumn("shard", F.concat_ws("-", "dim", "s")).repartition(shards, "shard")
    index = keyed.select("shard", "rep", "v").groupBy("shard").applyInPandas(_index, _ROW)
    index = space.save(index, "index")

    asking = rows.filter(is_query).select(F.col("id").alias("query_id"), "h1", "h2")
    askers = space.save(asking.join(members.select("h1", "h2", "rep"), ["h1", "h2"]).select("query_id", F.col("rep").alias("q")), "askers")
    distinct = askers.select(F.col("q").alias("id")).distinct()
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    asked = points.join(distinct, "id").select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).alias("block"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        row = (pdf["dim"].iloc[0], pdf["id"].to_numpy(np.int64).tobytes(), np.array(pdf["v"].tolist(), np.float64).tobytes())
        return pd.DataFrame([row], columns=["dim", "keys", "x"])

    packed = asked.groupBy("dim", "block").applyInPandas(pack, "dim int, keys binary, x binary")
    none = {"turn": F.lit(1), "n": F.lit(None).cast("int"), "start": F.lit(None).cast("int"), "graph": F.lit(None).cast("binary")}
    spread = packed.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.concat_ws("-", "dim", s)))).withColumns(none)
    dealt = index.unionByName(spread.select(*index.columns)).repartition(max(2, min(4 * shards, 20_000)), "shard").sortWithinPartitions("shard", "turn")
    found = space.save(dealt.mapInPandas(_search(k), "q long, rep long, score double"), "found")

    top = Window.partitionBy("q").orderBy("score", "rep")
    best = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
    each = best.join(askers, "q").join(members.select("rep", "ids"), "rep").select("query_id", F.explode("ids").alias("vec_id"), "score")
    each = each.filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
