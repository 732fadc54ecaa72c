"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector (for words frequent in the training texts) beside the sum of hashed
vectors of its character n-grams. Gated recurrent units read each window of ``WINDOW`` words both
ways, attention pools their states, and a logistic unit scores the window. All windows of a text,
one every ``STRIDE`` words, are scored, so a passage of up to ``WINDOW - STRIDE + 1`` words lies whole in
one of them, and the text's score is its worst window's. The fit takes
labels of whole texts: windows share the loss of their text by a smooth maximum.

Edge cases: null and empty texts are one window without words; without training texts of both labels
every score is the share of label 1 (0 without any); repeated rows get equal scores; extra columns
are never read, and neither are labels, languages, sources or ids when scoring.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, first_by_hash

WINDOW, STRIDE = 64, 32
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 12, 12, 12, 8192
VOCABULARY, MIN_TEXTS = 3000, 5
#: The fit reads at most so many texts of each label, by a hash of their ids, among those of at most so
#: many characters.
MAX_TRAIN_PER_LABEL, MAX_TRAIN_CHARS = 1000, 8000
STEPS, BATCH_TEXTS, RATE = 260, 24, 0.01
#: Share of a batch's distinct words that are blanked at first (falling to none at the end, so that
#: small samples aren't learnt by heart), and decay of the input vectors in each step.
BLANKED, DECAY = 0.6, 0.003
SEED = 5
_WORD = re.compile(r"\w+")
_KEEP = np.float32(30.0)  # an update gate held shut: what padding sends


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' character 3- and 4-grams with marked ends, and each one's word."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(m) for m in marked])
    starts, owners, out = np.cumsum(lengths) - lengths, [], []
    for n in (3, 4):
        total = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for j in range(n):
            total = (total ^ codes[j : j + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        count = np.maximum(lengths - n + 1, 0)
        who = np.repeat(np.arange(len(words)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[who]
        out.append((total[at] >> np.uint64(20)) % np.uint64(CHAR_BUCKETS))
        owners.append(who)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out)[order].astype(np.int64), owner[order]


def windows_of(count: int) -> list[int]:
    """Where the windows of a text of ``count`` words begin."""
    return list(range(0, max(1, count - (WINDOW - STRIDE)), STRIDE))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """The parameters, the forward pass and its gradient. Arrays have the two directions first."""

    def __init__(self, vocabulary: list[str], rng: np.random.Generator):
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {
            "word": draw(0.1, len(vocabulary) + 1, WORD_DIM), "char": draw(0.1, CHAR_BUCKETS, CHAR_DIM),
            "wx": draw(d**-0.5, 2, d, 3 * h), "b": np.zeros((2, 1, 3 * h), np.float32), "u": draw(h**-0.5, 2, h, 3 * h),
            "wa": draw((2 * h) ** -0.5, 2 * h, h), "va": draw(h**-0.5, h), "wo": draw((2 * h) ** -0.5, 2 * h), "bo": np.full(1, -3.0, np.float32),
        }

    def inputs(self, words: list[str]):
        """Input vectors of distinct words, and what their gradient needs."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        buckets, owner = gram_buckets(words)
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        scale = (1 / np.sqrt(np.diff(np.concatenate((begin, [len(owner)]))))).astype(np.float32)
        chars = np.add.reduceat(self.p["char"][buckets], begin, axis=0) * scale[:, None]
        word = self.p["word"][ids]
        word[ids == 0] = 0
        return np.concatenate((word, chars), 1), (ids, buckets, owner, scale)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(2, words + 1, 3 h) pre-activations; the last row is padding, which keeps a state as it is."""
        pre = np.matmul(x[None], self.p["wx"]) + self.p["b"]
        pad = np.zeros((2, 1, pre.shape[2]), np.float32)
        pad[:, :, :HIDDEN] = _KEEP
        return np.concatenate((pre, pad), 1)

    def forward(self, pre: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` (N, T) of rows of ``pre``; the last row marks padding."""
        n, t, h = at.shape[0], at.shape[1], HIDDEN
        u, held, state = self.p["u"], [], np.zeros((2, n, h), np.float32)
        states = np.empty((2, t, n, h), np.float32)
        for i in range(t):
            j = t - 1 - i
            x = np.stack((pre[0][at[:, i]], pre[1][at[:, j]]))
            r = np.matmul(state, u)
            z = _sigmoid(x[..., :h] + r[..., :h])
            g = _sigmoid(x[..., h : 2 * h] + r[..., h : 2 * h])
            c = np.tanh(x[..., 2 * h :] + g * r[..., 2 * h :])
            if keep:
                held.append((state, z, g, c, r[..., 2 * h :]))
            state = c + z * (state - c)
            states[0, i], states[1, j] = state
        both = np.concatenate((states[0], states[1]), 2)
        a = np.tanh(both @ self.p["wa"])
        score = a @ self.p["va"]
        score = np.where((at == pre.shape[1] - 1).T, np.float32(-1e9), score)
        e = np.exp(score - score.max(axis=0))
        e[score < -1e8] = 0
        weight = e / np.maximum(e.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tn,tnk->nk", weight, both)
        logits = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logits, (held, both, a, weight, pooled)) if keep else logits

    def backward(self, pre, at, kept, d_logits, x, shown, how) -> dict[str, np.ndarray]:
        held, both, a, weight, pooled = kept
        n, t, h = at.shape[0], at.shape[1], HIDDEN
        p, g = self.p, {"bo": np.array([d_logits.sum()], np.float32), "wo": pooled.T @ d_logits}
        d_pooled = d_logits[:, None] * p["wo"][None]
        d_both = weight[..., None] * d_pooled[None]
        d_weight = np.einsum("tnk,nk->tn", both, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.einsum("tn,tnk->k", d_score, a)
        d_a = d_score[..., None] * p["va"] * (1 - a * a)
        g["wa"] = np.einsum("tnk,tnj->kj", both, d_a)
        d_both += d_a @ p["wa"].T
        d_states = np.stack((d_both[..., :h], d_both[..., h:]))
        d_pre, g["u"], d_state = np.zeros_like(pre), np.zeros_like(p["u"]), np.zeros((2, n, h), np.float32)
        for i in reversed(range(t)):
            j = t - 1 - i
            state, z, r, c, rc = held[i]
            d = d_state + np.stack((d_states[0, i], d_states[1, j]))
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (state - c) * z * (1 - z)
            d_r = d_c * rc * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_c), 2)
            d_rec = np.concatenate((d_z, d_r, d_c * r), 2)
            g["u"] += np.matmul(state.transpose(0, 2, 1), d_rec)
            d_state = d * z + np.matmul(d_rec, p["u"].transpose(0, 2, 1))
            for side, place in ((0, i), (1, j)):
                for col in range(3 * h):
                    d_pre[side, :, col] += np.bincount(at[:, place], d_x[side, :, col], pre.shape[1])
        d_pre = d_pre[:, :-1]
        g["b"] = d_pre.sum(axis=1, keepdims=True)
        g["wx"] = np.matmul(x.T[None], d_pre)
        d_in = np.matmul(d_pre, p["wx"].transpose(0, 2, 1)).sum(axis=0) * shown
        ids, buckets, owner, scale = how
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], ids, d_in[:, :WORD_DIM])
        g["word"][0] = 0
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], buckets, (d_in[:, WORD_DIM:] * scale[:, None])[owner])
        return g


def _window_rows(ids: np.ndarray, pad: int) -> np.ndarray:
    begins = windows_of(len(ids))
    out = np.full((len(begins), WINDOW), pad, np.int64)
    for row, b in zip(out, begins, strict=True):
        part = ids[b : b + WINDOW]
        row[: len(part)] = part
    return out


def train(texts: list[str | None], labels: list[int], steps: int = STEPS) -> Network | float:
    """The network, or the share of label 1 where there are no texts of both labels."""
    words = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    groups = [np.flatnonzero(y == v) for v in (0, 1)]
    if not all(map(len, groups)):
        return float(y.mean()) if len(y) else 0.0
    seen = Counter(w for ws in words for w in set(ws))
    common = sorted((w for w, c in seen.items() if c >= MIN_TEXTS), key=lambda w: (-seen[w], w))[:VOCABULARY]
    rng = np.random.Generator(np.random.PCG64(SEED))
    net = Network(common, rng)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    queues = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for step in range(1, steps + 1):
        chosen = []
        for v in (0, 1):
            while len(queues[v]) < BATCH_TEXTS // 2:
                queues[v] = np.concatenate((queues[v], rng.permutation(groups[v])))
            chosen += queues[v][: BATCH_TEXTS // 2].tolist()
            queues[v] = queues[v][BATCH_TEXTS // 2 :]
        distinct = sorted({w for i in chosen for w in words[i]}) or ["_"]
        number = {w: k for k, w in enumerate(distinct)}
        rows = [_window_rows(np.array([number[w] for w in words[i]], np.int64), len(distinct)) for i in chosen]
        owner = np.repeat(np.arange(len(chosen)), [len(r) for r in rows])
        at = np.concatenate(rows)
        x, how = net.inputs(distinct)
        shown = (rng.random((len(x), 1)) >= BLANKED * (1 - step / steps)).astype(np.float32)
        x *= shown
        pre = net.project(x)
        logits, kept = net.forward(pre, at, keep=True)
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        top = np.maximum.reduceat(logits, begin)
        e = np.exp(logits - top[owner])
        total = np.add.reduceat(e, begin)
        whole = top + np.log(total)  # the smooth maximum of a text's windows
        d = (_sigmoid(whole) - y[chosen]) / len(chosen)
        grads = net.backward(pre, at, kept, (d[owner] * e / total[owner]).astype(np.float32), x, shown, how)
        norm = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in grads.items():
            v *= clip
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            if k in ("word", "char"):
                net.p[k] *= np.float32(1 - DECAY)
    return net


class _Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores whole texts, with the projected input of each distinct word kept."""

    limit, block = 150_000, 1024

    def __init__(self, net: Network):
        self.net, self.words, self.pre = net, _Words(), np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        rows: list[np.ndarray] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            ids = self._numbers(words_of(text))
            part = _window_rows(ids, -1)
            rows.append(part)
            owners += [i] * len(part)
            held += len(part)
            if held >= 4 * self.block or len(self.words) > self.limit:
                self._run(np.concatenate(rows), np.array(owners), out)
                rows, owners, held = [], [], 0
                if len(self.words) > self.limit:
                    self.words, self.pre = _Words(), self.pre[:, :0]
        if rows:
            self._run(np.concatenate(rows), np.array(owners), out)
        return 1 / (1 + np.exp(-out))

    def _run(self, at: np.ndarray, owners: np.ndarray, out: np.ndarray) -> None:
        new = list(self.words)[self.pre.shape[1] :]
        if new:
            self.pre = np.concatenate((self.pre, self.net.project(self.net.inputs(new)[0])[:, :-1]), 1)
        pad = self.net.project(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))
        pre = np.concatenate((self.pre, pad), 1)
        at = np.where(at < 0, pre.shape[1] - 1, at)
        for lo in range(0, len(at), self.block):
            part = at[lo : lo + self.block]
            used = int((part != pre.shape[1] - 1).any(axis=0).sum())  # short windows need fewer steps
            np.maximum.at(out, owners[lo : lo + self.block], self.net.forward(pre, part[:, : max(1, used)]).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN_PER_LABEL) -> Network | float:
    """Train on at most ``most`` texts of each label among the ids where ``usable`` (over ``id``) holds.

    The ids are chosen from narrow rows, so only their texts are gathered: one for each id and label
    (the smallest where rows share an id), of bounded length.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).filter(usable)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).filter(F.length("t") <= MAX_TRAIN_CHARS)
    chosen = first_by_hash(ids.join(texts.select("id"), "id").distinct(), "y", "id", most, SEED)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("t").alias("t"))  # at most 2 * most rows
    held = sorted((r["id"], r["y"], r["t"]) for r in rows.toLocalIterator())
    return train([r[2] for r in held], [r[1] for r in held])


_SCORERS: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Network | float, text_col: str = "text") -> Column:
    """The score of each row's whole text, between 0 and 1."""
    if isinstance(model, float):
        return F.lit(model)
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scorer = _SCORERS.get(id(held.value))
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[id(held.value)] = Scorer(held.value)
        return pd.Series(scorer.score(texts.tolist()))

    return run(F.col(text_col))
