"""Rules whose next step depends on the outcome of the last: one sorted pass over narrow columns.

Keys are visitors, signatures, sessions or decks; ``segments`` streams each task's keys past one state, so
neither a key nor a task is held as a whole.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.segments import emitted, segmented
from millrace.session import bound_batches


def capped_counter(df: DataFrame, key: list[str], order: list[str], amount: str, cap: float, seconds: str | None = None, ttl: float | None = None) -> DataFrame:
    """Adds allowed and count: an increment that would pass the cap is refused and uses nothing up, and so is
    a null amount. With ``ttl`` a counter lives that long from its first increment on, by ``seconds``,
    and then begins again at 0; a row without a time is refused."""

    def start() -> list:
        return [0.0, None]

    def step(state: list, a: float | None, t: float | None = None) -> tuple:
        if ttl is not None and t is not None and (state[1] is None or t >= state[1]):
            state[0], state[1] = 0.0, t + ttl
        ok = a is not None and (ttl is None or t is not None) and state[0] + a <= cap
        state[0] += a if ok else 0.0
        return ok, state[0]

    return segmented(df, key, order, [amount] if ttl is None else [amount, seconds], start, step, "allowed boolean, count double")


def dedupe_alerts(df: DataFrame, key: list[str], order: list[str], seconds: str, within: float) -> DataFrame:
    """Adds repeat: whether a row falls within ``within`` seconds of the last row that did not. A row
    without a time is an alert of its own and no anchor."""

    def step(state: list, t: float | None) -> tuple:
        if t is None:
            return (False,)
        again = state[0] is not None and t - state[0] <= within
        state[0] = state[0] if again else t
        return (again,)

    return segmented(df, key, order, [seconds], lambda: [None], step, "repeat boolean")


def multi_window_admission(df: DataFrame, visitor: str, order: list[str], seconds: str, caps: dict[float, int]) -> DataFrame:
    """Adds allowed: within the caps of all windows (seconds of a window -> cap) at once; a refused
    request gives back what it took. A request without a time is refused. ``admission.admit`` has more keys."""

    def step(used: dict, t: float | None) -> tuple:
        if t is None or t != t:
            return (False,)
        slots = [(w, t // w) for w in caps]
        for w, s in slots:
            if used.get(w, (None, 0))[0] != s:
                used[w] = (s, 0)
        ok = all(used[w][1] < caps[w] for w, _ in slots)
        for w, s in slots if ok else ():
            used[w] = (s, used[w][1] + 1)
        return (ok,)

    return segmented(df, [visitor], order, [seconds], dict, step, "allowed boolean")


def resolve_duplicates(df: DataFrame, key: list[str], order: list[str], label: str, alike: str) -> DataFrame:
    """Adds resolved: a frame whose page looks like others (``alike``: the pages of its group, itself
    included) takes the one nearest to half a page ahead of the last page told, ties to the lower page; the first
    one nearest to itself. Frames without a page (null or negative) stay so and are passed over."""

    def step(state: list, page: int | None, group: list[int] | None) -> tuple:
        if page is None or page < 0:
            return (page,)
        if group and len(group) > 1:
            ahead = (state[0] if state[0] >= 0 else page) + 0.5
            page = min(group, key=lambda g: (abs(g - ahead), g))
        state[0] = page
        return (page,)

    return segmented(df, key, order, [label, alike], lambda: [-1], step, "resolved int")


def mark_spans(df: DataFrame, key: list[str], order: list[str], seconds: str, opens: str, closes: str, most: float) -> DataFrame:
    """Adds inside: whether a row stands in a span from a row that ``opens`` one up to the next that ``closes`` it,
    both included, or until ``most`` seconds after its begin; the row that finds a span too old opens none."""

    def step(state: list, t: float | None, starts: bool | None, ends: bool | None) -> tuple:
        if t is None:
            return (False,)
        if state[0] is None:
            state[0] = t if starts else None
            return (bool(starts),)
        if t - state[0] > most:
            state[0] = None
            return (False,)
        state[0] = None if ends else state[0]
        return (True,)

    return segmented(df, key, order, [seconds, opens, closes], lambda: [None], step, "inside boolean")


def monotone_path(scores: np.ndarray, skip_cost: float = 0.0) -> list[int]:
    """The page of each chunk on the best path that never goes back, by dynamic programming."""
    n, m = scores.shape
    if not n or not m:
        return []
    best, came = np.full((n, m), -np.inf), np.zeros((n, m), np.int64)
    best[0] = scores[0] - skip_cost * np.arange(m)
    for i in range(1, n):
        # Coming from page k costs skip_cost for each page beyond the next one.
        lifted = best[i - 1] + skip_cost * np.arange(m)
        top, at = np.maximum.accumulate(lifted), np.zeros(m, np.int64)
        for j in range(1, m):
            at[j] = j if lifted[j] > lifted[at[j - 1]] else at[j - 1]
        best[i], came[i] = scores[i] + top - skip_cost * np.arange(m), at
    path = [int(best[-1].argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(came[i, path[-1]]))
    return path[::-1]


def align_monotone(scores: DataFrame, session: str, chunk: str, page: str, score: str, skip_cost: float = 0.0) -> DataFrame:
    """(session, chunk, page): the best monotone alignment of each session's chunks."""
    kind = scores.schema[session].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=chunk, columns=page, values=score, fill_value=0.0)
        path = monotone_path(wide.to_numpy(), skip_cost)
        return pd.DataFrame({session: [key[0]] * len(path), chunk: wide.index, page: [int(wide.columns[j]) for j in path]})

    return scores.groupBy(session).applyInPandas(run, f"`{session}` {kind}, `{chunk}` int, `{page}` int")


def merge_cues(df: DataFrame, key: list[str], start: str, end: str, text: str, gap: float = 1.5, most: int = 200) -> DataFrame:
    """Neighbouring cues joined while the pause is short and the text has room; a null text is an empty one."""

    def step(state: list, s: float, e: float, t: str | None) -> list[tuple]:
        t = t or ""
        if state and s - state[1] <= gap and len(state[2]) + 1 + len(t) <= most:
            state[1], state[2] = max(state[1], e), f"{state[2]} {t}"
            return []
        done = [tuple(state)] if state else []
        state[:] = [s, e, t]
        return done

    times = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    return emitted(times, key, [start, end, text], [start, end, text], list, step, lambda state: [tuple(state)], f"`{start}` double, `{end}` double, `{text}` string")


#: Fixed values of spoken words: how far ahead one may be found, and what is cut from a word that is not found.
JUMP_CHARS, EDGES = 80, ".,;:!?\"'()[]"
#: Bytes that two compared texts may take for the rows of their table, and as many again for the places of their tokens.
TABLE_BYTES = 1 << 22
_TOKEN, _ROW = re.compile(r"\s+|\S+").findall, re.compile(r"[^\n]*\n|[^\n]+").findall


def word_places(df: DataFrame, key: list[str], order: list[str], text: str, seconds: str, word: str, jump: int = JUMP_CHARS) -> DataFrame:
    """(key, seconds, place): the places in a text where its spoken words stand, in order from a cursor on. A
    word that is not there, or further ahead than ``jump`` characters, is passed over, and times never go
    back. The first row of a key bears its ``text``; others may be null there, so that a text need not travel with
    each of its words."""
    bound_batches(df.sparkSession)

    def step(state: dict, first: str | None, t: float | None, said: str | None) -> list[tuple]:
        if "text" not in state:
            state.update(text=first or "", at=0, last=-1.0)
        said = (said or "").strip()
        if not said or t is None:
            return []
        place = state["text"].find(said, state["at"])
        if place < 0:
            core = said.strip(EDGES)
            place, said = state["text"].find(core, state["at"]) if core else -1, core or said
        if place < 0 or place - state["at"] > jump:
            return []
        state["at"], state["last"] = place + len(said), max(t, state["last"])
        return [(round(state["last"], 3), place)]

    return emitted(df, key, order, [text, seconds, word], dict, step, lambda _: [], "seconds double, place int")


def _bits(places: list[int], m: int) -> int:
    if len(places) < 3:
        return sum(1 << p for p in places)
    held = bytearray((m >> 3) + 1)
    for p in places:
        held[p >> 3] |= 1 << (p & 7)
    return int.from_bytes(held, "little")


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places in two lists of their longest common subsequence. Where there are several, the tokens of ``a`` are left
    out first that cost no match.

    Rows of the table of lengths are differences from place to place, one bit each, the last token of ``b`` lowest, and
    a row follows from the next one by an addition (Hyyrö 2004). Its carries tell at which places of ``b`` leaving
    out a token of ``a`` costs a match; such a token then meets its next place in ``b``. Only the rows at every so many
    tokens are kept, and those between are made again on the way, so memory grows with ``b`` times the root of ``a``.
    """
    m = len(b)
    where: dict[str, list[int]] = {t: [] for t in set(a).intersection(b)}
    for j, t in enumerate(reversed(b)):
        if t in where:
            where[t].append(j)
    rows = [i for i, t in enumerate(a) if t in where]
    masks: dict[str, int] = {}
    room, top, full = TABLE_BYTES // ((m >> 3) + 32), 1 << m + 64, (1 << m) - 1

    def mask(t: str) -> int:
        found = _bits(where[t], m)
        if len(masks) < room:
            masks[t] = found
        return found

    # What is carried past the last place does no harm there, so a row is cut only now and then.
    block = max(math.isqrt(len(rows)) + 1, room)
    blocks = [rows[k : k + block] for k in range(0, len(rows), block)]
    row, kept = full, []
    for of_block in blocks[:0:-1]:
        kept.append(row)
        for i in reversed(of_block):
            met = row & (masks.get(a[i]) or mask(a[i]))
            row = row + met | row ^ met
            if row > top:
                row &= full
    kept.append(row)
    found, j = [], 0
    for of_block in blocks:
        row, carries = kept.pop(), []
        for i in reversed(of_block):
            met = row & (masks.get(a[i]) or mask(a[i]))
            rest, total = row ^ met, row + met
            carries.append(rest ^ total)
            row = total | rest
            if row > top:
                row &= full
        for i in of_block:
            t, carried = a[i], carries.pop()
            if t != b[j]:
                if not carried >> m - j & 1:
                    continue
                j = b.index(t, j)
            found.append((i, j))
            j += 1
            if j == m:
                return found
    return found


def _runs(before: str, after: str, most: int | None = None) -> tuple[list[str], list[str]]:
    a, b = _TOKEN(before), _TOKEN(after)
    if most is not None and len(a) * len(b) > most:
        a, b = _ROW(before), _ROW(after)
    low, least = 0, min(len(a), len(b))
    while low < least and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < least - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[low : len(a) - tail], b[low : len(b) - tail]
    met = _common(x, y) if x and y and (most is None or len(x) * len(y) <= most) else []
    ops, texts = [], []
    # A run is what stands between two places of a text; a place past the end closes the last one.
    at, to = [0, *accumulate(map(len, a))], [0, *accumulate(map(len, b))]
    first, i, j = 0, low, low
    for p, q in [*met, (len(x), len(y))]:
        p, q = p + low, q + low
        if p != i or q != j:
            if i > first:
                ops.append("=")
                texts.append(before[at[first] : at[i]])
            if p > i:
                ops.append("-")
                texts.append(before[at[i] : at[p]])
            if q > j:
                ops.append("+")
                texts.append(after[to[j] : to[q]])
            first = p
        i, j = p + 1, q + 1
    if len(a) > first:
        ops.append("=")
        texts.append(before[at[first] :])
    return ops, texts


def diff_parts(before: str, after: str, most: int | None = None) -> list[tuple[str, str]]:
    """Runs of = (kept), - (removed) and + (added) text by words, removals before additions; the kept and added ones
    joined give ``after``. A caller may ask for a coarser answer: texts of more than ``most`` pairs of tokens are then
    compared line by line, and beyond that replaced as a whole."""
    return list(zip(*_runs(before, after, most), strict=True))


def parts_of(before: pa.Array, after: pa.Array) -> pa.Array:
    """``diff_parts`` of each pair of texts. A pair's parts go into Arrow before the next pair is compared, so there
    are never Python objects for the parts of a whole batch."""
    fields = [pa.field("op", pa.string()), pa.field("text", pa.string())]
    ends, parts = [0], [pa.StructArray.from_arrays([pa.array([], pa.string())] * 2, fields=fields)]
    for x, y in zip(before, after, strict=True):
        found = _runs(x.as_py() or "", y.as_py() or "")
        parts.append(pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in found], fields=fields))
        ends.append(ends[-1] + len(found[0]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))


def word_diff(before: Column, after: Column) -> Column:
    """``diff_parts`` of two columns, as an array of (op, text); a null text is an empty one."""
    bound_batches(SparkSession.active())

    @F.arrow_udf("array<struct<op:string,text:string>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return parts_of(a, b)

    return run(before, after)


def greedy_batches(df: DataFrame, key: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Adds batch: rows in order, a new batch where the next row would pass ``most``; a null size is 0."""

    def step(state: list, s: int | None) -> tuple:
        s = s or 0
        if state[1] and state[1] + s > most:
            state[:] = [state[0] + 1, 0]
        state[1] += s
        return (state[0],)

    return segmented(df, key, order, [size], lambda: [0, 0], step, "batch int")


#: Fixed values of read-along: letters of a word that lights alone, and how often it may stand on the slide.
LONE_LETTERS, LONE_REPEATS = 4, 3


def highlights(spoken: list[tuple[str, int]], shown: list[tuple[str, float]], letters: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(spoken word, first and last shown word) of the places that light up while a narration is read.

    ``spoken``: stems with their sentence; ``shown``: stems with their height on the slide. At each spoken
    word the longest run of equal stems within its sentence wins, then a place after the last one, then
    the topmost. A lone word must be long and rare enough, and a place lights once; words of a run
    don't fire again. Run lengths come from one table, filled from the ends.
    """
    n, m = len(spoken), len(shown)
    letters = letters or [len(s) for s, _ in spoken]
    run = np.zeros((n + 1, m + 1), np.int64)
    for i in range(n - 1, -1, -1):
        goes_on = i + 1 < n and spoken[i + 1][1] == spoken[i][1]
        for j in range(m - 1, -1, -1):
            if spoken[i][0] == shown[j][0]:
                run[i, j] = 1 + (run[i + 1, j + 1] if goes_on else 0)
    out: list[tuple[int, int, int]] = []
    lit: set[int] = set()
    i, last = 0, -1
    while i < n:
        places = np.flatnonzero(run[i, :m])
        step = 1
        if len(places):
            j = min(places.tolist(), key=lambda p: (-run[i, p], p <= last, round(shown[p][1] / 0.005), p))
            k = int(run[i, j])
            lone = k == 1 and (letters[i] < LONE_LETTERS or len(places) > LONE_REPEATS or j in lit)
            if not lone and not lit.issuperset(range(j, j + k)):
                out.append((i, j, j + k - 1))
                lit.update(range(j, j + k))
                last, step = j + k - 1, k
        i += step
    return out


def read_along(df: DataFrame, key: list[str], spoken: str, shown: str) -> DataFrame:
    """(key, place, first, last): ``highlights`` of texts read beside texts shown, by lower-case words;
    sentences end at stops, and a shown word's height is its line."""

    def run(batches):
        for pdf in batches:
            rows = []
            for keys, a, b in zip(pdf[key].itertuples(index=False, name=None), pdf[spoken], pdf[shown], strict=True):
                said = [(w, n) for n, s in enumerate(re.split(r"[.!?]+", (a or "").lower())) for w in re.findall(r"[a-z]{3,}", s)]
                seen = [(w, float(n)) for n, line in enumerate((b or "").lower().split("\n")) for w in re.findall(r"[a-z]{3,}", line)]
                rows += [(*keys, *h) for h in highlights(said, seen)]
            yield pd.DataFrame(rows, columns=[*key, "place", "first", "last"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return df.select(*key, spoken, shown).mapInPandas(run, f"{kinds}, place int, first int, last int")
