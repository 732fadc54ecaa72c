"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions alone.

A text is cut into paragraphs: at line breaks, at the ends of sentences, and after every ``RUN_WORDS``
words of a long one, blanks around them cut away. Each different paragraph has a 64-bit digest. A sketch
is three rows of eight cells; a digest falls into one cell of each row, which counts it and holds the
exclusive or of the digests and of their check hashes. The fingerprint is the sketch as text, so equal
texts have equal ones and each has the same size.

To compare two versions, the cells of one are subtracted from those of the other: what both hold cancels
out. Cells that hold one digest (count 1 or -1, check hash right) give it away; it is taken out of its
other cells, which frees more, until all are empty. The recovered digests are exactly those that one
version has and the other hasn't, so likeness is shared / (shared + differing) paragraphs (Jaccard).
Where too many differ, peeling stops short, and the comparison is tried again with a sketch sixteen times
as large: digests are dealt to sixteen sketches by four of their bits, and only those that fail are enlarged again.
Two different digests part after sixteen such steps at most, so no pair is left undecided.

``edited_pairs`` puts beside each document its edited text and the next document. Texts cross the
network once: they are dealt to slices of consecutive ids (cut points from approximate percentiles, an id
that repeats much dealt further by the hash of its text), and the first row of each slice is copied to
the slice before it.

Edge cases: a null text is an empty one; a text without words has no paragraphs; two such texts have
likeness 1, one and another text 0. Null ids come first; rows of equal ids are ordered by the hash of their
text; rows equal in both stand next to each other and each is followed by its copy. The last row is followed
by the first (a lone row by itself). An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, WIDTH = 3, 8
CELLS = ROWS * WIDTH
#: Cells in a row of each of the sketches that replace one which could not be peeled.
PART_WIDTH = 4
#: Sketches that replace one which could not be peeled; four bits of a digest choose among them.
FANOUT, BITS = 16, 4
RUN_WORDS = 32
#: Sweeps over the cells of a sketch; one that needs more is tried again larger.
SWEEPS = 12
SLICE_BYTES = 64 << 20
MAX_SLICES = 1 << 16
#: An id that holds a whole slice is dealt to so many by the leading bits of its texts' hashes.
SUB_SLICES = 64


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.array_max(F.transform(F.array(value), body))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?:[^\s]+[ \t]*){{1,{RUN_WORDS}}}"), F.lit(0))
    return F.transform(runs, lambda p: F.regexp_replace(p, r"[ \t]+$", ""))


def digests(text: Column) -> Column:
    """The different digests of a text's paragraphs, sorted."""
    return F.array_sort(F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _entry(n: Column, key: Column, level: Column, width: int) -> Column:
    """A digest with its sign, its check and a bit for each of its cells, one in each row; other cells at
    each level."""

    def bits(h: Column) -> Column:
        cell = lambda r: F.call_function("shiftleft", F.lit(1), (F.call_function("shiftright", h, F.lit(16 * r)).bitwiseAND(F.lit(width - 1)) + r * width).cast("int"))
        return F.struct(n.alias("n"), key.alias("k"), _check(key).alias("c"), cell(0).bitwiseOR(cell(1)).bitwiseOR(cell(2)).alias("m"))

    return bound(F.xxhash64(key, level), bits)


def _merged(cell: Column, entries: Column, i: Column, sign: int) -> Column:
    """A cell with the entries that fall into it added (1) or taken away (-1)."""
    step = lambda s, e: F.struct((s["n"] + e["n"] * sign).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"), s["c"].bitwiseXOR(e["c"]).alias("c"))
    return F.aggregate(F.filter(entries, lambda e: F.getbit(e["m"], i) == F.lit(1).cast("tinyint")), cell, step)


def sketch(keys: Column, level: Column | None = None, width: int = WIDTH) -> Column:
    """The cells of a set of digests, ``width`` in each row."""
    level = F.lit(0) if level is None else level
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c"))
    entries = F.transform(keys, lambda k: _entry(F.lit(1), k, level, width))
    return bound(entries, lambda held: F.transform(F.sequence(F.lit(0), F.lit(ROWS * width - 1)), lambda i: _merged(zero, held, i, 1)))


def subtract(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c")))


def serialise(cells: Column) -> Column:
    """A sketch as text: counts, digests and checks of its cells as hex digits, packed."""
    digits = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 6, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["c"]), 16, "0")))
    return F.translate(F.base64(F.unhex(F.array_join(digits, ""))), "\r\n", "")


def peel(cells: Column, level: Column, width: int = WIDTH) -> Column:
    """(ok, d): whether the difference of two sketches could be emptied, and how many digests came out."""

    def remove(state: Column, pure: Column) -> Column:
        after = F.transform(state["cells"], lambda c, i: _merged(c, pure, i, -1))
        return F.when(F.size(pure) == 0, F.struct(state["cells"], state["d"], F.lit(False).alias("live"))).otherwise(F.struct(after.alias("cells"), (state["d"] + F.size(pure)).alias("d"), F.lit(True).alias("live")))

    def sweep(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: F.when((c["n"] == 1) | (c["n"] == -1), _check(c["k"]) == c["c"]).otherwise(False))
        once = lambda found: F.filter(found, lambda c, i: F.array_position(found["k"], c["k"]) == i + 1)
        pure = F.transform(bound(single, once), lambda c: _entry(c["n"], c["k"], level, width))
        return F.when(~state["live"], state).otherwise(bound(pure, lambda p: remove(state, p)))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("d"), F.lit(True).alias("live"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(SWEEPS)), start, sweep)
    empty = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))
    return bound(done, lambda s: F.struct(empty(s).alias("ok"), s["d"].alias("d")))


def _deal(node: Column, level: Column) -> Column:
    """The digests of two versions dealt by ``BITS`` of their bits; pairs without any are left out."""
    number = lambda keys: F.transform(keys, lambda k: F.struct(F.call_function("shiftright", k, level * BITS).bitwiseAND(F.lit(FANOUT - 1)).alias("i"), k.alias("k")))
    of = lambda keys, i: F.transform(F.filter(keys, lambda x: x["i"] == i), lambda x: x["k"])
    held = F.struct(number(node["a"]).alias("a"), number(node["b"]).alias("b"))
    dealt = bound(held, lambda h: F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda i: F.struct(of(h["a"], i).alias("a"), of(h["b"], i).alias("b"))))
    return F.filter(dealt, lambda x: (F.size(x["a"]) > 0) | (F.size(x["b"]) > 0))


def differing(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """How many digests only one of two versions has, peeled from the difference of their sketches;
    ``cells_a`` and ``cells_b`` are those of the fingerprints."""

    def enlarge(state: Column, level: Column) -> Column:
        def tried(node: Column) -> Column:
            gone = peel(subtract(sketch(node["a"], level, PART_WIDTH), sketch(node["b"], level, PART_WIDTH)), level, PART_WIDTH)
            return F.struct(gone.alias("r"), node.alias("node"))

        def after(results: Column) -> Column:
            left = F.flatten(F.transform(F.filter(results, lambda x: ~x["r"]["ok"]), lambda x: _deal(x["node"], level)))
            more = F.aggregate(F.filter(results, lambda x: x["r"]["ok"]), F.lit(0), lambda n, x: n + x["r"]["d"])
            return F.struct(left.alias("nodes"), (state["d"] + more).alias("d"))

        return F.when(F.size(state["nodes"]) == 0, state).otherwise(bound(F.transform(state["nodes"], tried), after))

    first = F.array(F.struct(a.alias("a"), b.alias("b")))
    start = F.struct(_deal(first[0], F.lit(0)).alias("nodes"), F.lit(0).alias("d"))
    retried = F.aggregate(F.sequence(F.lit(1), F.lit(64 // BITS)), start, enlarge)["d"]
    return bound(peel(subtract(cells_a, cells_b), F.lit(0)), lambda r: F.when(r["ok"], r["d"]).otherwise(retried))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Shared paragraphs among all of two versions, from 0 to 1; 1 where neither has any."""
    both = F.size(a) + F.size(b)
    return bound(differing(a, b, cells_a, cells_b), lambda d: F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d)))


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _slice(ident: Column, text_hash: Column, cuts: list[int], heavy: list[int]) -> Column:
    """The number of the slice of a row; slices ascend with (id, hash of the text)."""
    bits = max(1, len(cuts).bit_length())
    table = _numbers(cuts + [2**63 - 1] * (2**bits - 1 - len(cuts)))

    def half(low: Column, i: Column) -> Column:
        step = F.call_function("shiftright", F.lit(2**bits), i)
        return F.when(F.get(table, low + step - 1) < ident, low + step).otherwise(low)

    place = F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.lit(0), half).cast("bigint")
    sub = F.shiftright(text_hash, 64 - SUB_SLICES.bit_length() + 1) + SUB_SLICES // 2
    alone = F.array_contains(_numbers(heavy), ident) if heavy else F.lit(False)
    return F.when(ident.isNull(), sub - SUB_SLICES).when(alone, (2 * place + 1) * SUB_SLICES + sub).otherwise(2 * place * SUB_SLICES)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next): each document beside the text of the one that follows it by ascending id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = min(MAX_SLICES, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // SLICE_BYTES))
    at = [i / count for i in range(1, count)]
    cuts = rows.agg(F.percentile_approx("id", at, 10 * count)).first()[0] or []
    heavy = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("slice", _slice(F.col("id"), F.col("h"), sorted(set(cuts)), heavy))
    first = rows.groupBy("slice").agg(F.min(F.struct(F.col("id").isNotNull().alias("held"), "id", "h")).alias("m")).orderBy("slice").collect()
    before = [(r["m"]["id"], r["m"]["h"], first[i - 1]["slice"]) for i, r in enumerate(first)]  # one for each slice
    firsts = F.broadcast(spark.createDataFrame(before, "f_id long, f_h long, f_slice long"))
    rows = rows.join(firsts, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    own, copy = F.struct(F.col("slice").alias("s"), F.lit(0).alias("late")), F.struct(F.col("f_slice").alias("s"), F.lit(1).alias("late"))
    dealt = rows.select("id", "h", "text", F.explode(F.when(F.col("f_slice").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to"))
    dealt = dealt.select("id", "h", "text", F.col("to.s").alias("slice"), F.col("to.late").alias("late"))
    order = Window.partitionBy("slice").orderBy("late", F.col("id").asc_nulls_first(), "h")
    return dealt.withColumn("next", F.lead("text").over(order)).filter("late = 0").select("id", "text", "next")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, next): the last half of each text is replaced by the beginning of the next one."""
    pairs = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half)))


def compare_versions(pairs: DataFrame, text: str, others: dict[str, str]) -> DataFrame:
    """``pairs`` with fp_<text>, and for each further text column a fingerprint fp_<column> and, under the
    name given, its likeness to the first one. The generator keeps digests and cells computed once."""
    named = [text, *others]
    keys = F.struct(*(digests(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in named))
    rest = [c for c in pairs.columns if c not in ("__keys", "__cells")]
    held = pairs.select(*rest, F.explode(F.array(keys)).alias("__keys"))
    cells = F.struct(*(sketch(F.col(f"__keys.{c}")).alias(c) for c in named))
    held = held.select(*rest, "__keys", F.explode(F.array(cells)).alias("__cells"))
    of = lambda c: (F.col(f"__keys.{c}"), F.col(f"__cells.{c}"))
    (a, cells_a) = of(text)
    likes = [likeness(a, of(c)[0], cells_a, of(c)[1]).alias(name) for c, name in others.items()]
    return held.select(*rest, *(serialise(F.col(f"__cells.{c}")).alias(f"fp_{c}") for c in named), *likes)
