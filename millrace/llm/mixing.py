"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source that has n of N documents and the share w of the target is repeated at the mean rate
w * N / n. Each document draws its number of copies from a Poisson distribution of that mean by
inversion: a uniform number from a hash of the seed and its id is compared with the cumulative
probabilities of its source. A rate above ``PIECE`` is drawn as the sum of independent numbers of
equal means, each from a hash of its own, which is Poisson too. Copies are exploded and dealt
globally by a hash of seed, id and copy, within whose partitions they are sorted: a shuffle that can
be repeated exactly. Where a rate is high, a document's chunks of copies are dealt before they are exploded.

The table of rates has a row for each source; it is broadcast while that is at most
``BROADCAST_SOURCES`` rows and joined by shuffle beyond.

Edge cases: a null source is a source of its own; sources without a weight, or of weight 0, get no
copies; rows with equal ids draw equal numbers; a null id draws like an empty one; an empty table
gives an empty result. Columns named copy or mix_key are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Workspace, unused

SEED = "mix-1"
BROADCAST_SOURCES = 20_000
#: The largest mean drawn at one time: the table of rates stays small and exp() does not underflow.
PIECE = 64
#: Copies of a document that one task makes at a time.
CHUNK_COPIES = 1000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from an MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities for 0, 1, ... copies, far enough that the rest does not matter."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(held, k):
        p = held["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (held["c"] + p).alias("c"), F.array_append(held["all"], held["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["all"]


def rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None) -> DataFrame:
    """(src, rate, pieces, cdf) of each source; without ``weights`` every source gets an equal share."""
    counts = docs.groupBy(F.col(source_col).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        pairs = [F.struct(F.lit(k).cast(docs.schema[source_col].dataType).alias("k"), F.lit(float(v)).alias("v")) for k, v in weights.items()]
        found = F.filter(F.array(*pairs), lambda p: p["k"].eqNullSafe(F.col("src")))
        weighted = counts.withColumn("w", F.coalesce(F.get(found, F.lit(0))["v"], F.lit(0.0))) if pairs else counts.withColumn("w", F.lit(0.0))
    total = weighted.agg(F.sum("n").alias("total"), F.sum("w").alias("all_w"))
    rated = weighted.crossJoin(F.broadcast(total))  # one row
    rated = rated.filter("w > 0").withColumn("rate", F.col("w") / F.col("all_w") * F.col("total") / F.col("n"))
    rated = rated.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    return rated.select("src", "rate", "pieces", poisson_cdf(F.col("rate") / F.col("pieces")).alias("cdf"))


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with copy (from 1) and mix_key, shuffled."""
    space = Workspace(docs.sparkSession, "mix")
    table = space.save(rates(docs, source_col, weights), "rates")
    sources, highest = table.agg(F.count("*"), F.max("rate")).first()
    table = F.broadcast(table) if sources <= BROADCAST_SOURCES else table
    names = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    src, rate, draws, times, chunk = unused(docs, "src", "rate", "draws", "times", "chunk")
    table = table.select(F.col("src").alias(src), F.struct("pieces", "cdf").alias(rate))
    rows = docs.select(*names).join(table, F.col(source_col).eqNullSafe(F.col(src)))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    parts = F.transform(F.sequence(F.lit(1), F.col(rate)["pieces"]), lambda j: uniform(F.lit(seed), F.lit("piece"), ident, j.cast("string")))
    u = F.when(F.col(rate)["pieces"] == 1, F.array(uniform(F.lit(seed), ident))).otherwise(parts)
    count = F.aggregate(draws, F.lit(0), lambda n, x: n + F.size(F.filter(F.col(rate)["cdf"], lambda c: c <= x)))
    rows = rows.withColumn(draws, u).withColumn(times, count).filter(F.col(times) > 0).select(*names, times)
    place = lambda word, number: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(word), ident, number.cast("string"))), 1, 13), 16, 10).cast("long")
    first, last = F.lit(1), F.col(times)
    if (highest or 0) > CHUNK_COPIES:
        rows = rows.withColumn(chunk, F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / CHUNK_COPIES).cast("int"))))
        rows = rows.repartition(place("chunk", F.col(chunk)))
        first = F.col(chunk) * CHUNK_COPIES + 1
        last = F.least(F.col(times), first + (CHUNK_COPIES - 1))
    copies = rows.select(*names, F.explode(F.sequence(first, last)).alias("copy"))
    return copies.withColumn("mix_key", place("order", F.col("copy"))).repartition("mix_key").sortWithinPartitions("mix_key", id_col, "copy")
