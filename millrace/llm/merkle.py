"""A Merkle manifest of a dataset, with proofs from the preimages of each leaf's ancestors.

Each row is a leaf, the hash of its fields. In each group (the language) leaves stand by ascending id;
every eight consecutive nodes become one, the hash of their concatenated hashes, until one is left, and
the groups' roots become the root in the same way. A node is stored with its preimage, those concatenated
hashes of 64 characters each. Coming down from the root, each level is joined to the preimages of its
parents, so that a leaf ends with the preimages of all its ancestors. Cutting its own 64 characters out
of one leaves its siblings; putting a recomputed hash in their place and hashing that is one step of folding.

Places of leaves come from a sort by (group, id) over all tasks: a place is the number inside a task's run
of the group plus what earlier tasks hold of it, so no group has to fit one task. Texts are hashed where they
are read and never shuffled. From the first level on, rows are nodes of eight children; each level is a
written table an eighth as long as the one below, and a tree of n leaves has log8(n) of them.

Edge cases: a null field is hashed as ``-``, apart from an empty one; null ids stand first; rows of
equal ids are ordered by their hashes, so rows equal in all fields may change places without changing any
hash; a group of one leaf has that leaf as its root, and a proof without siblings is the hash of nothing;
rows without an id are not tampered with. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Workspace

FANOUT, BITS = 8, 3
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else its length in bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def places(rows: DataFrame, group: str, order: list[str], space: Workspace, label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with place, from 0 in each group by ``order``; and (group, total)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    held = space.save(held.withColumn("__at", F.monotonically_increasing_id()), label)
    held = held.withColumn("__task", F.shiftright("__at", 33))  # the upper bits of that number are the task's
    runs = held.groupBy(group, "__task").agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    runs = space.save(runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), f"{label}-runs")
    begin = runs.select(F.col(group).alias("__g"), F.col("__task").alias("__t"), "__from", "__before")
    placed = held.join(begin, (F.col("__task") == F.col("__t")) & F.col(group).eqNullSafe(F.col("__g")))
    place = (F.col("__before") + F.col("__at") - F.col("__from")).alias("place")
    return placed.select(*rows.columns, place), runs.groupBy(group).agg(F.sum("__n").alias("total"))


def _parents(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """(g, place, hash, preimage, kids) of the nodes above: ``nodes`` has g, place, hash and ``keep``. A group
    that has one node left keeps it, with a null preimage. ``kids`` holds what ``keep`` names."""
    slot = F.pmod("place", F.lit(FANOUT)).cast("int").alias("slot")
    kids = nodes.groupBy("g", F.floor(F.col("place") / FANOUT).alias("place")).agg(F.sort_array(F.collect_list(F.struct(slot, "hash", *keep))).alias("kids"))
    single = (F.col("place") == 0) & (F.size("kids") == 1)  # the only node of its level: a last run of one has others before it
    joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
    above = kids.withColumn("preimage", F.when(~single, joined))
    above = above.withColumn("hash", F.coalesce(F.sha2("preimage", 256), F.col("kids")[0]["hash"]))
    return above.select("g", "place", "hash", "preimage", *(["kids"] if keep else []))


def build(nodes: DataFrame, height: int, keep: list[str], space: Workspace, label: str) -> list[DataFrame]:
    """The levels above ``nodes`` (g, place, hash and ``keep``), each a written table, up to one node a group.
    The first of them keeps its children."""
    levels = []
    for k in range(height):
        nodes = space.save(_parents(nodes, keep if k == 0 else []), f"{label}-{k + 1}")
        levels.append(nodes)
        nodes = nodes.select("g", "place", "hash")
    return levels


def height(most: int) -> int:
    """Levels above ``most`` nodes, at least one."""
    n = 1
    while most > FANOUT**n:
        n += 1
    return n


def _down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first of ``levels`` with chain, the preimages of its nodes' ancestors from the nearest up (its own
    first), after what ``top`` (g, chain and more, a row for each group) holds."""
    more = [c for c in top.columns if c not in ("g", "chain")]
    held = levels[-1].join(top.withColumnRenamed("g", "__g"), F.col("g").eqNullSafe(F.col("__g"))).drop("__g")
    held = held.withColumn("chain", F.concat(F.array("preimage"), F.col("chain")))
    for level in reversed(levels[:-1]):
        above = held.select(F.col("g").alias("__g"), F.col("place").alias("__p"), F.col("chain").alias("__c"), *more)
        held = level.join(above, F.col("g").eqNullSafe(F.col("__g")) & (F.floor(F.col("place") / FANOUT) == F.col("__p")))
        held = held.withColumn("chain", F.concat(F.array("preimage"), F.col("__c"))).drop("__g", "__p", "__c")
    return held


def _steps(chain: Column, slots: Column) -> Column:
    """The preimages on a leaf's way with the slot that it has in each; levels that a lone node skips go."""
    return F.filter(F.zip_with(chain, slots, lambda p, s: F.struct(p.alias("p"), s.alias("s"))), lambda x: x["p"].isNotNull())


def siblings(steps: Column) -> Column:
    """The preimages without the own 64 characters, level by level."""
    cut = lambda x: F.concat(F.substring(x["p"], F.lit(1), x["s"] * HEX), F.substring(x["p"], x["s"] * HEX + HEX + 1, F.lit(HEX * FANOUT)))
    return F.array_join(F.transform(steps, cut), "")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to: put into the place it has in each preimage, and hashed."""
    return F.aggregate(steps, leaf, lambda h, x: F.sha2(F.overlay(x["p"], h, x["s"] * HEX + 1, F.lit(HEX)), 256))


def _slots(place: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.call_function("shiftright", place, (k * BITS).cast("int")).bitwiseAND(F.lit(FANOUT - 1)).cast("int"))


def manifest(rows: DataFrame, tampered: Column, group_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row. ``tampered`` is the leaf that
    a row turns out to have, null where it is the one of the manifest."""
    space = Workspace(rows.sparkSession, "merkle")
    leaves = rows.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), leaf_hash(*map(F.col, fields)).alias("hash"), tampered.alias("other"))
    leaves, totals = places(leaves, "g", ["id", "hash"], space, "leaves")
    groups, most = totals.agg(F.count("*"), F.max("total")).first()
    low = build(leaves, height(most or 1), ["id", "other"], space, "low")
    roots = low[-1].select(F.lit(0).alias("__all"), "g", F.col("hash"))
    roots, _ = places(roots, "__all", ["g"], space, "roots")
    roots = roots.select(F.col("__all").alias("g"), "place", "hash", F.col("g").alias("name"))
    high = build(roots, height(groups), ["name"], space, "high")
    root = high[-1].select("g", F.col("hash").alias("root"), F.array().cast("array<string>").alias("chain"))
    of_groups = _down(high, root).select("root", "chain", F.posexplode("kids").alias("__i", "kid"), (F.col("place") * FANOUT).alias("__first"))
    of_groups = of_groups.select(F.col("kid.name").alias("g"), F.col("kid.hash").alias("subroot"), "root", "chain", (F.col("__first") + F.col("__i")).alias("group_place"))
    nodes = _down(low, space.save(of_groups, "groups"))
    out = nodes.select(F.explode("kids").alias("kid"), "place", "subroot", "root", "group_place", "chain")
    slots = F.concat(_slots(F.col("place") * FANOUT + F.col("kid.slot"), len(low)), _slots(F.col("group_place"), len(high)))
    out = out.select("kid.id", F.col("kid.hash").alias("leaf"), "kid.other", "subroot", "root", _steps(F.col("chain"), slots).alias("steps"))
    out = out.withColumns({"proof_sha256": F.sha2(siblings(F.col("steps")), 256), "folded_root": fold(F.coalesce("other", "leaf"), F.col("steps"))})
    return out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
