"""Admission under several quotas at once: visitors, addresses and pools, each in fixed windows.

A request takes its amount from a counter of each quota that applies to it, from all or from none: one that
some counter refuses gives back what it took. Whether a request passes therefore depends on earlier ones
of the same visitor, and those on others of the same address. Most counters can never refuse, though, since all
that was ever asked of them stays within the cap. The others bind; counters that bind and meet in a request are
linked, and the components of these links are decided one by one, each in order of time. Requests without a
binding counter pass without being ordered at all.

The pass over a component holds its counters of windows that are still open, however many requests it has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graphs import components
from millrace.operators.scratch import Scratch
from millrace.operators.segments import segmented


@dataclass(frozen=True)
class Quota:
    """At most ``cap`` a window of ``window`` seconds for each value of ``columns``; it does not apply
    where one of them is null. Without columns it is a pool for all."""

    columns: tuple[str, ...]
    window: float
    cap: float


def _counter(i: int, quota: Quota, seconds: str) -> Column:
    """(key, quota) of the counter that a request takes from, null where the quota does not apply."""
    slot = F.floor(F.col(seconds) / quota.window)
    key = F.concat_ws("\x1f", F.lit(str(i)), *(F.col(c).cast("string") for c in quota.columns), slot.cast("string"))
    there = F.lit(True)
    for c in quota.columns:
        there &= F.col(c).isNotNull()
    return F.when(there, F.struct(key.alias("key"), F.lit(i).alias("quota")))


def admit(df: DataFrame, ident: str, order: list[str], seconds: str, quotas: list[Quota], amount: str | None = None, name: str = "allowed") -> DataFrame:
    """``df`` with ``name``: whether the request passes all ``quotas``. ``ident`` tells rows apart; ``order``
    begins with the time in seconds and has no ties. A request without a time or an amount (null
    or not a number) is refused and takes nothing; so is one with a negative amount.
    """
    scratch = Scratch(df.sparkSession, "admission")
    size = F.col(amount).cast("double") if amount else F.lit(1.0)
    sound = F.col(seconds).isNotNull() & ~F.isnan(F.col(seconds).cast("double")) & size.isNotNull() & ~F.isnan(size) & (size >= 0)
    counters = F.filter(F.array(*(_counter(i, q, seconds) for i, q in enumerate(quotas))), lambda c: c.isNotNull())
    asked = df.filter(sound).select(F.col(ident).alias("__i"), size.alias("__a"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.explode(counters).alias("__c"))
    asked = scratch.save(asked.select("__i", "__a", *(f"__o{i}" for i in range(len(order))), "__c.*"))
    caps = F.element_at(F.array(*(F.lit(float(q.cap)) for q in quotas)), F.col("quota") + 1)
    binding = scratch.save(asked.groupBy("key", "quota").agg(F.sum("__a").alias("all")).filter(F.col("all") > caps).select("key"))
    held = asked.join(binding, "key").groupBy("__i").agg(F.first("__a").alias("__a"), *(F.first(f"__o{i}").alias(f"__o{i}") for i in range(len(order))), F.sort_array(F.collect_list(F.struct("key", "quota"))).alias("__c"))
    # Two flat arrays, since structs would become a Python object each in the pass.
    held = scratch.save(held.withColumns({"__c": F.transform("__c", lambda c: c["key"]), "__q": F.transform("__c", lambda c: c["quota"])}).withColumn("__first", F.col("__c")[0]))
    edges = held.filter(F.size("__c") > 1).select(F.col("__first").alias("u"), F.explode(F.slice("__c", 2, len(quotas))).alias("v"))
    groups = components(edges, scratch)
    held = held.join(groups, held["__first"] == groups["node"], "left").withColumn("__g", F.coalesce("component", "__first")).drop("node", "component", "__first")

    most, windows = [float(q.cap) for q in quotas], [float(q.window) for q in quotas]

    def start() -> dict:
        return {"used": {}, "next": 0}

    def step(state: dict, t: float, size: float, keys: list[str], kinds: list[int]) -> tuple:
        used = state["used"]
        if len(used) > state["next"]:  # windows that time has passed
            for k in [k for k, (_, until) in used.items() if until <= t]:
                del used[k]
            state["next"] = 2 * len(used) + 64
        taken = []
        for k, i in zip(keys, kinds, strict=True):
            now = used.get(k)
            total = size if now is None else now[0] + size
            if not total <= most[i]:
                return (False,)
            taken.append((k, (total, (math.floor(float(t) / windows[i]) + 1) * windows[i] if now is None else now[1])))
        used.update(taken)
        return (True,)

    order_kept = [f"__o{i}" for i in range(len(order))]
    decided = segmented(held.select("__i", "__g", *order_kept, "__a", "__c", "__q"), ["__g"], order_kept, ["__o0", "__a", "__c", "__q"], start, step, "__ok boolean").select(F.col("__i").alias("__id"), "__ok")
    out = df.join(decided, df[ident] == decided["__id"], "left")
    return out.select(*(df[c] for c in df.columns if c != name), F.when(sound, F.coalesce("__ok", F.lit(True))).otherwise(False).alias(name))
