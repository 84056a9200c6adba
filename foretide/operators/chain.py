"""Sequential state along a timeline, evaluated in parallel.

Some rules are truly recursive: what a row does depends on a state the previous
row left behind.  Where the rows' state changes form a small family closed under
composition (clamps of a number, maps of a few states) they need not be replayed
by one task: blocks of rows are folded into one change each, blocks of blocks
likewise, the short list on top is replayed, and the entry states are handed down
again.  All of it is groupBy + array functions; no group exceeds ``block`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BIG = 1 << 60


@dataclass(frozen=True)
class Family:
    """How changes apply to a state, compose, and which change does nothing."""

    apply: Callable[[Column, Column], Column]
    compose: Callable[[Column, Column], Column]
    identity: Callable[[], Column]


def clamps() -> Family:
    """q -> min(max(q, lo), hi); a change is struct<lo, hi>."""

    def hit(q, g):
        return F.least(F.greatest(q, g["lo"]), g["hi"])

    return Family(
        apply=hit,
        compose=lambda s, g: F.struct(hit(s["lo"], g).alias("lo"), hit(s["hi"], g).alias("hi")),
        identity=lambda: F.struct(F.lit(-_BIG).cast("long").alias("lo"), F.lit(_BIG).cast("long").alias("hi")),
    )


def state_maps(n: int) -> Family:
    """States 0..n-1; a change is an array of the next state per state."""

    def hit(q, g):
        return F.element_at(g, (q + 1).cast("int")).cast("long")

    return Family(
        apply=hit,
        compose=lambda s, g: F.transform(s, lambda q: hit(q, g)),
        identity=lambda: F.array(*[F.lit(i).cast("long") for i in range(n)]),
    )


def entry_states(
    items: DataFrame, keys: Sequence[str], family: Family, initial: int, block: int = 48, levels: int | None = None
) -> DataFrame:
    """State before each item: (keys, pos, state).

    ``items`` has the keys, ``pos`` (0, 1, 2, … per key) and ``change``.  There are as many
    levels as the longest key needs for its topmost list to fit in one block.
    """
    if levels is None:
        longest = (items.agg(F.max("pos")).first()[0] or 0) + 1
        levels = 0
        while block ** (levels + 1) < longest:
            levels += 1
    group = F.floor(F.col("pos") / block).cast("long") if levels else F.lit(0).cast("long")
    listed = items.groupBy(*keys, group.alias("_g")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "change"))).alias("_items")
    )
    if levels:
        folds = listed.select(
            *keys,
            F.col("_g").alias("pos"),
            F.aggregate("_items", family.identity(), lambda s, e: family.compose(s, e["change"])).alias("change"),
        )
        starts = entry_states(folds, keys, family, initial, block, levels - 1)
        listed = listed.join(starts.withColumnRenamed("pos", "_g"), [*keys, "_g"])
    else:
        listed = listed.withColumn("state", F.lit(initial).cast("long"))
    empty = F.expr("cast(array() as array<struct<pos:bigint,state:bigint>>)")
    replay = F.aggregate(
        "_items",
        F.struct(F.col("state").alias("q"), empty.alias("out")),
        lambda s, e: F.struct(
            family.apply(s["q"], e["change"]).alias("q"),
            F.concat(s["out"], F.array(F.struct(e["pos"].alias("pos"), s["q"].alias("state")))).alias("out"),
        ),
    )
    return listed.select(*keys, F.explode(replay["out"]).alias("_e")).select(*keys, "_e.pos", "_e.state")
