"""Thinning along a clock: keep the first row, then always the next one a step later.

Which row is kept next depends on the last one kept, through the whole timeline.  What a
stretch of it does is a step function, though: from the time before which nothing may be
kept (the *threshold*) when the stretch is entered to the threshold when it is left.  Only
thresholds less than one step after the stretch's start can be met, so the function is a
list of the clocks in that first step, the next clock after them, and what each leads to.

Stretches of ``fan`` steps are evaluated by jumps (binary search, all entries at once),
``fan`` of them are composed into the next larger stretch, and so on; the few largest are
replayed per entity, and thresholds are handed down again.  Every level is one exchange up
and one down; the plan does not depend on the data.  A task holds the rows of ``fan``
steps, or the first-step clocks of ``fan`` stretches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.operators.timeline import null_safe_join
from foretide.settings import materialise


def leave(clocks: np.ndarray, exits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Thresholds after a stretch, given those before it; where no clock follows they stay."""
    i = np.searchsorted(clocks, at)
    return np.where(i < len(clocks), exits[np.minimum(i, len(clocks) - 1)], at) if len(clocks) else at


def jumps(clocks: np.ndarray, at: np.ndarray, step: float) -> np.ndarray:
    """Thresholds after sorted ``clocks`` for the thresholds ``at`` before them."""
    at = at.copy()
    live = np.arange(len(at))
    while len(live):
        i = np.searchsorted(clocks, at[live])
        live, i = live[i < len(clocks)], i[i < len(clocks)]
        at[live] = clocks[i] + step
    return at


def walk(clocks: np.ndarray, at: float, step: float) -> list[float]:
    """The clocks that are kept from a threshold on."""
    out = []
    i = int(np.searchsorted(clocks, at))
    while i < len(clocks):
        out.append(float(clocks[i]))
        i = int(np.searchsorted(clocks, clocks[i] + step))
    return out


def _first_step(clocks: np.ndarray, until: float) -> np.ndarray:
    """The clocks before ``until`` and the one after them."""
    return clocks[: int(np.searchsorted(clocks, until)) + 1]


def _parts(clocks, exits) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(c, float), np.asarray(e, float)) for c, e in zip(clocks, exits, strict=True)]


def _functions(width: float, step: float):
    """Step functions of stretches of ``width`` from their clocks, and from those of the stretches they are made of."""

    @F.pandas_udf("struct<clocks:array<double>,exits:array<double>>")
    def bottom(clocks: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = []
        for all_clocks, at in zip(clocks, number, strict=True):
            entry = _first_step(np.asarray(all_clocks, float), at * width + step)
            out.append((entry.tolist(), jumps(np.asarray(all_clocks, float), entry, step).tolist()))
        return pd.DataFrame(out, columns=["clocks", "exits"])

    @F.pandas_udf("struct<clocks:array<double>,exits:array<double>>")
    def composed(clocks: pd.Series, exits: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = []
        for c, e, at in zip(clocks, exits, number, strict=True):
            parts, heads, until = _parts(c, e), [], at * width + step
            for own, _ in parts:
                heads.append(_first_step(own, until))
                if heads[-1][-1] >= until:
                    break
            entry = now = np.concatenate(heads)
            for part in parts:  # entries of a later stretch lie beyond all clocks of the earlier ones
                now = leave(*part, now)
            out.append((entry.tolist(), now.tolist()))
        return pd.DataFrame(out, columns=["clocks", "exits"])

    return bottom, composed


def _entries():
    """The threshold at which each of a stretch's parts is entered, as an array."""

    @F.pandas_udf("array<double>")
    def entered(clocks: pd.Series, exits: pd.Series, enter: pd.Series) -> pd.Series:
        out = []
        for c, e, at in zip(clocks, exits, enter, strict=True):
            now, met = np.array([at]), []
            for part in _parts(c, e):
                met.append(float(now[0]))
                now = leave(*part, now)
            out.append(met)
        return pd.Series(out, dtype=object)

    return entered


def thin(df: DataFrame, keys: Sequence[str], order: Sequence[str], clock: str, step: float, fan: int = 256, levels: int = 1) -> DataFrame:
    """Rows kept when each is at least ``step`` after the last one kept, per entity; the first of equal clocks.

    ``clock`` is a number that never falls along ``order``.  Rows without a clock are kept, and bind no
    other; a step of 0 or less keeps every row.
    """
    if step <= 0:
        return df
    step, keys = float(step), list(keys)
    widths = [step * fan ** (i + 1) for i in range(levels + 1)]
    names = [f"_b{i}" for i in range(levels + 1)]
    at = F.col(clock).cast("double")
    rows = df.where(F.col(clock).isNotNull()).select(*keys, at.alias("_t"), *[F.floor(at / w).cast("long").alias(n) for n, w in zip(names, widths, strict=True)])

    # Up: each stretch's step function, from the clocks, then from the stretches below.
    bottom, _ = _functions(widths[0], step)
    first = rows.groupBy(*keys, *names).agg(F.array_sort(F.collect_set("_t")).alias("_all"))
    first = first.withColumn("_f", bottom("_all", names[0])).select(*keys, *names, "_all", "_f.clocks", "_f.exits")
    tables = [materialise(first, "thin-0")]

    def gathered(level: int) -> DataFrame:
        """The stretches of a level in order, per stretch of the level above (per entity, at the top)."""
        parts = tables[level].groupBy(*keys, *names[level + 1 :]).agg(F.sort_array(F.collect_list(F.struct(names[level], "clocks", "exits"))).alias("_p"))
        return parts.select(*keys, *names[level + 1 :], F.col(f"_p.{names[level]}").alias("_own"), F.col("_p.clocks").alias("clocks"), F.col("_p.exits").alias("exits"))

    for level in range(1, levels + 1):
        _, composed = _functions(widths[level], step)
        above = gathered(level - 1).withColumn("_f", composed("clocks", "exits", names[level]))
        tables.append(materialise(above.select(*keys, *names[level:], "_f.clocks", "_f.exits"), f"thin-{level}"))

    # Down: the threshold at which each stretch is entered.
    entered = None
    for level in range(levels, -1, -1):
        whole = gathered(level)
        whole = whole.withColumn("_enter", F.lit(float("-inf"))) if entered is None else null_safe_join(whole, entered, [*keys, *names[level + 1 :]])
        met = F.arrays_zip(F.col("_own").alias("own"), _entries()("clocks", "exits", "_enter").alias("enter"))
        entered = whole.select(*keys, *names[level + 1 :], F.explode(met).alias("_m"))
        entered = entered.select(*keys, *names[level + 1 :], F.col("_m.own").alias(names[level]), F.col("_m.enter").alias("_enter"))

    @F.pandas_udf("array<double>")
    def kept(clocks: pd.Series, enter: pd.Series) -> pd.Series:
        return pd.Series([walk(np.asarray(c, float), e, step) for c, e in zip(clocks, enter, strict=True)], dtype=object)

    chosen = null_safe_join(tables[0].select(*keys, *names, "_all"), entered, [*keys, *names])
    chosen = chosen.select(*keys, F.explode(kept("_all", "_enter")).alias("_t"))
    # Of the rows at a kept clock, the first in order.
    firsts = df.where(F.col(clock).isNotNull()).withColumn("_t", at).groupBy(*keys, "_t").agg(F.min(F.struct(*order)).alias("_first"))
    chosen = null_safe_join(chosen, firsts, [*keys, "_t"]).select(*keys, "_t", "_first")
    marked = null_safe_join(df.withColumn("_t", at), chosen, [*keys, "_t"], "left")
    return marked.where(F.col("_t").isNull() | (F.struct(*order) == F.col("_first"))).select(*df.columns)
