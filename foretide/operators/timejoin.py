"""Joins along time: as-of, nearest, trailing history, duplicates, matching, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators.chain import clamps, entry_states
from foretide.operators.timeline import (
    HALO,
    SLICE,
    Timeline,
    as_of,
    row_numbers,
    running,
    sliced,
    with_earlier_time,
)
from foretide.settings import CONTEXT_MS, MIN_ROWS, MIN_SPAN_MS, materialise


# --- clocks and pauses ------------------------------------------------------
def resume_points(runs: DataFrame, lifecycle: DataFrame, line: Timeline) -> DataFrame:
    """Runs left-joined with their resume points in time order: (…, ordinal, resume_ms).

    Kept as rows, not as one array per run, so that no run can outgrow a task.
    """
    points = row_numbers(lifecycle.where(F.col("state") == "active"), line, "ordinal").select(
        *line.keys, "ordinal", F.col(line.clock).alias("resume_ms")
    )
    return runs.join(points, list(line.keys), "left")


def last_resume(frames: DataFrame, lifecycle: DataFrame, line: Timeline, default: int = 0) -> DataFrame:
    """Latest resume at or before each frame's clock."""
    points = lifecycle.where(F.col("state") == "active")
    got = as_of(frames, points, line, {"last_resume": F.col(line.clock)})
    return got.withColumn("last_resume", F.coalesce("last_resume", F.lit(default)))


def state_as_of(frames: DataFrame, lifecycle: DataFrame, line: Timeline, default: str = "active") -> DataFrame:
    got = as_of(frames, lifecycle, line, {"state": F.col("state")})
    return got.withColumn("state", F.coalesce("state", F.lit(default)))


def drop_paused(frames: DataFrame, lifecycle: DataFrame, line: Timeline) -> DataFrame:
    return state_as_of(frames, lifecycle, line).where(F.col("state") != "paused").drop("state")


def frames_with_clock(frames: DataFrame, obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames without an observation are dropped."""
    return frames.join(obs, list(keys))


def attach_motion(frames: DataFrame, obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frames.join(obs.select(*keys, "motion"), list(keys), "left").withColumn(
        "motion", F.coalesce("motion", F.lit(0.0))
    )


def pause_counts(sessions: DataFrame, lifecycle: DataFrame) -> DataFrame:
    n = lifecycle.where(F.col("state") == "paused").groupBy("session_id").agg(F.count("*").alias("pause_count"))
    return sessions.join(n, "session_id", "left").withColumn("pause_count", F.coalesce("pause_count", F.lit(0)))


# --- trailing history -------------------------------------------------------
def anchors(df: DataFrame, line: Timeline, skip: int = 32, step: int = 4) -> DataFrame:
    """Skip the first rows of a run, then take every ``step``-th."""
    numbered = row_numbers(df, line, "rn")
    return numbered.where((F.col("rn") > skip) & ((F.col("rn") - skip - 1) % step == 0))


def select_history(
    frames: DataFrame,
    line: Timeline,
    fields: Sequence[str],
    context_ms: int = CONTEXT_MS,
    min_rows: int = MIN_ROWS,
    min_span_ms: int = MIN_SPAN_MS,
    skip: int = 32,
    step: int = 4,
) -> DataFrame:
    """For each anchor the rows up to ``context_ms`` back, since the last resume.

    Result: the anchor's columns, ``history`` (array of structs in time order),
    ``rows`` and ``span_ms``; anchors with too little history are dropped.
    ``frames`` may carry ``last_resume``.  A row lies after the anchor's last
    resume exactly when both have the same last resume, so that condition is a
    partition key of one RANGE frame rather than a pairwise test.
    """
    df = frames if "last_resume" in frames.columns else frames.withColumn("last_resume", F.lit(0).cast("long"))
    numbered = row_numbers(df, line, "rn")
    padded = with_earlier_time(numbered, line, context_ms)
    frame = (
        Window.partitionBy(*line.cells, "last_resume").orderBy(line.clock).rangeBetween(-context_ms, 0)
    )
    item = F.struct(*dict.fromkeys([line.clock, *line.order, *fields]))
    wanted = (F.col("rn") > skip) & ((F.col("rn") - skip - 1) % step == 0)
    return (
        padded.withColumn("rows", F.count("*").over(frame))
        .withColumn("span_ms", F.col(line.clock) - F.min(line.clock).over(frame))
        .withColumn("history", F.collect_list(item).over(frame))
        .where(~F.col(HALO) & wanted & (F.col("rows") >= min_rows) & (F.col("span_ms") >= min_span_ms))
        .withColumn("history", F.sort_array("history"))
        .drop(HALO)
    )


def resample_even(history: Column, k: int = 32) -> Column:
    """``k`` rows at evenly spaced, half-even rounded positions."""
    last = F.size(history) - 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.element_at(history, (F.rint(i * last / float(k - 1)) + 1).cast("int")),
    )


def aggregate_window(windows: DataFrame, keys: Sequence[str], fields: Sequence[str], column: str = "history") -> DataFrame:
    """Per window and field: mean, population std, min, max, and last-minus-first quarter mean.

    ``keys`` identify a window and include the columns the rows are already
    partitioned by, so exploding and re-grouping needs no exchange.
    """
    size = F.size(column)
    quarter = F.greatest(F.lit(1), F.floor(size / 4)).cast("int")
    rows = windows.select(
        *keys, size.alias("_n"), quarter.alias("_q"), F.posexplode(column).alias("_i", "_row")
    )
    out = []
    for f in fields:
        x = F.col(f"_row.{f}").cast("double")
        head = F.avg(F.when(F.col("_i") < F.col("_q"), x))
        tail = F.avg(F.when(F.col("_i") >= F.col("_n") - F.col("_q"), x))
        out += [
            F.avg(x).alias(f"mean_{f}"),
            F.stddev_pop(x).alias(f"std_{f}"),
            F.min(x).alias(f"min_{f}"),
            F.max(x).alias(f"max_{f}"),
            (tail - head).alias(f"delta_{f}"),
        ]
    return rows.groupBy(*keys).agg(*out)


def _flat_statistics(width: int):
    """The statistics of :func:`array_statistics` for whole histories, given as flat arrays without nulls."""

    @F.arrow_udf("array<double>")
    def statistics(flat: pa.Array) -> pa.Array:
        offsets, numbers = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
        size = np.where(flat.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0) // width
        out = np.zeros((len(flat), 5 * width))

        def mean(m):
            # Row after row, as the additions of a fold.
            total = np.zeros((len(m), width))
            for i in range(m.shape[1]):
                total = total + m[:, i]
            return total / m.shape[1]

        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == n)
            m = numbers[offsets[at][:, None] + np.arange(n * width)].reshape(len(at), n, width)
            q, middle = max(1, n // 4), mean(m)
            off = m - middle[:, None]
            # NaN counts as the largest number.
            out[at] = np.concatenate([middle, np.sqrt(mean(off * off)), np.fmin.reduce(m, 1), np.maximum.reduce(m, 1), mean(m[:, -q:]) - mean(m[:, :q])], axis=1)
        ends = np.arange(len(flat) + 1, dtype=np.int32) * (5 * width)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=flat.is_null())

    return statistics


def array_statistics(history: Column, width: int) -> Column:
    """The same five statistics of arrays of ``width`` numbers, element by element: stat-major, 5 x width numbers.

    Works inside the window's own array, so nothing is exploded or grouped; entries that
    are null make their five numbers null.  An empty history gives null.  Whole histories are
    worked off by numpy, a batch of windows at a time; those with a null or of another width by array functions.
    """
    flat = F.flatten(history).cast("array<double>")
    whole = (F.size(history) > 0) & F.forall(history, lambda v: F.size(v) == width) & ~F.exists(flat, lambda v: v.isNull())
    return F.coalesce(_flat_statistics(width)(F.when(whole, flat)), F.when(~F.coalesce(whole, F.lit(False)), _folded_statistics(history, width)))


def _folded_statistics(history: Column, width: int) -> Column:
    zeros = F.array_repeat(F.lit(0.0), width)

    def total(rows: Column) -> Column:
        return F.aggregate(rows, zeros, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))

    def mean(rows: Column) -> Column:
        n = F.size(rows)
        return F.transform(total(rows), lambda v: v / n)

    def extreme(rows: Column, pick) -> Column:
        return F.aggregate(rows, F.element_at(rows, 1), lambda s, v: F.zip_with(s, v, lambda a, b: F.when(a.isNull() | b.isNull(), None).otherwise(pick(a, b))))

    def spread(rows: Column) -> Column:
        # bound through a one-element array, so that the mean is computed once
        squares = lambda m: F.transform(rows, lambda v: F.zip_with(v, m, lambda a, b: (a - b) * (a - b)))
        return F.transform(F.transform(F.array(mean(rows)), lambda m: mean(squares(m)))[0], lambda v: F.sqrt(v))

    quarter = F.greatest(F.lit(1), F.floor(F.size(history) / 4)).cast("int")
    head, tail = mean(F.slice(history, 1, quarter)), mean(F.slice(history, -quarter, quarter))
    delta = F.zip_with(tail, head, lambda a, b: a - b)
    stats = F.concat(mean(history), spread(history), extreme(history, F.least), extreme(history, F.greatest), delta)
    return F.when(F.size(history) > 0, stats)


# --- as-of and nearest ------------------------------------------------------
def asof_frame(anchors_: DataFrame, frames: DataFrame, line: Timeline, tolerance: float, values: dict[str, Column]) -> DataFrame:
    """Latest frame at or before each anchor, null when older than ``tolerance``."""
    got = as_of(anchors_, frames, line, {**values, "_at": F.col(line.clock)})
    ok = F.col(line.clock) - F.col("_at") <= tolerance
    for n in values:
        got = got.withColumn(n, F.when(ok, F.col(n)))
    return got.drop("_at")


def nearest(targets: DataFrame, obs: DataFrame, line: Timeline, index: str, values: dict[str, Column]) -> DataFrame:
    """Observation with the smallest absolute time distance; the earliest on ties.

    Both sides are dealt once by (entity, slice); one sort carries the last observation
    forward and the next one back, and a row per slice carries both across slices.
    ``index`` orders observations of equal time: the first of them is taken.  A target
    without a clock, or of an entity without observations, gets nulls.
    """
    clock = line.clock
    found = F.struct(F.col(clock).alias("_at"), *[e.alias(n) for n, e in values.items()])
    base = [F.struct(*line.keys).alias("_k"), F.col(clock).alias("_t")]  # a struct of keys also matches nulls
    # Of equal times the first observation is nearest: the others need not travel.
    firsts = obs.where(F.col(clock).isNotNull()).groupBy(*line.keys, clock).agg(F.min_by(found, F.col(index)).alias("_o"))
    both = targets.select(*base, F.lit(1).alias("_side"), F.struct(*targets.columns).alias("_row"), F.lit(None).alias("_o")).unionByName(
        firsts.select(*base, F.lit(0).alias("_side"), F.lit(None).alias("_row"), "_o")
    )
    rows = both.withColumn("_slice", F.coalesce(line.slice_of(F.col("_t")), F.lit(-(1 << 62)))).repartition("_k", "_slice")
    place = F.when(F.col("_o").isNotNull(), F.col("_t"))
    ends = rows.groupBy("_k", "_slice").agg(F.max_by("_o", place).alias("_last"), F.min_by("_o", place).alias("_first"))
    across = Window.partitionBy("_k").orderBy("_slice")
    carry = ends.select(
        "_k", "_slice",
        F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    local = Window.partitionBy("_k", "_slice").orderBy("_t", "_side")
    near = rows.withColumn("_b", F.last("_o", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("_f", F.first("_o", ignorenulls=True).over(local.rowsBetween(0, Window.unboundedFollowing)))
    near = near.where(F.col("_row").isNotNull()).join(carry, ["_k", "_slice"])
    back, ahead = F.coalesce("_b", "_before"), F.coalesce("_f", "_after")
    use_back = back.isNotNull() & (ahead.isNull() | (F.col("_t") - back["_at"] <= ahead["_at"] - F.col("_t")))
    best = near.withColumn("_best", F.when(F.col("_t").isNotNull(), F.when(use_back, back).otherwise(ahead)))
    return best.select("_row.*", *[F.col(f"_best.{n}").alias(n) for n in values], F.col("_best._at").alias("nearest_at"))


def best_alignment(
    targets: DataFrame, candidates: DataFrame, keys: Sequence[str], offsets: Sequence[int], crop: tuple[int, int]
) -> DataFrame:
    """Candidate offset whose centre crop differs least (mean squared) from the target.

    ``targets`` (keys, seq, y, x, value) and ``candidates`` (same) meet on equal
    (keys, seq + offset, y, x): candidates per target are fixed in number.
    """
    inside = F.col("y").between(*crop) & F.col("x").between(*crop)
    t = targets.where(inside).select(
        *keys, F.col("seq").alias("target"), "y", "x", F.col("value").alias("a"),
        F.explode(F.array(*[F.lit(int(o)) for o in offsets])).alias("offset"),
    ).withColumn("seq", F.col("target") + F.col("offset"))
    c = candidates.where(inside).select(*keys, "seq", "y", "x", F.col("value").alias("b"))
    scored = t.join(c, [*keys, "seq", "y", "x"]).groupBy(*keys, "target", "offset").agg(
        F.avg(F.pow(F.col("a") - F.col("b"), 2)).alias("mse")
    )
    per = scored.groupBy(*keys, "target").agg(
        F.min(F.struct("mse", "offset")).alias("_best"),
        F.count("*").alias("candidates"),
        F.min("offset").alias("_lo"),
        F.max("offset").alias("_hi"),
    )
    return per.select(
        *keys, "target", "candidates", F.col("_best.mse").alias("mse"), F.col("_best.offset").alias("offset"),
        F.col("_best.offset").isin(F.col("_lo"), F.col("_hi")).alias("search_edge"),
    )


# --- duplicate runs ---------------------------------------------------------
def duplicate_runs(
    runs: DataFrame, start_ms: int = 1_000, duration_ms: int = 2_000, frames_floor: int = 4, frames_share: float = 0.02
) -> DataFrame:
    """Ids of runs that have a twin in start, duration and frame count.

    Runs fall into cells so small that two runs of one cell are always twins: a
    cell of two or more needs no comparison at all.  Only the lone run of a cell
    looks into the 45 neighbouring cells, so every run is met by at most 45 others
    however crowded its cell is.
    """
    if frames_floor < 4 or frames_share < 0.02:
        raise ValueError("cells are sized for tolerances of at least 4 frames and 2 %")
    f = F.col("valid_frame_count").cast("double")
    band = F.when(f < 200, F.floor(f / 4)).otherwise(50 + F.floor(F.log(f / 200.0) / F.log(F.lit(1.017))))
    r = runs.select(
        "session_id", "started_ms", "active_duration_ms", "valid_frame_count",
        F.floor(F.col("started_ms") / start_ms).alias("cs"),
        F.floor(F.col("active_duration_ms") / duration_ms).alias("cd"),
        band.cast("long").alias("cf"),
    )
    cell = ["cs", "cd", "cf"]
    sizes = r.groupBy(*cell).agg(F.count("*").alias("n"), F.max("session_id").alias("_only"))
    crowded = r.join(sizes.where("n > 1").select(*cell), cell, "left_semi").select("session_id")
    lone = r.join(sizes.where("n = 1").select(F.col("_only").alias("session_id")), "session_id", "left_semi")

    def spread(c: str, k: int) -> Column:
        return F.explode(F.sequence(F.col(c) - k, F.col(c) + k)).alias(c)

    probes = lone.select(
        *[F.col(c).alias(f"a_{c}") for c in ("session_id", "started_ms", "active_duration_ms", "valid_frame_count")],
        spread("cs", 1), "cd", "cf",
    )
    probes = probes.select(*[c for c in probes.columns if c != "cd"], spread("cd", 1))
    probes = probes.select(*[c for c in probes.columns if c != "cf"], spread("cf", 2))
    met = probes.join(r, cell).where(F.col("a_session_id") != F.col("session_id"))
    tolerance = F.greatest(
        F.lit(float(frames_floor)),
        S.round_even(F.greatest("valid_frame_count", "a_valid_frame_count") * frames_share),
    )
    twin = (
        (F.abs(F.col("started_ms") - F.col("a_started_ms")) <= start_ms)
        & (F.abs(F.col("active_duration_ms") - F.col("a_active_duration_ms")) <= duration_ms)
        & (F.abs(F.col("valid_frame_count") - F.col("a_valid_frame_count")) <= tolerance)
    )
    pairs = met.where(twin).select(F.explode(F.array("session_id", "a_session_id")).alias("session_id"))
    return crowded.unionByName(pairs).distinct()


def quarantine_duplicates(sessions: DataFrame, **tolerances) -> DataFrame:
    from foretide.settings import COHORT

    pool = sessions.where((F.col("model_version") == COHORT) & F.col("usable") & (F.col("status") == "complete"))
    twins = duplicate_runs(pool, **tolerances).withColumn("_twin", F.lit(True))
    hit = F.coalesce("_twin", F.lit(False))
    return (
        sessions.join(twins, "session_id", "left")
        .withColumn("quality_reason", F.when(hit, "excluded: duplicate-controller capture").otherwise(F.col("quality_reason")))
        .withColumn("usable", F.when(hit, F.lit(False)).otherwise(F.col("usable")))
        .drop("_twin")
    )


def prior_baseline(sessions: DataFrame, line: Timeline) -> DataFrame:
    """Mean duration (s) of usable runs that started strictly earlier; null if none.

    ``line`` has no keys and the start time as its clock; equal starts are merged
    first, so ties see none of each other.
    """
    d = F.when(F.col("usable"), F.col("active_duration_ms"))
    starts = sessions.groupBy(line.clock).agg(F.sum(d).alias("_sum"), F.count(d).alias("_n"))
    by_start = Timeline((), (line.clock,), line.clock, line.width)
    before = running(
        starts, by_start, sums={"_bs": F.coalesce("_sum", F.lit(0)), "_bn": F.col("_n")}, inclusive=False
    )
    mean = F.when(F.col("_bn") > 0, F.col("_bs") / F.col("_bn") / 1000.0)
    return sessions.join(before.select(line.clock, mean.alias("baseline_s")), line.clock)


# --- one-to-one event matching ---------------------------------------------
def match_events(
    events: DataFrame, truth: DataFrame, keys: Sequence[str], ahead: int, behind: int, width: int = 600
) -> DataFrame:
    """Match events, in order, each to the earliest free truth with ``truth - ahead <= event <= truth + behind``.

    Both frames hold distinct integer positions ``at`` per key.  Result rows are
    (keys, kind, event_at, truth_at) with kind matched / false / missed.

    The scan's only state is p, the number of truths used up or expired.  At event k
    with ``lo`` truths expired and ``hi`` in reach, p becomes min(max(p, lo) + 1, hi):
    on q = p - k that is a clamp, so :mod:`chain` evaluates it block-wise.
    """
    none = F.lit(None).cast("long")
    at = F.col("at").cast("long")

    def mark(place, side, low, high):
        return F.struct(place.alias("_at"), F.lit(side).alias("_side"), F.lit(low).alias("_low"), F.lit(high).alias("_high"))

    # A truth is read once: it comes into reach at one place and expires at another.
    borders = F.explode(F.array(mark(at + behind + 1, 0, 1, 0), mark(at - ahead, 0, 0, 1)))
    marks = (
        events.select(*keys, mark(at, 1, 0, 0).alias("_m"), at.alias("at"))
        .unionByName(truth.select(*keys, borders.alias("_m"), none.alias("at")))
        .select(*keys, "_m.*", "at")
    )
    line = Timeline(tuple(keys), ("_at", "_side", "_low"), "_at", width)
    counted = running(
        marks, line, sums={"lo": F.col("_low"), "hi": F.col("_high"), "k": F.col("_side")}
    ).where("_side = 1")
    ev = counted.select(
        *keys, "at", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"),
        (F.col("k") - 1).cast("long").alias("pos"),
    )
    ev = materialise(ev, "events")
    change = F.struct((F.col("lo") - F.col("pos")).alias("lo"), (F.col("hi") - F.col("pos") - 1).alias("hi"))
    states = entry_states(ev.select(*keys, "pos", change.alias("change")), keys, clamps(), 0)
    judged = ev.join(states, [*keys, "pos"]).withColumn("_p", F.greatest(F.col("state") + F.col("pos"), F.col("lo")))
    t_line = Timeline(tuple(keys), ("at",), "at", width)
    numbered = row_numbers(truth.select(*keys, at.alias("at")), t_line, "_i").select(
        *keys, F.col("at").alias("truth_at"), (F.col("_i") - 1).alias("_p")
    )
    used = judged.withColumn("_p", F.when(F.col("_p") < F.col("hi"), F.col("_p"))).select(*keys, F.col("at").alias("event_at"), "_p")
    hits = used.where(F.col("_p").isNotNull())
    matched = hits.join(numbered, [*keys, "_p"]).select(*keys, F.lit("matched").alias("kind"), "event_at", "truth_at")
    wrong = used.where(F.col("_p").isNull()).select(*keys, F.lit("false").alias("kind"), "event_at", none.alias("truth_at"))
    missed = numbered.join(hits, [*keys, "_p"], "left_anti").select(*keys, F.lit("missed").alias("kind"), none.alias("event_at"), "truth_at")
    return matched.unionByName(wrong).unionByName(missed)


def censor(df: DataFrame, first: int, stop: int, ambiguous: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Keep positions in [first, stop) that are not marked ambiguous."""
    kept = df.where((F.col("at") >= first) & (F.col("at") < stop))
    return kept if ambiguous is None else kept.join(ambiguous.select(*keys, "at"), [*keys, "at"], "left_anti")


# --- completeness and equality ----------------------------------------------
def completeness(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """One row: ids missing, ids unexpected, ids given more than once."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    g = got.groupBy(key).agg(F.count("*").alias("_n"))
    return e.join(g, key, "full").agg(
        F.count(F.when(F.col("_n").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_e").isNull(), 1)).alias("unexpected"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("repeated"),
    )


def assert_complete(expected: DataFrame, got: DataFrame, key: str) -> None:
    v = completeness(expected, got, key).first()
    if v.missing or v.unexpected or v.repeated:
        raise ValueError(f"reviewed ids differ from the expected ones: {v}")


def anchor_differences(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of either side without an equal partner: (side, columns…)."""
    x, y = a.select(*columns), b.select(*columns)
    return (
        x.exceptAll(y).select(F.lit("left").alias("side"), *columns)
        .unionByName(y.exceptAll(x).select(F.lit("right").alias("side"), *columns))
    )


def assert_same_anchors(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> None:
    if not anchor_differences(a, b, columns).isEmpty():
        raise ValueError("the datasets have different anchors")


def common_windows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows both sides support, with the two segment ids composed into one."""
    x = a.where("valid").select(*keys, F.col("segment").alias("_sa"))
    y = b.where("valid").select(*keys, F.col("segment").alias("_sb"))
    return x.join(y, list(keys)).select(*keys, (F.col("_sa") * 10_000_000 + F.col("_sb")).alias("segment"))


def needs_work(items: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items without a cached result of equal key, content hash and code hash."""
    return items.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def apply_repairs(frames: DataFrame, repaired: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Repaired rows replace originals; the rest stay."""
    r = repaired.select(*keys, F.struct(*columns).alias("_r"))
    hit = F.col("_r").isNotNull()
    joined = frames.join(r, list(keys), "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(hit, F.col(f"_r.{c}")).otherwise(F.col(c)))
    return joined.drop("_r")


def expand_grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row once per combination of the given (small, literal) axes."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


# --- clips and fixed leads ---------------------------------------------------
def clip_frames(
    anchors_: DataFrame, frames: DataFrame, line: Timeline, anchor_id: str, reach: float, most: int = 8
) -> DataFrame:
    """Frames within ``reach`` of an anchor, at most ``most`` of them, evenly spaced.

    An anchor visits the slices it can reach; the rows of one clip are bounded by
    the capture rate times twice the reach.
    """
    lo, hi = F.col(line.clock) - reach, F.col(line.clock) + reach
    a = anchors_.select(
        *line.keys, anchor_id, F.col(line.clock).alias("_t"),
        F.explode(F.sequence(line.slice_of(lo), line.slice_of(hi))).alias(SLICE),
    )
    near = a.join(sliced(frames, line), line.cells).where(F.abs(F.col(line.clock) - F.col("_t")) <= reach)
    w = Window.partitionBy(*line.keys, anchor_id)
    ranked = near.withColumn("_i", F.row_number().over(w.orderBy(*line.order)) - 1).withColumn("_n", F.count("*").over(w))
    k = F.least(F.lit(most), F.col("_n"))
    picks = F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.floor(i * (F.col("_n") - 1) / F.greatest(F.lit(1), k - 1)).cast("int"),
    )
    return ranked.where(F.array_contains(picks, F.col("_i"))).drop("_i", "_n", "_t", SLICE)


def lead_frames(events: DataFrame, frames: DataFrame, keys: Sequence[str], fps: float, leads: Sequence[float]) -> DataFrame:
    """The frame a fixed number of seconds before each event: idx = trunc((event - lead) * fps)."""
    wanted = events.withColumn("lead", F.explode(F.array(*[F.lit(float(x)) for x in leads]))).withColumn(
        "idx", ((F.col("event_s") - F.col("lead")) * fps).cast("long")
    )
    return wanted.join(frames, [*keys, "idx"])


# --- nested session documents -------------------------------------------------
def session_detail(sections: dict[str, DataFrame], line: Timeline, page_rows: int = 500) -> DataFrame:
    """Children of every session in time order, as pages of at most ``page_rows`` items.

    ``sections`` maps a section name to its rows; each has the line's columns.  One
    page is one row, so a session of any length never becomes one value.
    """
    pages = []
    for name, df in sections.items():
        cols = [c for c in df.columns if c not in line.keys]
        item = F.to_json(F.struct(*cols))
        numbered = row_numbers(df, line, "_rn")
        pages.append(
            numbered.withColumn("page", F.expr(f"(_rn - 1) div {page_rows}"))
            .groupBy(*line.keys, "page")
            .agg(F.sort_array(F.collect_list(F.struct("_rn", item.alias("item")))).alias("_l"))
            .select(*line.keys, F.lit(name).alias("section"), "page", F.col("_l.item").alias("items"))
        )
    return reduce(DataFrame.unionByName, pages)
