"""Analytic windows along a run: gaps, segments, look-backs, insights, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators import thinning
from foretide.operators.timeline import (
    Timeline,
    drop_halo,
    islands,
    previous_row,
    row_numbers,
    running,
    running_pairs,
    with_earlier_rows,
    with_earlier_time,
)
from foretide.settings import TARGET_RUNS, materialise


# --- run tables --------------------------------------------------------------
def run_order(sessions: DataFrame, cap: int = TARGET_RUNS) -> DataFrame:
    """First ``cap`` runs by start, numbered; the sort is a top-k, so only ``cap`` rows meet."""
    first = sessions.orderBy("started_ms", "session_id").limit(cap)
    return first.withColumn("run_order", F.row_number().over(Window.orderBy("started_ms", "session_id")))


def recent(df: DataFrame, by: str, n: int = 8, tie: str | None = None) -> DataFrame:
    """Latest ``n`` rows, latest first; missing values sort last."""
    order = [F.col(by).desc_nulls_last()] + ([F.col(tie).desc()] if tie else [])
    return df.orderBy(*order).limit(n)


def fraction_rows(df: DataFrame, line: Timeline, fractions: Sequence[float]) -> DataFrame:
    """Rows of each run at floor((n - 1) * fraction)."""
    numbered = row_numbers(df, line, "_rn")
    sizes = df.groupBy(*line.keys).agg(F.count("*").alias("_n"))
    wanted = sizes.select(
        *line.keys, "_n", F.posexplode(F.array(*[F.lit(float(f)) for f in fractions])).alias("part", "fraction")
    ).withColumn("_rn", F.floor((F.col("_n") - 1) * F.col("fraction")).cast("long") + 1)
    return numbered.join(wanted, [*line.keys, "_rn"]).drop("_rn", "_n")


def clip_by_fraction(frames: DataFrame, line: Timeline, fraction: float, cached_fps: int, fps: int, seconds: int) -> DataFrame:
    """Frames of a fixed-length clip that starts at a fraction of the run; adds ``offset``.

    ``line`` has the frame index as its clock; ``frames`` carries ``n_cached``, the
    length of the cached run at ``cached_fps``.
    """
    start = F.floor(F.col("n_cached") * fraction / cached_fps).cast("long") * fps
    at = F.col(line.clock)
    return frames.where((at >= start) & (at < start + seconds * fps)).withColumn("offset", at - start)


# --- gaps and segments -------------------------------------------------------
def gap_flags(obs: DataFrame, line: Timeline, wall: str, wall_gap: float = 800, active_gap: float = 600) -> DataFrame:
    """Adds ``wall_delta``, ``active_delta`` and ``gap``."""
    p = previous_row(obs, line, {"_w": F.col(wall), "_a": F.col(line.clock)})
    return (
        p.withColumn("wall_delta", F.col(wall) - F.col("_w"))
        .withColumn("active_delta", F.col(line.clock) - F.col("_a"))
        .withColumn(
            "gap", F.coalesce((F.col("wall_delta") > wall_gap) | (F.col("active_delta") > active_gap), F.lit(False))
        )
        .drop("_w", "_a", "_has_prev")
    )


def low_streak(obs: DataFrame, line: Timeline, threshold: float = 0.6) -> DataFrame:
    """Longest run of consecutive rows at or below ``threshold`` (0 if none)."""
    low = islands(obs.withColumn("_low", F.col("motion") <= threshold), line, F.col("_low"))
    per = low.groupBy(*line.keys, "island").agg(F.count(F.when(F.col("_low"), 1)).alias("n"))
    return per.groupBy(*line.keys).agg(F.max("n").alias("longest"))


def geometry_changed(df: DataFrame, line: Timeline, limit: float = 0.08) -> DataFrame:
    """Adds ``changed``: either side invalid, scale or centre moved more than ``limit``."""
    p = previous_row(
        df, line, {"_pv": F.col("valid"), "_pa": F.col("apothem"), "_px": F.col("cx"), "_py": F.col("cy")}
    )
    moved = F.hypot(F.col("cx") - F.col("_px"), F.col("cy") - F.col("_py")) > limit * F.col("_pa")
    scaled = F.abs(F.col("apothem") / F.col("_pa") - 1) > limit
    changed = ~F.col("valid") | ~F.col("_pv") | scaled | moved
    return p.withColumn("changed", F.when(F.col("_has_prev"), F.coalesce(changed, F.lit(True))).otherwise(F.lit(False))).drop(
        "_pv", "_pa", "_px", "_py", "_has_prev"
    )


def segment_ids(df: DataFrame, line: Timeline, wall: str, max_active: float = 600, max_wall: float = 800) -> DataFrame:
    """1-based continuous segments.

    A new one starts on the first row, when the active clock stalls or jumps, when
    the wall clock jumps, when a resume point lies in (previous, current], or where
    ``changed`` is set.  ``last_resume`` and ``changed`` are optional columns: a point
    lies in between exactly when the last resume is later than the previous row.
    """
    columns = {"a": F.col(line.clock), "w": F.col(wall)}
    for optional in ("last_resume", "changed"):
        if optional in df.columns:
            columns[optional] = F.col(optional)

    def start(p: Column, c: Column) -> Column:
        cut = (c["a"] <= p["a"]) | (c["a"] - p["a"] > max_active) | (c["w"] - p["w"] > max_wall)
        if "last_resume" in columns:
            cut = cut | (c["last_resume"] > p["a"])
        if "changed" in columns:
            cut = cut | c["changed"]
        return F.when(p.isNull() | F.coalesce(cut, F.lit(True)), F.lit(1)).otherwise(F.lit(0)).cast("long")

    return running_pairs(df, line, columns, {"segment": start})


def context_validity(frames: DataFrame, line: Timeline, rows: int = 33) -> DataFrame:
    """Adds ``reason``: ok when this and the ``rows - 1`` rows before are valid and in one segment."""
    padded = with_earlier_rows(frames, line, rows - 1)
    w = line.local().rowsBetween(-(rows - 1), 0)
    marked = (
        padded.withColumn("_n", F.count("*").over(w))
        .withColumn("_s", F.first("segment").over(w))
        .withColumn("_v", F.min(F.col("valid").cast("int")).over(w))
    )
    reason = (
        F.when(~F.col("valid"), F.col("frame_reason"))
        .when((F.col("_n") < rows) | (F.col("_s") != F.col("segment")), "insufficient_continuous_context")
        .when(F.col("_v") == 0, "invalid_frame_in_context")
        .otherwise("ok")
    )
    return drop_halo(marked.withColumn("reason", reason)).drop("_n", "_s", "_v")


# --- clocks ------------------------------------------------------------------
def active_clock(events: DataFrame, line: Timeline, started: str = "active") -> DataFrame:
    """Pause-excluding clock at each event: time spent since earlier events while active.

    ``state`` is the state an event switches to; before the first event nothing
    has elapsed.
    """

    def spent(p: Column, c: Column) -> Column:
        return F.when(p["s"] == started, c["t"] - p["t"]).otherwise(F.lit(0))

    return running_pairs(events, line, {"t": F.col(line.clock), "s": F.col("state")}, {"active_elapsed": spent})


def running_max(df: DataFrame, line: Timeline, value: str, name: str = "running_max") -> DataFrame:
    return running(df, line, maxima={name: F.col(value)})


# --- look-backs ----------------------------------------------------------------
def _divide_by(s: float):
    return lambda x: x / s


def lookback_deltas(
    df: DataFrame, line: Timeline, seconds: Sequence[int] = (1, 2, 4, 8), tolerance: float = 600, ranked: bool = False,
    unit: int = 1000,
) -> DataFrame:
    """Change of six lanes against the newest row at least s back, within ``tolerance``.

    ``df`` has ``height``, ``incoming`` and ``confidence`` arrays and a unique integer
    clock.  Adds arrays ``growth_s``, ``clear_s``, ``motion_s`` and scalar/array
    ``conf_s``.  With ``ranked`` the lanes are compared as sorted distributions, so a
    rotation is no change, and the confidence is half the weakest lane's.
    """
    reach = max(seconds) * unit + tolerance
    padded = with_earlier_time(df, line, reach)
    for s in seconds:
        w = line.by_clock().rangeBetween(int(-s * unit - tolerance), -s * unit)
        padded = padded.withColumn(f"_b{s}", F.last(F.struct("height", "incoming", "confidence")).over(w))
    out = drop_halo(padded)

    def side(prefix: str, name: str) -> Column:
        c = F.col(f"{prefix}{name}")
        return F.array_sort(c) if ranked else c

    for s in seconds:
        b = f"_b{s}."
        growth = F.zip_with(side("", "height"), side(b, "height"), lambda x, y: x - y)
        motion = F.transform(F.zip_with(side(b, "incoming"), side("", "incoming"), lambda x, y: x - y), _divide_by(s))
        if ranked:
            low = F.least(F.array_min("confidence"), F.array_min(f"{b}confidence")) * 0.5
            conf = F.transform("height", lambda _: low)
        else:
            conf = F.zip_with("confidence", f"{b}confidence", lambda x, y: F.least(x, y))
        found = F.col(f"_b{s}").isNotNull()
        out = (
            out.withColumn(f"growth_{s}", F.when(found, growth))
            .withColumn(f"clear_{s}", F.when(found, F.transform(growth, lambda g: F.greatest(F.lit(0.0), -g))))
            .withColumn(f"motion_{s}", F.when(found, motion))
            .withColumn(f"conf_{s}", F.when(found, conf))
        )
    return out.drop(*[f"_b{s}" for s in seconds])


def _motion_block(n: int, s: int, speeds: Column, fraction: Column, appear: Column, land: Column, g: Sequence[Column]) -> Column:
    q = [F.coalesce(S.array_quantile(speeds, p) * 4.0, F.lit(0.0)) for p in (0.5, 0.25, 0.75, 1.0)]
    return F.array(*q, fraction, appear, land, *g)


def motion_features(
    df: DataFrame, line: Timeline, seconds: Sequence[int] = (1, 2, 4, 8), rate: int = 4, limit: float = 5.0
) -> DataFrame:
    """Incoming-speed and stack-activity statistics over the last seconds; adds ``motion`` (12 per horizon).

    ``df`` has ``height`` and ``incoming`` arrays and ``phase``.  Null until a full
    history of ``max(seconds) * rate + 1`` rows exists.
    """
    longest = max(seconds) * rate
    padded = with_earlier_rows(df, line, longest)
    w = line.local()
    lag = lambda c: F.lag(c).over(w)
    rows = (
        padded.withColumn("_ph", lag("height")).withColumn("_pi", lag("incoming")).withColumn("_pp", lag("phase"))
    )
    stable = (F.abs("_pp") <= limit) & (F.abs("phase") <= limit)
    lanes = F.arrays_zip(F.col("_ph").alias("h0"), F.col("height").alias("h1"), F.col("_pi").alias("r0"), F.col("incoming").alias("r1"))

    def matched(v):
        step = v["r0"] - v["r1"]
        return (
            (v["r0"] < 2.05) & (v["r1"] < 2.05) & (v["r0"] > v["h0"] + 0.1) & (v["r1"] > v["h1"] + 0.1)
            & (step > 0.004) & (step < 0.25)
        )

    def landed(v):
        return (v["r0"] - v["h0"] < 0.2) & (v["r0"] < 2.05) & (v["r1"] - v["r0"] > 0.15)

    none = F.expr("cast(array() as array<double>)")
    speeds = F.when(stable, F.transform(F.filter(lanes, matched), lambda v: v["r0"] - v["r1"])).otherwise(none)
    count = lambda rule: F.when(stable, F.size(F.filter(lanes, rule))).otherwise(F.lit(0))
    rows = (
        rows.withColumn("_sp", speeds)
        .withColumn("_ap", count(lambda v: (v["r0"] >= 2.05) & (v["r1"] < 2.05)))
        .withColumn("_la", count(landed))
        .withColumn("_g", S.array_sum(F.col("height")) - S.array_sum(F.col("_ph")))
    )
    blocks = []
    for s in seconds:
        n = s * rate
        f = w.rowsBetween(-(n - 1), 0)
        g = F.col("_g")
        sums = [
            F.sum(F.greatest(g, F.lit(0.0))).over(f),
            F.sum(F.greatest(-g, F.lit(0.0))).over(f),
            F.sum((g > 0.06).cast("double")).over(f),
            F.sum((g < -0.06).cast("double")).over(f),
            F.sum(g).over(f),
        ]
        rows = rows.withColumn(f"_s{s}", F.array_sort(F.flatten(F.collect_list("_sp").over(f))))
        blocks.append(
            _motion_block(
                n, s, F.col(f"_s{s}"), F.size(f"_s{s}") / float(n * 6),
                F.sum("_ap").over(f).cast("double"), F.sum("_la").over(f).cast("double"), sums,
            )
        )
    rows = rows.withColumn("_n", F.count("*").over(w.rowsBetween(-longest, 0)))
    rows = rows.withColumn("motion", F.when(F.col("_n") == longest + 1, F.concat(*blocks)))
    return drop_halo(rows).select(*df.columns, "motion")


def verified_motion(df: DataFrame, line: Timeline, seconds: Sequence[int] = (1, 2, 4, 8), rate: int = 4) -> DataFrame:
    """Stricter statistics: identity by colour and confidence, steps confirmed by a second one.

    ``df`` has ``height``, ``incoming``, ``colour``, ``conf`` arrays plus ``phase``,
    ``apothem``, ``cx``, ``cy``.  Activity counts a height change only between two
    accepted observations at most three rows apart.  A window never uses a pair from
    before its first row, which only the longest horizon can touch.
    """
    longest = max(seconds) * rate
    padded = with_earlier_rows(df, line, longest + 2)
    w = line.local()
    whole = F.struct("height", "incoming", "colour", "conf", "phase", "apothem", "cx", "cy")
    rows = padded.withColumn("_1", F.lag(whole).over(w)).withColumn("_2", F.lag(whole).over(w))
    rows = rows.withColumn("_2", F.lag("_1").over(w))
    a = F.col("_1")
    stable = (
        (F.abs(a["phase"]) <= 5) & (F.abs("phase") <= 5) & (F.abs(F.col("apothem") / a["apothem"] - 1) < 0.03)
        & (F.hypot(F.col("cx") - a["cx"], F.col("cy") - a["cy"]) < 0.03 * a["apothem"])
    )
    rows = rows.withColumn("_st", F.coalesce(stable, F.lit(False)))
    zipped = F.arrays_zip(
        a["height"].alias("h0"), F.col("height").alias("h1"), a["incoming"].alias("r0"), F.col("incoming").alias("r1"),
        a["colour"].alias("c0"), F.col("colour").alias("c1"), a["conf"].alias("k0"), F.col("conf").alias("k1"),
    )

    def same(v):
        step = v["r0"] - v["r1"]
        return (
            (v["c0"] >= 0) & (v["c0"] == v["c1"]) & (v["k0"] >= 0.7) & (v["k1"] >= 0.7) & (step > 0.004) & (step < 0.25)
        )

    off = F.array(*[F.lit(False)] * 6)
    rows = rows.withColumn("_z", zipped)
    rows = rows.withColumn("_m", F.when(F.col("_st"), F.transform("_z", same)).otherwise(off))
    rows = rows.withColumn("_pm", F.coalesce(F.lag("_m").over(w), off))
    confirmed = F.zip_with(
        F.zip_with("_m", "_pm", lambda x, y: x & y),
        F.coalesce(F.zip_with("colour", F.col("_2")["colour"], lambda x, y: x == y), off),
        lambda x, y: x & y,
    )
    steps = F.filter(
        F.zip_with(confirmed, "_z", lambda ok, v: F.when(ok, v["r0"] - v["r1"])), lambda v: v.isNotNull()
    )
    appear = F.size(F.filter("_z", lambda v: (v["c0"] < 0) & (v["c1"] >= 0)))
    land = F.size(
        F.filter(
            "_z",
            lambda v: (v["r0"] - v["h0"] < 0.2) & (v["c0"] >= 0) & (v["r1"] - v["r0"] > 0.15) & (v["h1"] - v["h0"] > 0.025),
        )
    )
    jump = F.array_max(
        F.zip_with(F.array_sort("height"), F.array_sort(a["height"]), lambda x, y: F.abs(x - y))
    )
    rows = (
        rows.withColumn("_v", steps)
        .withColumn("_ap", F.when(F.col("_st"), appear).otherwise(0))
        .withColumn("_la", F.when(F.col("_st"), land).otherwise(0))
        .withColumn("_ok", F.coalesce(F.col("_st") & (jump < 0.035), F.lit(False)))
        .withColumn("_cur", F.when(F.col("_ok"), (S.array_sum(F.col("height")) + S.array_sum(a["height"])) / 2))
    )
    for k in (1, 2, 3):
        rows = rows.withColumn(f"_c{k}", F.lag("_cur", k).over(w))
    cut = lambda d: F.when(F.abs(d) > 0.06, d).otherwise(0.0)
    for k in (1, 2, 3):
        base = F.coalesce(*[F.col(f"_c{i}") for i in range(1, k + 1)])
        rows = rows.withColumn(f"_g{k}", F.coalesce(cut(F.col("_cur") - base), F.lit(0.0)))
    blocks = []
    for s in seconds:
        n = s * rate
        full = n == longest
        f = w.rowsBetween(-(n - 1), 0)
        vf = w.rowsBetween(-(n - 2), 0) if full else f
        gf = w.rowsBetween(-(n - 4), 0) if full else f
        # Of a window's first pairs, the first has no partner, the next only one, then two.
        edge = [F.lag("_g2", n - 3).over(w), F.lag("_g1", n - 2).over(w)] if full else []

        def gather(part, gf=gf, edge=edge):
            total = F.sum(part(F.col("_g3"))).over(gf)
            for e in edge:
                total = total + F.coalesce(part(e), F.lit(0.0))
            return total

        sums = [
            gather(lambda g: F.greatest(g, F.lit(0.0))),
            gather(lambda g: F.greatest(-g, F.lit(0.0))),
            gather(lambda g: (g > 0.06).cast("double")),
            gather(lambda g: (g < -0.06).cast("double")),
            gather(lambda g: g),
        ]
        rows = rows.withColumn(f"_s{s}", F.array_sort(F.flatten(F.collect_list("_v").over(vf))))
        blocks.append(
            _motion_block(
                n, s, F.col(f"_s{s}"), F.size(f"_s{s}") / float(n * 6),
                F.sum("_ap").over(f).cast("double"), F.sum("_la").over(f).cast("double"), sums,
            )
        )
    rows = rows.withColumn("_n", F.count("*").over(w.rowsBetween(-longest, 0)))
    rows = rows.withColumn("motion", F.when(F.col("_n") == longest + 1, F.concat(*blocks)))
    return drop_halo(rows).select(*df.columns, "motion")


def recent_event_features(
    frames: DataFrame, line: Timeline, seconds: Sequence[int] = (1, 2, 4, 8), rate: int = 12
) -> DataFrame:
    """Event count and confidence sum over the last seconds, with support checks.

    ``frames`` has ``supported``, ``event``, ``confidence``, ``segment``.  Adds
    ``count_s``, ``conf_s`` (null when unsupported) and ``context_reason``.
    """
    longest = max(seconds) * rate
    padded = with_earlier_rows(frames, line, longest)
    w = line.local()
    full = w.rowsBetween(-longest, 0)
    rows = (
        padded.withColumn("_n", F.count("*").over(full))
        .withColumn("_ok", F.min(F.col("supported").cast("int")).over(full))
        .withColumn("_lo", F.min("segment").over(full))
        .withColumn("_hi", F.max("segment").over(full))
    )
    why = (
        F.when(F.col("_n") < longest + 1, "short_history")
        .when(F.col("_ok") == 0, "unsupported_geometry")
        .when(F.col("_lo") != F.col("_hi"), "reset_within_window")
    )
    rows = rows.withColumn("context_reason", why)
    good = F.col("context_reason").isNull()
    for s in seconds:
        f = w.rowsBetween(-(s * rate - 1), 0)
        rows = rows.withColumn(f"count_{s}", F.when(good, F.sum(F.col("event").cast("int")).over(f))).withColumn(
            f"conf_{s}", F.when(good, F.sum(F.when(F.col("event"), F.col("confidence")).otherwise(0.0)).over(f))
        )
    return drop_halo(rows).drop("_n", "_ok", "_lo", "_hi")


def smooth(preds: DataFrame, line: Timeline, k: int = 3, width: int = 7) -> DataFrame:
    """Trailing mean of the last ``k`` probability vectors ``m``, made monotone again."""
    padded = with_earlier_rows(preds, line, k - 1)
    f = line.local().rowsBetween(-(k - 1), 0)
    means = F.array(*[F.avg(F.element_at("m", i + 1)).over(f) for i in range(width)])
    return drop_halo(padded.withColumn("smoothed", means)).withColumn("smoothed", S.monotone(F.col("smoothed"), width))


# --- insights ------------------------------------------------------------------
def segments(preds: DataFrame, line: Timeline, predicate: Column, minimum_ms: int, kind: str) -> DataFrame:
    """Maximal runs of rows satisfying a predicate that last at least ``minimum_ms``."""
    marked = preds.withColumn("_hit", F.coalesce(predicate, F.lit(False)))
    runs = islands(marked, line, F.col("_hit")).where("_hit")
    a, t = F.col(line.clock), F.col("ts_ms")
    return (
        runs.groupBy(*line.keys, "island")
        .agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms"), F.min(a).alias("start_active_ms"), F.max(a).alias("end_active_ms"))
        .where(F.col("end_active_ms") - F.col("start_active_ms") >= minimum_ms)
        .select(*line.keys, F.lit(kind).alias("kind"), "start_ms", "end_ms", "start_active_ms", "end_active_ms")
    )


def forecast_shifts(preds: DataFrame, line: Timeline, within_ms: int = 3_000, drop: float = 15.0) -> DataFrame:
    """Adjacent forecasts at most ``within_ms`` apart whose estimate falls by ``drop`` or more."""
    p = previous_row(preds, line, {"_t": F.col("ts_ms"), "_a": F.col(line.clock), "_r": F.col("remaining")})
    hit = (F.col(line.clock) - F.col("_a") <= within_ms) & (F.col("_r") - F.col("remaining") >= drop)
    return p.where(hit).select(
        *line.keys, F.lit("forecast_shift").alias("kind"), F.col("_t").alias("start_ms"), F.col("ts_ms").alias("end_ms"),
        F.col("_a").alias("start_active_ms"), F.col(line.clock).alias("end_active_ms"),
    )


def insights(
    preds: DataFrame, line: Timeline, signal_ms: int = 3_000, imminent_ms: int = 1_000, within_ms: int = 3_000,
    drop: float = 15.0,
) -> DataFrame:
    """All insight kinds of ready forecasts.

    The forecasts are worked out and written once, with only what the kinds need, and both
    kinds of stretches are numbered in one pass.
    """
    w = F.col("loss_window")
    needed = dict.fromkeys([*line.keys, *line.order, line.clock, "ts_ms", "remaining"])
    hits = {"loss_signal": w.isNotNull() & (w != "none"), "imminent": w == "under_10s"}
    ready = preds.where(F.col("status") == "ready").select(
        *needed, *[F.coalesce(hit, F.lit(False)).alias(f"_hit_{kind}") for kind, hit in hits.items()]
    )
    ready = materialise(ready, "forecasts")
    least = {"loss_signal": signal_ms, "imminent": imminent_ms}

    def change(kind: str):
        return lambda before, now: (before.isNull() | (before[kind] != now[kind])).cast("long")

    numbered = running_pairs(
        ready, line, {kind: F.col(f"_hit_{kind}") for kind in hits}, {f"_no_{kind}": change(kind) for kind in hits}
    )
    # A row belongs to a stretch of each kind it is a hit of.
    member = [
        F.when(F.col(f"_hit_{kind}"), F.struct(F.lit(kind).alias("kind"), F.col(f"_no_{kind}").alias("_no"), F.lit(ms).alias("_least")))
        for kind, ms in least.items()
    ]
    a, t = F.col(line.clock), F.col("ts_ms")
    rows = numbered.where(F.col("_hit_loss_signal") | F.col("_hit_imminent")).select(
        *line.keys, t, a.alias("_a"), F.explode(F.array_compact(F.array(*member))).alias("_of")
    )
    stretches = (
        rows.groupBy(*line.keys, "_of")
        .agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms"), F.min("_a").alias("start_active_ms"), F.max("_a").alias("end_active_ms"))
        .where(F.col("end_active_ms") - F.col("start_active_ms") >= F.col("_of._least"))
        .select(*line.keys, "_of.kind", "start_ms", "end_ms", "start_active_ms", "end_active_ms")
    )
    return stretches.unionByName(forecast_shifts(ready, line, within_ms, drop))


def warning_leads(preds: DataFrame, horizon: float = 60.0) -> DataFrame:
    """Per run: lead of the first in-range warning (0 if none), count of warnings too early.

    ``preds`` has session_id, ttf and ``signal``.
    """
    signal = F.col("signal")
    return preds.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(signal & (F.col("ttf") <= horizon), F.col("ttf"))), F.lit(0.0)).alias("lead"),
        F.count(F.when(signal & (F.col("ttf") > horizon), 1)).alias("false_early"),
    )


# --- alerts --------------------------------------------------------------------
def per_second(preds: DataFrame, line: Timeline, seconds: Column) -> DataFrame:
    """First row of each consecutive (segment, second) bucket."""
    key = F.struct(F.col("segment"), F.floor(seconds))
    p = previous_row(preds.withColumn("_k", key), line, {"_pk": F.col("_k")})
    return p.where(~F.col("_has_prev") | (F.col("_k") != F.col("_pk"))).drop("_k", "_pk", "_has_prev")


def alert_states(
    preds: DataFrame, line: Timeline, on: int = 3, off: int = 3, threshold: float = 0.5, gap: float = 1.6, unit: int = 1000
) -> DataFrame:
    """Hysteresis alert state per sampled prediction: adds ``active`` and ``onset``.

    ``preds`` has ``p``, ``t`` (seconds, the line's clock / ``unit``) and ``segment``
    (never falling along a run).  Predictions are thinned to one per second and
    segment; rows without a finite p before the first finite one are kept, and reset
    everything.  A row switches the alert on when it and the ``on - 1`` sampled rows
    before it all exceed the threshold, off likewise, and a segment change, gap or
    reset switches it off; the state is the last switch so far.  Streaks end at gaps,
    so they only ever see ``max(on, off) * gap`` seconds back.
    """
    finite = ~(F.col("p").isNull() | F.isnan("p") | (F.abs("p") == float("inf")))
    # One partition holds one second of one run.
    second = Window.partitionBy(*line.keys, "segment", F.floor("t")).orderBy(*line.order)
    seen = F.max(F.col("_ok").cast("int")).over(second.rowsBetween(Window.unboundedPreceding, -1))
    kept = preds.withColumn("_ok", finite).withColumn("_seen", F.coalesce(seen, F.lit(0))).where("_seen = 0").drop("_seen")
    padded = with_earlier_time(kept, line, int(max(on, off) * gap * unit))
    w = line.local()
    before = F.lag(F.struct("segment", "t", "_ok")).over(w)
    rows = padded.withColumn("_b", before)
    cut = (
        F.col("_b").isNull() | ~F.col("_b._ok") | ~F.col("_ok") | (F.col("segment") != F.col("_b.segment"))
        | (F.col("t") - F.col("_b.t") > gap)
    )
    side = F.when(~F.col("_ok"), 0).when(F.col("p") > threshold, 1).when(F.col("p") < threshold, -1).otherwise(0)
    rows = rows.withColumn("_cut", cut).withColumn("_side", side)

    def streak(n: int, sign: int) -> Column:
        all_on_side = (F.min((F.col("_side") == sign).cast("int")).over(w.rowsBetween(-(n - 1), 0)) == 1) & (
            F.count("*").over(w.rowsBetween(-(n - 1), 0)) == n
        )
        if n == 1:
            return all_on_side
        return all_on_side & (F.max(F.col("_cut").cast("int")).over(w.rowsBetween(-(n - 2), 0)) == 0)

    switch = F.when(streak(on, 1), 1).when(streak(off, -1) | F.col("_cut"), 0)
    marked = drop_halo(rows.withColumn("_switch", switch)).select(*preds.columns, "_ok", "_cut", "_switch")
    state = running(marked, line, lasts={"_was": F.col("_switch")}, inclusive=False)
    active = F.coalesce(F.coalesce("_switch", "_was") == 1, F.lit(False))
    was = F.coalesce(F.col("_was") == 1, F.lit(False)) & ~F.col("_cut")
    return (
        state.where("_ok").withColumn("active", active).withColumn("onset", active & ~was).select(*preds.columns, "active", "onset")
    )


def alert_metrics(states: DataFrame, keys: Sequence[str], useful: float = 15.0, horizon: float = 60.0) -> DataFrame:
    """Alert quality per run from :func:`alert_states`; ``r`` is the remaining time.

    Each sampled prediction stands for at most its next second.
    """
    r, onset = F.col("r"), F.col("onset")
    span = F.least(F.lit(1.0), F.greatest(F.lit(0.0), r))
    early = F.when(r > horizon, F.least(span, r - horizon)).otherwise(0.0)
    per = states.groupBy(*keys).agg(
        F.count(F.when(onset, 1)).alias("alerts"),
        F.count(F.when(onset & r.between(useful, horizon), 1)).alias("timely"),
        F.count(F.when(onset & (r > horizon), 1)).alias("false_alerts"),
        F.sum(span).alias("observed_s"),
        F.sum(early).alias("early_s"),
        F.sum(F.when(F.col("active"), early).otherwise(0.0)).alias("warning_early_s"),
    )
    zero = F.lit(0.0)
    return (
        per.withColumn("timely_recall", (F.col("timely") > 0).cast("double"))
        .withColumn("precision", F.coalesce(F.try_divide("timely", "alerts"), zero))
        .withColumn("false_per_minute", F.coalesce(F.try_divide(F.col("false_alerts") * 60.0, F.col("observed_s")), zero))
        .withColumn("early_fraction", F.coalesce(F.try_divide("warning_early_s", "early_s"), zero))
    )


# --- review helpers ------------------------------------------------------------
def propose_boundary(counts: DataFrame, line: Timeline, floor: int = 5) -> DataFrame:
    """Last frame where ``n`` drops below ``floor``, else the last frame: (keys, idx, found)."""
    p = previous_row(counts, line, {"_before": F.col("n")})
    drop = (F.col("_before") >= floor) & (F.col("n") < floor)
    return p.groupBy(*line.keys).agg(
        F.coalesce(F.max(F.when(drop, F.col(line.clock))), F.max(line.clock)).alias("idx"),
        F.coalesce(F.max(drop), F.lit(False)).alias("found"),
    )


def drop_events(frames: DataFrame, line: Timeline, threshold: float = 0.06) -> DataFrame:
    """Frames whose total height falls by more than ``threshold``; rising event counts, if any, too."""
    total = S.array_sum(F.col("height"))
    p = previous_row(frames.withColumn("_h", total), line, {"_ph": F.col("_h")})
    return p.withColumn("dropped", F.coalesce(F.col("_h") - F.col("_ph") < -threshold, F.lit(False))).drop(
        "_h", "_ph", "_has_prev"
    )


def count_rises(frames: DataFrame, line: Timeline, column: str) -> DataFrame:
    """Rows where a cumulative event count grew: each is a new event."""
    p = previous_row(frames, line, {"_before": F.col(column)})
    return p.where(F.col(column) - F.col("_before") > 0).drop("_before", "_has_prev")


def thin(df: DataFrame, line: Timeline, step: float) -> DataFrame:
    """Keep the first row, then always the next one at least ``step`` after the last kept (see :mod:`thinning`)."""
    return thinning.thin(df, line.keys, line.order, line.clock, step)
