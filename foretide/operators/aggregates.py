"""Summaries of runs, windows, reviews and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions.scalars import array_quantile, monotone
from foretide.operators.quality import phase
from foretide.operators.timeline import Timeline, by_depth, null_safe_join, previous_row, running
from foretide.settings import COHORT, DEVELOPMENT_RUNS, LOCKED_TEST_RUNS, TARGET_RUNS


def _share(x: Column) -> Column:
    return F.avg(x.cast("double"))


# --- collection ----------------------------------------------------------------
def usable_count(df: DataFrame, version: str = COHORT) -> DataFrame:
    return df.where(F.col("usable") & (F.col("model_version") == version)).agg(F.count("*").alias("usable_runs"))


def dataset_summary(windows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row: sessions, windows, split sizes and the positive rate per horizon.

    Distinct sessions come from a pre-aggregated per-session count.
    """
    rates = [F.sum(F.element_at("y", i + 1)).alias(f"_y{i}") for i in range(len(horizons))]
    per = windows.groupBy("session_id").agg(F.count("*").alias("_n"), *rates)
    sessions = F.count("*")
    return per.agg(
        sessions.alias("sessions"),
        F.sum("_n").alias("windows"),
        F.least(sessions, F.lit(DEVELOPMENT_RUNS)).alias("development_runs"),
        F.greatest(F.lit(0), F.least(F.lit(LOCKED_TEST_RUNS), sessions - DEVELOPMENT_RUNS)).alias("locked_runs"),
        *[(F.sum(f"_y{i}") / F.sum("_n")).alias(f"rate_{h}") for i, h in enumerate(horizons)],
    )


def collector_summary(sessions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Instrumented totals; ``sessions`` has id, complete, automated, telemetry has id, ts_ms."""
    t = telemetry.groupBy("session_id").agg(
        F.count("*").alias("frames"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms")
    )
    s = sessions.join(t, "session_id", "left").fillna({"frames": 0, "duration_ms": 0})
    done = F.col("complete")
    return s.agg(
        F.count("*").alias("total_sessions"),
        F.count(F.when(done, 1)).alias("complete_sessions"),
        F.count(F.when(~done, 1)).alias("active_sessions"),
        F.count(F.when(done & F.col("automated"), 1)).alias("automated_sessions"),
        F.count(F.when(done & ~F.col("automated"), 1)).alias("manual_sessions"),
        F.coalesce(F.sum(F.when(done, F.col("frames"))), F.lit(0)).alias("total_frames"),
        F.coalesce(F.sum(F.when(done, F.col("duration_ms"))), F.lit(0)).alias("total_duration_ms"),
    )


def reason_counts(df: DataFrame, reason: str = "quality_reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def collection_status(runs: DataFrame) -> DataFrame:
    """One row from runs carrying usable, official, legacy."""
    n = F.count(F.when(F.col("usable"), 1))
    return runs.agg(
        n.alias("usable_runs"),
        F.greatest(F.lit(0), TARGET_RUNS - n).alias("remaining_runs"),
        F.least(n, F.lit(DEVELOPMENT_RUNS)).alias("development_runs"),
        F.least(F.greatest(F.lit(0), n - DEVELOPMENT_RUNS), F.lit(LOCKED_TEST_RUNS)).alias("locked_runs"),
        F.count(F.when(F.col("official") & ~F.col("usable"), 1)).alias("excluded_runs"),
        F.count(F.when(F.col("legacy"), 1)).alias("legacy_runs"),
        phase(n).alias("phase"),
    )


def latest_job(jobs: DataFrame) -> DataFrame:
    """The training job that changed last: job_id, milestone, state, updated_ms (no row without jobs)."""
    row = F.struct("job_id", "milestone", "state", "updated_ms")
    last = jobs.agg(F.max_by(row, F.struct("updated_ms", "job_id")).alias("_j"))
    return last.where("_j is not null").select("_j.*")


def status_report(
    collection: DataFrame, reasons: DataFrame, dataset: DataFrame, collector: DataFrame, catalogue: DataFrame, jobs: DataFrame
) -> DataFrame:
    """The status document as (section, document) rows of JSON; one row per reason and evaluation."""

    def section(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("document"))

    parts = [section("collection", collection), section("reason", reasons), section("dataset", dataset), section("collector", collector), section("evaluation", catalogue), section("job", latest_job(jobs))]
    return reduce(DataFrame.unionByName, parts)


def checkpoint_summary(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where("complete").select("usable_runs", "created_at", F.size("sessions").alias("session_count"), "path")


# --- coverage --------------------------------------------------------------------
def coverage_by_run(windows: DataFrame, run: str = "run") -> DataFrame:
    return windows.groupBy(run).agg(
        F.count("*").alias("eligible"),
        F.count(F.when(F.col("reason") == "ok", 1)).alias("valid"),
        _share(F.col("reason") == "ok").alias("coverage"),
    )


def exclusions_by_run(windows: DataFrame, run: str = "run", reason: str = "reason") -> DataFrame:
    return windows.where(F.col(reason) != "ok").groupBy(run, reason).agg(F.count("*").alias("n"))


def tail_support(windows: DataFrame, seconds: float = 10.0) -> DataFrame:
    last = F.col("ttf") <= seconds
    return windows.groupBy("run").agg(
        F.count(F.when(last, 1)).alias("eligible_tail"),
        F.count(F.when(last & F.col("valid"), 1)).alias("supported_tail"),
        _share(F.col("valid")).alias("supported_share"),
    )


def message_counts(df: DataFrame, message: str) -> DataFrame:
    return df.groupBy(message).agg(F.count("*").alias("n"))


# --- durations and references -----------------------------------------------------
def run_durations(windows: DataFrame, run: str = "session_id") -> DataFrame:
    """Longest and median elapsed + remaining seconds per run."""
    total = F.col("elapsed") + F.col("ttf")
    longest = windows.groupBy(run).agg(F.max(total).alias("duration_max"))
    middle = exact_quantiles(windows, total, {"duration_median": 0.5}, [run]).drop("duration_median_element")
    return longest.join(middle, run)


def constant_rate(long_df: DataFrame) -> DataFrame:
    return long_df.groupBy("h").agg(F.avg("y").alias("rate"))


def fit_normaliser(sequences: DataFrame, fields: Sequence[str], epsilon: float = 1e-6) -> DataFrame:
    """One row of mean and std + epsilon per field over all (window, step) cells."""
    cells = sequences.select(F.explode("history").alias("_r"))
    out = []
    for f in fields:
        x = F.col(f"_r.{f}").cast("double")
        out += [F.avg(x).alias(f"mu_{f}"), (F.stddev_pop(x) + epsilon).alias(f"sd_{f}")]
    return cells.agg(*out)


def normalise(df: DataFrame, stats: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``stats`` is one row, joined to every row."""
    joined = df.join(F.broadcast(stats.limit(1)))
    for f in fields:
        joined = joined.withColumn(f, (F.col(f) - F.col(f"mu_{f}")) / F.col(f"sd_{f}"))
    return joined.select(*df.columns)


def feature_drift(windows: DataFrame, fields: Sequence[str], train: Column, top: int = 5) -> DataFrame:
    """Largest standardised mean shifts per run: (run, rank, feature, shift)."""

    def unpivot(df, keys, stat):
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{stat}_{f}").alias(stat)) for f in fields])
        return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")

    base = windows.where(train).agg(
        *[F.avg(f).alias(f"mu_{f}") for f in fields], *[F.stddev_pop(f).alias(f"sd_{f}") for f in fields]
    )
    per = windows.groupBy("run").agg(*[F.avg(f).alias(f"m_{f}") for f in fields])
    stats = unpivot(base, [], "mu").join(unpivot(base, [], "sd"), "feature")
    z = F.abs((F.col("m") - F.col("mu")) / F.greatest(F.col("sd"), F.lit(1e-12)))
    shift = F.when(F.col("sd") < 1e-10, F.lit(0.0)).otherwise(z)
    ranked = (
        unpivot(per, ["run"], "m").join(F.broadcast(stats), "feature").withColumn("shift", shift)
        # One row per feature: a run's partition is as wide as the feature list.
        .withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("shift"), "feature")))
    )
    return ranked.where(F.col("rank") <= top).select("run", "rank", "feature", "shift")


def macro_mean(per_run: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return per_run.agg(*[F.avg(m).alias(m) for m in metrics])


def ensemble_median(members: DataFrame, keys: Sequence[str], width: int = 7) -> DataFrame:
    """``members`` has one row per (keys, member) with array ``p``; a handful of members each."""
    listed = members.groupBy(*keys).agg(F.collect_list("p").alias("_m"))
    medians = F.array(*[array_quantile(F.array_sort(F.transform("_m", _at(i))), 0.5) for i in range(width)])
    # Two projections: the running maximum refers to every median several times.
    return listed.select(*keys, medians.alias("_q")).select(*keys, monotone(F.col("_q"), width).alias("p"))


def _at(i: int):
    return lambda p: F.element_at(p, i + 1)


def exact_quantiles(
    df: DataFrame, value: Column, quantiles: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles of any number of rows per group.

    Built-in ``percentile`` keeps a group's distinct values in one buffer.  Here
    equal values are merged, ranks accumulated over cells that hold about equally many
    of them, and only the one or two values around each wanted rank are picked.  Adds ``<name>_element``, the value at position floor(q n).
    """
    hist = df.select(*keys, value.cast("double").alias("v")).where("v is not null").groupBy(*keys, "v").agg(
        F.count("*").alias("c")
    )
    hist, line = by_depth(hist, tuple(keys), "v", "quantiles")
    total = hist.groupBy(*keys).agg(F.sum("c").alias("n"))
    joined = null_safe_join(hist, total, list(keys)) if keys else hist.join(F.broadcast(total))
    upto = running(joined, line, sums={"upto": F.col("c")})

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    picks, out = [F.max("n").alias("n")], []
    for name, q in quantiles.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        lo = F.floor(at)
        picks += [
            at_rank(lo).alias(f"_a_{name}"),
            at_rank(F.least(lo + 1, F.col("n") - 1)).alias(f"_b_{name}"),
            at_rank(F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(q))))).alias(f"{name}_element"),
        ]
        a_, b_ = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        out += [(a_ + (b_ - a_) * (at - lo)).alias(name), F.col(f"{name}_element")]
    return upto.groupBy(*keys).agg(*picks).select(*keys, *out)


def latency_p95(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated p95 and the element at floor(.95 n) of the ascending order."""
    return exact_quantiles(df, F.col(value), {"p95": 0.95}, keys)


# --- event scoring -----------------------------------------------------------------
def event_summary(matches: DataFrame, seconds: Column | float) -> DataFrame:
    """Totals over all match rows; ``seconds`` is the reviewed time."""
    tp = F.count(F.when(F.col("kind") == "matched", 1))
    fp = F.count(F.when(F.col("kind") == "false", 1))
    fn = F.count(F.when(F.col("kind") == "missed", 1))
    secs = F.lit(float(seconds)) if not isinstance(seconds, Column) else seconds
    zero = F.lit(0.0)
    return matches.agg(
        tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"),
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
        F.try_divide(fp * 60.0, secs).alias("false_per_minute"),
    )


def negative_positions(scored: DataFrame, truth: DataFrame, keys: Sequence[str], ahead: int, behind: int) -> DataFrame:
    """Scored positions covered by no truth's [t - ahead, t + behind]."""
    covered = truth.select(*keys, F.explode(F.sequence(F.col("at") - ahead, F.col("at") + behind)).alias("at")).distinct()
    return scored.join(covered, [*keys, "at"], "left_anti")


# --- reviews ------------------------------------------------------------------------
def review_checkpoint(
    decisions: DataFrame, clips: DataFrame, expected: int, share: float, clip_count: int, events: Sequence[str]
) -> DataFrame:
    """One row: correct frames, accuracy, clip completeness, event coverage, verdict."""
    ok = F.col("geometry_correct").eqNullSafe(True) & F.col("colours_correct").eqNullSafe(True)
    frames = decisions.agg(F.count("*").alias("reviewed"), F.count(F.when(ok, 1)).alias("correct"))
    seen = clips.select("clip", "reviewed", F.explode_outer("events").alias("_e"))
    facts = seen.agg(
        F.count_distinct("clip").alias("clips"),
        F.coalesce(F.bool_and("reviewed"), F.lit(True)).alias("all_reviewed"),
        F.array_sort(F.collect_set(F.when(F.col("_e").isin(*events), F.col("_e")))).alias("covered"),
    )
    want = F.array(*[F.lit(e) for e in sorted(events)])
    return frames.join(F.broadcast(facts)).select(
        "reviewed", "correct", (F.col("correct") / F.col("reviewed")).alias("accuracy"), "clips",
        (F.size(F.array_except(want, F.col("covered"))) == 0).alias("events_covered"),
        (
            (F.col("reviewed") == expected) & (F.col("correct") >= F.ceil(F.lit(expected * share)))
            & (F.col("clips") == clip_count) & F.col("all_reviewed")
            & (F.size(F.array_except(want, F.col("covered"))) == 0)
        ).alias("passed"),
    )


def stability_summary(base: DataFrame, variants: DataFrame, limit: float) -> DataFrame:
    """How many transformed frames keep their geometry and colours, per variant.

    ``variants`` carries ``scale``, ``pad_x``, ``pad_y`` describing the transform.
    """
    b = base.select("id", *[F.col(c).alias(f"b_{c}") for c in ("valid", "cx", "cy", "apothem", "colours")])
    j = variants.join(b, "id")
    dx = (F.col("cx") - F.col("pad_x")) / F.col("scale") - F.col("b_cx")
    dy = (F.col("cy") - F.col("pad_y")) / F.col("scale") - F.col("b_cy")
    both = F.col("valid") & F.col("b_valid")
    geometry = both & (F.hypot(dx, dy) / F.col("b_apothem") <= limit) & (
        F.abs(F.col("apothem") / F.col("scale") / F.col("b_apothem") - 1) <= limit
    )
    return j.groupBy("variant").agg(
        F.count(F.when(geometry, 1)).alias("geometry_stable"),
        F.count(F.when(both & (F.col("colours") == F.col("b_colours")), 1)).alias("colours_stable"),
        F.count("*").alias("total"),
    )


def ruler_check(rulers: DataFrame, frames: DataFrame, keys: Sequence[str], fps: float, tolerance: float = 0.15) -> DataFrame:
    """Estimated against manually measured speed; both ends must show the same colour."""
    f = frames.select(*keys, "idx", "radius", "colour")
    a = f.select(*keys, F.col("idx").alias("start_idx"), F.col("radius").alias("_ra"), F.col("colour").alias("_ca"))
    b = f.select(*keys, F.col("idx").alias("end_idx"), F.col("radius").alias("_rb"), F.col("colour").alias("_cb"))
    seconds = (F.col("end_idx") - F.col("start_idx")) / fps
    same = (F.col("_ca") >= 0) & (F.col("_ca") == F.col("_cb"))
    estimated, manual = (F.col("_ra") - F.col("_rb")) / seconds, (F.col("start_radius") - F.col("end_radius")) / seconds
    return (
        rulers.join(a, [*keys, "start_idx"]).join(b, [*keys, "end_idx"])
        .withColumn("identity", same)
        .withColumn("estimated", F.when(same, estimated))
        .withColumn("manual", manual)
        .withColumn("difference", F.when(same, F.abs(estimated - manual)))
        .withColumn("within", same & (F.abs(estimated - manual) <= tolerance))
        .drop("_ra", "_rb", "_ca", "_cb")
    )


def track_agreement(tracks: DataFrame, frames: DataFrame, line) -> DataFrame:
    """Along annotated tracks: frames of the right colour, inward steps, possible steps.

    ``tracks`` has the keys, start_idx, end_idx, colour; ``frames`` idx, radius, colour.
    """
    wanted = tracks.select(
        *line.keys, F.col("colour").alias("_want"), F.explode(F.sequence("start_idx", "end_idx")).alias("idx")
    )
    got = wanted.join(frames.select(*line.keys, "idx", "radius", "colour"), [*line.keys, "idx"])
    p = previous_row(got, line, {"_pr": F.col("radius")})
    return p.groupBy(*line.keys).agg(
        F.count(F.when(F.col("colour") == F.col("_want"), 1)).alias("colour_correct"),
        F.count("*").alias("reviewed"),
        F.count(F.when(F.col("radius") < F.col("_pr"), 1)).alias("inward_pairs"),
        (F.count("*") - 1).alias("possible_pairs"),
    )


# --- session report -------------------------------------------------------------------
def session_stats(preds: DataFrame, cap: float, actual: Column) -> DataFrame:
    """Report figures per session; ``preds`` has ttf, remaining, loss_window, latency_ms."""
    warned = F.col("loss_window").isNotNull() & (F.col("loss_window") != "none")
    return preds.groupBy("session_id").agg(
        F.avg(F.abs(F.col("remaining") - F.least(F.lit(float(cap)), F.col("ttf")))).alias("mae"),
        F.coalesce(F.greatest(F.lit(0.0), F.max(F.when(warned, F.col("ttf")))), F.lit(0.0)).alias("warning_lead"),
        _share(F.col("loss_window").eqNullSafe(actual)).alias("window_accuracy"),
        F.count(F.when((F.col("loss_window") != "none") & (F.col("ttf") > cap), 1)).alias("false_early"),
    )


def failed_gates(evals: DataFrame) -> DataFrame:
    """Names of failed gates per evaluation and progress percentages capped at 100."""
    bad = F.array_sort(F.map_keys(F.map_filter("gates", lambda _, v: ~v)))
    return evals.withColumn("failed", F.array_join(bad, ",")).withColumn(
        "progress", F.least(F.lit(100.0), F.col("done") * 100.0 / F.col("target"))
    )


def timeline_series(preds: DataFrame, sessions: DataFrame, pauses: DataFrame, cap: float = 60.0) -> DataFrame:
    """Chart points per session: (session_id, series, at_ms, value), values within [0, cap].

    ``preds`` has active_ms, remaining, low, high; ``sessions`` active_duration_ms and
    baseline_s; ``pauses`` active_ms.
    """
    fit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), x))

    def points(df, series, at, value):
        return df.select("session_id", F.lit(series).alias("series"), at.cast("long").alias("at_ms"), fit(value).alias("value"))

    d = F.col("active_duration_ms")
    cap_ms = int(cap * 1000)
    knots = F.when(
        d > cap_ms,
        F.array(*[F.struct(a.cast("long").alias("a"), v.cast("double").alias("v")) for a, v in
                  ((F.lit(0), F.lit(cap)), (d - cap_ms, F.lit(cap)), (d, F.lit(0.0)))]),
    ).otherwise(
        F.array(*[F.struct(a.cast("long").alias("a"), v.cast("double").alias("v")) for a, v in
                  ((F.lit(0), d / 1000.0), (d, F.lit(0.0)))])
    )
    truth = sessions.select("session_id", F.explode(knots).alias("_k")).withColumn("_a", F.col("_k.a")).withColumn("_v", F.col("_k.v"))
    known = sessions.where(F.col("baseline_s").isNotNull())
    return (
        points(preds, "estimate", F.col("active_ms"), F.col("remaining"))
        .unionByName(points(preds, "low", F.col("active_ms"), F.col("low")))
        .unionByName(points(preds, "high", F.col("active_ms"), F.col("high")))
        .unionByName(points(truth, "truth", F.col("_a"), F.col("_v")))
        .unionByName(points(known, "average", F.lit(0), F.col("baseline_s")))
        .unionByName(points(known, "average", d, F.col("baseline_s") - d / 1000.0))
        .unionByName(points(pauses, "pause", F.col("active_ms"), F.lit(0.0)))
    )
