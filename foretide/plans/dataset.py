"""Registered queries: the window data set of 135 numbers, and the fits that read it in one pass per step."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators import aggregates as A
from foretide.operators import board as B
from foretide.operators import evaluation as E
from foretide.operators import stacked as T
from foretide.operators import timejoin as J
from foretide.plans import views as V
from foretide.plans.boards import VECTOR_SQL, features
from foretide.plans.forecasts import study_folds
from foretide.plans.registry import query
from foretide.plans.sessions import KEY, R, runs40
from foretide.settings import FOLDS, materialise

C = F.col
FX = V.FX_HORIZONS
WIDTH = 27
# The eleven occupancy numbers, means of seven fields and deltas of four (places in the frame vector).
OCCUPANCY = [*(0 * WIDTH + k for k in (8, 9, 10, 11, 13, 14, 12)), *(4 * WIDTH + k for k in (8, 9, 10, 14))]
# Feature groups of the candidate grid; the last number of a row is its elapsed time.
ELAPSED = 5 * WIDTH
GROUPS = {
    "elapsed": (ELAPSED,),
    "occupancy": tuple(OCCUPANCY),
    "appearance": tuple(i for i in range(ELAPSED) if i % WIDTH < 8),
    "board": tuple(i for i in range(ELAPSED) if i % WIDTH >= 8),
    "all": tuple(range(ELAPSED)),
    "all_elapsed": tuple(range(ELAPSED + 1)),
}
RASTERS = 500  # an observation shows raster event_id % RASTERS


def vectors(spark, d, runs=None):
    """Observations (of ``runs``, if given) with the 27 numbers of the frame they show."""
    f = B.assemble_vector(features(spark, d), F.lit(0.0), F.lit(0.0)).select("frame", C("vector").alias("_v"))
    seen = V.obs(spark, d) if runs is None else V.obs(spark, d).join(runs.select("session_id"), "session_id", "left_semi")
    shown = seen.withColumn("frame", C("event_id") % RASTERS).join(f, "frame")
    own = F.array((C("motion") / 100).cast("double"), S.clamp_motion(C("motion").cast("double")))
    return shown.withColumn("vector", F.concat(F.slice("_v", 1, 6), own, F.slice("_v", 9, 19))).drop("_v", "frame")


def window_rows(spark, d, runs=None):
    """Anchored windows (of ``runs``, if given) with their 135 numbers, before runs and labels are attached."""
    w = J.select_history(vectors(spark, d, runs), V.HISTORY_LINE, ["vector"])
    even = F.transform(J.resample_even(C("history")), lambda h: h["vector"])
    return w.select("session_id", "event_id", "active_ms", J.array_statistics(even, WIDTH).alias("numbers"))


def study_runs(spark, d):
    """(session_id, run, active_duration_ms, _d0.._d4) of the forty study runs, written once: multiplicities of five draws of the last fold's fit runs."""
    # The runs are read 16 times here, and their order is a long plan: written first, so that no plan holds it more than once.
    r = materialise(runs40(spark, d).select("session_id", "run", "active_duration_ms"), "runs")
    a, _, _ = FOLDS[-1]
    fit_runs = r.where(C("run") <= a).select("run", (C("run") - 1).alias("pos"))
    for m in range(5):
        r = r.join(E.bootstrap_multiplicity(fit_runs, 41 + m).withColumnRenamed("multiplicity", f"_d{m}"), "run", "left")
    return materialise(r, "draws")


def dataset(spark, d):
    """(run, session_id, event_id, ttf, x, y, w) of the forty study runs, written once.

    x: 135 numbers and the elapsed seconds.  y: seven targets.  w: for each fold the weights as
    fit, calibration and evaluation row, then the multiplicities of five bootstrap draws of the fit runs of the last fold.
    """
    r = study_runs(spark, d)
    run = C("run")
    role = lambda q: q.cast("double")
    folds = [role(q) for a, b, c in FOLDS for q in (run <= a, (run > a) & (run <= b), (run > b) & (run <= c))]
    draws = [F.coalesce(C(f"_d{m}"), F.lit(0)).cast("double") for m in range(5)]
    ttf = S.time_to_failure(C("active_duration_ms"), C("active_ms"))
    # A window has rows of one session only, so windows of other sessions need not be made first.
    rows = window_rows(spark, d, r).join(r, "session_id").withColumn("ttf", ttf)
    x = F.concat("numbers", F.array(C("active_ms") / 1000.0))
    y = F.transform(S.failure_targets(C("ttf"), FX), lambda v: v.cast("double"))
    return materialise(rows.select("run", *KEY, "ttf", x.alias("x"), y.alias("y"), F.array(*folds, *draws).alias("w")), "dataset")


def fold_weight(fold: int, role: str) -> int:
    return 3 * fold + ("fit", "calibration", "evaluation").index(role)


V.register_ctes(
    {
        "fx_shown": """select h.session_id, h.event_id, k.i, h.shown, h.motion from (
            select w.session_id, w.event_id, h.event_id as shown, h.motion, row_number() over (partition by w.session_id, w.event_id order by h.active_ms, h.ts_ms, h.event_id) - 1 as i,
              count(*) over (partition by w.session_id, w.event_id) as n
            from fx_windows w join fx_obs h on h.session_id = w.session_id and h.active_ms between w.active_ms - 8000 and w.active_ms) h, range(32) k(i)
            where h.i = cast(round_even(k.i * (h.n - 1) / 31.0, 0) as bigint)""",
        "fx_vectors": "select s.session_id, s.event_id, s.i, "
        + ", ".join(f"{ {6: 's.motion/100', 7: 'greatest(0.0, least(1.0, s.motion/32.0))'}.get(k, e) } as v{k}" for k, e in enumerate(VECTOR_SQL))
        + f" from fx_shown s join fx_pixframe p on p.frame = s.shown % {RASTERS}",
    }
)
STATS = ("avg({v})", "stddev_pop({v})", "min({v})", "max({v})", "avg(case when i >= 24 then {v} end) - avg(case when i < 8 then {v} end)")


@query(
    "a10_vector_statistics",
    # Means of short decimals may lie on a tie of the sixth digit, where the order of addition decides: both sides round a little above.
    "select session_id, event_id, " + ", ".join(f"round({s.format(v=f'v{k}')} + 1e-9, 6) as x{i * WIDTH + k}" for i, s in enumerate(STATS) for k in range(WIDTH))
    + " from fx_vectors group by session_id, event_id",
)
def _(spark, d):
    return window_rows(spark, d).select(*KEY, *[R(F.element_at("numbers", i + 1) + 1e-9).alias(f"x{i}") for i in range(5 * WIDTH)])


def reference_fit(spark, d):
    """The occupancy-only reference of the last fold: balanced regressions on eleven numbers."""
    rows = dataset(spark, d)
    study_folds(rows)
    tasks = [T.Task(f"occupancy_{h}", fold_weight(2, "fit"), h, GROUPS["occupancy"]) for h in range(7)]
    stack = T.fit_stacked(rows, tasks, balanced=True)
    test = rows.where(F.element_at("w", fold_weight(2, "evaluation") + 1) > 0)
    p = T.score_stacked(stack, test, "q", probability=True)
    return stack, p.withColumn("p", S.monotone(C("q"), 7))


@query("m10_occupancy_reference")
def _(spark, d):
    """Forecasts from board occupancy alone for the windows of the last fold's evaluation runs."""
    return reference_fit(spark, d)[1].select("run", *KEY, "p")


@query(
    "m10_occupancy_rows",
    """select cast(r.run as bigint) as run, count(*) as n, cast(0 as bigint) as falling, cast(0 as bigint) as outside, true as converged
       from fx_windows w join fx_runs40 r using (session_id) where r.run > 25 and r.run <= 30 group by 1""",
)
def _(spark, d):
    """Facts that hold for every right fit: each window once, probabilities rising and within 0..1, gradients at zero."""
    stack, p = reference_fit(spark, d)
    falling = F.exists(F.sequence(F.lit(2), F.lit(7)), lambda i: F.element_at("p", i) < F.element_at("p", i - 1))
    outside = F.exists("p", lambda v: v.isNull() | (v < 0) | (v > 1))
    n = lambda q, a: F.sum(q.cast("long")).alias(a)
    return p.groupBy("run").agg(F.count("*").alias("n"), n(falling, "falling"), n(outside, "outside")).withColumn("converged", F.lit(bool(stack.slope.max() < 1e-4)))


def grid_scores(scored):
    """Brier score and windows per candidate, fold and evaluation run of ``scored`` (run, y, w, q: probabilities of all candidates, folds and horizons)."""
    parts = [
        F.struct(F.lit(g).alias("candidate"), F.lit(f).alias("fold"), F.slice("q", 1 + 7 * (3 * i + f), 7).alias("q"))
        for i, g in enumerate(GROUPS) for f in range(3)
    ]
    each = scored.select("run", "y", "w", F.explode(F.array(*parts)).alias("_c")).select("run", "y", "w", "_c.*")
    # Made monotone after exploding: one long expression, not one for each candidate and fold.
    each = each.where(F.element_at("w", C("fold") * 3 + fold_weight(0, "evaluation") + 1) > 0).withColumn("p", S.monotone(C("q"), 7))
    squares = F.aggregate(F.zip_with("p", "y", lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda s, v: s + v) / 7
    return each.groupBy("candidate", (C("fold") + 1).alias("fold"), "run").agg(F.avg(squares).alias("brier"), F.count("*").alias("n"))


@query("m12_stacked_grid")
def _(spark, d):
    """Brier score per candidate, fold and run: six feature groups, three folds, seven horizons, calibrated, in one scan per step."""
    rows = dataset(spark, d)
    study_folds(rows)
    tasks = [T.Task(f"{g}|{f}|{h}", fold_weight(f, "fit"), h, x) for g, x in GROUPS.items() for f in range(3) for h in range(7)]
    stack = T.fit_stacked(rows, tasks, c=0.1)
    final = T.calibrate_stacked(stack, rows, [t.weight + 1 for t in tasks])
    return grid_scores(T.score_stacked(final, rows, "q", probability=True))


@query("m09_stacked_ensemble")
def _(spark, d):
    """Five members on bootstrap draws of whole runs, seven horizons, calibrated; each window's monotone median."""
    rows = dataset(spark, d)
    study_folds(rows)
    tasks = [T.Task(f"{m}|{h}", 9 + m, h, GROUPS["all"]) for m in range(5) for h in range(7)]
    stack = T.fit_stacked(rows, tasks, balanced=True)
    final = T.calibrate_stacked(stack, rows, [fold_weight(2, "calibration")] * len(tasks))
    test = rows.where(F.element_at("w", fold_weight(2, "evaluation") + 1) > 0)
    p = T.score_stacked(final, test, "q", probability=True)
    members = F.array(*[F.struct(F.lit(m).alias("member"), S.monotone(F.slice("q", 1 + 7 * m, 7), 7).alias("p")) for m in range(5)])
    each = p.select("run", *KEY, F.explode(members).alias("_m")).select("run", *KEY, "_m.*")
    return A.ensemble_median(each, ["run", *KEY])
