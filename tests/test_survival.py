"""Survival figures against plain loops, and what a missing reference does to the gates."""

import numpy as np
from pyspark.sql import functions as F

from foretide.operators import evaluation as E

HORIZONS = (2.0, 4.0, 8.0)


def left(p):
    s = np.concatenate([[1.0], 1 - np.maximum.accumulate(p)])
    return float(((s[1:] + s[:-1]) * np.diff([0.0, *HORIZONS]) / 2).sum())


def figures(rows):
    err = [(abs(left(p) - min(t, 8.0)), t) for _, t, p, _ in rows]
    brier = np.mean([np.mean((np.maximum.accumulate(p) - y) ** 2) for _, _, p, y in rows])
    part = lambda lim: float(np.mean([e for e, t in err if t <= lim] or [8.0]))
    return brier, part(8.0), part(2.0)


def test_figures_and_missing_reference(spark):
    rng = np.random.default_rng(2)
    times = rng.uniform(0, 12, 60)
    made = lambda: [(i % 4, float(t), np.array(rng.random(3)), np.array([float(t <= h) for h in HORIZONS])) for i, t in enumerate(times)]
    model, elapsed, average = made(), made(), made()
    frame = lambda rows: spark.createDataFrame([(r, t, p.tolist(), y.tolist()) for r, t, p, y in rows], "run long, ttf double, p array<double>, y array<double>")
    refs = frame(elapsed).withColumn("name", F.lit("elapsed_time_only")).unionByName(frame(average).withColumn("name", F.lit("average_duration")))
    warnings = spark.createDataFrame([(0.75,)], "useful_rate double")
    got = E.survival_metrics(frame(model), refs, warnings, HORIZONS, 8.0, 2.0).first()
    m, e, a = figures(model), figures(elapsed), figures(average)
    assert got.evaluated_runs == 4 and got.useful_rate == 0.75
    want = [(e[0] - m[0]) / e[0], (a[0] - m[0]) / a[0], (e[1] - m[1]) / e[1], (a[1] - m[1]) / a[1], m[2], e[2]]
    have = [got.brier_vs_elapsed, got.brier_vs_average, got.mae_vs_elapsed, got.mae_vs_average, got.final10_mae, got.elapsed_final10_mae]
    assert np.allclose(want, have)
    alone = E.survival_metrics(frame(model), refs.where("name = 'average_duration'"), warnings, HORIZONS, 8.0, 2.0)
    gates = E.promotion_gates(alone.withColumn("total_runs", F.lit(40)).withColumn("latency_p95", F.lit(1.0))).first()
    assert gates.brier_vs_elapsed is None and not gates.gate_brier_elapsed and not gates.gate_time_elapsed and not gates.eligible
    none = E.survival_metrics(frame(model).limit(0), refs.limit(0), warnings, HORIZONS, 8.0, 2.0).first()
    assert none.evaluated_runs is None and none.brier_vs_elapsed is None
