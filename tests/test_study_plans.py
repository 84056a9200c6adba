"""Plans of the stacked fits stay small: the driver holds and compiles them."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from foretide.operators import evaluation as E
from foretide.plans import dataset as D
from foretide.plans import sessions


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_study_runs_are_ordered_once(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1)
    rows = [
        (s * 100 + k, begin + dt.timedelta(days=k * 0.5, hours=s), s, "click", float(k % 9)) for s in range(1, 13) for k in range(60)
    ]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    spark.createDataFrame(events).write.parquet(f"{tmp_path}/events.parquet")
    got = D.study_runs(spark, str(tmp_path))
    # A scan of what was written, whatever the length of the plan that orders the runs.
    assert len(plan(got).splitlines()) == 1
    runs = {r.run: r for r in got.collect()}
    want = sessions.runs40(spark, str(tmp_path)).select("session_id", "run", "active_duration_ms").collect()
    assert len(want) > 3 and {(r.session_id, r.run, r.active_duration_ms) for r in runs.values()} == {tuple(r) for r in want}
    fit = spark.createDataFrame([(r.run, r.run - 1) for r in want], "run long, pos long")
    for m in range(5):
        drawn = {r.run: r.multiplicity for r in E.bootstrap_multiplicity(fit, 41 + m).collect()}
        assert {k: r[f"_d{m}"] for k, r in runs.items()} == {k: drawn.get(k) for k in runs}


def test_grid_scores_hold_one_monotone_expression(spark):
    rng = np.random.default_rng(3)
    n, groups = 12, list(D.GROUPS)
    q, y = rng.random((n, 7 * 3 * len(groups))), rng.integers(0, 2, (n, 7)).astype(float)
    w = np.zeros((n, 14))
    fold, run = np.arange(n) % 3, np.arange(n) % 4 + 1
    w[np.arange(n), 3 * fold + 2] = 1.0
    rows = pd.DataFrame({"run": run, "y": y.tolist(), "w": w.tolist(), "q": q.tolist()})
    scores = D.grid_scores(spark.createDataFrame(rows, "run long, y array<double>, w array<double>, q array<double>"))
    assert plan(scores).count("greatest(") < 100
    got = {(r.candidate, r.fold, r.run): (r.brier, r.n) for r in scores.collect()}
    want = {}
    for i, g in enumerate(groups):
        for f in range(3):
            for k in range(1, 5):
                at = np.flatnonzero((fold == f) & (run == k))
                p = np.maximum.accumulate(q[at, 7 * (3 * i + f) : 7 * (3 * i + f) + 7], 1)
                want[g, f + 1, k] = (((p - y[at]) ** 2).mean(), len(at))
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and np.isclose(got[k][0], want[k][0]) for k in want)
