"""Nearest observation and paired bootstrap against plain loops."""

import random

import numpy as np
import pytest

from foretide.operators import evaluation as E
from foretide.operators import timejoin as J
from foretide.operators.timeline import Timeline
from pyspark.sql import functions as F


def plain_nearest(targets, obs):
    out = []
    for key, t, i in targets:
        near = sorted((abs(c - t), c, j) for k, c, j in obs if k == key and c is not None) if t is not None else []
        out.append((i, near[0][2] if near else None))
    return sorted(out)


@pytest.mark.parametrize("width", [1, 10, 100_000])
def test_nearest_equals_a_plain_search(spark, width):
    rng = random.Random(width)
    keys = ["a", "a", "a", "b", None]
    targets = [(rng.choice(keys), rng.randrange(200), i) for i in range(120)] + [("a", None, 500), ("none", 3, 501)]
    obs = [(rng.choice(keys), rng.randrange(-50, 260, 3), i) for i in range(90)] + [("b", None, 900)]
    t = spark.createDataFrame(targets, "k string, c long, id long")
    o = spark.createDataFrame(obs, "k string, c long, j long")
    line = Timeline(("k",), ("c",), "c", width)
    got = sorted((r["id"], r["near"]) for r in J.nearest(t, o, line, "j", {"near": F.col("j")}).collect())
    assert got == plain_nearest(targets, obs)


def test_nearest_deals_the_rows_once(spark):
    t = spark.createDataFrame([("a", 1, 1)], "k string, c long, id long")
    o = spark.createDataFrame([("a", 2, 1)], "k string, c long, j long")
    plan = J.nearest(t, o, Timeline(("k",), ("c",), "c", 10), "j", {"near": F.col("j")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") <= 2 and plan.count("Window ") <= 6


def drawn(n, seed, resamples):
    out = np.zeros((resamples, n), int)
    for r in range(resamples):
        for k in range(n):
            x = (r * 1009 + k * 7919 + seed * 104_729 + 1) % E.LCG_M
            for _ in range(3):
                x = (x * E.LCG_A + 11) % E.LCG_M
            out[r, k] = x % n
    return out


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_resample_means_equal_plain_draws(spark, most):
    rng = np.random.default_rng(1)
    n, values = 23, rng.normal(size=23)
    rows = [(i, float(v), None if i % 5 == 0 else float(-v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "pos long, x double, y double")
    got = {r["resample"]: (r["x"], r["y"]) for r in E.resample_means(df, n, ["x", "y"], 3, 40, most).collect()}
    other = np.array([np.nan if r[2] is None else r[2] for r in rows])
    for r, at in enumerate(drawn(n, 3, 40)):
        assert np.allclose(got[r], (values[at].mean(), np.nanmean(other[at])))


def test_no_runs(spark):
    empty = spark.createDataFrame([], "run long, brier double")
    rows = E.paired_intervals(empty, empty, ["brier"], resamples=10).collect()
    assert [r["runs"] for r in rows] == [0] and rows[0]["low"] is None
