"""Stacked regressions against one Newton fit each, and array statistics against numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from foretide.operators import stacked as T
from foretide.operators import timejoin as J

SCHEMA = "x array<double>, y array<double>, w array<double>"


def newton(x, y, w, c, balanced=False, standardise=True):
    """Plain penalised logistic regression of one task: raw coefficients and intercept."""
    n, pos = w.sum(), (w * y).sum()
    mean = (w[:, None] * x).sum(0) / n if standardise else np.zeros(x.shape[1])
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / n) if standardise else np.ones(x.shape[1])
    keep = sd > 1e-5
    z = np.hstack([(x[:, keep] - mean[keep]) / sd[keep], np.ones((len(x), 1))])
    if balanced:
        w = w * np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    penalty = np.diag([1 / c] * keep.sum() + [0.0])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (p - y)) + penalty @ b)
    out = np.zeros(x.shape[1])
    out[keep] = b[:-1] / sd[keep]
    return out, b[-1] - (out * mean).sum()


def rows(spark, x, y, w):
    data = pd.DataFrame({"x": x.tolist(), "y": y.tolist(), "w": w.tolist()})
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def sample(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [1, 50, 0.01, 1, 3, 1] + [0, 1000, 5, 0, 0, 0]
    x[:, 3] = 7.0  # no spread
    score = x[:, 0] + (x[:, 1] - 1000) / 40 - x[:, 4] / 3
    y = np.stack([score + rng.normal(size=n) > t for t in (0.0, 1.5)], 1).astype(float)
    w = np.stack([np.ones(n), rng.integers(0, 4, n), np.arange(n) < 0], 1).astype(float)
    return x, y, w


def test_equals_one_fit_each(spark):
    x, y, w = sample()
    tasks = [T.Task(f"{g}{t}{len(f)}", g, t, f) for g in (0, 1) for t in (0, 1) for f in ((0, 1, 2, 3, 4, 5), (1, 4))]
    for balanced, c in ((False, 0.1), (True, 1.0)):
        s = T.fit_stacked(rows(spark, x, y, w), tasks, c=c, balanced=balanced)
        assert s.slope.max() <= 1e-6
        for i, t in enumerate(tasks):
            f = list(t.features)
            want, shift = newton(x[:, f], y[:, t.target], w[:, t.weight], c, balanced)
            sd = x[:, f].std(0) + 1e-9
            assert np.allclose(s.coefficients[i, f] * sd, want * sd, atol=1e-4)
            assert np.allclose(s.margins(x)[:, i], x[:, f] @ want + shift, atol=1e-3)
            assert not s.coefficients[i, [k for k in range(6) if k not in f]].any()


def test_scans_do_not_grow_with_tasks(spark):
    x, y, w = sample(200)
    data = rows(spark, x, y, w)
    one = T.fit_stacked(data, [T.Task("a", 0, 0, (0, 1, 4))])
    many = T.fit_stacked(data, [T.Task(str(i), i % 2, i % 2, (0, 1, 4)) for i in range(30)])
    assert many.passes < 3 * one.passes


def test_one_class_no_rows_nulls_and_empty(spark):
    x, y, w = sample(100)
    y[:, 1] = 1.0
    data = [(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(x, y, w)]
    clean = T.fit_stacked(spark.createDataFrame(data, SCHEMA), [T.Task("a", 0, 0, (0, 1))])
    odd = [
        ([None, 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 1.0], [1.0, 1.0, 1.0]), ([9.0] * 6, [None, 1.0], [1.0] * 3), ([9.0] * 6, [0.0, 1.0], [None, None, None]),
        (None, [1.0, 1.0], [1.0] * 3), ([9.0] * 6, None, [1.0] * 3), ([9.0] * 6, [1.0, 1.0], None), ([9.0], [1.0, 1.0], [1.0] * 3),
    ]
    tasks = [T.Task("a", 0, 0, (0, 1)), T.Task("one", 0, 1, (0,)), T.Task("none", 2, 0, (0,))]
    s = T.fit_stacked(spark.createDataFrame(data + [o for o in odd if o[2] is None or o[0] is None or len(o[0]) > 1][:2], SCHEMA), tasks[:1])
    assert np.allclose(s.coefficients[0], clean.coefficients[0], rtol=1e-6)
    s = T.fit_stacked(spark.createDataFrame(data + odd, SCHEMA), tasks[:2])
    assert np.allclose(s.coefficients[0], clean.coefficients[0], rtol=1e-6) and s.constant[1] == 1.0
    s = T.fit_stacked(spark.createDataFrame(data, SCHEMA), tasks)
    assert s.constant[2] == 0.0 and np.isnan(s.constant[0])
    scored = T.score_stacked(s, spark.createDataFrame(odd[:1] + data[:1], SCHEMA), "p", probability=True).collect()
    assert scored[0].p[0] is None and 0 < scored[1].p[0] < 1 and scored[1].p[1] > 0.999
    empty = T.fit_stacked(spark.createDataFrame([], SCHEMA), tasks)
    assert (empty.constant == 0).all() and T.fit_stacked(spark.createDataFrame([], SCHEMA), []).tasks == []


def test_calibration(spark):
    x, y, w = sample()
    w[:, 0], w[:, 1] = np.arange(600) < 400, np.arange(600) >= 400
    data = rows(spark, x, y, w)
    raw = T.fit_stacked(data, [T.Task("a", 0, 0, (0,)), T.Task("b", 0, 1, (0, 1, 4)), T.Task("c", 0, 1, (5,))], balanced=True)
    done = T.calibrate_stacked(raw, data, [1, 1, 2])
    for i, t in ((0, 0), (1, 1)):
        z = raw.margins(x)[:, i : i + 1]
        a, b = newton(z, y[:, t], w[:, 1], 1.0, standardise=False)
        assert np.allclose(done.margins(x)[:, i], z[:, 0] * a[0] + b, atol=1e-3)
    assert np.allclose(done.margins(x)[:, 2], raw.margins(x)[:, 2])


def test_array_statistics(spark):
    rng = np.random.default_rng(1)
    cases = [rng.normal(size=(n, 4)) for n in (1, 3, 4, 11, 32)]
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cases)] + [(9, []), (10, [[1.0, None, 2.0, 3.0], [2.0, 1.0, 2.0, 3.0]])], "i int, h array<array<double>>")
    got = {r.i: r.s for r in df.select("i", J.array_statistics(F.col("h"), 4).alias("s")).collect()}
    for i, c in enumerate(cases):
        q = max(1, len(c) // 4)
        want = np.concatenate([c.mean(0), c.std(0), c.min(0), c.max(0), c[-q:].mean(0) - c[:q].mean(0)])
        assert np.allclose(got[i], want, atol=1e-12)
    assert got[9] is None
    assert [got[10][5 * 0 + 1], got[10][5], got[10][9], got[10][13], got[10][17]] == [None] * 5
    assert got[10][0] == 1.5 and got[10][8:12:2] == [1.0, 2.0]
