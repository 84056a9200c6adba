"""Many logistic regressions fitted together: one pass over the rows per step, whatever their number.

Each regression (a :class:`Task`) has its own row weights, target and features.  A step
multiplies the rows of a batch by the stacked coefficients of all tasks at once; the tasks of
Spark add what they see into one array of sums, a few reducers merge the arrays, and the
driver receives a fixed number of them (tasks x features numbers each, never rows).  It keeps one
small quasi-Newton state per regression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGERS = 8


@dataclass(frozen=True)
class Task:
    """One regression: places in the rows' arrays ``w`` (its weight), ``y`` (its target) and ``x`` (its features)."""

    name: str
    weight: int
    target: int
    features: tuple[int, ...]


@dataclass
class Stack:
    """Fitted coefficients on the raw features, one row per task.

    ``constant`` holds the rate of tasks with one class (or no row) and NaN for the others;
    ``slope`` is the largest gradient entry per row at the end, ``passes`` the scans taken.
    """

    tasks: list[Task]
    coefficients: np.ndarray
    intercept: np.ndarray
    constant: np.ndarray
    slope: np.ndarray
    passes: int = 0

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.coefficients.T + self.intercept
        return np.where(np.isnan(self.constant), z, _logit(self.constant))


def _logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(np.nan_to_num(p, nan=0.5), 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    """Arrays as rows of a matrix; null arrays and null or missing entries are NaN."""
    if all(v is not None and len(v) >= width for v in values):
        return np.array([v[:width] for v in values], dtype=float).reshape(len(values), width)
    out = np.full((len(values), width), np.nan)
    for i, v in enumerate(values):
        if v is not None:
            v = np.asarray(v, dtype=float)[:width]
            out[i, : len(v)] = v
    return out


def _summed(rows: DataFrame, columns: Sequence[str], widths: Sequence[int], length: int, add) -> np.ndarray:
    """The sum over all batches of ``add(matrices)``, an array of ``length`` numbers."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length)
        for batch in batches:
            if len(batch):
                total += add(*[_matrix(batch[c], n) for c, n in zip(columns, widths)])
        yield pd.DataFrame({"s": [total]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length)
        for batch in batches:
            for s in batch["s"]:
                total += s
        yield pd.DataFrame({"s": [total]})

    parts = rows.select(*columns).mapInPandas(partial, "s array<double>")
    merged = parts.repartition(MERGERS).mapInPandas(merge, "s array<double>").collect()
    return np.sum([np.asarray(r.s, dtype=float) for r in merged], axis=0) if merged else np.zeros(length)


@dataclass
class _Descent:
    """Limited-memory quasi-Newton state of one regression."""

    at: np.ndarray
    value: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    pairs: list = field(default_factory=list)
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.at if self.direction is None else self.at + self.step * self.direction

    def turn(self, scale: float) -> None:
        q = self.gradient.copy()
        kept = []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q *= scale
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        self.direction, self.step = -q, 1.0

    def take(self, value: float, gradient: np.ndarray, scale: float, tolerance: float, memory: int = 10) -> None:
        if self.direction is not None:
            slope = self.gradient @ self.direction
            if not value <= self.value + 1e-4 * self.step * slope + 1e-12 * abs(self.value):
                self.step /= 2
                self.done = self.step < 1e-9
                return
            s, y = self.step * self.direction, gradient - self.gradient
            if s @ y > 1e-14 * (y @ y):
                self.pairs = [*self.pairs[1 - memory :], (s, y)]
            self.at = self.at + s
        self.value, self.gradient = value, gradient
        if np.abs(gradient).max() <= tolerance:
            self.done = True
        else:
            self.turn(scale)


def fit_stacked(
    rows: DataFrame, tasks: Sequence[Task], c: float = 1.0, balanced: bool = False, standardise: bool = True,
    passes: int = 200, tolerance: float = 1e-6,
) -> Stack:
    """Fit all tasks on ``rows`` (x, y, w: arrays of numbers), minimising weighted log-loss + |coefficients|^2 / 2c.

    ``balanced`` gives both classes of a task the same total weight.  Features without
    spread get no coefficient.  Null weights are 0; a row with a null target or a null
    among a task's features is left out of that task; a task of one class is its
    rate, one without rows the rate 0.  ``tolerance`` bounds the gradient per unit of weight.
    ``rows`` is read two times and then once per step: hand in a written table.
    """
    tasks = list(tasks)
    k = len(tasks)
    if not k:
        return Stack([], np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0))
    width = 1 + max(max(t.features, default=0) for t in tasks)
    targets, weights = 1 + max(t.target for t in tasks), 1 + max(t.weight for t in tasks)
    ti, wi = np.array([t.target for t in tasks]), np.array([t.weight for t in tasks])
    mask = np.zeros((k, width))
    for i, t in enumerate(tasks):
        mask[i, list(t.features)] = 1.0
    data, widths = ["x", "y", "w"], [width, targets, weights]

    def usable(x, y, w):
        """Features without nulls, targets and weights per task."""
        gone = np.isnan(x)
        t, v = y[:, ti], np.nan_to_num(w[:, wi])
        if gone.any():
            v = np.where(gone.astype(float) @ mask.T > 0, 0.0, v)
        v = np.where(np.isnan(t), 0.0, v)
        return np.nan_to_num(x), np.nan_to_num(t), v

    def first(x, y, w):
        x, t, v = usable(x, y, w)
        return np.concatenate([v.sum(0), (v * t).sum(0), (v.T @ x).ravel()])

    got = _summed(rows, data, widths, k * (2 + width), first)
    n, pos = got[:k], got[k : 2 * k]
    safe = np.where(n > 0, n, 1.0)
    mean = got[2 * k :].reshape(k, width) / safe[:, None]
    flat = (n <= 0) | (pos <= 0) | (pos >= n)
    constant = np.where(flat, pos / safe, np.nan)
    if standardise:

        def second(x, y, w):
            x, _, v = usable(x, y, w)
            return np.stack([v[:, i] @ (x - mean[i]) ** 2 for i in range(k)]).ravel()

        spread = np.sqrt(_summed(rows, data, widths, k * width, second).reshape(k, width) / safe[:, None])
        mask = mask * (spread > 1e-5)
        scale = np.where(spread > 1e-5, spread, 1.0)
    else:
        scale, mean = np.ones((k, width)), np.zeros((k, width))
    up, down = np.ones(k), np.ones(k)
    if balanced:
        up = np.where(flat, 1.0, safe / (2 * np.where(pos > 0, pos, 1.0)))
        down = np.where(flat, 1.0, safe / (2 * np.where(safe > pos, safe - pos, 1.0)))

    states = [_Descent(np.zeros(width + 1), done=bool(flat[i])) for i in range(k)]
    taken = 1 + int(standardise)
    while taken < passes and not all(s.done for s in states):
        live = [i for i, s in enumerate(states) if not s.done]
        theta = np.stack([states[i].trial() for i in live])
        raw = theta[:, :width] * mask[live] / scale[live]
        shift = theta[:, width] - (raw * mean[live]).sum(1)

        def step(x, y, w, live=live, raw=raw, shift=shift):
            x, t, v = usable(x, y, w)
            t, v = t[:, live], v[:, live]
            v = v * np.where(t > 0.5, up[live], down[live])
            z = x @ raw.T + shift
            tail = np.exp(-np.abs(z))
            loss = v * (np.log1p(tail) + np.maximum(z, 0.0) - t * z)
            off = v * (np.where(z >= 0, 1.0, tail) / (1.0 + tail) - t)
            return np.concatenate([loss.sum(0), off.sum(0), (off.T @ x).ravel()])

        m = len(live)
        got = _summed(rows, data, widths, m * (2 + width), step)
        taken += 1
        loss, off, slopes = got[:m], got[m : 2 * m], got[2 * m :].reshape(m, width)
        for j, i in enumerate(live):
            b = theta[j, :width] * mask[i]
            g = (slopes[j] - off[j] * mean[i]) / scale[i] * mask[i] + b / c
            states[i].take(
                (loss[j] + b @ b / (2 * c)) / n[i], np.append(g, off[j]) / n[i], 4.0 / (1.0 + 4.0 / (c * n[i])), tolerance
            )
    theta = np.stack([s.at for s in states])
    raw = theta[:, :width] * mask / scale
    slope = np.array([0.0 if s.gradient is None else np.abs(s.gradient).max() for s in states])
    return Stack(tasks, raw, theta[:, width] - (raw * mean).sum(1), constant, slope, taken)


def score_stacked(stack: Stack, rows: DataFrame, name: str = "z", probability: bool = False) -> DataFrame:
    """Adds the log-odds (or probabilities) of all tasks as one array, in their order.

    The coefficients travel with the function: tasks x features numbers.  A null among the
    features that any task reads makes that task's entry null.
    """
    used = np.zeros(stack.coefficients.shape)
    for i, t in enumerate(stack.tasks):
        used[i, list(t.features)] = 1.0

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        m = _matrix(x, stack.coefficients.shape[1])
        gone = np.isnan(m).astype(float) @ used.T > 0
        z = stack.margins(np.nan_to_num(m))
        if probability:
            tail = np.exp(-np.abs(z))
            z = np.where(z >= 0, 1.0, tail) / (1.0 + tail)
        return pd.Series([[None if g else float(v) for g, v in zip(gs, vs)] for gs, vs in zip(gone, z)])

    return rows.withColumn(name, scores("x"))


def calibrate_stacked(stack: Stack, rows: DataFrame, weights: Sequence[int], c: float = 1.0, **options) -> Stack:
    """One slope and intercept per task on the scores of calibration rows, again all in one pass per step.

    ``weights`` names each task's place in ``w`` for calibration; a task whose calibration rows
    hold one class predicts that rate, and one without such rows keeps its score (slope 1).
    """
    scored = score_stacked(stack, rows).select(F.col("z").alias("x"), "y", "w")
    tasks = [Task(t.name, g, t.target, (i,)) for i, (t, g) in enumerate(zip(stack.tasks, weights))]
    fitted = fit_stacked(scored, tasks, c=c, standardise=False, **options)
    have = _summed(scored, ["w"], [1 + max(weights)], 1 + max(weights), lambda w: np.nan_to_num(w).sum(0)) if tasks else np.zeros(0)
    empty = np.array([have[g] <= 0 for g in weights], dtype=bool)
    slope = np.where(empty, 1.0, np.diag(fitted.coefficients)) if tasks else np.zeros(0)
    shift = np.where(empty, 0.0, fitted.intercept)
    # A constant score is mapped like any other; NaN stays NaN.
    mapped = 1.0 / (1.0 + np.exp(-(slope * _logit(stack.constant) + shift)))
    mapped = np.where(np.isnan(stack.constant), np.nan, mapped)
    constant = np.where(empty, stack.constant, np.where(np.isnan(fitted.constant), mapped, fitted.constant))
    return Stack(stack.tasks, stack.coefficients * slope[:, None], stack.intercept * slope + shift, constant, fitted.slope, stack.passes + fitted.passes)
