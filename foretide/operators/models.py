"""Splits, folds, reference forecasts, MLlib fits, calibration and ensemble scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VarianceThresholdSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators.aggregates import exact_quantiles
from foretide.operators.evaluation import bootstrap_multiplicity
from foretide.operators.timeline import Timeline, by_depth, null_safe_join, running
from foretide.settings import DEVELOPMENT_RUNS, FIT_RUNS, FOLDS, HORIZONS, TARGET_RUNS


# --- splits ------------------------------------------------------------------
def split_label(run: Column, n: Column) -> Column:
    """Chronological part of run 1..n: fit / calibration / test, or null when in none.

    From ``DEVELOPMENT_RUNS`` on the cuts are fixed and later runs are the locked
    test; at exactly that many the calibration runs double as validation.
    """
    fit_end = F.greatest(F.lit(1), F.floor(n * 0.70))
    cal_end = F.least(F.greatest(fit_end + 1, F.floor(n * 0.85)), n - 1)
    small = F.when(run <= fit_end, "fit").when(run <= cal_end, "calibration").otherwise("test")
    large = (
        F.when(run <= FIT_RUNS, "fit")
        .when(run <= DEVELOPMENT_RUNS, F.when(n == DEVELOPMENT_RUNS, "validation").otherwise("calibration"))
        .when(run <= TARGET_RUNS, "test")
    )
    return F.when(n < 7, F.raise_error(F.lit("at least seven runs are needed"))).when(n >= DEVELOPMENT_RUNS, large).otherwise(small)


def run_split(windows: DataFrame, run: str = "run") -> DataFrame:
    n = windows.agg(F.max(run).alias("_n"))
    return windows.join(F.broadcast(n)).withColumn("part", split_label(F.col(run), F.col("_n"))).drop("_n")


def fold_assign(windows: DataFrame, folds: Sequence[tuple[int, int, int]] = FOLDS, run: str = "run") -> DataFrame:
    """Every row once per fold it takes part in, with its role there."""
    r = F.col(run)
    specs = []
    for i, (a, b, c) in enumerate(folds, 1):
        role = F.when(r <= a, "fit").when(r <= b, "calibration").when(r <= c, "evaluation")
        specs.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    return windows.withColumn("_f", F.explode(F.array(*specs))).where(F.col("_f.role").isNotNull()).select(
        *windows.columns, "_f.fold", "_f.role"
    )


def missing_fold_runs(windows: DataFrame, folds: Sequence[tuple[int, int, int]] = FOLDS, run: str = "run") -> DataFrame:
    """Runs a fold needs but has no window of; any row means folds must not be used."""
    spark = windows.sparkSession
    have = windows.select(run).distinct()
    need = spark.range(1, max(c for _, _, c in folds) + 1).withColumnRenamed("id", run)
    return need.join(have, run, "left_anti")


def assert_folds(windows: DataFrame, folds: Sequence[tuple[int, int, int]] = FOLDS, run: str = "run") -> None:
    gone = [r[0] for r in missing_fold_runs(windows, folds, run).orderBy(run).collect()]
    if gone:
        raise ValueError(f"runs without windows: {gone}")


# --- references ----------------------------------------------------------------
def average_duration(train: DataFrame, default: float = 60.0) -> DataFrame:
    """One row: mean over runs of the longest elapsed + remaining time."""
    per = train.groupBy("run").agg(F.max(F.col("elapsed") + F.col("ttf")).alias("_d"))
    return per.agg(F.coalesce(F.avg("_d"), F.lit(default)).alias("avg_s"))


def empirical_reference(train: DataFrame, rows: DataFrame, horizons: Sequence[float]) -> DataFrame:
    """Adds ``p``: share of training runs still going that end within each horizon.

    Counts of durations up to t and t + h are cumulative counts along the time axis, looked
    up for each distinct elapsed time once and joined to the rows that share it.
    """
    from foretide.operators.aggregates import run_durations

    d = run_durations(train, "run").select(F.col("duration_median").alias("d"))
    hist = d.groupBy("d").agg(F.count("*").alias("c"))
    total = hist.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("_all"))
    points = rows.select(F.col("elapsed").alias("_id")).distinct()
    bounds = [("b", 0.0), *[(f"w{i}", float(h)) for i, h in enumerate(horizons)]]
    probes = points.select("_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), (F.col("_id") + h).alias("t")) for n, h in bounds])).alias("_q")).select("_id", "_q.*")
    # Durations sort before probes of the same time, so "up to and including" is counted.
    marks = hist.select(F.col("d").alias("t"), F.lit(0).alias("_side"), F.lit(-1.0).alias("_id"), F.lit("").alias("n"), "c").unionByName(
        probes.select("t", F.lit(1).alias("_side"), "_id", "n", F.lit(0).cast("long").alias("c"))
    )
    celled, _ = by_depth(marks, (), "t", "durations")
    line = Timeline((), ("t", "_side", "_id", "n"), "_cell", 1)
    upto = running(celled, line, sums={"upto": F.col("c")}).where("_side = 1")
    wide = upto.groupBy("_id").agg(*[F.max(F.when(F.col("n") == n, F.col("upto"))).alias(f"_u_{n}") for n, _ in bounds])
    j = null_safe_join(rows, wide.withColumnRenamed("_id", "elapsed"), ["elapsed"], "left").join(F.broadcast(total))
    beyond = F.col("_all") - F.col("_u_b")
    within = [F.col(f"_u_w{i}") - F.col("_u_b") for i in range(len(horizons))]
    p = S.monotone(F.array(*S.empirical_duration_probs(beyond, within)), len(horizons))
    return j.withColumn("p", p).select(*rows.columns, "p")


def constant_reference(train: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    rates = train.agg(*[F.avg(F.element_at("y", i + 1)).alias(f"_r{i}") for i in range(width)])
    p = S.monotone(F.array(*[F.col(f"_r{i}") for i in range(width)]), width)
    return rows.join(F.broadcast(rates)).withColumn("p", p).select(*rows.columns, "p")


def average_reference(train: DataFrame, rows: DataFrame, horizons: Sequence[float]) -> DataFrame:
    j = rows.join(F.broadcast(average_duration(train)))
    p = S.average_duration_probs(F.col("avg_s"), F.col("elapsed"), horizons)
    return j.withColumn("p", S.monotone(p, len(horizons))).select(*rows.columns, "p")


def controls(rows: DataFrame, width: int = 7) -> DataFrame:
    """Always-warn and never-warn forecasts for every row."""
    both = F.array(
        F.struct(F.lit("always").alias("model"), F.array_repeat(F.lit(1.0), width).alias("p")),
        F.struct(F.lit("never").alias("model"), F.array_repeat(F.lit(0.0), width).alias("p")),
    )
    return rows.select(*rows.columns, F.explode(both).alias("_c")).select(*rows.columns, "_c.model", "_c.p")


# --- fitting -----------------------------------------------------------------------
@dataclass
class Fitted:
    """A fitted score with its calibration for one horizon."""

    family: str
    constant: float | None = None
    pipeline: PipelineModel | None = None
    slope: float | None = None
    intercept: float | None = None
    calibrated_constant: float | None = None
    facts: dict = field(default_factory=dict)

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Adds the raw (log-odds) score."""
        if self.constant is not None:
            return df.withColumn(name, S.safe_logit(F.lit(self.constant)))
        out = self.pipeline.transform(df)
        raw = vector_to_array(F.col("rawPrediction"))[1]
        return out.withColumn(name, raw).select(*df.columns, name)

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        if self.calibrated_constant is not None:
            return df.withColumn(name, F.lit(self.calibrated_constant))
        scored = self.score(df, "_z")
        if self.slope is not None:
            z = F.col("_z") * self.slope + self.intercept
        elif self.constant is not None:
            return df.withColumn(name, F.lit(self.constant))
        else:
            # A boosted margin stands for half the log-odds.
            z = F.col("_z") * (2.0 if self.family == "tree" else 1.0)
        return scored.withColumn(name, 1.0 / (1.0 + F.exp(-z))).select(*df.columns, name)


def _label_facts(train: DataFrame, label: Column, weight: Column) -> tuple[float, float]:
    r = train.agg(F.sum(weight).alias("n"), F.sum(label * weight).alias("pos")).first()
    return float(r.n or 0), float(r.pos or 0)


def fit(
    train: DataFrame, features: str, label: Column, family: str = "logistic", c: float = 0.1, balanced: bool = False,
    weight: Column | None = None, trees: int = 80, seed: int = 42,
) -> Fitted:
    """Fit one horizon; a single class gives a constant.

    ``weight`` multiplies rows (bootstrap multiplicity).  The logistic family drops
    constant features, standardises, and is regularised by 1 / (C n).
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    n, pos = _label_facts(train, label.cast("double"), w)
    if n == 0 or pos in (0.0, n):
        return Fitted(family, constant=pos / n if n else 0.0)
    y = label.cast("double")
    if balanced:
        w = w * F.when(label == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    data = train.select(array_to_vector(F.transform(F.col(features), lambda v: v.cast("double"))).alias("_x"), y.alias("_y"), w.alias("_w"))
    if family == "tree":
        stages = [
            GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=3, minInstancesPerNode=40, stepSize=0.05, seed=seed)
        ]
    else:
        stages = [
            VarianceThresholdSelector(featuresCol="_x", outputCol="_v", varianceThreshold=1e-10),
            StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
            LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), maxIter=100),
        ]
    return Fitted(family, pipeline=Pipeline(stages=stages).fit(data))


def vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.transform(F.col(features), lambda v: v.cast("double"))))


def calibrate(model: Fitted, cal: DataFrame, label: Column, c: float = 1.0) -> Fitted:
    """Fit probability = sigmoid(a z + b) on calibration rows; one class gives a constant."""
    n, pos = _label_facts(cal, label.cast("double"), F.lit(1.0))
    if n == 0:
        return model
    if pos in (0.0, n):
        model.calibrated_constant = pos / n
        return model
    z = model.score(cal, "_zc").select(array_to_vector(F.array("_zc")).alias("_x"), label.cast("double").alias("_y"))
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), standardization=False).fit(z)
    model.slope, model.intercept = float(lr.coefficients[0]), float(lr.intercept)
    return model


def linear_score(x: Column, coefficients: Sequence[float], intercept: float) -> Column:
    """Dot product as one expression."""
    products = F.zip_with(x, F.array(*[F.lit(float(v)) for v in coefficients]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + intercept


def together(jobs: Sequence[Callable[[], Any]], parallelism: int = 8) -> list:
    """Independent fits submitted from a few driver threads, so their small jobs share the cluster."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(j) for j in jobs]))


def fit_horizons(
    train: DataFrame, cal: DataFrame, features: str, horizons: int, family: str = "logistic", weight: Column | None = None,
    **options,
) -> list[Fitted]:
    """One calibrated model per horizon from (features, y) rows."""
    train, cal = vectors(train, features), vectors(cal, features)

    def one(h: int) -> Fitted:
        y = F.element_at("y", h + 1)
        return calibrate(fit(train, features, y, family, weight=weight, **options), cal, y)

    return together([partial(one, h) for h in range(horizons)])


def predict_horizons(models: Sequence[Fitted], rows: DataFrame, features: str, name: str = "p") -> DataFrame:
    out = vectors(rows, features)
    names = [f"_p{h}" for h in range(len(models))]
    for n, m in zip(names, models):
        out = m.probability(out, n)
    return out.withColumn(name, S.monotone(F.array(*names), len(models))).select(*rows.columns, name)


def fit_ensemble(
    train: DataFrame, cal: DataFrame, features: str, horizons: int, members: int = 5, seed: int = 41, **options
) -> list[list[Fitted]]:
    """Members fitted on bootstrap draws of whole runs: a drawn run weighs as often as drawn."""
    runs = train.select("run").distinct()
    line = Timeline((), ("run",), "run", 1000)
    numbered = running(runs, line, sums={"_k": F.lit(1).cast("long")}).select("run", (F.col("_k") - 1).alias("pos"))
    out = []
    for m in range(members):
        mult = bootstrap_multiplicity(numbered, seed + m)
        drawn = train.join(mult, "run")
        out.append(fit_horizons(drawn, cal, features, horizons, weight=F.col("multiplicity"), balanced=True, c=1.0, **options))
    return out


def member_predictions(ensemble: Sequence[Sequence[Fitted]], rows: DataFrame, features: str) -> DataFrame:
    """(row columns, member, p): every member's monotone forecast of every row."""
    parts = [predict_horizons(models, rows, features).withColumn("member", F.lit(i)) for i, models in enumerate(ensemble)]
    return reduce(DataFrame.unionByName, parts)


# --- scoring -----------------------------------------------------------------------
def score_members(members: DataFrame, keys: Sequence[str], horizons: Sequence[float] = HORIZONS, width: int | None = None) -> DataFrame:
    """Median forecast with uncertainty from the members of each row.

    Adds ``p`` (monotone median), remaining, low / high (10 % and 90 % of the members'
    remaining time) and disagreement (mean over horizons of the members' std).
    """
    width = width or len(horizons)
    listed = members.groupBy(*keys).agg(F.collect_list("p").alias("_m"))
    column = lambda i: F.transform("_m", lambda p: F.element_at(p, i + 1))
    left = F.array_sort(F.transform("_m", lambda p: S.expected_remaining(p, horizons)))
    spread = [_deviation(column(i)) for i in range(width)]
    scored = listed.select(
        *keys,
        F.array(*[S.array_quantile(F.array_sort(column(i)), 0.5) for i in range(width)]).alias("_q"),
        left.alias("_left"),
        (sum(spread[1:], spread[0]) / width).alias("disagreement"),
    ).withColumn("p", S.monotone(F.col("_q"), width))
    return scored.select(
        *keys, "p", S.array_quantile(F.col("_left"), 0.1).alias("low"), S.array_quantile(F.col("_left"), 0.9).alias("high"), "disagreement",
        S.expected_remaining(F.col("p"), horizons).alias("remaining"),
    )


def _deviation(a: Column) -> Column:
    """Population standard deviation of a short array."""
    return F.transform(
        F.array(S.array_sum(a) / F.size(a)),
        lambda m: F.sqrt(S.array_sum(F.transform(a, lambda v: (v - m) * (v - m))) / F.size(a)),
    )[0]


def certainty_contract(scored: DataFrame, cap: float = 60.0, high_limit: float = 7.0, medium_limit: float = 15.0) -> DataFrame:
    """Disagreement thresholds (33 % / 67 %), the error of each tier, and which tiers may be shown."""
    q = exact_quantiles(scored, F.col("disagreement"), {"high": 0.33, "medium": 0.67}).select("high", "medium")
    err = F.abs(F.col("remaining") - F.least(F.col("ttf"), F.lit(float(cap))))
    tier_high = F.col("disagreement") <= F.col("high")
    tier_medium = ~tier_high & (F.col("disagreement") <= F.col("medium"))
    return (
        scored.select("disagreement", "remaining", "ttf").join(F.broadcast(q))
        .groupBy("high", "medium")
        .agg(F.avg(F.when(tier_high, err)).alias("high_mae"), F.avg(F.when(tier_medium, err)).alias("medium_mae"))
        .withColumn("high_enabled", F.coalesce(F.col("high_mae") <= high_limit, F.lit(False)))
        .withColumn(
            "medium_enabled",
            F.coalesce(
                (F.col("medium_mae") <= medium_limit) & (~F.col("high_enabled") | (F.col("high_mae") < F.col("medium_mae"))),
                F.lit(False),
            ),
        )
    )


def postmortem(preds: DataFrame, width: int = 7) -> DataFrame:
    """Per run: Brier, mean probability per horizon, largest gap to an independent recomputation ``q``."""
    gap = F.array_max(F.zip_with("p", "q", lambda a, b: F.abs(a - b)))
    squares = F.aggregate(F.zip_with("p", "y", lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda s, x: s + x) / width
    return preds.groupBy("run").agg(
        F.avg(squares).alias("brier"),
        *[F.avg(F.element_at("p", i + 1)).alias(f"mean_p{i}") for i in range(width)],
        F.max(gap).alias("largest_gap"),
    )


def run_grid(
    windows: DataFrame, groups: dict[str, Sequence[int]], families: Sequence[str], horizons: int,
    folds: Sequence[tuple[int, int, int]] = FOLDS, **options,
) -> DataFrame:
    """Out-of-fold forecasts of every (feature group, family) candidate.

    ``windows`` has run, x (features), y and identifying columns.  The loop only
    chooses what to fit; all rows stay distributed.
    """
    parts = []
    for i, (a, b, c) in enumerate(folds, 1):
        run = F.col("run")
        for group, index in groups.items():
            data = windows.withColumn("_g", F.array(*[F.element_at("x", k + 1) for k in index]))
            train, cal = data.where(run <= a), data.where((run > a) & (run <= b))
            test = data.where((run > b) & (run <= c))
            for family in families:
                models = fit_horizons(train, cal, "_g", horizons, family, **options)
                p = predict_horizons(models, test, "_g").drop("_g")
                parts.append(p.withColumn("fold", F.lit(i)).withColumn("candidate", F.lit(f"{group}_{family}")))
    return reduce(DataFrame.unionByName, parts)


def freeze(models: Sequence[Fitted], path: str, facts: dict) -> DataFrame:
    """Write the refitted winner and its registry row; it is never eligible for live use by itself."""
    import hashlib

    pieces = []
    for h, m in enumerate(models):
        if m.pipeline is not None:
            m.pipeline.write().save(f"{path}/horizon-{h}")
        pieces.append(f"{m.family}|{m.constant}|{m.slope}|{m.intercept}|{m.calibrated_constant}")
    spark = SparkSession.getActiveSession()
    row = {"path": path, "horizons": len(models), "eligible_for_live": False, "sha256": hashlib.sha256("\n".join(pieces).encode()).hexdigest(), **facts}
    df = spark.createDataFrame([row])
    df.write.mode("errorifexists").parquet(f"{path}/registry")
    return spark.read.parquet(f"{path}/registry")

