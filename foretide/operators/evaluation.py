"""Forecast evaluation: errors, calibration, baselines, bootstrap, gates, audits.

Long prediction tables have one row per prediction and horizon with ``h``, ``p``
(monotone probability) and ``y``; wide ones hold arrays ``m`` and ``y`` plus ``ttf``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators.aggregates import exact_quantiles
from foretide.operators.timeline import Timeline, by_depth, row_numbers, running
from foretide.settings import LOCKED_TEST_RUNS, TARGET_RUNS, materialise


def brier(long_df: DataFrame, keys: Sequence[str] = ("h",)) -> DataFrame:
    return long_df.groupBy(*keys).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def auroc(long_df: DataFrame, keys: Sequence[str] = ("h",)) -> DataFrame:
    """Rank-sum area under the ROC curve, ties averaged; .5 with a single class.

    Equal probabilities are merged first, then negatives below are accumulated over
    cells with about equally many probabilities: no ordering of all rows in one task.
    """
    by_p = long_df.groupBy(*keys, "p").agg(
        F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg")
    )
    celled, line = by_depth(by_p, tuple(keys), "p", "auroc")
    below = running(celled, line, sums={"neg_below": F.col("neg")}, inclusive=False)
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos") * F.sum("neg")
    return below.groupBy(*keys).agg(F.when(pairs > 0, area / pairs).otherwise(0.5).alias("auroc"))


def probability_bin(p: Column, bins: int = 10) -> Column:
    """0..bins-1 by edges k * (1 / bins), as doubles (ten bins: the third starts at 0.30000000000000004); 1.0 falls into the last."""
    out = F.lit(0)
    for k in range(1, bins):
        out = F.when(p >= F.lit(k * (1.0 / bins)), F.lit(k)).otherwise(out)
    return out


def ece(long_df: DataFrame, keys: Sequence[str] = ("h",), bins: int = 10) -> DataFrame:
    """Expected calibration error with equal-width bins, weighted by bin share."""
    b = long_df.groupBy(*keys, probability_bin(F.col("p"), bins).alias("_bin")).agg(
        F.count("*").alias("_n"), F.sum("y").alias("_y"), F.sum("p").alias("_p")
    )
    return b.groupBy(*keys).agg((F.sum(F.abs(F.col("_y") - F.col("_p"))) / F.sum("_n")).alias("ece"))


def weighted_ece(long_df: DataFrame, entity: str, keys: Sequence[str] = ("h",), bins: int = 10) -> DataFrame:
    """Calibration error with every entity weighing the same."""
    per = long_df.groupBy(entity, *keys, probability_bin(F.col("p"), bins).alias("_bin")).agg(
        F.count("*").alias("_n"), F.sum("y").alias("_y"), F.sum("p").alias("_p")
    )
    sizes = per.groupBy(entity, *keys).agg(F.sum("_n").alias("_rows"))
    runs = sizes.groupBy(*keys).agg(F.count("*").alias("_runs"))
    binned = (
        per.join(sizes, [entity, *keys]).groupBy(*keys, "_bin")
        .agg(F.sum((F.col("_y") - F.col("_p")) / F.col("_rows")).alias("_d"))
    )
    return binned.join(runs, list(keys)).groupBy(*keys).agg((F.sum(F.abs("_d")) / F.max("_runs")).alias("weighted_ece"))


def strongest_baseline(model: DataFrame, baselines: DataFrame) -> DataFrame:
    """Best reference per horizon and relative improvement over it (0 for a perfect reference).

    ``model`` has h, brier; ``baselines`` name, h, brier; ties go to the first name.
    """
    best = baselines.groupBy("h").agg(F.min(F.struct("brier", "name")).alias("_b"))
    return model.join(best, "h").select(
        "h", "brier", F.col("_b.name").alias("strongest"), F.col("_b.brier").alias("strongest_brier"),
        F.coalesce(F.try_divide(F.col("_b.brier") - F.col("brier"), F.col("_b.brier")), F.lit(0.0)).alias("improvement"),
    )


def time_mae(preds: DataFrame, cap: float = 60.0, near: float = 10.0, mid: float = 30.0, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute time error over ttf <= cap, near and mid; ``cap`` where no row applies."""
    err = F.abs(F.col("remaining") - F.least(F.col("ttf"), F.lit(float(cap))))
    part = lambda lim: F.coalesce(F.avg(F.when(F.col("ttf") <= lim, err)), F.lit(float(cap)))
    return preds.groupBy(*keys).agg(part(cap).alias("mae"), part(near).alias("final_near_mae"), part(mid).alias("final_mid_mae"))


def warning_metrics(preds: DataFrame, leads: DataFrame, useful: float = 15.0) -> DataFrame:
    """Window accuracy, early false warnings, useful rate and median lead in one row."""
    acc = preds.agg(F.avg((F.col("predicted_class") == F.col("actual_class")).cast("double")).alias("window_accuracy"))
    lead = leads.agg(
        F.coalesce(F.avg((F.col("lead") >= useful).cast("double")), F.lit(0.0)).alias("useful_rate"),
        F.coalesce(F.sum("false_early"), F.lit(0)).alias("false_early"),
    )
    middle = exact_quantiles(leads, F.col("lead"), {"median_lead": 0.5}).drop("median_lead_element")
    return acc.join(F.broadcast(lead)).join(F.broadcast(middle), how="left")


def promotion_gates(metrics: DataFrame) -> DataFrame:
    """Nine promotion gates per row; a missing metric fails its gate.

    Columns: total_runs, evaluated_runs, brier_vs_elapsed, brier_vs_average,
    mae_vs_elapsed, mae_vs_average, useful_rate, worst_ece, final10_mae,
    elapsed_final10_mae, latency_p95.
    """
    c = lambda n, d: F.coalesce(F.col(n).cast("double"), F.lit(float(d)))
    gates = {
        "locked_test": (c("total_runs", 0) >= TARGET_RUNS) & (c("evaluated_runs", 0) == LOCKED_TEST_RUNS),
        "brier_elapsed": c("brier_vs_elapsed", 0) >= 0.10,
        "brier_average": c("brier_vs_average", 0) >= 0.10,
        "time_elapsed": c("mae_vs_elapsed", 0) >= 0.10,
        "time_average": c("mae_vs_average", 0) >= 0.10,
        "useful_warning": c("useful_rate", 0) >= 0.50,
        "calibration": c("worst_ece", 1) <= 0.12,
        "final_ten": c("final10_mae", 60) <= 1.10 * c("elapsed_final10_mae", 60),
        "latency": c("latency_p95", "inf") < 500.0,
    }
    out = metrics
    for n, g in gates.items():
        out = out.withColumn(f"gate_{n}", g)
    eligible = F.lit(True)
    for n in gates:
        eligible = eligible & F.col(f"gate_{n}")
    return out.withColumn("eligible", eligible)


def survival_metrics(
    model: DataFrame, references: DataFrame, warnings: DataFrame, horizons: Sequence[float], cap: float = 60.0, near: float = 10.0,
    elapsed: str = "elapsed_time_only", average: str = "average_duration",
) -> DataFrame:
    """One row of the figures that :func:`promotion_gates` reads, from a model's forecasts and its references'.

    ``model`` has run, ttf, p and y (one entry per horizon), ``references`` also a ``name``;
    ``warnings`` is the row of :func:`warning_metrics`.  A reference that is absent, or an error
    of 0, gives no improvement figure at all: null, which fails its gate.  Both tables are
    aggregated once to a row per name.
    """
    n = len(horizons)
    columns = ["name", "run", "ttf", "p", "y"]
    rows = model.withColumn("name", F.lit("")).select(*columns).unionByName(references.where(F.col("name").isin(elapsed, average)).select(*columns))
    p = S.monotone(F.col("p"), n)
    squares = F.aggregate(F.zip_with("p", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v) / n
    rows = rows.withColumn("p", p).withColumn("remaining", S.expected_remaining(F.col("p"), horizons)).withColumn("_s", squares)
    err = F.abs(F.col("remaining") - F.least(F.col("ttf"), F.lit(float(cap))))
    # A run may own a third of the rows: runs are counted from one partial row per run.
    per = rows.groupBy("name", "run").agg(
        F.sum("_s").alias("_s"), F.count("_s").alias("_n"), *[F.sum(F.when(F.col("ttf") <= lim, err)).alias(f"_e{i}") for i, lim in enumerate((cap, near))],
        *[F.count(F.when(F.col("ttf") <= lim, err)).alias(f"_c{i}") for i, lim in enumerate((cap, near))],
    )
    ratio = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    named = per.groupBy("name").agg(
        ratio("_s", "_n").alias("brier"), F.coalesce(ratio("_e0", "_c0"), F.lit(float(cap))).alias("mae"),
        F.coalesce(ratio("_e1", "_c1"), F.lit(float(cap))).alias("near_mae"), F.count("*").alias("runs"),
    )
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    better = lambda name, c: F.try_divide(of(name, c) - of("", c), of(name, c))
    wide = named.agg(
        of("", "runs").alias("evaluated_runs"), better(elapsed, "brier").alias("brier_vs_elapsed"), better(average, "brier").alias("brier_vs_average"),
        better(elapsed, "mae").alias("mae_vs_elapsed"), better(average, "mae").alias("mae_vs_average"), of("", "near_mae").alias("final10_mae"),
        of(elapsed, "near_mae").alias("elapsed_final10_mae"),
    )
    each = model.select(F.posexplode(F.arrays_zip(S.monotone(F.col("p"), n).alias("p"), F.col("y").alias("y"))).alias("h", "_v")).select("h", "_v.p", "_v.y")
    worst = ece(each).agg(F.max("ece").alias("worst_ece"))
    return wide.join(F.broadcast(worst)).join(F.broadcast(warnings.select("useful_rate")))


def per_run_metrics(preds: DataFrame, run: str, cap: float = 60.0, near: float = 10.0) -> DataFrame:
    """Mean Brier, time errors, early-warning fraction and first warning of each run.

    ``preds`` has m, y, ttf, remaining and ``alarm``; runs without rows in the last
    ``near`` seconds get null (see :func:`require_coverage`).
    """
    squares = F.aggregate(
        F.zip_with("m", "y", lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda s, x: s + x
    ) / F.size("m")
    err = F.abs(F.col("remaining") - F.col("ttf"))
    early = F.col("ttf") > cap
    return preds.groupBy(run).agg(
        F.avg(squares).alias("brier"),
        F.avg(F.when(F.col("ttf") <= cap, err)).alias("mae"),
        F.avg(F.when(F.col("ttf") <= near, err)).alias("final_near_mae"),
        F.coalesce(F.avg(F.when(early, F.col("alarm").cast("double"))), F.lit(0.0)).alias("false_warning_fraction"),
        F.max(F.when(F.col("alarm"), F.col("ttf"))).alias("first_warning_lead"),
    )


def require_coverage(per_run: DataFrame) -> None:
    if not per_run.where(F.col("mae").isNull() | F.col("final_near_mae").isNull()).isEmpty():
        raise ValueError("a run lacks coverage of its final stretch")


def screen(result: DataFrame, baselines: DataFrame, folds: DataFrame, coverage: DataFrame) -> DataFrame:
    """Eight screening gates per candidate.

    ``result``: candidate, brier, mae, final10, worst_ece, recall, false_per_minute.
    ``baselines``: name, brier, mae, final10.  ``folds``: candidate, fold, brier, mae,
    base_name, base_brier, base_mae.  ``coverage``: coverage.
    """
    b = baselines.agg(F.min("brier").alias("b_brier"), F.min("mae").alias("b_mae"), F.min("final10").alias("b_final"))
    wins = (
        folds.groupBy("candidate", "fold")
        .agg(F.bool_and((F.col("brier") < F.col("base_brier")) & (F.col("mae") < F.col("base_mae"))).alias("_won"))
        .groupBy("candidate").agg(F.count(F.when(F.col("_won"), 1)).alias("folds_won"))
    )
    cov = coverage.agg(F.min("coverage").alias("min_coverage"))
    j = result.join(wins, "candidate", "left").join(F.broadcast(b)).join(F.broadcast(cov))
    gates = {
        "probability": F.col("brier") <= 0.9 * F.col("b_brier"),
        "time": F.col("mae") <= 0.9 * F.col("b_mae"),
        "folds": F.coalesce("folds_won", F.lit(0)) >= 2,
        "final_ten": F.col("final10") <= 1.1 * F.col("b_final"),
        "calibration": F.col("worst_ece") <= 0.12,
        "timely": F.col("recall") >= 0.6,
        "false_alarms": F.col("false_per_minute") <= 0.2,
        "coverage": F.coalesce(F.col("min_coverage") >= 0.95, F.lit(False)),
    }
    out = j.select("candidate", "brier", "mae", *[g.alias(n) for n, g in gates.items()])
    qualifies = F.lit(True)
    for n in gates:
        qualifies = qualifies & F.col(n)
    return out.withColumn("qualifies", qualifies)


def rank_candidates(screened: DataFrame) -> DataFrame:
    """Best qualifying candidate by (brier, mae), or none."""
    return screened.where("qualifies").orderBy("brier", "mae").limit(1)


# --- deterministic draws and bootstrap ----------------------------------------------
# Multiplicative congruential generator, products stay below 2**63.
LCG_A = 48_271
LCG_M = 2_147_483_647


def draw(seed: Column, n: Column) -> Column:
    """Pseudo-random position 0..n-1 for a positive seed, equal in every SQL engine."""
    x = seed % LCG_M
    for _ in range(3):
        x = (x * LCG_A + 11) % LCG_M
    return (x % n).cast("long")


def bootstrap_multiplicity(runs: DataFrame, seed: int, run: str = "run") -> DataFrame:
    """How often each run (numbered 0..n-1 in ``pos``) is drawn when n are drawn with replacement.

    Runs never drawn are absent: a left join with 0 gives the weight of every row.
    """
    n = runs.agg(F.count("*").alias("_n"))
    draws = runs.join(F.broadcast(n)).select(draw(F.col("pos") * 7919 + seed * 104_729 + 1, F.col("_n")).alias("pos"))
    counts = draws.groupBy("pos").agg(F.count("*").alias("multiplicity"))
    return runs.join(counts, "pos").select(run, "multiplicity")


def resample_means(pos: DataFrame, n: int, metrics: Sequence[str], seed: int, resamples: int, most: int = 1_000_000) -> DataFrame:
    """(resample, one mean per metric): n values drawn with replacement, ``resamples`` times; nulls are left out.

    ``pos`` has ``pos`` 0..n-1 and the metrics.  Draws follow from a rule, so they are no rows:
    every task takes a range of draws and adds the values they hit into one array per
    metric, and only these arrays are merged.  At most ``most`` values are with the tasks
    at a time; more are gone through in blocks, each of which adds the draws that fall into it.
    """
    spark = pos.sparkSession
    schema = "resample long, " + ", ".join(f"`{m}` double, `_n_{m}` long" for m in metrics)
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 256))

    def added(low: int, values):
        def run(batches):
            total, met = np.zeros((len(metrics), resamples)), np.zeros((len(metrics), resamples), np.int64)
            block, rows = values.value, np.arange(resamples, dtype=np.int64)[:, None] * 1009 + seed * 104_729 + 1
            for batch in batches:
                for at in range(0, len(batch), 256):
                    x = (rows + batch["id"].to_numpy(np.int64)[None, at : at + 256] * 7919) % LCG_M
                    for _ in range(3):
                        x = (x * LCG_A + 11) % LCG_M
                    x = x % n - low
                    hit = (x >= 0) & (x < block.shape[1])
                    for i in range(len(metrics)):
                        drawn = np.where(hit, block[i][np.where(hit, x, 0)], np.nan)
                        total[i] += np.nansum(drawn, axis=1)
                        met[i] += (~np.isnan(drawn)).sum(axis=1)
            columns = {name: v for i, m in enumerate(metrics) for name, v in ((m, total[i]), (f"_n_{m}", met[i]))}
            yield pd.DataFrame({"resample": np.arange(resamples), **columns})

        return run

    parts = []
    for low in range(0, max(n, 1), most):
        # At most ``most`` rows of a few numbers.
        held = pos.where(F.col("pos").between(low, low + most - 1)).select("pos", *metrics).toPandas().sort_values("pos")
        values = spark.sparkContext.broadcast(held[list(metrics)].to_numpy(float).T)
        parts.append(spark.range(0, n, numPartitions=tasks).mapInPandas(added(low, values), schema))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("resample").agg(*[F.try_divide(F.sum(m), F.sum(f"_n_{m}")).alias(m) for m in metrics])


def paired_intervals(a: DataFrame, b: DataFrame, metrics: Sequence[str], seed: int = 1, resamples: int = 5000) -> DataFrame:
    """Paired bootstrap over runs: improvement, 95 % interval, runs won, per metric.

    ``a`` and ``b`` hold run and metrics.  Every run contributes one draw to each
    resample; see :func:`resample_means`.
    """
    pair = a.select("run", *[F.col(m).alias(f"a_{m}") for m in metrics]).join(
        b.select("run", *[F.col(m).alias(f"b_{m}") for m in metrics]), "run"
    )
    pair = materialise(pair, "paired-runs")
    n = pair.count()
    numbered = row_numbers(pair, Timeline((), ("run",), "run", 10_000), "_rn")
    gains = numbered.select((F.col("_rn") - 1).alias("pos"), *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(m) for m in metrics])
    means = resample_means(gains, n, metrics, seed, resamples)
    bounds = means.agg(
        *[F.percentile(m, q).alias(f"{m}_{n_}") for m in metrics for q, n_ in ((0.025, "lo"), (0.975, "hi"))]
    )
    facts = pair.agg(
        *[(F.avg(f"b_{m}") - F.avg(f"a_{m}")).alias(f"{m}_gain") for m in metrics],
        *[F.count(F.when(F.col(f"a_{m}") < F.col(f"b_{m}"), 1)).alias(f"{m}_won") for m in metrics],
        F.count("*").alias("_runs"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"{m}_gain").alias("improvement"), F.col(f"{m}_lo").alias("low"),
                F.col(f"{m}_hi").alias("high"), F.col(f"{m}_won").alias("runs_won"), F.col("_runs").alias("runs"),
            )
            for m in metrics
        ]
    )
    return facts.join(F.broadcast(bounds)).select(F.explode(rows).alias("_r")).select("_r.*")


# --- audit decisions -----------------------------------------------------------------
def timing_reasons(rows: DataFrame, widest: float = 0.25) -> DataFrame:
    """Adds ``reason`` (null when the reviewed interval is precise enough) and ``pending``."""
    lo, hi = F.col("lo"), F.col("hi")
    wild = F.isnan(lo) | F.isnan(hi) | (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    reason = (
        F.when(~F.coalesce("reviewed", F.lit(False)), "not_visually_reviewed")
        .when(lo.isNull() & hi.isNull(), "visible_loss_transition_missing")
        .when(lo.isNull() | hi.isNull() | wild, "invalid_loss_interval")
        .when((hi <= lo) | (hi - lo > widest + 1e-9), "loss_uncertainty_exceeds_0.25_seconds")
    )
    aligned = F.coalesce(F.col("alignment_verified") & F.col("alignment_bound").between(0, 0.5), F.lit(False))
    return rows.withColumn("reason", reason).withColumn("pending", ~aligned)


def timing_gate(rows: DataFrame, lo: int = 1, hi: int = 30) -> DataFrame:
    """One row: status, failures, pending runs; never allows forecasting by itself."""
    judged = timing_reasons(rows)
    per = judged.groupBy("run").agg(
        F.count("*").alias("_n"), F.count("reason").alias("_bad"), F.count(F.when(F.col("pending"), 1)).alias("_pend")
    )
    facts = per.agg(
        F.coalesce(
            (F.count("*") == hi - lo + 1) & (F.max("_n") == 1) & (F.min("run") == lo) & (F.max("run") == hi), F.lit(False)
        ).alias("complete"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("failures"),
        F.coalesce(F.sum("_pend"), F.lit(0)).alias("pending_runs"),
    )
    status = (
        F.when(~F.col("complete"), "incomplete_review")
        .when(F.col("failures") > 0, "closed_timing_failure")
        .when(F.col("pending_runs") > 0, "pending_alignment")
        .otherwise("timing_passed")
    )
    return facts.withColumn("status", status).withColumn("forecasting_allowed", F.lit(False))


def require_timing(rows: DataFrame, lo: int = 1, hi: int = 30) -> DataFrame:
    gate = timing_gate(rows, lo, hi)
    if not gate.first().complete:
        raise ValueError(f"the review must hold each run {lo}..{hi} exactly once")
    return gate


def alignment_gate(checks: DataFrame, margin: float = 0.15, allowed: float = 0.5) -> DataFrame:
    ok = ~F.coalesce("search_edge", F.lit(True)) & (F.abs(F.coalesce("offset_s", F.lit(1.0))) + margin <= allowed)
    return checks.agg(
        F.count("*").alias("checks"), F.count(F.when(~ok, 1)).alias("failing"),
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("passed"),
    )


def audit_decision(frames: DataFrame, issues: DataFrame, alignment: DataFrame, need: float = 0.9) -> DataFrame:
    """Optimistic upper bound on correct frames and the resulting status.

    ``frames``: id; ``issues``: id, kind (incorrect / uncertain); ``alignment`` as in
    :func:`alignment_gate`.
    """
    n = frames.agg(F.count("*").alias("reviewed"))
    bad = issues.agg(
        F.count("*").alias("issues"),
        F.count(F.when(F.col("kind") == "incorrect", 1)).alias("incorrect"),
        F.count(F.when(F.col("kind") == "uncertain", 1)).alias("uncertain"),
    )
    gate = alignment_gate(alignment).select(F.col("passed").alias("alignment_passed"), F.col("checks").alias("alignment_checks"))
    j = n.join(F.broadcast(bad)).join(F.broadcast(gate))
    bound = (F.col("reviewed") - F.col("issues")) / F.col("reviewed")
    failed = F.col("alignment_passed") & (bound < need)
    return j.withColumn("upper_bound", bound).withColumn(
        "status", F.when(failed, "closed_extraction_failure").otherwise("not_approved")
    ).withColumn("forecasting_allowed", F.lit(False))


def measurement_gate(summary: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Gates over one summary row: true/false positives and negatives, rates, coverage."""
    c = F.col
    gates = {
        "enough_events": c("true_positive") + c("false_negative") >= limits["events"],
        "enough_negative_time": c("negative_seconds") >= limits["negative_seconds"],
        "precision_ok": c("precision") >= limits["precision"],
        "recall_ok": c("recall") >= limits["recall"],
        "false_rate_ok": F.coalesce(c("false_per_minute") <= limits["false_per_minute"], F.lit(False)),
        "coverage_ok": c("supported_share") >= limits["coverage"],
        "ambiguity_ok": c("ambiguous_share") <= limits["ambiguous"],
    }
    out = summary
    for n, g in gates.items():
        out = out.withColumn(n, g)
    passed = F.lit(True)
    for n in gates:
        passed = passed & F.col(n)
    return out.withColumn("passed", passed)


def verify_provenance(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Sources whose hash is missing or differs: (key, problem)."""
    j = manifest.select(key, F.col("sha256").alias("_want")).join(files.select(key, F.col("sha256").alias("_got")), key, "left")
    problem = F.when(F.col("_got").isNull(), "missing").when(F.col("_got") != F.col("_want"), "changed")
    return j.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(key, "problem")


def assert_provenance(manifest: DataFrame, files: DataFrame, key: str) -> None:
    first = verify_provenance(manifest, files, key).orderBy(key).first()
    if first:
        raise ValueError(f"source {first[0]}: {first[1]}")


def same_frames(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per clip: frame counts of two decodings and whether all hashes agree by index."""
    x, y = a.select(*keys, "idx", F.col("hash").alias("_a")), b.select(*keys, "idx", F.col("hash").alias("_b"))
    j = x.join(y, [*keys, "idx"], "full")
    return j.groupBy(*keys).agg(
        F.count("_a").alias("frames_a"), F.count("_b").alias("frames_b"),
        F.bool_and(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("same"),
    )


def report_table(results: DataFrame, key: str, decimals: dict[str, int]) -> DataFrame:
    """Figures as text with fixed decimals."""
    return results.select(key, *[F.format_number(F.col(c).cast("double"), d).alias(c) for c, d in decimals.items()])
