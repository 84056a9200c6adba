"""Run quality rules, cohort predicates, input constraints and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators.timeline import (
    Timeline,
    drop_halo,
    previous_row,
    row_numbers,
    running,
    with_earlier_rows,
)
from foretide.settings import COHORT, DEVELOPMENT_RUNS, LEGACY, TARGET_RUNS


def run_quality(
    df: DataFrame,
    min_active_ms: int = 8_000,
    min_frames: int = 28,
    min_coverage: float = 0.75,
    frame_ms: int = 250,
) -> DataFrame:
    """First failing rule decides; adds expected count, coverage, reason and verdict.

    ``active_duration_ms`` is the greater of the reported and the observed clock
    when a ``reported_ms`` column is present.
    """
    if "reported_ms" in df.columns:
        df = df.withColumn("active_duration_ms", F.greatest("reported_ms", "active_duration_ms"))
    expected = F.greatest(F.lit(1), S.round_even(F.col("active_duration_ms") / frame_ms).cast("long"))
    good = F.lit("usable personal run")
    reason = (
        F.when(F.col("end_reason") != "game_over", F.concat(F.lit("excluded: "), "end_reason"))
        .when(F.col("active_duration_ms") < min_active_ms, "excluded: fewer than eight active seconds")
        .when(F.col("valid_frame_count") < min_frames, "excluded: insufficient valid frames")
        .when(F.col("coverage") < min_coverage, f"excluded: capture coverage below {round(min_coverage * 100)}%")
        .otherwise(good)
    )
    return (
        df.withColumn("expected_frame_count", expected)
        .withColumn("coverage", F.least(F.lit(1.0), F.col("valid_frame_count") / F.col("expected_frame_count")))
        .withColumn("quality_reason", reason)
        .withColumn("usable", F.col("quality_reason") == good)
    )


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reject_reason``: name of the first rule that is false or null, else null."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        reason = F.when(F.coalesce(rule, F.lit(False)), reason).otherwise(F.lit(name))
    return df.withColumn("reject_reason", reason)


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    judged = validate(df, rules)
    return judged.where(F.col("reject_reason").isNull()).drop("reject_reason"), judged.where(
        F.col("reject_reason").isNotNull()
    )


# Input constraints of the capture records.
def frame_rules() -> dict[str, Column]:
    return {
        "timestamp": F.col("ts_ms") > 0,
        "active_elapsed": F.col("active_ms") >= 0,
        "motion": F.col("motion").between(0, 255),
    }


def canvas_rules() -> dict[str, Column]:
    return {
        "width": (F.col("width") > 0) & (F.col("width") <= 8192),
        "height": (F.col("height") > 0) & (F.col("height") <= 8192),
    }


def legacy_quality(
    obs: DataFrame,
    line: Timeline,
    min_rows: int = 32,
    min_span_ms: int = 8_000,
    max_gap_ms: int = 1_000,
    low_motion: float = 0.6,
    streak: int = 8,
    tail: int = 12,
) -> DataFrame:
    """Verdict per run from its observations, first failing rule wins.

    ``streak`` low-motion rows in a row is a bounded ROWS frame; the last ``tail``
    rows are ignored.  First and last row follow the line's order.
    """
    padded = with_earlier_rows(
        obs.select(*line.keys, *line.order, *([] if line.clock in line.order else [line.clock]), "motion"),
        line,
        max(1, streak - 1),
    )
    frame = line.local().rowsBetween(-(streak - 1), 0)
    marked = (
        padded.withColumn("_low", F.sum((F.col("motion") <= low_motion).cast("int")).over(frame))
        .withColumn("_lag", F.lag(line.clock).over(line.local()))
    )
    rows = row_numbers(drop_halo(marked), line, "_rn")
    total = F.count("*")
    per = rows.groupBy(*line.keys).agg(
        total.alias("rows"),
        (F.max_by(line.clock, line.position()) - F.min_by(line.clock, line.position())).alias("span_ms"),
        F.max(F.col(line.clock) - F.col("_lag")).alias("widest_gap_ms"),
        F.min(F.when(F.col("_low") >= streak, F.col("_rn"))).alias("first_low"),
    )
    reason = (
        F.when(F.col("rows") < min_rows, "legacy: insufficient frames")
        .when(F.col("span_ms") < min_span_ms, "legacy: fewer than eight seconds")
        .when(F.col("widest_gap_ms") > max_gap_ms, "legacy: capture gap")
        .when(F.col("first_low") <= F.col("rows") - tail, "legacy: possible pause")
        .otherwise("usable legacy run")
    )
    return per.withColumn("reason", reason).withColumn("usable", F.col("reason") == "usable legacy run")


def backfill_legacy(sessions: DataFrame, legacy: DataFrame, spans: DataFrame, order: Timeline) -> DataFrame:
    """Fill quality of complete zero-duration runs without a verdict.

    ``legacy`` has (session_id, usable, reason); ``spans`` has (session_id, span_ms).
    The index of a candidate is its position by start; index and version are only
    filled where missing.
    """
    wanted = (
        (F.col("status") == "complete")
        & (F.col("end_reason") == "game_over")
        & (F.col("active_duration_ms") == 0)
        & F.col("quality_reason").isNull()
    )
    ranked = row_numbers(sessions.where(wanted), order, "_index").select("session_id", "_index")
    fill = (
        ranked.join(legacy.select("session_id", F.col("usable").alias("_ok"), F.col("reason").alias("_why")), "session_id", "left")
        .join(spans.select("session_id", F.col("span_ms").alias("_span")), "session_id", "left")
    )
    hit = F.col("_index").isNotNull()
    return (
        sessions.join(fill, "session_id", "left")
        .withColumn("active_duration_ms", F.when(hit, F.coalesce("_span", F.lit(0))).otherwise(F.col("active_duration_ms")))
        .withColumn("usable", F.when(hit, F.coalesce("_ok", F.lit(False))).otherwise(F.col("usable")))
        .withColumn("quality_reason", F.when(hit, F.coalesce("_why", F.lit("legacy: insufficient frames"))).otherwise(F.col("quality_reason")))
        .withColumn("collection_index", F.when(hit, F.coalesce("collection_index", "_index")).otherwise(F.col("collection_index")))
        .withColumn("model_version", F.when(hit, F.coalesce("model_version", F.lit(LEGACY))).otherwise(F.col("model_version")))
        .drop("_ok", "_why", "_span", "_index")
    )


def exclude_legacy(df: DataFrame, legacy: str = LEGACY) -> DataFrame:
    hit = (F.col("model_version") == legacy) & F.col("usable")
    why = "legacy: excluded from official v3 cohort"
    return df.withColumn("quality_reason", F.when(hit, why).otherwise(F.col("quality_reason"))).withColumn(
        "usable", F.when(hit, F.lit(False)).otherwise(F.col("usable"))
    )


def cohort_runs(sessions: DataFrame, legacy: DataFrame | None = None, version: str = COHORT) -> DataFrame:
    """Dataset cohort: complete, game over, current version, usable.

    A run with an empty active clock is judged by the legacy verdicts instead.
    """
    base = sessions.where(
        (F.col("status") == "complete") & (F.col("end_reason") == "game_over") & (F.col("model_version") == version)
    )
    if legacy is None:
        return base.where(F.col("usable"))
    verdict = legacy.select("session_id", F.col("usable").alias("_ok"))
    chosen = F.when(F.col("active_duration_ms") == 0, F.coalesce("_ok", F.lit(False))).otherwise(F.col("usable"))
    return base.join(verdict, "session_id", "left").where(chosen).drop("_ok")


def status_usable(sessions: DataFrame, legacy: DataFrame, version: str = COHORT) -> DataFrame:
    """Status-page rule: a zero-clock game over counts by its legacy verdict, whatever its version."""
    verdict = legacy.select("session_id", F.col("usable").alias("_ok"), F.col("reason").alias("_why"))
    zero = (F.coalesce("active_duration_ms", F.lit(0)) == 0) & (F.col("end_reason") == "game_over")
    legacy_flag = S.is_legacy(F.col("quality_reason"))
    return (
        sessions.where(F.col("status") == "complete")
        .join(verdict, "session_id", "left")
        .withColumn("legacy", legacy_flag)
        .withColumn("official", F.col("model_version") == version)
        .withColumn(
            "reason",
            F.when(zero, F.coalesce("_why", F.lit("legacy: insufficient frames"))).otherwise(
                F.coalesce("quality_reason", F.lit("excluded: incomplete quality metadata"))
            ),
        )
        .withColumn("usable", F.when(zero, F.coalesce("_ok", F.lit(False))).otherwise(F.col("usable") & F.col("official")))
        .drop("_ok", "_why")
    )


def phase(usable_count: Column, development: int = DEVELOPMENT_RUNS, target: int = TARGET_RUNS) -> Column:
    return (
        F.when(usable_count < development, "development")
        .when(usable_count < target, "locked_test")
        .otherwise("evaluation")
    )


def cohort_violations(df: DataFrame, line: Timeline, lo: int, hi: int) -> DataFrame:
    """One row (runs, sessions, outside, backward): all zero or hi-lo+1 when sound.

    ``df`` has run, session_id and the line's columns; anchors must strictly increase
    within a run, and each run must belong to one session.
    """
    before = previous_row(df, line, {"_before": F.col(line.clock)})
    per = before.groupBy("run").agg(
        F.min("session_id").alias("_lo"),
        F.max("session_id").alias("_hi"),
        F.sum(F.when(F.col("_before") >= F.col(line.clock), 1).otherwise(0)).alias("_back"),
    )
    return per.agg(
        F.count(F.when(F.col("run").between(lo, hi), 1)).alias("runs_inside"),
        F.count(F.when(~F.col("run").between(lo, hi), 1)).alias("runs_outside"),
        F.count(F.when(F.col("_lo") != F.col("_hi"), 1)).alias("mixed_runs"),
        F.coalesce(F.sum("_back"), F.lit(0)).alias("backward_anchors"),
    )


def assert_cohort(df: DataFrame, line: Timeline, lo: int = 1, hi: int = DEVELOPMENT_RUNS) -> None:
    v = cohort_violations(df, line, lo, hi).first()
    if v.runs_inside != hi - lo + 1 or v.runs_outside or v.mixed_runs or v.backward_anchors:
        raise ValueError(f"cohort must hold runs {lo}..{hi} with one session and rising anchors each: {v}")


def nonfinite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def count_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows holding a NaN, an infinity or a null, per column (arrays are searched)."""
    kinds = dict(df.dtypes)

    def bad(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.exists(F.col(c), nonfinite)
        return nonfinite(F.col(c))

    return df.agg(*[F.count(F.when(bad(c), 1)).alias(c) for c in columns])


def assert_finite(df: DataFrame, columns: Sequence[str]) -> None:
    found = {k: v for k, v in count_nonfinite(df, columns).first().asDict().items() if v}
    if found:
        raise ValueError(f"non-finite values: {found}")


def select_features(x: Column, indices: Sequence[int]) -> Column:
    return F.array(*[F.element_at(x, i + 1) for i in indices])


def feature_names(stats: Sequence[str], fields: Sequence[str]) -> list[str]:
    """Stat-major names."""
    return [f"{s}_{f}" for s in stats for f in fields]


def admissible_models(
    df: DataFrame, horizons: Sequence[int], schema_version: str, feature_count: int, kinds: Sequence[str]
) -> DataFrame:
    return df.where(
        F.col("eligible_for_live")
        & (F.col("horizons") == F.array(*[F.lit(h) for h in horizons]))
        & (F.col("feature_schema") == schema_version)
        & (F.col("feature_count") == feature_count)
        & F.col("kind").isin(*kinds)
    )


def compatibility(dataset: DataFrame, manifest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Compare two one-row frames column by column: (field, same)."""
    left = dataset.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])))
    right = manifest.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])))
    return (
        left.withColumnRenamed("value", "a")
        .join(right.withColumnRenamed("value", "b"), "key")
        .select(F.col("key").alias("field"), F.col("a").eqNullSafe(F.col("b")).alias("same"))
    )


def assert_compatible(dataset: DataFrame, manifest: DataFrame, columns: Sequence[str]) -> None:
    wrong = [r.field for r in compatibility(dataset, manifest, columns).where(~F.col("same")).collect()]
    if wrong:
        raise ValueError(f"incompatible: {sorted(wrong)}")


def subset_runs(df: DataFrame, excluded: Sequence[int], last: int = DEVELOPMENT_RUNS) -> DataFrame:
    return df.where(F.col("run").between(1, last) & ~F.col("run").isin(*excluded))


def collection_index(sessions: DataFrame, order: Timeline) -> DataFrame:
    """Usable runs started before this one, plus one."""
    return running(
        sessions, order, sums={"collection_index": F.col("usable").cast("long")}, inclusive=False
    ).withColumn("collection_index", F.col("collection_index") + 1)


