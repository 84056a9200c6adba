"""Scalar building blocks as Column expressions (no Python runs per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foretide.settings import HORIZONS

# Warning window names by first crossed horizon, and what they display.
WINDOW_BY_CROSSING = (
    "under_10s",
    "under_10s",
    "10_to_20s",
    "10_to_20s",
    "20_to_30s",
    "30_to_45s",
    "45_to_60s",
    "none",
)
WINDOW_LABELS = {
    "none": "NO FAILURE SIGNAL",
    "45_to_60s": "LOSS LIKELY IN 45-60s",
    "30_to_45s": "LOSS LIKELY IN 30-45s",
    "20_to_30s": "LOSS LIKELY IN 20-30s",
    "10_to_20s": "LOSS LIKELY IN 10-20s",
    "under_10s": "LOSS IMMINENT - <10s",
}
WINDOW_SECONDS = {
    "under_10s": 5.0,
    "10_to_20s": 15.0,
    "20_to_30s": 25.0,
    "30_to_45s": 37.5,
    "45_to_60s": 52.5,
}
CLASS_BY_CROSSING = (0, 0, 1, 1, 2, 3, 4, 5)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def round_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits) if digits else F.rint(x)


def round_away(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_quantile(ascending: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array; null for an empty one."""
    n = F.greatest(F.size(ascending), F.lit(1))
    at = (n - 1) * F.lit(float(q))
    lo = F.floor(at).cast("int")
    hi = F.least(lo + 1, n - 1)
    a, b = F.try_element_at(ascending, lo + 1), F.try_element_at(ascending, hi + 1)
    return a + (b - a) * (at - lo)


def monotone_columns(p: Sequence[Column]) -> list[Column]:
    """Clip to [0, 1] and take the running maximum, one column per horizon."""
    clipped = [clip(c, 0.0, 1.0) for c in p]
    return [F.greatest(*clipped[: i + 1]) if i else clipped[0] for i in range(len(clipped))]


def monotone(p: Column, width: int = len(HORIZONS)) -> Column:
    """Array form of :func:`monotone_columns`; any other length raises."""
    checked = F.when(F.size(p) == width, p).otherwise(
        F.raise_error(F.lit("one cumulative probability per horizon expected"))
    )
    # Each value holds the one before it and none stands in a branch, so Spark evaluates each once per row.
    values = [clip(F.element_at(checked, 1), 0.0, 1.0)]
    for i in range(1, width):
        values.append(F.greatest(values[-1], clip(F.element_at(checked, i + 1), 0.0, 1.0)))
    return F.array(*values)


def first_crossing(p: Column, threshold: float = 0.5, width: int = len(HORIZONS)) -> Column:
    """Index of the first horizon reaching ``threshold``; ``width`` when none does."""
    out = F.lit(width)
    for i in reversed(range(width)):
        out = F.when(F.element_at(p, i + 1) >= threshold, F.lit(i)).otherwise(out)
    return out


def _pick(values: Sequence, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def loss_window(crossing: Column) -> Column:
    return _pick(WINDOW_BY_CROSSING, crossing)


def _lookup(table: dict, key: Column, default=None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def window_label(window: Column) -> Column:
    return _lookup(WINDOW_LABELS, window)


def window_seconds(window: Column, default: float = 60.0) -> Column:
    return _lookup(WINDOW_SECONDS, window, default)


def predicted_class(crossing: Column) -> Column:
    return _pick(CLASS_BY_CROSSING, crossing)


def actual_class(remaining: Column, horizons: Sequence[float] = HORIZONS) -> Column:
    """0..4 by the upper horizons, 5 beyond the last one."""
    out = F.lit(5)
    for k, h in reversed(list(enumerate(horizons[i] for i in (1, 3, 4, 5, 6)))):
        out = F.when(remaining <= h, F.lit(k)).otherwise(out)
    return out


def expected_remaining(p: Column, horizons: Sequence[float] = HORIZONS) -> Column:
    """Trapezoid area under survival (1, 1-p) over (0, horizons); ``p`` monotone."""
    times = (0, *horizons)
    survival = [F.lit(1.0)] + [F.lit(1.0) - F.element_at(p, i + 1) for i in range(len(horizons))]
    total = F.lit(0.0)
    for i in range(len(horizons)):
        total = total + (survival[i] + survival[i + 1]) * F.lit(float(times[i + 1] - times[i])) / 2
    return total


def failure_targets(remaining: Column, horizons: Sequence[float] = HORIZONS) -> Column:
    left = F.greatest(F.lit(0.0), remaining)
    return F.array(*[(left <= h).cast("int") for h in horizons])


def time_to_failure(duration_ms: Column, active_ms: Column) -> Column:
    return F.greatest(F.lit(0.0), (duration_ms - active_ms) / 1000.0)


def average_duration_probs(
    average: Column, elapsed: Column, horizons: Sequence[float] = HORIZONS, scale: float = 5.0
) -> Column:
    left = average - elapsed
    return F.array(
        *[1.0 / (1.0 + F.exp(clip((left - float(h)) / scale, -50.0, 50.0))) for h in horizons]
    )


def empirical_duration_probs(
    beyond: Column, within: Sequence[Column]
) -> list[Column]:
    """Smoothed share of runs still going that end within each horizon."""
    return [(w + 0.5) / (beyond + 1.0) for w in within]


def safe_logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.log(q / (1 - q))


def certainty(disagreement: Column, high: float, medium: float, high_on: bool, medium_on: bool) -> Column:
    return (
        F.when(F.lit(high_on) & (disagreement <= high), "high")
        .when(F.lit(medium_on) & (disagreement <= medium), "medium")
        .otherwise("low")
    )


def entropy(counts: Sequence[Column]) -> Column:
    """Natural-log entropy of a count vector; empty classes contribute nothing."""
    total = F.greatest(F.lit(1.0), sum(counts[1:], counts[0]))
    terms = [F.when(c > 0, -(c / total) * F.log(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return sum(terms[1:], terms[0])


def canonical_ring(ring: Column, size: int = 6) -> Column:
    """Lexicographically largest cyclic shift of a ring of comparable items."""
    turns = [
        F.concat(F.slice(ring, k + 1, size - k), F.slice(ring, 1, k)) if k else ring for k in range(size)
    ]
    return F.array_max(F.array(*turns))


def average_motion(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors; 0 when either is missing or sizes differ."""
    pairs = F.zip_with(a, b, lambda x, y: F.abs(y.cast("double") - x.cast("double")))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), total / F.size(b)).otherwise(0.0)


def clamp_motion(m: Column) -> Column:
    return clip(m / 32.0, 0.0, 1.0)


def receipt(usable: Column, usable_runs: Column, target: Column, coverage: Column, reason: Column):
    """Columns (accepted, headline, detail) shown when a run completes."""
    percent = F.floor(coverage * 100 + 0.5).cast("long").cast("string")
    tail = F.when(coverage.isNotNull() & ~F.isnan(coverage), F.concat(F.lit(" · "), percent, F.lit("% capture")))
    ok = F.concat(
        F.coalesce(usable_runs, F.lit(0)).cast("string"),
        F.lit(" / "),
        F.coalesce(target, F.lit(40)).cast("string"),
        F.lit(" usable"),
        F.coalesce(tail, F.lit("")),
    )
    why = F.coalesce(F.nullif(reason, F.lit("")), F.lit("Run did not pass capture checks"))
    why = F.regexp_replace(F.regexp_replace(why, r"(?i)^excluded:\s*", ""), r"(?i)^legacy:\s*", "")
    good = F.coalesce(usable, F.lit(False))
    return (
        good.alias("accepted"),
        F.when(good, "RUN ACCEPTED").otherwise("RUN EXCLUDED").alias("headline"),
        F.when(good, ok).otherwise(why).alias("detail"),
    )


def iso_to_ms(text: Column) -> Column:
    return F.unix_millis(F.to_timestamp(text))


def duration_text(active_ms: Column, started_ms: Column, ended_ms: Column) -> Column:
    """``Xm YYs active`` from the active clock, else plain wall time, else "Live now"."""

    def spell(ms: Column, pattern: str) -> Column:
        seconds = F.floor(ms / 1000.0 + 0.5).cast("long")
        return F.format_string(pattern, F.floor(seconds / 60).cast("long"), seconds % 60)

    wall = F.greatest(F.lit(0), ended_ms - started_ms)
    return (
        F.when(active_ms > 0, spell(active_ms, "%dm %02ds active"))
        .when(ended_ms.isNull(), F.lit("Live now"))
        .otherwise(spell(wall, "%dm %02ds"))
    )


def content_hash(*parts: Column) -> Column:
    """SHA-256 of one content column, or of several joined by '|'."""
    return F.sha2(parts[0] if len(parts) == 1 else F.concat_ws("|", *parts), 256)


def field_or(document: Column, path: str, type_: str, default) -> Column:
    """Optional JSON field with a typed default."""
    return F.coalesce(F.get_json_object(document, path).cast(type_), F.lit(default).cast(type_))


def is_legacy(reason: Column) -> Column:
    text = F.coalesce(reason, F.lit(""))
    return text.startswith("legacy:") | (text == "usable legacy run")


def supported_url(
    url: Column, scheme: str = "http", hosts: Sequence[str] = ("127.0.0.1", "localhost"), port: str | None = "8000"
) -> Column:
    """Scheme / host / port allow-list; anything unparsable is refused."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    found = F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit(""))
    good = (F.try_parse_url(url, F.lit("PROTOCOL")) == scheme) & host.isin(*hosts)
    good = good & (found.isNull() if port is None else (found == port))
    return F.coalesce(good, F.lit(False))


def register_sql_functions(spark: SparkSession) -> list[str]:
    """The same helpers as SQL functions, so that SQL text can call them."""
    h = HORIZONS
    body = {
        "ft_clip01(x DOUBLE) RETURNS DOUBLE": "greatest(0D, least(1D, x))",
        "ft_ttf(duration_ms BIGINT, active_ms BIGINT) RETURNS DOUBLE":
            "greatest(0D, (duration_ms - active_ms) / 1000D)",
        "ft_motion01(m DOUBLE) RETURNS DOUBLE": "greatest(0D, least(1D, m / 32D))",
        "ft_within(ttf DOUBLE, h INT) RETURNS INT": "cast(greatest(0D, ttf) <= h AS INT)",
        "ft_logit(p DOUBLE) RETURNS DOUBLE":
            "ln(greatest(1e-6D, least(0.999999D, p)) / (1 - greatest(1e-6D, least(0.999999D, p))))",
        "ft_class(ttf DOUBLE) RETURNS INT":
            f"CASE WHEN ttf <= {h[1]} THEN 0 WHEN ttf <= {h[3]} THEN 1 WHEN ttf <= {h[4]} THEN 2 "
            f"WHEN ttf <= {h[5]} THEN 3 WHEN ttf <= {h[6]} THEN 4 ELSE 5 END",
    }
    for signature, expression in body.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {expression}")
    return [s.split("(")[0] for s in body]
