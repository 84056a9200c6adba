"""Session-domain views over the driver tables, in Spark and (as CTEs) in DuckDB SQL.

One second of a session is two days of event time, so that a user's month of
events looks like a 15 s run sampled at about four rows per second.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators import quality
from foretide.operators.timeline import Timeline
from foretide.settings import COHORT, LEGACY, prepare_session

FX_HORIZONS = (1, 2, 3, 4, 6, 9, 12)
TICK_US = 172_800_000
# Carried values work on any width; histories copy 8 s of rows into every slice.
SLICE_MS = 1_000
HISTORY_SLICE_MS = 8_000
MIN_COVERAGE = 0.95

OBS_LINE = Timeline(("session_id",), ("ts_ms", "event_id"), "active_ms", SLICE_MS)
HISTORY_LINE = Timeline(OBS_LINE.keys, OBS_LINE.order, OBS_LINE.clock, HISTORY_SLICE_MS)
HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{folder}/{name}.parquet")


def raw_events(spark, folder) -> DataFrame:
    return read(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "event_type",
        "value",
    )


def obs(spark, folder) -> DataFrame:
    """Observations with the pause-free clock; the start per user is a small pre-aggregate."""
    e = raw_events(spark, folder)
    start = e.groupBy("session_id").agg(F.min("ts_us").alias("start_us"))
    return e.join(start, "session_id").select(
        "session_id",
        "event_id",
        F.expr("ts_us div 1000").alias("ts_ms"),
        F.expr(f"(ts_us - start_us) div {TICK_US}").alias("active_ms"),
        F.col("value").alias("motion"),
        "event_type",
    )


def session_facts(spark, folder) -> DataFrame:
    """One row per run before judging it."""
    e = raw_events(spark, folder)
    per = e.groupBy("session_id").agg(
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.count("*").alias("valid_frame_count"),
        F.max_by("event_type", F.struct("ts_us", "event_id")).alias("last_type"),
    )
    return per.select(
        "session_id",
        F.expr("start_us div 1000").alias("started_ms"),
        F.expr("end_us div 1000").alias("ended_ms"),
        F.expr(f"(end_us - start_us) div {TICK_US}").alias("active_duration_ms"),
        "valid_frame_count",
        F.when(F.col("last_type") == "error", "capture_error").otherwise("game_over").alias("end_reason"),
        F.when(F.col("session_id") % 5 == 0, LEGACY).otherwise(COHORT).alias("model_version"),
        F.lit("complete").alias("status"),
    )


def sessions(spark, folder) -> DataFrame:
    return quality.run_quality(session_facts(spark, folder), min_coverage=MIN_COVERAGE)


def lifecycle(spark, folder) -> DataFrame:
    return (
        obs(spark, folder)
        .where(F.col("event_type").isin("error", "signup"))
        .select(
            "session_id",
            "event_id",
            "ts_ms",
            "active_ms",
            F.when(F.col("event_type") == "error", "paused").otherwise("active").alias("state"),
        )
    )


def raw_probability(i: int):
    return F.least(F.lit(1.0), F.col("motion") * (1 + (F.col("event_id") * (i + 3)) % 7) / 400.0)


def predictions(spark, folder) -> DataFrame:
    """Columns p (as emitted), m (clipped, monotone), remaining, crossing, loss_window, status."""
    p = F.array(*[raw_probability(i) for i in range(7)])
    return (
        obs(spark, folder)
        .select("session_id", "event_id", "ts_ms", "active_ms", p.alias("p"))
        .withColumn("m", S.monotone(F.col("p")))
        .withColumn("remaining", S.expected_remaining(F.col("m"), FX_HORIZONS))
        .withColumn("crossing", S.first_crossing(F.col("m")))
        .withColumn("loss_window", S.loss_window(F.col("crossing")))
        .withColumn("status", F.when(F.col("event_id") % 11 == 0, "warming_up").otherwise("ready"))
    )


def labelled(spark, folder) -> DataFrame:
    """Predictions with time to failure and the seven labels."""
    d = session_facts(spark, folder).select("session_id", "active_duration_ms")
    return (
        predictions(spark, folder)
        .join(d, "session_id")
        .withColumn("ttf", S.time_to_failure(F.col("active_duration_ms"), F.col("active_ms")))
        .withColumn("y", S.failure_targets(F.col("ttf"), FX_HORIZONS))
    )


def cohort(spark, folder) -> DataFrame:
    """Complete, current-cohort, game-over runs (usable by the scaled rule)."""
    return sessions(spark, folder).where(
        (F.col("end_reason") == "game_over") & (F.col("model_version") == COHORT) & F.col("usable")
    )


def long_predictions(df: DataFrame, *keep: str) -> DataFrame:
    """One row per prediction and horizon: h, p, y."""
    pairs = F.arrays_zip(F.col("m").alias("p"), F.col("y").alias("y"))
    return df.select(*keep, F.posexplode(pairs).alias("h", "_py")).select(
        *keep, "h", F.col("_py.p").alias("p"), F.col("_py.y").alias("y")
    )


def pixels(spark, folder) -> DataFrame:
    """8x8 rasters from the 64-value vectors: (frame, session, y, x, r, g, b)."""

    def channel(shift: int):
        at = (F.col("i") + shift) % 64
        return F.least(F.lit(1.0), F.abs(F.element_at("embedding", (at + 1).cast("int")).cast("double")))

    e = read(spark, folder, "embeddings")
    return e.select(
        F.col("vec_id").alias("frame"),
        F.col("label").alias("session"),
        "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"),
    ).select(
        "frame",
        "session",
        F.expr("i div 8").cast("int").alias("y"),
        (F.col("i") % 8).alias("x"),
        channel(0).alias("r"),
        channel(21).alias("g"),
        channel(42).alias("b"),
    )


def lanes(spark, folder) -> DataFrame:
    """Six lanes x (height, gap, incoming, confidence), ordered by vec_id within label."""
    e = read(spark, folder, "embeddings")
    v = F.transform(F.slice("embedding", 1, 64), lambda x: F.abs(x.cast("double")))
    return e.select(F.col("label").alias("run"), F.col("vec_id").alias("frame"), v.alias("v"))


# ---------------------------------------------------------------------------
# The same views as DuckDB CTEs.

_M = ",\n".join(
    f"       greatest({', '.join(f'p{j}' for j in range(i + 1))}) as m{i}" if i else "       p0 as m0" for i in range(7)
)
_P = ",\n".join(f"       least(1.0, motion * (1 + (event_id * {i + 3}) % 7) / 400.0) as p{i}" for i in range(7))


def trapezoid_sql(names: list[str], horizons) -> str:
    times = (0, *horizons)
    s = ["1.0"] + [f"(1.0 - {n})" for n in names]
    return " + ".join(
        f"({s[i]} + {s[i + 1]}) * {float(times[i + 1] - times[i])} / 2" for i in range(len(horizons))
    )


def crossing_sql(names: list[str], threshold: float = 0.5) -> str:
    return "case " + " ".join(f"when {n} >= {threshold} then {i}" for i, n in enumerate(names)) + f" else {len(names)} end"


WINDOW_SQL = (
    "case when crossing <= 1 then 'under_10s' when crossing <= 3 then '10_to_20s' when crossing = 4 then '20_to_30s' "
    "when crossing = 5 then '30_to_45s' when crossing = 6 then '45_to_60s' else 'none' end"
)
MS = [f"m{i}" for i in range(7)]
_Y = ", ".join(f"case when ttf <= {h} then 1 else 0 end as y{i}" for i, h in enumerate(FX_HORIZONS))

CTES: dict[str, str] = {
    "fx_obs": f"""
select user_id as session_id, event_id, epoch_us(ts)//1000 as ts_ms,
       (epoch_us(ts)-min(epoch_us(ts)) over (partition by user_id))//{TICK_US} as active_ms,
       value as motion, event_type
from events""",
    "fx_facts": f"""
select user_id as session_id, min(epoch_us(ts))//1000 as started_ms, max(epoch_us(ts))//1000 as ended_ms,
       (max(epoch_us(ts))-min(epoch_us(ts)))//{TICK_US} as active_duration_ms, count(*) as valid_frame_count,
       case when last(event_type order by ts, event_id) = 'error' then 'capture_error' else 'game_over' end as end_reason,
       case when user_id % 5 = 0 then 'legacy-v2' else 'collection-v3' end as model_version, 'complete' as status
from events group by user_id""",
    "fx_sessions": f"""
select *, case when end_reason <> 'game_over' then 'excluded: ' || end_reason
               when active_duration_ms < 8000 then 'excluded: fewer than eight active seconds'
               when valid_frame_count < 28 then 'excluded: insufficient valid frames'
               when coverage < {MIN_COVERAGE} then 'excluded: capture coverage below {round(MIN_COVERAGE * 100)}%'
               else 'usable personal run' end as quality_reason,
       (end_reason = 'game_over' and active_duration_ms >= 8000 and valid_frame_count >= 28 and coverage >= {MIN_COVERAGE}) as usable
from (select *, greatest(1, cast(round_even(active_duration_ms/250.0, 0) as bigint)) as expected_frame_count,
             least(1.0, valid_frame_count * 1.0 / greatest(1, cast(round_even(active_duration_ms/250.0, 0) as bigint))) as coverage
      from fx_facts)""",
    "fx_lifecycle": """
select session_id, event_id, ts_ms, active_ms, case when event_type='error' then 'paused' else 'active' end as state
from fx_obs where event_type in ('error','signup')""",
    "fx_predictions": f"""
select *, {WINDOW_SQL} as loss_window,
       case when event_id % 11 = 0 then 'warming_up' else 'ready' end as status
from (select *, {trapezoid_sql(MS, FX_HORIZONS)} as remaining, {crossing_sql(MS)} as crossing
      from (select *,
{_M}
            from (select session_id, event_id, ts_ms, active_ms,
{_P}
                  from fx_obs)))""",
    "fx_labelled": f"""
select *, {_Y} from (
select p.*, f.active_duration_ms, greatest(0.0, (f.active_duration_ms - p.active_ms)/1000.0) as ttf
from fx_predictions p join fx_facts f using (session_id))""",
    "fx_long": "\nunion all\n".join(
        f"select session_id, event_id, active_ms, ttf, {i} as h, m{i} as p, y{i} as y from fx_labelled" for i in range(7)
    ),
    "fx_cohort": """
select * from fx_sessions where end_reason='game_over' and model_version='collection-v3' and usable""",
    "fx_pixels": """
select vec_id as frame, label as session, i//8 as y, i%8 as x,
       least(1.0, abs(embedding[i+1]::double)) as r,
       least(1.0, abs(embedding[(i+21)%64+1]::double)) as g,
       least(1.0, abs(embedding[(i+42)%64+1]::double)) as b
from embeddings, range(64) t(i)""",
    "fx_lanes": """
select label as run, vec_id as frame, l as lane,
       abs(embedding[l*4+1]::double) as height, abs(embedding[l*4+2]::double) as gap,
       abs(embedding[l*4+3]::double) as incoming, abs(embedding[l*4+4]::double) as confidence
from embeddings, range(6) t(l)""",
}


def register_ctes(extra: dict[str, str]) -> None:
    for name, sql in extra.items():
        if name in CTES:
            raise ValueError(f"{name} is already defined")
        CTES[name] = sql


def expand(sql: str) -> str:
    """Prepend the CTEs a query mentions, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in CTES and name not in order:
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    views = ",\n".join(f"{n} as ({CTES[n]})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {views},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"
