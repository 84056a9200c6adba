"""Structured Streaming: live history and forecasts, run detection, sinks.

Keyed state is bounded (36 frames, 3 forecasts, 2 radial profiles).  Rows of a key
within one micro-batch touch the state in time order: they are kept as a few flat number
arrays while they arrive (:func:`ordered`), and results leave in slices, so a session of a
million rows in one micro-batch is no special case.  The size of a micro-batch is the source's
``maxFilesPerTrigger`` / ``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from foretide.functions.scalars import WINDOW_BY_CROSSING, WINDOW_LABELS
from foretide.settings import HORIZONS, TRAINING_MILESTONES
from foretide.sources.store import upsert_predictions


SLICE_ROWS = 20_000


def ordered(
    batches: Iterator[pd.DataFrame], order: Sequence[str], numbers: Sequence[str], kinds: dict[str, tuple[str, ...]] | None = None, vector: str | None = None
) -> Iterator[dict[str, np.ndarray]]:
    """A key's rows of one micro-batch in order, as slices of flat arrays.

    ``numbers`` become arrays of their own type, columns of ``kinds`` the place of their value
    in the given list (-1: another one), ``vector`` a matrix (NaN where a row has none).  Nothing else of a row is held.
    """
    kinds = kinds or {}
    parts: dict[str, list] = {c: [] for c in [*numbers, *kinds, *([vector] if vector else [])]}
    for batch in batches:
        for c in numbers:
            parts[c].append(batch[c].to_numpy())
        for c, values in kinds.items():
            parts[c].append(pd.Categorical(batch[c], categories=values).codes)
        if vector:
            rows = [None if v is None else np.asarray(v, float) for v in batch[vector]]
            width = max((len(v) for v in rows if v is not None), default=0)
            parts[vector].append(np.stack([np.full(width, np.nan) if v is None else v for v in rows]) if rows else np.zeros((0, width)))
    if vector:
        width = max((p.shape[1] for p in parts[vector]), default=0)
        parts[vector] = [p if p.shape[1] == width else np.full((len(p), width), np.nan) for p in parts[vector]]
    whole = {}
    for c in list(parts):
        whole[c] = np.concatenate(parts.pop(c) or [np.zeros(0)])
    at = np.lexsort([whole[c] for c in reversed(order)])
    for a in range(0, len(at), SLICE_ROWS):
        yield {c: v[at[a : a + SLICE_ROWS]] for c, v in whole.items()}


@dataclass(frozen=True)
class LiveModel:
    """Linear members over the aggregated window: weights (member, horizon, feature), bias (member, horizon).

    ``certainty`` has the largest disagreement of a high and of a medium certainty, null where the tier is off.
    """

    weights: tuple
    bias: tuple
    horizons: tuple = HORIZONS
    certainty: tuple = (0.04, 0.10)

    def members(self, frames: np.ndarray) -> np.ndarray:
        quarter = max(1, len(frames) // 4)
        x = np.concatenate(
            [frames.mean(0), frames.std(0), frames.min(0), frames.max(0), frames[-quarter:].mean(0) - frames[:quarter].mean(0)]
        )
        z = np.asarray(self.weights) @ x + np.asarray(self.bias)
        return np.maximum.accumulate(1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))), axis=1)

    def remaining(self, p: np.ndarray) -> float:
        return float(np.trapezoid(np.concatenate([[1.0], 1.0 - p]), np.array([0.0, *self.horizons])))


    def tier(self, members: np.ndarray) -> str:
        """Certainty from the members' mean standard deviation."""
        apart = float(members.std(0).mean())
        for name, most in zip(("high", "medium"), self.certainty, strict=True):
            if most is not None and apart <= most:
                return name
        return "low"


LIVE_STATE = T.StructType(
    [
        T.StructField("active", T.ArrayType(T.LongType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
        T.StructField("probabilities", T.ArrayType(T.DoubleType())),
        T.StructField("last_p", T.ArrayType(T.DoubleType())),
        T.StructField("last_ts", T.LongType()),
        T.StructField("last_active", T.LongType()),
        T.StructField("clock", T.LongType()),
        T.StructField("valid_frames", T.LongType()),
        T.StructField("paused", T.BooleanType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("certainty", T.StringType()),
    ]
)
LIVE_OUTPUT = (
    "session_id long, ts_ms long, event_id long, active_ms long, status string, valid_frames long, history int, clock long, "
    "forecast_ts_ms long, p array<double>, remaining double, low double, high double, certainty string, loss_window string, label string"
)
LIVE_KINDS = ("frame", "paused", "active")


def live_history(
    stream: DataFrame, model: LiveModel | None, keep: int = 36, min_rows: int = 28, min_span_ms: int = 7_750, throttle_ms: int = 900, smooth: int = 3
) -> DataFrame:
    """Frames and lifecycle rows of each session in, one status row per frame out.

    ``stream``: session_id, ts_ms, event_id, active_ms, kind (frame / paused / active),
    vector (array).  Paused sessions ignore frames; a resume clears history, smoothing
    and the last forecast.  Status climbs collecting, paused, warming_up, ready, and a
    forecast is repeated until ``throttle_ms`` of active time have passed.  A forecast has the
    smoothed probabilities, the remaining seconds with the members' tenth and ninetieth percentile, the
    certainty of the members' agreement, the loss window and its label.
    """
    width = len(model.horizons) if model else 0
    names = [f.split()[0] for f in LIVE_OUTPUT.split(", ")]

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            active, values, probs, last_p, last_ts, last_active, clock, valid, paused, low, high, tier = state.get
        else:
            active, values, probs, last_p, last_ts, last_active, clock, valid, paused, low, high, tier = [], [], [], [], 0, 0, 0, 0, False, None, None, None
        active, last_p = deque(active, keep), list(last_p)
        frames = deque(np.reshape(values, (len(active), -1)) if len(active) else [], keep)
        probs = deque(np.reshape(probs, (-1, width)) if len(probs) else [], smooth)
        told = (None,) * 8
        if last_p:
            told = _told(model, last_p, last_ts, low, high, tier)
        for part in ordered(batches, ("ts_ms", "event_id"), ("ts_ms", "event_id", "active_ms"), {"kind": LIVE_KINDS}, "vector"):
            out = []
            for i, (ts, event, at, kind) in enumerate(zip(*(part[c].tolist() for c in ("ts_ms", "event_id", "active_ms", "kind")), strict=True)):
                clock = max(clock, at)
                if kind == 1:
                    paused = True
                    continue
                if kind == 2:
                    paused, last_p, last_active = False, [], at
                    active.clear(), frames.clear(), probs.clear()
                    continue
                if not paused:
                    active.append(at)
                    frames.append(part["vector"][i])
                    valid += 1
                if model is None:
                    status = "collecting"
                elif paused:
                    status = "paused"
                elif len(active) < min_rows or active[-1] - active[0] < min_span_ms:
                    status = "warming_up"
                else:
                    status = "ready"
                    if not last_p or at - last_active >= throttle_ms:
                        members = model.members(np.stack(frames))
                        probs.append(np.maximum.accumulate(np.median(members, axis=0)))
                        last_p = np.maximum.accumulate(np.mean(probs, axis=0)).tolist()
                        last_ts, last_active = ts, at
                        low, high = np.quantile([model.remaining(m) for m in members], [0.1, 0.9]).tolist()
                        tier = model.tier(members)
                        told = _told(model, last_p, last_ts, low, high, tier)
                out.append((key[0], ts, event, at, status, valid, len(active), clock, *(told if status == "ready" else (None,) * 8)))
            frames = deque([f.copy() for f in frames], keep)  # not views of the slice
            yield pd.DataFrame(out, columns=names)
        flat = np.concatenate(frames).tolist() if frames else []
        state.update((list(active), flat, np.concatenate(probs).tolist() if probs else [], last_p, last_ts, last_active, clock, valid, paused, low, high, tier))

    return stream.groupBy("session_id").applyInPandasWithState(run, LIVE_OUTPUT, LIVE_STATE, "append", GroupStateTimeout.NoTimeout)


def _told(model: LiveModel, p: list[float], ts: int, low: float, high: float, tier: str) -> tuple:
    """What a ready row says about the last forecast."""
    window = WINDOW_BY_CROSSING[next((i for i, x in enumerate(p) if x >= 0.5), len(p))]
    return ts, p, model.remaining(np.asarray(p)), low, high, tier, window, WINDOW_LABELS[window]


DETECTOR_STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("streak", T.IntegerType())])


def detect_step(state: str, streak: int, motion: float, hidden: bool, paused: bool, over: bool, playing: bool, start: float = 1.8, needed: int = 3):
    """One step of the run lifecycle: (state, streak, event or None)."""
    stopped = hidden or paused
    if state == "idle":
        if stopped or over:
            return "idle", 0, None
        streak = needed if playing else streak + 1 if motion >= start else 0
        return ("active", 0, "started") if streak >= needed else ("idle", streak, None)
    if over:
        return "idle", 0, "ended"
    if stopped:
        return "paused", streak, "paused" if state != "paused" else None
    return "active", streak, "resumed" if state == "paused" else None


def run_detector(stream: DataFrame, start: float = 1.8, needed: int = 3) -> DataFrame:
    """Lifecycle events (started, paused, resumed, ended) per session from sampled signals.

    ``stream``: session_id, ts_ms, event_id, motion, hidden, paused, over, playing.
    Stillness never ends a run.
    """
    signs = ("motion", "hidden", "paused", "over", "playing")

    def run(key, batches, state):
        now, streak = state.get if state.exists else ("idle", 0)
        for part in ordered(batches, ("ts_ms", "event_id"), ("ts_ms", "event_id", *signs)):
            out = []
            for ts, *row in zip(*(part[c].tolist() for c in ("ts_ms", *signs)), strict=True):
                now, streak, event = detect_step(now, streak, *row, start, needed)
                if event:
                    out.append((key[0], ts, event))
            yield pd.DataFrame(out, columns=["session_id", "ts_ms", "event"])
        state.update((now, streak))

    return stream.groupBy("session_id").applyInPandasWithState(
        run, "session_id long, ts_ms long, event string", DETECTOR_STATE, "append", GroupStateTimeout.NoTimeout
    )


CLOSE_STATE = T.StructType([T.StructField("failed_since", T.LongType()), T.StructField("last_ms", T.LongType()), T.StructField("closed", T.BooleanType())])
CLOSE_KINDS = ("ok", "failed", "game_over", "navigation", "disarmed")


def close_sessions(stream: DataFrame, failure_ms: int = 3_000, silence_ms: int | None = None, delay: str | None = None, time: str = "ts") -> DataFrame:
    """First closing of each session: an explicit end reason, capture failing for ``failure_ms``, or silence.

    ``stream``: session_id, ts_ms, event_id, signal (ok / failed / game_over /
    navigation / disarmed).  Without ``delay`` a session closes with the row that shows it.
    With a watermark ``delay`` on the ``time`` column a failing or (``silence_ms``) silent session closes as capture_error
    at its deadline once the watermark has passed it, without another row of the session;
    a row exactly at the deadline still counts.  Results do not depend on how rows are dealt to micro-batches.
    """
    timed = delay is not None
    if silence_ms is not None and not timed:
        raise ValueError("silence is measured by the watermark: give its delay")
    source = stream.withWatermark(time, delay).select("session_id", "ts_ms", "event_id", "signal", time) if timed else stream
    never = (1 << 62)

    def deadline(since: int, last: int) -> int:
        failing = since + failure_ms if timed and since >= 0 else never
        silent = last + silence_ms if silence_ms is not None and last >= 0 else never
        return min(failing, silent)

    def run(key, batches, state):
        since, last, closed = state.get if state.exists else (-1, -1, False)
        names = ["session_id", "ts_ms", "reason"]
        if state.hasTimedOut:
            state.update((since, last, True))
            yield pd.DataFrame([(key[0], deadline(since, last), "capture_error")] if not closed else [], columns=names)
            return
        found = None
        for part in ordered(batches, ("ts_ms", "event_id"), ("ts_ms", "event_id"), {"signal": CLOSE_KINDS}):
            for ts, kind in zip(part["ts_ms"].tolist(), part["signal"].tolist(), strict=True):
                if closed:
                    break
                if ts > deadline(since, last):
                    found = (deadline(since, last), "capture_error")
                elif kind == 0:
                    since = -1
                elif kind == 1:
                    since = ts if since < 0 else since
                    found = (ts, "capture_error") if ts - since >= failure_ms else None
                else:
                    found = (ts, CLOSE_KINDS[kind])
                last, closed = ts, found is not None
        if timed and not closed and deadline(since, last) < never:
            if deadline(since, last) < state.getCurrentWatermarkMs():
                found, closed = (deadline(since, last), "capture_error"), True
            else:
                # Fires when the watermark is later than the time set; a time equal to it cannot be set.
                state.setTimeoutTimestamp(max(deadline(since, last), state.getCurrentWatermarkMs() + 1))
        state.update((since, last, closed))
        yield pd.DataFrame([(key[0], *found)] if found else [], columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return source.groupBy("session_id").applyInPandasWithState(run, "session_id long, ts_ms long, reason string", CLOSE_STATE, "append", timeout)


CLEAR_STATE = T.StructType(
    [
        T.StructField("history", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("time", T.DoubleType()),
        T.StructField("geometry", T.ArrayType(T.DoubleType())),
        T.StructField("active", T.BooleanType()),
    ]
)


def _flash_evidence(white: np.ndarray, prior: np.ndarray, level: float) -> float:
    hit = (white >= level) & (prior >= level)
    best = 0.0
    for lane in range(len(white)):
        edges = np.flatnonzero(np.diff(np.r_[False, hit[lane], False].astype(int)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= 2:
                best = max(best, float(white[lane, a:b].mean()))
    return best


def stream_clear_events(stream: DataFrame, hz: int = 12, level: float = 0.57, limit: float = 0.08) -> DataFrame:
    """Streaming form of the flash detector; equal to the batch operator on ordered input.

    ``stream``: run, frame, t, valid, reset, cx, cy, apothem, white, coloured.
    """

    def run(key, batches, state):
        history, last, geo, active = state.get if state.exists else ([], None, None, False)
        history = [np.asarray(h) for h in history]
        out = []
        for r in pd.concat(list(batches)).sort_values(["t", "frame"]).itertuples(index=False):
            moved = r.valid and geo is not None and (
                abs(r.apothem / geo[0] - 1) > limit or np.hypot(r.cx - geo[1], r.cy - geo[2]) > limit * geo[0]
            )
            if r.reset or not r.valid or moved or (last is not None and (r.t <= last or r.t - last > 1.2 / hz)):
                history, last, geo, active = [], None, None, False
            if not r.valid:
                out.append((key[0], int(r.frame), False, False, 0.0))
                continue
            white = np.stack([np.asarray(w, float) for w in r.white])
            evidence = _flash_evidence(white, np.max(history, axis=0), level) if history else 0.0
            broad = bool(((white[:, 1:] >= level) & (white[:, :-1] >= level)).any())
            now = evidence > 0 or (active and broad)
            out.append((key[0], int(r.frame), True, bool(now and not active), evidence))
            history = (history + [np.stack([np.asarray(c, float) for c in r.coloured]).max(0)])[-2:]
            last, geo, active = float(r.t), [float(r.apothem), float(r.cx), float(r.cy)], bool(now)
        state.update(([h.tolist() for h in history], last, geo, active))
        yield pd.DataFrame(out, columns=["run", "frame", "supported", "event", "confidence"])

    return stream.groupBy("run").applyInPandasWithState(
        run, "run long, frame long, supported boolean, event boolean, confidence double", CLEAR_STATE, "append", GroupStateTimeout.NoTimeout
    )


# --- stateless and windowed forms ---------------------------------------------------
def bucketed(rows: DataFrame, time: str, value: str, width: str = "1 second", delay: str | None = None) -> DataFrame:
    """First value of each session and tumbling window (batch or stream)."""
    df = rows.withWatermark(time, delay) if delay else rows
    return df.groupBy("session_id", F.window(time, width)).agg(
        F.min_by(value, F.struct(time, "event_id")).alias("first_value"), F.count("*").alias("n")
    ).select("session_id", F.col("window.start").alias("start"), "first_value", "n")


def deduplicate(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Drop repeats of a row that arrive within the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def flag_late(rows: DataFrame, line, clock: str, allowed: int) -> DataFrame:
    """Adds ``late``: the row's clock lies more than ``allowed`` behind an earlier-arrived row.

    Late rows go to a side table; the live clock itself is the running maximum.
    """
    from foretide.operators.timeline import running

    r = running(rows, line, maxima={"_seen": F.col(clock)}, inclusive=False)
    return r.withColumn("late", F.coalesce(F.col(clock) < F.col("_seen") - allowed, F.lit(False))).drop("_seen")


LATE_STATE = T.StructType([T.StructField("seen", T.DoubleType())])


def late_rows(stream: DataFrame, clock: str, arrival: Sequence[str], allowed: float) -> DataFrame:
    """Streaming form of :func:`flag_late`: session_id, event_id, the clock and ``late`` of every row.

    The state of a session is the greatest clock that has arrived; rows of one micro-batch
    count in the order of ``arrival``.
    """

    def run(key, batches, state):
        seen = state.get[0] if state.exists else float("-inf")
        for part in ordered(batches, arrival, tuple(dict.fromkeys([*arrival, "event_id", clock]))):
            before = np.maximum.accumulate(np.append(seen, part[clock].astype(float)))
            seen = float(before[-1])
            yield pd.DataFrame({"session_id": key[0], "event_id": part["event_id"], clock: part[clock], "late": part[clock] < before[:-1] - allowed})
        state.update((seen,))

    kind = dict(stream.dtypes)[clock]
    return stream.groupBy("session_id").applyInPandasWithState(
        run, f"session_id long, event_id long, {clock} {kind}, late boolean", LATE_STATE, "append", GroupStateTimeout.NoTimeout
    )


# --- sinks ---------------------------------------------------------------------------
def split_sink(stream: DataFrame, path: str, checkpoint: str, column: str = "late"):
    """One pass per micro-batch that writes kept and late rows to folders of their own (``late=false`` / ``late=true``).

    A replayed batch overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(column).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_frames(stream: DataFrame, path: str, checkpoint: str, clock: str = "ts_ms", buckets: int = 16):
    """Append rows by day, a session's rows of a day in one file per batch; returns the started query.

    Days are few however many sessions there are; ``buckets`` files at most per day and batch.
    """
    placed = stream.withColumn("day", F.to_date(F.timestamp_millis(clock)))
    return (
        placed.repartition(F.col("day"), F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
        .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("day").outputMode("append").trigger(availableNow=True).start()
    )


def batch_sink(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Write every micro-batch to its own folder: replaying a batch overwrites it with equal rows."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).withColumn("ingest_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def sink_predictions(stream: DataFrame, path: str, checkpoint: str):
    """Idempotent forecast sink: batches are appended as written, the upsert happens on read.

    A stored table is never rewritten per batch, so the cost of a batch does not grow
    with the table.
    """
    return batch_sink(stream, path, checkpoint, lambda d: d.where("status = 'ready'"))


def stored_predictions(log: DataFrame) -> DataFrame:
    """Current forecasts of a batch log: last write per (session, time) wins."""
    order = F.struct("ingest_batch", "event_id")
    both = log.withColumn("ingest_seq", order)
    return upsert_predictions(both.limit(0), both).drop("ingest_seq")


def milestone_batch(path: str, order: Sequence[str], marks: tuple[int, ...] = TRAINING_MILESTONES) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: counts usable runs as they arrive and logs each milestone once, with the run that hit it.

    ``path`` gets one tally row per batch and the hits of each batch.  A batch reads the tallies
    of earlier batches only and overwrites its own files, so a replay changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        spark = batch.sparkSession
        earlier = spark.read.schema("batch long, n long").parquet(f"{path}/tally").where(F.col("batch") < number) if number else None
        prior = (earlier.agg(F.sum("n")).first()[0] or 0) if number else 0
        n = batch.count()
        batch.sparkSession.range(1).select(F.lit(n).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/tally/batch={number}")
        # Only the first rows of a batch can hit a milestone: a top-k.
        first = batch.orderBy(*order).limit(max(marks)) if prior < max(marks) else batch.limit(0)
        placed = first.withColumn("milestone", F.row_number().over(Window.orderBy(*order)) + F.lit(prior).cast("int"))
        hits = placed.where(F.col("milestone").isin(*marks)).select("milestone", "session_id")
        hits.coalesce(1).write.mode("overwrite").parquet(f"{path}/hits/batch={number}")

    return write


def milestone_sink(stream: DataFrame, path: str, checkpoint: str, order: Sequence[str], marks: tuple[int, ...] = TRAINING_MILESTONES):
    """Start the milestone log over a stream of usable runs."""
    return (
        stream.writeStream.foreachBatch(milestone_batch(path, order, marks)).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def milestones(usable: DataFrame, order, reached: DataFrame | None = None, marks: tuple[int, ...] = TRAINING_MILESTONES) -> DataFrame:
    """Milestones the usable-run count has hit, with the run that hit them, minus those logged before.

    Only the first ``max(marks)`` runs matter, so the numbering is a top-k.
    """
    from pyspark.sql import Window

    first = usable.orderBy(*order).limit(max(marks))
    hit = first.withColumn("milestone", F.row_number().over(Window.orderBy(*order))).where(F.col("milestone").isin(*marks))
    hit = hit.select("milestone", "session_id")
    return hit if reached is None else hit.join(reached.select("milestone"), "milestone", "left_anti")
