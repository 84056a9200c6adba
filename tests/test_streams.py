"""Stateful stream operators: order inside a micro-batch, timers, late rows, replays."""

import os
import random
import resource
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.streaming import live as L


def test_slices_are_in_order_and_flat():
    rng = random.Random(1)
    rows = [(rng.randrange(500), i, rng.choice(["frame", "paused", "odd"]), None if i % 7 == 0 else [float(i), 2.0 * i]) for i in range(1000)]
    frames = [pd.DataFrame(rows[a : a + 130], columns=["ts_ms", "event_id", "kind", "vector"]) for a in range(0, 1000, 130)]
    parts = list(L.ordered(iter(frames), ("ts_ms", "event_id"), ("ts_ms", "event_id"), {"kind": L.LIVE_KINDS}, "vector"))
    got = [(int(t), int(e), int(k), v.tolist()) for p in parts for t, e, k, v in zip(p["ts_ms"], p["event_id"], p["kind"], p["vector"])]
    codes = {"frame": 0, "paused": 1, "odd": -1}
    want = [(t, e, codes[k], v) for t, e, k, v in sorted(rows, key=lambda r: r[:2])]
    assert [(t, e, k) for t, e, k, _ in got] == [(t, e, k) for t, e, k, _ in want]
    assert all(g[3] == w[3] if w[3] else np.isnan(g[3]).all() for g, w in zip(got, want))


def test_empty_batches():
    assert list(L.ordered(iter([]), ("ts_ms",), ("ts_ms",))) == []


class State:
    """What the keyed function sees of the state."""

    exists, hasTimedOut, value = False, False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True


def history_function(model, **options):
    """The function that :func:`live_history` hands to Spark."""
    caught = {}

    class Grouped:
        def applyInPandasWithState(self, run, *_):
            caught["run"] = run

    class Stream:
        def groupBy(self, _):
            return Grouped()

    L.live_history(Stream(), model, **options)
    return caught["run"]


def frames_of(n, rng=None):
    rng = rng or np.random.default_rng(2)
    return pd.DataFrame(
        {"session_id": 1, "ts_ms": np.arange(n) * 250, "event_id": np.arange(n), "active_ms": np.arange(n) * 250, "kind": "frame", "vector": list(rng.random((n, 3)))}
    )


def model_of(members=5):
    rng = np.random.default_rng(3)
    return L.LiveModel(rng.normal(0, 0.3, (members, 7, 15)), rng.normal(0, 1, (members, 7)))


def test_a_million_rows_of_one_session_in_one_batch():
    run = history_function(None)
    n = 1_000_000
    order = np.random.default_rng(4).permutation(n)

    def batches():
        for a in range(0, n, 10_000):
            at = order[a : a + 10_000]
            yield pd.DataFrame({"session_id": 1, "ts_ms": at * 250, "event_id": at, "active_ms": at * 250, "kind": "frame", "vector": list(np.ones((len(at), 3)))})

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    seen, last = 0, -1
    for out in run((1,), batches(), State()):
        assert out["ts_ms"].iloc[0] > last and out["ts_ms"].is_monotonic_increasing and len(out) <= L.SLICE_ROWS
        last, seen = out["ts_ms"].iloc[-1], seen + len(out)
    assert seen == n
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # KB


def test_results_do_not_depend_on_micro_batches():
    rows = frames_of(400)
    rows.loc[rows["event_id"] == 150, "kind"] = "paused"
    rows.loc[rows["event_id"] == 170, "kind"] = "active"
    whole = pd.concat(history_function(model_of())((1,), iter([rows.sample(frac=1, random_state=1)]), State()))
    run, state, parts = history_function(model_of()), State(), []
    for a in range(0, 400, 37):
        parts += list(run((1,), iter([rows[a : a + 37]]), state))
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), pd.concat(parts).reset_index(drop=True))
    ready = whole[whole["status"] == "ready"]
    assert (whole["status"] == "paused").sum() == 19 and len(ready) > 250
    assert ready["forecast_ts_ms"].nunique() == len(set(ready["forecast_ts_ms"])) < len(ready)


def test_forecast_columns(spark):
    model = model_of()
    out = pd.concat(history_function(model, throttle_ms=0)((1,), iter([frames_of(90)]), State()))
    ready = out[out["status"] == "ready"]
    vectors = np.stack(frames_of(90)["vector"])
    probs = []
    for i, row in ready.iterrows():
        members = model.members(vectors[max(0, row["event_id"] - 35) : row["event_id"] + 1])
        probs.append(np.maximum.accumulate(np.median(members, axis=0)))
        p = np.maximum.accumulate(np.mean(probs[-3:], axis=0))
        assert np.allclose(row["p"], p)
        assert np.allclose([row["low"], row["high"]], np.quantile([model.remaining(m) for m in members], [0.1, 0.9]))
        apart = members.std(0).mean()
        assert row["certainty"] == ("high" if apart <= 0.04 else "medium" if apart <= 0.1 else "low")
    df = spark.createDataFrame(ready[["p", "loss_window", "label"]])
    crossing = S.first_crossing(F.col("p"))
    assert df.where((S.loss_window(crossing) != F.col("loss_window")) | (S.window_label(S.loss_window(crossing)) != F.col("label"))).count() == 0


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream whose micro-batches are the given lists of rows."""

    def build(schema, *batches):
        folder = tmp_path / "in"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/file={i}")
            for part in (folder / f"file={i}").glob("*.parquet"):
                os.utime(part, (1_000 + i, 1_000 + i))
        kind = spark.createDataFrame([], schema).schema
        return spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))

    return build


def test_timers_close_without_another_row(spark, arriving, tmp_path):
    def row(session, second, signal):
        second += 1_000  # a watermark starts at 0, and what is not later than it is late
        return (session, second * 1000, session * 1000 + second, signal, datetime.fromtimestamp(second, tz=timezone.utc))

    first = [row(1, 0, "ok"), row(2, 0, "failed"), row(3, 0, "failed"), row(4, 0, "ok"), row(4, 1, "game_over"), row(6, 0, "failed")]
    second = [row(3, 2, "ok"), row(5, 40, "ok"), row(6, 3, "ok")]
    stream = arriving("session_id long, ts_ms long, event_id long, signal string, ts timestamp", first, second, [row(5, 60, "ok")])
    out = str(tmp_path / "out")
    L.batch_sink(L.close_sessions(stream, 3_000, 20_000, "5 seconds"), out, str(tmp_path / "log")).awaitTermination()
    got = sorted((r["session_id"], r["ts_ms"], r["reason"]) for r in spark.read.parquet(out).collect())
    # 1 and 3 fall silent, 2 keeps failing, 4 ends itself, 5 is still heard, 6 recovers at its deadline and falls silent.
    want = [(1, 20_000, "capture_error"), (2, 3_000, "capture_error"), (3, 22_000, "capture_error"), (4, 1_000, "game_over"), (6, 23_000, "capture_error")]
    assert got == [(k, 1_000_000 + t, why) for k, t, why in want]


def test_late_rows_go_to_a_side_table(spark, arriving, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.randrange(1000), i) for i in range(300)]
    stream = arriving("session_id long, event_id long, clock long, arrival long", rows[:100], rows[100:210], rows[210:])
    out = str(tmp_path / "out")
    L.split_sink(L.late_rows(stream, "clock", ("arrival",), 200), out, str(tmp_path / "log")).awaitTermination()
    got = {r["event_id"]: str(r["late"]) == "true" for r in spark.read.parquet(out).collect()}
    seen, want = {}, {}
    for session, event, clock, _ in rows:
        want[event] = clock < seen.get(session, -1e9) - 200
        seen[session] = max(clock, seen.get(session, -1e9))
    assert got == want


def test_a_replayed_batch_adds_no_milestone(spark, tmp_path):
    path = str(tmp_path / "log")
    write = L.milestone_batch(path, ["started_ms", "session_id"], (3, 5, 8))

    def batch(a, b):
        return spark.createDataFrame([(i, 1000 - i) for i in range(a, b)], "session_id long, started_ms long")

    for number, part in enumerate([batch(0, 4), batch(4, 4), batch(4, 10), batch(10, 30)]):
        write(part, number)
        write(part, number)
    write(batch(4, 10), 2)
    hits = sorted((r["milestone"], r["session_id"]) for r in spark.read.schema("milestone int, session_id long").parquet(f"{path}/hits").collect())
    assert hits == [(3, 1), (5, 9), (8, 6)]  # within a batch by start: later ids start earlier here
