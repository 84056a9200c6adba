"""Block-wise evaluation of recursive rules equals the plain loop."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foretide.operators import timejoin as J
from foretide.operators import windows as W
from foretide.operators.chain import clamps, entry_states, state_maps
from foretide.operators.timeline import Timeline


def test_entry_states_over_several_levels(spark):
    rng = np.random.default_rng(0)
    n = 300
    lo = rng.integers(-5, 5, n)
    hi = lo + rng.integers(0, 4, n)
    q, expected = 0, []
    for a, b in zip(lo, hi):
        expected.append(q)
        q = min(max(q, a), b)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "pos": np.arange(n), "lo": lo, "hi": hi})).select("k", "pos", F.struct("lo", "hi").alias("change"))
    got = entry_states(df, ["k"], clamps(), 0, block=4, levels=3).orderBy("pos").toPandas()
    assert got.state.tolist() == expected
    maps = rng.integers(0, 3, (n, 3))
    q, expected = 2, []
    for m in maps:
        expected.append(q)
        q = int(m[q])
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "pos": np.arange(n), "change": maps.tolist()}))
    got = entry_states(df, ["k"], state_maps(3), 2, block=5, levels=2).orderBy("pos").toPandas()
    assert got.state.tolist() == expected


def greedy(events, truth, ahead, behind):
    free, out = sorted(truth), []
    for e in events:
        options = [t for t in free if t - ahead <= e <= t + behind]
        if options:
            free.remove(options[0])
            out.append(("matched", e, options[0]))
        else:
            out.append(("false", e, None))
    return sorted(out + [("missed", None, t) for t in free], key=str)


def test_matching_known_case(spark):
    ev = spark.createDataFrame([(1, x) for x in (10, 11, 12, 20)], "c long, at long")
    tr = spark.createDataFrame([(1, x) for x in (11, 24)], "c long, at long")
    got = {(r.kind, r.event_at, r.truth_at) for r in J.match_events(ev, tr, ["c"], 1, 6).collect()}
    assert got == {("matched", 10, 11), ("false", 11, None), ("false", 12, None), ("false", 20, None), ("missed", None, 24)}


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_against_loop(spark, seed):
    rng = np.random.default_rng(seed)
    ev = {c: sorted(rng.choice(400, 150 if c == 0 else 20, replace=False).tolist()) for c in range(4)}
    tr = {c: sorted(rng.choice(400, 140 if c == 0 else 25, replace=False).tolist()) for c in range(4)}
    to = lambda d: spark.createDataFrame([(c, x) for c, xs in d.items() for x in xs], "c long, at long")
    rows = J.match_events(to(ev), to(tr), ["c"], 1, 6, width=16).collect()
    for c in range(4):
        got = sorted([(r.kind, r.event_at, r.truth_at) for r in rows if r.c == c], key=str)
        assert got == greedy(ev[c], tr[c], 1, 6)


@pytest.mark.parametrize("width", [40, 100_000])
def test_thin_against_loop(spark, width):
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.integers(0, 120, 400))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": t, "id": np.arange(400)}))
    kept, last = [], None
    for i, x in enumerate(t):
        if last is None or x >= last + 240:
            kept.append(i)
            last = x
    got = W.thin(df, Timeline(("k",), ("t", "id"), "t", width), 240)
    assert sorted(r.id for r in got.collect()) == kept


def alert_loop(rows, on=3, off=3, gap=1.6):
    """(index, active, onset) of every sampled row, by direct simulation."""
    out, active, up, down, prev = [], False, 0, 0, None
    for i, (t, p, seg) in enumerate(rows):
        if prev and prev[1] == seg and math.floor(prev[0]) == math.floor(t):
            continue
        if prev is None or prev[1] != seg or t - prev[0] > gap:
            active, up, down = False, 0, 0
        if not math.isfinite(p):
            active, up, down, prev = False, 0, 0, None
            continue
        up, down = (up + 1 if p > 0.5 else 0), (down + 1 if p < 0.5 else 0)
        onset = False
        if not active and up >= on:
            active, onset, up = True, True, 0
        elif active and down >= off:
            active, down = False, 0
        out.append((i, active, onset))
        prev = (t, seg)
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_alerts_against_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    t = np.cumsum(rng.choice([0.2, 0.5, 1.0, 1.0, 1.0, 1.5, 1.7], n)).round(3)
    p = rng.choice([0.2, 0.5, 0.9, 0.9, np.nan], n, p=[0.35, 0.05, 0.3, 0.27, 0.03])
    p = np.repeat(p[: n // 3 + 1], 3)[:n]
    seg = np.cumsum(rng.random(n) < 0.02)
    pdf = pd.DataFrame({"k": 1, "i": np.arange(n), "t": t, "p": p, "segment": seg, "ms": (t * 1000).round().astype("int64")})
    line = Timeline(("k",), ("ms", "i"), "ms", 9_000)
    got = W.alert_states(spark.createDataFrame(pdf), line).select("i", "active", "onset").collect()
    assert sorted(tuple(r) for r in got) == alert_loop(list(zip(t, p, seg)))


def test_alerts_known_case(spark):
    p = [1, 1, 0, 1, 1, 1, 0, 0, 0]
    pdf = pd.DataFrame({"k": 1, "i": range(9), "t": np.arange(9.0), "p": np.array(p, float), "segment": 1, "ms": np.arange(9) * 1000, "r": 40.0 - np.arange(9)})
    line = Timeline(("k",), ("ms", "i"), "ms", 4_000)
    states = W.alert_states(spark.createDataFrame(pdf), line)
    assert [r.r for r in states.where("onset").collect()] == [35.0]
    m = W.alert_metrics(states, ["k"]).first()
    assert (m.alerts, m.timely, m.false_alerts, m.timely_recall) == (1, 1, 0, 1.0)
    broken = pdf.assign(segment=[1, 1, 1, 1, 2, 2, 2, 2, 2])
    assert W.alert_states(spark.createDataFrame(broken), line).where("onset").count() == 0


def verified_loop(f):
    """48 numbers of one 33-row window, by direct evaluation."""
    h, r, c, k = (np.array([x[n] for x in f]) for n in ("height", "incoming", "colour", "conf"))
    phase, a = np.array([x["phase"] for x in f]), np.array([x["apothem"] for x in f])
    xy = np.array([(x["cx"], x["cy"]) for x in f])
    pairs = range(1, 33)
    stable = [
        abs(phase[i - 1]) <= 5 and abs(phase[i]) <= 5 and abs(a[i] / a[i - 1] - 1) < 0.03 and np.hypot(*(xy[i] - xy[i - 1])) < 0.03 * a[i - 1]
        for i in pairs
    ]
    step = [r[i - 1] - r[i] for i in pairs]
    match = [
        [bool(stable[i - 1] and c[i - 1][l] >= 0 and c[i - 1][l] == c[i][l] and k[i - 1][l] >= 0.7 and k[i][l] >= 0.7 and 0.004 < step[i - 1][l] < 0.25) for l in range(6)]
        for i in pairs
    ]
    ok = [[i >= 2 and match[i - 1][l] and match[i - 2][l] and c[i][l] == c[i - 2][l] for l in range(6)] for i in pairs]
    appear = [sum(stable[i - 1] and c[i - 1][l] < 0 <= c[i][l] for l in range(6)) for i in pairs]
    land = [
        sum(bool(stable[i - 1] and r[i - 1][l] - h[i - 1][l] < 0.2 and c[i - 1][l] >= 0 and r[i][l] - r[i - 1][l] > 0.15 and h[i][l] - h[i - 1][l] > 0.025) for l in range(6))
        for i in pairs
    ]
    act, base, at = [0.0] * 32, None, -99
    for i in pairs:
        if not (stable[i - 1] and np.max(np.abs(np.sort(h[i]) - np.sort(h[i - 1]))) < 0.035):
            continue
        now = (h[i].sum() + h[i - 1].sum()) / 2
        if base is not None and i - at <= 3 and abs(now - base) > 0.06:
            act[i - 1] = now - base
        base, at = now, i
    out = []
    for n in (4, 8, 16, 32):
        speeds = [step[j][l] * 4 for j in range(32 - n, 32) for l in range(6) if ok[j][l]]
        out += [float(np.quantile(speeds, q)) if speeds else 0.0 for q in (0.5, 0.25, 0.75, 1.0)]
        g = np.array(act[-n:])
        out += [np.mean(ok[-n:]), sum(appear[-n:]), sum(land[-n:]), g.clip(0).sum(), (-g).clip(0).sum(), (g > 0.06).sum(), (g < -0.06).sum(), g.sum()]
    return np.array(out, float)


def test_verified_motion_against_loop(spark):
    rng = np.random.default_rng(4)
    frames, h = [], rng.random(6) * 0.4 + 0.3
    r = rng.random(6) + 0.9
    for i in range(80):
        h = h + rng.choice([0, 0, 0.01, -0.012, 0.03], 6) - (0.2 if i % 17 == 0 else 0) * np.eye(6)[i % 6]
        r = np.where(rng.random(6) < 0.1, 1.9, r - rng.choice([0.02, 0.05, 0.3], 6, p=[0.6, 0.35, 0.05]))
        frames.append(
            dict(run=1, at=i, height=h.tolist(), incoming=r.tolist(), colour=((np.arange(6) + i // 9) % 4 - (rng.random(6) < 0.1)).astype(int).tolist(),
                 conf=(0.69 + rng.random(6) * 0.3).tolist(), phase=int(rng.choice([0, 2, 9], p=[0.5, 0.4, 0.1])), apothem=100.0 + rng.random(), cx=50.0, cy=50.0)
        )
    schema = "run long, at long, height array<double>, incoming array<double>, colour array<int>, conf array<double>, phase int, apothem double, cx double, cy double"
    df = spark.createDataFrame([tuple(f[n.split()[0]] for n in schema.split(", ")) for f in frames], schema)
    got = W.verified_motion(df, Timeline(("run",), ("at",), "at", 13)).where("motion is not null").orderBy("at").collect()
    assert [g.at for g in got] == list(range(32, 80))
    for g in got:
        assert np.allclose(g.motion, verified_loop(frames[g.at - 32 : g.at + 1]), atol=1e-9)


def test_motion_known_case(spark):
    df = spark.createDataFrame(
        [(1, i, [0.3] * 6, [1.9 - 0.025 * i] + [2.1] * 5, 0) for i in range(33)], "run long, at long, height array<double>, incoming array<double>, phase int"
    )
    m = W.motion_features(df, Timeline(("run",), ("at",), "at", 10)).where("motion is not null").first().motion
    assert m[0] == pytest.approx(0.1) and m[4] == pytest.approx(1 / 6)
    off = W.motion_features(df.withColumn("phase", F.lit(20)), Timeline(("run",), ("at",), "at", 10)).where("motion is not null").first().motion
    assert off[0] == 0 and off[4] == 0
