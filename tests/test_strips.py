"""Votes along strips by numpy against joined samples, and whole frames out of any batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foretide.operators import board as B
from foretide.operators import components as K

W, H = 26, 22
GEO = "frame long, valid boolean, cx double, cy double, apothem double, phase int, core_ratio double"


def scene(spark, frames=70):
    """Frames of 3 x 3 blocks, some given twice, some with odd geometries; more than are worked off at once."""
    rng = np.random.default_rng(12)
    px, geo = [], []
    for f in range(frames):
        grid = np.repeat(np.repeat(rng.integers(-1, 3, (8, 9)), 3, 0), 3, 1)
        grid[grid == 2] = rng.integers(0, 2)
        px += [(f, y, x, int(grid[y, x])) for y in range(H + 1) for x in range(W + 1) if grid[y, x] >= 0] * (2 if f % 20 == 3 else 1)
        geo.append((f, True, 12.0 + f % 3, 11.0, 7.0 + f % 4, f % 60 - 30, 0.32))
    px += [(5, y, x, 3) for y in range(8, 14) for x in range(W)] + [(None, 1, 1, 1), (900, 1, 1, 1), (6, None, 1, 1)]
    geo += [geo[7], (8, True, 12.0, 11.0, 7.0, 0, 0.4), (9, True, 3.0, 4.0, 9.0, 0, 0.32)]
    geo[10] = (10, True, 12.0, 11.0, 9.0, None, 0.32)
    geo[11] = (11, True, None, 11.0, 9.0, 0, 0.32)
    geo[12] = (12, True, 12.0, 11.0, 9.0, 0, None)
    geo[13] = (13, True, 12.0, 11.0, 9.0, 4, 0.95)  # steps count downwards
    geo += [(None, True, 12.0, 11.0, 9.0, 0, 0.32), (901, True, 12.0, 11.0, 9.0, 0, 0.32)]
    return spark.createDataFrame(px, "frame long, y int, x int, colour int"), spark.createDataFrame(geo, GEO)


def labels(points, px, votes, clamp):
    """Most votes win, the lower colour on ties, over joined samples."""
    inside = px.where(F.col("y").between(0, H - 1) & F.col("x").between(0, W - 1))
    s = B.sample(points, inside, W, H, clamp).where("colour is not null")
    n = s.groupBy("frame", "lane", "j", "radius", "colour").count().collect()
    best = {}
    for r in n:
        at = (r.frame, r.lane, r.j, r.radius)
        best[at] = max(best.get(at, (0, 0)), (r["count"], -r.colour))
    return {at: (-c, n) for at, (n, c) in best.items() if n >= votes}


def test_steps_of_lanes_equal_joined_samples(spark):
    px, geo = scene(spark)
    offsets = [-0.085 + 0.17 * i / 14 for i in range(15)]
    dealt = B._strips_dealt(geo, px, W, H)
    out = K.by_frames(
        dealt, lambda t: B._lane_table(t, B._strip_labels(t, W, H, 0.008, 0.94, 0.012, offsets, 7, True)),
        "frame long, lane int, steps array<struct<j:int,radius:double,colour:int>>",
    )
    got = {(r.frame, r.lane, s.j, s.radius): s.colour for r in out.collect() if r.frame is not None for s in r.steps}
    points = B.strip_points(geo, F.col("core_ratio") + 0.008, 0.94, 0.012, offsets, F.col("phase"))
    want = {at: c for at, (c, _) in labels(points, px, 7, True).items()}
    assert got == want and len(want) > 5000 and min(j for f, _, j, _ in want if f == 13) < 0


def test_runs_of_lanes_equal_joined_samples(spark):
    px, geo = scene(spark)
    stacks = B.lane_stacks(geo, px, W, H)
    found = B.incoming_runs(geo, stacks, px, W, H, length=5)
    want, offsets = {}, [-0.06 + 0.12 * i / 8 for i in range(9)]
    run = {}
    for (frame, lane, j, radius), (colour, n) in sorted(labels(B.strip_points(geo, 0.35, 2.1, 0.006, offsets), px, 6, False).items()):
        if run.get("at") != (frame, lane, j - 1, colour):
            run = {"radius": radius, "n": [], "colour": colour}
            want.setdefault((frame, lane), []).append(run)
        run["at"] = (frame, lane, j, colour)
        run["n"].append(n / 9)
    heights = {}
    for r in stacks.collect():
        heights.setdefault(r.frame, {})[r.lane] = r.height
    phase = {r.frame: r.phase for r in geo.collect()}
    seen = 0
    for r in found.where("frame is not null and frame not in (7, 8, 9)").collect():
        tall = heights[r.frame][r.lane] if phase[r.frame] is not None and abs(phase[r.frame]) <= 5 else max((h for h in heights[r.frame].values() if h is not None), default=None)
        over = [x for x in want.get((r.frame, r.lane), []) if len(x["n"]) >= 5 and x["radius"] > max(0.48, (tall or 0.0) + 0.07)]
        first = over[0] if over else {"radius": 2.1, "colour": -1, "n": [0.0]}
        seen += bool(over)
        assert (r.incoming, r.colour) == (first["radius"], first["colour"]) and np.isclose(r.confidence, np.mean(first["n"]))
    assert seen > 20


def test_samples_are_neither_rows_nor_sorted_by_step(spark):
    px, geo = scene(spark, 15)
    runs = B.incoming_runs(geo, B.lane_stacks(geo, px, W, H), px, W, H)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_raster" not in plan and "sx" not in plan
    # Both kinds of strips read one exchange of the pixels.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = runs.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("REPARTITION_BY_NUM") - plan.count("ReusedExchange [frame#, cell#") <= 2 and "ReusedExchange [frame" in plan


def test_frames_stay_whole_in_batches_of_any_size():
    frames = [None] * 3 + [1] * 7 + [2] + [4] * 40 + [5, 6, 7]
    whole = pa.record_batch({"frame": pa.array(frames, pa.int64()), "i": pa.array(range(len(frames)))})
    for size in (1, 2, 5, 100):
        for rows in (1, 4, 1000):
            batches = [whole.slice(i, size) for i in range(0, len(frames), size)] + [whole.slice(0, 0)]
            parts = []
            done = list(K.whole_frames(iter(batches), lambda t: parts.append(t["frame"].to_pylist()) or t, rows))
            assert [i for b in done for i in b["i"].to_pylist()] == list(range(len(frames)))
            assert not any(a[-1] == b[0] for a, b in zip(parts, parts[1:]))
            assert rows > 4 or len(parts) > 1
    assert list(K.whole_frames(iter([]), lambda t: t)) == []
