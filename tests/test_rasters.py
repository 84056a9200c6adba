"""Samples of rasters: found where they are made, equal to the join, and no raster broadcast."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foretide.operators import board as B


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scene(spark):
    """Three frames of 9 x 70 pixels made by exploding few rows; the second frame's pixels and geometry come twice, the third has no pixel."""
    f = spark.createDataFrame([(1,), (2,), (2,)], "frame long")
    px = f.select("frame", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("y")).select("frame", "y", F.explode(F.sequence(F.lit(0), F.lit(69))).alias("x"))
    px = px.where("(x * 7 + y * 3 + frame) % 5 <> 0").withColumn("colour", ((F.col("x") + F.col("y")) % 4).cast("int"))
    geo = spark.createDataFrame([(1, 35.0), (2, 35.0), (2, 30.0), (3, 35.0), (None, 35.0)], "frame long, cx double").select(
        "frame", "cx", F.lit(4.0).alias("cy"), F.lit(6.0).alias("apothem"), F.lit(True).alias("valid")
    )
    return px, geo


@pytest.mark.parametrize("clamp", [True, False])
def test_raster_samples_equal_the_join(scene, clamp):
    px, geo = scene
    points = lambda g: B.strip_points(g, 0.3, 2.1, 0.3, [-0.1, 0.0, 0.1], 7.0)
    joined = B.sample(points(geo), px, 70, 9, clamp)
    found = B.sample_raster(points(B.with_raster(geo, px, 70, 9)), 70, 9, clamp)
    columns = sorted(joined.columns)
    both = [df.select(*columns).toPandas().sort_values(columns).reset_index(drop=True) for df in (joined, found)]
    assert len(both[0]) > 5 * 6 * 6 * 3
    pd.testing.assert_frame_equal(*both)


def test_rasters_are_not_broadcast(scene):
    px, geo = scene
    points = B.strip_points(geo, 0.3, 2.1, 0.3, [0.0])
    lanes = geo.select("frame", F.lit(1).alias("lane"), F.lit(0.3).alias("height"))
    for df in (B.sample(points, px, 70, 9), B.with_raster(geo, px, 70, 9)):
        assert "Broadcast" not in plan_of(df)
    near = B.incoming(geo, lanes, px)
    # What is broadcast holds a row per lane at most, so no pixel.
    assert "BroadcastExchange" not in plan_of(near).split("percentile", 1)[-1]


def test_dark_steps_are_not_exchanged(scene):
    px, geo = scene
    rgb = px.select("frame", "y", "x", *[F.when((F.col("x") > 30) & (F.col("y") > 1), 0.1).otherwise(0.9).alias(c) for c in "rgb"])
    facing = B.orientation(geo, rgb, 70, 9)
    assert not [line for line in plan_of(facing).splitlines() if "Exchange hashpartitioning" in line and "ray" in line]
    # The last dark step of each ray, by a plain loop over the dark pixels.
    dark = {(r.frame, r.y, r.x) for r in rgb.where("r < 0.2").collect()}
    usable = {r.frame: r.usable for r in facing.collect()}
    for frame, centres in ((1, (35.0,)), (2, (35.0, 30.0)), (3, (35.0,))):
        good = 0
        for ray in range(180):
            outer, a = 0.0, ray * (2 * math.pi / 180) - math.pi
            for cx in centres:
                for i in range(101):
                    r = i * (0.25 / 100) + 0.20
                    x = max(0, min(69, round(cx + math.cos(a) * r * 6.0)))
                    y = max(0, min(8, round(4.0 + math.sin(a) * r * 6.0)))
                    if (frame, y, x) in dark and math.hypot(x - cx, y - 4.0) / 6.0 < 0.46:
                        outer = max(outer, r)
            good += outer > 0.22
        assert usable[frame] == pytest.approx(good / 180)
