"""Pixel and board-geometry features as joins and aggregates over a pixel table.

Pixels are rows (frame, y, x, r, g, b) with channels in [0, 1].  One frame has a
fixed, small number of pixels, so a frame is the natural unit of parallelism: all
windows and groups below are per frame (or smaller), never per run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.functions import scalars as S
from foretide.operators.chain import entry_states, state_maps
from foretide.operators.components import by_frames, drop_specks, frame_starts
from foretide.operators.timeline import (
    Timeline,
    drop_halo,
    previous_row,
    row_numbers,
    running,
    with_earlier_rows,
    with_earlier_time,
)
from foretide.settings import materialise

# Block colours (red, yellow, blue, green) and the board's gray.
PALETTE = ((231, 76, 60), (241, 196, 15), (52, 152, 219), (46, 204, 113))
BOARD_GRAY = (189, 195, 199)
# Ring masks of the low-resolution raster, in units of half its width.
RING_INNER, RING_OUTER, NEAR_OUTER, OUTER_INNER = 0.12, 0.43, 0.27, 0.30
COLOURFUL, DARK = 0.16, 0.08
NO_INCOMING = 2.1

NORMAL_ANGLES = [math.radians(30 + 60 * k) for k in range(6)]


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def luma() -> Column:
    r, g, b = _rgb()
    return r * 0.299 + g * 0.587 + b * 0.114


def span() -> Column:
    return F.greatest(*_rgb()) - F.least(*_rgb())


# --- decoding -------------------------------------------------------------------
def to_pixels(images: DataFrame, n: int, key: str = "frame") -> DataFrame:
    """Image structs (height, width, nChannels, BGR bytes) to an n x n pixel table.

    The only Python step turns bytes into rows, batch by batch; the resize is a box
    average in Spark.
    """
    schema = f"{key} bigint, y int, x int, h int, w int, r double, g double, b double"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                h, w, c = int(row.height), int(row.width), int(row.nChannels)
                a = np.frombuffer(row.data, dtype=np.uint8).reshape(h, w, c)
                a = np.repeat(a, 3, axis=2) if c == 1 else a
                yy, xx = np.divmod(np.arange(h * w), w)
                flat = a[:, :, :3].reshape(-1, 3) / 255.0
                yield pd.DataFrame(
                    {key: np.int64(getattr(row, key)), "y": yy.astype("int32"), "x": xx.astype("int32"), "h": np.int32(h),
                     "w": np.int32(w), "r": flat[:, 2], "g": flat[:, 1], "b": flat[:, 0]}
                )

    flat = images.select(key, "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(unpack, schema)
    cell_y = F.floor(F.col("y") * n / F.col("h")).cast("int")
    cell_x = F.floor(F.col("x") * n / F.col("w")).cast("int")
    return flat.groupBy(key, cell_y.alias("y"), cell_x.alias("x")).agg(*[F.avg(c).alias(c) for c in "rgb"])


def letterbox(px: DataFrame, h: int, w: int, height: int, width: int) -> DataFrame:
    """Fit h x w rasters into height x width, keeping the aspect, centred on black."""
    scale = min(width / w, height / h, 1.0)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    ox, oy = (width - nw) // 2, (height - nh) // 2
    small = px.groupBy(
        "frame",
        (F.floor(F.col("y") * nh / h) + oy).cast("int").alias("y"),
        (F.floor(F.col("x") * nw / w) + ox).cast("int").alias("x"),
    ).agg(*[F.avg(c).alias(c) for c in "rgb"])
    grid = (
        px.select("frame").distinct()
        .select("frame", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
        .select("frame", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    )
    return grid.join(small.hint("merge"), ["frame", "y", "x"], "left").fillna(0.0, list("rgb"))


def transform_pixels(px: DataFrame, scale: float, pad_y: int = 0, pad_x: int = 0, h: int = 0, w: int = 0) -> DataFrame:
    """Rescaled (box average down, nearest up) and padded rasters for invariance checks."""
    if scale > 1:
        # The target cells whose floor(i / scale) is this pixel.
        def spread(c):
            lo, hi = F.ceil(F.col(c) * scale), F.ceil((F.col(c) + 1) * scale) - 1
            return F.explode(F.sequence(lo, hi)).alias(c)

        out = px.select("frame", spread("y"), "x", "r", "g", "b").select("frame", "y", spread("x"), "r", "g", "b")
    elif scale < 1:
        out = px.groupBy(
            "frame", F.floor(F.col("y") * scale).alias("y"), F.floor(F.col("x") * scale).alias("x")
        ).agg(*[F.avg(c).alias(c) for c in "rgb"])
    else:
        out = px.select("frame", "y", "x", "r", "g", "b")
    out = out.withColumn("y", (F.col("y") + pad_y).cast("int")).withColumn("x", (F.col("x") + pad_x).cast("int"))
    if not (pad_x or pad_y):
        return out
    th, tw = int(round(h * scale)) + 2 * pad_y, int(round(w * scale)) + 2 * pad_x
    return letterbox_fill(out, th, tw)


def letterbox_fill(px: DataFrame, height: int, width: int) -> DataFrame:
    """Complete every frame to a full height x width grid with black."""
    grid = (
        px.select("frame").distinct()
        .select("frame", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
        .select("frame", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    )
    return grid.join(px.hint("merge"), ["frame", "y", "x"], "left").fillna(0.0, list("rgb"))


# --- low-resolution raster features --------------------------------------------------
def ring_columns(px: DataFrame, n: int) -> DataFrame:
    """Adds radius, sector 0..5 and ring masks; the mask is arithmetic on (y, x), no join."""
    cx = F.col("x") * (2.0 / (n - 1)) - 1.0
    cy = F.col("y") * (2.0 / (n - 1)) - 1.0
    radius = F.sqrt(cx * cx + cy * cy)
    angle = F.pmod(F.atan2(cy, cx) + 2 * math.pi, F.lit(2 * math.pi))
    return (
        px.withColumn("radius", radius)
        .withColumn("sector", F.floor(angle / (math.pi / 3)).cast("int"))
        .withColumn("ring", F.col("radius").between(RING_INNER, RING_OUTER))
        .withColumn("near", F.col("radius").between(RING_INNER, NEAR_OUTER))
        .withColumn("outer", F.col("radius").between(OUTER_INNER, RING_OUTER))
        .withColumn("colourful", span() > COLOURFUL)
    )


def with_edges(px: DataFrame, n: int) -> DataFrame:
    """Adds gray, and its absolute difference to the left and upper neighbour (null at the border)."""
    w = Window.partitionBy("frame").orderBy("y", "x")
    g = F.col("gray")
    left = F.when(F.col("x") > 0, F.abs(g - F.lag(g, 1).over(w)))
    up = F.when(F.col("y") > 0, F.abs(g - F.lag(g, n).over(w)))
    return px.withColumn("gray", luma()).withColumn("_dx", left).withColumn("_dy", up)


def _share(cond: Column, among: Column | None = None) -> Column:
    one = cond.cast("double")
    return F.avg(one if among is None else F.when(among, one))


def frame_features(px: DataFrame, n: int, inner: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Per frame: appearance, edges, occupancy, pressure and sector statistics.

    One exchange by frame serves the neighbour windows and the single aggregation.
    """
    rows = ring_columns(with_edges(px, n), n)
    lo, hi = int(n * inner[0]), int(n * inner[1]) - 1
    centre = F.col("y").between(lo, hi) & F.col("x").between(lo, hi)
    col, ring = F.col("colourful"), F.col("ring")
    weight = S.clip((F.col("radius") - RING_INNER) / (RING_OUTER - RING_INNER), 0.0, 1.0)
    out = [
        F.avg("gray").alias("brightness"),
        F.stddev_pop("gray").alias("contrast"),
        F.avg(span()).alias("saturation"),
        _share(F.col("gray") > DARK).alias("non_dark"),
        (F.avg("_dx") + F.avg("_dy")).alias("edge_density"),
        F.avg(F.when(centre, F.col("gray"))).alias("centre_brightness"),
        _share(col, ring).alias("board_occupancy"),
        F.coalesce(_share(col, F.col("near")), F.lit(0.0)).alias("near_occupancy"),
        F.coalesce(_share(col, F.col("outer")), F.lit(0.0)).alias("outer_occupancy"),
        (F.sum(F.when(col & ring, weight).otherwise(0.0)) / F.greatest(F.lit(1), F.count(F.when(ring, 1)))).alias("radial_pressure"),
    ]
    for k in range(6):
        mine = ring & (F.col("sector") == k)
        out.append(F.coalesce(_share(col, mine), F.lit(0.0)).alias(f"occupancy_{k}"))
        reach = F.percentile(F.when(mine & col, F.col("radius")), 0.9)
        scaled = (F.coalesce(reach, F.lit(RING_INNER)) - RING_INNER) / (RING_OUTER - RING_INNER)
        out.append(S.clip(scaled, 0.0, 1.0).alias(f"reach_{k}"))
    f = rows.groupBy("frame").agg(*out)
    occ, reach = [F.col(f"occupancy_{k}") for k in range(6)], [F.col(f"reach_{k}") for k in range(6)]
    mean = sum(occ[1:], occ[0]) / 6
    var = sum(((o - mean) * (o - mean) for o in occ[1:]), (occ[0] - mean) * (occ[0] - mean)) / 6
    return (
        f.withColumn("sector_imbalance", F.sqrt(var))
        .withColumn("mean_reach", sum(reach[1:], reach[0]) / 6)
        .withColumn("max_reach", F.greatest(*reach))
    )


def pixel_motion(frames: DataFrame, px: DataFrame, line: Timeline) -> DataFrame:
    """Mean absolute gray difference to the previous selected frame of the window; 0 for the first.

    The predecessor is found on the frame list; only pairs of rasters meet, on
    (frame, y, x).
    """
    ordered = previous_row(frames, line, {"before": F.col("frame")}).drop("_has_prev")
    gray = px.select("frame", "y", "x", luma().alias("gray"))
    now = ordered.join(gray.hint("merge"), "frame")
    old = gray.select(F.col("frame").alias("before"), "y", "x", F.col("gray").alias("_old"))
    pairs = now.join(old.hint("merge"), ["before", "y", "x"], "left")
    return pairs.groupBy(*line.keys, "frame").agg(F.coalesce(F.avg(F.abs(F.col("gray") - F.col("_old"))), F.lit(0.0)).alias("motion"))


def assemble_vector(features: DataFrame, motion: Column, observed: Column) -> DataFrame:
    """The 27-number frame vector in its fixed order."""
    names = ["brightness", "contrast", "saturation", "non_dark", "edge_density", "centre_brightness"]
    rest = ["board_occupancy", "near_occupancy", "outer_occupancy", "radial_pressure", "sector_imbalance", "mean_reach", "max_reach"]
    cols = [F.col(c) for c in names] + [motion, S.clamp_motion(observed)] + [F.col(c) for c in rest]
    cols += [F.col(f"occupancy_{k}") for k in range(6)] + [F.col(f"reach_{k}") for k in range(6)]
    return features.withColumn("vector", F.array(*[c.cast("double") for c in cols]))


# --- colour classes -----------------------------------------------------------------
def classify_colour(min_span: float = 0.16, max_distance: float = 0.42) -> Column:
    """Nearest palette colour of the span-normalised pixel, or -1."""
    r, g, b = _rgb()
    low, wide = F.least(r, g, b), F.greatest(span(), F.lit(1e-8))
    distances = []
    for colour in PALETTE:
        lo, hi = min(colour), max(colour)
        want = [(v - lo) / (hi - lo) for v in colour]
        d = sum((F.pow((ch - low) / wide - t, 2) for ch, t in zip((g, b), want[1:])), F.pow((r - low) / wide - want[0], 2))
        distances.append(F.sqrt(d))
    best = F.least(*distances)
    nearest = F.lit(3)
    for k in (2, 1, 0):
        nearest = F.when(distances[k] == best, k).otherwise(nearest)
    return F.when((span() > min_span) & (best < max_distance), nearest).otherwise(-1)


def gray_mask(w: int, h: int, near: float = 0.06, max_span: float = 0.10, crop: float = 0.26) -> Column:
    """Board-gray pixels of the central part."""
    r, g, b = _rgb()
    off = F.greatest(*[F.abs(c - v / 255.0) for c, v in zip((r, g, b), BOARD_GRAY)])
    inside = (F.abs(F.col("x") - w / 2.0) < w * crop) & (F.abs(F.col("y") - h / 2.0) < w * crop)
    return (off < near) & inside & (span() < max_span)


def fit_hexagon(
    px: DataFrame, w: int, h: int, near: float = 0.06, max_span: float = 0.10, crop: float = 0.26, quantile: float = 0.99,
    max_residual: float = 0.035, min_apothem: float = 8.0, min_share: float = 0.008, min_points: int = 30,
) -> DataFrame:
    """Hexagon (cx, cy, apothem) from the supports of the gray region in six directions.

    Least squares over six evenly spread normals is closed: the apothem is the mean
    support, the centre a third of the support-weighted normals.
    """
    frames = px.select("frame").distinct()
    gray = px.where(gray_mask(w, h, near, max_span, crop))
    supports = [
        F.percentile(F.col("x") * math.cos(a) + F.col("y") * math.sin(a), quantile).alias(f"_s{k}")
        for k, a in enumerate(NORMAL_ANGLES)
    ]
    g = gray.groupBy("frame").agg(F.count("*").alias("_n"), *supports)
    s = [F.col(f"_s{k}") for k in range(6)]
    a = sum(s[1:], s[0]) / 6
    cx = sum((s[k] * math.cos(NORMAL_ANGLES[k]) for k in range(1, 6)), s[0] * math.cos(NORMAL_ANGLES[0])) / 3
    cy = sum((s[k] * math.sin(NORMAL_ANGLES[k]) for k in range(1, 6)), s[0] * math.sin(NORMAL_ANGLES[0])) / 3
    err = sum(
        (F.pow(F.col("cx") * math.cos(t) + F.col("cy") * math.sin(t) + F.col("apothem") - s[k], 2) for k, t in enumerate(NORMAL_ANGLES)),
        F.lit(0.0),
    )
    need = max(min_points, h * w * min_share)
    fitted = (
        frames.join(g, "frame", "left").withColumn("apothem", a).withColumn("cx", cx).withColumn("cy", cy)
        .withColumn("residual", F.sqrt(err / 6) / F.greatest(F.lit(1.0), F.col("apothem")))
    )
    reason = (
        F.when(F.coalesce("_n", F.lit(0)) < need, "gray_not_found")
        .when((F.col("apothem") < min_apothem) | (F.col("residual") > max_residual), "gray_fit_uncertain")
        .otherwise("ok")
    )
    out = fitted.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")
    keep = lambda c: F.when(F.col("reason") != "gray_not_found", F.col(c)).alias(c)
    return out.select("frame", "valid", "reason", keep("cx"), keep("cy"), keep("apothem"), keep("residual"))


def core_mask(w: int, h: int) -> Column:
    r, g, b = _rgb()
    return (
        (r < 0.28) & (g < 0.36) & (b < 0.43) & (F.abs(F.col("x") - w / 2.0) < w * 0.12) & (F.abs(F.col("y") - h / 2.0) < h * 0.2)
    )


def fit_hexagon_core(px: DataFrame, w: int, h: int, min_core: int = 100, min_neighbours: int = 5, near: float = 0.06, max_span: float = 0.10) -> DataFrame:
    """Fit for crowded boards: centre from the dark core's box, apothem from the median support.

    Isolated gray specks are dropped by counting gray neighbours in the 3 x 3 block
    (each pixel is sent to its nine neighbours and counted), which stands in for
    removing small connected regions.
    """
    frames = px.select("frame").distinct()
    core = px.where(core_mask(w, h)).groupBy("frame").agg(
        F.count("*").alias("_core"), ((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("y") + F.max("y")) / 2).alias("cy")
    )
    gray = px.where(gray_mask(w, h, near, max_span)).select("frame", "y", "x")
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    votes = (
        gray.select("frame", "y", "x", F.explode(offsets).alias("o"))
        .groupBy("frame", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
        .agg(F.count("*").alias("_nb"))
    )
    solid = gray.hint("merge").join(votes.where(F.col("_nb") >= min_neighbours), ["frame", "y", "x"]).join(core, "frame")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    reach = F.array(*[dx * math.cos(a) + dy * math.sin(a) for a in NORMAL_ANGLES])
    solid = solid.withColumn("_r", reach)
    tops = solid.groupBy("frame").agg(
        F.count("*").alias("_gray"), F.array(*[F.max(F.col("_r")[k]) for k in range(6)]).alias("_s")
    )
    ordered = F.array_sort("_s")
    tops = tops.withColumn("apothem", (ordered[2] + ordered[3]) / 2)
    over = solid.join(tops.select("frame", "apothem"), "frame").groupBy("frame").agg(
        F.avg((F.array_max("_r") > F.col("apothem") * 1.04).cast("double")).alias("_over")
    )
    errors = F.array_sort(F.transform("_s", lambda s: F.abs(s - F.col("apothem")) / F.greatest(F.lit(1.0), F.col("apothem"))))
    j = frames.join(core, "frame", "left").join(tops, "frame", "left").join(over, "frame", "left").withColumn("_e", errors)
    close = F.size(F.filter("_e", lambda e: e < 0.035))
    reason = (
        F.when(F.col("_gray").isNull() & F.col("_core").isNotNull() & (F.col("_core") >= min_core), "gray_not_found")
        .when(F.coalesce("_core", F.lit(0)) < min_core, "core_center_missing")
        .when((F.col("apothem") < 8) | (close < 3) | (F.col("_over") > 0.02), "occluded_gray_fit_uncertain")
        .otherwise("ok")
    )
    return j.select(
        "frame", (reason == "ok").alias("valid"), reason.alias("reason"), "cx", "cy", "apothem",
        ((F.col("_e")[0] + F.col("_e")[1] + F.col("_e")[2]) / 3).alias("residual"),
    )


# --- sampling along rays and strips ---------------------------------------------------
def _median(a: Column) -> Column:
    """Median of an array; null when empty."""
    s = F.array_sort(a)
    n = F.greatest(F.size(s), F.lit(1))
    return (F.try_element_at(s, F.floor((n - 1) / 2).cast("int") + 1) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def sample(points: DataFrame, px: DataFrame, w: int, h: int, clamp: bool = True) -> DataFrame:
    """Pixels at the rounded positions (sx, sy) of sample rows.

    Samples per frame are fixed in number and meet pixels on (frame, y, x).  With
    ``clamp`` positions are moved to the border, otherwise samples outside are kept
    with null channels.  The rasters are never broadcast: they are made by exploding,
    which the planner's size estimates do not see.
    """
    x, y = _cell_of(w, h, clamp)
    return points.withColumn("x", x).withColumn("y", y).drop("sx", "sy").join(px.hint("merge"), ["frame", "y", "x"], "left")


def _cell_of(w: int, h: int, clamp: bool) -> tuple[Column, Column]:
    x, y = F.rint("sx").cast("int"), F.rint("sy").cast("int")
    if clamp:
        x, y = F.greatest(F.lit(0), F.least(x, F.lit(w - 1))), F.greatest(F.lit(0), F.least(y, F.lit(h - 1)))
    return x, y


def with_raster(geo: DataFrame, px: DataFrame, w: int, h: int) -> DataFrame:
    """Adds ``_raster`` to each frame: an array of its w x h cells, each the list of the pixel rows there.

    Samples that are exploded from such a frame find their pixels where they are made, so
    only pixels are exchanged (by frame, once), never samples.
    """
    values = [c for c in px.columns if c not in ("frame", "y", "x")]
    inside = px.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    held = inside.select("frame", (F.col("y") * w + F.col("x")).cast("int").alias("_cell"), F.struct(*values).alias("_p"))
    # Every cell is there, so that a cell's place in the sorted list is its number.
    blank = geo.select("frame").distinct().select(
        "frame", F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("_cell"), F.lit(None).cast(held.schema["_p"].dataType).alias("_p")
    )
    cells = held.unionByName(blank).repartition("frame").groupBy("frame", "_cell").agg(F.collect_list("_p").alias("_p"))
    raster = cells.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("_cell", "_p"))).alias("_c"))
    return geo.join(raster.select("frame", F.col("_c")["_p"].alias("_raster")).hint("merge"), "frame", "left")


def sample_raster(points: DataFrame, w: int, h: int, clamp: bool = True) -> DataFrame:
    """:func:`sample` for points of frames that carry their ``_raster``."""
    x, y = _cell_of(w, h, clamp)
    rest = [c for c in points.columns if c not in ("sx", "sy", "_raster")]
    at = points.select(*rest, "_raster", x.alias("x"), y.alias("y"))
    cell = F.col("y") * w + F.col("x")
    if not clamp:
        cell = F.when(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1), cell)
    return at.select(*rest, "x", "y", F.explode_outer(F.get("_raster", cell)).alias("_p")).select(*rest, "x", "y", "_p.*")


def strip_points(
    geo: DataFrame, start: Column | float, stop: float, step: float, offsets: Sequence[float], phase: Column | float = 0.0
) -> DataFrame:
    """Rows across a strip along each face normal: frame, lane, j, radius, sx, sy (and the frame's ``_raster``, if it has one).

    Grids are exploded from integers so that positions are computed in generated code.
    """
    start = start if isinstance(start, Column) else F.lit(float(start))
    phase = phase if isinstance(phase, Column) else F.lit(float(phase))
    last = F.ceil((F.lit(stop) - start) / step).cast("int") - 1
    carried = [c for c in ("_raster",) if c in geo.columns]
    # One list of lanes and offsets, so that few generators share a stage and its code stays small enough to be compiled.
    across = F.array(*[F.struct(F.lit(k).alias("lane"), F.lit(float(o)).alias("o")) for k in range(6) for o in offsets])
    lanes = geo.select(
        "frame", *carried, "cx", "cy", "apothem", start.alias("_start"), last.alias("_last"), phase.alias("_phase"), F.explode(across).alias("_a")
    ).select("*", F.col("_a.lane").alias("lane"), F.col("_a.o").alias("_o")).drop("_a")
    turned = lanes.withColumn("_angle", F.radians(30.0 + 60.0 * F.col("lane") + F.col("_phase")))
    axis = turned.select("*", F.cos("_angle").alias("_c"), F.sin("_angle").alias("_s")).drop("_angle", "_phase")
    rows = axis.select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("j")).drop("_last")
    rows = rows.withColumn("radius", F.col("_start") + F.col("j") * step).drop("_start")
    r, o, c, s = F.col("radius"), F.col("_o"), F.col("_c"), F.col("_s")
    return rows.select(
        "frame", *carried, "lane", "j", "radius",
        (F.col("cx") + (r * c - o * s) * F.col("apothem")).alias("sx"),
        (F.col("cy") + (r * s + o * c) * F.col("apothem")).alias("sy"),
    )


CELLS, AT_ONCE = 2_000_000, 64  # counts of cells and colours, and frames, that numpy holds together


def _strips_dealt(geo: DataFrame, coloured: DataFrame, w: int, h: int) -> DataFrame:
    """(frame, cell, colour, board): the pixels inside the raster and, without a cell, a row per geometry, dealt by frame.

    ``board`` has cx, cy, apothem, phase and core ratio, then cosines and sines of the six face normals, turned by
    the phase and not turned.  It does not depend on the strips, so that several kinds of strips
    of the same frames share one exchange, and pixels pass no long expression after it.
    """
    places = [F.col(c).cast("double") if c in geo.columns else F.lit(None).cast("double") for c in ("cx", "cy", "apothem", "phase", "core_ratio")]
    angles = [[F.radians(F.lit(30.0 + 60.0 * k) + turn) for k in range(6)] for turn in (places[3], F.lit(0.0))]
    board = F.array(*places, *[of(a) for turned in angles for of in (F.cos, F.sin) for a in turned])
    inside = coloured.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1) & F.col("colour").isNotNull())
    pixels = inside.select(
        "frame", (F.col("y") * w + F.col("x")).cast("int").alias("cell"), F.col("colour").cast("int").alias("colour"), F.lit(None).cast("array<double>").alias("board")
    )
    frames = geo.select("frame", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("int").alias("colour"), board.alias("board"))
    parts = int(geo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pixels.unionByName(frames).repartition(parts, "frame")


def _strip_labels(
    table: pa.Table, w: int, h: int, start: float, stop: float, step: float, offsets: Sequence[float], votes: int, core: bool
):
    """For some frames at a time: their rows, and of each place (frame, lane, step) with at least ``votes`` samples of one
    colour the place, its radius, the colour and the votes.  Most votes win, the lower colour on ties.

    With ``core`` strips start at the core ratio (plus ``start``), turn with the phase and are moved
    to the border; otherwise samples outside the raster have no colour.
    """
    number = np.cumsum(frame_starts(table)) - 1
    cell = table["cell"].combine_chunks()
    board = cell.is_null().to_numpy(zero_copy_only=False)
    cell = cell.fill_null(0).to_numpy().astype(np.int64)
    colour = table["colour"].combine_chunks().fill_null(0).to_numpy()
    given = table["board"].combine_chunks().drop_null().flatten()
    none = given.is_null().to_numpy(zero_copy_only=False).reshape(-1, 29)
    given = given.to_numpy(zero_copy_only=False).reshape(-1, 29)
    # cx, cy, apothem, start, last step, cosines and sines; NaN where they follow from a null.
    begin = given[:, 4] + start if core else np.full(len(given), float(start))
    last = np.ceil((stop - begin) / step) - 1
    turned = slice(5, 17) if core else slice(17, 29)
    strip = np.concatenate([given[:, :3], begin[:, None], last[:, None], given[:, turned]], axis=1)
    since = none[:, 4] & core
    none = np.concatenate([none[:, :3], since[:, None], since[:, None], none[:, turned]], axis=1)
    if not np.isfinite(strip[~none]).all():
        raise ValueError("a geometry holds numbers that are not finite")
    used = ~since
    rows, of, none, strip = np.flatnonzero(board)[used], number[board][used], none[used], strip[used]
    kinds = np.unique(colour[~board])
    if not len(rows) or not len(kinds):
        return
    pixel = np.flatnonzero(~board)
    code = np.searchsorted(kinds, colour[pixel])
    many = max(1, min(AT_ONCE, CELLS // (w * h * len(kinds))))
    for low in range(int(of[0]), int(of[-1]) + 1, many):
        here = slice(*np.searchsorted(of, [low, low + many]))
        if here.start == here.stop:
            continue
        mine = slice(*np.searchsorted(number[pixel], [low, low + many]))
        at = ((number[pixel[mine]] - low) * (w * h) + cell[pixel[mine]]) * len(kinds) + code[mine]
        counts = np.bincount(at, minlength=many * w * h * len(kinds)).astype(np.int32).reshape(-1, len(kinds))
        frame, g = of[here] - low, strip[here, :, None, None]
        # A last step below 0 counts downwards, as a sequence does.
        last = strip[here, 4].astype(np.int64)
        first, last = np.minimum(last, 0), np.maximum(last, 0)
        j = np.arange(first.min(), last.max() + 1)
        radius = strip[here, 3, None] + j * step
        r, c, s = radius[:, None, :], g[:, 5:11, 0], g[:, 11:17, 0]
        lost = [(none[here, k] | none[here, 2] | none[here, 5])[:, None, None] for k in (0, 1)]
        sums = np.zeros((len(frame), 6, len(j), len(kinds)), dtype=np.int32)
        for o in offsets:
            x = np.rint(g[:, 0] + (r * c - o * s) * g[:, 2])
            y = np.rint(g[:, 1] + (r * s + o * c) * g[:, 2])
            if core:
                # A place that is not known counts as beyond the border.
                x, y = (np.where(q, n - 1, np.clip(v, 0, n - 1)) for v, n, q in ((x, w, lost[0]), (y, h, lost[1])))
                sums += counts[(frame[:, None, None] * h + y.astype(np.int64)) * w + x.astype(np.int64)]
            else:
                inside = (x >= 0) & (x < w) & (y >= 0) & (y < h) & ~lost[0] & ~lost[1]
                x, y = np.where(inside, x, 0).astype(np.int64), np.where(inside, y, 0).astype(np.int64)
                sums += counts[(frame[:, None, None] * h + y) * w + x] * inside[..., None]
        sums *= ((j >= first[:, None]) & (j <= last[:, None]))[:, None, :, None]
        # Geometries of one frame with the same radii vote together.
        _, kept, together = np.unique(np.stack([frame, strip[here, 3]]), axis=1, return_index=True, return_inverse=True)
        if len(kept) < len(frame):
            apart, sums = sums, np.zeros((len(kept), *sums.shape[1:]), dtype=np.int32)
            np.add.at(sums, together.ravel(), apart)
        n, best = sums.max(3), sums.argmax(3)
        place = np.nonzero(n >= max(votes, 1))
        yield rows[here][kept], place, j[place[2]], radius[kept[place[0]], place[2]], kinds[best[place]], n[place]


def _lane_table(table: pa.Table, labels) -> pa.Table:
    """(frame, lane, steps): the labelled steps of a lane as a list in their order."""
    parts = []
    for rows, (at, lane, _), j, radius, colour, _ in labels:
        new = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(lane) != 0))) if len(at) else np.zeros(0, dtype=int)
        steps = pa.StructArray.from_arrays([pa.array(j.astype(np.int32)), pa.array(radius), pa.array(colour.astype(np.int32))], ["j", "radius", "colour"])
        steps = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), steps)
        parts.append(pa.table({"frame": table["frame"].take(pa.array(rows[at[new]])), "lane": pa.array(lane[new].astype(np.int32)), "steps": steps}))
    return pa.concat_tables(parts) if parts else pa.table({})


def _run_table(table: pa.Table, labels, length: int, across: int) -> pa.Table:
    """(frame, lane, colour, radius, confidence): stretches of at least ``length`` steps of one colour."""
    parts = []
    for rows, (at, lane, _), j, radius, colour, n in labels:
        new = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(lane) != 0) | (np.diff(j) != 1) | (np.diff(colour) != 0))) if len(at) else np.zeros(0, dtype=int)
        size = np.diff(np.append(new, len(at)))
        new, size = new[size >= length], size[size >= length]
        total = np.zeros(len(new))
        # Step after step, as the additions of a mean.
        for i in range(size.max(initial=0)):
            more = size > i
            total[more] += n[new[more] + i] / float(across)
        parts.append(
            pa.table(
                {"frame": table["frame"].take(pa.array(rows[at[new]])), "lane": pa.array(lane[new].astype(np.int32)), "colour": pa.array(colour[new].astype(np.int32)),
                 "radius": pa.array(radius[new]), "confidence": pa.array(total / size)}
            )
        )
    return pa.concat_tables(parts) if parts else pa.table({})


WORD = 63  # pixels of a raster row in one long


def _bitmaps(geo: DataFrame, marked: DataFrame, w: int, h: int) -> DataFrame:
    """(frame, _bits): one bit per marked pixel, rows of ceil(w / 63) longs; all frames of ``geo`` have every long."""
    per_row = -(-w // WORD)
    inside = marked.where(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x").cast("int"), F.lit(WORD)))
    own = inside.select("frame", (F.col("y") * per_row + F.floor(F.col("x") / WORD)).cast("int").alias("_word"), bit.alias("_b"))
    blank = geo.select("frame", F.explode(F.sequence(F.lit(0), F.lit(h * per_row - 1))).alias("_word"), F.lit(0).cast("long").alias("_b"))
    words = own.unionByName(blank).groupBy("frame", "_word").agg(F.bit_or("_b").alias("_b"))
    whole = words.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("_word", "_b"))).alias("_w"))
    return whole.select("frame", F.col("_w")["_b"].alias("_bits"))


def orientation(geo: DataFrame, px: DataFrame, w: int, h: int, rays: int = 180, depth: int = 101, step: int = 1) -> DataFrame:
    """Adds phase (degrees, -30..29), orientation error and the core's apothem ratio.

    Per ray the last dark radius is a max over the dark steps; the sixty candidate
    phases are scored on the frame's array of rays.  A frame's dark pixels travel as bits,
    so that steps find theirs where they are made and are never exchanged.
    """
    r, gg, b = _rgb()
    dark = px.where((r < 0.28) & (gg < 0.36) & (b < 0.43))
    g = geo.where("valid").join(_bitmaps(geo.where("valid"), dark, w, h).hint("merge"), "frame")
    ray = g.select("frame", "cx", "cy", "apothem", "_bits", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray"))
    ray = ray.withColumn("angle", F.col("ray") * (2 * math.pi / rays) - math.pi)
    ray = ray.select("*", F.cos("angle").alias("_c"), F.sin("angle").alias("_s"))
    steps = ray.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("_i"))
    reach = lambda i: (i * (0.25 / (depth - 1)) + 0.20) * F.col("apothem")

    def cell(i):
        x, y = F.rint(F.col("cx") + F.col("_c") * reach(i)), F.rint(F.col("cy") + F.col("_s") * reach(i))
        return F.greatest(F.lit(0.0), F.least(x, F.lit(w - 1.0))) + F.greatest(F.lit(0.0), F.least(y, F.lit(h - 1.0))) * w

    # Only the last step of a ray inside each pixel can be its last dark step there.
    i = F.col("_i")
    steps = steps.where((i == depth - 1) | (cell(i) != cell(i + 1)))
    pts = steps.select(
        "frame", "cx", "cy", "apothem", "_bits", "ray", "angle", (i * (0.25 / (depth - 1)) + 0.20).alias("radius"),
        (F.col("cx") + F.col("_c") * reach(i)).alias("sx"), (F.col("cy") + F.col("_s") * reach(i)).alias("sy"),
    )
    x, y = _cell_of(w, h, True)
    s = pts.withColumn("x", x).withColumn("y", y)
    word = F.get("_bits", F.col("y") * -(-w // WORD) + F.floor(F.col("x") / WORD).cast("int"))
    s = s.withColumn("dark", F.call_function("shiftright", word, F.pmod(F.col("x"), F.lit(WORD))).bitwiseAND(F.lit(1)) == 1)
    inside = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) / F.col("apothem") < 0.46
    outer = s.groupBy("frame", "ray", "angle").agg(F.coalesce(F.max(F.when(F.col("dark") & inside, F.col("radius"))), F.lit(0.0)).alias("outer"))
    per = outer.groupBy("frame").agg(
        F.avg((F.col("outer") > 0.22).cast("double")).alias("usable"),
        F.sort_array(F.collect_list(F.when(F.col("outer") > 0.22, F.struct("ray", "angle", "outer")))).alias("_rays"),
    )

    def projected(deg: Column) -> Column:
        def one(v):
            facing = [F.cos(v["angle"] - F.radians(deg + 30 + 60 * k)) for k in range(6)]
            return v["outer"] * F.greatest(*facing)

        return F.transform("_rays", one)

    def spread(deg: Column) -> Column:
        # let-binding through a one-element array keeps the projection evaluated once
        return F.transform(F.array(projected(deg)), lambda a: F.struct(a.alias("a"), _median(a).alias("m")))[0]

    scored = F.transform(
        F.sequence(F.lit(0), F.lit(59), F.lit(step)),
        lambda deg: F.transform(
            F.array(spread(deg)),
            lambda t: F.struct(
                # Rounded, so that phases that fit equally well go to the least angle.
                F.round(_median(F.transform(t["a"], lambda v: F.abs(v - t["m"]))), 9).alias("error"), deg.alias("deg"), t["m"].alias("core")
            ),
        )[0],
    )
    best = per.withColumn("_best", F.array_min(scored))
    deg = F.col("_best.deg")
    return geo.join(
        best.select(
            "frame", "usable", F.when(F.col("_best.error").isNotNull(), F.when(deg < 30, deg).otherwise(deg - 60)).alias("phase"),
            F.col("_best.error").alias("orientation_error"), F.col("_best.core").alias("core_ratio"),
        ),
        "frame", "left",
    )


def lane_stacks(
    geo: DataFrame, coloured: DataFrame, w: int, h: int, reach: float = 0.94, step: float = 0.012, votes: int = 7,
    offsets: Sequence[float] = tuple(-0.085 + 0.17 * i / 14 for i in range(15)),
) -> DataFrame:
    """Per frame and lane: stack height, outermost colour and colour sequence from the core outwards.

    ``coloured`` holds (frame, y, x, colour >= 0).  A stack must begin within .055 of
    the core; holes of up to two radial steps are bridged.
    """
    g = geo.select("frame", "cx", "cy", "apothem", "phase", "core_ratio")
    dealt = _strips_dealt(g, coloured, w, h)
    kind = g.schema["frame"].dataType.simpleString()
    occupied = by_frames(
        dealt, lambda t: _lane_table(t, _strip_labels(t, w, h, 0.008, reach, step, offsets, votes, True)),
        f"frame {kind}, lane int, steps array<struct<j:int,radius:double,colour:int>>",
    )
    per = occupied.groupBy("frame", "lane").agg(F.sort_array(F.flatten(F.collect_list("steps"))).alias("_o")).hint("merge")
    lanes = g.select("frame", "core_ratio", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lane")).join(per, ["frame", "lane"], "left")
    empty = F.expr("cast(array() as array<int>)")
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(None).cast("double").alias("height"), F.lit(-1).alias("top"), empty.alias("seq"), F.lit(True).alias("on"))

    def grow(acc, o):
        joins = acc["on"] & F.coalesce(o["j"] - acc["last"] <= 3, o["radius"] <= F.col("core_ratio") + 0.055)
        changed = F.when((F.size(acc["seq"]) == 0) | (F.element_at(F.concat(F.array(F.lit(-1)), acc["seq"]), -1) != o["colour"]), True).otherwise(False)
        return F.struct(
            F.when(joins, o["j"]).otherwise(acc["last"]).alias("last"),
            F.when(joins, o["radius"] + step / 2).otherwise(acc["height"]).alias("height"),
            F.when(joins, o["colour"]).otherwise(acc["top"]).alias("top"),
            F.when(joins & changed, F.concat(acc["seq"], F.array(o["colour"]))).otherwise(acc["seq"]).alias("seq"),
            joins.alias("on"),
        )

    walked = lanes.withColumn("_w", F.aggregate(F.coalesce("_o", F.expr("cast(array() as array<struct<j:int,radius:double,colour:int>>)")), start, grow))
    return walked.select(
        "frame", "lane", F.coalesce("_w.height", "core_ratio").alias("height"), F.col("_w.top").alias("top"), F.col("_w.seq").alias("colours"),
    )


def incoming(geo: DataFrame, stacks: DataFrame, coloured: DataFrame, quantile: float = 0.03) -> DataFrame:
    """Per frame and lane: nearest coloured pixels above the stack in a fixed 12-degree wedge.

    A coloured pixel faces at most one lane's wedge, so it is assigned once.
    """
    # Merged: the planner's estimate of exploded pixels is far too small for a choice of its own.
    c = coloured.hint("merge").join(geo.select("frame", "cx", "cy", "apothem"), "frame")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    lane = F.pmod(F.floor(F.degrees(F.atan2(dy, dx)) / 60.0).cast("int"), F.lit(6))
    angle = F.radians(30.0 + 60.0 * F.col("lane"))
    c = c.withColumn("lane", lane).withColumn("projected", (dx * F.cos(angle) + dy * F.sin(angle)) / F.col("apothem")).withColumn(
        "across", F.abs(-dx * F.sin(angle) + dy * F.cos(angle)) / F.col("apothem")
    )
    near = c.hint("merge").join(stacks.select("frame", "lane", "height"), ["frame", "lane"]).where(
        (F.col("across") < math.tan(math.radians(12)) * F.col("projected"))
        & (F.col("projected") > F.greatest(F.lit(0.48), F.col("height") + 0.06))
        & (F.col("projected") < NO_INCOMING)
        & ~((F.col("projected") > 0.94) & (F.col("projected") < 1.08))
    )
    got = near.groupBy("frame", "lane", "apothem").agg(F.count("*").alias("_n"), F.percentile("projected", quantile).alias("_q"))
    enough = got.where(F.col("_n") > F.greatest(F.lit(4.0), F.col("apothem") * 0.05)).select("frame", "lane", "_q")
    return stacks.select("frame", "lane", "height").join(enough, ["frame", "lane"], "left").select(
        "frame", "lane", F.coalesce("_q", F.lit(NO_INCOMING)).alias("incoming")
    )


def incoming_runs(
    geo: DataFrame, stacks: DataFrame, coloured: DataFrame, w: int, h: int, step: float = 0.006, votes: int = 6, length: int = 7,
) -> DataFrame:
    """First radial run of one colour above each stack: radius, colour, mean vote share.

    Lanes are fixed in screen space; off-phase boards compare with the tallest stack.
    """
    offsets = [-0.06 + 0.12 * i / 8 for i in range(9)]
    dealt = _strips_dealt(geo, coloured, w, h)
    kind = geo.schema["frame"].dataType.simpleString()
    runs = by_frames(
        dealt, lambda t: _run_table(t, _strip_labels(t, w, h, 0.35, NO_INCOMING, step, offsets, votes, False), length, len(offsets)),
        f"frame {kind}, lane int, colour int, radius double, confidence double",
    )
    tallest = stacks.groupBy("frame").agg(F.max("height").alias("_max"))
    need = stacks.join(tallest, "frame").join(geo.select("frame", "phase"), "frame").select(
        "frame", "lane", F.when(F.abs("phase") <= 5, F.col("height")).otherwise(F.col("_max")).alias("_h")
    )
    ok = runs.join(need, ["frame", "lane"]).where(F.col("radius") > F.greatest(F.lit(0.48), F.col("_h") + 0.07))
    first = ok.groupBy("frame", "lane").agg(F.min_by(F.struct("radius", "colour", "confidence"), "radius").alias("_f"))
    return need.join(first, ["frame", "lane"], "left").select(
        "frame", "lane", F.coalesce("_f.radius", F.lit(NO_INCOMING)).alias("incoming"), F.coalesce("_f.colour", F.lit(-1)).alias("colour"),
        F.coalesce("_f.confidence", F.lit(0.0)).alias("confidence"),
    )


def board_vector(lanes: DataFrame, geo: DataFrame) -> DataFrame:
    """54 numbers per frame from its six lanes (height, incoming, top)."""
    conf = geo.select(
        "frame", S.clip(1 - F.col("residual") * 10 - F.coalesce("orientation_error", F.lit(0.0)) * 10, 0.0, 1.0).alias("_conf")
    )
    per = lanes.groupBy("frame").agg(
        F.sort_array(F.collect_list(F.struct("lane", "height", "incoming", "top"))).alias("_l")
    ).join(conf, "frame")
    geometry = F.flatten(
        F.transform("_l", lambda v: F.array(v["height"], F.greatest(F.lit(0.0), v["incoming"] - v["height"]), v["incoming"], F.col("_conf")))
    )
    onehot = F.flatten(F.transform("_l", lambda v: F.array(*[(v["top"] == c).cast("double") for c in range(4)])))
    turned = F.concat(F.slice("_l", 2, 5), F.slice("_l", 1, 1))
    match = F.zip_with("_l", turned, lambda a, b: ((a["top"] >= 0) & (a["top"] == b["top"])).cast("double"))
    return per.select(
        "frame", F.transform("_l", lambda v: v["height"]).alias("heights"), F.transform("_l", lambda v: v["top"]).alias("tops"),
        F.concat(geometry, onehot, match).alias("vector"),
    )


def coloured_pixels(px: DataFrame, min_brightness: float = 0.52) -> DataFrame:
    """Bright enough pixels of a palette colour: (frame, y, x, colour)."""
    c = px.where(F.greatest(*_rgb()) >= min_brightness).withColumn("colour", classify_colour())
    return c.where("colour >= 0").select("frame", "y", "x", "colour")


def extract_board(px: DataFrame, w: int, h: int, geo: DataFrame | None = None) -> DataFrame:
    """Geometry, orientation, stacks, incoming and the 54-vector of every frame; invalid ones keep a reason."""
    fitted = geo if geo is not None else fit_hexagon(px, w, h)
    facing = orientation(fitted, px, w, h)
    uncertain = F.col("valid") & (F.coalesce("usable", F.lit(0.0)) < 0.8)
    facing = facing.withColumn("reason", F.when(uncertain, "central_hexagon_uncertain").otherwise(F.col("reason")))
    facing = facing.withColumn("valid", F.col("reason") == "ok")
    good = facing.where("valid")
    coloured = drop_specks(coloured_pixels(px), good)
    stacks = lane_stacks(good, coloured, w, h)
    near = incoming(good, stacks, coloured)
    vec = board_vector(stacks.join(near, ["frame", "lane"]), good)
    return facing.join(vec, "frame", "left")


def route_repair(primary: DataFrame, fallback: DataFrame, tallest: float = 0.84) -> DataFrame:
    """The fallback result for invalid frames and for frames with a stack above ``tallest``."""
    cols = [c for c in primary.columns if c != "frame"]
    f = fallback.select("frame", F.struct(*cols).alias("_f"))
    needs = ~F.col("valid") | (F.array_max("heights") > tallest)
    j = primary.join(f, "frame", "left").withColumn("_use", F.coalesce(needs, F.lit(True)) & F.col("_f").isNotNull())
    return j.select("frame", *[F.when(F.col("_use"), F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c) for c in cols], F.col("_use").alias("repaired"))


# --- stateful geometry -------------------------------------------------------------------
def hold_geometry(frames: DataFrame, line: Timeline) -> DataFrame:
    """Keep the previous geometry over at most two frames when a ring of blocks hides the edge.

    ``frames`` has the native fit (valid, cx, cy, apothem, core) and a refit
    (refit_valid, refit_cx, refit_cy, refit_apothem, refit_core), cores as fractions of
    the apothem.  What a frame ends up with is one of eleven cases: nothing, its own
    native or refit geometry, or the native/refit geometry of one or two frames back
    while its core was measured on the native/refit fit.  Whether the next frame moves
    from one case to another is a map over these cases (see :mod:`chain`).
    """
    fit = lambda p: F.struct(F.col(f"{p}cx").alias("cx"), F.col(f"{p}cy").alias("cy"), F.col(f"{p}apothem").alias("a"), F.col(f"{p}core").alias("core"))
    numbered = row_numbers(frames, line, "_rn").withColumn("pos", F.col("_rn") - 1)
    numbered = numbered.withColumn("_n", fit("")).withColumn("_r", fit("refit_"))
    rows = with_earlier_rows(numbered, line, 3)
    w = line.local()
    back = {0: (F.col("_n"), F.col("_r"))}
    for k in (1, 2, 3):
        rows = rows.withColumn(f"_n{k}", F.lag("_n", k).over(w)).withColumn(f"_r{k}", F.lag("_r", k).over(w))
        back[k] = (F.col(f"_n{k}"), F.col(f"_r{k}"))
    # Cases: (frames back of the geometry, which fit, which fit measured the core, held count).
    cases: list[tuple[int, int, int, int] | None] = [None, (0, 0, 0, 0), (0, 1, 1, 0)]
    cases += [(1, g, c, 1) for g in (0, 1) for c in (0, 1)] + [(2, g, c, 2) for g in (0, 1) for c in (0, 1)]
    number = {c: i for i, c in enumerate(cases)}

    def next_case(case) -> Column:
        valid = F.coalesce(F.col("valid"), F.lit(False))
        if case is None:
            return F.when(valid, F.lit(number[(0, 0, 0, 0)])).otherwise(0)
        age, g, c, held = case
        geo = back[age + 1][g]  # as seen from the current frame
        core_px = back[1][c]["core"] * back[1][c]["a"]
        ratio = core_px / geo["a"]
        native, refit = back[0]
        jump = F.hypot(native["cx"] - geo["cx"], native["cy"] - geo["cy"]) / geo["a"] > 0.075
        use_refit = jump & F.coalesce(F.col("refit_valid"), F.lit(False))

        def after(which: int) -> Column:
            cur = back[0][which]
            own = F.lit(number[(0, which, which, 0)])
            if held >= 2:
                return own
            px = cur["core"] * cur["a"]
            same = F.abs(px / core_px - 1) < 0.025
            centred = F.hypot(cur["cx"] - geo["cx"], cur["cy"] - geo["cy"]) < 0.04 * geo["a"]
            plausible = F.abs(px / geo["a"] / 0.325 - 1) < 0.055
            hold = (cur["core"] > 0.34) & same & centred & (ratio < 0.34) & plausible
            return F.when(F.coalesce(hold, F.lit(False)), F.lit(number[(held + 1, g, which, held + 1)])).otherwise(own)

        chosen = F.when(F.coalesce(use_refit, F.lit(False)), after(1)).otherwise(after(0))
        return F.when(valid, chosen).otherwise(0)

    change = F.array(*[next_case(c).cast("long") for c in cases])
    mapped = materialise(drop_halo(rows.withColumn("change", change)), "geometry")
    states = entry_states(mapped.select(*line.keys, "pos", "change"), line.keys, state_maps(len(cases)), 0)
    j = mapped.join(states, [*line.keys, "pos"]).withColumn("_case", F.element_at("change", (F.col("state") + 1).cast("int")))
    pick = lambda f: F.coalesce(
        *[F.when(F.col("_case") == i, f(c)) for i, c in enumerate(cases) if c is not None]
    )
    geo_of = lambda c: back[c[0]][c[1]]
    core_of = lambda c: back[0][c[2]]["core"] * back[0][c[2]]["a"]
    new = {
        "cx": pick(lambda c: geo_of(c)["cx"]), "cy": pick(lambda c: geo_of(c)["cy"]), "apothem": pick(lambda c: geo_of(c)["a"]),
        "core": pick(lambda c: core_of(c) / geo_of(c)["a"]), "held": pick(lambda c: F.lit(c[3])), "refit": pick(lambda c: F.lit(c[1] == 1 and c[3] == 0)),
    }
    out = j.select(*[F.col(c) for c in frames.columns if c not in new], *[e.alias(n) for n, e in new.items()])
    return out.fillna({"held": 0, "refit": False})


# --- derived vectors ---------------------------------------------------------------------
def normalise_scale(frames: DataFrame, target: float = 0.32, lo: float = 0.27, hi: float = 0.40) -> DataFrame:
    """Rescale lengths so that the core has a fixed size; frames with an implausible core are invalid.

    ``frames`` has valid, reason, core, apothem, height, gap, incoming.
    """
    ok = F.col("valid") & (F.col("core") > lo) & (F.col("core") < hi)
    k = F.lit(target) / F.col("core")
    height = F.transform("height", lambda v: v * k)
    near = F.transform("incoming", lambda v: F.least(F.when(v < 2.05, v * k).otherwise(v), F.lit(NO_INCOMING)))
    gap = F.zip_with(near, height, lambda r, t: F.greatest(F.lit(0.0), r - t))
    return (
        frames.withColumn("_h", height).withColumn("_i", near).withColumn("_g", gap)
        .withColumn("reason", F.when(F.col("valid") & ~ok, "core_scale_uncertain").otherwise(F.col("reason")))
        .withColumn("apothem", F.when(ok, F.col("apothem") / k).otherwise(F.col("apothem")))
        .withColumn("height", F.when(ok, F.col("_h"))).withColumn("incoming", F.when(ok, F.col("_i"))).withColumn("gap", F.when(ok, F.col("_g")))
        .withColumn("core", F.when(ok, F.lit(target)).otherwise(F.col("core"))).withColumn("valid", ok)
        .drop("_h", "_i", "_g")
    )


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def _std(a: Column) -> Column:
    squares = F.transform(F.array(_mean(a)), lambda m: _sum(F.transform(a, lambda v: (v - m) * (v - m))))
    return F.sqrt(squares[0] / F.size(a))


def invariant_features(frames: DataFrame) -> DataFrame:
    """182 rotation-invariant numbers from a 150-number vector (54 current + 4 x 6 x 4 changes); adds ``invariant``.

    Lanes appear sorted, as moments, counts and as the lexicographically greatest
    rotation of (height, colours), so turning the board changes nothing.
    """
    v = F.col("vector")
    lane = lambda k: F.array(*[F.element_at(v, 4 * i + k + 1) for i in range(6)])
    rows = frames.withColumn("_h", lane(0)).withColumn("_g", lane(1)).withColumn("_i", lane(2)).withColumn("_c", lane(3))
    rows = rows.withColumn("_top", F.array_max("_h")).withColumn("_med", _median(F.col("_h")))
    h, g, c = F.col("_h"), F.col("_g"), F.col("_c")
    # A second parameter of the function, even one with a default, would receive the element's index.
    over = lambda t: F.size(F.filter(h, lambda x: x > t)).cast("double")
    above = [over(t) for t in (0.5, 0.65, 0.8, 0.95)]
    pairs = F.arrays_zip(h.alias("h"), g.alias("g"))
    least = lambda rule: F.array_min(F.transform(F.filter(pairs, rule), lambda p: p["g"]))
    geometry = F.concat(
        F.array_sort(h), F.array_sort(g), F.array_sort("_i"),
        F.array(
            _mean(h), _std(h), F.col("_top") - F.array_min(h), _sum(h), *above, _mean(g), _std(g),
            least(lambda p: p["h"] == F.col("_top")), least(lambda p: p["h"] >= F.col("_med")), F.array_min(c), _mean(c),
        ),
    )
    counts = [sum((F.element_at(v, 25 + 4 * i + k) for i in range(1, 6)), F.element_at(v, 25 + k)) for k in range(4)]
    ring = F.array(
        *[F.array(F.element_at(v, 4 * i + 1), *[F.element_at(v, 25 + 4 * i + k) for k in range(4)]) for i in range(6)]
    )
    canonical = F.flatten(F.transform(S.canonical_ring(ring), lambda t: F.slice(t, 2, 4)))
    match = sum((F.element_at(v, 49 + i) for i in range(1, 6)), F.element_at(v, 49))
    colour = F.concat(F.array(*counts, match, S.entropy(counts)), canonical)
    change = lambda s, k: F.array(*[F.element_at(v, 55 + 24 * s + 4 * i + k) for i in range(6)])
    ordered = F.concat(*[change(s, k) for s in range(4) for k in range(4)])
    summary = []
    for s in range(4):
        grow, motion = change(s, 0), change(s, 2)
        summary += [_sum(grow), F.array_max(grow), F.array_min(grow), _sum(change(s, 1)), _mean(motion), F.array_max(motion)]
    out = rows.withColumn("invariant", F.concat(geometry, colour, ordered, F.array(*summary)))
    return out.select(*frames.columns, "invariant")


def compact_features(df: DataFrame, geometry: int = 32, block: int = 12, speeds: int = 5) -> DataFrame:
    """80 of (invariant ++ 48 motion numbers): speeds, geometry, activity; adds ``compact``."""
    m = F.col("motion")
    fast = [k * block + j for k in range(4) for j in range(speeds)]
    rest = [i for i in range(4 * block) if i not in fast]
    take = lambda ix: F.array(*[F.element_at(m, i + 1) for i in ix])
    return df.withColumn("compact", F.concat(take(fast), F.slice("invariant", 1, geometry), take(rest)))


def derive_windows(anchors: DataFrame, frames: DataFrame, line: Timeline, tolerance: float, columns: Sequence[str]) -> DataFrame:
    """Attach derived frame features to anchors by time; anchors without valid ones must not be there.

    Rows come back with a ``changed`` flag where an anchor marked valid finds no
    features, which callers treat as an error.
    """
    from foretide.operators.timejoin import asof_frame

    got = asof_frame(anchors, frames, line, tolerance, {c: F.col(c) for c in columns})
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return got.withColumn("changed", F.col("valid") & missing)


# --- clear detection ------------------------------------------------------------------------
def flash_observation(
    geo: DataFrame, px: DataFrame, w: int, h: int, start: float = 0.37, stop: float = 0.93, step: float = 0.012, across: int = 21, reach: float = 0.19,
) -> DataFrame:
    """Per frame, lane and radius: share of white and of coloured samples; cropped boards are invalid."""
    offsets = [-reach + 2 * reach * i / (across - 1) for i in range(across)]
    labelled = px.withColumn("colour", classify_colour())
    points = strip_points(with_raster(geo.where("valid"), labelled, w, h), start, stop, step, offsets, F.col("phase"))
    s = sample_raster(points, w, h, clamp=False)
    white = (F.least(*_rgb()) > 0.84) & (span() < 0.065)
    cells = s.groupBy("frame", "lane", "j").agg(
        F.avg(white.cast("double")).alias("white"), F.avg((F.col("colour") >= 0).cast("double")).alias("coloured"),
        F.bool_and(F.col("r").isNotNull()).alias("inside"),
    )
    per = cells.groupBy("frame").agg(
        F.bool_and("inside").alias("valid"), F.sort_array(F.collect_list(F.struct("lane", "j", "white", "coloured"))).alias("_c")
    )
    lanes = lambda f: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform(F.filter("_c", lambda v: v["lane"] == k), lambda v: v[f]))
    good = per.select("frame", "valid", F.when(F.col("valid"), lanes("white")).alias("white"), F.when(F.col("valid"), lanes("coloured")).alias("coloured"))
    out = geo.select("frame", "cx", "cy", "apothem", F.col("valid").alias("_g")).join(good, "frame", "left")
    reason = F.when(~F.col("_g"), "unsupported_geometry").when(~F.coalesce("valid", F.lit(False)), "board_crop_incomplete").otherwise("ok")
    return out.withColumn("reason", reason).withColumn("valid", F.coalesce("valid", F.lit(False))).drop("_g")


def _evidence(white: Column, prior: Column, level: float) -> Column:
    """Greatest mean white share over lane runs of two or more radii that are white now and were coloured."""

    def lane(row: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))

        def step(acc, v):
            hit = (v["w"] >= level) & (v["p"] >= level)
            total, n = F.when(hit, acc["sum"] + v["w"]).otherwise(0.0), F.when(hit, acc["n"] + 1).otherwise(0)
            closed = F.when(~hit & (acc["n"] >= 2), F.greatest(acc["best"], acc["sum"] / F.greatest(acc["n"], F.lit(1)))).otherwise(acc["best"])
            return F.struct(total.alias("sum"), n.alias("n"), closed.alias("best"))

        done = lambda acc: F.when(acc["n"] >= 2, F.greatest(acc["best"], acc["sum"] / F.greatest(acc["n"], F.lit(1)))).otherwise(acc["best"])
        return F.aggregate(F.arrays_zip(row.alias("w"), prior.alias("p")), start, step, done)

    return F.array_max(F.transform(white, lane))


def clear_events(obs: DataFrame, line: Timeline, hz: int = 12, level: float = 0.57, limit: float = 0.08, unit: float = 1000.0) -> DataFrame:
    """Flash events: adds supported, event, confidence, segment, reason.

    ``obs`` has valid, reason, cx, cy, apothem, white / coloured (lane x radius), ``t``
    (seconds; the line's clock / ``unit``) and ``reset``.  An event is the first row
    with evidence in a stretch of consecutive broadly white rows; stretches end at
    resets, gaps, invalid rows and geometry changes.  A row looks at most two rows and
    two sampling periods back, so one time halo covers all of it but the stretch.
    """
    period = 1.2 / hz
    coloured = F.aggregate(
        F.slice("coloured", 2, 5), F.element_at("coloured", 1), lambda s, row: F.zip_with(s, row, lambda a, b: F.greatest(a, b))
    )
    lane_broad = lambda row: F.exists(F.zip_with(F.slice(row, 1, F.size(row) - 1), F.slice(row, 2, F.size(row) - 1), lambda a, b: F.least(a, b)), lambda v: v >= level)
    rows = (
        obs.withColumn("_col", F.when(F.col("valid"), coloured))
        .withColumn("_broad", F.coalesce(F.col("valid") & F.exists("white", lane_broad), F.lit(False)))
    )
    padded = with_earlier_time(rows, line, math.ceil(3 * period * unit))
    w = line.local()
    p = F.lag(F.struct("valid", "t", "cx", "cy", "apothem", "_broad")).over(w)
    padded = padded.withColumn("_p", p)
    moved = (F.abs(F.col("apothem") / F.col("_p.apothem") - 1) > limit) | (
        F.hypot(F.col("cx") - F.col("_p.cx"), F.col("cy") - F.col("_p.cy")) > limit * F.col("_p.apothem")
    )
    cut = (
        F.col("_p").isNull() | ~F.col("_p.valid") | ~F.col("valid") | F.col("reset") | moved
        | (F.col("t") <= F.col("_p.t")) | (F.col("t") - F.col("_p.t") > period)
    )
    padded = padded.withColumn("_cut", F.coalesce(cut, F.lit(True)))
    one = F.when(~F.col("_cut"), F.lag("_col", 1).over(w))
    two = F.when(~F.col("_cut") & ~F.lag("_cut", 1).over(w), F.lag("_col", 2).over(w))
    prior = F.when(two.isNotNull(), F.zip_with(one, two, lambda a, b: F.greatest(a, b))).otherwise(one)
    padded = padded.withColumn("_prior", prior)
    evidence = F.when(F.col("valid") & F.col("_prior").isNotNull(), _evidence(F.col("white"), F.col("_prior"), level)).otherwise(0.0)
    padded = padded.withColumn("confidence", F.coalesce(evidence, F.lit(0.0)))
    # A stretch starts where a broadly white row does not continue one.
    starts = F.col("_broad") & (F.col("_cut") | ~F.col("_p._broad"))
    flat = drop_halo(padded.withColumn("_start", starts)).select(*[c for c in obs.columns if c not in ("white", "coloured")], "_broad", "_cut", "_start", "confidence")
    hit = F.col("confidence") > 0
    counted = running(
        flat, line, sums={"segment": F.col("_cut").cast("long"), "_stretch": F.col("_start").cast("long"), "_hits": hit.cast("long")}
    )
    # Evidence before this stretch began is known from the running count at its start.
    base = running(counted, line, lasts={"_base": F.when(F.col("_start"), F.col("_hits") - hit.cast("long"))})
    seen = F.col("_hits") - F.col("_base")
    active = F.col("_broad") & (seen > 0)
    event = active & hit & (seen == 1)
    why = F.when(~F.col("valid"), F.col("reason")).when(active, "clear_flash").otherwise("no_confirmed_flash")
    return (
        base.withColumn("supported", F.col("valid")).withColumn("event", F.coalesce(event, F.lit(False))).withColumn("reason", F.coalesce(why, F.lit("no_confirmed_flash")))
        .drop("_broad", "_cut", "_start", "_stretch", "_hits", "_base")
    )


def score_pixels(px: DataFrame, w: int, h: int, half_w: int = 23, half_h: int = 7) -> DataFrame:
    """White pixels in the central score box, per frame (an outcome aid, never a feature)."""
    box = F.col("y").between(h // 2 - half_h, h // 2 + half_h) & F.col("x").between(w // 2 - half_w, w // 2 + half_w)
    white = (F.least(*_rgb()) > 150 / 255.0) & (span() < 50 / 255.0)
    return px.groupBy("frame").agg(F.count(F.when(box & white, 1)).alias("n"))
