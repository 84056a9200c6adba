"""Same-coloured areas against a flood fill, and what becomes of specks."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foretide.operators import components as K


def flood(grid):
    """Sizes of four-neighbour areas per pixel, by a plain stack."""
    h, w = grid.shape
    size, seen = np.zeros((h, w), int), np.zeros((h, w), bool)
    for at in np.ndindex(h, w):
        if seen[at] or grid[at] < 0:
            continue
        stack, area = [at], []
        seen[at] = True
        while stack:
            y, x = stack.pop()
            area.append((y, x))
            for b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= b[0] < h and 0 <= b[1] < w and not seen[b] and grid[b] == grid[at]:
                    seen[b] = True
                    stack.append(b)
        for p in area:
            size[p] = len(area)
    return size


def runs_of(grid):
    out = []
    for y, row in enumerate(grid):
        x = 0
        while x < len(row):
            end = x
            while end + 1 < len(row) and row[end + 1] == row[x]:
                end += 1
            if row[x] >= 0:
                out.append((y, x, end, row[x]))
            x = end + 1
    return np.array(out, dtype=int).reshape(-1, 4).T


def spiral(n):
    grid = np.full((n, n), -1)
    y, x, dy, dx = 0, 0, 0, 1
    grid[0, 0] = 1
    while True:
        for _ in range(2):
            ny, nx = y + dy, x + dx
            ahead = (ny + dy, nx + dx)
            inside = 0 <= ny < n and 0 <= nx < n
            if inside and grid[ny, nx] < 0 and not (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead] >= 0):
                break
            dy, dx = dx, -dy
        else:
            return grid
        y, x = ny, nx
        grid[y, x] = 1


def check(grid):
    y, x0, x1, colour = runs_of(grid)
    label = K.contract(y, x0, x1, colour)
    size = np.bincount(label, weights=x1 - x0 + 1, minlength=1)
    want = flood(grid)
    assert [size[k] for k in label] == [want[a, b] for a, b in zip(y, x0)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.data())
def test_contraction_equals_flood_fill(h, w, data):
    check(np.array(data.draw(st.lists(st.integers(-1, 2), min_size=h * w, max_size=h * w))).reshape(h, w))


def test_long_winding_areas():
    check(spiral(41))
    comb = np.full((40, 41), -1)
    comb[:, ::2] = 3
    comb[-1] = 3
    check(comb)
    rng = np.random.default_rng(5)
    check(rng.integers(-1, 1, (120, 160)))


def frame(spark, number, grid):
    y, x = np.nonzero(grid >= 0)
    return pd.DataFrame({"frame": number, "y": y.astype("int32"), "x": x.astype("int32"), "colour": grid[y, x].astype("int32")})


SCHEMA = "frame long, y int, x int, colour int"


def test_drop_specks(spark):
    grid = np.full((30, 30), -1)
    grid[2:12, 2:12] = 1
    grid[5, 5] = 2  # a speck inside an area
    grid[20:24, 20:22] = 0  # eight pixels
    grid[20:27, 25] = 0  # seven pixels
    grid[12, 12] = 1  # touches the area at a corner only
    both = pd.concat([frame(spark, 1, grid), frame(spark, 2, grid), frame(spark, 3, grid)])
    geo = spark.createDataFrame([(1, 10.0), (2, 60.0)], "frame long, apothem double")
    px = spark.createDataFrame(both, SCHEMA)
    kept = {f: {(r.y, r.x, r.colour) for r in K.drop_specks(px, geo).where(f"frame = {f}").collect()} for f in (1, 2, 3)}
    body = {(y, x, 1) for y in range(2, 12) for x in range(2, 12)} - {(5, 5, 1)}
    small = {(y, x, 0) for y in range(20, 24) for x in (20, 21)}
    assert kept[1] == kept[3] == body | small
    assert kept[2] == body  # 0.004 x 60^2 is more than eight


def test_repeats_nulls_and_empty_frames(spark):
    geo = spark.createDataFrame([(1, None)], "frame long, apothem double")
    assert K.drop_specks(spark.createDataFrame([], SCHEMA), geo).count() == 0
    rows = [(1, y, x, 2) for y in range(3) for x in range(3)] * 2 + [(1, None, 0, 2), (1, 9, None, 2), (1, 9, 9, None), (1, 9, 9, -1)] + [(None, y, 0, 1) for y in range(8)]
    got = [tuple(r) for r in K.drop_specks(spark.createDataFrame(rows, SCHEMA), geo).collect()]
    assert sorted(r[1:] for r in got if r[0] == 1) == [(y, x, 2) for y in range(3) for x in range(3)]
    assert sorted(r[1:] for r in got if r[0] is None) == [(y, 0, 1) for y in range(8)]


@pytest.mark.parametrize("name", ["p13_same_colour_areas", "p13_drop_specks", "p24_runs_without_specks", "p29_flash_grid"])
def test_twins(spark, name):
    from test_queries import test_twin

    test_twin(spark, name)
