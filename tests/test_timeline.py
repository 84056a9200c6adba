"""Sliced windows equal plain per-entity loops, for every slice width and with a hot entity."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foretide.operators import timeline as T


def rows(seed=3, n=240):
    rng = np.random.default_rng(seed)
    # One entity owns two thirds of all rows; times repeat, ids break the ties.
    key = np.where(rng.random(n) < 0.66, 0, rng.integers(1, 5, n))
    return pd.DataFrame(
        {"k": key.astype("int64"), "t": rng.integers(0, 900, n).astype("int64"), "id": np.arange(n, dtype="int64"),
         "v": rng.integers(0, 9, n).astype("int64")}
    ).sort_values(["k", "t", "id"]).reset_index(drop=True)


@pytest.fixture(scope="module", params=[7, 60, 10_000])
def line(request):
    return T.Timeline(("k",), ("t", "id"), "t", request.param)


@pytest.fixture(scope="module")
def data(spark):
    p = rows()
    return p, spark.createDataFrame(p)


def back(df, *cols):
    return df.select("id", *cols).toPandas().sort_values("id").reset_index(drop=True)


def want(p, values):
    return pd.DataFrame({"id": p.id, "x": values}).sort_values("id").reset_index(drop=True).x.tolist()


def test_previous_row(data, line):
    p, df = data
    got = back(T.previous_row(df, line, {"x": F.col("v")}), "x")
    assert [None if pd.isna(x) else x for x in got.x] == [None if pd.isna(x) else x for x in want(p, p.groupby("k").v.shift(1))]


def test_running(data, line):
    p, df = data
    got = back(
        T.running(df, line, sums={"s": F.col("v")}, maxima={"m": F.col("v")}, lasts={"l": F.when(F.col("v") > 6, F.col("id"))}), "s", "m", "l"
    )
    g = p.groupby("k").v
    assert got.s.tolist() == want(p, g.cumsum())
    assert got.m.tolist() == want(p, g.cummax())
    last = p.id.where(p.v > 6).groupby(p.k).ffill()
    assert got.l.fillna(-1).tolist() == [-1 if pd.isna(x) else x for x in want(p, last)]


def test_running_exclusive_and_numbers(data, line):
    p, df = data
    got = back(T.row_numbers(T.running(df, line, sums={"s": F.col("v")}, inclusive=False), line, "rn"), "s", "rn")
    g = p.groupby("k").v
    assert got.s.tolist() == want(p, g.cumsum() - p.v)
    assert got.rn.tolist() == want(p, g.cumcount() + 1)


def test_islands(data, line):
    p, df = data
    got = back(T.islands(df, line, F.col("v") > 4), "island")
    hit = p.v > 4
    starts = (hit != hit.groupby(p.k).shift(1)).astype(int)
    assert got.island.tolist() == want(p, starts.groupby(p.k).cumsum())


@pytest.mark.parametrize("n", [1, 5, 40])
def test_rows_halo(data, line, n):
    p, df = data
    padded = T.with_earlier_rows(df, line, n)
    got = back(T.drop_halo(padded.withColumn("x", F.sum("v").over(line.local().rowsBetween(-n, 0)))), "x")
    assert got.x.tolist() == want(p, p.groupby("k").v.transform(lambda s: s.rolling(n + 1, min_periods=1).sum()))


def test_time_halo(data, line):
    p, df = data
    padded = T.with_earlier_time(df, line, 100)
    got = back(T.drop_halo(padded.withColumn("x", F.sum("v").over(line.by_clock().rangeBetween(-100, 0)))), "x")
    expected = [int(p[(p.k == r.k) & (p.t >= r.t - 100) & (p.t <= r.t)].v.sum()) for r in p.itertuples()]
    assert got.x.tolist() == want(p, expected)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(data, line, strict):
    p, df = data
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = back(T.as_of(left, right, line, {"x": F.col("id")}, strict), "x")
    out = {}
    for r in p[p.id % 2 == 0].itertuples():
        c = p[(p.k == r.k) & (p.id % 2 == 1) & ((p.t < r.t) if strict else (p.t <= r.t))]
        out[r.id] = None if c.empty else int(c.sort_values(["t", "id"]).id.iloc[-1])
    assert {int(r.id): None if pd.isna(r.x) else int(r.x) for r in got.itertuples()} == out


def test_without_keys(spark):
    p = rows()
    line = T.Timeline((), ("t", "id"), "t", 50)
    got = back(T.row_numbers(spark.createDataFrame(p), line, "rn"), "rn")
    q = p.sort_values(["t", "id"]).reset_index(drop=True)
    assert got.rn.tolist() == want(q, np.arange(len(q)) + 1)


def test_hot_entity_is_spread_over_buckets(spark):
    """One entity owns a third of the rows: no bucket holds more than twice its size."""
    rows = spark.range(6_000).selectExpr("if(id % 3 = 0, 0, id % 50 + 1) as e", "id as t", "id as v")
    line = T.Timeline(("e",), ("t",), "t", 100)
    padded = T.with_earlier_rows(rows, line, 5, bucket=64)
    most = padded.groupBy("e", T.SLICE).count().agg(F.max("count")).first()[0]
    assert most <= 2 * 64
    frame = line.local().rowsBetween(-5, 0)
    got = T.drop_halo(padded.withColumn("x", F.sum("v").over(frame))).select("e", "t", "x")
    want = rows.withColumn("x", F.sum("v").over(Window.partitionBy("e").orderBy("t").rowsBetween(-5, 0))).select("e", "t", "x")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_null_keys_and_clocks_lose_no_row(spark):
    df = spark.createDataFrame([(1, 5, 1), (None, 7, 2), (1, None, 3), (None, None, 4), (1, 900, 5)], "e long, t long, v long")
    line = T.Timeline(("e",), ("t", "v"), "t", 100)
    sums = {r["v"]: r["s"] for r in T.running(df, line, sums={"s": F.col("v")}).collect()}
    assert sums == {3: 3, 1: 4, 5: 9, 4: 4, 2: 6}
    before = {r["v"]: r["p"] for r in T.previous_row(df, line, {"p": F.col("v")}).collect()}
    assert before == {3: None, 1: 3, 5: 1, 4: None, 2: 4}
    assert {r["v"]: r["rn"] for r in T.row_numbers(df, line).collect()} == {3: 1, 1: 2, 5: 3, 4: 1, 2: 2}


def test_one_far_value_does_not_crowd_a_cell(spark):
    df = spark.range(20_000).selectExpr("cast(id as double) as v").unionByName(spark.createDataFrame([(1e18,)], "v double"))
    cells, _ = T.by_depth(df, (), "v", "depth")
    assert cells.groupBy("_cell").count().agg(F.max("count")).first()[0] < 0.7 * 20_000
    from foretide.operators.aggregates import exact_quantiles

    assert exact_quantiles(df, F.col("v"), {"m": 0.5}).first()["m"] == 10_000.0


def test_chain_of_three_levels(spark):
    from foretide.operators.chain import clamps, entry_states

    n, q, want = 48 * 48 + 1, 0, []
    items = []
    for i in range(n):
        lo, hi = (i * 7) % 50 - 30, (i * 7) % 50 + (i % 11)
        items.append((1, i, (lo, hi)))
        want.append(q)
        q = min(max(q, lo), hi)
    df = spark.createDataFrame(items, "k long, pos long, change struct<lo:bigint,hi:bigint>")
    got = {r["pos"]: r["state"] for r in entry_states(df, ["k"], clamps(), 0).collect()}
    assert [got[i] for i in range(n)] == want


def test_shared_folder_must_be_named_off_a_local_master():
    from types import SimpleNamespace

    from foretide.settings import shared_folder

    class Conf:
        def get(self, key, default=None):
            return default

    fake = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: Conf()))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(fake)
