"""Steps that must not grow faster than their input: files one per id, files of a stream, window statistics."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretide.operators import timejoin as J
from foretide.plans import stores
from foretide.settings import fresh_path


def test_files_of_ids_lie_in_few_folders(spark):
    ids = [(i, f"v{i}") for i in range(300)] + [(7, "again"), (8, None), (None, "x")]
    root = stores.write_each(spark.createDataFrame(ids, "id long, value string"), "few").removeprefix("file://")
    files = {os.path.basename(f): open(f).read() for f in glob.glob(f"{root}/*/*.txt")}
    assert len(os.listdir(root)) <= stores.FOLDERS and len(files) == 301
    assert files["5.txt"] == "v5\n" and sorted(files["7.txt"].split()) == ["again", "v7"] and files["null.txt"] == "x\n"
    assert sorted(files["8.txt"].split("\n")) == ["", "", "v8"]
    got = stores.RD.read_documents(spark, f"file://{root}/*").select(stores.file_id("path").alias("id")).where("id is not null")
    assert sorted(r.id for r in got.collect()) == list(range(300))


def test_stream_files_are_made_once_and_arrive_in_order(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(100).mapInPandas(count, "id long")
    stream = stores.arriving(spark, rows, F.when(F.col("id") < 90, (F.col("id") * 7 % 10).cast("int")), 10, 4)
    seen = []
    stream.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.id for r in b.collect()))).option(
        "checkpointLocation", fresh_path(spark, "seen")
    ).trigger(availableNow=True).start().awaitTermination()
    part = [sorted(i for i in range(90) if i * 7 % 10 in f) for f in (range(4), range(4, 8), range(8, 10))]
    assert seen == part and made.value == 100


def test_batched_statistics_equal_the_folded_ones(spark):
    rng = np.random.default_rng(5)
    rows = [[rng.normal(size=3).tolist() for _ in range(n)] for n in (1, 2, 3, 4, 9, 32, 32, 33)]
    rows += [[[1.0, float("nan"), 2.0], [float("nan"), 0.0, 1.0]], [[1.0, None, 2.0], [0.0, 1.0, 2.0]], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h array<array<double>>").repartition(3)
    got = df.select("i", J.array_statistics(F.col("h"), 3).alias("a"), J._folded_statistics(F.col("h"), 3).alias("b")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.b is None:
            assert r.a is None
        else:
            assert [v is None for v in r.a] == [v is None for v in r.b]
            assert np.array_equal(np.array(r.a, float), np.array(r.b, float), equal_nan=True)
    # Whole histories are not left to the array functions: their place in the plan is that of one batched step.
    assert "ArrowEvalPython" in df.select(J.array_statistics(F.col("h"), 3))._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_runs_are_those_of_all_rows(spark, tmp_path):
    from foretide.plans import dataset as D

    ts = "timestamp_micros(id * 60000000)"
    spark.range(400).selectExpr("id as event_id", f"{ts} as ts", "id % 4 as user_id", "'click' as event_type", "cast(id % 9 as double) as value", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(500).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> cast(sin(id + i) as float)) as embedding", "cast(id % 3 as int) as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    runs = spark.createDataFrame([(1, 0), (2, 1)], "session_id long, run int")
    d = str(tmp_path)
    some = D.vectors(spark, d, runs).select("event_id", F.to_json(F.struct("vector")).alias("v"))
    every = D.vectors(spark, d).where("session_id in (1, 2)").select("event_id", F.to_json(F.struct("vector")).alias("v"))
    assert some.count() == 200 and some.exceptAll(every).count() == 0 and every.count() == 200


def counted(spark, df):
    """``df`` and an accumulator of the rows worked out for it."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema), made


def test_marks_of_all_kinds_are_one_table(spark, tmp_path):
    from foretide.plans import timelines as L

    n, step = 300, 10**10
    kinds = ["click", "purchase", "error"]
    spark.range(n).selectExpr(
        "id as event_id", f"timestamp_micros(id * {step}) as ts", "if(id % 7 = 0, null, id % 5) as user_id",
        "if(id % 11 = 0, null, element_at(array('click', 'purchase', 'error'), int(id div 5 % 3) + 1)) as event_type", "1.0 as value", "'' as props",
    ).union(spark.range(1).selectExpr("999", "timestamp_micros(50000000000)", "0L", "'click'", "1.0", "''")).write.parquet(f"{tmp_path}/events.parquet")
    got = dict(zip(kinds, L.marks(spark, str(tmp_path), *kinds), strict=True))
    rows = [(i % 5, i * step, kinds[i // 5 % 3] if i % 11 else None) for i in range(n) if i % 7] + [(0, 5 * step, "click")]
    start = {u: min(t for v, t, _ in rows if v == u) for u in range(5)}
    for kind, df in got.items():
        want = {(u, (t - start[u]) // 172_800_000 * 12 // 1000) for u, t, k in rows if k == kind}
        assert sorted(tuple(r) for r in df.collect()) == sorted(want)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_a_truth_is_read_once_for_its_two_borders(spark):
    ev = spark.createDataFrame([(1, x) for x in (10, 11, 12, 20)], "c long, at long")
    tr = spark.createDataFrame([(1, x) for x in (11, 24)], "c long, at long")
    tr, made = counted(spark, tr)
    J.match_events(ev, tr, ["c"], 1, 6)  # writes the events with the truths in reach
    assert made.value <= 4  # once for the slices' sums, once for the rows


def test_forecasts_are_worked_out_once_for_all_insights(spark):
    from foretide.operators import windows as W
    from foretide.operators.timeline import Timeline

    rng = np.random.default_rng(3)
    windows = ["none", "under_10s", "10_to_20s", None]
    rows, t = [], {1: 0, 2: 0}
    for i in range(240):
        k = 1 + int(rng.random() < 0.3)
        t[k] += int(rng.integers(1, 400))
        rows.append((k, i, t[k], t[k], float(rng.random() * 30), windows[rng.choice(4, p=[0.2, 0.5, 0.25, 0.05])], "ready" if i % 9 else "warming_up"))
    df, made = counted(spark, spark.createDataFrame(rows, "k long, id long, ts_ms long, at long, remaining double, loss_window string, status string"))
    got = W.insights(df, Timeline(("k",), ("at", "id"), "at", 700), 500, 300, 300, 12.0)
    want = []
    for k in (1, 2):
        mine = sorted((r for r in rows if r[0] == k and r[6] == "ready"), key=lambda r: (r[3], r[1]))
        for kind, hit, least in (("loss_signal", lambda w: w not in (None, "none"), 500), ("imminent", lambda w: w == "under_10s", 300)):
            run = []
            for r in [*mine, None]:
                if r is not None and hit(r[5]):
                    run.append(r[3])
                    continue
                if run and run[-1] - run[0] >= least:
                    want.append((k, kind, run[0], run[-1], run[0], run[-1]))
                run = []
        want += [(k, "forecast_shift", a[2], b[2], a[3], b[3]) for a, b in zip(mine, mine[1:], strict=False) if b[3] - a[3] <= 300 and a[4] - b[4] >= 12.0]
    assert len(want) > 20 and sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert made.value == len(rows)


def test_monotone_values_are_chained_outside_any_branch(spark):
    from foretide.functions import scalars as S

    rows = [([0.3, None, 0.1],), ([float("nan"), 0.2, 0.1],), ([-1.0, 0.2, 3.0],), ([-0.5, -0.4, -0.3],)]
    df = spark.createDataFrame(rows, "p array<double>")
    assert [r.m for r in df.select(S.monotone(F.col("p"), 3).alias("m")).collect()] == [[0.3, 1.0, 1.0], [1.0] * 3, [0.0, 0.2, 1.0], [0.0] * 3]
    code = df.select(S.monotone(F.col("p"), 7).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array(greatest(" in code and "THEN array" not in code
    with pytest.raises(Exception, match="one cumulative probability per horizon expected"):
        spark.createDataFrame([(None,)], "p array<double>").select(S.monotone(F.col("p"), 3)).collect()


def test_runs_of_one_colour_need_no_window_and_no_aggregate(spark):
    from foretide.operators import components as K

    rng = np.random.default_rng(8)
    pixels = [(int(f), int(y), int(x), int(c)) for f, y, x, c in rng.integers(0, [3, 6, 40, 3], (900, 4))] + [(None, 0, 0, 1), (None, 0, 1, 1)]
    runs = K.colour_runs(spark.createDataFrame(pixels, "frame long, y int, x int, colour int"))
    got = sorted((-1 if r.frame is None else r.frame, r.y, r.colour, r.x0, r.x1) for r in runs.collect())
    at = {(-1 if f is None else f, y, c, x) for f, y, x, c in pixels}
    want = []
    for f, y, c, x in sorted(at):
        if (f, y, c, x - 1) not in at:
            end = x
            while (f, y, c, end + 1) in at:
                end += 1
            want.append((f, y, c, x, end))
    assert got == want
    geo = spark.createDataFrame([(1, 10.0)], "frame long, apothem double")
    plan = K.drop_specks(spark.createDataFrame(pixels, "frame long, y int, x int, colour int"), geo)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
