"""Thinning against a plain walk: dense steps, gaps over many stretches, ties, nulls."""

import random

import pytest

from foretide.operators import thinning


def plain(rows, step):
    """rows: (key, clock, id) -> kept ids."""
    out, last = [], {}
    for key, clock, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        if clock is None:
            out.append(i)
        elif key not in last or clock >= last[key] + step:
            out.append(i)
            last[key] = clock
    return sorted(out)


def kept(spark, rows, step, **options):
    df = spark.createDataFrame(rows, "k string, c long, id long")
    return sorted(r["id"] for r in thinning.thin(df, ["k"], ["c", "id"], "c", step, **options).collect())


def scattered(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for key in ("a", "b", None):
        at = rng.randint(-500, 500)
        for _ in range(400):
            at += rng.choice([0, 0, 1, 2, 3, 7, 30, 5000 if rng.random() < 0.05 else 4])
            rows.append((key, at, i))
            i += 1
    return rows + [("a", None, i), ("c", None, i + 1), ("c", 5, i + 2)]


@pytest.mark.parametrize("options", [{}, {"fan": 2, "levels": 3}, {"fan": 3, "levels": 1}, {"fan": 2, "levels": 0}])
def test_equals_a_plain_walk(spark, options):
    rows = scattered(len(options) + options.get("fan", 0))
    for step in (1, 7, 40):
        assert kept(spark, rows, step, **options) == plain(rows, step)


def test_ten_thousand_rows_in_one_step(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(35_000), i) for i in range(40_000)]
    assert kept(spark, rows, 10_000, fan=2, levels=1) == plain(rows, 10_000)


def test_no_rows_and_no_step(spark):
    assert kept(spark, [], 5) == []
    rows = [("a", 1, 1), ("a", 1, 2), ("a", 0, 3)]
    assert kept(spark, rows, 0) == [1, 2, 3]


def test_plan_does_not_depend_on_density(spark):
    def operators(rows):
        df = spark.createDataFrame(rows, "k string, c long, id long")
        return len(thinning.thin(df, ["k"], ["c", "id"], "c", 1000)._jdf.queryExecution().optimizedPlan().toString().split("\n"))

    assert operators([("a", i * 900, i) for i in range(50)]) == operators([("a", i % 2000, i) for i in range(4000)])
