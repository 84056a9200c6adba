"""Large cells: split before the tasks, and split again where a walk stalls."""

import random
import time

import numpy as np
import pytest

from foretide.llm import simhash


def plain(fps, radius=4):
    """Least fingerprint reachable, by comparing all pairs."""
    fps = np.array(sorted(fps), np.uint64)
    root = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[i:] ^ fps[i]) <= radius) + i
        least = root[near].min()
        for r in np.unique(root[near]):
            root[root == r] = least
    return {int(f): int(fps[r]) for f, r in zip(fps, root)}


def ones(rng, n):
    """Fingerprints whose two-bit counts are all one: every grid puts them into one cell."""
    bits = rng.integers(0, 2, (n, 32), dtype=np.uint64)
    return ((np.uint64(1) + bits) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def members(seed, n):
    rng = np.random.default_rng(seed)
    base = ones(rng, n)
    near = base[: n // 4] ^ (np.uint64(3) << (rng.integers(0, 32, n // 4).astype(np.uint64) * np.uint64(2)))  # two bits away, same counts
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 64, (n // 4, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.unique(np.concatenate([base, near, dense]))


def test_unary_counts_are_the_manhattan_distance():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in "xy")
    counts = [np.array([[(int(f) >> 2 * s & 3).bit_count() for s in range(32)] for f in v]) for v in (x, y)]
    assert (np.bitwise_count(simhash.unary(x) ^ simhash.unary(y)) == np.abs(counts[0] - counts[1]).sum(axis=1)).all()
    assert (np.bitwise_count(simhash.unary(x) ^ simhash.unary(y)) <= np.bitwise_count(x ^ y)).all()


@pytest.mark.parametrize("split", [1 << 16, 50])
def test_hot_cells_keep_all_that_is_reachable(spark, split):
    fps = members(2, 1_200)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    edges = simhash.links(df, split=split)
    assert edges.where("bit_count(a ^ b) > 4").count() == 0
    got = {r["node"] % (1 << 64): r["root"] for r in simhash.components(edges).collect()}
    groups = {}
    for f, r in plain(fps).items():
        groups.setdefault(r, set()).add(got.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_million_members_of_one_cell():
    rng = np.random.default_rng(3)
    spread = rng.integers(0, 1 << 62, 1_000_000).astype(np.uint64)  # of a cell as large as this the members need not agree on more
    spread[1::1000] = spread[::1000] ^ np.uint64(0b1011)
    spread = rng.permutation(np.unique(spread))
    start = time.time()
    a, b = simhash._linked(spread, 4, np.arange(64))
    assert time.time() - start < 240
    pairs = {(int(min(x, y)), int(max(x, y))) for x, y in zip(np.concatenate(a), np.concatenate(b))}
    assert len(pairs) >= 1_000 and all((x ^ y).bit_count() <= 4 for x, y in pairs)


def test_cells_over_many_batches():
    import pandas as pd

    rng = random.Random(4)
    fps = members(5, 300)
    rows = pd.DataFrame([(g, c, 0, int(f)) for g in range(2) for c in range(3) for f in rng.sample(list(fps.view(np.int64)), 90)], columns=["grid", "cell", "part", "fp"])

    def links(size):
        parts = [rows.iloc[i : i + size] for i in range(0, len(rows), size)]
        return pd.concat(list(simhash._walk(4)(iter(parts)))).drop_duplicates().sort_values(["a", "b"]).to_numpy().tolist()

    whole = links(len(rows))
    assert whole and all(links(size) == whole for size in (1, 7, 89, 90, 91, 200))
