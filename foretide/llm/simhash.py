"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint becomes a vector of bit counts, one per 2-bit segment.  The
Manhattan distance of two vectors is at most the Hamming distance of the fingerprints, so
fingerprints within ``radius`` bits differ by at most ``radius`` over all coordinates.
Cut the coordinates into ``groups`` groups: at least ``groups - radius`` of them agree
entirely.  Every choice of that many groups is a grid, the coordinates in it name a cell,
and each pair in range shares a cell of some grid.  Inside a cell the Manhattan bound is
tested over all segments, as one bit count of the vectors in unary, then the exact distance.

Cells differ in size: two of four segment values count one bit, so the cell of all ones holds far more
than others and grows with the data.  Members of cells above ``split`` are dealt further, by the bits on which
``parts - radius`` of ``parts`` parts of the fingerprint agree (all pairs in range share such a
choice), before any task sees them; a walk that stalls inside a cell does the same with its rest.

Copies collapse to one fingerprint first.  A cell never lists its pairs: it is walked from
neighbour to neighbour over the members not reached yet and emits one verified link per
member at most, so a cell of m near copies gives m - 1 links.  The links keep everything
that is reachable reachable; components are then found by contraction.

Nulls and texts without words have the fingerprint zero and link like any other.  Rows
with a null doc_id take part, but never give a component its name unless it has no other.
Repeated rows share a fingerprint and component.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from foretide.llm.common import cut, row_hash
from foretide.settings import materialise

SEGMENTS = 32  # of two bits each
_CHUNK = 1 << 20


def _word_chunks(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased words, about a megabyte of text at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() touches A-Z only
    at = 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()  # splits at \x20 and \x09-\x0D
        at = end


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(hashes: list[int]) -> int:
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        return len(hashes)

    for words in _word_chunks(text):
        words = held + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            n += add([digest(joined[a:b], seed) for a, b in spans])
        held = words[-(shingle - 1) :]
    if not n:
        if not held:
            return 0
        n = add([digest(b" ".join(held), seed)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts.tolist()], np.uint64).view(np.int64))


def grids(groups: int, radius: int) -> list[int]:
    """Bit masks of the segments of each grid."""
    parts = np.array_split(np.arange(SEGMENTS), groups)
    masks = [sum(3 << int(2 * s) for s in part) for part in parts]
    return [sum(c) for c in combinations(masks, groups - radius)]


def popcounts(fp):
    """Per-segment bit counts, packed where the segments were (a column expression)."""
    low = F.lit(0x5555555555555555)
    one, two = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return one.bitwiseXOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))  # two-bit sums, no carries


def bit_masks(bits: np.ndarray, parts: int, radius: int) -> list[tuple[int, np.ndarray]]:
    """Masks of which two fingerprints in range agree on at least one, with the bits left open."""
    cuts = np.array_split(bits, min(parts, len(bits)))
    out = []
    for chosen in combinations(range(len(cuts)), len(cuts) - radius):
        mask = sum(1 << int(x) for c in chosen for x in cuts[c])
        out.append((mask, np.concatenate([cuts[c] for c in range(len(cuts)) if c not in chosen])))
    return out


def unary(fp: np.ndarray) -> np.ndarray:
    """Two-bit counts as 00, 01 or 11, so that differing bits of two vectors are their Manhattan distance."""
    low = np.uint64(0x5555555555555555)
    one, two = fp & low, (fp >> np.uint64(1)) & low
    return (one | two) | ((one & two) << np.uint64(1))


_FEW = 8
_ALL = np.arange(64)


def _in_runs(fp: np.ndarray, starts: np.ndarray, radius: int, bits: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified links inside each run of ``fp``; ``bits`` are those that the members of a run may differ in."""
    u = unary(fp)
    sizes = np.diff(np.append(starts, len(fp)))
    run = np.repeat(np.arange(len(starts)), sizes)
    few = sizes[run] <= _FEW
    a, b = [], []
    for d in range(1, min(_FEW, int(sizes.max(initial=1)))):  # runs of a few members: by offset, all at once
        at = np.flatnonzero(few[:-d] & (run[:-d] == run[d:]) & (np.bitwise_count(u[:-d] ^ u[d:]) <= radius))
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        a.append(fp[at])
        b.append(fp[at + d])
    for s, n in zip(starts[sizes > _FEW].tolist(), sizes[sizes > _FEW].tolist(), strict=True):
        x, y = _linked(fp[s : s + n], radius, bits)
        a += x
        b += y
    return a, b


def _linked(members: np.ndarray, radius: int, bits: np.ndarray, patience: int = 32) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Verified links that span every component of one cell.

    Walks from neighbour to neighbour, which is quick where many are near.  Where ``patience`` steps reach
    hardly any, the rest (the reached ones not walked from included) is split by its bits.
    """
    u = unary(members)
    left, queue, a, b = np.arange(1, len(members)), [0], [], []
    steps, before = 0, len(left)
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        close = np.bitwise_count(u[left] ^ u[i]) <= radius
        close[close] = np.bitwise_count(members[left[close]] ^ members[i]) <= radius
        near, left = left[close], left[~close]
        if len(near):
            a.append(np.full(len(near), members[i]))
            b.append(members[near])
            queue.extend(near.tolist())
        steps += 1
        if steps % patience == 0:
            if len(left) > patience and len(left) > 0.75 * before and len(bits) > radius:
                rest = members[np.concatenate([np.array(queue, np.int64), left])]
                for mask, others in bit_masks(bits, 7, radius):
                    key = rest & np.uint64(mask)
                    order = np.argsort(key, kind="stable")
                    starts = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1))
                    x, y = _in_runs(rest[order], starts, radius, others)
                    a += x
                    b += y
                break
            before = len(left)
    return a, b


def _walk(radius: int):
    """Cells arrive one after another, each row holding (grid, cell, part, fp)."""

    def solve(grid: np.ndarray, cell: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        new = np.flatnonzero((np.diff(grid) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
        a, b = _in_runs(fp.view(np.uint64), np.concatenate(([0], new)), radius, _ALL)
        none = [np.zeros(0, np.uint64)]
        x, y = np.concatenate(none + a).view(np.int64), np.concatenate(none + b).view(np.int64)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []  # the last cell may go on
        for batch in batches:
            if not len(batch):
                continue
            rows = tuple(batch[c].to_numpy() for c in ("grid", "cell", "part", "fp"))
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            goes_on = held and all(r[-1] == held[-1][k][-1] for k, r in enumerate(rows[:3]))
            if cut or (held and not goes_on):
                done = [*held, tuple(r[:cut] for r in rows)]
                yield solve(*[np.concatenate(p) for p in zip(*done, strict=True)])
                held = []
            held.append(tuple(r[cut:] for r in rows))
        if held:
            yield solve(*[np.concatenate(p) for p in zip(*held, strict=True)])

    return walk


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)


def links(distinct: DataFrame, radius: int = 4, groups: int = 7, split: int = 1 << 16) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep all reachability within ``radius``."""
    masks, further = grids(groups, radius), [m for m, _ in bit_masks(_ALL, 7 if radius < 7 else radius + 3, radius)]
    counts = popcounts(F.col("fp"))
    cells = distinct.select("fp", F.posexplode(F.array(*[counts.bitwiseAND(_signed(m)) for m in masks])).alias("grid", "cell"))
    # Large cells by a bitmap, so what is broadcast is bounded; a small cell taken for a large one is split in vain only.
    name = F.xxhash64("grid", "cell")
    page, bit = F.pmod(F.shiftright(name, 6), F.lit(1 << 18)), F.call_function("shiftleft", F.lit(1).cast("long"), name.bitwiseAND(63).cast("int"))
    large = cells.groupBy("grid", "cell").count().where(F.col("count") > split).groupBy(page.alias("_page")).agg(F.bit_or(bit).alias("_bits"))
    is_large = F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(bit) != 0
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("part")))
    parts = F.array(*[F.struct(F.lit(i).alias("sub"), F.col("fp").bitwiseAND(_signed(m)).alias("part")) for i, m in enumerate(further)])
    dealt = cells.join(F.broadcast(large), page == F.col("_page"), "left").select("fp", "grid", "cell", F.explode(F.when(is_large, parts).otherwise(whole)).alias("_p"))
    # A grid of a large cell is named by both choices.
    dealt = dealt.select("fp", (F.col("grid") * (len(further) + 1) + F.col("_p.sub") + 1).alias("grid"), "cell", F.col("_p.part").alias("part"))
    return (
        dealt.repartition("grid", "cell", "part")
        .sortWithinPartitions("grid", "cell", "part")
        .mapInPandas(_walk(radius), "a long, b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge.

    Every round points each node at the least neighbour and then contracts: edges are
    rewritten between the roots and those inside a component vanish, so what is left
    shrinks at least by half.  Each round is checkpointed.
    """
    spark = edges.sparkSession
    left = cut(edges.where("a <> b"))
    hops: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parent = cut(parent.select("node", F.least("node", "least").alias("root")))
        # Parents only decrease, so jumping ends at a node that is its own parent.
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            jumped = cut(parent.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
            parent = jumped.select("node", "root")
            if jumped.where("_moved").isEmpty():
                break
        hops.append(parent)
        roots = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        left = cut(
            left.join(roots, "a")
            .join(roots.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where("a <> b")
            .distinct()
        )
    if not hops:
        return spark.createDataFrame([], "node long, root long")
    # A node's root in one round is a node of the next; later rounds hold ever fewer nodes.
    total = hops[0]
    for hop in hops[1:]:
        nxt = hop.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        total = total.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return total


def near_duplicates(docs: DataFrame, radius: int = 4, groups: int = 7) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` its (doc_id, row_key, fp); per distinct fp its (fp, root)."""
    prints = materialise(
        docs.select("doc_id", row_hash(docs).alias("row_key"), fingerprints(F.col("text")).alias("fp")), "simhash"
    )
    distinct = prints.select("fp").distinct()
    roots = components(links(distinct, radius, groups)).withColumnRenamed("node", "fp")
    return prints, roots


def classes(docs: DataFrame, radius: int = 4, groups: int = 7) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (least doc_id reachable) of every row."""
    prints, roots = near_duplicates(docs, radius, groups)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialise(firsts.join(roots, "fp", "left"), "simhash-roots")
    # Only linked fingerprints need their root's name; a root may have many, so they are dealt over copies of it.
    salts = 32
    linked = named.where("root is not null").withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(salts)))
    names = linked.groupBy("root", "_salt").agg(F.min("least").alias("least")).groupBy("root").agg(F.min("least").alias("component_id"))
    names = names.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    lone = named.where("root is null").select("fp", F.col("least").alias("component_id"))
    ids = materialise(linked.join(names, ["root", "_salt"]).select("fp", "component_id").unionByName(lone), "simhash-classes")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, groups: int = 7) -> DataFrame:
    """``docs`` without near copies: of each component the row with the least doc_id stays.

    Ties on doc_id go to the least row hash; of entirely equal rows one stays.
    """
    prints, roots = near_duplicates(docs, radius, groups)
    per_fp = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    named = per_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keys = named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.row_key")
    rows = prints.groupBy("doc_id", "row_key").agg(F.count("*").alias("_n")).withColumnRenamed("doc_id", "_id")
    keys = materialise(
        keys.join(rows.withColumnRenamed("row_key", "_key"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))).select("_id", "_key", "_n"),
        "simhash-kept",
    )
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_hash(docs).alias("_own"))

    def held(where: str) -> DataFrame:
        match = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))
        return own.join(keys.where(where), match, "left_semi").select("_row.*")

    if keys.where("_n > 1").isEmpty():
        return held("_n = 1")
    return held("_n = 1").unionByName(held("_n > 1").dropDuplicates())
