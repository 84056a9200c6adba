"""Same-coloured areas of a raster, and the removal of specks.

A frame is a fixed amount of data: its pixels are dealt and sorted once by frame, and
numpy makes the pixels of some frames at a time into runs along the pixel rows and contracts
the ones that touch.  No window and no aggregate holds pixels, so a task keeps one sort of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 100_000  # rows of whole frames that numpy works off together


RUN_COLUMNS = "y int, x0 int, x1 int, colour int, component int, size long"


def _dealt(coloured: DataFrame) -> DataFrame:
    """(frame, y, x, colour) of the pixels with a place and a colour, dealt by frame.

    Dealt to the session's number of partitions: pixels are small on the wire, so tasks
    joined by bytes would hold many times that in memory.
    """
    parts = int(coloured.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return coloured.where("y is not null and x is not null and colour >= 0").select(
        "frame", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("colour").cast("int").alias("colour")
    ).repartition(parts, "frame")


def by_frames(dealt: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on tables of whole frames, in their order, of rows that are dealt by frame."""
    return dealt.sortWithinPartitions("frame").mapInArrow(lambda batches: whole_frames(batches, work), schema)


def whole_frames(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.Table], rows: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """``work`` on the frames of sorted batches, as soon as there are about ``rows`` rows of whole ones."""
    held, many, most = [], 0, rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            many += batch.num_rows
        if many >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(frame_starts(table))[-1])
            if cut:
                yield from work(table.slice(0, cut)).to_batches()
            # The last frame may go on in the next batch.
            held, many = table.slice(cut).to_batches(), table.num_rows - cut
            most = max(rows, 2 * many)
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()


def frame_starts(table: pa.Table) -> np.ndarray:
    """Whether a row's frame is another than that of the row before; null is a frame."""
    frame = table["frame"].combine_chunks()
    none = frame.is_null().to_numpy(zero_copy_only=False)
    start = np.ones(len(frame), dtype=bool)
    other = pc.fill_null(pc.not_equal(frame[1:], frame[:-1]), False).to_numpy(zero_copy_only=False)
    start[1:] = other | (none[1:] != none[:-1])
    return start


def _runs(table: pa.Table) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Runs in the order of frame, colour and place: their frames, the frames' numbers, and y, x0, x1, colour."""
    y, x, colour = (table[c].to_numpy().astype(np.int64) for c in ("y", "x", "colour"))
    number = np.cumsum(frame_starts(table)) - 1
    order = np.lexsort((x, y, colour, number))
    y, x, colour, number = y[order], x[order], colour[order], number[order]
    # A pixel that is given twice continues its run.
    new = np.ones(len(x), dtype=bool)
    new[1:] = (np.diff(number) != 0) | (np.diff(colour) != 0) | (np.diff(y) != 0) | (np.diff(x) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    frame = table["frame"].combine_chunks().take(pa.array(order[first]))
    return frame, number[first], [y[first], x[first], x[last], colour[first]]


def _run_table(frame: pa.Array, runs: list[np.ndarray], **more: np.ndarray) -> pa.Table:
    columns = {c: pa.array(v.astype(np.int32)) for c, v in zip(("y", "x0", "x1", "colour"), runs)}
    return pa.table({"frame": frame, **columns, **{c: pa.array(v) for c, v in more.items()}})


def colour_runs(coloured: DataFrame) -> DataFrame:
    """(frame, y, x0, x1, colour): stretches of one colour along a pixel row.

    Pixels without a place or a colour belong to no run; a pixel that is given twice
    counts once.
    """

    def work(table: pa.Table) -> pa.Table:
        frame, _, runs = _runs(table)
        return _run_table(frame, runs)

    kind = coloured.schema["frame"].dataType.simpleString()
    return by_frames(_dealt(coloured), work, f"frame {kind}, y int, x0 int, x1 int, colour int")


def contract(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """Component number of every run of one frame; runs of neighbouring rows touch where their x overlap.

    Runs are put on one line, row after row and colour after colour, so that the
    touching runs of the row above are a stretch found by two binary searches.
    """
    n = len(y)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    y, x0, x1, colour = (a.astype(np.int64) for a in (y, x0, x1, colour))
    x0, x1, y = x0 - x0.min(), x1 - x0.min(), y - y.min()
    wide = x1.max() + 1
    row = colour * (y.max() + 2) + y + 1
    order = np.argsort(row * wide + x0, kind="stable")
    first, last = (row * wide + x0)[order], (row * wide + x1)[order]
    low = np.searchsorted(last, first - wide, side="left")
    high = np.searchsorted(first, last - wide, side="right")
    many = np.maximum(high - low, 0)
    below = np.repeat(np.arange(n), many)
    above = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    label = np.arange(n)
    while True:
        least = np.minimum(label[below], label[above])
        before = label.copy()
        # Roots are hooked, not only the runs themselves, so long chains shrink by halves.
        for side in (below, above):
            np.minimum.at(label, before[side], least)
            np.minimum.at(label, side, least)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
        if np.array_equal(before, label):
            break
    out = np.empty(n, dtype=np.int64)
    out[order] = label
    return out


def _components(table: pa.Table) -> pa.Table:
    frame, number, (y, x0, x1, colour) = _runs(table)
    # Pixel rows of all frames and colours below one another, with a free one between any that are not neighbours.
    same = (np.diff(number) == 0) & (np.diff(colour) == 0)
    down = np.where(same, np.minimum(np.diff(y), 2), 2)
    label = contract(np.concatenate([[0], np.cumsum(down)]), x0, x1, np.zeros(len(y), dtype=np.int64))
    size = np.bincount(label, weights=x1 - x0 + 1, minlength=1).astype(np.int64)
    component = label - np.searchsorted(number, number)
    return _run_table(frame, [y, x0, x1, colour], component=component.astype(np.int32), size=size[label])


def same_colour_components(coloured: DataFrame) -> DataFrame:
    """Runs with their four-neighbour component (numbered within the frame) and its pixels: (frame, y, x0, x1, colour, component, size)."""
    kind = coloured.schema["frame"].dataType.simpleString()
    return by_frames(_dealt(coloured), _components, f"frame {kind}, {RUN_COLUMNS}")


def drop_specks(coloured: DataFrame, geo: DataFrame, least: float = 8.0, share: float = 0.004) -> DataFrame:
    """Pixels (frame, y, x, colour) of areas with at least max(least, share x apothem^2) pixels.

    Frames without a geometry, or with a null apothem, are held to ``least`` alone.
    """
    sized = same_colour_components(coloured).join(geo.select("frame", "apothem"), "frame", "left")
    needed = F.greatest(F.lit(float(least)), F.coalesce(F.col("apothem") * F.col("apothem") * share, F.lit(0.0)))
    kept = sized.where(F.col("size") >= needed)
    return kept.select("frame", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "colour")
