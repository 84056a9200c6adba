"""Importance resampling toward a target distribution, with segment deduplication.

Features are runs of 1 to ``ngram`` consecutive words, joined by one space, hashed by
CRC-32 into ``buckets``.  A bucket's gain compares its smoothed share of the target's features with
its share of the corpus; a document weighs the sum of its features' gains, gets a
Gumbel number that its doc_id alone decides, and the documents of the highest sums are drawn:
a weighted draw without replacement, the same in every run.

Line feeds separate words, so they cut texts into lines.  Corpus counts are made from
distinct lines: lines are grouped by their content (partial sums before the shuffle, so a
line that half the corpus holds moves once per task), each distinct line's feature counts
are computed once and multiplied by its occurrences.  Runs of two or more words that span
lines are added separately, per text, from the words at the borders.  Scoring works the
same way on the distinct lines of a batch.

CRC-32 is computed exactly, over all words of a block at once, byte place by byte place; a run of
words continues the state of its first words, so nothing is joined or looked up.  Words
over ``LONG`` bytes are fed to zlib one by one.  The buckets' sums of a task are one array.

The draw orders the narrow score rows by ranges, numbers each range and adds the rows
before it; no task holds more than a range.

Defined results: null and empty texts have no features, weight 0 and are never drawn while
``least_words`` is positive.  A null doc_id gets the Gumbel number of the empty text and comes last among ties.
Repeated rows are rows of their own; rows alike in score and doc_id share the ranks of their ties in
any order, which no column shows.  Very long texts are cut into
blocks between words.  Extra columns are ignored, so names cannot clash.  With an empty target or corpus all its
counts are 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.llm import bytesets as B
from foretide.settings import materialise

#: Words are runs of ASCII digits, ASCII letters and all bytes of other characters.
WORD = B.lookup([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
LONG = 48
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc_fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states (not yet inverted) after feeding each its span of ``data``."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
    sizes, at, now = sizes[order], starts[order], state[order]
    long = int(np.searchsorted(-sizes.clip(max=LONG + 1), -LONG))  # spans over LONG bytes come first
    for i in range(long):
        now[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]].tobytes(), int(now[i] ^ _ONES)) ^ 0xFFFFFFFF
    now_short, at, sizes = now[long:], at[long:], sizes[long:]
    live = np.searchsorted(-sizes, -np.arange(1, (int(sizes[0]) if len(sizes) else 0) + 1), side="right")
    for place, n in enumerate(live.tolist()):
        part = now_short[:n]
        now_short[:n] = _TABLE[(part ^ data[at[:n] + place]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty_like(now)
    out[order] = now
    return out


def _spaced(state: np.ndarray) -> np.ndarray:
    return _TABLE[(state ^ np.uint32(32)) & 0xFF] ^ (state >> np.uint32(8))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return B.runs(WORD[data])


def run_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the runs of 1, 2, .. n words that begin at each word (runs of k words: without the last k - 1)."""
    state = np.full(len(starts), _ONES)
    for k in range(min(n, len(starts))):
        m = len(starts) - k
        state = _spaced(state[:m]) if k else state
        state = crc_fed(state, data, starts[k:], ends[k:])
        yield ((state ^ _ONES) % np.uint32(buckets)).astype(np.int64)


def _lower(data: bytes) -> np.ndarray:
    return B.LOWER[np.frombuffer(data, np.uint8)]


def line_blocks(lines: list[bytes], size: int = B.BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first line, bytes, word starts, word ends, line of each word) of several lines at once.

    A line longer than a block stands alone, whole: its arrays are bounded by the line.
    """
    at = 0
    while at < len(lines):
        upto, total = at, 0
        while upto < len(lines) and (upto == at or total + len(lines[upto]) < size):
            total += len(lines[upto]) + 1
            upto += 1
        data = _lower(b"\n".join(lines[at:upto]))
        starts, ends = word_spans(data)
        borders = np.cumsum([len(x) + 1 for x in lines[at:upto]])
        yield at, data, starts, ends, np.searchsorted(borders, starts, side="right")
        at = upto


def line_counts(lines: list[bytes], times: np.ndarray, ngram: int, buckets: int) -> np.ndarray:
    """Bucket counts of distinct lines, each counted ``times`` over."""
    total = np.zeros(buckets, np.int64)
    for first, data, starts, ends, line in line_blocks(lines):
        for k, bucket in enumerate(run_buckets(data, starts, ends, ngram, buckets)):
            inside = line[: len(bucket)] == line[k:]
            np.add.at(total, bucket[inside], times[first + line[: len(bucket)][inside]])
    return total


def crossing(lines: list[bytes], ngram: int, buckets: int) -> np.ndarray:
    """Buckets of a text's runs of 2 to ``ngram`` words that lie on more than one line."""
    out = [np.zeros(0, np.int64)]
    if ngram < 2 or len(lines) < 2:
        return out[0]
    data = _lower(b"\n".join(lines))
    starts, ends = word_spans(data)
    line = np.searchsorted(np.cumsum([len(x) + 1 for x in lines]), starts, side="right")
    border = np.flatnonzero(line[1:] != line[:-1])
    near = np.zeros(len(starts), bool)
    for k in range(ngram - 1):  # words that begin a run over a border
        near[np.maximum(border - k, 0)] = True
    at = np.flatnonzero(near)
    state = crc_fed(np.full(len(at), _ONES), data, starts[at], ends[at])
    for k in range(1, ngram):
        fits = at + k < len(starts)
        at, state = at[fits], state[fits]
        state = crc_fed(_spaced(state), data, starts[at + k], ends[at + k])
        over = line[at + k] != line[at]
        out.append(((state[over] ^ _ONES) % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(out)


def _texts(batch: pa.RecordBatch) -> list[list[bytes]]:
    """The lines of a batch's texts."""
    return [[] if t is None else t.encode("utf-8", "surrogatepass").split(b"\n") for t in batch.column("text").to_pylist()]


def _bucket_rows(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, ngram: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): features of all texts, from distinct lines and the runs across lines."""

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            lines = [x.encode("utf-8", "surrogatepass") for x in batch.column("line").to_pylist()]
            total += line_counts(lines, batch.column("times").to_numpy(), ngram, buckets)
        yield _bucket_rows(total)

    def of_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for lines in _texts(batch):
                total += np.bincount(crossing(lines, ngram, buckets), minlength=buckets)
        yield _bucket_rows(total)

    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    distinct = lines.groupBy("line").agg(F.count("*").alias("times"))
    rows = distinct.mapInArrow(of_lines, "bucket long, n long")
    if ngram > 1:
        rows = rows.union(docs.select("text").mapInArrow(of_borders, "bucket long, n long"))
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of smoothed shares, rounded down, per bucket."""
    s, t, k = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def fit(docs: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The gains; ``buckets`` numbers are all that reaches the driver."""

    def array(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, ngram, buckets).collect():  # at most ``buckets`` rows
            out[r["bucket"]] = r["n"]
        return out

    return gains(array(docs), array(target))


def weighed(gain: np.ndarray, ngram: int, columns: list[str], flush: int = 4 << 20):
    """For mapInArrow: n_words, n_features and weight of each text, from the distinct lines of a batch."""

    def part(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(x, len(number)) for lines in texts for x in lines), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(lines) for lines in texts])
        distinct = list(number)
        n_words, n_features, weight = (np.zeros(len(distinct), np.int64) for _ in range(3))
        for first, data, starts, ends, line in line_blocks(distinct):
            n_words += np.bincount(first + line, minlength=len(distinct))
            for k, bucket in enumerate(run_buckets(data, starts, ends, ngram, len(gain))):
                inside = line[: len(bucket)] == line[k:]
                at = first + line[: len(bucket)][inside]
                n_features += np.bincount(at, minlength=len(distinct))
                np.add.at(weight, at, gain[bucket[inside]])
        out = []
        for values in (n_words, n_features, weight):
            sums = np.zeros(len(texts), np.int64)
            np.add.at(sums, doc, values[which])
            out.append(sums)
        if ngram > 1:
            for i, lines in enumerate(texts):
                over = crossing(lines, ngram, len(gain))
                out[1][i] += len(over)
                out[2][i] += gain[over].sum()
        return tuple(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            done = 0
            while done < len(texts):
                upto, held, size = done, [], 0
                while upto < len(texts) and (upto == done or size < flush):
                    raw = (texts[upto] or "").encode("utf-8", "surrogatepass")
                    held.append([x for x in raw.split(b"\n") if x])
                    size += len(raw)
                    upto += 1
                n_words, n_features, weight = part(held)
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(columns).slice(done, upto - done).columns, pa.array(n_words), pa.array(n_features), pa.array(weight)],
                    names=[*columns, "n_words", "n_features", "weight"],
                )
                done = upto

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """The thousandfold Gumbel number of a document, rounded down, from the first 8 hex digits of a SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, gain: np.ndarray, ngram: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row; one pass without a shuffle."""
    schema = "doc_id long, n_words long, n_features long, weight long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weighed(gain, ngram, ["doc_id"]), schema)
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def ranked(rows: DataFrame, least_words: int = 20, percent: int = 10) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3.. for the drawn, null for the others."""
    rows = materialise(rows.withColumn("_can", F.col("n_words") >= least_words), "resample-scores")
    order = [F.col("_can").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # A range's rows are numbered in order by their ids; written once, so the ranges stay as they are.
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(placed, "resample-order")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("_can").alias("can")).collect()  # a row per range
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before[r["part"]] = at
        at += r["n"]
    drawn = sum(r["can"] for r in sizes) * percent // 100
    starts = placed.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # as many rows as ranges
    return out.withColumn("rank", F.when(F.col("_can") & (place <= drawn), place)).drop("_can", "_id", "_part", "_before")


def draw(docs: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank in the draw (null: not drawn)."""
    return ranked(scores(docs, fit(docs, target, ngram, buckets), ngram, seed), least_words, percent)
