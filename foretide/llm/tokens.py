"""Token ids as ORC files: run-length encoded stripes, row indexes, Bloom filters.

Whole texts become arrays of ids, one row per document in ascending doc_id order, each
ending in ``end_id``.  ORC's integer run-length encoding packs the ids, every
``row_index_stride`` rows have minima and maxima, and Bloom filters on doc_id let a point
look-up skip stripes from metadata.  A stripe is the unit of parallel reading: Spark cuts
files at stripes of ``stripe_bytes``.

A document's first id stands at the ids of the files' earlier ranges (a small manifest,
summed from the files) plus its place in its own range.

Encoding asks the tokenizers library about distinct pieces only.  A byte-level tokenizer
of this kind never joins a character to a following blank or line feed, nor a letter to a
following stop, so a text may be cut there; ids of pieces met before come from a bounded
table per worker, keyed by 64-bit hashes.  Texts with any other white space or of over a
megabyte, and tokenizers of another kind, are encoded whole.

With ``added``, the string of an added token (``<|endoftext|>``) in a text becomes that
token's id, as the library does by itself; texts that hold one are encoded whole.  Without,
such strings are ordinary text.

Nulls count as empty texts and hold the end id only.  Null doc_ids come last; repeated
doc_ids are ordered by their texts' hashes.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretide.llm import bytesets as B
from foretide.settings import materialise

FLUSH = 2_000_000  # characters per batch
CACHE = 2_000_000  # distinct pieces a worker remembers
GROUP = 1 << 19  # bytes of text encoded together
_BLANK = B.lookup(b" \n")
_ASCII_LETTER = B.lookup([*range(65, 91), *range(97, 123)])
_STOP = B.lookup(b",.;:!?|%$&*#")
_CONTROL_SPACE = B.lookup([9, 11, 12, 13, 28, 29, 30, 31])


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Where white space other than blank and line feed begins."""
    one, two = np.append(data[1:], np.uint8(0)), np.append(data[2:], np.zeros(2, np.uint8))[: len(data)]
    general = (data == 0xE2) & (((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F)))
    rest = ((data == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((data == 0xE1) & (one == 0x9A)) | ((data == 0xE3) & (one == 0x80))
    return _CONTROL_SPACE[data] | general | rest


def _cuts(data: np.ndarray) -> np.ndarray:
    """Starts of pieces: where a blank follows something else, or a stop follows a Latin letter."""
    before, blank = data[:-1], _BLANK[data]
    letter = _ASCII_LETTER[before]
    letter[1:] |= (data[:-2] == 0xC3) & (before[1:] >= 0x80) & (before[1:] != 0x97) & (before[1:] != 0xB7)
    return np.flatnonzero((blank[1:] & ~blank[:-1]) | (letter & _STOP[data[1:]])) + 1


class _Table:
    """Sorted piece hashes and where their ids lie in the pool."""

    def __init__(self, keys=None, at=None, size=None):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.at = np.zeros(0, np.int64) if at is None else at
        self.size = np.zeros(0, np.int64) if size is None else size

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return i, self.keys[i] == keys

    def plus(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> _Table:
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        return _Table(keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order])


class Encoder:
    """Ids of texts, as one array and the number of ids of each text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = [t for t in spec.get("added_tokens") or [] if t["content"] and (added or not t.get("special"))]
        # Without a normalizer a text holds a token only if it holds its content as it is.
        self.whole = [t["content"].encode("utf-8", "surrogatepass") for t in tokens]
        before = spec.get("pre_tokenizer") or {}
        self.cuttable = (
            not spec.get("normalizer")
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not (spec.get("truncation") or spec.get("padding"))
        )
        self._forget()

    def _forget(self) -> None:
        self.old, self.new = _Table(), _Table()
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        if not self.cuttable:
            return self._library(texts)
        ids: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        held: list[int] = []
        total = 0

        def flush() -> None:
            if held:
                found, n = self._group([texts[i] for i in held], [raw[i] for i in held])
                ids.append(found)
                sizes[held] = n
                held.clear()

        for i, data in enumerate(raw):
            if total + len(data) > GROUP:
                flush()
                total = 0
            held.append(i)
            total += len(data)
        flush()
        return np.concatenate([np.zeros(0, np.int32), *ids]), sizes

    def _group(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        if len(data) > B.BLOCK or (len(data) and (_odd_space(data).any() or any(t in r for t in self.whole for r in raw))):
            if len(texts) == 1:
                return self._library(texts)
            parts = [self._group([t], [r]) for t, r in zip(texts, raw, strict=True)]
            return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = np.sort(np.concatenate([[0], _cuts(data), ends[:-1][ends[:-1] < len(data)]]), kind="stable").astype(np.int64)
        starts = starts[np.append(True, starts[1:] != starts[:-1])]
        stops = np.append(starts[1:], len(data))
        keys, first, back, _ = B.distinct(B.Hasher(data).spans(starts, stops))
        at, size = self._known(keys, lambda new: [data[starts[j] : stops[j]].tobytes().decode("utf-8", "surrogatepass") for j in first[new]])
        lengths = size[back]
        upto = np.cumsum(lengths)
        ids = self.pool[np.repeat(at[back] - (upto - lengths), lengths) + np.arange(upto[-1])]
        # Ids of a text: those of its pieces.
        last = np.searchsorted(starts, ends, side="left") - 1
        per_end = np.where(last >= 0, upto[np.maximum(last, 0)], 0)
        return ids, np.diff(per_end, prepend=0)

    def _known(self, keys: np.ndarray, pieces) -> tuple[np.ndarray, np.ndarray]:
        i, in_old = self.old.find(keys)
        j, in_new = self.new.find(keys)
        missing = np.flatnonzero(~in_old & ~in_new)
        if len(missing):
            if len(self.old.keys) + len(self.new.keys) + len(missing) > CACHE:
                self._forget()
                return self._known(keys, pieces)
            ids, sizes = self._library(pieces(missing))
            if self.used + len(ids) > len(self.pool):
                self.pool = np.append(self.pool[: self.used], np.zeros(max(len(ids), self.used), np.int32))
            self.pool[self.used : self.used + len(ids)] = ids
            self.new = self.new.plus(keys[missing], self.used + np.cumsum(sizes) - sizes, sizes)
            self.used += len(ids)
            if len(self.new.keys) > 40_000:
                self.old, self.new = self.old.plus(self.new.keys, self.new.at, self.new.size), _Table()
            return self._known(keys, pieces)
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[in_old], size[in_old] = self.old.at[i[in_old]], self.old.size[i[in_old]]
        at[in_new], size[in_new] = self.new.at[j[in_new]], self.new.size[j[in_new]]
        return at, size


def encoded(path: str, end_id: int, added: bool = False):
    """For mapInArrow: (doc_id, bucket, text) in order, to the rows of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = B.per_worker(f"encoder:{path}:{added}", lambda: Encoder(path, added))
        at = 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            done = 0
            while done < len(texts):
                upto, chars = done, 0
                while upto < len(texts) and (upto == done or chars + len(texts[upto]) <= FLUSH):
                    chars += len(texts[upto])
                    upto += 1
                ids, sizes = encoder.encode(texts[done:upto])
                ids = np.insert(ids, np.cumsum(sizes), np.int32(end_id))
                sizes += 1
                offsets = np.append(0, np.cumsum(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.select(["doc_id", "bucket"]).slice(done, upto - done).columns,
                        pa.array(at + offsets[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "bucket", "place", "n_tokens", "ids"],
                )
                at += int(offsets[-1])
                done = upto

    return run


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, stripe_bytes: int = 16 << 20, row_index_stride: int = 1_000, added: bool = False
) -> None:
    """Encode ``docs`` (doc_id, text) to ORC files under ``path``, ranges of doc_id in order."""
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("doc_id", F.spark_partition_id().alias("bucket"), "text")
    out = ranged.mapInArrow(encoded(tokenizer, end_id, added), "doc_id long, bucket int, place long, n_tokens long, ids array<int>")
    writer = out.write.option("compression", "zstd").option("orc.create.index", "true")
    writer = writer.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_index_stride)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, documents, tokens, before) of the ranges, from one column of the files."""
    per = spark.read.orc(path).groupBy("bucket").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy().astype(np.int64)
        values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("bucket"), batch.column("place"), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())],
            names=["doc_id", "bucket", "place", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all read from the files."""
    rows = spark.read.orc(path).select("doc_id", "bucket", "place", "ids")
    rows = rows.mapInArrow(_digest, "doc_id long, bucket int, place long, n_tokens long, ids_crc32 long")
    offsets = materialise(manifest(spark, path).select("bucket", "before").coalesce(1), "token-manifest")
    return rows.join(offsets, "bucket").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents; ranges, row indexes and Bloom filters prune what is read."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")
