"""Audit of how the sources of a language diverge, with late string materialisation.

Terms are counted per (language, source) by tasks, which write one row per group and term: a
64-bit digest, the documents, the occurrences, and the number that the task's chunk gave the
term.  The term itself stands in a column of its own, once per chunk.
All grouping then reads and shuffles digests and numbers only.  A language keeps the terms in
at least ``least_docs`` of its documents.  For the digests kept, and for no others, the minimum
and the maximum string are taken; where they differ, two terms share the digest, and its rows are split by their strings.  Strings
come back only to the rows of the ``term`` part that may be among the first ``top``.

Shares are exact integers (a thousand millionths, rounded down, plus one).  Differences of two
sources are summed over blocks of terms: a task gets the shares of at most ``SIDE`` x 2 sources
over about ``TERMS`` terms and returns one partial sum per pair of sources, so neither a
frequent term nor a large source makes a task larger; the rows that leave are as many as the
pairs that the result itself lists, per block.

Defined results: null text, language and source count as ''.  A row is a document, so repeated
rows count again and doc_ids are not read.  Texts without terms make their (language, source)
group occur with counts of 0; a language without kept terms has pairs of value 0 and no ``term`` rows.  Ties
are ordered by the item's UTF-8 bytes.  Very long texts are cut into blocks between terms, and a task
writes a chunk out whenever it holds ``HELD`` terms.  Extra columns are ignored, so names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretide.llm import bytesets as B
from foretide.llm.common import maybe_in
from foretide.settings import materialise

#: Bytes outside terms become blanks, A-Z lower case; terms are runs of ASCII letters and bytes of other characters.
PLAIN = bytes(int(B.LOWER[b]) if B.LETTER[b] else 32 for b in range(256))
HELD = 400_000  # distinct terms of a task's chunk
TERMS, SIDE = 1024, 512
SCALE = 1_000_000_000
SCHEMA = "lang string, source string, digest long, docs long, n long, chunk long, word long, term string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def terms(text: str) -> Counter:
    """Occurrences of the terms, as UTF-8 bytes."""
    found: Counter = Counter()
    for block in B.blocks(text, cut=~B.LETTER):
        found.update(block.tobytes().translate(PLAIN).split())
    return found


def digest(term: bytes, bits: int) -> int:
    """The low bits of a signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(term)
    return (h & ((1 << bits) - 1)) - (1 << 63) if bits == 64 else h & ((1 << bits) - 1)


class _Words(dict):
    """Numbers terms as they are met."""

    def __missing__(self, term) -> int:
        self[term] = n = len(self)
        return n


class Held:
    """A task's counts: every term once, and (group, term) numbers with documents and occurrences."""

    def __init__(self):
        self.words, self.groups = _Words(), _Words()
        self.keys, self.docs, self.times = [], [], []  # sorted parts and single documents
        self.size = self.dense = 0  # entries, and those of the sorted part

    def add(self, group: tuple[str, str], text: str) -> None:
        g, found = self.groups[group], terms(text)
        self.keys.append((g << 32) + np.fromiter(map(self.words.__getitem__, found), np.int64, len(found)))
        self.docs.append(np.ones(len(found), np.int64))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        self.size += len(found)
        if self.size > self.dense + 4 * HELD:
            self.compact()

    def compact(self) -> None:
        keys, docs, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.keys, self.docs, self.times))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys = [keys[first]]
        self.docs, self.times = ([np.add.reduceat(x[order], first) if len(first) else x] for x in (docs, times))
        self.size = self.dense = len(first)

    def full(self) -> bool:
        return len(self.words) > HELD or self.dense > 3 * HELD

    def rows(self, chunk: int, bits: int, slice_rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        self.compact()
        digests = np.fromiter((digest(t, bits) for t in self.words), np.int64, len(self.words))
        names = [t.decode("utf-8", "replace") for t in self.words]
        groups = [pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1)]
        keys, docs, times = self.keys[0], self.docs[0], self.times[0]
        word, group = keys & 0xFFFFFFFF, keys >> 32
        first = np.zeros(len(word), bool)
        first[np.unique(word, return_index=True)[1]] = True
        for at in range(0, len(word), slice_rows):
            w, g, f = (x[at : at + slice_rows] for x in (word, group, first))
            spelt = iter([names[i] for i in w[f].tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    *[x.take(pa.array(g)) for x in groups],
                    pa.array(digests[w]),
                    pa.array(docs[at : at + slice_rows]),
                    pa.array(times[at : at + slice_rows]),
                    pa.array(np.full(len(w), chunk)),
                    pa.array(w),
                    pa.array([next(spelt) if x else None for x in f.tolist()], pa.string()),
                ],
                names=NAMES,
            )
        # One row without a term for every group, so groups without terms occur too.
        n = len(self.groups)
        zeros, none = pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([*groups, none, zeros, zeros, none, none, pa.nulls(n, pa.string())], names=NAMES)


def counted(bits: int = 64):
    """For mapInArrow: (lang, source, text) rows to the rows of :class:`Held`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, Held()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "source", "text")]
            for lang, source, text in zip(*columns, strict=True):
                held.add((lang, source), text)
                if held.full():
                    yield from held.rows(chunk, bits)
                    chunk, held = chunk + 1, Held()
        yield from held.rows(chunk, bits)

    return run


def term_rows(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The written rows of :func:`counted`; readers take only the columns they need."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return materialise(plain.mapInArrow(counted(bits), SCHEMA), "divergence-terms")


def kept_counts(rows: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, part, n) of kept terms, and (digest, part, term) of their names.

    ``part`` numbers the terms that share a digest; it is 0 where there is only one.
    """
    met = rows.where("docs > 0")
    keys = ["lang", "source", "digest"]
    kept = met.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest")
    kept = materialise(kept, "divergence-kept")
    # Least and greatest string of the kept digests, partly aggregated before they move.
    named = maybe_in(rows.where("term is not null").select("digest", "term"), kept, "digest")
    named = named.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("most"))
    named = materialise(named.join(kept.select("digest").distinct(), "digest", "left_semi"), "divergence-names")
    shared = materialise(named.where("least <> most").select("digest"), "divergence-shared")
    # Terms of a shared digest start again from their strings, found by the task's own numbers.
    spelt = rows.where("term is not null").join(shared, "digest", "left_semi").select("chunk", "word", "term")
    split = met.join(shared, "digest", "left_semi").drop("term").join(spelt, ["chunk", "word"])
    split = materialise(split.groupBy(*keys, "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "divergence-split")
    frequent = split.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest", "term")
    parts = split.select("digest", "term").distinct().withColumn("part", F.row_number().over(Window.partitionBy("digest").orderBy("term")))
    split = split.join(frequent, ["lang", "digest", "term"], "left_semi").join(parts, ["digest", "term"])
    alone = maybe_in(met.select(*keys, "n"), kept, "digest").groupBy(*keys).agg(F.sum("n").alias("n"))
    alone = alone.join(kept, ["lang", "digest"], "left_semi").join(shared, "digest", "left_anti")
    counts = alone.select(*keys, F.lit(0).alias("part"), "n").unionByName(split.select(*keys, "part", "n"))
    names = named.where("least = most").select("digest", F.lit(0).alias("part"), F.col("least").alias("term")).unionByName(parts.select("digest", "part", "term"))
    return materialise(counts, "divergence-counts"), names


def share(n: Column, total: Column, kept: Column, extra: int) -> Column:
    """1 + floor(SCALE (n + extra) / (total + extra kept)), exactly; of no kept terms no share is ever summed."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(n + extra) * F.lit(SCALE).cast("decimal(10,0)"), wide(F.greatest(total + extra * kept, F.lit(1)))) + 1


def pair_sums(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sources of a block, and the sums of |p - q| over its terms for all their pairs.

    Rows of part -1 say which sources there are, what share a term with no
    occurrence has there, and how many terms the block has, met in these sources or not.
    """
    base = batch[batch["part"] < 0].sort_values("source")
    sources = base["source"].to_numpy()
    cells = batch[batch["part"] >= 0]
    column = cells.groupby(["digest", "part"], sort=False).ngroup().to_numpy()
    table = np.repeat(base["p"].to_numpy(np.int64)[:, None], int(column.max()) + 1 if len(column) else 0, axis=1)
    place = {s: i for i, s in enumerate(sources)}
    table[[place[s] for s in cells["source"]], column] = cells["p"].to_numpy(np.int64)
    zero, size = base["p"].to_numpy(np.int64), base["size"].to_numpy(np.int64)
    elsewhere = (size - table.shape[1])[:, None] * np.abs(zero[:, None] - zero[None, :])
    return sources, elsewhere + np.stack([np.abs(table - row).sum(axis=1) for row in table])


def pairs(shares: DataFrame, whole: DataFrame, groups: DataFrame, extra: int, side: int = SIDE, per_block: int = TERMS) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language; ``whole`` lists each language's kept terms."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / per_block)).cast("int")
    sides = F.greatest(F.lit(1), F.ceil(F.col("sources") / side)).cast("int")
    own = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int")
    base = groups.withColumn("sides", sides).withColumn("blocks", blocks)
    block = F.pmod(F.xxhash64("digest", "part"), F.col("blocks")).cast("int")
    sizes = whole.join(base.select("lang", "blocks").distinct(), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("size"))
    none = base.select(
        "lang", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).cast("long").alias("digest"),
        F.lit(-1).alias("part"), share(F.lit(0), F.col("total"), F.col("kept"), extra).alias("p"), "sides",
    )
    none = none.join(sizes, ["lang", "block"], "left").na.fill(0, ["size"])
    some = shares.join(base.select("lang", "source", "sides", "blocks"), ["lang", "source"])
    some = some.select("lang", "source", block.alias("block"), "digest", "part", "p", "sides", F.lit(0).cast("long").alias("size"))
    both = none.unionByName(some)
    # A source meets the sources of every side once: the pair of sides is the smaller, then the larger.
    other = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    other = other.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))

    def sums(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        lang, _, a, b = key
        sources, total = pair_sums(batch)
        at = batch.drop_duplicates("source").set_index("source")["own"].reindex(sources).to_numpy()
        i, j = np.nonzero(np.triu(np.ones(total.shape, bool), 1) & ((at[:, None] != at[None, :]) | (a == b)))
        return pd.DataFrame({"lang": lang, "source": sources[i], "item": sources[j], "value": total[i, j]})

    partial = other.groupBy("lang", "block", "a", "b").applyInPandas(sums, "lang string, source string, item string, value long")
    summed = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return summed.unionByName(turned)


def audit(docs: DataFrame, least_docs: int = 30, extra: int = 5, top: int = 50, bits: int = 64, side: int = SIDE, per_block: int = TERMS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank; see the module's text."""
    rows = term_rows(docs, bits)
    counts, names = kept_counts(rows, least_docs)
    kept = counts.groupBy("lang").agg(F.countDistinct("digest", "part").alias("kept"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = materialise(groups.join(per_lang, "lang"), "divergence-groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"), extra))
    shares = materialise(shares.select("lang", "source", "digest", "part", "n", "p"), "divergence-shares")

    whole = counts.groupBy("lang", "digest", "part").agg(F.sum("n").alias("lang_n"))
    whole = whole.join(kept, "lang").select("lang", "digest", "part", share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), extra).alias("q"))
    whole = materialise(whole, "divergence-whole")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    listed = pairs(shares.select("lang", "source", "digest", "part", "p"), whole.select("lang", "digest", "part"), groups, extra, side, per_block)
    listed = listed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    # Digests and numbers up to the first ``top`` values with their ties; only those get their strings.
    above = shares.join(whole, ["lang", "digest", "part"]).where("p > q").select("lang", "source", "digest", "part", (F.col("p") - F.col("q")).alias("value"))
    near = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    first = above.withColumn("_r", F.rank().over(near)).where(F.col("_r") <= top)
    first = first.join(names, ["digest", "part"]).select("lang", "source", "value", F.col("term").alias("item"))
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return listed.unionByName(first.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
