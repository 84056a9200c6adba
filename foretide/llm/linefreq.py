"""Quality rules: cross-document line frequency.

Lines are normalised (lower case, single blanks, digits as 0) and hashed.  Per host, the
documents that hold a line are counted: each document once however often it repeats the
line, and documents with equal texts once.  Lines in more than a share of the host's documents, and
in more than ``least`` of them, are boilerplate and removed; a document left with less than ``keep_share`` of its words is depleted and rejected.  Base rules reject
texts that are too short or repeat themselves.

Texts are read once, by one pass that writes counts and line hashes.  All counting is
grouped by (host, line) with partial sums; the boilerplate lines are a table that Spark
broadcasts where it is small and joins with skew handling where it is not.

Nulls and empty texts have no words and fail the base rules.  A null host is a host of
its own.  Repeated rows are judged one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from foretide.llm import bytesets as B
from foretide.settings import materialise

SYMBOL = B.lookup(b"#*$%&|<>")
_DIGITS = re.compile("[0-9]")
MEASURES = (
    "doc_id long, source string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<h:bigint,words:bigint>>"
)


def repeated_words(text: str, n: int = 8) -> int:
    """Words that lie in a window of ``n`` words found twice or more in the text."""
    words = []
    for block in B.blocks(text):
        starts, ends = B.runs(~B.SPACE[block])
        words.append(B.Hasher(block).spans(starts, ends))
    codes = np.concatenate([np.zeros(0, np.uint64), *words])
    grams = B.grams(codes, n)
    if len(grams) < 2:
        return 0
    _, at, count = np.unique(grams, return_inverse=True, return_counts=True)
    cover = np.zeros(len(codes) + 1, np.int64)
    twice = np.flatnonzero(count[at] > 1)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def normalised(line: str) -> str:
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The base counts of each text and its distinct normalised lines with their words."""
    for batch in batches:
        out = []
        for doc_id, source, text in zip(batch["doc_id"], batch["source"], batch["text"], strict=True):
            text = text or ""
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            inside = ~B.SPACE[data]
            seen: set[str] = set()
            dup, total, lines = 0, 0, {}
            for line in text.split("\n"):
                n = len(line.encode("utf-8", "surrogatepass").split())
                if not n:
                    continue
                total += n
                dup += line in seen
                seen.add(line)
                plain = normalised(line)
                lines[plain] = lines.get(plain, 0) + n
            out.append(
                (
                    doc_id,
                    source,
                    xxhash.xxh64_intdigest(data.tobytes()) - (1 << 63),
                    total,
                    int((inside & ((data & 0xC0) != 0x80)).sum()),
                    int(SYMBOL[data].sum()),
                    dup,
                    repeated_words(text),
                    [{"h": line_hash(k), "words": v} for k, v in lines.items() if k],
                )
            )
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in re.sub("<.*>", "", MEASURES).split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def measures(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "source", "text").mapInPandas(measured, MEASURES)
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "line-measures")


def boilerplate(rows: DataFrame, least: int = 5, share: float = 0.01) -> DataFrame:
    """(host, h): lines in more documents of their host than the limit.

    The limit is a share of the documents, so hosts of all sizes are judged alike;
    ``least`` only keeps a few chance repeats on a small host from counting.
    """
    distinct = rows.select(F.col("source").alias("host"), "text_hash", F.explode("lines.h").alias("h")).distinct()
    counts = distinct.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hosts = rows.select(F.col("source").alias("host"), "text_hash").distinct().groupBy("host").agg(F.greatest(F.count("*") * F.lit(float(share)), F.lit(float(least))).alias("limit"))
    limits = materialise(hosts.select(F.col("host").alias("_host"), "limit").coalesce(1), "line-hosts")
    over = counts.join(limits, F.col("host").eqNullSafe(F.col("_host"))).where("n > limit").select("host", "h", "n")
    return materialise(over, "line-boilerplate")


def judge(docs: DataFrame, least: int = 5, share: float = 0.01, keep_share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Per row: counts, ``removed_words``, ``base_failed`` and ``kept``; and the boilerplate lines."""
    rows = measures(docs)
    over = boilerplate(rows, least, share)
    hits = rows.select("row", "source", F.explode("lines").alias("_l")).join(
        over.select("host", F.col("h").alias("_h")), F.col("source").eqNullSafe(F.col("host")) & (F.col("_l.h") == F.col("_h"))
    )
    removed = hits.groupBy("row").agg(F.sum("_l.words").alias("removed_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= keep_share * F.col("n_words"))), over


@F.pandas_udf(ArrayType(LongType()))
def _hashes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [line_hash(normalised(x)) for x in (t or "").split("\n")])


def stripped(docs: DataFrame, over: DataFrame) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of their texts (null texts stay null)."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_row"), F.monotonically_increasing_id().alias("_id"), _hashes(F.col("text")).alias("_hs"))
    rows = materialise(rows, "line-rows")
    hit = rows.select("_id", F.col("_row.source").alias("_s"), F.explode(F.array_distinct("_hs")).alias("_h")).join(
        over.select("host", "h"), F.col("_s").eqNullSafe(F.col("host")) & (F.col("_h") == F.col("h"))
    )
    gone = hit.groupBy("_id").agg(F.collect_set("h").alias("_gone"))
    kept = F.filter(F.split(F.col("_row.text"), "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), F.element_at("_hs", i + 1)))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.concat_ws("\n", kept))
    return rows.join(gone, "_id", "left").select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")
