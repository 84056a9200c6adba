"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.settings import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the document number as text, modulo ``parts``; null stays null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def row_hash(df: DataFrame) -> Column:
    """A hash of every column, so that rows without a usable key can still be matched."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith(("map", "struct", "array")) else F.col(f"`{c}`") for c, t in df.dtypes], F.array(*[F.col(f"`{c}`").isNull() for c in df.columns]).cast("string"))


def hashed_below(key: Column, share: float, seed: int) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))


def maybe_in(rows: DataFrame, kept: DataFrame, key: str, pages: int = 1 << 18) -> DataFrame:
    """``rows`` whose long ``key`` may be in ``kept``: all that are, and few others.

    By a bitmap of ``pages`` longs, which bounds what is broadcast whatever the size of ``kept``.
    """
    hashed = F.xxhash64(key)
    page = F.pmod(F.shiftright(hashed, 6), F.lit(pages))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(63).cast("int"))
    bitmap = kept.groupBy(page.alias("_page")).agg(F.bit_or(bit).alias("_bits"))
    return rows.join(F.broadcast(bitmap), page == F.col("_page")).where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: ends the lineage, survives executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
