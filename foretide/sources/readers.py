"""Readers for observations, documents, frames, windows, caches and evaluations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("timestampMs", T.LongType()),
        T.StructField("activeElapsedMs", T.LongType()),
        T.StructField("observedMotion", T.DoubleType()),
    ]
)
_BAD = "_bad_line"


def read_observations(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """JSON-lines observations; blank lines are skipped, a missing path is empty.

    Strict reading fails on a bad line, tolerant reading skips it.  The active clock
    of old recordings is missing and falls back to the time since the first row.
    """
    reader = spark.read.schema(OBSERVATION if not tolerant else T.StructType([*OBSERVATION.fields, T.StructField(_BAD, T.StringType())]))
    try:
        if tolerant:
            raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)
            raw = raw.where(F.col(_BAD).isNull() & F.col("timestampMs").isNotNull()).drop(_BAD)
        else:
            raw = reader.option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], OBSERVATION)
    first = raw.groupBy("session_id").agg(F.min("timestampMs").alias("_first"))
    return raw.join(first, "session_id").select(
        "session_id",
        F.col("timestampMs").alias("ts_ms"),
        F.coalesce("activeElapsedMs", F.col("timestampMs") - F.col("_first")).alias("active_ms"),
        F.coalesce("observedMotion", F.lit(0.0)).alias("motion"),
    )


def parse_document(text: Column) -> Column:
    """JSON objects as text; anything unreadable or not an object is null."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed))


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """Small JSON documents: (path, document)."""
    files = spark.read.text(glob, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), parse_document(F.col("value")).alias("document"))


def frame_key(path: Column) -> Column:
    """Timestamp from ``…/<timestamp>.<jpg|png>``."""
    return F.nullif(F.regexp_extract(path, r"(\d+)\.(?:jpg|jpeg|png)$", 1), F.lit("")).cast("long")


def session_key(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"([^/]+)/frames/[^/]+$", 1), F.lit(""))


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images below ``root/<session>/frames`` with their keys; undecodable files are dropped."""
    images = spark.read.format("image").option("dropInvalid", True).load(f"{root}/*/frames")
    return images.select(
        session_key(F.col("image.origin")).alias("session_id"), frame_key(F.col("image.origin")).alias("frame"), "image"
    ).where("frame is not null")


def list_uploads(spark: SparkSession, glob: str) -> DataFrame:
    """Names and sizes of binary uploads; contents are not read."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime")


def run_extractor(
    frames: DataFrame, extractor: Callable[[DataFrame], DataFrame], columns: dict[str, str], schema_version: str, code_hash: str
) -> DataFrame:
    """A plug-in's features with the version stamp that cached frames are checked against.

    The plug-in must return exactly the promised columns and types.
    """
    out = extractor(frames)
    got = dict(out.dtypes)
    if got != columns:
        raise ValueError(f"extractor returns {got}, promised {columns}")
    return out.withColumn("schema_version", F.lit(schema_version)).withColumn("code_hash", F.lit(code_hash))


def decode_data_urls(df: DataFrame, column: str, max_bytes: int = 500_000, header: str = "data:image/jpeg;base64") -> DataFrame:
    """Adds ``payload`` (bytes, null when refused) and ``reject_reason``."""
    u = F.col(column)
    body = F.substring_index(u, ",", -1)
    strict = body.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    payload = F.try_to_binary(F.when(strict, body), F.lit("base64"))
    reason = (
        F.when(F.instr(u, ",") == 0, "missing_separator")
        .when(F.substring_index(u, ",", 1) != header, "unsupported_header")
        .when(payload.isNull(), "invalid_base64")
        .when(F.octet_length(payload) > max_bytes, "too_large")
    )
    reason = F.when(u.isNull(), "missing_separator").otherwise(reason)
    return df.withColumn("reject_reason", reason).withColumn("payload", F.when(F.col("reject_reason").isNull(), payload))


def read_instrumented(spark: SparkSession, root: str) -> DataFrame:
    """Instrumented runs ``root/run_id=…``: metadata left-joined with telemetry spans and the complete marker."""
    meta = spark.read.schema("run_id long, automated boolean, startedAt string, policy string").json(f"{root}/metadata")
    telemetry = spark.read.schema("run_id long, timestampMs long").json(f"{root}/telemetry")
    done = spark.read.schema("run_id long").json(f"{root}/complete").select("run_id", F.lit(True).alias("_done")).distinct()
    spans = telemetry.groupBy("run_id").agg(F.count("*").alias("frames"), (F.max("timestampMs") - F.min("timestampMs")).alias("duration_ms"))
    return meta.join(spans, "run_id", "left").join(done, "run_id", "left").select(
        "run_id", F.coalesce("automated", F.lit(False)).alias("automated"), F.coalesce("_done", F.lit(False)).alias("complete"),
        F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), "startedAt", "policy",
    )


def load_windows(spark: SparkSession, path: str, columns: Sequence[str], max_run: int = 30) -> DataFrame:
    """Window rows of the development cohort; projection and cohort filter reach the scan."""
    return spark.read.parquet(path).where(F.col("run_order") <= max_run).select(*columns)


def load_frame_cache(spark: SparkSession, path: str, schema: str, code_hash: str) -> DataFrame:
    """Cached frames; a stale schema or extractor hash anywhere raises when the rows are read."""
    cache = spark.read.parquet(path)
    fresh = (F.col("schema_version") == schema) & (F.col("code_hash") == code_hash)
    guard = F.when(F.coalesce(fresh, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("stale cache")).cast("boolean"))
    return cache.where(guard)


def read_evaluations(spark: SparkSession, glob: str) -> DataFrame:
    """Evaluation documents with defaults and modification time."""
    schema = "model string, split string, eligibleForLive boolean, metrics map<string,double>, gates map<string,boolean>"
    raw = spark.read.schema(schema).option("multiLine", True).json(glob)
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)\.json", 1)
    return raw.select(
        stem.alias("id"), F.coalesce("model", stem).alias("model"), "split", F.coalesce("eligibleForLive", F.lit(False)).alias("eligible"),
        F.coalesce("metrics", F.expr("cast(map() as map<string,double>)")).alias("metrics"),
        F.coalesce("gates", F.expr("cast(map() as map<string,boolean>)")).alias("gates"),
        F.unix_millis(F.col("_metadata.file_modification_time")).alias("updated_ms"),
    )


def write_windows(df: DataFrame, path: str, summary: DataFrame) -> None:
    """Windows partitioned by run, and their one-row summary as JSON."""
    df.write.mode("errorifexists").partitionBy("run_order").parquet(f"{path}/windows")
    summary.write.mode("errorifexists").json(f"{path}/summary")


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
