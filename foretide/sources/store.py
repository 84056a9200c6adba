"""Session tables: schemas, reads, upserts, updates, deletes, snapshots and projections."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretide.settings import CHECKPOINT_MILESTONES, COHORT, HORIZONS

L, D, B, X = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS = {
    "sessions": _schema(
        session_id=L, game=X, source_url=X, started_ms=L, ended_ms=L, status=X, canvas_width=L, canvas_height=L,
        overlay_expanded_initial=B, end_reason=X, recording_path=X, model_source=X, active_duration_ms=L, usable=B,
        quality_reason=X, collection_index=L, model_version=X, valid_frame_count=L, expected_frame_count=L, coverage=D,
    ),
    "predictions": _schema(
        session_id=L, ts_ms=L, status=X, active_ms=L, failure_probabilities=X, loss_window=X, certainty=X, remaining=D,
        low=D, high=D, displayed=X, model_source=X, calibrated=B, latency_ms=D,
    ),
    "overlay_events": _schema(session_id=L, ts_ms=L, expanded=B),
    "lifecycle_events": _schema(session_id=L, ts_ms=L, active_ms=L, state=X),
}

# Typed defaults of columns older session tables lack.
SESSION_DEFAULTS = {
    "status": "active", "active_duration_ms": 0, "usable": False, "valid_frame_count": 0, "expected_frame_count": 0,
    "coverage": 0.0, "overlay_expanded_initial": False, "model_source": "collection_only",
}


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its declared schema; parquet columns are matched by name."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def upgrade_schema(df: DataFrame, target: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Add the target's missing columns, cast the present ones, fill typed defaults.

    Columns the target does not know are kept.
    """
    defaults = defaults or {}
    empty = df.sparkSession.createDataFrame([], target)
    both = empty.unionByName(df, allowMissingColumns=True)
    cols = []
    for f in target.fields:
        c = F.col(f.name).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return both.select(*cols, *[c for c in df.columns if c not in target.fieldNames()])


def insert_sessions(base: DataFrame, new: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    filled = new
    for n, v in (defaults or SESSION_DEFAULTS).items():
        if n in base.columns and n not in new.columns:
            filled = filled.withColumn(n, F.lit(v))
    return base.unionByName(filled, allowMissingColumns=True)


def probability_json(m: Column, horizons=HORIZONS, digits: int = 5) -> Column:
    """Map of horizon to rounded probability as JSON with keys in text order."""
    order = sorted(range(len(horizons)), key=lambda i: str(horizons[i]))
    fields = [F.bround(F.element_at(m, i + 1), digits).alias(str(horizons[i])) for i in order]
    return F.to_json(F.struct(*fields))


def upsert_predictions(base: DataFrame, delta: DataFrame, ingest: str = "ingest_seq") -> DataFrame:
    """Last write per (session_id, ts_ms) wins; only ready predictions are stored.

    The latest row is a map-side combined maximum, not a sort of every key's history.
    """
    ready = delta.where(F.col("status") == "ready")
    both = base.unionByName(ready, allowMissingColumns=True)
    whole = F.struct(*[F.col(c) for c in both.columns])
    return both.groupBy("session_id", "ts_ms").agg(F.max_by(whole, F.col(ingest)).alias("_w")).select("_w.*")


FINISH_COLUMNS = (
    "ended_ms", "end_reason", "active_duration_ms", "usable", "quality_reason", "valid_frame_count",
    "expected_frame_count", "coverage",
)


def finish_sessions(base: DataFrame, finishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated sessions, finishes that match no session)."""
    f = finishes.select("session_id", F.struct(*FINISH_COLUMNS).alias("_f"))
    hit = F.col("_f").isNotNull()
    out = base.join(f, "session_id", "left")
    for c in FINISH_COLUMNS:
        out = out.withColumn(c, F.when(hit, F.col(f"_f.{c}")).otherwise(F.col(c)))
    out = out.withColumn("status", F.when(hit, "complete").otherwise(F.col("status"))).drop("_f")
    return out, finishes.join(base.select("session_id"), "session_id", "left_anti")


def append_events(base: DataFrame, new: DataFrame) -> DataFrame:
    return base.unionByName(new)


def set_recording(base: DataFrame, paths: DataFrame) -> DataFrame:
    p = paths.select("session_id", F.col("recording_path").alias("_p"))
    return base.join(p, "session_id", "left").withColumn("recording_path", F.coalesce("_p", "recording_path")).drop("_p")


def delete_sessions(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Sessions and all their children without the given ids."""
    gone = ids.select("session_id").distinct()
    return {n: t.join(gone, "session_id", "left_anti") for n, t in tables.items()}


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted ids; unknown ids give nothing."""
    return df.join(ids.select("session_id").distinct(), "session_id", "left_semi")


def filter_oversize(binaries: DataFrame, max_bytes: int = 250 * 1024 * 1024) -> DataFrame:
    """Uploads within the limit; a ``binaryFile`` scan answers this from file status alone."""
    return binaries.where(F.col("length") <= max_bytes)


def cohort_manifest(sessions: DataFrame, n: int, version: str = COHORT) -> DataFrame:
    """The first ``n`` usable sessions of a cohort by start."""
    pool = sessions.where(F.col("usable") & (F.col("model_version") == version))
    return pool.orderBy("started_ms", "session_id").limit(n)


def checkpoint_cohort(tables: dict[str, DataFrame], n: int, path: str) -> DataFrame | None:
    """Snapshot all tables of exactly ``n`` cohort sessions below ``path``; returns the manifest.

    Only milestones are taken; a finished snapshot is left alone.  The manifest is
    written last and is what marks completion.
    """
    if n not in CHECKPOINT_MILESTONES:
        return None
    spark = tables["sessions"].sparkSession
    target = f"{path}/run-{n:03d}"
    if _finished(spark, f"{target}/manifest"):
        return spark.read.parquet(f"{target}/manifest")
    manifest = cohort_manifest(tables["sessions"], n)
    found = manifest.count()
    if found != n:
        raise ValueError(f"expected {n} cohort sessions, found {found}")
    ids = manifest.select("session_id")
    for name, table in tables.items():
        table.join(ids, "session_id", "left_semi").write.mode("overwrite").parquet(f"{target}/{name}")
    manifest.withColumn("usable_runs", F.lit(n)).withColumn("cohort", F.lit(COHORT)).write.mode("overwrite").parquet(
        f"{target}/manifest"
    )
    return spark.read.parquet(f"{target}/manifest")


def _finished(spark: SparkSession, path: str) -> bool:
    """A folder that is missing, or holds no finished file yet, means "not there"; other errors are raised."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def list_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Completed snapshots: usable_runs, session_count, created_at."""
    return (
        spark.read.parquet(f"{path}/run-*/manifest")
        .select("usable_runs", "session_id", F.col("_metadata.file_modification_time").alias("_at"))
        .groupBy("usable_runs")
        .agg(F.count("*").alias("session_count"), F.max("_at").alias("created_at"))
    )


# --- projections ------------------------------------------------------------------
def session_view(df: DataFrame) -> DataFrame:
    """Public names; a recording exists when its path is not empty."""
    names = {
        "session_id": "id", "game": "game", "source_url": "sourceUrl", "started_ms": "startedMs", "ended_ms": "endedMs",
        "status": "status", "canvas_width": "canvasWidth", "canvas_height": "canvasHeight", "end_reason": "endReason",
        "model_source": "modelSource", "active_duration_ms": "activeDurationMs", "quality_reason": "qualityReason",
        "collection_index": "collectionIndex", "model_version": "modelVersion", "valid_frame_count": "validFrameCount",
        "expected_frame_count": "expectedFrameCount", "coverage": "captureCoverage",
    }
    cols = [F.col(a).alias(b) for a, b in names.items() if a in df.columns]
    flags = {"overlay_expanded_initial": "overlayExpandedInitial", "usable": "usableForTraining"}
    cols += [F.coalesce(F.col(a).cast("boolean"), F.lit(False)).alias(b) for a, b in flags.items() if a in df.columns]
    if "recording_path" in df.columns:
        cols.append(F.coalesce(F.length("recording_path") > 0, F.lit(False)).alias("hasRecording"))
    return df.select(*cols)


def prediction_view(df: DataFrame) -> DataFrame:
    """JSON text becomes a map; missing text an empty one."""
    parsed = F.from_json("failure_probabilities", T.MapType(X, D))
    return df.withColumn("failure_probabilities", F.coalesce(parsed, F.expr("cast(map() as map<string,double>)")))


