"""Fixed values shared by the operators.

Every one of them is only the default of an operator argument, so the same
operator runs on any entity/time table.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Forecast horizons (seconds) and cohort policy.
HORIZONS = (5, 10, 15, 20, 30, 45, 60)
TARGET_RUNS = 40
DEVELOPMENT_RUNS = 30
FIT_RUNS = 24
LOCKED_TEST_RUNS = 10
CHECKPOINT_MILESTONES = (20, 30, 40)
TRAINING_MILESTONES = (20, 25, 30, 40)
FOLDS = ((9, 15, 20), (14, 20, 25), (19, 25, 30))

# History rule (milliseconds of active time, rows).
CONTEXT_MS = 8_000
MIN_ROWS = 28
MIN_SPAN_MS = 7_500
SEQUENCE_LENGTH = 32

# Cohort names and model kinds.
COHORT = "collection-v3"
LEGACY = "legacy-v2"
KNOWN_KINDS = ("sklearn_personal_survival", "torchscript_personal_survival")


def prepare_session(spark: SparkSession) -> SparkSession:
    """The one session option every plan relies on; everything else stays with the caller."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where a local master names none (tests) a fresh folder is made, and remembered
    in the session so that later calls agree.  On a cluster every executor would write to
    a folder of its own, so there a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        folder = spark.conf.get("foretide.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("foretide.shared.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and continue from the table.

    For results that several branches of one plan read: the branches then share the
    work, the plan stays small, and a lost executor costs a re-read.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
