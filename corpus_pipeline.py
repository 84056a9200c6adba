"""A training corpus from raw documents: filter, dedupe, decontaminate, mix, shard.

Defined results of every stage: a null text counts as an empty one and a null doc_id, lang or source as a value
of its own; such rows are judged like others, and all empty texts are copies of one another, so one of them
stays.  Very long texts are judged whole.  Of repeated rows, and of ties between near copies, one row stays, the one
with the smallest doc_id; in the mix, rows equal in doc_id and text share one place in the order.  Extra columns are
carried along whatever their names.  An empty table gives an empty table of the same columns, the last stage's added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foretide.llm import decontaminate, mixing, sharding, simhash, toxicity
from foretide.llm.common import fold, table
from foretide.settings import fresh_path

#: Toxicity, fingerprints and shares have no SQL form; tests/llm checks the stages one by one.
ORACLE_SQL = None
SHARDS, WEIGHTS = 24, [5, 2, 1]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored 0.3 or more for toxicity."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item or most of one."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target shares."""
    return mixing.mixed_documents(docs, WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their virtual slot and the shard that the balanced slot map gives it."""
    keys = ["doc_id", "text"]
    return sharding.place(docs, sharding.plan(docs, SHARDS, keys).read(2), keys)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
