import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) tuples."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}x{i % 31}." for i in range(150_000))
    return make(
        [
            (1, "plain words of a short text that says a little more than nothing at all today", "a"),
            (1, "plain words of a short text that says a little more than nothing at all today", "a"),
            (None, "no number here, only words", "a"),
            (None, None, None),
            (2, "", "b"),
            (3, None, "b"),
            (4, " \n\t ", None),
            (5, long, "b"),
            (6, "é\x0bñ \U0001f600 x y\x1cz", "b"),
        ]
    )


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like results and helpers."""
    from pyspark.sql import functions as F

    out = odd
    for name in ("score", "predicted", "shard", "slot", "vslot", "bucket", "h", "_row", "_key", "fp", "removed", "source_size", "size"):
        out = out.withColumn(name, F.lit("mine"))
    return out


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 1), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(make):
    return make([])
