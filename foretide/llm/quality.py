"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Tokens are runs of letters (lower-cased), of digits and of symbols; a token equal to the one
before is replaced by a mark for "the same again", so stuttering texts share features.
Runs of one to ``NGRAM`` tokens are hashed into 2**bits weights.  A text is the unit vector of
its n-gram counts; its score is the logistic function of a sparse dot product.

Training is follow-the-regularised-leader with per-coordinate rates and an L1 term: one
task streams a bounded sample (``max_rows`` labelled texts) and keeps two arrays of 2**bits
numbers; what comes back are the weights that are not zero.  The sample is chosen by
hash, its keys are broadcast, and no text but the sample's is moved.  Scoring is one pass
of a pandas UDF, without a shuffle.

Nulls and texts without tokens have no features and get the score of the bias.  Null or
repeated doc_ids are scored like others and never learnt from.  Equal texts count once in
training.  Without labelled rows every score is 0.5.  Input columns called ``score`` or
``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretide.llm import bytesets as B
from foretide.llm.common import cut, hashed_below

NGRAM = 3
_DIGIT = B.lookup(range(48, 58))
_SYMBOL = ~(B.SPACE | B.LETTER | _DIGIT)
_AGAIN = np.uint64(1)


def tokens(text: str | None) -> np.ndarray:
    """Token codes of a whole text."""
    out = [np.zeros(0, np.uint64)]
    for block in B.blocks(text):
        data = B.LOWER[block]
        spans = [B.runs(kind[data]) for kind in (B.LETTER, _DIGIT, _SYMBOL)]
        starts = np.concatenate([s for s, _ in spans])
        order = np.argsort(starts, kind="stable")
        ends = np.concatenate([e for _, e in spans])
        out.append(B.Hasher(data).spans(starts[order], ends[order]))
    codes = np.concatenate(out)
    again = np.flatnonzero(codes[1:] == codes[:-1]) + 1
    codes[again] = _AGAIN
    return codes


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's unit vector."""
    codes = tokens(text)
    found = [B.mix(B.grams(codes, n) + np.uint64(n)) for n in range(1, NGRAM + 1)]
    index, count = np.unique(np.concatenate(found) & np.uint64((1 << bits) - 1), return_counts=True)
    value = np.sqrt(count)
    return index.astype(np.int64), value / max(1.0, np.sqrt((value * value).sum()))


@dataclass(frozen=True)
class Model:
    """At most 2**bits weights and a bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


def train(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], bits: int, updates: int, alpha: float, beta: float, l1: float, l2: float) -> Model:
    """FTRL-proximal over (indices, values, label) rows, in their order, again and again for about ``updates`` updates."""
    data = list(rows)
    epochs = max(3, -(-updates // max(1, len(data))))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits  # the last coordinate

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(i == bias, 0.0, l1), 0.0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for index, value, label in data:
            i, x = np.append(index, bias), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    touched = np.flatnonzero(n[:-1])
    w = weights(touched)
    return Model(touched[w != 0], w[w != 0].astype(np.float32), float(weights(np.array([bias]))[0]), bits)


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, bits: int = 20, updates: int = 30_000, alpha: float = 2.0, beta: float = 1.0,
    l1: float = 0.2, l2: float = 0.1, seed: int = 23,
) -> Model:
    """Learn from the rows of ``labels`` (doc_id, quality), at most about ``max_rows`` of them."""
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    total = known.count()
    empty = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, bits)
    if not total:
        return empty
    # Bounded by max_rows, so the keys may be broadcast.
    chosen = known.where(hashed_below(F.col("doc_id"), max_rows / total, seed))
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.sha2("text", 256).alias("_same")).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t, bits) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "same": batch["_same"],
                    "label": batch["label"],
                    "index": [i.astype(np.int32) for i, _ in found],
                    "value": [v.astype(np.float32) for _, v in found],
                }
            )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                yield from zip(batch["index"], batch["value"], batch["label"], strict=True)

        model = train(rows(), bits, updates, alpha, beta, l1, l2)
        yield pd.DataFrame({"index": np.append(model.index, -1), "weight": np.append(model.weight.astype(float), model.bias)})

    rows = cut(sample.mapInPandas(extract, "same string, label int, index array<int>, value array<float>"))
    # One task streams the bounded sample, in the order of the texts' hashes.
    learnt = rows.coalesce(1).sortWithinPartitions("same").mapInPandas(learn, "index long, weight double").toPandas()
    found = learnt[learnt["index"] >= 0].sort_values("index")
    return Model(found["index"].to_numpy(), found["weight"].to_numpy(np.float32), float(learnt["weight"][learnt["index"] < 0].iloc[0]), bits)


def scored(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = model.dense()
        for texts in batches:
            totals = []
            for text in texts.tolist():
                index, value = features(text, model.bits)
                totals.append(model.bias + float(weights[index] @ value))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(totals, float), -35, 35))))

    return scores(text)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    out = docs.withColumn("score", scored(F.col("text"), model))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
