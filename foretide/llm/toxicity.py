"""Toxicity by non-negative positive-unlabelled learning.

A text's features are hashes of its words and of their first bytes (stems).  Those that
are far more frequent in confirmed toxic texts than in unlabelled ones enter a linear
model, which numpy fits with the non-negative estimator of the classification risk:

    R(f) = prior * R+(f on P) + max(0, R-(f on U) - prior * R-(f on P))

Unlabelled texts are a sample of the rows one may learn from, their labels not looked at; the prior
is the share of toxic rows among the same rows.  The two must be of one population: where labels do not
cover the corpus evenly, the prior is wrong for unlabelled texts from elsewhere, and clean texts are flagged.

Fitting reads a bounded sample (``max_positive`` + ``max_unlabelled`` texts); feature
statistics are counted on the executors, and the driver sees the selected features only.
Scoring is one pass of a pandas UDF over the text column, without a shuffle.

Nulls and texts without words have no features and get the score of such a text.  A null
or repeated doc_id is scored like any other row and never learnt from.  Repeated texts
count once in fitting.  With no labelled rows the score is the prior ``empty_prior`` for
every row.  An input column called ``score`` or ``predicted`` is replaced.
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

STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights and the bias; the bounded sample bounds their number."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.features):
            seen: dict[int, set[int]] = {}
            for held, who, hashes in features(texts):
                at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
                hit = self.features[at] == hashes
                for doc, j in set(zip(who[hit].tolist(), at[hit].tolist(), strict=True)):
                    seen.setdefault(held[doc], set()).add(j)
            for i, js in seen.items():
                total[i] += self.weights[list(js)].sum()
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def features(texts) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Per block: the texts in it, and (text within the block, feature hash) pairs."""
    for held, raw in B.grouped(texts):
        data = B.LOWER[raw]
        starts, ends = B.runs(B.LETTER[data])
        who = np.zeros(len(starts), dtype=np.int64)
        if len(held) > 1:
            # Texts are joined by newlines but also contain them; their own ends are recounted here.
            sizes = np.fromiter((len((texts[i] or "").encode("utf-8", "surrogatepass")) + 1 for i in held), np.int64, len(held))
            who = np.searchsorted(np.cumsum(sizes), starts, side="right")
        hasher = B.Hasher(data)
        docs, hashes = [who], [hasher.spans(starts, ends)]
        for k in STEMS:
            long = ends - starts > k
            docs.append(who[long])
            hashes.append(B.mix(hasher.spans(starts[long], starts[long] + k) + np.uint64(k)))
        yield held, np.concatenate(docs), np.concatenate(hashes)


def _unique(texts) -> Iterator[tuple[int, np.ndarray]]:
    """(position, distinct feature hashes) of each text; the parts of a long text are merged."""
    parts: dict[int, list[np.ndarray]] = {}
    for held, who, hashes in features(texts):
        order = np.argsort(who, kind="stable")
        cuts = np.searchsorted(who[order], np.arange(1, len(held)))
        for i, h in zip(held, np.split(hashes[order], cuts), strict=True):
            parts.setdefault(i, []).append(np.unique(h))
    for i, hs in parts.items():
        yield i, hs[0] if len(hs) == 1 else np.unique(np.concatenate(hs))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of each class that hold a feature, combined per batch."""
    for batch in batches:
        pos, unl = batch["positive"].to_numpy(), batch["unlabelled"].to_numpy()
        found = list(_unique(batch["text"].tolist()))
        if not found:
            continue
        hashes = np.concatenate([h for _, h in found])
        reps = [len(h) for _, h in found]
        p = np.repeat([pos[i] for i, _ in found], reps)
        u = np.repeat([unl[i] for i, _ in found], reps)
        keys, at = np.unique(hashes, return_inverse=True)
        yield pd.DataFrame(
            {
                "feature": keys.view(np.int64),
                "p": np.bincount(at, p, len(keys)).astype(np.int64),
                "u": np.bincount(at, u, len(keys)).astype(np.int64),
            }
        )


def _surprise(p, n_p, u, n_u):
    """Log-likelihood ratio of a feature's share in P and in U (a column expression)."""
    q = n_p / (n_p + n_u)
    seen = p + u

    def part(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))

    return F.lit(2.0) * (part(p, seen * q) + part(u, seen * (1 - q)))


def nnpu_fit(
    rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, n_features: int, prior: float,
    steps: int = 400, rate: float = 0.1, decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model over binary features (row, column) pairs.

    Logistic loss, Adam steps on all rows.  Where the bracket of the risk turns negative
    its gradient is reversed, which undoes the over-fit instead of rewarding it.
    """
    n = len(positive)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], n)
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        softplus = np.logaddexp(0, z)
        bracket = (softplus * unlabelled).sum() / n_u - prior * (softplus * positive).sum() / n_p
        g_minus = s * (unlabelled / n_u - prior * positive / n_p)
        g = -g_minus if bracket < 0 else prior * (s - 1) * positive / n_p + g_minus
        grad = np.append(np.bincount(cols, g[rows], n_features) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(
    docs: DataFrame, labels: DataFrame, max_positive: int = 4_000, max_unlabelled: int = 8_000,
    least_surprise: float = 8.0, empty_prior: float = 0.1, seed: int = 11,
) -> Model:
    """Learn from the rows of ``labels`` (doc_id, toxic); ``docs`` has doc_id and text.

    ``labels`` holds only rows one may learn from.  About ``max_positive`` toxic texts and
    ``max_unlabelled`` texts of the labelled documents, their labels put aside, are read.
    Every feature that passes the two tests of its counts is kept.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n, n_pos = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not n_pos:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(empty_prior / (1 - empty_prior))))
    prior = min(max(n_pos / n, 1e-3), 0.999)
    chosen = known.select(
        "doc_id",
        ((F.col("toxic") == 1) & hashed_below(F.col("doc_id"), max_positive / n_pos, seed)).alias("positive"),
        hashed_below(F.col("doc_id"), max_unlabelled / n, seed + 1).alias("unlabelled"),
    ).where("positive or unlabelled")
    # The sample is bounded by the two parameters, so its keys may be broadcast.
    sample = cut(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy(F.sha2("text", 256).alias("_same"))
        .agg(F.min("text").alias("text"), F.max("positive").cast("int").alias("positive"), F.max("unlabelled").cast("int").alias("unlabelled"))
        .drop("_same")
    )
    n_p, n_u = sample.agg(F.sum("positive"), F.sum("unlabelled")).first()
    if not n_p or not n_u:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    counts = sample.mapInPandas(_count, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    surprise = _surprise(F.col("p").cast("double"), float(n_p), F.col("u").cast("double"), float(n_u))
    picked = (
        # By the prior, at least half of the texts with the feature are toxic.
        counts.where(F.col("p") * F.lit(prior * n_u) >= F.lit(0.5) * F.col("u") * F.lit(float(n_p)))
        .withColumn("s", surprise)
        .where(F.col("s") >= least_surprise)
        .select("feature")
        .toPandas()["feature"]
        .to_numpy(np.int64)
        .view(np.uint64)
    )
    chosen_features = np.sort(picked)
    width = len(chosen_features)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {i: np.flatnonzero(np.isin(chosen_features, h)).tolist() for i, h in _unique(batch["text"].tolist())}
            yield pd.DataFrame(
                {"positive": batch["positive"], "unlabelled": batch["unlabelled"], "hits": [found.get(i, []) for i in range(len(batch))]}
            )

    table = sample.mapInPandas(hits, "positive int, unlabelled int, hits array<int>").toPandas()
    rows = np.repeat(np.arange(len(table)), table["hits"].map(len))
    cols = np.concatenate([np.zeros(0, np.int64), *[np.asarray(h, np.int64) for h in table["hits"]]]).astype(np.int64)
    order = np.lexsort((cols, rows))
    w, b = nnpu_fit(rows[order], cols[order], table["positive"].to_numpy(float), table["unlabelled"].to_numpy(float), width, prior)
    return Model(chosen_features, w, b)


def scored(text: Column, model: Model) -> Column:
    """Scores of a text column."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()))

    return scores(text)


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs``, all columns as they are, without the rows scored ``threshold`` or more."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), scored(F.col("text"), model).alias("_score")).where(F.col("_score") < threshold).select("_row.*")


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    out = docs.withColumn("score", scored(F.col("text"), model))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
