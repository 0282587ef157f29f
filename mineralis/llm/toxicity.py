"""Toxicity by logistic regression with FTRL-proximal updates over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate and an L1 threshold, so only features that carry evidence keep
a weight. The weights are one array of fixed size, whatever the corpus, and are broadcast to the scan
that scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WordHashes, grams, without

#: bound of the labelled sample the model is fitted on, and of the rows one shard learns from
MAX_ROWS, SHARD_ROWS = 32_768, 4_096
#: size of the weight array as a power of two: 2^20 weights of four bytes are the broadcast's bound
BITS = 20
#: places of the words of a feature: single words, pairs, pairs around one word, triples
SHAPES = ((0,), (0, 1), (0, 2), (0, 1, 2))
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 8.0, 1.0, 4
THRESHOLD = 0.7

_TOKEN = re.compile(r"[^\W_]+")


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Indices, with repetitions, of the features of a whole text; letters and digits in lower case."""
    words = hashes.of(_TOKEN.findall(text.lower())) if text else np.empty(0, np.uint64)
    shift = np.uint64(64 - bits)
    return np.concatenate([grams(words, shape) >> shift for shape in SHAPES]).astype(np.int64)


def fit_shard(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(weights, intercept) after ``EPOCHS`` passes over the rows in their order.

    ``z`` and ``n`` are the sums of FTRL-proximal. The intercept has no L1 term.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(idx: np.ndarray) -> np.ndarray:
        sign = np.sign(z[idx])
        l1 = np.where(idx == size, 0.0, L1)
        return np.where(np.abs(z[idx]) <= l1, 0.0, -(z[idx] - sign * l1) / ((BETA + np.sqrt(n[idx])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for idx, label in zip(rows, labels):
            w = weight(idx)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA
            z[idx] += g - step * w
            n[idx] += g * g
    w = weight(np.arange(size + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, max_rows: int = MAX_ROWS,
        shard_rows: int = SHARD_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_rows`` labelled documents: of those for which ``teaches`` (a test of
    ``doc_id``) holds, the ones whose ids have the smallest hashes.

    Ids are chosen first, so only the texts of the sample move. They are dealt to shards of about
    ``shard_rows``; each shard runs FTRL on its own and gives back its nonzero weights, and the model is
    their mean. The number of shards follows from the number of rows and is at most
    ``max_rows / shard_rows``.

    An id with several label rows counts as toxic if one says so; an id with several texts teaches the
    first of them in order. Rows without id, text or label teach nothing. With no rows, or one label
    only, no weight leaves zero and all scores are alike.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & teaches)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & teaches)
    both = texts.select("doc_id").distinct().join(marks, "doc_id").withColumn("order", F.xxhash64("doc_id"))
    chosen = cut_lineage(both.orderBy("order", "doc_id").limit(max_rows))
    n = chosen.count()
    if not n:
        return np.zeros(1 << bits, np.float32), 0.0
    shards = max(1, round(n / shard_rows))
    # at most max_rows rows of three numbers are sent to all
    sample = (texts.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
              .groupBy("doc_id", "order", "label").agg(F.min("text").alias("text")))
    seat = F.pmod("order", F.lit(shards)).cast("int").alias("shard")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id"])
        hashes = WordHashes()
        rows = [np.append(np.unique(features(t, hashes, bits)), 1 << bits) for t in part["text"]]
        w, intercept = fit_shard(rows, part["label"].to_numpy(float), bits)
        idx = np.flatnonzero(w)
        return pd.DataFrame({"idx": np.append(idx, 1 << bits), "weight": np.append(w[idx], intercept)})

    learned = sample.select("doc_id", "order", "text", "label", seat).groupBy("shard").applyInPandas(learn, "idx long, weight double")
    # at most 2^bits rows come back, far fewer under the L1 term
    mean = cut_lineage(learned.groupBy("idx").agg((F.sum("weight") / shards).alias("weight"))).toPandas()
    weights = np.zeros((1 << bits) + 1)
    weights[mean["idx"].to_numpy(int)] = mean["weight"].to_numpy()
    return weights[:-1].astype(np.float32), float(weights[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or above).

    The whole text counts, each feature once. Null or empty text: the score of the intercept. Rows are
    scored one by one; columns named ``score`` or ``predicted`` are replaced, others pass through.
    """
    weights, intercept = model
    bits = int(np.log2(len(weights)))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in batches:
            hashes, out = WordHashes(), np.empty(len(texts))
            for k, text in enumerate(texts):
                idx = features(text, hashes, bits)
                out[k] = w[np.unique(idx[w[idx] != 0])].sum(dtype=float)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out + intercept, -500, 500))))

    scored = without(docs, "score", "predicted").withColumn("score", score_of("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

