"""Operator 10: quality by supervised subword embeddings.

Words, pairs of words and runs of three and four characters within a word (its ends marked) are hashed to
BUCKETS vectors. A text is the mean of the vectors of its features; a softmax over two classes gives
the probability of good quality. Vectors and output are learned together in numpy by stochastic
gradient descent on the cross-entropy, on at most TRAIN_ROWS labelled rows of each class, those of
the least hash, however often rows are repeated. Classes count the same in training. Features are
counted on the executors: at most BUCKETS numbers a row come to the driver, whatever the length of texts.

Every row of documents is scored. As the output is linear in the mean, the learned vectors are
multiplied by the output once, and scoring a text is a mean of one number for each feature.

A text that is null, empty or blank has no feature: p_good is null and good is false. A row without a
label is scored like the others. Labels other than 0 and 1 are not trained on, nor are those of a
null doc_id. Without labelled rows of both classes nothing can be learned, and p_good is 0.5 and good
true for every text with a feature, as is a text of exactly LEAST. Very long texts are read whole, a
text at a time; an empty table gives an empty result. Repeated rows are scored alike; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear_text import bounded_bags, char_grams, mean_scores, word_grams

#: Most labelled rows of each class that the classifier is trained on.
TRAIN_ROWS = 2500
BITS, DIM, EPOCHS, BATCH, RATE, SEED = 14, 16, 12, 16, 20.0, 11
BUCKETS = 1 << BITS
#: A text is good from this probability on.
LEAST = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [*word_grams(data, offsets, BITS), *(char_grams(data, offsets, n, BITS) for n in (3, 4))]


def gradients(x: np.ndarray, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the weighted mean cross-entropy of rows x (shares of features) by vectors, output and bias."""
    hidden = x @ vectors
    logits = hidden @ out + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= weight[:, None] / len(y)
    return x.T @ (p @ out.T), hidden.T @ p, p.sum(0)


def train_embeddings(index: list[np.ndarray], share: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """A number for each bucket, and a bias: the log-odds of class 1 are the mean of a text's numbers plus the bias."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    classes = np.bincount(y, minlength=2)
    if classes.min() == 0:
        return np.zeros(BUCKETS), 0.0
    weight = (len(y) / 2 / classes)[y].astype(np.float32)
    steps = EPOCHS * -(-len(y) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            rows = order[a : a + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            used, back = np.unique(np.concatenate([index[r] for r in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            x[np.repeat(np.arange(len(rows)), [len(index[r]) for r in rows]), back] = np.concatenate([share[r] for r in rows])
            of_vectors, of_out, of_bias = gradients(x, vectors[used], out, bias, y[rows], weight[rows])
            out -= rate * 0.1 * of_out
            bias -= rate * 0.01 * of_bias
            vectors[used] -= rate * of_vectors
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes, index, share = bounded_bags(texts, marked, ["doc_id"], "quality", rows, features, BUCKETS)
    return train_embeddings(index, share, classes.astype(np.int64))


def _score(numbers: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, mean, count in mean_scores(batch.column("text"), features, numbers[:, None]):
                p = 1 / (1 + np.exp(-np.clip(mean[:, 0] + bias, -500, 500)))
                blank = np.array([not (t.as_py() or "").strip() for t in batch.column("text").slice(a, b - a)], bool)
                none = blank | (count == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(p, mask=none), pa.array((p >= LEAST) & ~none)], names=["doc_id", "p_good", "good"])

    return run


def scored(docs: DataFrame, numbers: np.ndarray, bias: float) -> DataFrame:
    """doc_id, p_good and good for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(numbers, bias), "doc_id long, p_good double, good boolean")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
