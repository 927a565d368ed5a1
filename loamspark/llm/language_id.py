"""Operator 9: language by hierarchical discrimination.

First the family is predicted, then the language within it. Both steps are one-versus-one linear
support vector machines: one for each pair of families, one for each pair of languages of a family,
which vote (the sum of margins decides ties). Features are hashed runs of one, two and three
lower-case bytes, as shares of the text's; so a margin is a mean of weights over the whole text and
is computed without building its feature vector.

The machines are trained in numpy by averaged subgradient descent on the hinge loss (Pegasos) on at
most TRAIN_ROWS labelled rows of each language, those of the least hash; all rows are predicted.

A text that is null, empty or blank has family and language null and margin 0, and so has every text
if no row is labelled with a known language. With a single family or language there is nothing to
tell apart, and it is predicted. Very long texts are read whole, a text at a time; an empty table gives
an empty result; of names with equal votes and margins the first by name wins. Unknown or null languages are not trained on, but predicted like
the others. A null doc_id is carried as null; repeated rows are predicted alike, and in
training each counts, up to the bound; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear_text import bounded_bags, byte_grams, dense, mean_scores
from .simhash_dedup import lowered

FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "pl", "ru", "sk", "uk"),
    "uralic": ("et", "fi", "hu"),
}
#: Most labelled rows of each language that the machines are trained on.
TRAIN_ROWS = 800
BITS, EPOCHS, LAMBDA, SCALE, SEED = 12, 40, 1e-4, 30.0, 3


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    low = lowered(data)
    return [byte_grams(low, offsets, n, BITS) for n in (1, 2, 3)]


def train_svm(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weights and, at the end, the bias of a linear support vector machine; y is 1 or -1."""
    x = np.hstack([x * SCALE, np.ones((len(x), 1), np.float32)])
    share = {s: 0.5 / max(1, (y == s).sum()) for s in (1, -1)}  # both sides weigh the same
    weight = np.where(y == 1, share[1], share[-1]) * len(y)
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 32):
            t += 1
            rows = order[a : a + 32]
            wrong = rows[y[rows] * (x[rows] @ w) < 1]
            step = 1 / (LAMBDA * (t + 1000))
            w *= 1 - step * LAMBDA
            if len(wrong):
                w += step / len(rows) * ((weight[wrong] * y[wrong]) @ x[wrong])
            if epoch >= EPOCHS // 2:
                mean += w
    mean /= max(1, np.linalg.norm(mean))
    mean[:-1] *= SCALE
    return mean


class Model:
    """Machines for pairs: (level, one, other); level is '' for families, else a family."""

    def __init__(self, index: list[np.ndarray], share: list[np.ndarray], langs: np.ndarray):
        x = dense(index, share, 1 << BITS)
        rng = np.random.default_rng(SEED)
        family = {lang: f for f, of in FAMILIES.items() for lang in of}
        known = sorted(set(langs.tolist()) & set(family))
        self.members = {f: [lang for lang in of if lang in known] for f, of in FAMILIES.items() if set(of) & set(known)}
        of_row = np.array([family.get(lang, "") for lang in langs.tolist()], dtype=object)
        self.pairs: list[tuple[str, str, str]] = []
        machines = []
        for level, names, values in [("", sorted(self.members), of_row), *((f, m, langs) for f, m in self.members.items())]:
            for one, other in combinations(names, 2):
                rows = np.flatnonzero((values == one) | (values == other))
                machines.append(train_svm(x[rows], np.where(values[rows] == one, 1, -1), rng))
                self.pairs.append((level, one, other))
        self.weights = np.array([m[:-1] for m in machines]).T.astype(np.float64) if machines else np.zeros((1 << BITS, 0))
        self.bias = np.array([m[-1] for m in machines])

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in names of each row's winner, and its least margin over the others."""
        n = len(margins)
        score, least = np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
        for k, (at, one, other) in enumerate(self.pairs):
            if at == level:
                m = margins[:, k]
                for name, sign in ((one, 1), (other, -1)):
                    j = names.index(name)
                    score[:, j] += (sign * m > 0) + np.tanh(sign * m) * 1e-3
                    least[:, j] = np.minimum(least[:, j], sign * m)
        best = score.argmax(1)
        return best, np.where(np.isinf(least[np.arange(n), best]), 0, least[np.arange(n), best])

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = sorted(self.members)
        family, lang, sure = (np.full(len(margins), None, object) for _ in range(3))
        sure[:] = 0.0
        if names:
            best, margin = self._vote("", names, margins)
            for j, f in enumerate(names):
                rows = np.flatnonzero(best == j)
                family[rows] = f
                at, inner = self._vote(f, self.members[f], margins[rows])
                lang[rows] = np.array(self.members[f], dtype=object)[at]
                sure[rows] = np.where(len(self.members[f]) > 1, inner, margin[rows])
        return family, lang, sure


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("lang").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("lang").isin([x for of in FAMILIES.values() for x in of]))
    langs, index, share = bounded_bags(known, known.select("doc_id", "lang"), ["doc_id", "lang"], "lang", rows, features, 1 << BITS)
    return Model(index, share, langs)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, mean, _ in mean_scores(batch.column("text"), features, model.weights):
                family, lang, sure = model.predict(mean + model.bias)
                blank = np.array([not (t.as_py() or "").strip() for t in batch.column("text").slice(a, b - a)], bool)
                family[blank], lang[blank], sure[blank] = None, None, 0.0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(sure.astype(np.float64))], names=["doc_id", "family", "predicted", "margin"])

    return run


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, family, predicted and margin for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predict(model), "doc_id long, family string, predicted string, margin double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return languages(docs, train(docs))
