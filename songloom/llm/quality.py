"""Quality classifier learned from positive and unlabelled texts.

A linear model is fitted by the non-negative unbiased risk: with the class prior p, the risk of
calling unlabelled texts bad is corrected by p times that of the trusted positives, and when the
corrected part falls below zero the step is taken back. The prior is estimated from the labels.
Fitting takes at most ``MOST_POSITIVE`` trusted and ``MOST_UNLABELLED`` other texts, chosen by a
hash of the id; every text is then scored as a whole, on the executors.

Features: shares of hashed n-grams of bytes and of their shapes, and a few properties of the
text (how many words differ, repeat the one before, are long; capitals, marks, lines).

Defined results: a missing text is an empty one, and gets a score like any other; without
trusted positives every score is the prior; a missing label is not learned from; repeated rows
are answered each; an empty table gives an empty result. Other columns are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songloom.llm.features import Grams, add_columns, frequencies, products, raw, shape
from songloom.llm.words import SPACED, blocks, find_words

MOST_POSITIVE = 3_000
MOST_UNLABELLED = 4_000
GOOD = 0.7
# Where nothing is labelled.
DEFAULT_PRIOR = 0.5
TABLES = (Grams(raw, 3, 4096), Grams(shape, 3, 1024))
STEPS = 1500
BATCH = 256
RATE = 0.02
DECAY = 3e-3
# How much of a step is taken back where the corrected risk is negative.
BACK = -0.2


def properties(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of properties for each text of a run."""
    words = find_words(data, bounds, SPACED, lower=True)
    hashes, at = words.hashes(), words.bounds
    n, size = np.diff(at), np.diff(bounds)
    distinct = np.array([len(np.unique(hashes[a:z])) for a, z in zip(at[:-1], at[1:], strict=True)])
    again = np.zeros(len(hashes) + 1)
    again[1:] = np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]])) if len(hashes) else again[1:]
    first = np.minimum(at[:-1] + 1, at[1:])

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, 1)

    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) | (data >= 0x80)
    return np.column_stack([
        distinct / np.maximum(n, 1), (distinct / np.maximum(n, 1)) * np.log1p(n), np.log1p(n),
        (again[at[1:]] - again[first]) / np.maximum(n, 1), size / np.maximum(n, 1),
        share((data >= 0x41) & (data <= 0x5A)), share(~letter & (data > 0x20)), share((data >= 0x30) & (data <= 0x39)),
        share(data == 0x0A), share(data == 0x20)])


def _bent(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1)


@dataclass
class Model:
    prior: float
    grams: np.ndarray
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    spread: np.ndarray

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = products(data, bounds, TABLES, self.grams[:, None])[:, 0]
        z = z + _bent((properties(data, bounds) - self.mean) / self.spread) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def class_prior(labels: DataFrame, label_col: str = "quality") -> float:
    """Share of good texts, as the labels have it."""
    return labels.agg(F.avg(F.col(label_col).cast("double"))).first()[0]


def _sample(documents: DataFrame, ids: DataFrame, most: int, id_col: str, text_col: str) -> list[str]:
    """The texts of at most ``most`` of the ids; texts stay where they are, the ids chosen are sent to them."""
    keys = ids.select(F.xxhash64(id_col).alias("key")).distinct().orderBy("key").limit(most)
    rows = documents.select(F.xxhash64(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"])
    return sorted(r["text"] for r in found.select("text").toLocalIterator())


def training_texts(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality") -> tuple[list[str], list[str], float | None]:
    """Trusted positives, unlabelled texts, and the class prior; ``learn`` says which rows may be used."""
    documents = documents.filter(learn)
    marked = labels.filter(learn & F.col(label_col).isNotNull())
    good, known = marked.filter(F.col(label_col) == 1).select(id_col), documents.select(id_col)
    return (_sample(documents, known.join(good, id_col, "left_semi"), MOST_POSITIVE, id_col, text_col),
            _sample(documents, known, MOST_UNLABELLED, id_col, text_col), class_prior(marked, label_col))


def _gradient(x: np.ndarray, z: np.ndarray, sign: float) -> np.ndarray:
    """Of the mean logistic loss of calling all rows ``sign``, by the weights."""
    return (-sign / (1.0 + np.exp(np.clip(sign * z, -40, 40)))).astype(np.float32) @ x / np.float32(len(x))


def fit(positive: list[str], unlabelled: list[str], prior: float | None, seed: int = 5) -> Model:
    texts = [t.encode() for t in (*positive, *unlabelled)]
    size = sum(t.slots for t in TABLES)
    bare = Model(DEFAULT_PRIOR if prior is None else prior, np.zeros(size, np.float32), np.zeros(30), 0.0,
                 np.zeros(10), np.ones(10))
    # Fixed chance for all where there is nothing to tell apart.
    bare.bias = float(np.log(np.clip(bare.prior, 1e-6, 1 - 1e-6) / np.clip(1 - bare.prior, 1e-6, 1.0)))
    if not positive or not unlabelled or not 0.0 < bare.prior < 1.0:
        return bare
    dense = np.concatenate([properties(data, bounds) for _, _, data, bounds in blocks(pa.array(
        [*positive, *unlabelled], pa.string()))])
    mean, spread = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    grams = frequencies(texts, TABLES)
    scale = (0.3 / np.sqrt(grams.mean(axis=0) + 1e-4)).astype(np.float32)
    grams *= scale
    x = np.concatenate([grams, _bent((dense - mean) / spread).astype(np.float32), np.ones((len(texts), 1), np.float32)],
                       axis=1)
    del grams
    rng, p = np.random.default_rng(seed), bare.prior
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    w[-1] = bare.bias
    average = np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):
        xp = x[rng.integers(0, len(positive), BATCH)]
        xu = x[len(positive) + rng.integers(0, len(unlabelled), BATCH * 2)]
        zp, zu = xp @ w, xu @ w
        bad = np.logaddexp(0, zu).mean() - p * np.logaddexp(0, zp).mean()
        against = _gradient(xu, zu, -1.0) - p * _gradient(xp, zp, -1.0)
        g = p * _gradient(xp, zp, 1.0) + against if bad >= 0 else BACK * against
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= np.float32(RATE / (1 + step / 200)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        if step > STEPS // 2:
            average += w
    w = average / (STEPS - STEPS // 2)
    return Model(p, (w[:size] * scale).astype(np.float32), w[size:-1], float(w[-1]), mean, spread)


def score_quality(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability that a text is a good one."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(_: pa.Array, data: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
        return {score_col: pa.array(sent.value.score(data, bounds), pa.float64())}

    return add_columns(documents, text_col, {score_col: T.DoubleType()}, work)
