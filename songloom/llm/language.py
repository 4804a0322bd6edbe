"""Language identification: first the family, then the languages within it two by two.

Features are shares of hashed n-grams of letters. Linear models part each family from the rest;
within a family every two languages have a linear support vector machine, and most votes win
(ties by the sum of margins). Models are fitted on the driver from at most ``PER_LANGUAGE``
texts of each language, chosen by a hash of the id, whole and in short pieces. Every text is
then scored as a whole, on the executors.

Defined results: a missing text, or one without a letter, is ``und`` with score 0; so is every
text where nothing was learned from; a missing label is not learned from; repeated rows are
answered each; an empty table gives an empty result. Other columns are passed on.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songloom.llm.features import Grams, add_columns, frequencies, letters, products
from songloom.llm.words import give_back
from songloom.operators.groups import top_k_per_group

UNKNOWN = "und"
PER_LANGUAGE = 600
PIECES = ((24, 60), (60, 200))  # bytes of the short pieces that are learned from besides whole texts
TABLES = (Grams(letters, 3, 4096), Grams(letters, 2, 1024))
STEPS = 600
BATCH = 64
# Rows of features that are made at once.
ROWS_AT_ONCE = 256

# Languages by family; one that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}


@dataclass
class Model:
    """Columns of ``weights``: one per family, then one per pair of related languages."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray

    def family(self, language: str) -> str:
        return _FAMILY_OF.get(language, language)

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of margins."""
        margins = margins / self.scale
        names = np.array([*self.languages, UNKNOWN], object)
        if not self.languages:
            return names[np.zeros(len(margins), int)], np.zeros(len(margins))
        sure = lambda m: 1.0 / (1.0 + np.exp(-np.clip(3.0 * m, -40.0, 40.0)))
        kin = margins[:, :len(self.families)]
        of_family = sure(kin)
        of_family = of_family / of_family.sum(axis=1, keepdims=True)
        best = kin.argmax(axis=1)
        votes = np.zeros((len(margins), len(self.languages), 2))
        least = np.ones((len(margins), len(self.languages)))
        for k, (a, b) in enumerate(self.pairs):
            margin = margins[:, len(self.families) + k]
            for language, m in ((self.languages.index(a), margin), (self.languages.index(b), -margin)):
                votes[:, language, 0] += m > 0
                votes[:, language, 1] += m
                least[:, language] = np.minimum(least[:, language], sure(m))
        family_no = np.array([self.families.index(self.family(x)) for x in self.languages])
        outside = family_no[None, :] != best[:, None]
        votes[outside] = -np.inf
        # Most votes, then the larger sum of margins, then the first name.
        winner = np.lexsort((-votes[:, :, 1], -votes[:, :, 0]), axis=1)[:, 0]
        rows = np.arange(len(margins))
        return names[winner], of_family[rows, best] * least[rows, winner]


def separate(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Linear support vector machine by averaged steps on the hinge loss; classes weigh the same.

    Rows with ``y`` 0 take no part; the features are read where they are, never copied.
    """
    rng, lam = np.random.default_rng(seed), 1e-4
    w, total, b, b_total = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1]), 0.0, 0.0
    sides = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    if not all(len(s) for s in sides):
        return w, float(np.sign(y.sum()))
    for step in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        seen = x[rows].astype(np.float32)
        wrong = y[rows] * (seen @ w + b) < 1
        rate = 1.0 / (1.0 + 0.02 * step)
        w *= 1.0 - rate * lam
        if wrong.any():
            w += rate / BATCH * (y[rows[wrong]] @ seen[wrong])
            b += rate / BATCH * 0.1 * float(y[rows[wrong]].sum())
        if step > STEPS // 2:
            total += w
            b_total += b
    return (total / (STEPS - STEPS // 2)).astype(np.float32), b_total / (STEPS - STEPS // 2)


def labelled_sample(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "lang", most: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, label) of at most ``most`` rows of each label where ``learn`` is true."""
    keys = documents.filter(learn & F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("label"), F.xxhash64(id_col).alias("key")).distinct()
    chosen = top_k_per_group(keys, ["label"], [F.col("key")], most, "key").select("key", "label")
    rows = documents.filter(learn & F.col(text_col).rlike(r"\p{L}")).select(
        F.xxhash64(id_col).alias("key"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    # At most ``most`` rows per language: sent to the texts, which stay where they are.
    found = rows.join(F.broadcast(chosen), ["key", "label"], "left_semi").dropDuplicates(["key", "label"])
    return sorted((r["text"], r["label"]) for r in found.select("text", "label").toLocalIterator())


def fit(sample: list[tuple[str, str]], seed: int = 3) -> Model:
    rng, texts, labels = np.random.default_rng(seed), [], []
    for text, label in sample:
        whole = text.encode()
        texts.append(whole)
        labels.append(label)
        for low, high in PIECES:
            size = int(rng.integers(low, high))
            if len(whole) > 2 * size:
                start = int(rng.integers(0, len(whole) - size))
                piece = re.sub(rb"^[\x80-\xbf]+", b"", whole[start:start + size])
                texts.append(piece)
                labels.append(label)
    languages = sorted(Counter(labels))
    model = Model(languages, [], [], np.zeros((0, 0)), np.zeros(0), np.ones(0))
    model.families = sorted({model.family(x) for x in languages})
    model.pairs = [(a, b) for a, b in combinations(languages, 2) if model.family(a) == model.family(b)]
    size = sum(t.slots for t in TABLES)
    if not languages:
        model.weights = np.zeros((size, 0), np.float32)
        return model
    parts = [slice(a, a + ROWS_AT_ONCE) for a in range(0, len(texts), ROWS_AT_ONCE)]
    mean = sum(frequencies(texts[part], TABLES).sum(axis=0, dtype=np.float64) for part in parts) / len(texts)
    # Rare n-grams count as much as common ones.
    spread = (1.0 / np.sqrt(mean + 1e-5)).astype(np.float32)
    # Half precision is enough to learn from, and half the memory of the driver.
    x = np.empty((len(texts), size), np.float16)
    for part in parts:
        x[part] = frequencies(texts[part], TABLES) * spread
    family, label = np.array([model.family(x) for x in labels]), np.array(labels)
    found = [np.where(family == f, 1.0, -1.0) for f in model.families]
    found += [np.where(label == a, 1.0, np.where(label == b, -1.0, 0.0)) for a, b in model.pairs]
    weights, bias, scale = [], [], []
    for k, y in enumerate(found):
        w, b = separate(x, y.astype(np.float32), seed + k)
        margin = np.abs(np.concatenate([x[part].astype(np.float32) @ w for part in parts]) + b)[y != 0]
        weights.append(w * spread)
        bias.append(b)
        scale.append(max(float(np.median(margin)), 1e-6))
    model.weights, model.bias, model.scale = np.stack(weights, axis=1), np.array(bias), np.array(scale)
    del x, texts
    give_back()
    return model


def identify(documents: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred",
             score_col: str = "score") -> DataFrame:
    """Add the predicted language of each text and its score (0 to 1)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
        known = sent.value
        language, score = known.predict(products(data, bounds, TABLES, known.weights) + known.bias)
        none = [i for i, t in enumerate(texts.to_pylist()) if not t or not any(c.isalpha() for c in t)]
        language[none], score[none] = UNKNOWN, 0.0
        score[language == UNKNOWN] = 0.0
        return {lang_col: pa.array(language, pa.string()), score_col: pa.array(score, pa.float64())}

    return add_columns(documents, text_col, {lang_col: T.StringType(), score_col: T.DoubleType()}, work)
