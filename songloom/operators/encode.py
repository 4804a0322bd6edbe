"""Text encoders and relevance scorers, both pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from songloom.functions.payload import parse_score
from songloom.functions.text import render_prompt, tokens

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str]], list[str | None]]

HASH_DIM = 256
# Column with the words of the lyrics, where they have been cut already.
LYRICS_WORDS = "_lyrics_words"


def _slots(text: Column, dim: int) -> Column:
    """The slot of every word of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


def _count_slots(dim: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Slots of a batch of texts as unit vectors of counts, all texts of a batch at once."""
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            given = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            known = lists.take(pa.array(given))
            slots, sizes = known.flatten().to_numpy(), np.diff(known.offsets.to_numpy())
            cells = np.repeat(np.arange(len(given)), sizes) * dim + slots
            out = np.bincount(cells, minlength=len(given) * dim).astype(np.float64).reshape(-1, dim)
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            out = (out / np.where(lengths == 0.0, 1.0, lengths)).astype(np.float32)
            offsets = np.zeros(len(lists) + 1, np.int32)
            offsets[given + 1] = dim
            missing = np.ones(len(lists), bool)
            missing[given] = False
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), pa.array(out.ravel()),
                                           mask=pa.array(missing))
    return count


def hashed_words(df: DataFrame, text: str, dim: int = HASH_DIM, output: str = "embedding") -> DataFrame:
    """Rows with the built-in vector of their text: counts of hashed words, as a unit vector.

    Words are cut and hashed by SQL expressions; only counting runs in Python, batch by batch.
    """
    count = F.arrow_udf(_count_slots(dim), "array<float>", ArrowUDFType.SCALAR_ITER)
    return df.withColumn(output, count(_slots(F.col(text), dim)))


def embed_texts(df: DataFrame, text: str, load: Callable[[], Encoder] | None = None,
                output: str = "embedding", dim: int = HASH_DIM) -> DataFrame:
    """Rows with the vector of their text; ``load`` runs once per task and returns the encoder.

    Without one it is :func:`hashed_words` of ``dim`` numbers. A missing text gets no vector.
    """
    if load is None:
        return hashed_words(df, text, dim, output)

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            given = batch.notna().to_numpy()
            if given.any():
                vectors = encode(batch[given].tolist()).astype(np.float32)
                out[np.nonzero(given)[0]] = list(vectors)
            yield out

    return df.withColumn(output, vector(F.col(text)))


def without_vectors(songs: DataFrame, stored: DataFrame) -> DataFrame:
    """Songs that have no stored vector yet."""
    return songs.join(stored.select("song_id"), "song_id", "left_anti")


def score_relevance(pairs: DataFrame, scorer: Scorer | None = None, concurrency: int | None = None) -> DataFrame:
    """(prompt, title, artist, lyrics) rows with a 0-100 ``relevance``; NULL where there are no lyrics.

    ``scorer`` takes a batch of request texts and returns the responses; ``concurrency``
    bounds how many tasks call it at once. Without one the score is the share of the
    prompt's words that occur in the lyrics.
    """
    if scorer is None:
        asked = pairs.withColumn("_asked", tokens(F.col("prompt")))
        cut = LYRICS_WORDS in pairs.columns
        words, sung = (F.col(LYRICS_WORDS) if cut else tokens(F.col("lyrics"))), F.col(LYRICS_WORDS if cut else "lyrics").isNotNull()
        shared = F.size(F.array_intersect("_asked", words))
        share = F.floor(F.lit(100.0) * shared / F.greatest(F.size("_asked"), F.lit(1))).cast("int")
        return asked.withColumn("relevance", F.when(sung, share)).drop("_asked", LYRICS_WORDS)
    if concurrency:
        pairs = pairs.repartition(concurrency)

    @F.pandas_udf("string")
    def respond(batch: pd.Series) -> pd.Series:
        asked = batch[batch.notna()]
        return pd.Series(scorer(asked.tolist()), index=asked.index, dtype=object).reindex(batch.index)

    request = render_prompt(F.col("prompt"), F.col("title"), F.col("artist"), F.col("lyrics"))
    return pairs.withColumn("_response", respond(request)).withColumn(
        "relevance", F.when(F.col("lyrics").isNotNull(), parse_score(F.col("_response")))).drop("_response")
