"""Exact vector search: similarity, popularity and top-k.

Song rows carry ``song_id, title, artist, views, embedding`` and a query is a plain list
of numbers. Ranking is by score, then by song id, so equal scores always come out alike.
Popularity is either part of the score from the start (fused) or applied to the best rows
by similarity only (two-stage); the two give different results and stay separate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.constants import (
    OVERFETCH_ALL,
    OVERFETCH_CANDIDATES,
    TOP_K_RAW,
    TOP_K_SEARCH_ALL,
    TOP_K_SEARCH_CHUNKS,
)
from songloom.functions.keys import numeric
from songloom.functions.scores import counted_views, views_multiplier
from songloom.functions.vectors import cosine, dot, l2_normalise, literal
from songloom.operators.chunks import unit_flags
from songloom.operators.filters import drop_unidentified
from songloom.operators.groups import top_k_per_group

RESULT = ["song_id", "title", "artist", "views", "raw_score", "views_multiplier", "score"]


def best_first(score: str = "score") -> list[Column]:
    return [F.col(score).desc(), F.col("song_id").asc()]


def normalise_vectors(songs: DataFrame) -> DataFrame:
    return songs.withColumn("embedding", l2_normalise(F.col("embedding")))


def normalise_if_needed(vectors: DataFrame) -> DataFrame:
    """Normalise only the chunks whose first rows do not look normalised."""
    # One row per chunk, made from its first 512 rows: a broadcast keeps the vectors where they are.
    unit = F.broadcast(unit_flags(vectors).select("chunk_index", "already_unit"))
    flagged = vectors.join(unit, "chunk_index", "left").fillna(False, ["already_unit"])
    return flagged.withColumn(
        "embedding",
        F.when(F.col("already_unit"), F.col("embedding").cast("array<double>"))
        .otherwise(l2_normalise(F.col("embedding"))),
    )


def with_vector(songs: DataFrame, dim: int | Column | None = None) -> DataFrame:
    """Songs that can be scored: those with a vector of the query's length without missing numbers.

    Every search goes through here, so whether a song can be a hit does not depend on the way.
    """
    vector = F.col("embedding")
    songs = songs.filter(vector.isNotNull())
    whole = ~F.exists(vector, lambda x: x.isNull())
    return songs.filter(whole if dim is None else whole & (F.size(vector) == dim))


def cosine_scan(songs: DataFrame, query: list[float]) -> DataFrame:
    """Similarity of every song with a vector to one query; the vectors are unit vectors."""
    return with_vector(songs, len(query)).withColumn("raw_score", dot(F.col("embedding"), literal(query)))


def cosine_raw(songs: DataFrame, query: list[float], k: int = TOP_K_RAW) -> DataFrame:
    """Top-k by cosine of vectors that were not normalised beforehand."""
    scored = with_vector(songs, len(query)).withColumn("score", cosine(F.col("embedding"), literal(query))).drop("embedding")
    return scored.orderBy(*best_first()).limit(k)


def with_popularity(scored: DataFrame) -> DataFrame:
    """Views as used for scoring, their multiplier and the final score."""
    views = numeric(F.col("views"))
    return scored.withColumn("views_multiplier", views_multiplier(views)).withColumn(
        "score", F.col("raw_score") * F.col("views_multiplier")).withColumn("views", counted_views(views))


def topk_fused(songs: DataFrame, query: list[float], k: int = TOP_K_SEARCH_CHUNKS) -> DataFrame:
    """Top-k by similarity times popularity over all identified songs."""
    scored = with_popularity(cosine_scan(drop_unidentified(songs), query)).select(*RESULT)
    return scored.orderBy(*best_first()).limit(k)


def _only(songs: DataFrame, candidates: DataFrame) -> DataFrame:
    # Before scoring, so that only candidates' vectors are read into the arithmetic.
    return songs.join(candidates.select("song_id").distinct(), "song_id", "left_semi")


def topk_fused_candidates(songs: DataFrame, candidates: DataFrame, query: list[float],
                          k: int = TOP_K_SEARCH_CHUNKS) -> DataFrame:
    return topk_fused(_only(songs, candidates), query, k)


def topk_two_stage(songs: DataFrame, query: list[float], k: int = TOP_K_SEARCH_ALL,
                   overfetch: int = OVERFETCH_ALL) -> DataFrame:
    """Best ``overfetch * k`` by similarity, unidentified rows dropped, popularity applied, top-k.

    An unidentified row takes up a place in the first cut.
    """
    slim = cosine_scan(songs, query).select("song_id", "title", "artist", "views", "raw_score")
    near = slim.orderBy(*best_first("raw_score")).limit(k * overfetch)
    return with_popularity(drop_unidentified(near)).select(*RESULT).orderBy(*best_first()).limit(k)


def topk_two_stage_candidates(songs: DataFrame, candidates: DataFrame, query: list[float],
                              k: int = TOP_K_SEARCH_ALL, overfetch: int = OVERFETCH_CANDIDATES) -> DataFrame:
    return topk_two_stage(_only(songs, candidates), query, k, overfetch)


def rank_pairs(scored: DataFrame, k: int, overfetch: int | None) -> DataFrame:
    """Per request, the top-k of (request, song) rows that carry ``raw_score``.

    ``overfetch`` set: two-stage, with that factor; not set: fused.
    """
    if overfetch is None:
        fused = with_popularity(drop_unidentified(scored))
        return top_k_per_group(fused, ["request_id"], best_first(), k, "song_id")
    near = top_k_per_group(scored, ["request_id"], best_first("raw_score"), k * overfetch, "song_id").drop("rank")
    return top_k_per_group(with_popularity(drop_unidentified(near)), ["request_id"], best_first(), k, "song_id")
