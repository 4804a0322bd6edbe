"""Playlist payloads in, finished playlists out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.constants import TOP_K_JOB
from songloom.functions.text import playlist_title
from songloom.schema import PLAYLIST_PAGE

SONG_FIELDS = ["id", "title", "artist", "album", "genre", "duration_ms", "score", "streams", "relevance",
               "url", "image_url", "vector_score"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Search-result pages, one JSON object per line."""
    return spark.read.schema(PLAYLIST_PAGE).json(path)


def playlists(requests: DataFrame, songs: DataFrame, max_songs: int = TOP_K_JOB) -> DataFrame:
    """One nested row per request: id, title, genres and its songs in rank order.

    The rank filter keeps every collected list at ``max_songs`` entries or fewer.
    """
    fields = [c for c in SONG_FIELDS if c in songs.columns]
    ranked = songs.filter(F.col("rank") <= max_songs).groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("song")))).alias("s"))
    return requests.join(ranked, "request_id").select(
        F.col("request_id").alias("id"), playlist_title(F.col("prompt")).alias("title"), "genres",
        F.col("s.song").alias("songs"))


def write_playlists(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
