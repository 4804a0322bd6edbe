"""Matching requested tracks to the corpus.

Joins carry no broadcast hint: how many candidates there are is only known at run time,
so adaptive execution broadcasts the candidate side when its measured size allows, and
otherwise splits whatever key is hot on the corpus side. The candidate side has one row
per key by then, so a hot key never multiplies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.constants import DEFAULT_ALBUM, DEFAULT_DURATION_MS, DEFAULT_GENRE, MISSING_URL
from songloom.functions.keys import corpus_key, normalise_key, numeric, wanted_tags
from songloom.functions.payload import first_artist, first_image, track_url
from songloom.operators.filters import drop_unidentified
from songloom.operators.groups import first_per_key, top_k_per_group
from songloom.sources.key_index import MATCH_KEY, match_stored

KEYS = ["norm_title", "norm_artist"]
SEEN_ORDER = ["query_no", "page_no", "playlist_pos", "track_pos"]


def flatten_playlists(pages: DataFrame) -> DataFrame:
    """One row per track of nested playlist pages; missing playlists and tracks are skipped."""
    playlists = pages.select(
        "request_id", "query_no", "page_no", F.posexplode("playlists").alias("playlist_pos", "playlist"))
    tracks = playlists.filter(F.col("playlist").isNotNull()).select(
        "request_id", "query_no", "page_no", "playlist_pos", F.col("playlist.id").alias("playlist_id"),
        F.size("playlist.tracks").cast("bigint").alias("playlist_total"),
        F.posexplode("playlist.tracks").alias("track_pos", "item"))
    return tracks.filter(F.col("item.track").isNotNull()).select(
        "request_id", "query_no", "page_no", "playlist_pos", "playlist_id", "playlist_total", "track_pos",
        F.col("item.track").alias("track"))


def track_fields(tracks: DataFrame) -> DataFrame:
    """Track struct unpacked to the fields later steps use."""
    track = F.col("track")
    return tracks.select(
        *[c for c in tracks.columns if c != "track"],
        track["id"].alias("track_id"), track["name"].alias("name"),
        first_artist(track).alias("artist_name"), track_url(track).alias("url"),
        first_image(track).alias("image_url"),
    )


def with_track_keys(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("norm_title", normalise_key(F.col("name"))).withColumn(
        "norm_artist", normalise_key(F.col("artist_name")))


def with_corpus_keys(songs: DataFrame) -> DataFrame:
    return songs.withColumn("norm_title", corpus_key(F.col("title"))).withColumn(
        "norm_artist", corpus_key(F.col("artist")))


def dedup_tracks(tracks: DataFrame, order: list[str], per: list[str] | None = None) -> DataFrame:
    """Each track id once (per request), as first seen."""
    return first_per_key(tracks, [*(per or []), "track_id"], order)


def dedup_keys_first(tracks: DataFrame, order: list[str], per: list[str] | None = None) -> DataFrame:
    """Each (title, artist) key once (per request), as first seen."""
    return first_per_key(with_track_keys(tracks), [*(per or []), *KEYS], order)


def distinct_keys(tracks: DataFrame) -> DataFrame:
    return with_track_keys(tracks).select(*KEYS).distinct()


def match_candidates(songs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Corpus rows whose key is among the tracks' keys; corpus duplicates all stay."""
    return with_corpus_keys(songs).join(distinct_keys(tracks), KEYS, "left_semi")


def match_candidates_strict(songs: DataFrame, tracks: DataFrame) -> DataFrame:
    """As :func:`match_candidates`, leaving out tracks with a blank title or artist."""
    keys = distinct_keys(tracks).filter((F.col("norm_title") != "") & (F.col("norm_artist") != ""))
    return with_corpus_keys(songs).join(keys, KEYS, "left_semi").select("song_id", "title", "artist")


def first_tracks(tracks: DataFrame, order: list[str]) -> DataFrame:
    """Each key once, with id, url and image of its first track."""
    return dedup_keys_first(tracks, order).select(*KEYS, "track_id", "url", "image_url")


def attach_track_attrs(matched: DataFrame, tracks: DataFrame, order: list[str]) -> DataFrame:
    """Matched rows with id, url and image of the first track that has their key."""
    return matched.join(first_tracks(tracks, order), KEYS, "left")


def match_and_attach(songs: DataFrame, tracks: DataFrame, order: list[str]) -> DataFrame:
    """Matching and attaching in one join, from one reading of the tracks."""
    return with_corpus_keys(songs).join(first_tracks(tracks, order), KEYS)


def request_keys(requests: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per request the distinct keys of its tracks, with the first track's url and image and the wanted tags."""
    asked = requests.select("request_id", wanted_tags(F.col("genres")).alias("tags"))
    mine = tracks.join(asked.select("request_id"), "request_id", "left_semi")
    once = dedup_tracks(mine, SEEN_ORDER, ["request_id"])
    first = dedup_keys_first(once, SEEN_ORDER, ["request_id"]).select("request_id", *KEYS, "url", "image_url")
    return first.join(asked, "request_id")


def match_keys(songs: DataFrame, keys: DataFrame) -> DataFrame:
    """Corpus rows, with their key, whose key is among the given ones.

    ``songs`` may be the corpus, whose keys are made here, or the index that was stored with them.
    """
    if MATCH_KEY in songs.columns:
        return match_stored(songs, keys).drop(MATCH_KEY)
    return with_corpus_keys(songs).join(keys.select(*KEYS).distinct(), KEYS, "left_semi")


def match_names(songs: DataFrame, keys: DataFrame) -> DataFrame:
    """(request, name) for the names each request found, a name being a title, artist and tag.

    ``copies`` counts the songs that share the name and ``song_id, views`` are those of the
    first. However often a name occurs it is one row per request here, which is all that
    counting and describing need.
    """
    names = match_keys(songs.select("song_id", "title", "artist", "tag", "views"), keys).groupBy(*KEYS, "title", "artist", "tag").agg(
        F.count(F.lit(1)).alias("copies"), F.min("song_id").alias("song_id"),
        F.min_by("views", "song_id").alias("views"))
    return names.join(keys, KEYS)


def restrict_to_hits(matched: DataFrame, hits: DataFrame) -> DataFrame:
    """Matched rows whose title and artist are among the hits."""
    return matched.join(hits.select("title", "artist").distinct(), ["title", "artist"], "left_semi")


def lookup_ids(hits: DataFrame, songs: DataFrame) -> DataFrame:
    """Hits with the stored row of their song; hits without one vanish."""
    return hits.join(songs, "song_id")


def first_song_per_name(songs: DataFrame, per: list[str] | None = None) -> DataFrame:
    """The first corpus row of each (title, artist)."""
    return first_per_key(drop_unidentified(songs), [*(per or []), "title", "artist"], ["song_id"])


def enrich_hits(hits: DataFrame, matched: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Hits with genre, album, duration, url and image of the first matched row of the same name."""
    keys = [*(per or []), "title", "artist"]
    wanted = {"tag": "string", "album": "string", "duration_ms": "int", "url": "string", "image_url": "string"}
    slim = matched.select(*keys, "song_id", *[c for c in wanted if c in matched.columns])
    first = first_song_per_name(slim, per).drop("song_id").withColumn("_found", F.lit(True))
    for column, kind in wanted.items():
        if column not in first.columns:
            first = first.withColumn(column, F.lit(None).cast(kind))
    kept = [c for c in hits.columns if c not in wanted]
    # A missing row takes the defaults; so does a column the corpus does not have.
    return hits.select(*kept).join(first, keys, "left").select(
        *kept,
        F.coalesce("album", F.lit(DEFAULT_ALBUM)).alias("album"),
        F.coalesce("tag", F.lit(DEFAULT_GENRE)).alias("genre"),
        F.coalesce("duration_ms", F.lit(DEFAULT_DURATION_MS)).alias("duration_ms"),
        F.when(F.coalesce("url", F.lit("")) == "", MISSING_URL).otherwise(F.col("url")).alias("url"), "image_url",
    )


def flag_in_final(watched: DataFrame, final: DataFrame) -> DataFrame:
    """Watched songs, each with whether it is in the final list."""
    names = final.select("title", "artist").distinct().withColumn("_in", F.lit(True))
    return watched.join(names, ["title", "artist"], "left").withColumn(
        "in_final", F.coalesce("_in", F.lit(False))).drop("_in")


def dedup_corpus(songs: DataFrame) -> DataFrame:
    """One row per (title, artist) key, the most viewed; rows without a key all stay.

    Only keys that occur more than once are joined back, so a corpus with few duplicates
    drops them without shuffling its lyrics.
    """
    keyed = with_corpus_keys(songs).withColumn("_views", F.coalesce(numeric(F.col("views")), F.lit(0.0)))
    best = keyed.filter(F.col("norm_title").isNotNull() & F.col("norm_artist").isNotNull()).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min_by("song_id", F.struct((-F.col("_views")).alias("v"), "song_id")).alias("_kept"),
    ).filter(F.col("_copies") > 1).drop("_copies")
    return keyed.join(best, KEYS, "left").filter(
        F.col("_kept").isNull() | (F.col("_kept") == F.col("song_id"))).drop("_kept", "_views")


def pick_playlists(tracks: DataFrame, min_tracks: int, max_tracks: int, max_songs: int) -> DataFrame:
    """Per request: for each phrase the first playlist of acceptable size, their tracks once each.

    Playlists come in the order of the search; their size is the stated total (``playlist_total``),
    missing tracks included. At most ``max_songs`` tracks per request, in the order seen.
    """
    keys = ["request_id", "query_no", "page_no", "playlist_pos"]
    fitting = tracks.filter(F.col("playlist_total").between(min_tracks, max_tracks)).select(*keys).distinct()
    chosen = first_per_key(fitting, ["request_id", "query_no"], ["page_no", "playlist_pos"])
    once = dedup_tracks(tracks.join(chosen, keys, "left_semi"), SEEN_ORDER, ["request_id"])
    return top_k_per_group(once, ["request_id"], [F.col(c) for c in SEEN_ORDER], max_songs, "track_pos")


def run_summary(requests: DataFrame, tracks: DataFrame, names: DataFrame, kept: DataFrame,
                hits: DataFrame) -> DataFrame:
    """Per request: distinct candidates, corpus matches, matches left by genre, hits."""
    once = tracks.join(requests.select("request_id"), "request_id", "left_semi").select("request_id", "track_id").distinct()
    one = F.lit(1)
    out = requests.select("request_id")
    for column, rows, count in (("total_candidates", once, F.count(one)), ("dataset_matches", names, F.sum("copies")),
                                ("after_genre", kept, F.sum("copies")), ("hits", hits, F.count(one))):
        out = out.join(rows.groupBy("request_id").agg(count.alias(column)), "request_id", "left")
    return out.fillna(0)
