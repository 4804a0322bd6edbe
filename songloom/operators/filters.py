"""Row filters over the corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.constants import KEPT_LANGUAGES, MIN_YEAR
from songloom.functions.keys import has_text, numeric, wanted_tags
from songloom.schema import require


def _kept_year(min_year: int = MIN_YEAR) -> Column:
    return numeric(F.col("year")) >= min_year


def _kept_language(languages: list[str] | None = None) -> Column:
    return F.col("language").isin(languages or KEPT_LANGUAGES)


def year_filter(songs: DataFrame, min_year: int = MIN_YEAR) -> DataFrame:
    return songs.filter(_kept_year(min_year))


def language_filter(songs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    return songs.filter(_kept_language(languages))


def clean_corpus(songs: DataFrame) -> DataFrame:
    """Rows kept by both the year and the language rule.

    The language test is a plain comparison and reaches the Parquet scan.
    """
    return language_filter(year_filter(songs))


def clean_report(songs: DataFrame) -> DataFrame:
    """Rows before and after cleaning for each chunk."""
    kept = F.count_if(F.coalesce(_kept_year() & _kept_language(), F.lit(False)))
    return songs.groupBy("chunk_index").agg(
        F.count(F.lit(1)).alias("rows_before"), kept.alias("rows_after"),
    ).withColumn("none_filtered", F.col("rows_before") == F.col("rows_after"))


def genre_filter(songs: DataFrame, genres: list[str]) -> DataFrame:
    """Rows whose tag is one of the genres; no genre given, or no tag column, keeps every row."""
    wanted = sorted({g.strip().lower() for g in genres} - {""})
    if not wanted or "tag" not in songs.columns:
        return songs
    return songs.filter(F.lower("tag").isin(wanted))


def passes_genres(tags: Column, tag: Column) -> Column:
    """Whether a corpus tag is among the wanted tags; no wanted tag lets every row pass."""
    return (F.size(tags) == 0) | F.coalesce(F.array_contains(tags, F.lower(tag)), F.lit(False))


def genre_filter_per_request(candidates: DataFrame, genres: str = "genres", tag: str = "tag") -> DataFrame:
    """As :func:`genre_filter`, each row carrying the label list of its own request."""
    return candidates.filter(passes_genres(wanted_tags(F.col(genres)), F.col(tag)))


def drop_unidentified(songs: DataFrame) -> DataFrame:
    # Plain tests, which reach the Parquet scan; dropna's do not.
    return songs.filter(F.col("title").isNotNull() & F.col("artist").isNotNull())


def drop_blank_lyrics(songs: DataFrame) -> DataFrame:
    return songs.filter(has_text(F.col("lyrics")))


def valid_views(songs: DataFrame) -> DataFrame:
    """Rows with a view count that is a number and not negative, as a number."""
    return songs.withColumn("views", numeric(F.col("views"))).filter(F.col("views") >= 0)


def _contains(column: str, term: str, case_sensitive: bool, literal: bool) -> Column:
    pattern = re.escape(term) if literal else term
    return F.coalesce(F.col(column).rlike(pattern if case_sensitive else f"(?i){pattern}"), F.lit(False))


def search_titles(songs: DataFrame, title_term: str = "", artist_term: str = "",
                  case_sensitive: bool = False, literal: bool = False) -> DataFrame:
    """Rows whose title and artist contain the given patterns; a blank term filters nothing."""
    for column, term in (("title", title_term), ("artist", artist_term)):
        if term.strip():
            songs = songs.filter(_contains(column, term, case_sensitive, literal))
    return songs


def watchlist_matches(candidates: DataFrame, terms: list[str]) -> DataFrame:
    """(term, row) for each watched title term a candidate's title contains.

    The terms are a short list someone typed; each title is tested against them in
    place, so the candidates are read once and nothing is joined.
    """
    tested = F.array(*[
        F.when(_contains("title", t, False, False), F.lit(t)) for t in terms
    ])
    return candidates.withColumn("term", F.explode(F.array_compact(tested)))


def watchlist_found(candidates: DataFrame, terms: list[str]) -> DataFrame:
    """One row per term: how many candidates match it, and whether any does."""
    counts = [F.count_if(_contains("title", t, False, False)).alias(f"_{i}") for i, t in enumerate(terms)]
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_{i}").alias("matches"))
                      for i, t in enumerate(terms)])
    return (
        candidates.agg(*counts).select(F.explode(pairs).alias("p")).select("p.*")
        .withColumn("found", F.col("matches") > 0)
    )


def training_columns(songs: DataFrame, position: str = "original_index") -> DataFrame:
    """Columns training needs: text ``song_id`` (row position where absent), title, artist, lyrics."""
    require(songs, "lyrics")
    row_id = F.col(position).cast("string")
    song_id = F.coalesce(F.col("song_id").cast("string"), row_id) if "song_id" in songs.columns else row_id
    optional = [c for c in ("title", "artist") if c in songs.columns]
    return songs.filter(F.col("lyrics").isNotNull()).select(song_id.alias("song_id"), *optional, "lyrics")
