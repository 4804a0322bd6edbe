"""How a result row is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from songloom.constants import VARIOUS_GENRES


def duration_text(milliseconds: Column) -> Column:
    seconds = F.floor(milliseconds / F.lit(1000.0) + F.lit(0.5)).cast("int")
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), F.pmod(seconds, F.lit(60)))


def percent_text(score: Column) -> Column:
    """Rounded percentage, half up; blank for a missing or zero score."""
    shown = F.concat(F.floor(score * 100.0 + 0.5).cast("string"), F.lit("%"))
    return F.when(score.isNull() | (score == 0.0), F.lit("")).otherwise(shown)


def streams(views: Column) -> Column:
    return F.coalesce(views.cast("bigint"), F.lit(0).cast("bigint"))


def genres_text(genres: Column) -> Column:
    shown = F.array_join(F.slice(genres, 1, 3), ", ")
    return F.when(F.coalesce(F.size(genres), F.lit(0)) > 0, shown).otherwise(F.lit(VARIOUS_GENRES))


def result_id(position: Column, title: Column, artist: Column) -> Column:
    """``song_{position}_{0-9999}``, the number taken from the title and artist."""
    key = F.concat(title, F.lit("_"), artist)
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 10000
    return F.concat_ws("_", F.lit("song"), position.cast("string"), number.cast("string"))
