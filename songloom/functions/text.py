"""Text shaping: passages, prompts, titles, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from songloom.constants import (
    LYRICS_FOOTER,
    LYRICS_MAX_CHARS,
    PASSAGE_MAX_CHARS,
    PASSAGE_MERGE_BELOW,
    QUERY_SEED_WORDS,
)
from songloom.functions.keys import strip

_NO_TEXT = "array<string>"


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def passages(lyrics: Column, max_chars: int = PASSAGE_MAX_CHARS) -> Column:
    """Passages of a text: blank-line parts, short neighbours merged, long ones cut.

    A part joins the running passage while their lengths, blank line not counted,
    add up to less than the merge limit.
    """
    parts = F.filter(F.transform(F.split(lyrics, "\n\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast(_NO_TEXT).alias("done"), F.lit("").alias("open"))

    def take(acc: Column, part: Column) -> Column:
        joins = (acc["open"] != "") & (F.length(acc["open"]) + F.length(part) < PASSAGE_MERGE_BELOW)
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return F.struct(
            F.when(joins, acc["done"]).otherwise(closed).alias("done"),
            F.when(joins, F.concat(acc["open"], F.lit("\n\n"), part)).otherwise(part).alias("open"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    def cut(piece: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(piece), F.lit(1)), F.lit(max_chars))
        return F.transform(starts, lambda at: F.substring(piece, at, F.lit(max_chars)))

    return F.flatten(F.transform(F.aggregate(parts, start, take, finish), cut))


def first_words(text: Column, n: int = QUERY_SEED_WORDS) -> Column:
    return F.array_join(F.slice(F.split(strip(text), r"(?U)\s+"), 1, n), " ")


def truncate_lyrics(lyrics: Column, limit: int = LYRICS_MAX_CHARS) -> Column:
    short = F.concat(F.substring(lyrics, 1, limit), F.lit("..."))
    return F.when(F.length(lyrics) > limit, short).otherwise(lyrics)


def render_prompt(prompt: Column, title: Column, artist: Column, lyrics: Column) -> Column:
    """Request text that asks a scorer for a 0-100 relevance score as JSON."""
    return F.concat(
        F.lit('Score from 0 to 100 how well this song answers the request. Reply with {"score": n} only.\nRequest: '),
        prompt, F.lit("\nTitle: "), F.coalesce(title, F.lit("")),
        F.lit("\nArtist: "), F.coalesce(artist, F.lit("")),
        F.lit("\nLyrics:\n"), truncate_lyrics(lyrics),
    )


def query_context(prompt: Column, genres: Column) -> Column:
    """Prompt with the genres in brackets behind it."""
    return F.concat(prompt, F.lit("("), F.array_join(genres, " "), F.lit(")"))


def genre_focus(genres: Column) -> Column:
    """Sentence naming the genres, empty when there are none."""
    focus = F.concat(F.lit(" Focus on "), F.array_join(genres, ", "), F.lit(" music."))
    return F.when(F.size(genres) > 0, focus).otherwise(F.lit(""))


def clean_lyrics(lyrics: Column) -> Column:
    """Lyrics without their heading line and leftover page text; blank becomes NULL."""
    body = strip(F.replace(F.regexp_replace(lyrics, r"^[^\n]*\n", ""), F.lit(LYRICS_FOOTER), F.lit("")))
    return F.when(body != "", body)


def playlist_title(prompt: Column) -> Column:
    short = F.concat(F.substring(prompt, 1, 47), F.lit("..."))
    return F.when(F.length(prompt) <= 50, prompt).otherwise(short)


def short_title(title: Column) -> Column:
    words = F.split(title, " ")
    return F.when(F.size(words) > 3, F.concat(F.array_join(F.slice(words, 1, 3), " "), F.lit("..."))).otherwise(title)
