"""From scored hits to the final list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.constants import MIN_RELEVANCE
from songloom.functions.scores import blend, neutral_rule, strict_rule
from songloom.functions.keys import has_text, strip
from songloom.functions.text import tokens
from songloom.operators.encode import LYRICS_WORDS

Rule = Callable[[Column, Column, Column], dict[str, Column]]


def blend_scores(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", blend(F.col("vector_score"), F.col("relevance")))


def _rerank(hits: DataFrame, rule: Rule) -> DataFrame:
    """``vector_score, relevance (NULL: no lyrics), failed`` turned into ``score, relevance``."""
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in hits.columns else F.lit(False)
    new = rule(F.col("vector_score"), F.col("relevance"), failed)
    return hits.withColumns(new).drop("failed")


def rerank_neutral(hits: DataFrame) -> DataFrame:
    return _rerank(hits, neutral_rule)


def rerank_strict(hits: DataFrame) -> DataFrame:
    return _rerank(hits, strict_rule)


def rank_results(hits: DataFrame, per: list[str], score: str = "score") -> DataFrame:
    """1-based place of each hit in the list of its request."""
    order = Window.partitionBy(*per).orderBy(F.col(score).desc(), F.col("song_id"))
    return hits.withColumn("rank", F.row_number().over(order))


def fetch_lyrics(candidates: DataFrame, lyrics: DataFrame, by: list[str], words: bool = False) -> DataFrame:
    """Candidates with their lyrics, stripped; blank or absent lyrics are NULL.

    ``words``: also with their words, for ``score_relevance``, cut once a song and not once a candidate.

    The lyrics are cut down to the candidates' first: an outer join alone could only
    broadcast or shuffle the lyrics, never leave them in place.
    """
    wanted = lyrics.join(candidates.select(*by).distinct(), by, "left_semi")
    text = wanted.filter(has_text(F.col("lyrics"))).select(*by, strip(F.col("lyrics")).alias("lyrics"))
    if words:
        text = text.withColumn(LYRICS_WORDS, tokens(F.col("lyrics")))
    return candidates.drop("lyrics").join(text, by, "left")


def min_score_filter(candidates: DataFrame, scores: DataFrame, min_score: int = MIN_RELEVANCE) -> DataFrame:
    """Candidates with lyrics whose relevance reaches ``min_score``, best first."""
    kept = scores.filter(F.col("relevance") >= min_score)
    return candidates.join(kept, "song_id").orderBy(F.col("relevance").desc(), F.col("song_id"))
