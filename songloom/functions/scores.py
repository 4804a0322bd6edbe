"""Scores built from similarity, popularity and relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from songloom.constants import (
    NEUTRAL_RELEVANCE,
    POPULARITY_CENTRE,
    POPULARITY_FLOOR,
    POPULARITY_SLOPE,
    RELEVANCE_WEIGHT,
    VECTOR_WEIGHT,
)


def counted_views(views: Column) -> Column:
    """View count as used for scoring: missing and below one both count as one."""
    return F.greatest(F.coalesce(views, F.lit(1.0)), F.lit(1.0))


def views_multiplier(views: Column) -> Column:
    boost = F.lit(POPULARITY_SLOPE) * (F.log10(counted_views(views)) - F.lit(POPULARITY_CENTRE))
    return F.greatest(F.lit(1.0) + boost, F.lit(POPULARITY_FLOOR))


def blend(vector_score: Column, relevance: Column) -> Column:
    return F.lit(VECTOR_WEIGHT) * vector_score + F.lit(RELEVANCE_WEIGHT) * (relevance / F.lit(100.0))


def neutral_rule(vector_score: Column, relevance: Column, failed: Column) -> dict[str, Column]:
    """Service rule: no lyrics counts as neutral; a failed call leaves the vector score alone."""
    known = F.when(failed | relevance.isNull(), F.lit(NEUTRAL_RELEVANCE)).otherwise(relevance)
    score = F.when(failed, vector_score).otherwise(blend(vector_score, known))
    return {"score": score, "relevance": known.cast("int")}


def strict_rule(vector_score: Column, relevance: Column, failed: Column) -> dict[str, Column]:
    """Command-line rule: no lyrics keeps the vector score unweighted, with relevance 0.

    This variant has no failure branch: its scorer turns every failure into a score of 0.
    """
    known = F.when(failed, F.lit(0)).otherwise(relevance)
    score = F.when(known.isNull(), vector_score).otherwise(blend(vector_score, known))
    return {"score": score, "relevance": F.coalesce(known, F.lit(0)).cast("int")}
