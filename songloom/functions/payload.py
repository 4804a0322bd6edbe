"""Reading the text and nested payloads that external services return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from songloom.constants import FALLBACK_PHRASES, N_PHRASES
from songloom.functions.keys import strip


def unfence(text: Column) -> Column:
    """Response without code fences."""
    return F.replace(F.replace(strip(text), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))


def _one_object(text: Column, value: Callable[[Column], Column]) -> Column:
    """``value`` of a text that is one JSON object and nothing else; it gets the object as ``$.one``.

    JSON readers ignore what follows the first value. Put into a list and into an object, a
    text that holds more than one value, or a stray bracket, breaks at least one of the two.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"one": '), text, F.lit("}")))
    single = F.schema_of_variant(F.try_variant_get(held, "$.one", "variant")).startswith("OBJECT")
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$") & alone & single & listed.isNotNull(), value(held))


def parse_score(response: Column) -> Column:
    """Score in a JSON response, cut to 0-100; anything unreadable scores 0."""
    found = _one_object(unfence(response), lambda held: F.try_variant_get(held, "$.one.score", "bigint"))
    number = F.coalesce(found, F.lit(0))
    return F.greatest(F.least(number, F.lit(100)), F.lit(0)).cast("int")


def parse_phrases_json(response: Column) -> Column:
    """Phrases in a JSON object with a ``queries`` list; unreadable responses give none."""
    text = unfence(response)
    parsed = F.from_json(_one_object(text, lambda _: text), "queries ARRAY<STRING>")
    return F.coalesce(parsed["queries"], F.array().cast("array<string>"))


def parse_phrases_lines(response: Column, n: int = N_PHRASES) -> Column:
    """First ``n`` non-blank lines; the fixed phrases when the call failed (NULL)."""
    lines = F.filter(F.transform(F.split(strip(response), "\n"), strip), lambda line: line != "")
    return F.coalesce(F.slice(lines, 1, n), F.array(*[F.lit(p) for p in FALLBACK_PHRASES]))


def first_artist(track: Column) -> Column:
    return F.coalesce(F.get(track["artists"], F.lit(0))["name"], F.lit(""))


def track_url(track: Column) -> Column:
    return track["external_urls"]["spotify"]


def first_image(track: Column) -> Column:
    return F.get(track["album"]["images"], F.lit(0))["url"]


def message_count(message: Column) -> Column:
    """First number in a progress message about songs or candidates."""
    found = F.regexp_extract(message, r"(\d{1,3}(?:,\d{3})*|\d+)", 1)
    about = message.contains("songs") | message.contains("candidates")
    return F.when(about & (found != ""), F.replace(found, F.lit(","), F.lit("")).try_cast("bigint"))
