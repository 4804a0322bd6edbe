"""Keys, whitespace and numbers held in text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from songloom.constants import GENRE_LABELS

# Every character that counts as whitespace, the no-break and wide spaces included.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


# Decimal numbers and infinity, with the blanks around them that a cast allows.
_NUMBER = r"(?i)^[\x00-\x20]*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)[\x00-\x20]*$"


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """Whether there is anything but whitespace; stops at the first such character."""
    return text.rlike(f"[^{WHITESPACE}]")


def normalise_key(text: Column) -> Column:
    """Key of a requested title or artist; a missing one becomes the empty key."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def corpus_key(text: Column) -> Column:
    """Key of a stored title or artist; a missing one stays missing and so matches nothing."""
    return F.lower(strip(text))


def numeric(text: Column) -> Column:
    """Number held in text, NULL when it is not one (NaN included).

    The cast alone would also take Java's own spellings, such as "1d" and "0x1p3". The text
    stands here twice only, as filters repeat whatever it is made from.
    """
    plain = text.cast("string")
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def genre_tag(label: Column) -> Column:
    """Corpus tag for a label a user picked; unknown labels count as tags already."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(GENRE_LABELS.items())])
    trimmed = strip(label)
    return F.coalesce(F.try_element_at(known, trimmed), F.lower(trimmed))


def wanted_tags(genres: Column) -> Column:
    """Tags a list of genre labels stands for; blank labels are ignored."""
    return F.filter(F.transform(genres, genre_tag), lambda tag: tag != "")
