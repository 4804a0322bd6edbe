"""Repeatable randomness: a draw is the md5 of a seed and what is drawn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, *parts: Column | str) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def draw_number(seed: int, modulus: int, *parts: Column | str) -> Column:
    """Draw as a number from 0 to ``modulus - 1``."""
    return (F.conv(F.substring(draw(seed, *parts), 1, 8), 16, 10).cast("bigint") % modulus).cast("int")
