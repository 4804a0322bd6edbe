"""A random order that any place can be computed in: a keyed permutation of the numbers 0 to n - 1.

A number is written as two digits of about the root of n, and in each round one digit is shifted
by a hash of the other. Every round can be undone, so different numbers stay different; the few
results that are n or more go through the rounds again until they are below. Where a number ends up
depends on the key and n alone: no sort, no shuffle, and any part of the order by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
# Times that a number may go through the rounds; less than one in a root of n goes through them again.
MOST_TURNS = 64


def digits(n: int) -> tuple[int, int]:
    """Bases of the two digits: their product is n or barely more."""
    base = max(1, math.isqrt(n - 1) + 1 if n > 0 else 1)
    return base, max(1, -(-n // base))


def _rounds(number: Column, n: int, seed: int, key: str) -> Column:
    """One pass: a struct holds both digits, so that each is computed once a round."""
    high, low = digits(n)
    start = F.struct(F.floor(number / F.lit(low)).cast("bigint").alias("h"), (number % low).alias("l"))

    def turn(state: Column, k: Column) -> Column:
        # The number of the round is part of the hash, as a column here.
        shift = lambda digit, modulus: F.conv(F.substring(F.md5(F.concat_ws(
            "|", F.lit(str(seed)), F.lit(key), k.cast("string"), digit.cast("string"))), 1, 8), 16, 10).cast("bigint") % modulus
        moved = (state["h"] + shift(state["l"], high)) % high
        other = (state["l"] + shift(state["h"], low)) % low
        return F.when(k % 2 == 0, F.struct(moved.alias("h"), state["l"].alias("l"))).otherwise(
            F.struct(state["h"].alias("h"), other.alias("l")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["h"] * low + s["l"])


def permuted(number: Column, n: int, seed: int, key: str) -> Column:
    """Where a number from 0 to ``n - 1`` stands in the order that ``seed`` and ``key`` name."""
    number = number.cast("bigint")
    again = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_TURNS)), _rounds(number, n, seed, key),
        lambda x, _: F.when(x < n, x).otherwise(_rounds(x, n, seed, key)))
    inside = (number >= 0) & (number < n)
    return F.when(inside, again).otherwise(F.raise_error(F.concat(F.lit(f"not a number below {n}: "), number.cast("string"))))
