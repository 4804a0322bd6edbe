"""First row and top rows per group, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.session import settle

SALTS = 64


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes first in ``order`` for each key (NULL is a key like any other).

    Spark's limit on the row number keeps one row per key in each task ahead of the
    shuffle, so a key holding a large share of the rows costs no more than any other.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, salt_on: str,
                    rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Cut twice: within (group, salt) and then within the group. Both cuts have Spark's
    per-task limit in front of their shuffle, and the last task of a group sees at most
    ``salts * k`` rows however large the group is.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_local", F.row_number().over(first)).filter(F.col("_local") <= k)
        .withColumn(rank, F.row_number().over(last)).filter(F.col(rank) <= k)
        .drop("_salt", "_local")
    )


def row_positions(df: DataFrame, *order: str, position: str = "position") -> DataFrame:
    """0-based position of each row by columns, whatever their values.

    Rows are dealt out in ranges of about equal count and sorted within; each range is shifted
    by the count of the earlier ones. One number per range comes to the driver. The ranges are
    stored, as their numbers hold for one sampling of the bounds only.
    """
    ordered = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, shifts = 0, []
    for row in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():
        shifts += [F.lit(row["part"]), F.lit(before)]
        before += row["count"]
    shift = F.element_at(F.create_map(*shifts), part) if shifts else F.lit(0)
    return ordered.withColumn(position, (shift + inside).cast("bigint")).drop("_at")
