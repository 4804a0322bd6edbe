"""Chunked corpora: stacking, aligning, splitting and counting chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.constants import EXPECTED_CHUNKS, UNIT_NORM_HIGH, UNIT_NORM_LOW, UNIT_NORM_ROWS
from songloom.functions.vectors import norm
from songloom.operators.groups import row_positions

POSITION = ["chunk_index", "original_index"]


def union_chunks(chunks: dict[int, DataFrame]) -> DataFrame:
    """Stack chunk tables, each row keeping the number of its chunk."""
    tagged = [df.withColumn("chunk_index", F.lit(n).cast("int")) for n, df in sorted(chunks.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def align_chunks(metadata: DataFrame, vectors: DataFrame, lyrics: DataFrame | None = None) -> DataFrame:
    """Join the parts of each chunk by row position.

    Positions run from 0 without gaps, so the inner join is exactly "trim all parts to
    the shortest".
    """
    aligned = metadata.join(vectors, POSITION)
    return aligned if lyrics is None else aligned.join(lyrics, POSITION)


def chunk_inventory(metadata: DataFrame, vectors: DataFrame, expected: list[int] | None = None) -> DataFrame:
    """For each expected chunk: rows of either part, and whether both are there."""
    spark = metadata.sparkSession
    chunks = spark.createDataFrame([(n,) for n in expected or EXPECTED_CHUNKS], "chunk_index int")
    meta = metadata.groupBy("chunk_index").agg(F.count(F.lit(1)).alias("metadata_rows"))
    vecs = vectors.groupBy("chunk_index").agg(F.count(F.lit(1)).alias("vector_rows"))
    status = F.when(F.col("present"), F.lit("loaded")).otherwise(F.lit("missing"))
    return (
        chunks.join(meta, "chunk_index", "left").join(vecs, "chunk_index", "left")
        .fillna(0, ["metadata_rows", "vector_rows"])
        .withColumn("present", (F.col("metadata_rows") > 0) & (F.col("vector_rows") > 0))
        .withColumn("status", status)
    )


def chunk_status_line(inventory: DataFrame) -> DataFrame:
    """One row, one text: which chunks are loaded and which are missing."""
    def listed(flag):
        found = F.array_sort(F.collect_list(F.when(flag, F.col("chunk_index"))))
        return F.concat(F.lit("["), F.array_join(found.cast("array<string>"), ", "), F.lit("]"))

    # Collects one number per expected chunk.
    lists = inventory.agg(listed(F.col("present")).alias("present"), listed(~F.col("present")).alias("missing"))
    loaded = F.concat(F.lit("loaded chunks "), F.col("present"))
    return lists.select(
        F.when(F.col("present") == "[]", F.lit("no chunks loaded"))
        .when(F.col("missing") == "[]", loaded)
        .otherwise(F.concat(loaded, F.lit("; missing chunks "), F.col("missing"))).alias("status_line")
    )


def chunk_sizes(rows: DataFrame) -> list[int]:
    """Rows per chunk in chunk order; one number per chunk reaches the driver."""
    return [r["count"] for r in rows.groupBy("chunk_index").count().orderBy("chunk_index").collect()]


def split_to_sizes(rows: DataFrame, order: str, sizes: list[int]) -> DataFrame:
    """Give rows, in order, to chunks 1, 2, ... of the given sizes.

    Rows beyond the last chunk are dropped; fewer rows than the sizes add up to is an error.
    """
    total = rows.count()
    if total < sum(sizes):
        raise ValueError(f"source has {total} rows, chunks need {sum(sizes)}")
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    starts = [0, *ends[:-1]]
    starts_before = F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("position"))
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("chunk_index"))
    return (
        row_positions(rows, order).filter(F.col("position") < ends[-1])
        .withColumn("chunk_index", F.size(starts_before))
        .withColumn("original_index", (F.col("position") - start).cast("bigint"))
    )


def corpus_counts(songs: DataFrame) -> DataFrame:
    """Songs per chunk, and in total on the row without a chunk number."""
    return songs.rollup("chunk_index").agg(F.count(F.lit(1)).alias("songs"))


def vector_profile(vectors: DataFrame, sample_rows: int = UNIT_NORM_ROWS) -> DataFrame:
    """Per chunk: rows, dimension, mean length of its first rows and whether they look normalised.

    Only the first rows' vectors are read; rows are counted without theirs.
    """
    rows = vectors.groupBy("chunk_index").agg(F.count(F.lit(1)).alias("vectors"))
    return rows.join(unit_flags(vectors, sample_rows), "chunk_index", "left").fillna(False, ["already_unit"])


def unit_flags(vectors: DataFrame, sample_rows: int = UNIT_NORM_ROWS) -> DataFrame:
    """Per chunk, from its first rows: dimension, mean length and whether they look normalised."""
    first = vectors.filter(F.col("original_index") < sample_rows)
    return first.groupBy("chunk_index").agg(
        F.max(F.size("embedding")).alias("dim"), F.avg(norm(F.col("embedding"))).alias("mean_norm"),
    ).withColumn("already_unit", F.coalesce(F.col("mean_norm").between(UNIT_NORM_LOW, UNIT_NORM_HIGH), F.lit(False)))


def candidates_by_chunk(candidates: DataFrame) -> DataFrame:
    """Per chunk: how many candidates it holds and the span of positions to read."""
    return candidates.groupBy("chunk_index").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min("original_index").alias("first_index"),
        F.max("original_index").alias("last_index"),
    )
