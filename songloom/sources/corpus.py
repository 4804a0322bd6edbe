"""The corpus as Parquet, partitioned by chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from songloom.schema import require


def scan_metadata(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All present chunks; a filter on ``chunk_index`` reads only those folders."""
    rows = require(spark.read.parquet(path), "title", "artist", "chunk_index", *(columns or []))
    return rows.select(*columns) if columns else rows


def write_clean(songs: DataFrame, path: str) -> DataFrame:
    """Overwrite the cleaned corpus and return it as stored.

    The rebalance step gives one chunk few files of good size and splits a chunk that is
    much larger than the others over several tasks.
    """
    songs.hint("rebalance", "chunk_index").write.mode("overwrite").partitionBy("chunk_index").parquet(path)
    return songs.sparkSession.read.parquet(path).select(*songs.columns)


def write_clean_reported(songs: DataFrame, keep: Callable[[DataFrame], DataFrame], path: str, chunks: list[int]
                         ) -> tuple[DataFrame, DataFrame]:
    """Overwrite the cleaned corpus; what is stored, and rows before and after cleaning for each chunk.

    ``keep`` is the cleaning. Both counts are taken while the rows pass on their way to the files, so the
    source is read once. Rows of other chunks than those named are counted under no chunk.
    """
    def counts(name: str) -> tuple[Observation, list[Column]]:
        known = F.coalesce(F.col("chunk_index").isin(chunks), F.lit(False)) if chunks else F.lit(False)
        return Observation(name), [*[F.count_if(F.col("chunk_index") == c).alias(f"chunk_{c}") for c in chunks], F.count_if(~known).alias("other")]

    (before, asked), (after, same) = counts("rows before"), counts("rows after")
    stored = write_clean(keep(songs.observe(before, *asked)).observe(after, *same), path)
    seen = [(c, before.get[f"chunk_{c}"], after.get[f"chunk_{c}"]) for c in chunks]
    if before.get["other"]:
        seen.append((None, before.get["other"], after.get["other"]))
    report = songs.sparkSession.createDataFrame(seen, "chunk_index int, rows_before bigint, rows_after bigint").filter(
        "rows_before > 0").withColumn("none_filtered", F.col("rows_before") == F.col("rows_after"))
    return stored, report


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append vectors to those stored at ``path``; vectors of another length are an error."""
    dim = vector_length(vectors.sparkSession.read.parquet(path))
    if dim is not None:
        wrong = F.concat(F.lit(f"a vector to append does not have {dim} numbers but "), F.size("embedding").cast("string"))
        fits = F.coalesce(F.size("embedding") == dim, F.lit(True))
        vectors = vectors.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(wrong)))
    vectors.write.mode("append").parquet(path)


def store_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def vector_length(vectors: DataFrame) -> int | None:
    """How many numbers the vectors have, as the first one has it."""
    row = vectors.filter(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    return row[0] if row else None


def store_bucketed(rows: DataFrame, table: str, buckets: int) -> DataFrame:
    """Keep rows as a table bucketed by song: tables with equal buckets join without a shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, "song_id").sortBy("song_id").saveAsTable(table)
    return rows.sparkSession.table(table)
