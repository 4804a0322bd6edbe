"""The corpus stored by match key, for requests that come again and again.

A song's key is made once, when the index is stored, and its rows lie in buckets by it. A request
then joins its own keys to the stored ones: the corpus side of the plan has no key to compute and
nothing to shuffle, and where the keys are few only the buckets that can hold them are opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.functions.keys import corpus_key
from songloom.session import scratch_path

MATCH_KEY = "match_key"
BUCKETS = 64
# Keys up to this number are named in the plan, so that it opens their buckets only.
NAMED_KEYS = 1_000


def match_key(norm_title: Column, norm_artist: Column) -> Column:
    """Both halves of a key as one text, told apart whatever they hold."""
    return F.concat(F.length(norm_title).cast("string"), F.lit(":"), norm_title, norm_artist)


def store_key_index(songs: DataFrame, table: str | None = None, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Store songs, with ``norm_title, norm_artist, match_key``, as a table bucketed and sorted by key.

    Songs without a title or artist have no key and are left out, as they match nothing. The
    table gets a name of its own and lies in the shared folder unless told otherwise.
    """
    spark = songs.sparkSession
    table = table or f"songs_by_key_{uuid.uuid4().hex}"
    keyed = songs.withColumn("norm_title", corpus_key(F.col("title"))).withColumn("norm_artist", corpus_key(F.col("artist")))
    keyed = keyed.filter(F.col("norm_title").isNotNull() & F.col("norm_artist").isNotNull()).withColumn(
        MATCH_KEY, match_key(F.col("norm_title"), F.col("norm_artist")))
    # Dealt out by bucket first: every bucket is one file, sorted. A key that is far more frequent than others
    # makes its bucket large; Spark reads it in as many splits as any file where no join needs it in one.
    keyed.repartition(buckets, MATCH_KEY).write.mode("overwrite").option("path", path or scratch_path(spark, "key-index")).bucketBy(
        buckets, MATCH_KEY).sortBy(MATCH_KEY).saveAsTable(table)
    return spark.table(table)


def with_match_key(keys: DataFrame) -> DataFrame:
    return keys.withColumn(MATCH_KEY, match_key(F.col("norm_title"), F.col("norm_artist")))


def match_stored(index: DataFrame, keys: DataFrame, named: int = NAMED_KEYS) -> DataFrame:
    """Stored songs whose key is among ``keys`` (``norm_title, norm_artist``, at hand in a stored table)."""
    wanted = with_match_key(keys.select("norm_title", "norm_artist").distinct()).select(MATCH_KEY)
    # At most this many rows come to the driver.
    few = [r[MATCH_KEY] for r in wanted.limit(named + 1).collect()]
    if len(few) <= named:
        return index.filter(F.col(MATCH_KEY).isin(few)) if few else index.limit(0)
    return index.join(wanted, MATCH_KEY, "left_semi")
