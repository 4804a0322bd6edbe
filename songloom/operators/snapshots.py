"""Vectors of lyrics kept up to date: what changed is embedded again, what is gone is dropped, nothing is done twice.

A hash of each song's lyrics lies beside its vector. An update compares the corpus with the hashes,
embeds only songs that are new or have other lyrics, and writes them, with marks for songs that
are gone, as a delta of its own. Only then does it write the manifest of the next version, which
names the deltas that make it up. A run that breaks off before that leaves a delta that no
manifest names; the next run makes its own. Every version can still be read.

The manifest is one small folder per version, written as a whole or not at all; two updates of one
version cannot both succeed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.operators.encode import Encoder, embed_texts
from songloom.operators.filters import drop_blank_lyrics

DELTA = "song_id {id}, lyrics_hash string, embedding array<float>, gone boolean, delta int"


@dataclass(frozen=True)
class Update:
    """The version an update led to, and how many songs it embedded for the first time, again, or dropped."""

    version: int
    added: int
    changed: int
    gone: int


def _deltas(spark: SparkSession, path: str, version: int | None) -> tuple[int, list[str]]:
    """A version (the newest by default; 0: none yet) and the names of its deltas."""
    try:
        rows = spark.read.parquet(f"{path}/manifest").select("version", "delta", "name")
    except AnalysisException:
        return 0, []
    # One row per delta of each version.
    found = rows.agg(F.max("version")).first()[0] or 0 if version is None else version
    return found, [r["name"] for r in rows.filter(F.col("version") == found).orderBy("delta").collect()]


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, id_type: str = "bigint") -> DataFrame:
    """(song_id, lyrics_hash, embedding, delta) of a version; ``delta`` says in which update the vector was made."""
    schema = DELTA.format(id=id_type)
    _, names = _deltas(spark, path, version)
    if not names:
        return spark.createDataFrame([], schema).drop("gone")
    rows = spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in names])
    newest = rows.groupBy("song_id").agg(F.max_by(F.struct("lyrics_hash", "embedding", "gone", "delta"), "delta").alias("s"))
    return newest.filter("NOT s.gone").select("song_id", "s.lyrics_hash", "s.embedding", "s.delta")


def update_snapshot(songs: DataFrame, path: str, load: Callable[[], Encoder] | None = None) -> Update:
    """Bring the vectors stored at ``path`` up to the given songs (``song_id, lyrics``); blank lyrics count as gone.

    Where nothing changed, no version is added.
    """
    spark, kind = songs.sparkSession, songs.schema["song_id"].dataType.simpleString()
    version, names = _deltas(spark, path, None)
    known = read_snapshot(spark, path, version, kind).select("song_id", F.col("lyrics_hash").alias("_known"))
    wanted = drop_blank_lyrics(songs.select("song_id", "lyrics")).withColumn("lyrics_hash", F.sha2("lyrics", 256))
    other = wanted.join(known, "song_id", "left").filter(~F.col("lyrics_hash").eqNullSafe(F.col("_known")))
    embedded = embed_texts(other, "lyrics", load).select(
        "song_id", "lyrics_hash", "embedding", F.lit(False).alias("gone"), F.col("_known").isNotNull().alias("again"))
    gone = known.join(wanted.select("song_id"), "song_id", "left_anti").select(
        "song_id", F.lit(None).cast("string").alias("lyrics_hash"), F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(True).alias("gone"), F.lit(True).alias("again"))
    name = f"delta-{uuid.uuid4().hex}"
    embedded.unionAll(gone).withColumn("delta", F.lit(version + 1)).write.parquet(f"{path}/{name}")
    counts = spark.read.parquet(f"{path}/{name}").agg(
        F.count_if(~F.col("again")), F.count_if(F.col("again") & ~F.col("gone")), F.count_if("gone")).first()
    if not any(counts):
        return Update(version, 0, 0, 0)
    manifest = spark.createDataFrame([(version + 1, k, n) for k, n in enumerate([*names, name], 1)], "version int, delta int, name string")
    manifest.coalesce(1).write.parquet(f"{path}/manifest/of={version + 1}")
    return Update(version + 1, *counts)
