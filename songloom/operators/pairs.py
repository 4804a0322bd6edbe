"""Training pairs from lyric passages.

Passages are made and drawn inside each row's own array, so pair building reads every
song once and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.constants import MIN_SONGS_PER_CHUNK, QUERY_TEMPLATES, SAMPLES_PER_EPOCH
from songloom.functions.permutation import permuted
from songloom.functions.sampling import draw, draw_number
from songloom.functions.text import first_words, passages
from songloom.operators.groups import row_positions, top_k_per_group
from songloom.session import settle


def with_passages(songs: DataFrame) -> DataFrame:
    return songs.filter(F.col("lyrics").isNotNull()).withColumn("passages", passages(F.col("lyrics")))


def passage_rows(songs: DataFrame) -> DataFrame:
    """One row per passage, numbered from 0 within its song."""
    return with_passages(songs).select("song_id", F.posexplode("passages").alias("passage_no", "passage"))


def _positives(samples: int, seed: int) -> Column:
    """Pairs drawn from a row's passages: the first two in a random order, once per draw."""
    def pair(draw_no: Column) -> Column:
        ordered = F.array_sort(F.transform("passages", lambda p, i: F.struct(
            draw(seed, F.col("song_id"), draw_no, i).alias("key"), i.alias("no"), p.alias("text"))))
        return _pair(draw_no, "positive", F.get(ordered, F.lit(0))["text"], F.get(ordered, F.lit(1))["text"])

    pairs = F.transform(F.sequence(F.lit(1), F.lit(samples)), pair)
    return F.when(F.size("passages") >= 2, pairs).otherwise(F.slice(pairs, 1, 0))


def _synthetics(samples: int, seed: int) -> Column:
    """Made-up requests: the first words of a random passage in a random template, once per draw."""
    templates = F.array(*[F.lit(t) for t in QUERY_TEMPLATES])

    def pair(draw_no: Column) -> Column:
        passage = F.array_min(F.transform("passages", lambda p, i: F.struct(
            draw(seed, "passage", F.col("song_id"), draw_no, i).alias("key"), p.alias("text"))))["text"]
        which = draw_number(seed, len(QUERY_TEMPLATES), "template", F.col("song_id"), draw_no)
        query = F.replace(F.get(templates, which), F.lit("{}"), first_words(passage))
        return _pair(draw_no, "synthetic", query, passage)

    pairs = F.transform(F.sequence(F.lit(1), F.lit(samples)), pair)
    return F.when(F.size("passages") > 0, pairs).otherwise(F.slice(pairs, 1, 0))


def _pair(draw_no: Column, kind: str, first: Column, second: Column) -> Column:
    return F.struct(draw_no.alias("draw_no"), F.lit(kind).alias("kind"),
                    first.alias("sentence_0"), second.alias("sentence_1"))


def _drawn(songs: DataFrame, pairs: Column) -> DataFrame:
    return with_passages(songs).select("song_id", F.explode(pairs).alias("p")).select("song_id", "p.*")


def positive_pairs(songs: DataFrame, samples_per_song: int = 2, seed: int = 42) -> DataFrame:
    """Pairs of two different passages of the same song, for songs that have two."""
    return _drawn(songs, _positives(samples_per_song, seed))


def synthetic_queries(songs: DataFrame, samples_per_song: int = 1, seed: int = 42) -> DataFrame:
    """A made-up request built from the first words of a passage, paired with that passage."""
    return _drawn(songs, _synthetics(samples_per_song, seed))


def training_pairs(songs: DataFrame, samples_per_song: int = 1, seed: int = 42) -> DataFrame:
    """Both kinds of pairs, from one reading of the lyrics."""
    return _drawn(songs, F.concat(_positives(samples_per_song, seed), _synthetics(samples_per_song, seed)))


def pair_counts(songs: DataFrame, samples_per_song: int = 1) -> DataFrame:
    """Songs with two passages or more, and the pairs of each kind they lead to."""
    n = F.size("passages")
    return with_passages(songs).agg(
        F.count_if(n >= 2).alias("songs_with_pairs"),
        (F.count_if(n >= 2) * samples_per_song).alias("positive_pairs"),
        (F.count_if(n > 0) * samples_per_song).alias("synthetic_pairs"),
    )


def shuffle_pairs(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Pairs in random but repeatable order; the order key stays on the row.

    The keys are random already, so spreading the rows by them and sorting each part is a
    full shuffle; a global sort would compute the pairs a second time to find its bounds.
    """
    keyed = pairs.withColumn("shuffle_key", draw(seed, "shuffle", F.col("song_id"), F.col("kind"), F.col("draw_no")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def numbered_pairs(pairs: DataFrame) -> DataFrame:
    """Stored pairs with ``pair_no``, from 0, by song, kind and draw: made once, for every epoch."""
    return row_positions(settle(pairs, "pairs"), "song_id", "kind", "draw_no", position="pair_no")


def epoch_places(numbered: DataFrame, n: int, epoch: int, seed: int = 42) -> DataFrame:
    """Pairs (``pair_no``, of ``n``) with their ``place`` in the order of an epoch; nothing is sorted or moved."""
    return numbered.withColumn("place", permuted(F.col("pair_no"), n, seed, f"epoch {epoch}"))


def epoch_shard(numbered: DataFrame, n: int, epoch: int, shard: int, shards: int, seed: int = 42) -> DataFrame:
    """The pairs of one of ``shards`` equal stretches of an epoch's order, in that order.

    All shards together are the whole epoch, each pair once. Only the shard itself is sorted.
    """
    placed = epoch_places(numbered, n, epoch, seed)
    first, end = shard * n // shards, (shard + 1) * n // shards
    return placed.filter((F.col("place") >= first) & (F.col("place") < end)).orderBy("place")


def quota_sample(songs: DataFrame, total: int, samples_per_song: int = 1, seed: int = 42) -> DataFrame:
    """The same number of random songs from each chunk, enough of them to make ``total`` pairs.

    Drawn on ids alone; only the songs drawn are looked up.
    """
    n_chunks = songs.select("chunk_index").distinct().count()
    quota = max(MIN_SONGS_PER_CHUNK, (total // max(1, n_chunks)) // (2 * samples_per_song))
    keyed = songs.select("chunk_index", "song_id", draw(seed, "song", F.col("song_id")).alias("_key"))
    drawn = top_k_per_group(keyed, ["chunk_index"], [F.col("_key"), F.col("song_id")], quota, "song_id", "sample_no")
    return songs.join(settle(drawn.drop("_key"), "sample"), ["chunk_index", "song_id"])


def epoch_pairs(songs: DataFrame, total: int = SAMPLES_PER_EPOCH, samples_per_song: int = 1, seed: int = 42
                ) -> DataFrame:
    """The pairs of one epoch: from each chunk's sample the positive pairs, then the made-up requests.

    Chunks in order; at most ``total`` pairs, numbered from 1. How many pairs each chunk and
    kind has comes to the driver, so that no row is sorted beyond its own chunk and kind.
    """
    sampled = quota_sample(songs, total, samples_per_song, seed)
    both = with_passages(sampled).select(
        "chunk_index", "sample_no", "song_id",
        F.explode(F.concat(_positives(samples_per_song, seed), _synthetics(samples_per_song, seed))).alias("p"))
    made = settle(both.select("chunk_index", "sample_no", "song_id", "p.*"), "pairs")
    groups = made.groupBy("chunk_index", "kind").count().orderBy("chunk_index", "kind").collect()
    before, shifts = 0, F.lit(None).cast("bigint")
    for row in groups:
        if before < total:
            mine = F.col("chunk_index").eqNullSafe(row["chunk_index"]) & (F.col("kind") == row["kind"])
            shifts = F.when(mine, before).otherwise(shifts)
        before += row["count"]
    # At most ``total`` rows of each chunk and kind are left to be numbered.
    numbered = top_k_per_group(made.filter(shifts.isNotNull()), ["chunk_index", "kind"],
                               [F.col("sample_no"), F.col("draw_no")], total, "song_id", "_no")
    return numbered.withColumn("pair_no", F.col("_no") + shifts).filter(F.col("pair_no") <= total).drop("_no")
