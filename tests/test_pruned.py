"""Search that skips groups finds what the whole search finds."""

import random

import pytest
from pyspark.sql import functions as F

from songloom.operators import block, pruned


def _songs(spark, n=4000, dims=8, groups=12, spread=0.05):
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, spread) for x in middles[i % groups]]
        length = sum(x * x for x in v) ** 0.5
        rows.append((i, None if i % 50 == 0 else f"t{i}", "a", rng.choice(["10", "1000", "5000000", "n/a"]), [x / length for x in v]))
    rows += [(n, "t", "a", "1", None), (n + 1, "t", "a", "1", [1.0]), (n + 2, "t", "a", "1", [None] * dims),
             *[(n + 10 + i, "same", "a", "1000", rows[7][4]) for i in range(20)]]  # ties
    return spark.createDataFrame(rows, "song_id long, title string, artist string, views string, embedding array<double>").repartition(3)


@pytest.mark.parametrize("rows_per_group", [16, 512])
def test_same_rows_as_the_whole_search(spark, rows_per_group):
    songs = _songs(spark)
    queries = songs.filter("song_id % 97 = 0 AND song_id < 4000").select(F.col("song_id").alias("query_id"), F.col("embedding").alias("q"))
    groups = pruned.store_groups(songs, rows_per_group)
    columns = ["query_id", "rank", "song_id", "raw_score", "score"]
    found = sorted(map(tuple, pruned.topk_pruned(groups, songs, queries, 7).select(*columns).collect()))
    assert found == sorted(map(tuple, block.topk_batch(songs, queries, 7).select(*columns).collect())) and len(found) == 42 * 7


def test_groups_are_skipped(spark):
    songs = _songs(spark)
    groups = pruned.store_groups(songs, 64).coalesce(1)
    one = songs.filter("song_id = 97").select(F.col("song_id").alias("query_id"), F.col("embedding").alias("q"))
    row = pruned.found_in_groups(groups, one, 5).first()
    assert row["groups"] > 60 and 0 < row["looked_at"] < row["groups"] / 2


def test_nothing_to_search(spark):
    songs = _songs(spark, 40)
    groups = pruned.store_groups(songs)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert pruned.topk_pruned(groups, songs, queries).count() == 0  # another length
    assert pruned.topk_pruned(groups, songs, queries.limit(0)).count() == 0
    assert pruned.topk_pruned(pruned.store_groups(songs.limit(0)), songs, queries).count() == 0
