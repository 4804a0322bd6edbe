"""Matching from the corpus stored by key: same rows, no key made and nothing of the corpus shuffled."""

import pytest
from pyspark.sql import functions as F

from songloom.operators import matching
from songloom.session import settle
from songloom.sources import key_index

SONGS = [(1, "  Song A ", "X"), (2, "song a", "x "), (3, None, "X"), (4, "Song B", None), (5, "ab", "c"), (6, "a", "bc"),
         (7, "", ""), (8, "Song A", "Y"), *[(100 + i, f"t{i}", "hot") for i in range(300)], *[(500 + i, "hot", "hot") for i in range(200)]]


@pytest.fixture(scope="module")
def songs(spark):
    return spark.createDataFrame(SONGS, "song_id long, title string, artist string").withColumn(
        "tag", F.lit("Pop")).withColumn("views", F.lit("1"))


@pytest.fixture(scope="module")
def index(songs):
    return key_index.store_key_index(songs, buckets=8)


def _keys(spark, names):
    tracks = spark.createDataFrame(names, "name string, artist_name string")
    return settle(matching.distinct_keys(tracks), "keys")


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("named", [0, 1000])
def test_the_index_gives_what_the_corpus_gives(spark, songs, index, named):
    keys = _keys(spark, [("SONG A", "X"), ("a", "bc"), ("a:b", "c"), ("", ""), ("hot", "hot"), ("no such", "one"), (None, "X")])
    columns = ["song_id", "title", "artist", "norm_title", "norm_artist"]
    plain = matching.match_keys(songs, keys).select(*columns).collect()
    stored = key_index.match_stored(index, keys, named).select(*columns).collect()
    assert sorted(map(tuple, stored)) == sorted(map(tuple, plain)) and len(plain) > 200


def test_no_keys_and_an_empty_corpus(spark, songs, index):
    assert matching.match_keys(index, _keys(spark, [("x", "y")]).limit(0)).count() == 0
    assert matching.match_keys(key_index.store_key_index(songs.limit(0)), _keys(spark, [("x", "y")])).count() == 0


def test_few_keys_open_their_buckets_only(spark, index):
    keys = _keys(spark, [("song a", "x"), ("t7", "hot")])
    found = matching.match_keys(index, keys)
    plan = _plan(found)
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert sum(len(p.files()) for p in scan.inputRDDs().head().partitions()) <= 2
    assert "Exchange" not in plan and "lower" not in plan and "regexp" not in plan


def test_many_keys_leave_the_corpus_where_it_is(spark, index):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = _keys(spark, [(f"t{i}", "hot") for i in range(250)])
        plan = _plan(key_index.match_stored(index, keys, 10))
        scan = next(i for i, line in enumerate(plan.splitlines()) if "songs_by_key" in line)
        above = plan.splitlines()[max(0, scan - 4):scan]  # sort, filter and projection of the corpus' side
        assert "Bucketed: true" in plan and "lower" not in plan and not [x for x in above if "Exchange" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
