import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_results import compare, open_tables
from songloom import session
from songloom.operators import block
from songloom.plans import recommend as plan
from songloom.plans.catalog import Data
from songloom.session import scratch_path, settle, shared_dir

SMALL = "/root/testdata/sf0.001"
QUERIES = sorted(entry.QUERIES)


@pytest.fixture(scope="module")
def tables():
    return open_tables(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, tables, name):
    same, note = compare(spark, tables, SMALL, name)
    assert same, note


def test_every_query_has_its_sql():
    assert set(entry.CHECKS) == set(entry.QUERIES)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == plan.RESULT and rows.count() > 0


def ranks(df):
    return {(r["request_id"], r["rank"]): (r["song_id"], round(r["score"], 9)) for r in df.collect()}


@pytest.mark.parametrize("overfetch", [2, None])
def test_common_names_scored_in_blocks_give_the_same_hits(spark, overfetch, monkeypatch):
    """The same rows to the last bit, with equal vectors under rare and common names and missing ones."""
    d = Data(spark, "/root/testdata/sf0.01")
    asked, songs = d.requests, d.metadata
    # A name that a third of the songs share; every vector stands twice, some are missing.
    songs = songs.withColumn("title", F.when(F.col("song_id") % 3 == 0, F.lit("Song 1")).otherwise(F.col("title"))).withColumn(
        "artist", F.when(F.col("song_id") % 3 == 0, F.lit("SRC1")).otherwise(F.col("artist"))).withColumn(
        "tag", F.when(F.col("song_id") % 3 != 0, F.col("tag"))).withColumn("views", F.lit("1000"))
    twin = d.lyric_vectors.select((F.col("song_id") + 1 - 2 * (F.col("song_id") % 2)).alias("song_id"), "embedding")
    vectors = d.lyric_vectors.filter("song_id % 2 = 0").unionByName(twin.filter("song_id % 2 = 1")).withColumn(
        "embedding", F.when(F.col("song_id") % 50 != 3, F.col("embedding")))
    found = plan.match(asked, d.page_tracks, songs)
    assert found.names.agg(F.max("copies")).first()[0] > 300

    def hits(**more):
        rows = plan.vector_hits(asked, found.wanted(), found.songs, vectors, 20, overfetch, **more).collect()
        return {(r["request_id"], r["rank"]): (r["song_id"], r["score"]) for r in rows}

    plain = hits(max_pairs=10**6)
    assert plain and not any(song % 50 == 3 for song, _ in plain.values())
    monkeypatch.setattr(block, "SONG_BLOCK_ROWS", 50)
    monkeypatch.setattr(block, "QUERY_BLOCK_ROWS", 4)
    assert hits(max_pairs=100) == plain
    assert hits(max_pairs=1) == plain


def test_lower_scored_songs_do_not_change_the_top(spark):
    d = Data(spark, SMALL)
    out = plan.recommend(d.requests, d.tracks, d.metadata, d.lyric_vectors, d.song_lyrics, top_k=3)
    more = d.metadata.withColumn("song_id", F.col("song_id") + 100_000).withColumn("views", F.lit("1"))
    opposite = d.lyric_vectors.select((F.col("song_id") + 100_000).alias("song_id"),
                                      F.transform("embedding", lambda x: x * F.lit(0.0).cast("float")).alias("embedding"))
    positive = {k: v for k, v in ranks(out).items() if v[1] > 0.3}
    again = ranks(plan.recommend(d.requests, d.tracks, d.metadata.unionByName(more),
                                 d.lyric_vectors.unionByName(opposite), d.song_lyrics, top_k=3))
    assert positive and {k: again[k] for k in positive} == positive


def test_recommend_reads_large_tables_in_place(spark):
    """With few requests, vectors and lyrics are joined by broadcast of the other side."""
    d = Data(spark, SMALL)
    asked = d.requests
    found = plan.match(asked, d.tracks, d.metadata)
    hits = plan.vector_hits(asked, found.wanted(), found.songs, d.lyric_vectors)
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "documents.parquet" not in text  # the metadata has been read by the match


def test_a_request_without_a_vector_is_an_error(spark):
    requests = spark.createDataFrame([(1, None, [])], "request_id bigint, prompt string, genres array<string>")
    with pytest.raises(Exception, match="no vector for request 1"):
        plan.encoded(requests, None, 16).collect()
    given = requests.withColumn("q", F.array(F.lit(1.0)))
    assert plan.encoded(given, None, 16).first()["q"] == [1.0]


def test_every_request_has_songs(spark):
    d = Data(spark, SMALL)
    assert d.asked_songs.select("request_id").distinct().count() == d.openings.count()


def test_scratch_can_be_removed():
    """In a session of its own, as it removes what the other tests still read."""
    code = """
import os
from songloom.session import build_session, remove_scratch, settle
spark = build_session(master="local[1]")
folder = os.path.dirname(settle(spark.range(5), "numbers").inputFiles()[0].removeprefix("file://"))
assert os.path.isdir(folder) and remove_scratch(spark) == 1 and not os.path.exists(folder)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)), timeout=120)


def test_settled_table_is_below_the_shared_folder(spark):
    rows = settle(spark.range(5), "numbers")
    assert rows.count() == 5
    assert rows.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file:"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_asked_is_asked_songs_of_some_songs(spark):
    d = Data(spark, SMALL)
    some = d.songs.filter("song_id % 3 = 1")
    columns = ["song_id", "title", "request_id", "prompt"]
    wanted = d.asked_songs.filter("song_id % 3 = 1").select(*columns).collect()
    assert wanted and sorted(map(str, d.asked(some).select(*columns).collect())) == sorted(map(str, wanted))


def test_prompts_and_queries_go_to_the_songs(spark, monkeypatch):
    """Lyrics are met by hits that have their prompt already, vectors by pairs that have their query: neither moves once a hit."""
    d, seen = Data(spark, SMALL), []
    fetch = plan.fetch_lyrics
    monkeypatch.setattr(plan, "fetch_lyrics", lambda hits, *more, **named: seen.append(hits.columns) or fetch(hits, *more, **named))
    asked = d.requests
    found = plan.match(asked, d.tracks, d.metadata)
    hits = plan.vector_hits(asked, found.wanted(), found.songs, d.lyric_vectors)
    assert plan.recommend(asked, d.tracks, d.metadata, d.lyric_vectors, d.song_lyrics, matched=found).count() > 0
    assert "prompt" in seen[0]
    joins = [line for line in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "song_id" in joins[0] and "request_id" in joins[1]


def test_payload_files_are_packed(spark):
    assert all(f.endswith(".snappy") for f in Data(spark, SMALL).stored_pages.inputFiles())


def test_events_of_a_part_arrive_in_many_files(spark):
    entry.QUERIES["job_machine_stream"](spark, SMALL).collect()
    arriving = [p for p in session._scratch[spark.sparkContext.applicationId] if "/events-in-" in p][-1]
    files = [f for f in os.listdir(arriving) if f.endswith(".parquet")]
    assert len(files) > 3
