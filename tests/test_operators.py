import random

import pytest
from pyspark.sql import functions as F

from songloom.constants import VIEW_EDGES
from songloom.operators import block, chunks, encode, filters, groups, histogram, matching, pairs, rank, search
from songloom.plans import recommend
from songloom.sources import corpus as corpus_files

SONG = "song_id bigint, title string, artist string, tag string, language string, year string, views string, " \
       "chunk_index int, original_index bigint, lyrics string"


@pytest.fixture(scope="module")
def songs(spark):
    return spark.createDataFrame([
        (0, " Blue Sky ", "Ann", "Pop", "en", "1999", "1000", 1, 0, "a\n\nb"),
        (1, "blue sky", "ANN", "rock", "es", "1799", "20", 1, 1, "  "),
        (2, None, "Ann", "rap", "en", "2001", "n/a", 1, 2, "la"),
        (3, "Rain", "Bob", None, "fr", "unknown", "-5", 2, 0, None),
        (4, "Rain", "Bob", "ROCK", "en", "1800", "1000000", 2, 1, "x y z"),
        (5, "", "", "pop", "en", None, None, 2, 2, "text"),
    ], SONG)


def ids(df, column="song_id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_cleaning_rules(songs):
    assert ids(filters.year_filter(songs)) == [0, 2, 4]
    assert ids(filters.language_filter(songs)) == [0, 1, 2, 4, 5]
    cleaned = filters.clean_corpus(songs)
    assert ids(cleaned) == [0, 2, 4]
    assert ids(filters.clean_corpus(cleaned)) == [0, 2, 4]
    report = {r["chunk_index"]: tuple(r)[1:] for r in filters.clean_report(songs).collect()}
    assert report == {1: (3, 2, False), 2: (3, 1, False)}


def test_nan_year_is_dropped(spark):
    years = spark.createDataFrame([(1, float("nan")), (2, 1800.0)], "song_id int, year double")
    assert ids(filters.year_filter(years)) == [2]


def test_genre_filter(songs):
    assert ids(filters.genre_filter(songs, ["POP ", "rock"])) == [0, 1, 4, 5]
    assert filters.genre_filter(songs, ["", " "]).count() == 6
    assert filters.genre_filter(songs.drop("tag"), ["pop"]).count() == 6


def test_dropping_rows(songs):
    assert ids(filters.drop_unidentified(songs)) == [0, 1, 3, 4, 5]
    assert ids(filters.drop_blank_lyrics(songs)) == [0, 2, 4, 5]
    assert ids(filters.valid_views(songs)) == [0, 1, 4]


def test_search_titles(songs):
    assert ids(filters.search_titles(songs, "blue|rain")) == [0, 1, 3, 4]
    assert ids(filters.search_titles(songs, "blue", "^ann$")) == [0, 1]
    assert ids(filters.search_titles(songs, "blue", case_sensitive=True)) == [1]
    assert filters.search_titles(songs, " ", "").count() == 6
    assert filters.search_titles(songs, "b.ue", literal=True).count() == 0


def test_watchlist(songs):
    found = {r["term"]: (r["matches"], r["found"]) for r in filters.watchlist_found(songs, ["BLUE", "snow"]).collect()}
    assert found == {"BLUE": (2, True), "snow": (0, False)}
    assert sorted((r["term"], r["song_id"]) for r in filters.watchlist_matches(songs, ["BLUE", "sky"]).collect()) == [
        ("BLUE", 0), ("BLUE", 1), ("sky", 0), ("sky", 1)]


def test_training_columns(songs):
    rows = filters.training_columns(songs.drop("song_id", "artist"))
    assert rows.columns == ["song_id", "title", "lyrics"]
    assert rows.count() == 5
    with pytest.raises(ValueError, match="lyrics"):
        filters.training_columns(songs.drop("lyrics"))


def test_split_to_sizes(spark):
    rows = spark.range(10).withColumn("n", F.col("id") * 100_000 + 7)
    split = {r["id"]: (r["chunk_index"], r["original_index"]) for r in chunks.split_to_sizes(rows, "n", [3, 0, 4]).collect()}
    assert split == {0: (1, 0), 1: (1, 1), 2: (1, 2), 3: (3, 0), 4: (3, 1), 5: (3, 2), 6: (3, 3)}
    with pytest.raises(ValueError, match="chunks need 11"):
        chunks.split_to_sizes(rows, "n", [11])


def test_row_positions_need_no_dense_keys(spark):
    keys = sorted(random.Random(1).sample(range(10**9), 500))
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(4)
    placed = groups.row_positions(rows, "k")
    by_key = {r["k"]: r["position"] for r in placed.collect()}
    assert [by_key[k] for k in keys] == list(range(500))
    assert "SinglePartition" not in placed._jdf.queryExecution().executedPlan().toString()
    assert groups.row_positions(rows.limit(0), "k").count() == 0


def test_align_and_inventory(spark, songs):
    vectors = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "chunk_index int, original_index bigint, embedding array<float>")
    assert ids(chunks.align_chunks(songs.drop("lyrics"), vectors, songs.select(*chunks.POSITION, "lyrics"))) == [0, 1]
    inventory = chunks.chunk_inventory(songs, vectors)
    assert {r["chunk_index"]: r["status"] for r in inventory.collect()} == {1: "loaded", 2: "missing", 3: "missing", 4: "missing"}
    assert chunks.chunk_status_line(inventory).first()[0] == "loaded chunks [1]; missing chunks [2, 3, 4]"
    assert chunks.chunk_status_line(chunks.chunk_inventory(songs, vectors, [1])).first()[0] == "loaded chunks [1]"
    assert chunks.chunk_status_line(chunks.chunk_inventory(songs, vectors, [9])).first()[0] == "no chunks loaded"


def test_union_chunks_keeps_provenance(songs):
    parts = {2: songs.select("song_id", "title"), 1: songs.select("song_id", "artist")}
    stacked = chunks.union_chunks(parts)
    assert stacked.groupBy("chunk_index").count().count() == 2 and stacked.count() == 12


def test_vector_profile_and_normalising(spark):
    rows = [(1, i, i, [1.0, 0.0]) for i in range(3)] + [(2, i, 10 + i, [3.0, 4.0]) for i in range(3)] + [(2, 3, 13, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_index int, original_index bigint, song_id bigint, embedding array<double>")
    profile = {r["chunk_index"]: (r["vectors"], r["dim"], r["mean_norm"], r["already_unit"])
               for r in chunks.vector_profile(vectors).collect()}
    assert profile == {1: (3, 2, 1.0, True), 2: (4, 2, 3.75, False)}
    assert chunks.vector_profile(vectors, 3).filter("chunk_index = 2").first()["mean_norm"] == 5.0
    done = {r["song_id"]: r["embedding"] for r in search.normalise_if_needed(vectors).collect()}
    assert done[0] == [1.0, 0.0] and done[10] == [0.6, 0.8] and done[13] == [0.0, 0.0]


def scan_of(df):
    """The filters that reach the Parquet scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters"):].split("]")[0]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "en", "1990", "t", "a", 1)],
                          "song_id bigint, language string, year string, title string, artist string, original_index bigint"
                          ).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert "In(language" in scan_of(filters.language_filter(stored))
    assert "In(language" in scan_of(filters.clean_corpus(stored))
    assert "IsNotNull(title)" in scan_of(filters.drop_unidentified(stored))
    assert filters.clean_report(stored.withColumn("chunk_index", F.lit(1))).first()["rows_after"] == 1


def test_only_the_first_vectors_are_read_for_the_profile(spark, tmp_path):
    spark.createDataFrame([(1, i, [1.0]) for i in range(9)], "chunk_index int, original_index bigint, embedding array<float>"
                          ).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    plan = chunks.vector_profile(stored)._jdf.queryExecution().executedPlan().toString()
    scans = [part for part in plan.split("FileScan")[1:] if "embedding" in part.split("ReadSchema")[1].split(">")[0]]
    assert len(scans) == 1 and "LessThan(original_index,512)" in scans[0]


def test_a_number_repeats_its_text_twice(spark):
    views = spark.range(5).select(F.concat(F.lit("marker"), F.col("id").cast("string")).alias("views"))
    plan = filters.valid_views(views)._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line)
    assert condition.count("marker") <= 3


def test_a_histogram_reads_its_number_once(spark, tmp_path):
    """Neither the bins nor the join with them repeat the expression that the number is made from."""
    spark.createDataFrame([("1",), ("x",)], "views string").write.parquet(str(tmp_path / "v"))
    views = filters.valid_views(spark.read.parquet(str(tmp_path / "v")))
    for made in (histogram.histogram_edges(views), histogram.histogram_equal(views)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("try_cast") <= 4


def test_histograms(spark):
    values = spark.createDataFrame([(v,) for v in (0.0, 99.9, 100.0, 10_000_000.0, 10_000_001.0)], "views double")
    counts = {r["bin"]: r["songs"] for r in histogram.histogram_edges(values).collect()}
    assert counts == {**{i: 0 for i in range(1, len(VIEW_EDGES))}, 1: 2, 2: 1, 9: 1}
    equal = {r["bin"]: r["songs"] for r in histogram.histogram_equal(values).collect()}
    assert equal == {**{i: 0 for i in range(1, 11)}, 1: 3, 10: 1}
    assert histogram.trimmed_count(values).first()[0] == 1
    for edges in ([-1, 5], [5, 1]):
        with pytest.raises(ValueError):
            histogram.histogram_edges(values, edges)


TRACK = "request_id bigint, query_no int, page_no bigint, playlist_pos int, track_pos int, track_id string, name string, " \
        "artist_name string, url string, image_url string"


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame([
        (1, 2, 1, 0, 0, "a", "BLUE SKY", " ann", "late", None),
        (1, 1, 1, 0, 1, "a", "blue sky ", "Ann", "first", "img"),
        (1, 1, 1, 0, 2, None, "Rain", "Bob", "rain", None),
        (1, 1, 1, 0, 3, None, "Snow", "Bob", "snow", None),
        (2, 1, 1, 0, 0, "b", "Rain", None, "nobody", None),
        (2, 1, 1, 0, 1, "c", None, None, "blank", None),
    ], TRACK)


def test_dedup_tracks_treats_a_missing_id_as_one_track(tracks):
    once = matching.dedup_tracks(tracks, matching.SEEN_ORDER, ["request_id"])
    assert ids(once, "url") == ["blank", "first", "nobody", "rain"]


def test_matching(songs, tracks):
    assert ids(matching.match_candidates(songs, tracks)) == [0, 1, 3, 4, 5]
    assert ids(matching.match_candidates_strict(songs, tracks)) == [0, 1, 3, 4]
    attached = matching.attach_track_attrs(matching.match_candidates(songs, tracks), tracks, matching.SEEN_ORDER)
    assert {r["song_id"]: r["url"] for r in attached.collect()} == {0: "first", 1: "first", 3: "rain", 4: "rain", 5: "blank"}


def test_names_keep_counts_and_first_song(songs, tracks, spark):
    requests = spark.createDataFrame([(1, ["Rock"]), (2, [])], "request_id bigint, genres array<string>")
    keys = matching.request_keys(requests, tracks)
    names = matching.match_names(songs.unionByName(songs.withColumn("song_id", F.col("song_id") + 10)), keys)
    found = {(r["request_id"], r["song_id"]): r["copies"] for r in names.collect()}
    assert found == {(1, 0): 2, (1, 1): 2, (1, 3): 2, (1, 4): 2, (2, 5): 2}


def test_dedup_corpus(songs):
    assert ids(matching.dedup_corpus(songs)) == [0, 2, 4, 5]


def test_enrich_hits(songs, spark):
    hits = spark.createDataFrame([(4, "Rain", "Bob"), (9, "Gone", "Bob")], "song_id bigint, title string, artist string")
    rows = {r["song_id"]: r for r in matching.enrich_hits(hits, songs).collect()}
    assert {r["url"] for r in rows.values()} == {"None"}
    assert (rows[4]["genre"], rows[4]["album"], rows[4]["duration_ms"]) == ("Unknown Genre", "Unknown Album", 180000)
    assert rows[9]["genre"] == "Unknown Genre"
    with_album = songs.filter("song_id = 4").withColumn("album", F.lit("LP")).withColumn("duration_ms", F.lit(1))
    row = matching.enrich_hits(hits, with_album).filter("song_id = 4").first()
    assert (row["album"], row["genre"], row["duration_ms"]) == ("LP", "ROCK", 1)


def test_restrict_flag_lookup(songs, spark):
    hits = spark.createDataFrame([(4, "Rain", "Bob", 0.5)], "song_id bigint, title string, artist string, s double")
    assert ids(matching.restrict_to_hits(songs, hits)) == [3, 4]
    flagged = matching.flag_in_final(songs.select("song_id", "title", "artist"), hits)
    assert {r["song_id"] for r in flagged.filter("in_final").collect()} == {3, 4}
    missing = hits.select("song_id", "s").union(spark.createDataFrame([(77, 0.1)], "song_id bigint, s double"))
    assert ids(matching.lookup_ids(missing, songs)) == [4]


def test_pick_playlists(spark):
    def playlist(request, phrase, page, pos, n, first=0, total=None, name=None):
        return [(request, phrase, page, pos, name or page, total or n, i, f"t{first + i}") for i in range(n)]
    schema = ("request_id int, query_no int, page_no int, playlist_pos int, playlist_id int, playlist_total int, "
              "track_pos int, track_id string")
    rows = (playlist(1, 1, 1, 0, 3) + playlist(1, 1, 2, 0, 20) + playlist(1, 1, 3, 0, 50) + playlist(1, 2, 4, 0, 25, 10)
            + playlist(2, 1, 5, 0, 101))
    picked = matching.pick_playlists(spark.createDataFrame(rows, schema), 5, 100, 30).orderBy("rank").collect()
    assert [r["track_id"] for r in picked] == [f"t{i}" for i in range(30)]
    assert {r["request_id"] for r in picked} == {1}
    # On a page the place decides, not the id; the size is the stated one.
    page = playlist(1, 1, 1, 0, 6, 100, name=900) + playlist(1, 1, 1, 2, 6, 200, name=100)
    assert {r["playlist_id"] for r in matching.pick_playlists(spark.createDataFrame(page, schema), 5, 100, 30).collect()} == {900}
    stated = playlist(1, 1, 1, 0, 6, total=400, name=900) + playlist(1, 1, 1, 1, 3, total=7, name=100)
    assert {r["playlist_id"] for r in matching.pick_playlists(spark.createDataFrame(stated, schema), 5, 100, 30).collect()} == {100}


def test_flatten_skips_missing_playlists_and_tracks(spark):
    from songloom.schema import PLAYLIST_PAGE
    track = ("t1", "Song", [("Ann",)], ("http://u",), ([("http://i",)],))
    bare = ("t2", None, None, None, None)
    pages = spark.createDataFrame([(1, 1, 1, [None, (7, "p", [(track,), (None,), (bare,)])]), (1, 2, 1, None)], PLAYLIST_PAGE)
    rows = matching.track_fields(matching.flatten_playlists(pages)).orderBy("track_pos").collect()
    assert [(r["playlist_pos"], r["track_pos"], r["name"], r["artist_name"], r["url"], r["image_url"]) for r in rows] == [
        (1, 0, "Song", "Ann", "http://u", "http://i"), (1, 2, None, "", None, None)]


def test_top_k_per_group_with_one_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("g"), "id", (F.col("id") * 7919 % 1000).alias("s"))
    best = groups.top_k_per_group(rows, ["g"], [F.col("s").desc(), F.col("id")], 5, "id", salts=4)
    wanted = {}
    for r in sorted(rows.collect(), key=lambda r: (-r["s"], r["id"])):
        wanted.setdefault(r["g"], []).append(r["id"])
    found = {}
    for r in best.orderBy("g", "rank").collect():
        found.setdefault(r["g"], []).append(r["id"])
    assert found == {g: v[:5] for g, v in wanted.items()}


def test_ranked_groups_are_cut_before_the_shuffle(spark):
    rows = spark.range(100_000).select((F.col("id") % 3).alias("g"), "id")
    for cut in (groups.first_per_key(rows, ["g"], ["id"]), groups.top_k_per_group(rows, ["g"], [F.col("id")], 2000, "id")):
        plan = cut._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.rindex("Exchange hashpartitioning"):]
        assert "WindowGroupLimit" in below and "Partial" in below


@pytest.fixture(scope="module")
def corpus(spark):
    numbers = random.Random(3)
    rows = []
    for i in range(400):
        vector = [numbers.gauss(0, 1) for _ in range(8)]
        length = sum(x * x for x in vector) ** 0.5
        rows.append((i, None if i % 17 == 0 else f"title {i % 40}", f"artist {i % 4}", str(10 ** (i % 8)) if i % 5 else "n/a",
                     [x / length for x in vector]))
    rows += [(400 + i, "twin", "artist", "100", rows[1][4]) for i in range(5)]
    rows += [(410, "no vector", "artist", "100", None)]
    return spark.createDataFrame(rows, "song_id bigint, title string, artist string, views string, embedding array<double>").cache()


@pytest.fixture(scope="module")
def queries(spark, corpus):
    return corpus.filter("song_id % 57 = 1").select(F.col("song_id").alias("query_id"), F.col("embedding").alias("q")).cache()


def brute(corpus, query, k, near=None):
    import math
    scored = []
    for r in corpus.collect():
        if r["embedding"] is None:
            continue
        raw = 0.0
        for x, y in zip(r["embedding"], query):
            raw = raw + x * y
        views = max(float(r["views"]), 1.0) if r["views"] != "n/a" else 1.0
        scored.append((raw, raw * max(0.1, 1.0 + 0.1 * (math.log10(views) - 3.0)), r["song_id"], r["title"]))
    if near:
        scored = sorted(scored, key=lambda s: (-s[0], s[2]))[:near]
    kept = [s for s in scored if s[3] is not None]
    return [s[2] for s in sorted(kept, key=lambda s: (-s[1], s[2]))[:k]]


def ranked(df, key="score"):
    return [r["song_id"] for r in df.orderBy(F.col(key).desc(), "song_id").collect()]


def test_single_query_searches(corpus, queries):
    q = queries.first()["q"]
    assert ranked(search.topk_fused(corpus, q, 7)) == brute(corpus, q, 7)
    assert ranked(search.topk_two_stage(corpus, q, 8)) == brute(corpus, q, 8, 24)
    some = corpus.filter("song_id % 2 = 1")
    assert ranked(search.topk_fused_candidates(corpus, some, q, 7)) == brute(some, q, 7)
    assert ranked(search.topk_two_stage_candidates(corpus, some, q, 8)) == brute(some, q, 8, 16)
    assert ranked(search.topk_fused_candidates(corpus, corpus, q, 7)) == ranked(search.topk_fused(corpus, q, 7))


def test_two_stage_differs_from_fused(spark):
    rows = [(i, "t", "a", "1", [1.0, 0.0]) for i in range(3)] + [(3, "t", "a", "10000000", [0.9, 0.1])]
    songs = spark.createDataFrame(rows, "song_id bigint, title string, artist string, views string, embedding array<double>")
    assert ranked(search.topk_fused(songs, [1.0, 0.0], 1)) == [3]
    assert ranked(search.topk_two_stage(songs, [1.0, 0.0], 1)) == [0]


@pytest.mark.parametrize("at_once", [1000, 2])
@pytest.mark.parametrize("fused", [True, False])
def test_batch_search_equals_single_searches(corpus, queries, fused, at_once, monkeypatch):
    monkeypatch.setattr(block, "SONG_BLOCK_ROWS", 100)
    monkeypatch.setattr(block, "QUERY_BLOCK_ROWS", 2)
    monkeypatch.setattr(block, "QUERIES_PER_SCAN", at_once)
    found = {}
    for r in block.topk_batch(corpus, queries, 6, fused).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["song_id"])
    assert found == {r["query_id"]: brute(corpus, r["q"], 6, None if fused else 18) for r in queries.collect()}


@pytest.mark.parametrize("max_pairs", [1, 1_000_000])
def test_vectors_that_do_not_fit_are_no_hits_on_any_path(spark, max_pairs):
    """Another length, or a missing number: no hit, and no other song's vector is misread."""
    songs = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5, None]), (4, [0.5, 0.5, 0.0]), (5, None), (6, [9.0] * 4), (7, [])],
        "song_id long, embedding array<double>").selectExpr(
            "song_id", "concat('t', song_id) AS title", "'a' AS artist", "'1000' AS views", "embedding", "'n' AS name")
    wanted = [(1, 1.0), (4, 0.5)]
    q = [1.0, 0.0, 0.0]
    assert [(r["song_id"], r["raw_score"]) for r in search.topk_fused(songs, q, 9).collect()] == wanted
    queries = spark.createDataFrame([(1, q)], "query_id long, q array<double>")
    assert [(r["song_id"], r["raw_score"]) for r in block.topk_batch(songs, queries, 9).orderBy("rank").collect()] == wanted
    assert block.similarity_profile(songs, queries).first()["songs"] == 2
    asked = spark.createDataFrame([(1, q)], "request_id long, q array<double>")
    names = spark.createDataFrame([(1, "n", 7)], "request_id long, name string, copies long")
    hits = recommend.vector_hits(asked, names, songs.drop("embedding"), songs.select("song_id", "embedding"), 9, None, max_pairs)
    assert [(r["song_id"], r["raw_score"]) for r in hits.orderBy("rank").collect()] == wanted


def test_tasks_give_their_best_only(spark):
    """However many batches a task reads, each query leaves it with k songs at most."""
    numbers = random.Random(5)
    rows = [(i, [numbers.gauss(0, 1) for _ in range(4)]) for i in range(3000)]
    songs = spark.createDataFrame(rows, "song_id bigint, embedding array<double>").repartition(2).withColumn("weight", F.lit(1.0))
    queries = spark.createDataFrame(rows[:20], "query_id bigint, q array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        local = block.local_best(songs, queries, 7)
        assert local.count() == 2 * 20 * 7
        assert "CoGroup" not in local._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("at_once", [1000, 2])
def test_similarity_profile(corpus, queries, at_once, monkeypatch):
    monkeypatch.setattr(block, "QUERIES_PER_SCAN", at_once)
    profile = {r["query_id"]: r for r in block.similarity_profile(corpus, queries).collect()}
    for r in queries.collect():
        scores = [sum(x * y for x, y in zip(c["embedding"], r["q"])) for c in corpus.collect() if c["embedding"]]
        row = profile[r["query_id"]]
        assert row["songs"] == len(scores)
        assert row["mean_score"] == pytest.approx(sum(scores) / len(scores))
        assert (row["lowest_score"], row["highest_score"]) == pytest.approx((min(scores), max(scores)))


def test_no_queries_give_no_rows(corpus, queries):
    assert block.topk_batch(corpus, queries.limit(0)).count() == 0


def test_rerank_rules(spark):
    hits = spark.createDataFrame([
        (1, 0.5, 80, False), (2, 0.5, None, False), (3, 0.4, None, False), (4, 0.4, 0, True)],
        "song_id bigint, vector_score double, relevance int, failed boolean")
    neutral = {r["song_id"]: (pytest.approx(r["score"]), r["relevance"]) for r in rank.rerank_neutral(hits).collect()}
    assert neutral == {1: (0.59, 80), 2: (0.50, 50), 3: (0.43, 50), 4: (0.4, 50)}
    strict = {r["song_id"]: (pytest.approx(r["score"]), r["relevance"]) for r in rank.rerank_strict(hits).collect()}
    assert strict == {1: (0.59, 80), 2: (0.5, 0), 3: (0.4, 0), 4: (0.28, 0)}


def test_fetch_lyrics_and_min_score(songs, spark):
    wanted = songs.select("song_id", *chunks.POSITION).union(spark.createDataFrame([(9, 1, 99)], "a bigint, b int, c bigint"))
    found = {r["song_id"]: r["lyrics"] for r in rank.fetch_lyrics(wanted, songs.select(*chunks.POSITION, "lyrics"), chunks.POSITION).collect()}
    assert found == {0: "a\n\nb", 1: None, 2: "la", 3: None, 4: "x y z", 5: "text", 9: None}
    scores = spark.createDataFrame([(0, 49), (2, 50), (4, 90)], "song_id bigint, relevance int")
    assert [r["song_id"] for r in rank.min_score_filter(songs, scores).collect()] == [4, 2]


def test_encoder_is_pluggable_and_unit(spark):
    import numpy as np
    texts = spark.createDataFrame([(1, "Blue blue sky"), (2, None), (3, "  ")], "song_id bigint, t string")
    rows = {r["song_id"]: r["embedding"] for r in encode.embed_texts(texts, "t").collect()}
    assert rows[2] is None and sum(rows[3]) == 0.0
    assert sorted(x for x in rows[1] if x) == pytest.approx([1 / 5 ** 0.5, 2 / 5 ** 0.5])
    own = encode.embed_texts(texts, "t", lambda: lambda batch: np.array([[len(t), 1.0] for t in batch]))
    assert {r["song_id"]: r["embedding"] for r in own.collect()} == {1: [13.0, 1.0], 2: None, 3: [2.0, 1.0]}


def test_scorer_is_pluggable(spark):
    rows = spark.createDataFrame([(1, "sad rain", "T", "A", "rain falls"), (2, "sad rain", None, "A", None)],
                                 "song_id bigint, prompt string, title string, artist string, lyrics string")
    assert {r["song_id"]: r["relevance"] for r in encode.score_relevance(rows).collect()} == {1: 50, 2: None}

    def judge(requests):
        assert all("Lyrics:" in r for r in requests)
        return ['```json\n{"score": 71}\n```' for _ in requests]

    scored = encode.score_relevance(rows, judge, concurrency=2)
    assert {r["song_id"]: r["relevance"] for r in scored.collect()} == {1: 71, 2: None}


def test_without_vectors(songs, spark):
    assert ids(encode.without_vectors(songs, spark.createDataFrame([(0,), (4,)], "song_id bigint"))) == [1, 2, 3, 5]


LYRICS = "\n\n".join(f"verse {i} " + "la " * 60 for i in range(6))


def test_training_pairs(spark):
    rows = spark.createDataFrame([(1, LYRICS), (2, "short"), (3, " "), (4, None)], "song_id bigint, lyrics string")
    positive = pairs.positive_pairs(rows, 3).collect()
    assert len(positive) == 3 and {r["song_id"] for r in positive} == {1}
    assert all(r["sentence_0"] != r["sentence_1"] for r in positive)
    synthetic = {r["song_id"]: r for r in pairs.synthetic_queries(rows).collect()}
    assert set(synthetic) == {1, 2} and "short" in synthetic[2]["sentence_0"]
    assert len(synthetic[1]["sentence_0"].split(": ")[1].split()) == 20
    both = pairs.training_pairs(rows)
    assert both.count() == 3
    assert tuple(pairs.pair_counts(rows).first()) == (1, 1, 2)
    keys = [r["shuffle_key"] for r in pairs.shuffle_pairs(both).collect()]
    assert len(set(keys)) == 3
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, pairs.training_pairs(rows).collect()))


def test_quota_sample(spark):
    rows = spark.range(1000).select(F.col("id").alias("song_id"), (F.col("id") % 4 + 1).alias("chunk_index"))
    assert pairs.quota_sample(rows, 200_000).count() == 1000
    counts = {r["chunk_index"]: r["count"] for r in pairs.quota_sample(rows, 250).groupBy("chunk_index").count().collect()}
    assert counts == {1: 100, 2: 100, 3: 100, 4: 100}


def test_an_epoch_is_cut_by_pairs(spark):
    rows = spark.range(900).select(F.col("id").alias("song_id"), (F.col("id") % 3 + 1).alias("chunk_index"), F.lit(LYRICS).alias("lyrics"))
    made = pairs.epoch_pairs(rows, 250).orderBy("pair_no").collect()
    assert [r["pair_no"] for r in made] == list(range(1, 251))
    assert [(r["chunk_index"], r["kind"]) for r in made] == (
        [(1, "positive")] * 100 + [(1, "synthetic")] * 100 + [(2, "positive")] * 50)
    assert pairs.epoch_pairs(rows, 10_000).count() == 1800
    assert pairs.epoch_pairs(rows.limit(0), 10).count() == 0


def test_quota_sample_of_a_large_chunk_is_the_lowest_keys(spark):
    from songloom.functions.sampling import draw
    rows = spark.range(20_000).select(F.col("id").alias("song_id"), F.lit(1).alias("chunk_index"))
    found = ids(pairs.quota_sample(rows, 400))
    lowest = rows.orderBy(draw(42, "song", F.col("song_id"))).limit(200)
    assert found == ids(lowest)


def test_epoch_shards_are_the_epoch(spark):
    made = spark.range(50).selectExpr("id AS song_id", "'positive' AS kind", "1 AS draw_no")
    numbered = pairs.numbered_pairs(made.repartition(3))
    whole = [r["song_id"] for r in pairs.epoch_places(numbered, 50, 2).orderBy("place").collect()]
    parts = [r["song_id"] for k in range(3) for r in pairs.epoch_shard(numbered, 50, 2, k, 3).collect()]
    assert parts == whole and sorted(whole) == list(range(50))
    shard = pairs.epoch_places(numbered, 50, 2).filter("place < 10")
    assert "Exchange" not in shard._jdf.queryExecution().executedPlan().toString()


def test_the_write_reports_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "2000", "en"), (2, 1, "1700", "en"), (3, 2, "2001", "es"), (4, None, "2001", "fr"), (5, 9, "2001", "en")],
                                 "song_id long, chunk_index int, year string, language string")
    stored, report = corpus_files.write_clean_reported(rows, filters.clean_corpus, str(tmp_path / "out"), [1, 2, 3])
    assert sorted(r["song_id"] for r in stored.collect()) == [1, 3, 5]
    assert sorted(map(tuple, report.collect()), key=str) == sorted([(1, 2, 1, False), (2, 1, 1, True), (None, 2, 1, False)], key=str)
