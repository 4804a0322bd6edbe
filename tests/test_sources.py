import csv
import io
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from songloom.sources import corpus, csv_corpus, npy, playlists


def write_csv(path, rows):
    with open(path, "w", newline="") as out:
        csv.writer(out).writerows(rows)


def test_lyrics_csv_keeps_breaks_quotes_and_positions(spark, tmp_path):
    write_csv(tmp_path / "song_lyrics_chunk_1.csv", [["title", "lyrics"], ["A", 'one\n"two"\n\nthree, four'], ["B", ""]])
    write_csv(tmp_path / "song_lyrics_chunk_3.csv", [["title", "lyrics"], ["NA", " x "]])
    rows = csv_corpus.scan_lyrics_csv(spark, str(tmp_path)).orderBy("chunk_index", "original_index").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "A", 'one\n"two"\n\nthree, four'), (1, 1, "B", None), (3, 0, "NA", " x ")]
    only = csv_corpus.scan_lyrics_csv(spark, str(tmp_path), ["lyrics"])
    assert only.columns == ["chunk_index", "original_index", "lyrics"]
    missing = csv_corpus.scan_lyrics_csv(spark, str(tmp_path), na_values=["NA", "nan"])
    assert missing.filter("title IS NULL").count() == 1


def test_csv_files_with_columns_in_another_order(spark, tmp_path):
    write_csv(tmp_path / "other_columns_chunk_1.csv", [["title", "artist"], ["T1", "A1"]])
    write_csv(tmp_path / "other_columns_chunk_2.csv", [["artist", "title", "views"], ["A2", "T2", "5"]])
    rows = csv_corpus.scan_metadata_csv(spark, str(tmp_path)).orderBy("chunk_index").collect()
    assert [(r["title"], r["artist"], r["views"]) for r in rows] == [("T1", "A1", None), ("T2", "A2", "5")]


def test_csv_without_a_needed_column(spark, tmp_path):
    write_csv(tmp_path / "song_lyrics_chunk_1.csv", [["title", "words"], ["A", "x"]])
    with pytest.raises(ValueError, match="lyrics.*there are: title, words"):
        csv_corpus.scan_lyrics_csv(spark, str(tmp_path))


@pytest.mark.parametrize("range_bytes", [7, 64, 1000, 1 << 20])
def test_one_csv_is_read_in_ranges(spark, tmp_path, range_bytes):
    """Records that begin in any block, with breaks, quotes, commas and blank lines everywhere."""
    rng = random.Random(range_bytes)
    bits = ['"', '""', "\n", "\r\n", ",", "a", "é", "\n\n", " ", "x" * 30]
    rows = [["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(3)] for _ in range(60)]
    with open(tmp_path / "song_lyrics_chunk_2.csv", "w", newline="", encoding="utf-8-sig") as out:
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows([["a\n1", "lyrics", "c"], *rows[:30]])
        out.write("\n\r\n")
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n").writerows(rows[30:])
    write_csv(tmp_path / "song_lyrics_chunk_3.csv", [["lyrics"]])
    (tmp_path / "song_lyrics_chunk_4.csv").write_text("")
    found = csv_corpus.scan_lyrics_csv(spark, str(tmp_path), range_bytes=range_bytes)
    assert found.rdd.getNumPartitions() >= min(20, (tmp_path / "song_lyrics_chunk_2.csv").stat().st_size // range_bytes)
    got = sorted(map(tuple, found.select("chunk_index", "original_index", "`a\n1`", "lyrics", "c").collect()))
    assert got == [(2, i, *[v or None for v in row]) for i, row in enumerate(rows)]


def test_every_block_boundary_is_right():
    text = b'h,"l"\n1,"a\n""b"\n\n2,""\r\n\r\n"3\n","\n"\n4,x'
    plain = [r for r in csv.reader(io.StringIO(text.decode(), newline="")) if r][1:]
    for cuts in itertools.combinations(range(1, len(text)), 2):
        edges = [0, *cuts, len(text)]
        blocks = []
        for block, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            data = np.frombuffer((b"\n" if a == 0 else text[a - 1:a]) + text[a:z + 2], np.uint8)
            end = z == len(text)
            if not end:
                data = np.concatenate([data, np.zeros(z - a + 3 - len(data), np.uint8)])
            quotes, starts = csv_corpus._record_starts(data, end)
            starts = [s[s + a - 1 >= 6] for s in starts]
            blocks.append({"path": "f", "begin": a, "end": z, "quotes": quotes, "header": text[:6],
                           "first": [int(s[0]) + a - 1 if len(s) else -1 for s in starts], "records": [len(s) for s in starts]})
        ranges = csv_corpus._ranges(blocks, 1, 0)
        assert sum(r.rows for r in ranges) == len(plain) == 4
        read = [row for r in ranges for row in csv.reader(io.StringIO(text[r.begin:r.end].decode(), newline="")) if row]
        assert read == plain and [r.row for r in ranges] == np.cumsum([0, *[r.rows for r in ranges[:-1]]]).tolist()


def test_csv_that_is_not_as_it_should_be(spark, tmp_path):
    for name, text in (("open", 'lyrics,b\n"x,1\n'), ("short", "lyrics,b\nx\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "song_lyrics_chunk_1.csv").write_text(text)
        with pytest.raises(Exception, match="ends within quotes|Expected 2 columns"):
            csv_corpus.scan_lyrics_csv(spark, str(tmp_path / name)).collect()


def test_files_that_only_spark_opens(spark, tmp_path, monkeypatch):
    write_csv(tmp_path / "song_lyrics_chunk_1.csv", [["title", "lyrics"], ["A", "one\ntwo"], ["B", ""]])
    (tmp_path / "song_lyrics_chunk_2.csv").write_text("lyrics\nx\n")
    ranges = csv_corpus.scan_lyrics_csv(spark, str(tmp_path)).collect()
    monkeypatch.setattr(csv_corpus, "_openable", lambda uri: False)
    files = csv_corpus.scan_lyrics_csv(spark, str(tmp_path)).collect()
    assert sorted(map(repr, ranges)) == sorted(map(repr, files)) and len(files) == 3


def test_metadata_csv(spark, tmp_path):
    write_csv(tmp_path / "other_columns_chunk_2.csv", [["title", "artist", "views"], ["A", "X", "1"], ["B", "Y", "n/a"]])
    rows = csv_corpus.scan_metadata_csv(spark, str(tmp_path)).orderBy("original_index").collect()
    assert [tuple(r) for r in rows] == [(2, 0, "A", "X", "1"), (2, 1, "B", "Y", "n/a")]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "1", "  t ", 'a\n\n"b"'), (1, "2", None, " \t"), (2, "3", "x,y", "c\\n")],
                                 "chunk_index int, song_id string, title string, lyrics string")
    csv_corpus.write_csv_chunks(rows, str(tmp_path / "out"))
    back = csv_corpus.scan_lyrics_csv(spark, str(tmp_path / "out")).drop("original_index")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, rows.collect())))


@pytest.mark.parametrize("dtype", ["<f2", "<f4", "<f8"])
def test_npy_is_read_in_ranges(spark, tmp_path, dtype):
    matrices = {1: np.arange(25 * 4).reshape(25, 4) / 8, 4: np.ones((3, 4))}
    for chunk, matrix in matrices.items():
        np.save(tmp_path / f"embeddings_chunk_{chunk}.npy", matrix.astype(dtype))
    (tmp_path / "notes.txt").write_text("not a matrix")
    rows = npy.scan_npy(spark, str(tmp_path), rows_per_task=10)
    assert rows.rdd.getNumPartitions() == 4
    found = {(r["chunk_index"], r["original_index"]): r["embedding"] for r in rows.collect()}
    assert len(found) == 28
    for chunk, matrix in matrices.items():
        for i, vector in enumerate(matrix):
            assert found[chunk, i] == vector.tolist()
    assert npy.scan_npy(spark, str(tmp_path), chunks=[4]).count() == 3


def test_npy_filters_reach_the_files(spark, tmp_path):
    for chunk in (1, 2):
        np.save(tmp_path / f"embeddings_chunk_{chunk}.npy", np.arange(200, dtype="<f4").reshape(100, 2) * chunk)
    np.save(tmp_path / "embeddings_chunk_2.from_100.npy", np.ones((50, 2), "<f4"))
    (tmp_path / "embeddings_chunk_9.npy").write_text("not a matrix, and not to be opened")
    rows = npy.scan_npy(spark, str(tmp_path), rows_per_task=10).filter("chunk_index = 2 AND original_index >= 95 AND original_index < 107")
    assert rows.rdd.getNumPartitions() == 2  # five rows of one file, seven of the next
    assert sorted(r["original_index"] for r in rows.collect()) == list(range(95, 107))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    some = npy.scan_npy(spark, str(tmp_path)).filter("chunk_index IN (1, 2) AND original_index = 3 AND embedding[0] > 7")
    assert [(r["chunk_index"], r["embedding"][0]) for r in some.collect()] == [(2, 12.0)]
    assert npy.scan_npy(spark, str(tmp_path), chunks=[1]).filter("chunk_index = 2").count() == 0


def test_npy_that_cannot_be_written_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).selectExpr("1 AS chunk_index", "IF(id < 35, id, id + 1) AS original_index", "array(1f, 2f) AS embedding")
    with pytest.raises(Exception, match="has gaps after row 30"):
        npy.write_npy(rows, str(tmp_path / "v"), rows_per_file=10)
    assert list((tmp_path / "v").iterdir()) == []
    assert npy.write_npy(rows.limit(0), str(tmp_path / "w")) == 0 and list((tmp_path / "w").iterdir()) == []


def test_npy_rejects_other_shapes(spark, tmp_path):
    np.save(tmp_path / "embeddings_chunk_1.npy", np.zeros(3))
    with pytest.raises(Exception, match="row-ordered matrix"):
        npy.scan_npy(spark, str(tmp_path)).count()


def test_npy_round_trip_over_several_files(spark, tmp_path):
    rows = spark.range(50).select(
        (F.col("id") % 2 + 1).cast("int").alias("chunk_index"), F.floor(F.col("id") / 2).alias("original_index"),
        F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding"))
    assert npy.write_npy(rows, str(tmp_path / "v"), rows_per_file=10) == 50
    assert len(list((tmp_path / "v").iterdir())) == 6
    back = npy.scan_npy(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, ((r[0], r[1], tuple(r[2])) for r in back.collect()))) == sorted(
        (r[0], r[1], tuple(r[2])) for r in rows.collect())


def test_paths_without_a_scheme_are_spark_s(spark, tmp_path):
    from songloom.session import qualified
    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
    with pytest.raises(ValueError, match="no file system"):
        npy._open("/some/folder")


def test_vectors_of_another_length_are_not_appended(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "song_id bigint, embedding array<float>"
    corpus.store_vectors(spark.createDataFrame([(1, [1.0, 2.0])], schema), path)
    corpus.append_vectors(spark.createDataFrame([(2, [3.0, 4.0]), (3, None)], schema), path)
    assert spark.read.parquet(path).count() == 3 and corpus.vector_length(spark.read.parquet(path)) == 2
    with pytest.raises(Exception, match="does not have 2 numbers but 3"):
        corpus.append_vectors(spark.createDataFrame([(4, [1.0, 2.0, 3.0])], schema), path)


def test_npy_gap_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, [1.0]), (1, 2, [1.0])], "chunk_index int, original_index bigint, embedding array<float>")
    with pytest.raises(Exception, match="gaps"):
        npy.write_npy(rows, str(tmp_path / "v"))


def test_write_clean_overwrites_and_prunes(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(10).select(
        "id", F.lit("t").alias("title"), F.lit("a").alias("artist"), (F.col("id") % 2).cast("int").alias("chunk_index"))
    assert corpus.write_clean(rows, path).count() == 10
    stored = corpus.write_clean(rows.filter("id < 4"), path)
    assert stored.columns == rows.columns and stored.count() == 4
    with pytest.raises(ValueError, match="year"):
        corpus.scan_metadata(spark, path, ["id", "year"])
    plan = corpus.scan_metadata(spark, path).filter("chunk_index = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk_index" in plan


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS buckets LOCATION '{tmp_path}/buckets'")
        left = corpus.store_bucketed(spark.range(100).withColumnRenamed("id", "song_id"), "buckets.a", 4)
        right = corpus.store_bucketed(spark.range(50).withColumnRenamed("id", "song_id"), "buckets.b", 4)
        joined = left.join(right, "song_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.sql("DROP DATABASE IF EXISTS buckets CASCADE")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pages_and_playlists_as_json(spark, tmp_path):
    (tmp_path / "pages.json").write_text(
        '{"request_id": 1, "query_no": 1, "page_no": 0, "playlists": [null, {"id": 5, "name": "p", "tracks": '
        '[{"track": {"id": "t", "name": "n", "artists": [], "album": {"images": []}}}, {"track": null}]}]}\n')
    from songloom.operators import matching
    rows = matching.track_fields(matching.flatten_playlists(playlists.read_pages(spark, str(tmp_path / "pages.json")))).collect()
    assert [(r["track_id"], r["artist_name"], r["url"], r["image_url"]) for r in rows] == [("t", "", None, None)]

    requests = spark.createDataFrame([(1, "x" * 60, ["Pop"])], "request_id bigint, prompt string, genres array<string>")
    songs = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c")], "request_id bigint, rank int, title string")
    playlists.write_playlists(playlists.playlists(requests, songs, 2), str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert (row["id"], row["title"], row["genres"], [s["title"] for s in row["songs"]]) == (1, "x" * 47 + "...", ["Pop"], ["a", "b"])


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1000])
def test_stretches_give_what_the_whole_gives(monkeypatch, stretch):
    text = b'h,"l"\n1,"a\n""b"\n\n2,""\r\n\r\n"3\n","\n"\n4,x'
    whole = csv_corpus._count_records(io.BytesIO(text), len(text), 0, len(text), 6)
    assert (whole.first[0], whole.records[0]) == (6, 4)
    blocks = [csv_corpus._count_records(io.BytesIO(text), len(text), a, z, 0) for a, z in ((6, 20), (20, len(text)))]
    monkeypatch.setattr(csv_corpus, "STRETCH_BYTES", stretch)
    assert csv_corpus._count_records(io.BytesIO(text), len(text), 0, len(text), 6) == whole
    assert [csv_corpus._count_records(io.BytesIO(text), len(text), a, z, 0) for a, z in ((6, 20), (20, len(text)))] == blocks
    parts = list(csv_corpus._record_stretches(io.BytesIO(text), 6, len(text)))
    assert b"".join(parts) == text[6:]
    rows = [row for part in parts for row in csv.reader(io.StringIO(part.decode(), newline="")) if row]
    assert rows == [r for r in csv.reader(io.StringIO(text.decode(), newline="")) if r][1:]


def test_a_task_holds_a_stretch_of_its_range(tmp_path):
    path = tmp_path / "song_lyrics_chunk_1.csv"
    with open(path, "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["title", "lyrics"], *[[str(i), f'some "text"\n{i}' * 50] for i in range(20_000)]])
    size = path.stat().st_size
    row = {"path": path.as_uri(), "size": size, "block": 0, "begin": 0, "end": size}
    tracemalloc.start()
    (block,) = [b.to_pylist()[0] for b in csv_corpus._summarise(iter([pa.RecordBatch.from_pylist([row])]))]
    (part,) = csv_corpus._ranges([block], 1, 0)
    reader = csv_corpus.CsvRangeReader({"plan": "", "columns": '["title", "lyrics"]', "pattern": ""})
    last = None
    for batch in reader.read(part):
        last = batch.to_pylist()[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last == {"chunk_index": 1, "original_index": 19_999, "title": "19999", "lyrics": 'some "text"\n19999' * 50}
    assert peak < size and size > 16 << 20
