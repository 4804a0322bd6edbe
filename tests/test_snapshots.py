"""Vectors follow their lyrics: changed, new and gone songs, versions, and runs that break off."""

import pytest

from songloom.operators import snapshots
from songloom.operators.encode import embed_texts

SONGS = [(1, "one two"), (2, "three"), (3, " "), (4, None), (5, "five five")]
LATER = [(1, "one two"), (2, "three four"), (3, "now words"), (6, "six")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "song_id long, lyrics string")


def _vectors(spark, path, **options):
    return {r["song_id"]: (tuple(r["embedding"]), r["delta"]) for r in snapshots.read_snapshot(spark, path, **options).collect()}


def _wanted(spark, rows):
    return {r["song_id"]: tuple(r["embedding"]) for r in embed_texts(_frame(spark, rows), "lyrics").collect() if (r["lyrics"] or "").strip()}


def test_updates(spark, tmp_path):
    path = str(tmp_path / "v")
    assert snapshots.read_snapshot(spark, path).count() == 0
    assert snapshots.update_snapshot(_frame(spark, SONGS), path) == snapshots.Update(1, 3, 0, 0)
    assert snapshots.update_snapshot(_frame(spark, SONGS), path) == snapshots.Update(1, 0, 0, 0)  # nothing to do
    assert snapshots.update_snapshot(_frame(spark, LATER), path) == snapshots.Update(2, 2, 1, 1)
    now = _vectors(spark, path)
    assert {k: v for k, (v, _) in now.items()} == _wanted(spark, LATER)
    assert {k: d for k, (_, d) in now.items()} == {1: 1, 2: 2, 3: 2, 6: 2}
    assert {k: v for k, (v, _) in _vectors(spark, path, version=1).items()} == _wanted(spark, SONGS)
    assert snapshots.update_snapshot(_frame(spark, []), path) == snapshots.Update(3, 0, 0, 4)
    assert _vectors(spark, path) == {}
    assert snapshots.update_snapshot(_frame(spark, SONGS), path).added == 3  # songs may come back


def test_a_run_that_breaks_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    snapshots.update_snapshot(_frame(spark, SONGS), path)
    before = _vectors(spark, path)

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as patched:  # the delta is written, its manifest is not
        patched.setattr(snapshots, "any", stop, raising=False)
        with pytest.raises(Stopped):
            snapshots.update_snapshot(_frame(spark, LATER), path)
    assert _vectors(spark, path) == before
    assert snapshots.update_snapshot(_frame(spark, LATER), path) == snapshots.Update(2, 2, 1, 1)
    assert {k: v for k, (v, _) in _vectors(spark, path).items()} == _wanted(spark, LATER)


def test_two_updates_of_one_version(spark, tmp_path):
    path = str(tmp_path / "v")
    snapshots.update_snapshot(_frame(spark, SONGS), path)
    (tmp_path / "v" / "manifest" / "of=2").mkdir()  # another run is about to write it
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        snapshots.update_snapshot(_frame(spark, LATER), path)
