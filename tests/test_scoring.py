"""A scorer whose calls fail, and the memo of its answers."""

import os

import pytest
from pyspark.sql import functions as F

from songloom.operators import rank, scoring


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, "sad songs", f"title {i}", "artist", None if i % 7 == 0 else f"words {i}", 0.5, f"x{i}") for i in range(60)]
    rows += [(100 + i, "sad songs", f"title {i}", "artist", f"words {i}", 0.5, "y") for i in range(1, 7)]  # asked in the same words
    return spark.createDataFrame(rows, "song_id long, prompt string, title string, artist string, lyrics string, "
                                       "vector_score double, error string").repartition(3)


def counting(folder, fails=(), wrong=()):
    """A scorer that notes each song it is asked about in a file, and fails for some titles."""
    def scorer(asked):
        import re
        import uuid

        numbers = [int(re.search(r"title (\d+)", text)[1]) for text in asked]
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(" ".join(map(str, numbers)))
        if any(n in fails for n in numbers):
            raise TimeoutError("too slow")
        if any(n in wrong for n in numbers):
            return []
        return [f'{{"score": {n}}}' for n in numbers]
    return scorer


def _asked(folder):
    return sorted(int(n) for f in os.listdir(folder) for n in open(f"{folder}/{f}").read().split())


def _folder(tmp_path, name):
    (tmp_path / name).mkdir()
    return str(tmp_path / name)


def test_failures_stay_with_their_call_and_answers_are_kept(spark, pairs, tmp_path):
    memo, first, second, third = str(tmp_path / "memo"), *[_folder(tmp_path, n) for n in "abc"]
    out = scoring.score_with_memo(pairs, counting(first, fails={3, 10}, wrong={5}), memo, attempts=2)
    assert out.columns == ["song_id", "prompt", "title", "artist", "lyrics", "vector_score", "relevance", "failed", "error"]
    got = {r["song_id"]: (r["relevance"], r["failed"], r["error"]) for r in out.collect()}
    assert len(got) == 66
    for i in range(60):
        said = (None, True, "TimeoutError: too slow") if i in (3, 10) else (None, True, "ValueError: not enough values to unpack (expected 1, got 0)") \
            if i == 5 else (None if i % 7 == 0 else i, False, None)
        assert got[i] == said, i
    assert all(got[100 + i] == got[i] for i in range(1, 7))
    asked = _asked(first)
    assert max(asked.count(i) for i in range(60)) <= 3  # with its batch, and twice alone
    assert not [i for i in asked if i % 7 == 0] and set(range(60)) - set(asked) == {i for i in range(60) if i % 7 == 0}

    again = scoring.score_with_memo(pairs, counting(second), memo)
    assert {r["song_id"]: r["relevance"] for r in again.collect()} == {
        **{i: None if i % 7 == 0 else i for i in range(60)}, **{100 + i: i for i in range(1, 7)}}
    assert _asked(second) == [3, 5, 10]  # what failed, and nothing else
    scoring.score_with_memo(pairs, counting(third), memo).collect()
    assert _asked(third) == []


def test_a_memo_with_an_answer_twice(spark, pairs, tmp_path):
    memo = str(tmp_path / "memo")
    for _ in range(2):  # the same run written again
        spark.createDataFrame([("h", "1", "a"), ("h", "2", "b")], scoring.MEMO).write.mode("append").parquet(memo)
    assert [tuple(r) for r in scoring.read_memo(spark, memo).collect()] == [("h", "1")]


def test_failed_calls_keep_their_vector_score(spark, pairs, tmp_path):
    folder = _folder(tmp_path, "a")
    judged = scoring.score_with_memo(pairs.filter("song_id IN (3, 7, 8)"), counting(folder, fails={3}), str(tmp_path / "memo"), attempts=1)
    got = {r["song_id"]: (r["relevance"], round(r["score"], 6)) for r in rank.rerank_neutral(judged).collect()}
    assert got == {3: (50, 0.5), 7: (50, 0.5), 8: (8, 0.374)}


def test_no_pairs(spark, pairs, tmp_path):
    out = scoring.score_with_memo(pairs.limit(0), counting(str(tmp_path)), str(tmp_path / "memo"))
    assert out.count() == 0
    nothing = pairs.withColumn("lyrics", F.lit(None).cast("string"))
    out = scoring.score_with_memo(nothing, counting(_folder(tmp_path, "a")), str(tmp_path / "memo")).collect()
    assert len(out) == 66 and not [r for r in out if r["relevance"] is not None or r["failed"]]


def test_lyrics_do_not_move_to_the_answers(spark, pairs, tmp_path):
    """Behind the join with the answers only whether there are lyrics is known, where the caller drops them."""
    out = scoring.score_with_memo(pairs, lambda asked: ["1"] * len(asked), str(tmp_path / "memo")).select("song_id", "relevance")
    above_join = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "_sung" in above_join and "lyrics" not in above_join


@pytest.mark.parametrize("short_list", [0, 100])
def test_long_and_short_lists_get_the_same_answers(spark, pairs, tmp_path, monkeypatch, short_list):
    monkeypatch.setattr(scoring, "SHORT_LIST", short_list)
    judge = lambda asked: [str(len(text) % 90) for text in asked]
    first = scoring.score_with_memo(pairs.filter("song_id % 2 = 0"), judge, str(tmp_path / "memo")).collect()
    again = {r["song_id"]: r["relevance"] for r in scoring.score_with_memo(pairs, judge, str(tmp_path / "memo")).collect()}
    assert len(again) == pairs.count() and all(again[r["song_id"]] == r["relevance"] for r in first)
