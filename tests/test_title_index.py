"""Terms matched through the title index equal the plain form."""

import random
import re

import pytest
from pyspark.sql import functions as F

from songloom.operators import filters, title_index

TERMS = ["song", "Song 1", "^a", "b$", "one|two", "(red|blue) sky", "colou?r", "ab+c", "a.c", "x{0}yes", r"\bnight\b", r"50\.5",
         "[abc]def", "no such thing", "", "(?i)sky", "sky(?=line)", r"\Qa.b\E", "ÉTÉ", "été", "naïve", "straße", "Kelvin", "a[]x]bcd",
         "abc*d", "rain (and )?fire", "...", "zz+", "s\u0131r", "end\\$"]
TITLES = ["Song 1", "SONG 12 (live)", "my song", "Red Sky", "blue  sky", "blue sky", "color", "colour", "colr", "abbbc", "ac", "yes", "xyes",
          "Good Night", "nightly", "50.5 and", "5055", "adef", "ddef", "skyline", "sky", "a.b", "ÉTÉ", "été", "NAÏVE", "naïve", "STRASSE",
          "straße", "\u212aelvin", "kelvin", "axbcd", "a]bcd", "abd", "abcccd", "rain fire", "rain and fire", "zz", "zzz", "sır", "SIR",
          "the end$", "two", "ONE", "", "ab", None]


@pytest.fixture(scope="module")
def songs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TITLES)], "song_id long, title string, term_note string")


def _terms(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


@pytest.mark.parametrize("plain_terms", [2, 500])
def test_terms_of_every_kind(spark, songs, monkeypatch, plain_terms):
    monkeypatch.setattr(title_index, "PLAIN_TERMS", plain_terms)
    index = title_index.store_title_index(songs)
    wanted = filters.watchlist_matches(songs, TERMS).select("term", "song_id").collect()
    found = title_index.match_terms(songs, _terms(spark, [*TERMS, TERMS[0], None]), index)
    assert found.columns == ["term", "song_id", "title", "term_note"]
    assert sorted(map(tuple, found.select("term", "song_id").collect())) == sorted(set(map(tuple, wanted)))
    counts = filters.watchlist_found(songs, TERMS).collect()
    assert sorted(map(tuple, title_index.found_terms(songs, _terms(spark, TERMS), index).collect())) == sorted(map(tuple, counts))


def test_required_runs():
    runs = {"colou?r": ["colo", "r"], "ab+c": ["ab", "c"], "(red|blue) sky": [" sky"], "a|bcd": [], "x{2}yes": ["yes"], r"50\.5": ["50.5"],
            r"a\d+bcd": ["a", "bcd"], "[x-z]abc": ["abc"], "a(?:b)c": ["a", "c"], "(?x)a b": [], "ab(c": [], r"\Qab\E": [], "": []}
    assert {t: title_index.required_runs(t) for t in runs} == runs


def test_what_is_required_is_in_every_match():
    rng = random.Random(6)
    for _ in range(4000):
        pattern = "".join(rng.choice(["a", "b", "C", "d", ".", "?", "*", "+", "(", ")", "|", "[ab]", r"\.", "^", "{2}"]) for _ in range(rng.randint(1, 8)))
        try:
            compiled = re.compile(pattern, re.I)
        except re.error:
            continue
        for _ in range(8):
            title = "".join(rng.choice("abcdABCD.") for _ in range(rng.randint(0, 8)))
            if compiled.search(title):
                assert all(g in title.lower() for g in title_index.term_grams(pattern)), (pattern, title)


def test_many_terms_are_not_tested_against_every_title(spark):
    titles = spark.range(20_000).select(F.col("id").alias("song_id"), F.concat(F.lit("t"), F.substring(F.md5(F.col("id").cast("string")), 1, 9)).alias("title"))
    terms = titles.filter("song_id % 2 = 0").select(F.substring("title", 2, 6).alias("term"))
    index = title_index.store_title_index(titles)
    read = title_index._with_grams(terms)
    pairs = title_index.candidate_pairs(read, index)
    assert pairs.count() < 10 * terms.count()  # of 200 million
    found = title_index.match_terms(titles, terms, index)
    assert found.select("term").distinct().count() == terms.distinct().count()
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_terms_and_no_songs(spark, songs):
    index = title_index.store_title_index(songs)
    assert title_index.match_terms(songs, _terms(spark, ["x"]).limit(0), index).count() == 0
    empty = songs.limit(0)
    assert title_index.match_terms(empty, _terms(spark, ["song", ".."]), title_index.store_title_index(empty)).count() == 0


def test_postings_looked_up_grow_with_the_titles(spark):
    """Titles and terms that differ in their numbers only: the rarest piece of a term has few postings, however many there are."""
    def looked_up(n):
        titles = spark.range(n).select(F.col("id").alias("song_id"), F.format_string("  Song %d ", F.col("id") * 7919 % 900_000 + 100_000).alias("title"))
        read = title_index._with_grams(titles.select(F.upper(F.trim("title")).alias("term")))
        postings = title_index.store_title_index(titles).groupBy("gram").count()
        found = read.select("term", F.explode("grams").alias("gram")).join(postings, "gram").groupBy("term").agg(F.min("count").alias("n"))
        return found.agg(F.sum("n")).first()[0]

    assert looked_up(2_000) <= 2 * 2_000 and looked_up(8_000) <= 2 * 8_000


def test_pieces_of_every_length(spark):
    words = ["abc", "abcdef", "abcdefghijkl", "abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwxyz0123", "xabcdefghijklmnopqrst", "abcdéfghi", "ABCDE"]
    songs = spark.createDataFrame(list(enumerate(words)), "song_id long, title string")
    found = title_index.match_terms(songs, _terms(spark, words), title_index.store_title_index(songs)).select("term", "song_id").collect()
    assert sorted(map(tuple, found)) == sorted((t, i) for t in words for i, w in enumerate(words) if re.search("(?ai)" + t, w))
