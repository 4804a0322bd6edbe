import pytest
from pyspark.sql import functions as F

from songloom.functions import payload, present, sampling, text
from songloom.functions.keys import corpus_key, genre_tag, has_text, normalise_key, numeric, strip, wanted_tags
from songloom.functions.permutation import permuted
from songloom.functions.scores import blend, views_multiplier
from songloom.functions.vectors import cosine, dot, l2_normalise, literal, norm

V = F.col("v")


@pytest.mark.parametrize("given, wanted", [(" \t ÀB ", "àb"), (None, ""), (" x　", "x"), ("\n a b \r\n", "a b")])
def test_normalise_key(one, given, wanted):
    assert one(normalise_key(V), "v string", given) == wanted


def test_corpus_key_keeps_missing(one):
    assert one(corpus_key(V), "v string", None) is None


@pytest.mark.parametrize("given, wanted", [("  \t", False), ("", False), (None, None), ("  x", True)])
def test_has_text(one, given, wanted):
    assert one(has_text(V), "v string", given) is wanted


def test_strip_like_python(one):
    odd = "\x1c\x85 a b  \x1f"
    assert one(strip(V), "v string", odd) == odd.strip()


@pytest.mark.parametrize("given, wanted", [
    ("12", 12.0), (" 1e3 ", 1000.0), ("-.5", -0.5), ("n/a", None), ("", None), (None, None), ("NaN", None),
    ("1d", None), ("0x10", None), ("12f", None), ("inf", float("inf"))])
def test_numeric(one, given, wanted):
    assert one(numeric(V), "v string", given) == wanted


def test_numeric_nan_is_missing(one):
    assert one(numeric(V), "v double", float("nan")) is None


@pytest.mark.parametrize("given, wanted", [("R&B", "rb"), (" Rap", "rap"), ("Jazz", "jazz"), ("rock ", "rock")])
def test_genre_tag(one, given, wanted):
    assert one(genre_tag(V), "v string", given) == wanted


def test_blank_genres_are_ignored(one):
    assert one(wanted_tags(V), "v array<string>", ["", " Pop", "  "]) == ["pop"]


@pytest.mark.parametrize("given, wanted", [
    (None, 0.7), ("n/a", 0.7), ("0", 0.7), ("1", 0.7), ("1000", 1.0), ("10000", 1.1), ("1000000", 1.3)])
def test_views_multiplier(one, given, wanted):
    assert one(views_multiplier(numeric(V)), "v string", given) == pytest.approx(wanted)


def test_blend(one):
    assert one(blend(F.col("a"), F.col("b")), "a double, b int", 0.5, 80) == pytest.approx(0.59)


def test_vectors(one):
    assert one(dot(V, literal([1, 2])), "v array<float>", [3.0, 4.0]) == 11.0
    assert one(norm(V), "v array<float>", [3.0, 4.0]) == 5.0
    assert one(l2_normalise(V), "v array<float>", [3.0, 4.0]) == [0.6, 0.8]
    assert one(l2_normalise(V), "v array<float>", [0.0, 0.0]) == [0.0, 0.0]
    assert one(cosine(V, literal([6, 8])), "v array<float>", [3.0, 4.0]) == pytest.approx(1.0)
    assert one(cosine(V, literal([6, 8])), "v array<float>", [0.0, 0.0]) == 0.0


@pytest.mark.parametrize("given, wanted", [
    ('{"score": 85}', 85), ('```json\n{"score": 101}\n```', 100), ('{"score": -3}', 0), ('{"score": "77"}', 77),
    ('{"score": 85.7}', 85), ('{"score": "85.5"}', 0), ('{"x": 1}', 0), ('[1]', 0), ('{"score": 85} extra', 0),
    ('{"score": null}', 0), ("oops", 0), ("", 0), (None, 0), ('  {"score": 5}  ', 5), ('{"score": 1e12}', 100)])
def test_parse_score(one, given, wanted):
    assert one(payload.parse_score(V), "v string", given) == wanted


@pytest.mark.parametrize("given", ['{"score": 85} {"score": 1}', '{"score": 85} extra}', '{"score": 85}, {"score": 2}', '[{"score": 85}]'])
def test_more_than_one_object_is_no_score(one, given):
    assert one(payload.parse_score(V), "v string", given) == 0


def test_parse_phrases_json(one):
    parse = payload.parse_phrases_json(V)
    assert one(parse, "v string", '```json\n{"queries": ["a", "b c"]}\n```') == ["a", "b c"]
    assert one(parse, "v string", '{"other": 1}') == []
    assert one(parse, "v string", "no json") == []
    for more in ('{"queries": ["a"]} {"queries": ["b"]}', '{"queries": ["a"]}, {"queries": ["b"]}', '{"queries": ["a"]}] {"x": 1}',
                 '{"queries": ["a"]}} {"x": 1}', '{"queries": ["a"]} extra}', '["queries"]'):
        assert one(parse, "v string", more) == []
    assert one(parse, "v string", None) == []


def test_parse_phrases_lines(one):
    parse = payload.parse_phrases_lines(V)
    assert one(parse, "v string", " a \n\n b\nc\nd\ne\nf") == ["a", "b", "c", "d", "e"]
    assert one(parse, "v string", "  ") == []
    assert one(parse, "v string", None)[0] == "chill vibes"


@pytest.mark.parametrize("given, wanted", [
    ("Found 1,245 candidate songs", 1245), ("Filtered to 12 songs", 12), ("Reranking 7 things", None),
    ("all songs", None), ("5 candidates, 9 songs", 5), ("1000036 songs", 100), (None, None)])
def test_message_count(one, given, wanted):
    assert one(payload.message_count(V), "v string", given) == wanted


def expected_passages(lyrics):
    """Parts grouped while the text of a group and the next part stay short, then cut."""
    together = []
    for part in filter(None, map(str.strip, lyrics.split("\n\n"))):
        if together and len("\n\n".join(together[-1])) + len(part) < 200:
            together[-1].append(part)
        else:
            together.append([part])
    return [whole[at:at + 800] for whole in map("\n\n".join, together) for at in range(0, len(whole), 800)]


@pytest.mark.parametrize("lyrics", [
    "a" * 90 + "\n\n" + "b" * 90, "x" * 1700, "a" * 120 + "\n\n" + "b" * 80, " \n ", "", "one\n\n\n\ntwo", "é" * 801,
    "\n\n".join("word " * n for n in (1, 30, 2, 50, 400, 3, 3, 3)), "line\nline\n\n  verse  \n\n\n"])
def test_passages(one, lyrics):
    found = one(text.passages(V), "v string", lyrics)
    assert found == expected_passages(lyrics)
    assert all(0 < len(p) <= 800 for p in found)
    assert "".join("".join(found).split()) == "".join(lyrics.split())


def test_truncate_lyrics(one):
    assert one(text.truncate_lyrics(V), "v string", "é" * 5000) == "é" * 5000
    assert one(text.truncate_lyrics(V), "v string", "é" * 5001) == "é" * 5000 + "..."
    assert one(text.truncate_lyrics(V), "v string", None) is None


def test_first_words(one):
    assert one(text.first_words(V, 3), "v string", "  a\n b c  d") == "a b c"


def test_clean_lyrics(one):
    clean = text.clean_lyrics(V)
    assert one(clean, "v string", "Title\n la la 3EmbedShare URLCopyEmbedCopy") == "la la 3"
    assert one(clean, "v string", "single line") == "single line"
    assert one(clean, "v string", "Title\n  ") is None


def test_titles(one):
    assert one(text.playlist_title(V), "v string", "x" * 50) == "x" * 50
    assert one(text.playlist_title(V), "v string", "x" * 51) == "x" * 47 + "..."
    assert one(text.short_title(V), "v string", "a b c") == "a b c"
    assert one(text.short_title(V), "v string", "a b c d") == "a b c..."


def test_contexts(one):
    assert one(text.query_context(F.col("p"), F.col("g")), "p string, g array<string>", "sad", ["Pop", "Rap"]) == "sad(Pop Rap)"
    assert one(text.genre_focus(V), "v array<string>", ["Pop", "Rap"]) == " Focus on Pop, Rap music."
    assert one(text.genre_focus(V), "v array<string>", []) == ""


def test_presentation(one):
    assert one(present.duration_text(V), "v int", 180000) == "3:00"
    assert one(present.duration_text(V), "v int", 61499) == "1:01"
    assert one(present.percent_text(V), "v double", 0.425) == "43%"
    assert one(present.percent_text(V), "v double", 0.0) == ""
    assert one(present.percent_text(V), "v double", None) == ""
    assert one(present.genres_text(V), "v array<string>", []) == "Various Genres"
    assert one(present.genres_text(V), "v array<string>", None) == "Various Genres"
    assert one(present.genres_text(V), "v array<string>", ["a", "b", "c", "d"]) == "a, b, c"
    assert one(present.streams(V), "v double", 12.9) == 12
    assert one(present.streams(V), "v double", None) == 0


def test_result_id_is_stable(one):
    made = one(present.result_id(F.lit(3), F.col("t"), F.col("a")), "t string, a string", "Song", "Artist")
    assert made.startswith("song_3_") and 0 <= int(made.split("_")[2]) < 10000
    assert made == one(present.result_id(F.lit(3), F.col("t"), F.col("a")), "t string, a string", "Song", "Artist")


def test_draw_depends_on_every_part(one):
    draws = {one(sampling.draw(seed, V, F.lit(n)), "v bigint", 7) for seed in (1, 2) for n in (1, 2)}
    assert len(draws) == 4


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_permuted_numbers(spark, n):
    """Every place once, whatever the key; another key, another order."""
    orders = []
    for key in ("epoch 1", "epoch 2"):
        rows = spark.range(n).select("id", permuted(F.col("id"), n, 7, key).alias("place")).collect()
        assert sorted(r["place"] for r in rows) == list(range(n))
        orders.append([r["place"] for r in sorted(rows)])
        alone = spark.range(n - 1, n).select(permuted(F.col("id"), n, 7, key).alias("place")).first()["place"]
        assert alone == orders[-1][n - 1]  # by itself
    if n > 20:
        assert orders[0] != orders[1] and sum(abs(a - b) < n / 20 for a, b in zip(orders[0], range(n), strict=True)) < n / 4


def test_numbers_that_are_not_to_be_permuted(spark):
    for bad in (-1, 5):
        with pytest.raises(Exception, match="not a number below 5"):
            spark.range(1).select(permuted(F.lit(bad), 5, 7, "k")).collect()
