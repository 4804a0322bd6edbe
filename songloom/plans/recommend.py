"""From requests and the tracks found for them to ranked, described songs.

Intermediate tables are settled on the way - the requests, the keys and names they found, the
(request, song) pairs to score and the best of them - so that the joins with the large
tables (metadata, vectors, lyrics) know how small their other side is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.constants import OVERFETCH_CANDIDATES, RERANK_DEPTH, TOP_K_CLI, TOP_K_SERVICE
from songloom.functions.keys import numeric
from songloom.functions.present import result_id, streams
from songloom.functions.scores import views_multiplier
from songloom.functions.vectors import dot
from songloom.operators.block import best_within_names
from songloom.operators.encode import HASH_DIM, Encoder, Scorer, embed_texts, score_relevance
from songloom.operators.filters import passes_genres
from songloom.operators.groups import top_k_per_group
from songloom.operators.matching import KEYS, enrich_hits, match_keys, match_names, request_keys
from songloom.operators.rank import fetch_lyrics, rerank_neutral, rerank_strict
from songloom.operators.search import best_first, rank_pairs, with_popularity, with_vector
from songloom.session import settle
from songloom.sources.key_index import MATCH_KEY
from songloom.streaming.requests import Stage
from songloom.sources.corpus import vector_length

# A name shared by this many (request, song) pairs or more is scored block by block.
MAX_PAIRS_PER_NAME = 1_000_000

RESULT = ["request_id", "rank", "song_id", "id", "title", "artist", "album", "genre", "duration_ms", "score",
          "streams", "relevance", "url", "image_url", "vector_score"]


@dataclass
class Matched:
    """What the tracks of some requests found: ``songs``, the corpus rows of a wanted key, and
    ``names``, one row per request and (title, artist, tag)."""

    songs: DataFrame
    names: DataFrame

    def wanted(self) -> DataFrame:
        """The names that the requests' genres let pass."""
        return self.names.filter("passes")


def match(requests: DataFrame, tracks: DataFrame, songs: DataFrame) -> Matched:
    """Match the tracks to the corpus; its metadata is read here and nowhere else.

    ``songs`` may be the stored index of :mod:`songloom.sources.key_index`.

    ``passes`` says whether the request's genres let a name pass.
    """
    keys = settle(request_keys(requests, tracks), "keys")
    slim = songs.select("song_id", "title", "artist", "tag", "views", *[c for c in (*KEYS, MATCH_KEY) if MATCH_KEY in songs.columns])
    found = settle(match_keys(slim, keys).drop(*KEYS).withColumn("name", _name()), "matched")
    names = match_names(found, keys)
    passes = passes_genres(F.col("tags"), F.col("tag"))
    return Matched(found, settle(names.select("*", passes.alias("passes"), _name().alias("name")).drop("tags"), "names"))


def encoded(requests: DataFrame, encoder: Callable[[], Encoder] | None, dim: int) -> DataFrame:
    """Requests with the vector ``q`` of their prompt, unless they bring one.

    A request that is left without a vector is an error.
    """
    if "q" not in requests.columns:
        requests = embed_texts(requests, "prompt", encoder, "q", dim)
    told = F.concat(F.lit("no vector for request "), F.col("request_id").cast("string"))
    return requests.withColumn("q", F.when(F.col("q").isNotNull(), F.col("q")).otherwise(F.raise_error(told)))


def _name() -> Column:
    """Title, artist and tag as one key that joins and groups also when the tag is missing."""
    return F.to_json(F.array("title", "artist", "tag"), {"ignoreNullFields": "false"})


def vector_hits(requests: DataFrame, names: DataFrame, matched: DataFrame, vectors: DataFrame,
                depth: int = RERANK_DEPTH, overfetch: int | None = OVERFETCH_CANDIDATES,
                max_pairs: int = MAX_PAIRS_PER_NAME) -> DataFrame:
    """Per request the best songs of its names by vector search: two-stage, or fused without ``overfetch``.

    ``matched``: the songs of :func:`match`. Songs without a vector are no hits. Names with
    ``max_pairs`` pairs or more are scored in blocks, which gives the same scores and order.
    """
    slim = matched.select("song_id", "title", "artist", "views", "name")
    first = requests.select(F.size("q")).first()
    vectors = with_vector(vectors, first[0] if first else None)
    asks = names.select("request_id", "name")
    queries = requests.select("request_id", "q")
    common = names.groupBy("name").agg(F.max("copies").alias("songs"), F.count(F.lit(1)).alias("asks")).filter(
        F.col("songs") * F.col("asks") >= max_pairs)
    some_common = not common.isEmpty()

    rare = asks.join(common, "name", "left_anti") if some_common else asks
    pairs = settle(slim.join(rare, "name").drop("name"), "pairs")
    # The query goes to the song: a prompt has few words, so its vector is mostly zeros and packs well.
    scored = pairs.join(queries, "request_id").join(vectors, "song_id").withColumn(
        "raw_score", dot(F.col("embedding"), F.col("q"))).drop("embedding", "q")
    if some_common:
        weight = F.lit(1.0) if overfetch else views_multiplier(numeric(F.col("views")))
        blocks = slim.join(common.select("name"), "name").join(vectors, "song_id").select(
            "name", "song_id", "embedding", weight.alias("weight"))
        best = best_within_names(blocks, asks.join(queries, "request_id"), common, depth * (overfetch or 1))
        scored = scored.unionByName(settle(best, "best").join(slim.drop("name"), "song_id"))
    return rank_pairs(scored, depth, overfetch)


def _describe(requests, names, hits, lyrics, scorer, rerank, top_k) -> DataFrame:
    # The prompt goes to the lyrics: text that is as long as lyrics is moved once a song, not once a hit.
    hits = settle(hits.drop("rank").withColumnRenamed("score", "vector_score").join(
        requests.select("request_id", "prompt"), "request_id"), "hits")
    scored = score_relevance(fetch_lyrics(hits, lyrics, ["song_id"], words=scorer is None), scorer).drop("prompt", "lyrics")
    best = top_k_per_group(rerank(scored), ["request_id"], best_first(), top_k, "song_id")
    described = enrich_hits(best, names, ["request_id"])
    return described.withColumn("id", result_id(F.col("rank") - 1, F.col("title"), F.col("artist"))).withColumn(
        "streams", streams(F.col("views"))).select(*RESULT)


def recommend_stages(tracks: DataFrame, songs: DataFrame, vectors: DataFrame, lyrics: DataFrame, top_k: int = TOP_K_SERVICE,
                     depth: int = RERANK_DEPTH, scorer: Scorer | None = None, encoder: Callable[[], Encoder] | None = None
                     ) -> list[Stage]:
    """The steps of :func:`recommend`, for :func:`songloom.streaming.requests.staged_stream`.

    Each works on the requests that are still wanted then: what an earlier step found for others is left aside.
    """
    def find(requests: DataFrame, _: object) -> tuple[DataFrame, Matched]:
        asked = settle(encoded(requests, encoder, vector_length(vectors) or HASH_DIM), "requests")
        return asked, match(asked, tracks, songs)

    def search(requests: DataFrame, left: tuple[DataFrame, Matched]) -> tuple[DataFrame, DataFrame, DataFrame]:
        asked = left[0].join(requests.select("request_id"), "request_id", "left_semi")
        names = left[1].wanted().join(requests.select("request_id"), "request_id", "left_semi")
        return asked, names, settle(vector_hits(asked, names, left[1].songs, vectors, depth, OVERFETCH_CANDIDATES), "hits")

    def judge(requests: DataFrame, left: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
        asked, names, hits = (rows.join(requests.select("request_id"), "request_id", "left_semi") for rows in left)
        return settle(_describe(asked, names, hits, lyrics, scorer, rerank_neutral, top_k), "answers")

    return [Stage("Finding candidates", 20, find), Stage("Searching songs", 50, search), Stage("Ranking songs", 80, judge)]


def recommend(requests: DataFrame, tracks: DataFrame, songs: DataFrame, vectors: DataFrame, lyrics: DataFrame,
              top_k: int = TOP_K_SERVICE, depth: int = RERANK_DEPTH, scorer: Scorer | None = None,
              matched: Matched | None = None, encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """Service form: two-stage search, missing lyrics count as neutral.

    ``requests``: request_id, prompt, genres and, where the prompt is encoded elsewhere, its
    vector q; ``tracks``: what :func:`track_fields` gives; ``songs``: metadata; ``vectors``:
    song_id, embedding, made by the encoder that the prompts go through; ``lyrics``: song_id,
    lyrics. ``matched``: the requests' :func:`match`, where it is at hand already.
    """
    requests = settle(encoded(requests, encoder, vector_length(vectors) or HASH_DIM), "requests")
    matched = matched or match(requests, tracks, songs)
    hits = vector_hits(requests, matched.wanted(), matched.songs, vectors, depth, OVERFETCH_CANDIDATES)
    return _describe(requests, matched.wanted(), hits, lyrics, scorer, rerank_neutral, top_k)


def recommend_cli(requests: DataFrame, tracks: DataFrame, songs: DataFrame, vectors: DataFrame, lyrics: DataFrame,
                  top_k: int = TOP_K_CLI, depth: int = RERANK_DEPTH, scorer: Scorer | None = None,
                  matched: Matched | None = None, encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """Command-line form: fused search, missing lyrics leave the vector score as it is."""
    requests = settle(encoded(requests, encoder, vector_length(vectors) or HASH_DIM), "requests")
    matched = matched or match(requests, tracks, songs)
    hits = vector_hits(requests, matched.wanted(), matched.songs, vectors, depth, None)
    return _describe(requests, matched.wanted(), hits, lyrics, scorer, rerank_strict, top_k)


def score_watchlist(requests: DataFrame, watched: DataFrame, vectors: DataFrame, lyrics: DataFrame,
                    final: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Scores of watched matched songs, whether or not they made the final list.

    ``watched``: request_id, song_id, title, artist, views, one row per name and request.
    """
    pairs = settle(watched, "watched").join(with_vector(vectors), "song_id").join(
        requests.select("request_id", "q", "prompt"), "request_id").filter(F.size("embedding") == F.size("q"))
    scored = with_popularity(pairs.withColumn("raw_score", dot(F.col("embedding"), F.col("q"))).drop("embedding", "q"))
    fused = scored.withColumnRenamed("score", "vector_score").drop("raw_score", "views_multiplier")
    judged = score_relevance(fetch_lyrics(fused, lyrics, ["song_id"]), scorer).drop("prompt", "lyrics")
    names = final.select("request_id", "title", "artist").distinct().withColumn("_in", F.lit(True))
    return rerank_strict(judged).join(names, ["request_id", "title", "artist"], "left").withColumn(
        "in_final", F.coalesce("_in", F.lit(False))).drop("_in")
