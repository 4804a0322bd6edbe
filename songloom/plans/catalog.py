"""Every operator run over the given tables.

Each entry takes (spark, sf_dir) and returns a DataFrame with plain columns; floating
results are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.constants import (
    LYRICS_FOOTER,
    NEUTRAL_RELEVANCE,
    PLAYLIST_MAX_SONGS,
    PLAYLIST_MAX_TRACKS,
    PLAYLIST_MIN_TRACKS,
    RERANK_DEPTH,
    SAMPLES_PER_EPOCH,
)
from songloom.functions import payload, present, scores, text, vectors
from songloom.functions.keys import genre_tag, numeric
from songloom.functions.vectors import norm
from songloom.operators import block, chunks, encode, filters, histogram, matching, pairs, pruned, rank, scoring, search, snapshots, title_index
from songloom.plans import recommend as plan
from songloom.plans.views import register
from songloom.session import keep, scratch_path, settle, spread, tune
from songloom.sources import corpus, csv_corpus, key_index, npy, playlists
from songloom.streaming import jobs, machine, requests

Query = Callable[[SparkSession, str], DataFrame]

# What a user would type in: watched titles, search terms, genres.
WATCH_TERMS = ["Song 1", "song 39", "no such title", "Song (1|2)0"]
TITLE_TERM = "song (1|2)"
ARTIST_TERM = "src1"
GENRES = ["Pop", " rock "]

QUERIES: dict[str, Query] = {}


def query(function: Callable[["Data"], DataFrame]) -> Callable[["Data"], DataFrame]:
    """Register under the function's own name."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Data(tune(spark), sf_dir))

    QUERIES[function.__name__] = run
    return function


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def checksum(vector: Column) -> Column:
    """Sum of the elements, each times its position."""
    weighted = F.transform(vector.cast("array<double>"), lambda x, i: x * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


class Data:
    """The tables in their parts, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return register(self.spark, self.sf_dir, name)

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)

    @property
    def metadata(self) -> DataFrame:
        return self.songs.drop("lyrics")

    @property
    def centre(self) -> list[float]:
        """Mean of all vectors, as a unit vector: one row comes to the driver."""
        mean = self.vectors.agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("q"))
        return mean.select(vectors.l2_normalise(F.col("q")).alias("q")).first()["q"]

    @property
    def label_queries(self) -> DataFrame:
        """One query per label: the mean of its vectors, as a unit vector."""
        mean = self.vectors.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
            vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("q"))
        return mean.select("query_id", vectors.l2_normalise(F.col("q")).alias("q"))

    @property
    def raw_vectors(self) -> DataFrame:
        """Vectors of uneven length: only chunk 1 looks normalised, some are zero."""
        scale = F.when(F.col("song_id") % 97 == 0, 0.0).when(F.col("chunk_index") == 1, 1.0).otherwise(
            1.0 + F.col("song_id") % 3)
        return self.song_vectors.withColumn("scale", scale).withColumn(
            "embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("scale"))).drop("scale")

    @property
    def matched(self) -> DataFrame:
        return matching.match_candidates(self.metadata, self.tracks)

    @property
    def hits(self) -> DataFrame:
        """The best 100 songs of each label query, with a relevance from elsewhere.

        No lyrics (NULL relevance) and failed calls are in it too.
        """
        found = block.topk_batch(self.song_vectors, self.label_queries, RERANK_DEPTH)
        last = F.col("song_id") % 10
        return found.select(
            F.col("query_id").alias("request_id"), "song_id", "title", "artist", "views",
            F.col("score").alias("vector_score"),
            F.when(last != 0, F.col("song_id") % 101).cast("int").alias("relevance"),
            (last == 1).alias("failed"))

    @property
    def genre_requests(self) -> DataFrame:
        """Opening prompts, each with a list of genre labels."""
        kind = F.col("request_id") % 4
        genres = (F.when(kind == 0, F.array().cast("array<string>")).when(kind == 1, F.array(F.lit("Pop")))
                  .when(kind == 2, F.array(F.lit("R&B"), F.lit(" rock "))).otherwise(F.array(F.lit(""))))
        return self.openings.withColumn("genres", genres)

    def asked(self, songs: DataFrame) -> DataFrame:
        """Some songs with their requests, as ``asked_songs`` has them for all."""
        openings = settle(self.openings, "openings")
        requests = openings.agg(F.max("request_id") + 1).first()[0]
        return songs.join(openings, F.col("request_id") == F.col("song_id") % F.lit(requests))

    @property
    def requests(self) -> DataFrame:
        """Requests with the vector of their prompt."""
        return settle(plan.encoded(self.genre_requests, None, encode.HASH_DIM), "requests")

    @property
    def texts(self) -> DataFrame:
        """Songs for work that is heavy per lyric."""
        return spread(self.songs, "song_id")

    @property
    def song_lyrics(self) -> DataFrame:
        return self.songs.select("song_id", "lyrics")

    @property
    def bare_vectors(self) -> DataFrame:
        return self.vectors.select("song_id", "embedding")

    @property
    def pages(self) -> DataFrame:
        """Playlists as search-result pages; there are gaps between them, and items without a track.

        A playlist is an order and its items the order's few lines; a page is a few of a customer's orders.
        """
        image = F.when(F.col("image_url").isNotNull(), F.array(F.struct(F.col("image_url").alias("url")))).otherwise(
            F.array().cast("array<struct<url:string>>"))
        track = F.struct(
            F.col("track_id").alias("id"), "name",
            F.array(F.struct(F.col("artist_name").alias("name"))).alias("artists"),
            F.struct(F.col("url").alias("spotify")).alias("external_urls"),
            F.struct(image.alias("images")).alias("album"))
        item = F.struct("track_pos", F.struct(F.when(F.col("has_track"), track).alias("track")).alias("item"))
        page = ["request_id", "query_no", "page_no"]
        found = self.playlist_items.groupBy(*page, "playlist_pos", "playlist_id").agg(
            F.sort_array(F.collect_list(item)).alias("items"))
        playlist = F.struct(
            F.col("playlist_id").alias("id"), F.lit("playlist").alias("name"), F.col("items.item").alias("tracks"))
        placed = found.groupBy(*page).agg(
            F.map_from_entries(F.collect_list(F.struct("playlist_pos", playlist))).alias("placed"),
            F.max("playlist_pos").alias("last"))
        return placed.select(*page, F.transform(
            F.sequence(F.lit(0), F.col("last")), lambda at: F.element_at("placed", at)).alias("playlists"))

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What a service has at hand before the first request; made once per data folder."""
        return keep(self.spark, (self.sf_dir, name), make)

    @property
    def stored_pages(self) -> DataFrame:
        """The pages as the payload files they arrive in."""
        def write() -> DataFrame:
            path = self.scratch("pages-json")
            self.pages.write.option("compression", "snappy").json(path)
            return playlists.read_pages(self.spark, path)

        return self.stored("pages", write)

    @property
    def page_tracks(self) -> DataFrame:
        """The tracks of the pages, as a request has them: read from the nested payload."""
        return matching.track_fields(matching.flatten_playlists(self.stored_pages))

    @property
    def lyric_vectors(self) -> DataFrame:
        """Vectors of the lyrics, by the encoder that prompts go through."""
        def embed() -> DataFrame:
            embedded = encode.embed_texts(filters.drop_blank_lyrics(self.texts).select("song_id", "lyrics"), "lyrics")
            return settle(embedded.select("song_id", "embedding"), "lyric-vectors")

        return self.stored("lyric-vectors", embed)

    @property
    def key_index(self) -> DataFrame:
        """The metadata by match key."""
        return self.stored("key-index", lambda: key_index.store_key_index(
            self.metadata.select("song_id", "title", "artist", "tag", "views")))

    @property
    def title_index(self) -> DataFrame:
        return self.stored("title-index", lambda: title_index.store_title_index(self.metadata))

    def recommend(self) -> DataFrame:
        return plan.recommend(
            self.genre_requests, self.page_tracks, self.key_index, self.lyric_vectors, self.song_lyrics)

    def recommend_cli(self) -> DataFrame:
        return plan.recommend_cli(
            self.genre_requests, self.page_tracks, self.key_index, self.lyric_vectors, self.song_lyrics)


# Sources and sinks


@query
def scan_lyrics_csv(d: Data) -> DataFrame:
    path = d.scratch("lyrics-csv")
    csv_corpus.write_csv_chunks(d.songs.select("chunk_index", "song_id", "title", "artist", "lyrics"), path)
    rows = csv_corpus.scan_lyrics_csv(d.spark, path, ["song_id", "title", "lyrics"])
    return rows.select(F.col("song_id").cast("bigint").alias("song_id"), "chunk_index", "title",
                       F.length("lyrics").alias("chars"), F.md5("lyrics").alias("lyrics_md5"))


@query
def scan_csv_ranges(d: Data) -> DataFrame:
    """The same files in ranges far smaller than a file, so that records begin and end anywhere in them."""
    path = d.scratch("lyrics-csv")
    csv_corpus.write_csv_chunks(d.songs.select("chunk_index", "song_id", "title", "artist", "lyrics"), path)
    rows = csv_corpus.scan_lyrics_csv(d.spark, path, ["song_id", "artist", "lyrics"], range_bytes=512 << 10)
    return rows.select(F.col("song_id").cast("bigint").alias("song_id"), "chunk_index", "artist", F.md5("lyrics").alias("lyrics_md5"))


@query
def scan_metadata_csv(d: Data) -> DataFrame:
    path = d.scratch("metadata-csv")
    csv_corpus.write_csv_chunks(d.metadata.select("chunk_index", "song_id", "title", "artist", "views"), path)
    rows = csv_corpus.scan_metadata_csv(d.spark, path)
    return rows.select(F.col("song_id").cast("bigint").alias("song_id"), "chunk_index", "title", "artist", "views")


@query
def scan_metadata(d: Data) -> DataFrame:
    path = d.scratch("metadata")
    corpus.write_clean(d.metadata, path)
    return corpus.scan_metadata(d.spark, path, d.metadata.columns)


@query
def scan_npy(d: Data) -> DataFrame:
    path = d.scratch("vectors-npy")
    npy.write_npy(d.vectors, path, dtype="<f4")
    return npy.scan_npy(d.spark, path).select(
        "chunk_index", "original_index", F.size("embedding").alias("dim"), r6(checksum(F.col("embedding"))).alias("checksum"))


@query
def align_chunks(d: Data) -> DataFrame:
    aligned = chunks.align_chunks(
        d.metadata, d.vectors.drop("song_id"), d.songs.select(*chunks.POSITION, "lyrics"))
    return aligned.select("song_id", *chunks.POSITION, F.size("embedding").alias("dim"), F.md5("lyrics").alias("lyrics_md5"))


@query
def chunk_inventory(d: Data) -> DataFrame:
    return chunks.chunk_inventory(d.metadata, d.vectors, [1, 2, 3, 4, 5])


@query
def chunk_status_line(d: Data) -> DataFrame:
    return chunks.chunk_status_line(chunks.chunk_inventory(d.metadata, d.vectors, [1, 2, 3, 4, 5]))


@query
def split_to_sizes(d: Data) -> DataFrame:
    sizes = chunks.chunk_sizes(d.songs)
    rows = d.songs.select("song_id", "title")
    return chunks.split_to_sizes(rows, "song_id", sizes).select("song_id", "chunk_index", "original_index")


@query
def write_clean(d: Data) -> DataFrame:
    stored = corpus.write_clean(filters.clean_corpus(d.songs), d.scratch("clean"))
    return stored.select("song_id", *chunks.POSITION, "year", "language", F.md5("lyrics").alias("lyrics_md5"))


@query
def write_clean_reported(d: Data) -> DataFrame:
    """The report that the write of the cleaned corpus gives of itself."""
    return corpus.write_clean_reported(d.songs, filters.clean_corpus, d.scratch("clean"), [1, 2, 3, 4, 5])[1]


@query
def flatten_playlists(d: Data) -> DataFrame:
    return matching.track_fields(matching.flatten_playlists(d.stored_pages))


@query
def playlist_sink(d: Data) -> DataFrame:
    ranked = rank.rank_results(rank.rerank_neutral(d.hits), ["request_id"])
    songs = ranked.withColumn("id", present.result_id(F.col("rank") - 1, F.col("title"), F.col("artist")))
    path = d.scratch("playlists")
    playlists.write_playlists(playlists.playlists(d.genre_requests, songs), path)
    fields = "id bigint, title string, genres array<string>, songs array<struct<id:string,title:string,score:double>>"
    return d.spark.read.schema(fields).json(path).select(
        "id", "title", F.array_join("genres", "|").alias("genres"), F.size("songs").alias("n_songs"),
        F.array_join("songs.id", "|").alias("song_ids"), r6(F.col("songs")[0]["score"]).alias("top_score"))


@query
def incremental_embed(d: Data) -> DataFrame:
    """Vectors for the songs that have none yet, of the length of those that are stored; all are searched."""
    path = d.scratch("stored-vectors")
    corpus.store_vectors(d.bare_vectors, path)
    stored = d.spark.read.parquet(path)
    new = encode.without_vectors(filters.drop_blank_lyrics(d.texts), stored)
    vectors = encode.embed_texts(new, "lyrics", dim=corpus.vector_length(stored))
    corpus.append_vectors(vectors.select("song_id", "embedding"), path)
    whole = d.spark.read.parquet(path)
    return search.cosine_scan(whole, d.centre).select(
        "song_id", F.size("embedding").alias("dim"), F.round(checksum(F.col("embedding")), 3).alias("checksum"),
        F.round("raw_score", 6).alias("raw_score"))


# Projections, filters and predicates


@query
def normalise_key(d: Data) -> DataFrame:
    return matching.with_track_keys(d.tracks).select(
        "request_id", "playlist_id", "track_pos", "norm_title", "norm_artist")


@query
def numeric_coerce(d: Data) -> DataFrame:
    return d.songs.select("song_id", numeric(F.col("views")).alias("views"), numeric(F.col("year")).alias("year"))


@query
def year_filter(d: Data) -> DataFrame:
    return filters.year_filter(d.metadata).select("song_id", "year")


@query
def language_filter(d: Data) -> DataFrame:
    return filters.language_filter(d.metadata).select("song_id", "language")


@query
def clean_corpus(d: Data) -> DataFrame:
    aligned = chunks.align_chunks(d.metadata, d.vectors.drop("song_id"), d.songs.select(*chunks.POSITION, "lyrics"))
    return filters.clean_corpus(aligned).select(
        "song_id", "year", "language", r6(checksum(F.col("embedding"))).alias("checksum"),
        F.length("lyrics").alias("chars"))


@query
def genre_filter(d: Data) -> DataFrame:
    return filters.genre_filter(d.metadata, GENRES).select("song_id", "tag")


@query
def genre_label_map(d: Data) -> DataFrame:
    labels = d.genre_requests.select("request_id", F.posexplode("genres").alias("pos", "label"))
    return labels.withColumn("tag", genre_tag(F.col("label")))


@query
def genre_filter_requests(d: Data) -> DataFrame:
    """Each request's own genres against its share of the songs."""
    songs = d.asked_songs.select("song_id", "tag", "request_id")
    joined = songs.join(d.genre_requests.select("request_id", "genres"), "request_id")
    return filters.genre_filter_per_request(joined).select("request_id", "song_id", "tag")


@query
def drop_unidentified(d: Data) -> DataFrame:
    return filters.drop_unidentified(d.metadata).select("song_id", "title", "artist")


@query
def drop_blank_lyrics(d: Data) -> DataFrame:
    return filters.drop_blank_lyrics(d.songs).select("song_id", F.md5("lyrics").alias("lyrics_md5"))


@query
def search_titles(d: Data) -> DataFrame:
    return filters.search_titles(d.metadata, TITLE_TERM, ARTIST_TERM).select("song_id", "title", "artist")


@query
def watchlist_found(d: Data) -> DataFrame:
    return filters.watchlist_found(d.matched, WATCH_TERMS)


@query
def watchlist_matches(d: Data) -> DataFrame:
    return filters.watchlist_matches(d.matched, WATCH_TERMS).select("term", "song_id", "title", "artist")


@query
def match_terms(d: Data) -> DataFrame:
    """Every name among the tracks as a term, some hundreds or many thousands, against the whole corpus."""
    terms = d.tracks.select(F.col("name").alias("term")).distinct()
    return title_index.match_terms(d.metadata.select("song_id", "title"), terms, d.title_index).select("term", "song_id")


@query
def found_terms(d: Data) -> DataFrame:
    terms = d.tracks.select(F.col("name").alias("term")).distinct()
    return title_index.found_terms(d.metadata, terms, d.title_index)


@query
def training_columns(d: Data) -> DataFrame:
    return filters.training_columns(d.songs).select("song_id", "title", "artist", F.md5("lyrics").alias("lyrics_md5"))


@query
def min_score_filter(d: Data) -> DataFrame:
    judged = d.hits.filter(F.col("relevance").isNotNull()).select("song_id", "relevance").distinct()
    return rank.min_score_filter(filters.drop_blank_lyrics(d.songs), judged).select("song_id", "title", "artist", "relevance")


@query
def nonneg_views(d: Data) -> DataFrame:
    return filters.valid_views(d.view_counts).select("event_id", r6("views").alias("views"))


# Joins


@query
def match_candidates(d: Data) -> DataFrame:
    return d.matched.select("song_id", "norm_title", "norm_artist")


@query
def match_candidates_stored(d: Data) -> DataFrame:
    """As ``match_candidates``, from the corpus stored by key."""
    keys = settle(matching.distinct_keys(d.tracks), "keys")
    return matching.match_keys(d.key_index, keys).select("song_id", "norm_title", "norm_artist")


@query
def match_candidates_strict(d: Data) -> DataFrame:
    return matching.match_candidates_strict(d.metadata, d.tracks)


@query
def attach_track_attrs(d: Data) -> DataFrame:
    order = ["request_id", *matching.SEEN_ORDER]
    return matching.attach_track_attrs(d.matched, d.tracks, order).select(
        "song_id", "norm_title", "norm_artist", "track_id", "url", "image_url")


@query
def restrict_to_hits(d: Data) -> DataFrame:
    return matching.restrict_to_hits(d.matched, d.hits).select("song_id", "title", "artist")


@query
def fetch_lyrics(d: Data) -> DataFrame:
    lyrics = d.songs.select(*chunks.POSITION, "lyrics")
    return rank.fetch_lyrics(d.matched.select("song_id", *chunks.POSITION), lyrics, chunks.POSITION).select(
        "song_id", *chunks.POSITION, F.length("lyrics").alias("chars"), F.md5("lyrics").alias("lyrics_md5"))


@query
def lookup_ids(d: Data) -> DataFrame:
    found = matching.lookup_ids(d.hits.select("request_id", "song_id", "vector_score"), d.metadata)
    return found.orderBy(*search.best_first("vector_score")).select(
        "request_id", "song_id", "title", "artist", "tag", "language", r6("vector_score").alias("vector_score"))


@query
def enrich_hits(d: Data) -> DataFrame:
    matched = matching.match_and_attach(d.metadata, d.tracks, ["request_id", *matching.SEEN_ORDER])
    return matching.enrich_hits(d.hits.select("request_id", "song_id", "title", "artist"), matched)


@query
def watchlist_in_final(d: Data) -> DataFrame:
    watched = filters.watchlist_matches(d.matched, WATCH_TERMS).select("song_id", "title", "artist").distinct()
    final = rank.rank_results(rank.rerank_strict(d.hits), ["request_id"]).filter(F.col("rank") <= 25)
    return matching.flag_in_final(watched, final)


@query
def query_x_corpus(d: Data) -> DataFrame:
    profile = block.similarity_profile(d.song_vectors, d.label_queries)
    return profile.select("query_id", "songs", *[r6(c).alias(c) for c in ("mean_score", "lowest_score", "highest_score")])


# Aggregation and distinct


@query
def dedup_tracks(d: Data) -> DataFrame:
    return matching.dedup_tracks(d.tracks, matching.SEEN_ORDER, ["request_id"])


@query
def dedup_keys_first(d: Data) -> DataFrame:
    return matching.dedup_keys_first(d.tracks, matching.SEEN_ORDER, ["request_id"]).select(
        "request_id", "norm_title", "norm_artist", "track_id", "url", *matching.SEEN_ORDER)


@query
def distinct_keys(d: Data) -> DataFrame:
    return matching.distinct_keys(d.tracks)


@query
def dedup_corpus(d: Data) -> DataFrame:
    return matching.dedup_corpus(d.songs).select("song_id", "norm_title", "norm_artist", F.length("lyrics").alias("chars"))


@query
def corpus_counts(d: Data) -> DataFrame:
    return chunks.corpus_counts(d.metadata)


@query
def clean_report(d: Data) -> DataFrame:
    return filters.clean_report(d.metadata)


@query
def views_hist_edges(d: Data) -> DataFrame:
    return histogram.histogram_edges(filters.valid_views(d.view_counts))


@query
def views_hist_equal(d: Data) -> DataFrame:
    return histogram.histogram_equal(filters.valid_views(d.view_counts))


@query
def views_trimmed(d: Data) -> DataFrame:
    return histogram.trimmed_count(filters.valid_views(d.view_counts))


@query
def vector_profile(d: Data) -> DataFrame:
    return chunks.vector_profile(d.raw_vectors).withColumn("mean_norm", r6("mean_norm"))


@query
def run_summary(d: Data) -> DataFrame:
    asked, tracks = d.requests, d.page_tracks
    found = plan.match(asked, tracks, d.key_index)
    hits = plan.vector_hits(asked, found.wanted(), found.songs, d.lyric_vectors)
    return matching.run_summary(asked, tracks, found.names, found.wanted(), hits)


@query
def pair_counts(d: Data) -> DataFrame:
    return pairs.pair_counts(d.texts)


@query
def candidates_by_chunk(d: Data) -> DataFrame:
    return chunks.candidates_by_chunk(d.matched)


# Vector arithmetic, scores and top-k


@query
def l2_normalise(d: Data) -> DataFrame:
    done = search.normalise_vectors(d.raw_vectors)
    return done.select("song_id", r6(norm(F.col("embedding"))).alias("length"), r6(checksum(F.col("embedding"))).alias("checksum"))


@query
def cosine_scan(d: Data) -> DataFrame:
    return search.cosine_scan(d.song_vectors, d.centre).select("song_id", r6("raw_score").alias("raw_score"))


@query
def cosine_raw(d: Data) -> DataFrame:
    return search.cosine_raw(d.raw_vectors, d.centre).select("song_id", "title", "artist", r6("score").alias("score"))


@query
def views_multiplier(d: Data) -> DataFrame:
    return d.metadata.select("song_id", r6(scores.views_multiplier(numeric(F.col("views")))).alias("views_multiplier"))


def _shown(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.select(*keys, "song_id", "title", "artist", "views", *[
        r6(c).alias(c) for c in ("raw_score", "views_multiplier", "score")])


@query
def topk_fused(d: Data) -> DataFrame:
    return _shown(search.topk_fused(d.song_vectors, d.centre))


@query
def topk_fused_candidates(d: Data) -> DataFrame:
    return _shown(search.topk_fused_candidates(d.song_vectors, d.matched, d.centre))


@query
def topk_two_stage(d: Data) -> DataFrame:
    return _shown(search.topk_two_stage(d.song_vectors, d.centre))


@query
def topk_two_stage_candidates(d: Data) -> DataFrame:
    return _shown(search.topk_two_stage_candidates(d.song_vectors, d.matched, d.centre))


@query
def topk_batch(d: Data) -> DataFrame:
    return _shown(block.topk_batch(d.song_vectors, d.label_queries), "query_id", "rank")


@query
def topk_batch_pruned(d: Data) -> DataFrame:
    """The same from stored groups, those skipped that cannot hold one of the best."""
    songs = d.song_vectors
    return _shown(pruned.topk_pruned(pruned.store_groups(songs), songs, d.label_queries), "query_id", "rank")


@query
def topk_batch_two_stage(d: Data) -> DataFrame:
    return _shown(block.topk_batch(d.song_vectors, d.label_queries, fused=False), "query_id", "rank")


@query
def blend_scores(d: Data) -> DataFrame:
    known = d.hits.withColumn("relevance", F.coalesce("relevance", F.lit(NEUTRAL_RELEVANCE)))
    return rank.blend_scores(known).select("request_id", "song_id", "relevance", r6("score").alias("score"))


@query
def rerank_neutral(d: Data) -> DataFrame:
    ranked = rank.rank_results(rank.rerank_neutral(d.hits), ["request_id"])
    return ranked.select("request_id", "rank", "song_id", "relevance", r6("score").alias("score"))


@query
def rerank_strict(d: Data) -> DataFrame:
    ranked = rank.rank_results(rank.rerank_strict(d.hits), ["request_id"])
    return ranked.select("request_id", "rank", "song_id", "relevance", r6("score").alias("score"))


@query
def score_watchlist(d: Data) -> DataFrame:
    asked = d.requests
    found = plan.match(asked, d.page_tracks, d.key_index)
    kept = found.wanted().select("request_id", "song_id", "title", "artist", "views")
    watched = matching.first_song_per_name(filters.watchlist_matches(kept, WATCH_TERMS).drop("term"), ["request_id"])
    final = plan.recommend_cli(
        asked, d.page_tracks, d.metadata, d.lyric_vectors, d.song_lyrics, matched=found)
    scored = plan.score_watchlist(asked, watched, d.lyric_vectors, d.song_lyrics, final)
    return scored.select("request_id", "song_id", "title", "artist", "views", "relevance", "in_final",
                         r6("vector_score").alias("vector_score"), r6("score").alias("score"))


@query
def recommend(d: Data) -> DataFrame:
    return d.recommend().withColumn("score", r6("score")).withColumn("vector_score", r6("vector_score"))


@query
def recommend_cli(d: Data) -> DataFrame:
    return d.recommend_cli().withColumn("score", r6("score")).withColumn("vector_score", r6("vector_score"))


@query
def normalise_if_needed(d: Data) -> DataFrame:
    done = search.normalise_if_needed(d.raw_vectors)
    return done.select("song_id", "already_unit", r6(norm(F.col("embedding"))).alias("length"),
                       r6(checksum(F.col("embedding"))).alias("checksum"))


# Ranks and samples


@query
def rank_results(d: Data) -> DataFrame:
    return rank.rank_results(d.hits, ["request_id"], "vector_score").select("request_id", "rank", "song_id")


@query
def pick_playlist_in_range(d: Data) -> DataFrame:
    return matching.pick_playlists(d.tracks, PLAYLIST_MIN_TRACKS, PLAYLIST_MAX_TRACKS, PLAYLIST_MAX_SONGS).select(
        "request_id", "rank", "query_no", "playlist_id", "track_id", "name")


@query
def quota_sample(d: Data) -> DataFrame:
    return pairs.quota_sample(d.songs, SAMPLES_PER_EPOCH).select("chunk_index", "sample_no", "song_id")


@query
def epoch_pairs(d: Data) -> DataFrame:
    return pairs.epoch_pairs(d.songs).select(
        "pair_no", "chunk_index", "kind", "song_id", F.md5("sentence_0").alias("md5_0"), F.md5("sentence_1").alias("md5_1"))


@query
def shuffle_pairs(d: Data) -> DataFrame:
    return pairs.shuffle_pairs(pairs.training_pairs(d.texts)).select(
        "song_id", "kind", "draw_no", "shuffle_key",
        F.md5("sentence_0").alias("md5_0"), F.md5("sentence_1").alias("md5_1"))


@query
def epoch_order(d: Data) -> DataFrame:
    """All training pairs with their place in the order of one epoch."""
    numbered = pairs.numbered_pairs(pairs.training_pairs(d.texts).drop("sentence_0", "sentence_1"))
    return pairs.epoch_places(numbered, numbered.count(), 3).select("song_id", "kind", "draw_no", "pair_no", "place")


@query
def epoch_shards(d: Data) -> DataFrame:
    """The same order in two stretches, each computed for itself: the first and last pair of each."""
    numbered = pairs.numbered_pairs(pairs.training_pairs(d.texts).drop("sentence_0", "sentence_1"))
    n = numbered.count()
    parts = [pairs.epoch_shard(numbered, n, 3, k, 2).groupBy(F.lit(k).alias("shard")).agg(
        F.count("*").alias("pairs"), F.min_by("pair_no", "place").alias("first"), F.max_by("pair_no", "place").alias("last"))
        for k in range(2)]
    return parts[0].unionAll(parts[1])


@query
def union_chunks(d: Data) -> DataFrame:
    # Stored by chunk first, so that each part reads its own folder.
    rows = corpus.write_clean(d.metadata, d.scratch("metadata"))
    numbers = [r["chunk_index"] for r in rows.select("chunk_index").distinct().collect()]
    parts = {n: rows.filter(F.col("chunk_index") == n).drop("chunk_index") for n in numbers}
    return chunks.union_chunks(parts).select("song_id", "title", "artist", "chunk_index", "original_index")


# Text, payloads and presentation


@query
def passages(d: Data) -> DataFrame:
    return pairs.passage_rows(d.texts).select(
        "song_id", "passage_no", F.length("passage").alias("chars"), F.md5("passage").alias("passage_md5"))


@query
def positive_pairs(d: Data) -> DataFrame:
    return pairs.positive_pairs(d.texts)


@query
def synthetic_queries(d: Data) -> DataFrame:
    return pairs.synthetic_queries(d.texts)


@query
def truncate_lyrics(d: Data) -> DataFrame:
    short = text.truncate_lyrics(F.col("lyrics"))
    return d.songs.select("song_id", F.length(short).alias("chars"), F.md5(short).alias("lyrics_md5"))


@query
def render_prompt(d: Data) -> DataFrame:
    request = text.render_prompt(F.col("prompt"), F.col("title"), F.col("artist"), F.col("lyrics"))
    return d.asked_songs.select("song_id", F.length(request).alias("chars"), F.md5(request).alias("request_md5"))


@query
def parse_score(d: Data) -> DataFrame:
    return d.responses.select("event_id", payload.parse_score(F.col("response")).alias("score"))


@query
def parse_queries_json(d: Data) -> DataFrame:
    """Prompts sent back as fenced JSON lists of their words; every fifth is cut off."""
    words = F.split("prompt", " ")
    response = F.concat(F.lit("```json\n"), F.to_json(F.struct(words.alias("queries"))),
                        F.when(F.col("prompt_id") % 5 != 0, "\n```").otherwise(" and"))
    phrases = payload.parse_phrases_json(response)
    return d.prompts.select("prompt_id", F.posexplode(phrases).alias("pos", "phrase"))


@query
def parse_queries_lines(d: Data) -> DataFrame:
    """Prompts as line-by-line responses; every fifth call failed."""
    lines = F.replace(F.col("prompt"), F.lit(". "), F.lit(" \n\n "))
    response = F.when(F.col("prompt_id") % 5 != 0, lines)
    return d.prompts.select("prompt_id", F.posexplode(payload.parse_phrases_lines(response)).alias("pos", "phrase"))


@query
def query_context(d: Data) -> DataFrame:
    return d.genre_requests.select(
        "request_id", text.query_context(F.col("prompt"), F.col("genres")).alias("context"),
        text.genre_focus(F.col("genres")).alias("focus"))


@query
def first_nested(d: Data) -> DataFrame:
    tracks = matching.flatten_playlists(d.pages)
    track = F.col("track")
    return tracks.select(
        "playlist_id", "track_pos", payload.first_artist(track).alias("artist"),
        payload.track_url(track).alias("url"), payload.first_image(track).alias("image_url"))


@query
def clean_lyrics(d: Data) -> DataFrame:
    """Lyrics as a scraper finds them, with page text at the end."""
    found = F.concat(F.coalesce("lyrics", F.lit("")), F.lit("\n12"), F.lit(LYRICS_FOOTER))
    cleaned = d.texts.select("song_id", text.clean_lyrics(found).alias("lyrics"))
    return cleaned.filter(F.col("lyrics").isNotNull()).select(
        "song_id", F.length("lyrics").alias("chars"), F.md5("lyrics").alias("lyrics_md5"))


@query
def playlist_title(d: Data) -> DataFrame:
    title = text.playlist_title(F.col("prompt"))
    return d.prompts.select("prompt_id", title.alias("title"), text.short_title(title).alias("short_title"))


@query
def result_id(d: Data) -> DataFrame:
    ranked = rank.rank_results(d.hits, ["request_id"], "vector_score")
    return ranked.select("request_id", "song_id", present.result_id(
        F.col("rank") - 1, F.col("title"), F.col("artist")).alias("result_id"))


@query
def present_row(d: Data) -> DataFrame:
    """Songs as shown; length stands in for duration, the last digits of the id for the score."""
    views = numeric(F.col("views"))
    rows = d.asked_songs.join(d.genre_requests.select("request_id", "genres"), "request_id")
    return rows.select(
        "song_id",
        present.duration_text(F.coalesce(F.length("lyrics"), F.lit(0)) * 130).alias("duration"),
        present.percent_text((F.col("song_id") % 200) / F.lit(200.0)).alias("percent"),
        present.streams(views).alias("streams"),
        present.genres_text(F.col("genres")).alias("genres"))


@query
def message_count(d: Data) -> DataFrame:
    return d.job_events.select("event_id", payload.message_count(F.col("message")).alias("songs"))


# Encoders and scorers


@query
def embed_texts(d: Data) -> DataFrame:
    vector = F.col("embedding")
    embedded = encode.embed_texts(filters.drop_blank_lyrics(d.texts).select("song_id", "lyrics"), "lyrics")
    return embedded.select(
        "song_id", F.size(vector).alias("dim"), F.size(F.filter(vector, lambda x: x != 0)).alias("nonzero"),
        F.round(norm(vector), 4).alias("length"), F.round(checksum(vector), 3).alias("checksum"))


@query
def embed_snapshots(d: Data) -> DataFrame:
    """Vectors after two updates: some lyrics were drafts at first, some songs came later, some are gone again."""
    path, songs = d.scratch("snapshots"), d.texts.select("song_id", "lyrics")
    draft = F.when(F.col("song_id") % 9 == 0, F.concat("lyrics", F.lit(" draft"))).otherwise(F.col("lyrics"))
    gone = songs.filter("song_id % 50 = 1").withColumn("song_id", F.col("song_id") + 1_000_000_000)
    snapshots.update_snapshot(songs.filter("song_id % 10 <> 3").withColumn("lyrics", draft).unionAll(gone), path)
    snapshots.update_snapshot(songs, path)
    now = snapshots.read_snapshot(d.spark, path)
    return now.select("song_id", "lyrics_hash", "delta", F.round(checksum(F.col("embedding")), 3).alias("checksum"))


@query
def score_relevance(d: Data) -> DataFrame:
    rows = spread(d.asked_songs, "song_id")
    return encode.score_relevance(rows).select("song_id", "relevance")


def _judge(asked: list[str]) -> list[str]:
    """Stands in for a model that answers in JSON: the length of the request, as a score."""
    return [f'```json\n{{"score": {len(text) % 131}}}\n```' if len(text) % 7 else "no answer" for text in asked]


@query
def score_with_model(d: Data) -> DataFrame:
    """Requests rendered, answered by a scorer and its answers read."""
    rows = spread(d.asked_songs, "song_id")
    return encode.score_relevance(rows, _judge).select("song_id", "relevance")


def _judge_or_fail(asked: list[str]) -> list[str]:
    """The same, but calls of some lengths fail, however often they are tried."""
    if any(len(text) % 5 == 0 for text in asked):
        raise ConnectionError("no answer in time")
    return _judge(asked)


@query
def score_with_failures(d: Data) -> DataFrame:
    """Calls that fail stay with their song; the second run asks about these and the rest only."""
    # Stored: the songs meet their requests once, not again for each reading.
    asked = settle(d.asked_songs.select("song_id", "title", "artist", "prompt", "lyrics"), "asked-songs")
    rows, memo = spread(asked, "song_id"), d.scratch("memo")
    scoring.score_with_memo(rows.filter("song_id % 3 = 0"), _judge_or_fail, memo).agg(F.count_if("failed")).first()
    return scoring.score_with_memo(rows, _judge_or_fail, memo).select("song_id", "relevance", "failed", "error")


@query
def rerank_with_failures(d: Data) -> DataFrame:
    """Hits judged by a scorer some of whose calls fail: these keep their vector score."""
    hits = settle(d.hits.select("request_id", "song_id", "vector_score"), "hits")
    songs = d.asked(d.songs.join(hits.select("song_id").distinct(), "song_id", "left_semi"))
    found = settle(hits.join(songs.select("song_id", "title", "artist", "prompt", "lyrics"), "song_id"), "asked-hits")
    judged = scoring.score_with_memo(found, _judge_or_fail, d.scratch("memo"))
    ranked = rank.rank_results(rank.rerank_neutral(judged), ["request_id"])
    return ranked.select("request_id", "rank", "song_id", "relevance", r6("score").alias("score"))


# Streams


@query
def job_status(d: Data) -> DataFrame:
    return jobs.job_status(d.job_events)


@query
def job_status_stream(d: Data) -> DataFrame:
    """The same states kept up to date from event files that arrive one after the other."""
    arriving, output = d.scratch("events-in"), d.scratch("states-out")
    events = d.job_events
    events.repartitionByRange(4, "event_id").write.parquet(arriving)

    def publish(states: DataFrame, batch_id: int) -> None:
        states.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    stream = d.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    jobs.stream_job_status(stream, d.scratch("states-checkpoint"), publish).awaitTermination()
    stored = d.spark.read.parquet(output)
    rest = [c for c in stored.columns if c not in ("job_id", "batch_id")]
    return stored.groupBy("job_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("s")).select("job_id", "s.*")


@query
def job_machine_stream(d: Data) -> DataFrame:
    """Events checked as they arrive, in order of time: the state of each job and how many of its events were refused."""
    arriving, output, events = d.scratch("events-in"), d.scratch("reports-out"), settle(d.job_events, "job-events")
    edges = events.agg(F.percentile_approx("ts", [0.3, 0.7])).first()[0]
    part = F.when(F.col("ts") < F.lit(edges[0]), 0).when(F.col("ts") < F.lit(edges[1]), 1).otherwise(2)
    files = d.spark.sparkContext.defaultParallelism
    for k in range(3):  # one after the other, so that they are read in this order; a job's events of a part are in one file
        events.filter(part == k).repartition(files, "job_id").write.mode("append").parquet(arriving)
    stream = d.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(arriving)
    machine.stream_job_reports(stream, output, d.scratch("reports-checkpoint")).awaitTermination()
    return machine.latest_states(d.spark.read.parquet(output))


@query
def recommend_stages_stream(d: Data) -> DataFrame:
    """Requests answered stage by stage; some are cancelled ahead of the first stage, some ahead of the third.

    Both outputs read back: how far each request came, and how many songs it got.
    """
    arriving, output, told = d.scratch("requests-in"), d.scratch("answers-out"), d.scratch("progress-out")
    asked = settle(d.genre_requests, "requests")
    asked.repartitionByRange(2, "request_id").write.parquet(arriving)
    from_stage = F.when(F.col("request_id") % 5 == 0, 0).when(F.col("request_id") % 5 == 1, 2)
    stream = d.spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    requests.staged_stream(
        stream, plan.recommend_stages(settle(d.page_tracks, "tracks"), d.key_index, d.lyric_vectors, d.song_lyrics),
        lambda no: asked.filter(from_stage <= no), output, told, d.scratch("answers-checkpoint")).awaitTermination()
    answers = d.spark.read.parquet(output).groupBy("request_id").agg(F.count(F.lit(1)).alias("songs"))
    far = requests.latest_progress(d.spark.read.parquet(told))
    return far.join(answers, "request_id", "left").fillna(0, ["songs"])


@query
def recommend_stream(d: Data) -> DataFrame:
    """Requests that arrive as files, answered batch by batch."""
    arriving, output = d.scratch("requests-in"), d.scratch("answers-out")
    asked = d.genre_requests
    asked.repartitionByRange(2, "request_id").write.parquet(arriving)
    stream = d.spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    tracks, songs, vectors = settle(d.page_tracks, "tracks"), d.key_index, d.lyric_vectors

    def answer(batch: DataFrame) -> DataFrame:
        return plan.recommend(batch, tracks, songs, vectors, d.song_lyrics)

    requests.recommend_stream(stream, answer, output, d.scratch("answers-checkpoint")).awaitTermination()
    return d.spark.read.parquet(output).drop("batch_id").withColumn("score", r6("score")).withColumn(
        "vector_score", r6("vector_score"))
