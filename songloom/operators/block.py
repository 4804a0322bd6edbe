"""Many queries against many songs, block by block.

A block of song vectors times a block of query vectors is one matrix product; pairs never
become rows. The product only says which songs can be among the best: those are scored once
more by adding up in the order that the SQL expressions use, so a song has the same score, to
the last bit, whichever way it was found.

The corpus stays where it is. Queries are stored in the shared folder in files of
``QUERY_BLOCK_ROWS``; each task reads them block by block and keeps the best songs of every
query over all its batches. ``QUERIES_PER_SCAN`` queries are answered by one reading of the
corpus, more by more readings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.constants import OVERFETCH_ALL, TOP_K_SEARCH_CHUNKS
from songloom.functions.keys import numeric
from songloom.functions.scores import views_multiplier
from songloom.operators.filters import drop_unidentified
from songloom.operators.groups import top_k_per_group
from songloom.operators.search import best_first, rank_pairs, with_vector
from songloom.session import scratch_path, settle

# One matrix product: rows of songs and of queries. 16,384 x 512 results take 64 MB.
SONG_BLOCK_ROWS = 16_384
QUERY_BLOCK_ROWS = 512
# Queries whose best songs a task keeps at a time.
QUERIES_PER_SCAN = 4_096


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1 or column.null_count or column.flatten().null_count:
        raise ValueError(f"{name} has vectors of different lengths or missing numbers")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scalar products, added up from the first element to the last."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


class Best:
    """The k best songs of each query of a block by similarity times weight, ties by song id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        nothing = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.kept = [nothing] * len(query_ids)  # (song ids, similarity, similarity times weight), best first

    def add(self, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> None:
        if not len(ids):
            return
        near = vectors @ self.queries.T * weights[:, None]
        # More than the rounding of either way to add up.
        lengths = np.sqrt((vectors ** 2).sum(axis=1)) * np.abs(weights)
        slack = 1e-15 * vectors.shape[1] * lengths.max() * np.sqrt((self.queries ** 2).sum(axis=1))
        k, reach = self.k, near.max(axis=0) + slack
        for q, (old_ids, old_raw, old_ranked) in enumerate(self.kept):
            full = len(old_ids) >= k
            if full and reach[q] < old_ranked[-1]:
                continue
            least = old_ranked[-1] if full else -np.inf
            if len(ids) > k:
                least = max(least, np.partition(near[:, q], len(ids) - k)[len(ids) - k] - slack[q])
            at = np.flatnonzero(near[:, q] >= least - slack[q])
            raw = exact_products(vectors[at], self.queries[q])
            found = (np.concatenate([old_ids, ids[at]]), np.concatenate([old_raw, raw]),
                     np.concatenate([old_ranked, raw * weights[at]]))
            order = np.lexsort((found[0], -found[2]))[:k]
            self.kept[q] = tuple(values[order] for values in found)

    def table(self) -> pa.Table:
        sizes = [len(ids) for ids, _, _ in self.kept]
        ids, raw, ranked = (np.concatenate([kept[i] for kept in self.kept]) if self.kept else np.zeros(0) for i in range(3))
        return pa.table({"query_id": np.repeat(self.query_ids, sizes), "song_id": ids.astype(np.int64),
                         "raw_score": raw, "ranked_score": ranked})


class Profile:
    """How many songs each query of a block met, the sum of their similarity and its extremes."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray):
        self.query_ids, self.queries, self.songs = query_ids, queries, 0
        n = len(query_ids)
        self.total, self.lowest, self.highest = np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> None:
        if not len(ids):
            return
        raw = vectors @ self.queries.T
        self.songs += len(ids)
        self.total += raw.sum(axis=0)
        self.lowest, self.highest = np.minimum(self.lowest, raw.min(axis=0)), np.maximum(self.highest, raw.max(axis=0))

    def table(self) -> pa.Table:
        some = slice(None) if self.songs else slice(0)
        return pa.table({
            "query_id": self.query_ids[some], "songs": np.full(len(self.query_ids), self.songs)[some],
            "total": self.total[some], "lowest": self.lowest[some], "highest": self.highest[some]})


_BEST_SCHEMA = "query_id bigint, song_id bigint, raw_score double, ranked_score double"
_PROFILE_SCHEMA = "query_id bigint, songs bigint, total double, lowest double, highest double"

# (query ids, query matrix) -> what gathers a task's results
Gather = Callable[[np.ndarray, np.ndarray], Best | Profile]


def _read(uri: str) -> pa.Table:
    filesystem, path = fs.FileSystem.from_uri(uri)
    return pq.read_table(path, filesystem=filesystem, columns=["query_id", "q"], partitioning=None)


def _scan(batches: Iterator[pa.RecordBatch], gather: Gather, files: list[str]) -> Iterator[pa.RecordBatch]:
    """One result per task and query, made over all batches of the task."""
    blocks = [_read(file) for file in files]
    gathered = [gather(_numbers(b, "query_id"), _matrix(b, "q")) for b in blocks]
    for batch in batches:
        songs = pa.Table.from_batches([batch])
        for at in range(0, songs.num_rows, SONG_BLOCK_ROWS):
            part = songs.slice(at, SONG_BLOCK_ROWS)
            ids, vectors, weights = _numbers(part, "song_id"), _matrix(part, "embedding"), _numbers(part, "weight")
            for one in gathered:
                one.add(ids, vectors, weights)
    for one in gathered:
        yield from one.table().to_batches()


def _query_files(queries: DataFrame) -> list[list[str]]:
    """The stored queries as files of one block each, together as many as one scan answers."""
    spark = queries.sparkSession
    path = scratch_path(spark, "queries")
    queries.select("query_id", F.col("q").cast("array<double>").alias("q")).write.option(
        "maxRecordsPerFile", QUERY_BLOCK_ROWS).parquet(path)
    stored = spark.read.parquet(path)
    scans: list[list[str]] = []
    rows = QUERIES_PER_SCAN
    # One row per file of up to a block of queries.
    for file in stored.groupBy(F.col("_metadata.file_path").alias("file")).count().orderBy("file").collect():
        if rows + file["count"] > QUERIES_PER_SCAN:
            scans.append([])
            rows = 0
        scans[-1].append(file["file"])
        rows += file["count"]
    return scans


def _against_all(songs: DataFrame, queries: DataFrame, gather: Gather, schema: str) -> DataFrame:
    """What ``gather`` makes of every song against every query (``query_id, q``), per task."""
    dim = queries.select(F.size("q")).first()
    songs = with_vector(songs, dim[0] if dim else None).select("song_id", "embedding", "weight")

    def scan(files: list[str]) -> DataFrame:
        return songs.mapInArrow(lambda batches: _scan(batches, gather, files), schema)

    scans = [scan(files) for files in _query_files(queries)]
    return reduce(DataFrame.unionAll, scans) if scans else songs.sparkSession.createDataFrame([], schema)


def local_best(songs: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """Per task the ``depth`` best songs of each query by similarity times ``weight``."""
    return _against_all(songs, queries, lambda ids, q: Best(ids, q, depth), _BEST_SCHEMA)


def topk_batch(songs: DataFrame, queries: DataFrame, k: int = TOP_K_SEARCH_CHUNKS, fused: bool = True,
               overfetch: int = OVERFETCH_ALL) -> DataFrame:
    """Top-k songs for every query: ``query_id, rank`` and the columns of a search result.

    Fused results are cut on the fused score, two-stage ones on similarity alone.
    """
    if fused:
        songs = drop_unidentified(songs)
    depth = k if fused else k * overfetch
    weight = views_multiplier(numeric(F.col("views"))) if fused else F.lit(1.0)
    local = local_best(songs.withColumn("weight", weight), queries, depth)
    near = top_k_per_group(local, ["query_id"], best_first("ranked_score"), depth, "song_id")
    # At most depth rows per query, but only a stored table tells Spark so.
    named = settle(near, "near").select(F.col("query_id").alias("request_id"), "song_id", "raw_score").join(
        songs.select("song_id", "title", "artist", "views"), "song_id")
    # The similarity cut of a two-stage search has been made above.
    return rank_pairs(named, k, overfetch=None).withColumnRenamed("request_id", "query_id")


def similarity_profile(songs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query against every song, summed up per query: how many, mean, lowest, highest."""
    parts = _against_all(songs.withColumn("weight", F.lit(1.0)), queries, Profile, _PROFILE_SCHEMA)
    return parts.groupBy("query_id").agg(
        F.sum("songs").alias("songs"),
        (F.sum("total") / F.sum("songs")).alias("mean_score"),
        F.min("lowest").alias("lowest_score"),
        F.max("highest").alias("highest_score"),
    )


def _blocks(rows: DataFrame, mine: str, n_mine: Column, key: str, other: str, n_other: Column) -> DataFrame:
    """Rows with their own block number, once for each block of the other side."""
    return rows.withColumn(mine, F.pmod(F.xxhash64(key), n_mine)).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("bigint"), n_other - 1)))


def _block_count(rows: Column, size: int) -> Column:
    return F.greatest(F.ceil(rows / F.lit(size)), F.lit(1)).cast("bigint")


def _meet(songs: DataFrame, queries: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The best of the song block for the query block in each group."""
    def meet(song_block: pa.Table, query_block: pa.Table) -> pa.Table:
        best = Best(_numbers(query_block, "query_id"), _matrix(query_block, "q"), depth)
        if query_block.num_rows and song_block.num_rows:
            best.add(_numbers(song_block, "song_id"), _matrix(song_block, "embedding"), _numbers(song_block, "weight"))
        return best.table()

    return songs.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, _BEST_SCHEMA)


def best_within_names(songs: DataFrame, asks: DataFrame, names: DataFrame, depth: int) -> DataFrame:
    """Per request the best songs of each name it found, for names too common to pair up row by row.

    ``songs``: name, song_id, embedding, weight; ``asks``: name, request_id, q; ``names``:
    the names, with how many ``songs`` and ``asks`` each has. Either side of a name is cut
    into blocks; a block pair returns ``depth`` songs per request at most, whatever the
    name's size.
    """
    blocks = names.select("name", _block_count(F.col("songs"), SONG_BLOCK_ROWS).alias("n_songs"),
                          _block_count(F.col("asks"), QUERY_BLOCK_ROWS).alias("n_asks"))
    n_songs, n_asks = F.col("n_songs"), F.col("n_asks")
    left = _blocks(with_vector(songs).join(blocks, "name"), "sb", n_songs, "song_id", "qb", n_asks)
    right = _blocks(asks.withColumnRenamed("request_id", "query_id").join(blocks, "name"),
                    "qb", n_asks, "query_id", "sb", n_songs)
    keys = ["name", "sb", "qb"]
    best = _meet(left.select(*keys, "song_id", "embedding", "weight"), right.select(*keys, "query_id", "q"),
                 keys, depth)
    return best.select(F.col("query_id").alias("request_id"), "song_id", "raw_score")
