"""Exact batch search that skips what cannot be among the best.

Songs are stored in groups of similar vectors, each with its centre, its radius and the range of its
songs' weights. No song of a group is more similar to a query q than q·centre + |q|·radius; if that,
times the weight, is below the k-th best that a task has found so far, for all queries of a block,
the group's vectors are not looked at. Groups are taken in order of their bounds, so the k-th best
rises fast. What is returned equals :func:`songloom.operators.block.topk_batch`, row by row: groups
are made from a bounded sample, which decides how much is skipped and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.constants import TOP_K_SEARCH_CHUNKS
from songloom.functions.keys import numeric
from songloom.functions.scores import views_multiplier
from songloom.operators.block import Best, _matrix, _numbers, _query_files, _read
from songloom.operators.filters import drop_unidentified
from songloom.operators.groups import top_k_per_group
from songloom.operators.search import best_first, rank_pairs, with_vector
from songloom.session import settle

GROUP_ROWS = 512
SAMPLE = 4_096
MOST_CELLS = 256
ITERATIONS = 8

GROUP = ("centre binary, radius double, low_weight double, high_weight double, n int, ids binary, vectors binary, weights binary")
_FOUND = "query_id bigint, song_id bigint, raw_score double, ranked_score double, looked_at int, groups int"


def centres(sample: np.ndarray, seed: int = 1) -> np.ndarray:
    """Middles of groups of a sample's vectors, about as many as the root of its size."""
    if not len(sample):
        return sample
    n = int(np.clip(np.sqrt(len(sample)), 1, MOST_CELLS))
    found = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)].copy()
    for _ in range(ITERATIONS):
        nearest = _nearest(sample, found)
        for k in np.unique(nearest):
            found[k] = sample[nearest == k].mean(axis=0)
    return found


def _nearest(vectors: np.ndarray, middles: np.ndarray) -> np.ndarray:
    return ((middles ** 2).sum(axis=1) - 2 * vectors @ middles.T).argmin(axis=1)


def _cells(batches: Iterator[pa.RecordBatch], middles: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell = _nearest(_matrix(pa.Table.from_batches([batch]), "embedding"), middles) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])


def _grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of their cell, as groups of one cell each."""
    names = [part.split()[0] for part in GROUP.split(", ")]
    for batch in batches:
        cell = batch.column(3).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        out = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            for at in range(a, z, rows):
                part = pa.Table.from_batches([batch.slice(at, min(rows, z - at))])
                vectors, weights = _matrix(part, "embedding"), _numbers(part, "weight")
                centre = vectors.mean(axis=0)
                radius = np.sqrt(((vectors - centre) ** 2).sum(axis=1)).max()
                out.append((centre.tobytes(), radius, weights.min(), weights.max(), part.num_rows,
                            _numbers(part, "song_id").astype(np.int64).tobytes(), vectors.tobytes(), weights.tobytes()))
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=pa.schema(
                {"centre": pa.binary(), "radius": pa.float64(), "low_weight": pa.float64(), "high_weight": pa.float64(), "n": pa.int32(),
                 "ids": pa.binary(), "vectors": pa.binary(), "weights": pa.binary()}))


def store_groups(songs: DataFrame, rows_per_group: int = GROUP_ROWS) -> DataFrame:
    """Identified songs with a vector of the usual length, in stored groups, for fused search (similarity times popularity)."""
    dim = songs.filter(F.col("embedding").isNotNull()).agg(F.mode(F.size("embedding"), deterministic=True)).first()[0]
    usable = with_vector(drop_unidentified(songs), dim).select(
        "song_id", F.col("embedding").cast("array<double>").alias("embedding"), views_multiplier(numeric(F.col("views"))).alias("weight"))
    # At most SAMPLE vectors.
    sample = usable.orderBy(F.xxhash64("song_id"), "song_id").limit(SAMPLE).select("embedding").toArrow()
    middles = centres(_matrix(sample, "embedding"))
    if not len(middles):
        return settle(usable.limit(0).select(*[F.lit(None).cast(p.split()[1]).alias(p.split()[0]) for p in GROUP.split(", ")]), "groups")
    celled = usable.mapInArrow(lambda b: _cells(b, middles), "song_id bigint, embedding array<double>, weight double, cell int")
    ordered = settle(celled, "celled").repartitionByRange("cell", F.xxhash64("song_id")).sortWithinPartitions("cell")
    return settle(ordered.mapInArrow(lambda b: _grouped(b, rows_per_group), GROUP), "groups")


def _bounds(queries: np.ndarray, lengths: np.ndarray, centre: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No score of a group (column) for a query (row) is above this, rounding included."""
    most = queries @ centre.T + lengths[:, None] * radius[None, :]
    spare = 1e-9 * (1 + lengths[:, None] * (np.sqrt((centre ** 2).sum(axis=1)) + radius)[None, :]) * np.abs(high)[None, :]
    return np.maximum(most * high, most * low) + spare


def _search(batches: Iterator[pa.RecordBatch], files: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """The best of a task's groups for each query, and how many groups it looked at, of how many, on each row."""
    blocks = [_read(file) for file in files]
    best = [Best(_numbers(b, "query_id"), _matrix(b, "q"), k) for b in blocks]
    looked_at = groups = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column(4).to_numpy()
        centre = np.array([np.frombuffer(v.as_buffer()) for v in batch.column(0)])
        radius, low, high = (batch.column(i).to_numpy() for i in (1, 2, 3))
        groups += len(n)
        seen = np.zeros(len(n), bool)
        for one in best:
            if one.queries.shape[1:] != centre.shape[1:]:
                continue  # queries of another length have no hits
            lengths = np.sqrt((one.queries ** 2).sum(axis=1))
            bound = _bounds(one.queries, lengths, centre, radius, low, high)
            for g in np.argsort(-bound.max(axis=0), kind="stable"):
                kth = np.array([kept[2][-1] if len(kept[0]) >= k else -np.inf for kept in one.kept])
                if (bound[:, g] < kth).all():
                    continue
                seen[g] = True
                ids, flat, weights = (np.frombuffer(batch.column(c)[int(g)].as_buffer(), kind) for c, kind in (
                    (5, np.int64), (6, np.float64), (7, np.float64)))
                one.add(ids, flat.reshape(len(ids), -1), weights)
        looked_at += int(seen.sum())
    for one in best:
        table = one.table()
        counts = [pa.array(np.full(table.num_rows, v, np.int32)) for v in (looked_at, groups)]
        yield from table.append_column("looked_at", counts[0]).append_column("groups", counts[1]).to_batches()


def found_in_groups(groups: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per task the best ``k`` songs of each query (``query_id, q``), with the groups looked at and those there were."""
    scans = [groups.mapInArrow(lambda b, files=files: _search(b, files, k), _FOUND) for files in _query_files(queries)]
    return reduce(DataFrame.unionAll, scans) if scans else groups.sparkSession.createDataFrame([], _FOUND)


def topk_pruned(groups: DataFrame, songs: DataFrame, queries: DataFrame, k: int = TOP_K_SEARCH_CHUNKS) -> DataFrame:
    """Fused top-k songs for every query, from the stored groups of these songs."""
    local = found_in_groups(groups, queries, k)
    near = top_k_per_group(local, ["query_id"], best_first("ranked_score"), k, "song_id")
    named = settle(near, "near").select(F.col("query_id").alias("request_id"), "song_id", "raw_score").join(
        songs.select("song_id", "title", "artist", "views"), "song_id")
    return rank_pairs(named, k, overfetch=None).withColumnRenamed("request_id", "query_id")
