"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each with its own centroids; a pair of centroids is a cell. For a
query, cells are visited in the order of the summed distances of its halves (a heap walks the
pairs), until they hold a given share of all vectors; those are compared exactly.

Centroids and the share come from at most ``SAMPLE`` vectors, chosen by a hash of the id: the
share is the least at which the walk finds ``RECALL`` of the true neighbours within the sample.
A whole index is denser than its sample, so it needs no larger share. Every vector is indexed.

Vectors and the queries that visit them meet by first centroid; a centroid with many vectors is
split by salt, a large set of queries into blocks, so a task holds ``PER_TASK`` vectors and
``QUERIES_PER_TASK`` queries at most, about. Each gives its best per query only.

Defined results: vectors that are missing, zero, of another length than most, or with a missing
or non-finite component take no part, nor do rows without id; rows that share a query's id are
one query and no candidates of it; other repeated rows are candidates each; ties go to the
smaller id; fewer candidates than asked for are all returned; an empty table gives an empty
result. Other columns are not used.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.operators.groups import top_k_per_group
from songloom.session import settle

SAMPLE = 20_000
SAMPLE_QUERIES = 200
RECALL = 0.98
MOST_CENTROIDS = 128
ITERATIONS = 12
PER_TASK = 8_192
QUERIES_PER_TASK = 65_536


@dataclass
class Index:
    centroids: list[np.ndarray]  # of the first and of the second half
    share: float                 # of all vectors that a query looks at
    counts: np.ndarray | None = None  # vectors of each cell

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each half to its centroids."""
        cut = self.centroids[0].shape[1]
        return [(half ** 2).sum(axis=1)[:, None] + (c ** 2).sum(axis=1) - 2 * half @ c.T
                for half, c in zip((vectors[:, :cut], vectors[:, cut:]), self.centroids, strict=True)]


def _means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centroids = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(ITERATIONS):
        nearest = ((centroids ** 2).sum(axis=1) - 2 * points @ centroids.T).argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        used, first = np.unique(nearest[order], return_index=True)
        centroids[used] = np.add.reduceat(points[order], first) / np.diff(np.append(first, len(points)))[:, None]
    return centroids


def fit(sample: np.ndarray, k: int, recall: float = RECALL, seed: int = 1) -> Index:
    """Centroids, and the share of vectors to visit for ``k`` neighbours at the given recall."""
    rng, cut = np.random.default_rng(seed), max(1, sample.shape[1] // 2)
    size = int(np.clip(2 ** round(np.log2(max(1.0, len(sample) ** 0.5))), 1, MOST_CENTROIDS))
    index = Index([_means(half, size, rng) for half in (sample[:, :cut], sample[:, cut:])], 1.0)
    cells = [d.argmin(axis=1) for d in index.distances(sample)]
    queries = np.sort(rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False))
    first, second = index.distances(sample[queries])
    needed = []
    for row, query in enumerate(queries):
        far = ((sample - sample[query]) ** 2).sum(axis=1)
        far[query] = np.inf
        best = np.argsort(far)[:min(k, len(sample) - 1)]
        cost = first[row, cells[0]] + second[row, cells[1]]
        # Vectors in the cells up to that of each true neighbour.
        needed.append(np.searchsorted(np.sort(cost), cost[best], "right"))
    found = np.concatenate(needed) if needed else np.zeros(0)
    index.share = min(1.0, float(np.quantile(found, recall)) / len(sample)) if len(found) else 1.0
    return index


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: float) -> np.ndarray:
    """The cells to look at, in the order of summed distance until they hold ``need`` vectors."""
    by_first, by_second = np.argsort(first), np.argsort(second)
    a, b, out, held = first[by_first], second[by_second], np.zeros(counts.shape, bool), 0
    heap = [(a[0] + b[0], 0, 0)]
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        cell = by_first[i], by_second[j]
        out[cell] = True
        held += counts[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out & (counts > 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _assign(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cells = [d.argmin(axis=1).astype(np.int32) for d in sent.value.distances(_matrix(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cells)], ["id", "vector", "first", "second"])


def _visits(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """For each query and first centroid: which second centroids to look at, as bits."""
    index: Index = sent.value
    need = index.share * index.counts.sum()
    for batch in batches:
        if not batch.num_rows:
            continue
        first, second = index.distances(_matrix(batch.column(1)))
        for i in range(batch.num_rows):
            cells = visited(first[i], second[i], index.counts, need)
            used = np.flatnonzero(cells.any(axis=1))
            bits = [row.tobytes() for row in np.packbits(cells[used], axis=1)]
            same = pa.array(np.full(len(used), i))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(same), pa.array(used.astype(np.int32)), pa.array(bits, pa.binary()),
                batch.column(1).take(same)], ["query_id", "first", "cells", "query"])


def _compare(k: int):
    def work(vectors: pa.Table, visits: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], []]
        if vectors.num_rows and visits.num_rows:
            points, ids = _matrix(vectors["vector"]), vectors["id"].to_numpy()
            second, queries = vectors["second"].to_numpy(), _matrix(visits["query"])
            for own, bits, query in zip(visits["query_id"].to_pylist(), visits["cells"].to_pylist(), queries, strict=True):
                open_cells = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                at = np.flatnonzero(open_cells[second] & (ids != own))
                score = np.sqrt(((points[at] - query) ** 2).sum(axis=1))
                if len(at) > k:
                    near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                    at, score = at[near], score[near]
                best = np.lexsort((ids[at], score))[:k]
                rows[0].append(np.full(len(best), own))
                rows[1].append(ids[at][best])
                rows[2].append(score[best])
        whole = [np.concatenate(r) if r else np.zeros(0) for r in rows]
        return pa.table({"query_id": pa.array(whole[0].astype(np.int64)), "vec_id": pa.array(whole[1].astype(np.int64)),
                         "score": pa.array(whole[2].astype(float))})
    return work


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, but for their length."""
    vector = F.col(vector_col)
    bad: Column = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.filter(
        F.col(id_col).isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True))
        & F.exists(vector, lambda x: x != 0)).select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's ``k`` nearest found.

    ``is_query`` is an expression of the column ``id``.
    """
    spark = embeddings.sparkSession
    send = spark.sparkContext.broadcast
    clean = usable(embeddings, id_col, vector_col)
    lengths = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    clean = clean.filter(F.size("vector") == lengths["n"])
    keys = clean.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = clean.join(F.broadcast(keys), "id", "left_semi").dropDuplicates(["id"]).orderBy("id").toArrow()
    index = fit(_matrix(sample["vector"]), k, recall)

    fitted = send(index)
    kind = clean.schema["vector"].dataType.simpleString()
    cells = settle(clean.mapInArrow(
        lambda batches: _assign(batches, fitted), f"id bigint, vector {kind}, first int, second int"), "cells")
    size = len(index.centroids[0])
    index.counts = np.zeros((size, size), np.int64)
    for row in cells.groupBy("first", "second").count().collect():
        index.counts[row["first"], row["second"]] = row["count"]
    counted = send(index)
    queries = cells.filter(is_query).select("id", "vector").dropDuplicates(["id"])
    visits = queries.mapInArrow(
        lambda batches: _visits(batches, counted), f"query_id bigint, first int, cells binary, query {kind}")

    salts = F.array(*[F.lit(int(n) // PER_TASK + 1) for n in index.counts.sum(axis=1)])
    parts = F.element_at(salts, F.col("first") + 1)
    blocks = cells.filter(is_query).count() // QUERIES_PER_TASK + 1
    left = cells.withColumn("salt", F.pmod(F.xxhash64("id"), parts)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)))
    keys = ["first", "salt", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _compare(k), "query_id bigint, vec_id bigint, score double")
    best = top_k_per_group(found, ["query_id"], [F.col("score"), F.col("vec_id")], k, "vec_id")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
