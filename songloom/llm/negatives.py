"""Hard negatives of anchors: rows of another label whose score lies in a window below a positive's.

Vectors are scaled to whole numbers, so a score (inner product) is a whole number. Every row is
stored with its length and its angles to a few reference directions. On the sphere the triangle
inequality says that the angle between an anchor and a row is at least the difference of their
angles to any reference and at most their sum: an interval for the cosine, and times both lengths
one for the score, widened by more than rounding can do. Only rows whose interval meets a window
that is still open (for positives: that can be among the first) are scored, in whole numbers.

Rows are stored in order of label and nearest reference, in ranges of about equal count, so no
label or direction gathers in one task. A task reads anchors from files of ``ANCHORS_PER_FILE`` and
takes its rows in blocks; a block whose intervals as a whole miss an anchor's windows is skipped
at once. It keeps the best of each window only; the best of all tasks meet in small groups. Rows
never move again, pairs never become rows unless they are among the best of their task.

The references come from at most ``SAMPLE`` rows. They decide how much is skipped, never what is
found: on vectors that lie in no clusters all angles are alike and nearly every row is scored.

Memory: a block of rows, a file of anchors, and the best of ``ANCHORS_PER_SCAN`` anchors.

Defined results: rows without id, label or vector, or with a missing or non-finite component, take
no part; a shorter vector is as one filled up with zeros, a vector without components has a score
of 0 with any other; rows that share the anchor's id are not its positives; other repeated rows are
each; equal scores go to the smaller id; an anchor without positives or a window without rows gives
no rows, nor does an empty table. Scores beyond 64 bits are an error. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.operators.groups import top_k_per_group
from songloom.session import scratch_path, settle

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# A negative's score in percent of the positive's.
LOW, HIGH = 30, 90
REFERENCES = 8
SAMPLE = 4096
ITERATIONS = 8
BLOCK_ROWS = 2048
ANCHORS_PER_FILE = 512
ANCHORS_PER_SCAN = 4096
# Wider than the error of an angle: that of a cosine is below 1e-12, so that of an angle below 2e-6.
SLACK = 1e-5


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors of 64-bit whole numbers, filled up with zeros to one length."""
    parts = [np.frombuffer(v.as_buffer(), np.int64) for v in column]
    out = np.zeros((len(parts), max([width, *map(len, parts)])), np.int64)
    for row, part in zip(out, parts, strict=True):
        row[:len(part)] = part
    return out


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def directions(sample: np.ndarray, n: int = REFERENCES, seed: int = 1) -> np.ndarray:
    """Unit vectors towards the middles of groups of the sample's vectors."""
    lengths = np.sqrt((sample.astype(float) ** 2).sum(axis=1))
    unit = sample[lengths > 0] / lengths[lengths > 0][:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    found = unit[np.random.default_rng(seed).choice(len(unit), min(n, len(unit)), replace=False)]
    for _ in range(ITERATIONS):
        nearest = (unit @ found.T).argmax(axis=1)
        for k in np.unique(nearest):
            middle = unit[nearest == k].sum(axis=0)
            size = np.sqrt((middle ** 2).sum())
            if size > 0:
                found[k] = middle / size
    return found


def angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each vector and its angle to each reference (a right one for the zero vector)."""
    width = max(vectors.shape[1], references.shape[1])
    wide = _widened(vectors, width).astype(float)
    lengths = np.sqrt((wide ** 2).sum(axis=1))
    cosines = wide @ _widened(references, width).T / np.where(lengths > 0, lengths, 1.0)[:, None]
    return lengths, np.arccos(np.clip(cosines, -1.0, 1.0))


def score_bounds(lengths_a: np.ndarray, angles_a: np.ndarray, lengths_b: np.ndarray, low_b: np.ndarray, high_b: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each of the first with each of the others, whose angles lie from low to high.

    Of a block ``lengths_b`` is the largest length; a shorter one is nearer to 0, which is allowed for.
    """
    least = np.zeros((len(lengths_a), len(lengths_b)))
    most = np.full(least.shape, np.pi)
    for k in range(angles_a.shape[1]):
        a, low, high = angles_a[:, k, None], low_b[None, :, k], high_b[None, :, k]
        np.maximum(least, np.maximum(a - high, low - a), out=least)
        np.minimum(most, np.minimum(a + high, 2 * np.pi - a - low), out=most)
    product = lengths_a[:, None] * lengths_b[None, :]
    spare = product * 1e-9 + 1
    low = product * np.cos(np.minimum(most + SLACK, np.pi)) - spare
    high = product * np.cos(np.maximum(least - SLACK, 0.0)) + spare
    return low, high


def scores(vectors: np.ndarray, anchor: np.ndarray, bound: float) -> np.ndarray:
    """Whole-number inner products; ``bound`` is the product of the largest lengths."""
    if bound < 2.0 ** 52:  # every partial sum is a whole number that a double holds
        return (vectors.astype(float) @ anchor.astype(float)).astype(np.int64)
    if bound < 2.0 ** 62:
        return vectors @ anchor
    exact = vectors.astype(object) @ anchor.astype(object)
    return np.array([int(x) for x in exact], np.int64)  # OverflowError beyond 64 bits


def _described(batches: Iterator[pa.RecordBatch], references: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) with whole-number vectors, lengths, angles and nearest reference."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(2)
        sizes = np.diff(column.offsets.to_numpy())
        flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        if len(flat) and np.abs(flat).max() >= 2.0 ** 63:
            raise OverflowError("a component is beyond 64 bits")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        whole = flat.astype(np.int64)
        binary = pa.array([whole[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        lengths, found = angles(_matrix(binary), references)
        nearest = found.argmin(axis=1) if found.shape[1] else np.zeros(len(lengths), np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), binary, pa.array(lengths),
            pa.array([row.tobytes() for row in found], pa.binary()), pa.array(nearest.astype(np.int32))],
            ["id", "label", "vector", "length", "angles", "nearest"])


class _Rows:
    """Rows of a table of described vectors."""

    def __init__(self, table: pa.Table):
        self.ids, self.labels = table["id"].to_numpy(), table["label"].to_numpy()
        self.vectors, self.lengths = _matrix(table["vector"].combine_chunks()), table["length"].to_numpy()
        self.angles = np.array([np.frombuffer(v.as_buffer(), float) for v in table["angles"].combine_chunks()]).reshape(
            table.num_rows, -1)


class _Search:
    """The best rows of each place of each anchor of a file; a place is a window for scores.

    ``scored`` and ``met`` count the pairs that were scored and those that could have been.
    """

    k: int
    same: bool

    def __init__(self, table: pa.Table):
        self.anchors = _Rows(table)
        self.numbers = table["anchor"].to_numpy()
        self.open_windows(table)
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.kept = {place: nothing for place in self.places}
        self.scored = self.met = 0

    # (anchor's row, place) -> (least, largest) score wanted
    places: dict[tuple[int, int], tuple[float, float]]

    def open_windows(self, table: pa.Table) -> None:
        raise NotImplementedError

    def _limits(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor and window, the least and largest score that can still get in."""
        width = 1 + max((w for _, w in self.places), default=0)
        low, high = np.full((len(self.numbers), width), np.inf), np.full((len(self.numbers), width), -np.inf)
        for (i, w), (a, z) in self.places.items():
            kept = self.kept[i, w][1]
            low[i, w], high[i, w] = (max(a, int(kept[-1])) if len(kept) >= self.k else a), z
        return low, high

    def add(self, rows: _Rows) -> None:
        if not len(rows.ids) or not self.places:
            return
        own = self.anchors
        width = max(own.vectors.shape[1], rows.vectors.shape[1])
        own.vectors, rows.vectors = _widened(own.vectors, width), _widened(rows.vectors, width)
        wanted = own.labels[:, None] == rows.labels[None, :]
        wanted = wanted & (own.ids[:, None] != rows.ids[None, :]) if self.same else ~wanted
        least, largest = self._limits()
        # The block as a whole first: largest length, angles from the least to the largest.
        _, reach = score_bounds(own.lengths, own.angles, np.array([rows.lengths.max()]),
                                rows.angles.min(axis=0)[None, :], rows.angles.max(axis=0)[None, :])
        reach = np.maximum(reach, 1.0)  # a short vector's score is near 0 whatever its angle
        some = np.flatnonzero((reach >= least).any(axis=1) & wanted.any(axis=1))
        self.met += int(wanted.sum())
        if not len(some):
            return
        low, high = score_bounds(own.lengths[some], own.angles[some], rows.lengths, rows.angles, rows.angles)
        meets = np.zeros(low.shape, bool)
        for w in range(least.shape[1]):
            meets |= (high >= least[some, w, None]) & (low <= largest[some, w, None])
        meets &= wanted[some]
        bound = float(own.lengths.max() * rows.lengths.max())
        for i, hits in zip(some.tolist(), meets, strict=True):
            at = np.flatnonzero(hits)
            if not len(at):
                continue
            self.scored += len(at)
            found = scores(rows.vectors[at], own.vectors[i], bound)
            for w in range(least.shape[1]):
                if (i, w) not in self.places:
                    continue
                (first, last), (old_ids, old) = self.places[i, w], self.kept[i, w]
                inside = (found >= (max(first, int(old[-1])) if len(old) >= self.k else first)) & (found <= last)
                if inside.any():
                    ids, points = np.concatenate([old_ids, rows.ids[at[inside]]]), np.concatenate([old, found[inside]])
                    order = np.lexsort((ids, -points))[:self.k]
                    self.kept[i, w] = ids[order], points[order]

    def table(self) -> pa.Table:
        sizes = [len(ids) for ids, _ in self.kept.values()]
        number = np.array([self.numbers[i] for i, _ in self.kept], np.int64)
        place = np.array([w for _, w in self.kept], np.int32)
        join = lambda k: np.concatenate([np.zeros(0, np.int64), *[v[k] for v in self.kept.values()]])
        return pa.table({"anchor": np.repeat(number, sizes), "place": np.repeat(place, sizes), "id": join(0), "score": join(1)})


class _Positives(_Search):
    same = True

    def __init__(self, table: pa.Table, k: int):
        self.k = k
        super().__init__(table)

    def open_windows(self, table: pa.Table) -> None:
        self.places = {(i, 0): (-np.inf, np.inf) for i in range(table.num_rows)}


class _Negatives(_Search):
    same = False

    def __init__(self, table: pa.Table, k: int, low: int, high: int):
        self.k, self.share = k, (low, high)
        super().__init__(table)

    def open_windows(self, table: pa.Table) -> None:
        windows = {}
        for i, positives in enumerate(table["positives"].to_pylist()):
            for p in positives:
                # low * positive <= 100 * negative <= high * positive
                window = -(-self.share[0] * p["score"] // 100), self.share[1] * p["score"] // 100
                if window[0] <= window[1]:
                    windows[i, p["place"]] = window
        self.places = windows


def _read(uri: str) -> pa.Table:
    system, path = fs.FileSystem.from_uri(uri)
    return pq.read_table(path, filesystem=system, partitioning=None)


def _scan(batches: Iterator[pa.RecordBatch], files: list[str], search: Callable[[pa.Table], _Search]) -> Iterator[pa.RecordBatch]:
    searches = [search(_read(file)) for file in files]
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            rows = _Rows(pa.Table.from_batches([batch.slice(a, BLOCK_ROWS)]))
            for one in searches:
                one.add(rows)
    for one in searches:
        yield from one.table().to_batches()


def _best(rows: DataFrame, anchors: DataFrame, search: Callable[[pa.Table], _Search]) -> DataFrame:
    """What each task finds for all anchors, as many anchors per reading of the rows as a task may hold."""
    spark = rows.sparkSession
    path = scratch_path(spark, "anchors")
    anchors.write.option("maxRecordsPerFile", ANCHORS_PER_FILE).parquet(path)
    scans: list[list[str]] = []
    held = ANCHORS_PER_SCAN
    # One row per file of up to ANCHORS_PER_FILE anchors.
    for file in spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).count().orderBy("file").toLocalIterator():
        if held + file["count"] > ANCHORS_PER_SCAN:
            scans.append([])
            held = 0
        scans[-1].append(file["file"])
        held += file["count"]
    schema = "anchor bigint, place int, id bigint, score bigint"
    out = None
    for files in scans:
        found = rows.mapInArrow(lambda batches, files=files: _scan(batches, files, search), schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else settle(out, "best")


def hard_negatives(table: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``anchor``, on column ``id``, holds.

    An anchor's positives are its ``positives`` best rows of the same label; for each, the best
    ``negatives`` rows of other labels with a score from ``low`` to ``high`` percent of the positive's.
    """
    best = [F.desc("score"), F.asc("id")]
    usable = table.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v")).filter(
            "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(
                F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    # At most SAMPLE vectors.
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    width = max(map(len, chosen), default=0)
    references = directions(np.array([np.floor(SCALE * np.pad(np.array(v, float), (0, width - len(v)))) for v in chosen]).reshape(
        len(chosen), width))
    rows = usable.mapInArrow(
        lambda batches: _described(batches, references),
        "id bigint, label bigint, vector binary, length double, angles binary, nearest int")
    rows = settle(rows.repartitionByRange("label", "nearest", F.xxhash64("id")).sortWithinPartitions("label", "nearest"), "vectors")

    anchors = settle(rows.filter(anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    found = _best(rows, anchors, lambda t: _Positives(t, positives))
    near = settle(top_k_per_group(found, ["anchor"], best, positives, "id", "nth"), "positives")
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct((F.col("nth") - 1).alias("place"), "score"))).alias("positives"))
    met = _best(rows, anchors.join(windows, "anchor"), lambda t: _Negatives(t, negatives, low, high))
    hard = top_k_per_group(met, ["anchor", "place"], best, negatives, "id").select(
        "anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("anchor", (F.col("nth") - 1).alias("place"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score")).join(
        anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return hard.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
