"""Benchmark decontamination with a positional inverted index.

The documents' postings (for the terms that tests use) are stored in the shared folder, a run
of documents per row: which terms, how often, and at which word positions. A window of test
words is found by taking the posting list of its rarest term, shifting it to where the window
would start, and intersecting it with the shifted lists of the other terms, rarest first. The
documents never move; nothing is shuffled but a count per term.

Tests are cut into stretches of ``STRETCH`` words that overlap by a window less one word, so that
a test of any length is many of them. Their terms and their windows are stored as well, windows in
blocks of ``BLOCK_WINDOWS`` (about 18 MB); tasks read both from the shared folder, a worker keeping
them only where they are small. Stretches with more than ``PART_TERMS`` words are answered in parts,
each by an index of its own terms, and what the parts find is joined; so any number of tests is
answered, and none of their text passes through the driver.

Defined results: a missing or empty text has no words and no hits; a test without words is
never found; a test without id marks words but is not listed, tests that share an id are listed
once; repeated rows are answered each for itself; an empty table of tests leaves every document clean. Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from songloom.llm.words import ALNUM, blocks, find_words, give_back
from songloom.session import qualified, scratch_path, settle

# Fixed value: words of a window.
WINDOW = 10
# A proximity match has each word of the window at most this far from its place.
SLACK = 3

BLOCK_WINDOWS = 200_000
CANDIDATES_AT_ONCE = 1 << 20
# Unused positions between two documents of a run, so that no match reaches over.
GAP = 4 * WINDOW
# Words of a stretch, and of all stretches whose terms one index has (64 MB of hashes).
STRETCH = 20_000
PART_TERMS = 8 << 20
# Bytes of stored terms or windows that a worker keeps from one task to the next.
KEPT_BYTES = 64 << 20

STRETCHES = "item {item}, words binary"
WINDOWS = "items array<{item}>, terms binary, offsets binary, lengths binary, item binary"

INDEX = ("run string, ids array<{id}>, bounds array<bigint>, terms array<int>, counts array<int>, "
         "positions array<int>")
FOUND = ("run string, place int, {id_col} {id}, n_words bigint, items array<{item}>, near_items array<{item}>, "
         "spans array<struct<start:bigint,end:bigint>>")


def _text_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hash of each word, words before each row) of runs of rows."""
    for first, end, data, bounds in blocks(texts):
        words = find_words(data, bounds, ALNUM, lower=True)
        yield first, end, words.hashes(), words.bounds


def _list(values: pa.Array | np.ndarray) -> pa.Array:
    """One row that holds all the values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _files(uri: str) -> list[str]:
    system, path = fs.FileSystem.from_uri(uri)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted(i.path for i in found if i.is_file and i.base_name.endswith(".parquet") and not i.base_name.startswith(("_", ".")))


_kept: dict[str, object] = {}


def _once(uri: str, read, size) -> object:
    """What ``read`` makes of a stored table; kept for later tasks if it is small, a newer one taking its place."""
    if uri not in _kept:
        value = read()
        if size(value) > KEPT_BYTES:
            return value
        if len(_kept) >= 4:
            _kept.pop(next(iter(_kept)))
        _kept[uri] = value
    return _kept[uri]


def _table(uri: str, columns: list[str]) -> pa.Table:
    system, _ = fs.FileSystem.from_uri(uri)
    return pa.concat_tables(pq.read_table(f, columns=columns, filesystem=system, partitioning=None) for f in _files(uri))


def _terms(uri: str) -> np.ndarray:
    """The stored terms, ascending; a term's number is its place."""
    return _once(uri, lambda: np.sort(_table(uri, ["term"])["term"].to_numpy().view(np.uint64)), lambda v: v.nbytes)


def _seen(uri: str, n: int) -> np.ndarray:
    """How often each term stands in the documents, and a 0 behind the last."""
    table, seen = _table(uri, ["term", "n"]), np.zeros(n + 1, np.int64)
    seen[table["term"].to_numpy()] = table["n"].to_numpy()
    return seen


def _stretches(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    """Tests as stretches of word hashes."""
    for batch in batches:
        for first, _, hashes, bounds in _text_words(batch.column(1)):
            rows, words = [], []
            for row, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), first):
                for at in range(a, max(a + 1, z - WINDOW + 1), stretch):
                    if z > a:
                        rows.append(row)
                        words.append(hashes[at:min(z, at + stretch + WINDOW - 1)].tobytes())
            items = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([items, pa.array(words, pa.binary())], ["item", "words"])


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(0)]
        own = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["term"])


def _index(batches: Iterator[pa.RecordBatch], terms: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    known, part, number = _terms(terms), TaskContext.get().partitionId(), 0
    for batch in batches:
        for first, end, hashes, bounds in _text_words(batch.column(1)):
            place = np.searchsorted(known, hashes)
            place[place == len(known)] = 0
            hit = np.flatnonzero(known[place] == hashes) if len(known) else np.zeros(0, np.int64)
            row = np.searchsorted(bounds, hit, "right") - 1
            key = np.sort((place[hit].astype(np.int64) << 32) | (hit + row * GAP))
            used, counts = np.unique(key >> 32, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{part}-{number}"]), _list(batch.column(0).slice(first, end - first)),
                _list(bounds.astype(np.int64)), _list(used.astype(np.int32)), _list(counts.astype(np.int32)),
                _list((key & 0xFFFFFFFF).astype(np.int32)),
            ], ["run", "ids", "bounds", "terms", "counts", "positions"])
            number += 1
    give_back()


@dataclass
class Windows:
    """Windows of test words, the words of each ordered from the rarest."""

    terms: np.ndarray    # number of the term, -1 where a window has fewer words
    offsets: np.ndarray  # its place in the window
    lengths: np.ndarray
    items: np.ndarray    # row of the test
    ids: pa.Array        # id of each test

    def __len__(self) -> int:
        return len(self.lengths)


def _windows(hashes: np.ndarray, bounds: np.ndarray, ids: pa.Array, known: np.ndarray, seen: np.ndarray) -> Windows:
    """All windows of some tests; those with a term that no document has are left out."""
    counts = np.diff(bounds)
    lengths = np.where(counts >= WINDOW, WINDOW, counts)
    many = np.where(counts > 0, counts - lengths + 1, 0)
    items = np.repeat(np.arange(len(counts)), many)
    first = bounds[items] + np.arange(len(items)) - np.repeat(np.cumsum(many) - many, many)
    place = first[:, None] + np.arange(WINDOW)
    valid = np.arange(WINDOW) < lengths[items][:, None]
    number = np.searchsorted(known, hashes)
    terms = np.where(valid, number[np.where(valid, place, 0)], -1) if len(items) else np.zeros((0, WINDOW), np.int64)
    rarity = np.where(valid, seen[terms], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    keep = np.where(valid, rarity, 1).min(axis=1, initial=1) > 0
    return Windows(np.take_along_axis(terms, order, 1)[keep].astype(np.int32), order[keep].astype(np.int8),
                   lengths[items][keep].astype(np.int8), items[keep].astype(np.int32), ids)


def _intersect(windows: Windows, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, exact) of all proximity matches in a run, some at a time.

    Terms are ascending, and so are the positions of each.
    """
    if not len(terms) or not len(windows):
        return
    keys = (np.repeat(terms.astype(np.int64), counts) << 32) | positions
    lists = np.cumsum(counts) - counts
    place = np.minimum(np.searchsorted(terms, windows.terms[:, 0]), len(terms) - 1)
    sizes = np.where(terms[place] == windows.terms[:, 0], counts[place], 0)
    reached = np.cumsum(sizes)
    first = 0
    while first < len(windows):
        end = max(first + 1, int(np.searchsorted(
            reached, (reached[first - 1] if first else 0) + CANDIDATES_AT_ONCE, "right")))
        n = sizes[first:end]
        window = np.repeat(np.arange(first, end), n)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = positions[lists[place[window]] + inside].astype(np.int64) - windows.offsets[window, 0]
        exact = np.ones(len(window), bool)
        for k in range(1, WINDOW):
            if not len(window):
                break
            term = windows.terms[window, k].astype(np.int64)
            key = (term << 32) + start + windows.offsets[window, k]
            at = np.searchsorted(keys, key - SLACK)
            near = (term < 0) | (keys[np.minimum(at, len(keys) - 1)] - key <= SLACK) & (at < len(keys))
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            exact &= (term < 0) | (keys[at] == key)
            window, start, exact = window[near], start[near], exact[near]
        yield window, start, exact
        first = end


def _lists(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """Values as one list per row; ``rows`` is ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _window_blocks(batches: Iterator[pa.RecordBatch], terms: str, seen: str, most: int) -> Iterator[pa.RecordBatch]:
    """The windows of stretches (item, words), as rows of a block each."""
    known = _terms(terms)
    counted = None
    for batch in batches:
        counted = _seen(seen, len(known)) if counted is None else counted
        words = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(1)]
        reached = np.cumsum([len(w) for w in words])
        first = 0
        while first < len(words):
            end = max(first + 1, int(np.searchsorted(reached, (reached[first - 1] if first else 0) + most, "right")))
            own = words[first:end]
            ids = batch.column(0).slice(first, end - first)
            w = _windows(np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]), ids, known, counted)
            if len(w):
                yield pa.RecordBatch.from_arrays([
                    _list(ids), *[pa.array([v.tobytes()]) for v in (w.terms, w.offsets, w.lengths, w.items)]],
                    ["items", "terms", "offsets", "lengths", "item"])
            first = end


def _read_windows(uri: str, kept: int) -> Iterator[Windows]:
    """The stored blocks one after the other; kept by the worker if they are small together."""
    def blocks_of() -> Iterator[Windows]:
        system, _ = fs.FileSystem.from_uri(uri)
        for name in _files(uri):
            with system.open_input_file(name) as source:
                for batch in pq.ParquetFile(source).iter_batches(1):
                    for i in range(batch.num_rows):
                        flat = lambda k, kind, i=i: np.frombuffer(batch.column(k)[i].as_buffer(), kind)  # noqa: B023,E731
                        yield Windows(flat(1, np.int32).reshape(-1, WINDOW), flat(2, np.int8).reshape(-1, WINDOW),
                                      flat(3, np.int8), flat(4, np.int32), batch.column(0)[i].values)

    if uri in _kept:
        yield from _kept[uri]
        return
    system, _ = fs.FileSystem.from_uri(uri)
    # Windows are stored uncompressed, so their files say what they take.
    if sum(system.get_file_info(f).size for f in _files(uri)) <= kept:
        yield from _once(uri, lambda: list(blocks_of()), lambda v: 0)
    else:
        yield from blocks_of()


class _Run:
    """What has been found in one run of documents."""

    def __init__(self, bounds: np.ndarray):
        self.n = len(bounds) - 1
        self.bounds, self.spread = bounds, bounds + np.arange(len(bounds)) * GAP
        self.covered = np.zeros(self.spread[-1] + 1, np.int32)
        # Documents and tests, of exact and of all matches.
        self.rows: list[list[np.ndarray]] = [[], []]
        self.tests: list[list[pa.Array]] = [[], []]

    def add(self, windows: Windows, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> None:
        for window, start, exact in _intersect(windows, terms, counts, positions):
            row = np.searchsorted(self.spread, start + windows.offsets[window, 0], "right") - 1
            for k, which in enumerate((exact, slice(None))):
                pair = np.unique(row[which] * len(windows.ids) + windows.items[window][which])
                self.rows[k].append(pair // len(windows.ids))
                self.tests[k].append(windows.ids.take(pa.array(pair % len(windows.ids))))
            np.add.at(self.covered, start[exact], 1)
            np.add.at(self.covered, start[exact] + windows.lengths[window[exact]], -1)

    def lists(self, k: int, kind: pa.DataType) -> pa.Array:
        """The ids of the tests of each document, once each; those without id are not listed."""
        rows, tests = np.concatenate([np.zeros(0, np.int64), *self.rows[k]]), pa.concat_arrays([pa.array([], kind), *self.tests[k]])
        pairs = pa.table({"row": rows, "test": tests}).filter(pc.field("test").is_valid()).group_by(["row", "test"]).aggregate([])
        pairs = pairs.sort_by("row").combine_chunks()
        column = pairs["test"]
        return _lists(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], kind), pairs["row"].to_numpy(), self.n)

    def spans(self) -> pa.Array:
        hit = np.diff((np.cumsum(self.covered) > 0).astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        row = np.searchsorted(self.spread, begin, "right") - 1
        return _lists(pa.StructArray.from_arrays(
            [pa.array(begin - self.spread[row]), pa.array(end - self.spread[row])], ["start", "end"]), row, self.n)


def _search(batches: Iterator[pa.RecordBatch], windows: str, kept: int, kind: pa.DataType, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = lambda k, i: batch.column(k)[i].values  # noqa: B023,E731
        runs = [_Run(column(2, i).to_numpy()) for i in range(batch.num_rows)]
        for block in _read_windows(windows, kept):
            for i, run in enumerate(runs):
                run.add(block, *[column(k, i).to_numpy() for k in (3, 4, 5)])
        for i, run in enumerate(runs):
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0)[i].as_py()] * run.n, pa.string()), pa.array(np.arange(run.n, dtype=np.int32)), column(1, i),
                pa.array(np.diff(run.bounds)), run.lists(0, kind), run.lists(1, kind), run.spans()], names)
    give_back()


def find_contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: n_words, the tests with exact windows in it (``items``) or with all words of a
    window near their places (``near_items``), and the word ``spans`` that exact windows cover.
    """
    spark = documents.sparkSession
    item, id_type = benchmark.schema[item_col].dataType, documents.schema[id_col].dataType.simpleString()
    stretches = settle(benchmark.select(item_col, item_text_col).mapInArrow(
        lambda batches: _stretches(batches, STRETCH), STRETCHES.format(item=item.simpleString())), "stretches")
    words = stretches.agg(F.sum(F.octet_length("words")) / 8).first()[0] or 0
    parts = max(1, math.ceil(words / PART_TERMS))
    schema = FOUND.format(id_col=id_col, id=id_type, item=item.simpleString())
    names = ["run", "place", id_col, "n_words", "items", "near_items", "spans"]
    kind = to_arrow_type(item)

    def answer(own: DataFrame) -> DataFrame:
        """All documents against some stretches."""
        terms, seen, windows = (scratch_path(spark, name) for name in ("terms", "seen", "windows"))
        own.select("words").mapInArrow(_distinct_terms, "term bigint").distinct().write.parquet(terms)
        terms = qualified(spark, terms)
        index = settle(documents.select(id_col, text_col).mapInArrow(
            lambda batches: _index(batches, terms), INDEX.format(id=id_type)), "postings")
        index.select(F.explode(F.arrays_zip("terms", "counts")).alias("posting")).groupBy(
            F.col("posting.terms").alias("term")).agg(F.sum("posting.counts").alias("n")).write.parquet(seen)
        seen = qualified(spark, seen)
        own.select("item", "words").mapInArrow(
            lambda batches: _window_blocks(batches, terms, seen, BLOCK_WINDOWS), WINDOWS.format(item=item.simpleString())).write.option(
                "compression", "none").parquet(windows)
        windows = qualified(spark, windows)
        return index.mapInArrow(lambda batches: _search(batches, windows, KEPT_BYTES, kind, names), schema)

    if parts == 1:
        return answer(stretches).drop("run", "place")
    whole = reduce(DataFrame.unionAll, [
        answer(stretches.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == k)) for k in range(parts)])
    joined = whole.groupBy("run", "place").agg(
        F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"),
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near_items")],
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return joined.withColumn("spans", merge_spans("spans")).drop("run", "place")


def merge_spans(spans: str):
    """Sorted spans with those that overlap or touch made one."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(last["end"] >= span["start"], F.lit(False))
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(
            F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast(kind), step)
