"""Substring dedup: windows of 35 words that occur more than once, found by their hashes.

This stands in for suffix trees split by prefixes, which are not built: no suffixes are sorted and
no prefix is lengthened until a group fits. What is removed depends on equal windows of 35 words
only, which are the leaves below one node of depth 35 of such a tree; trees would give the same
words and were left out as more than that needs. Neighbouring repeated windows of a document are
united, also where their copies lie in different documents, so the stretches are no maximal repeats.

Windows are dealt out in groups by a key of one of two kinds. Usually it is an 8-gram anywhere
within the 35 words, the least one by a hash: neighbouring windows mostly share it and travel as
one record, equal ones always meet. An 8-gram that is frequent would gather too much; its windows go by all of their 35
words. Frequent 8-grams are counted over all documents: blocks report those they hold often, and one
in ``ONE_IN`` of all others, which tells those that are spread thinly over very many blocks. The
``MAX_FREQUENT`` most frequent are sent to the tasks (8 bytes each). All records of a group that
goes by its 35 words are alike, so they are not held together however many there are. Windows repeated within a block of documents are known there
already, and one of each goes on to meet those of other blocks.

Windows and keys are 64-bit hashes.

Defined results: a missing or empty text has no words; repeated rows repeat each other; a missing
id is a value like any other; an empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.words import SPACED, blocks, find_words, give_back, mix, runs
from songloom.session import settle

# Fixed value: words of a repeat, at least.
LENGTH = 35
GRAM = 8
BLOCK_BYTES = 4 << 20
MAX_FREQUENT = 1 << 17
# Suffixes by one 8-gram within a block that make it worth counting.
MANY = 64
# Of so many 8-grams a block reports one, whether it is frequent there or not.
ONE_IN = 256
# Records of one window that are held at a time.
HELD = 65_536

_BYTES = 8
_PLACE = np.uint64((1 << 23) - 1)  # places within a block, which has fewer words


class _Suffixes:
    """The suffixes of a run of documents that have enough words, in order."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
        words = find_words(data, bounds, SPACED, lower=False)
        hashes = words.hashes()
        n = max(0, len(hashes) - length + 1)
        rows = words.rows()
        self.at = np.flatnonzero(rows[:n] == rows[length - 1:]) if n else np.zeros(0, np.int64)
        self.row = rows[self.at]
        self.start = self.at - words.bounds[self.row]
        self.node = runs(hashes, length)[self.at]
        if not len(self.at):
            self.place, self.prefix = self.at, self.node
            return
        grams = runs(hashes, gram)
        if len(grams) <= _PLACE:
            least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            wide, step = length - gram + 1, 1
            while step * 2 <= wide:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            least = np.minimum(least[:n], least[wide - step:wide - step + n])
            self.place = (least & _PLACE).astype(np.int64)[self.at]
        else:  # one very long document: the same choice, a stretch at a time
            self.place = np.concatenate([self._least(grams, self.at[a:a + 65_536], length - gram + 1)
                                         for a in range(0, len(self.at), 65_536)])
        self.prefix = grams[self.place]

    @staticmethod
    def _least(grams: np.ndarray, at: np.ndarray, wide: int) -> np.ndarray:
        return at + (grams[at[:, None] + np.arange(wide)] & ~_PLACE).argmin(axis=1)


def _intervals(start: np.ndarray, new: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first, first word, word after the last) of stretches of neighbouring suffixes."""
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return first, start[first], start[last] + length


def _frequent_grams(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, bounds in blocks(batch.column(0), BLOCK_BYTES):
            suffixes = _Suffixes(data, bounds, length, gram)
            prefix, count = np.unique(suffixes.prefix, return_counts=True)
            # Drawn anew by each block, so that an 8-gram of many blocks is drawn in its share of them.
            block = mix(suffixes.node.sum(keepdims=True)) if len(prefix) else prefix[:1]
            drawn = mix(prefix ^ block) < np.uint64((1 << 64) // ONE_IN)
            many = (count >= MANY) | drawn
            yield pa.RecordBatch.from_arrays([
                pa.array(prefix[many].view(np.int64)), pa.array(np.where(count >= MANY, count, 0)[many]),
                pa.array(np.where(drawn, count, 0)[many]), pa.array(drawn[many].astype(np.int64))], ["prefix", "count", "drawn", "draws"])
    give_back()


def _records(batches: Iterator[pa.RecordBatch], length: int, gram: int, sent) -> Iterator[pa.RecordBatch]:
    """Rows of (part, key, start, known, nodes).

    ``nodes`` are those of neighbouring suffixes from word ``start`` on. A known row has none: it
    says that as many words as ``part`` are repeated.
    """
    frequent: np.ndarray = sent.value
    for batch in batches:
        for first_row, _, data, bounds in blocks(batch.column(1), BLOCK_BYTES):
            s = _Suffixes(data, bounds, length, gram)
            if not len(s.at):
                continue
            keys = batch.column(0).to_numpy()[first_row:]
            order = np.argsort(s.node, kind="stable")
            ordered = s.node[order]
            equal = ordered[1:] == ordered[:-1]
            later = np.concatenate([[False], equal])
            known, kept = np.zeros(len(order), bool), np.ones(len(order), bool)
            known[order] = later | np.concatenate([equal, [False]])
            kept[order] = ~later

            i = np.flatnonzero(known)
            if len(i):
                new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(s.at[i]) != 1) | (np.diff(s.row[i]) != 0)])
                first, begin, end = _intervals(s.start[i], new, length)
                n = len(first)
                yield _batch(end - begin, keys[s.row[i[first]]], begin, np.ones(n, bool), np.zeros(n + 1, np.int32), b"")

            i = np.flatnonzero(kept)
            at = np.minimum(np.searchsorted(frequent, s.prefix[i]), max(0, len(frequent) - 1))
            alone = frequent[at] == s.prefix[i] if len(frequent) else np.zeros(len(i), bool)
            new = np.concatenate([[True], (np.diff(s.at[i]) != 1) | (np.diff(s.place[i]) != 0) | (np.diff(s.row[i]) != 0)])
            first = np.flatnonzero(new | alone | np.concatenate([[False], alone[:-1]]))
            part = np.where(alone, s.node[i], s.prefix[i])[first].view(np.int64)
            nodes = s.node[i].tobytes()
            yield _batch(part, keys[s.row[i[first]]], s.start[i[first]], np.zeros(len(first), bool),
                         (np.append(first, len(i)) * _BYTES).astype(np.int32), nodes)


def _batch(part: np.ndarray, key: np.ndarray, start: np.ndarray, known: np.ndarray, offsets: np.ndarray, nodes: bytes
           ) -> pa.RecordBatch:
    binary = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(nodes)])
    return pa.RecordBatch.from_arrays([
        pa.array(part), pa.array(key), pa.array(start.astype(np.int64)), pa.array(known), binary],
        ["part", "key", "start", "known", "nodes"])


def _deep_nodes(table: pa.Table, length: int) -> pa.RecordBatch:
    """Repeated stretches among the records of whole groups."""
    part, start = table["part"].to_numpy(), table["start"].to_numpy()
    known = table["known"].to_numpy(zero_copy_only=False)
    key = table["key"].to_numpy()
    group = np.cumsum(np.concatenate([[0], part[1:] != part[:-1]]))
    several = (np.bincount(group, weights=~known) > 1)[group] & ~known
    records = np.flatnonzero(several)
    nodes = table["nodes"].combine_chunks()
    nodes = pa.concat_arrays(nodes.chunks) if isinstance(nodes, pa.ChunkedArray) else nodes
    sizes = np.diff(np.frombuffer(nodes.buffers()[1], np.int32)[nodes.offset:nodes.offset + len(nodes) + 1]) // _BYTES
    chosen = nodes.take(pa.array(records))
    node = np.frombuffer(b"".join(v.as_buffer() for v in chosen), np.uint64)
    n = sizes[records]
    record = np.repeat(records, n)
    begin = start[record] + np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((node, group[record]))
    equal = (node[order][1:] == node[order][:-1]) & (group[record][order][1:] == group[record][order][:-1])
    deep = np.zeros(len(record), bool)
    if len(record):
        deep[order] = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
    i = np.flatnonzero(deep)
    new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(record[i]) != 0)])[:len(i)]
    first, a, z = _intervals(begin[i], new, length) if len(i) else (i, i, i)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([key[record[i[first]]], key[known]]).astype(np.int64)),
        pa.array(np.concatenate([a, start[known]]).astype(np.int64)),
        pa.array(np.concatenate([z, start[known] + part[known]]).astype(np.int64))], ["key", "start", "end"])


def _trees(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated stretches, from records ordered by part; the last group of a batch waits for the next.

    A group of one window only is given on as soon as it is large, but for one record that the next ones meet.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        part = table["part"].to_numpy()
        if held and part[0] != held[-1]["part"][-1].as_py():
            yield _deep_nodes(pa.concat_tables(held).combine_chunks(), length)
            held = []
        other = np.flatnonzero(part != part[-1])
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield _deep_nodes(pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks(), length)
            held = []
        held.append(table.slice(cut))
        if sum(t.num_rows for t in held) > HELD:
            group = pa.concat_tables(held).combine_chunks()
            parts = group.filter(pc.invert(group["known"]))
            if parts.num_rows > 1 and len(pc.unique(parts["nodes"])) == 1:
                yield _deep_nodes(group, length)
                held = [parts.slice(parts.num_rows - 1, 1)]
    give_back()
    if held:
        yield _deep_nodes(pa.concat_tables(held).combine_chunks(), length)


def _without(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Cut the words of the spans out of each text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        counts, removed, kept, merged = [], [], [], []
        texts, spans = batch.column(1), batch.column(2)
        for i in range(batch.num_rows):
            words = texts[i].as_buffer().to_pybytes().split()
            cut: list[list[int]] = []
            for span in sorted((s["start"], s["end"]) for s in spans[i].as_py() or ()):
                if cut and span[0] <= cut[-1][1]:
                    cut[-1][1] = max(cut[-1][1], span[1])
                else:
                    cut.append(list(span))
            counts.append(len(words))
            removed.append(sum(z - a for a, z in cut))
            merged.append([{"start": a, "end": z} for a, z in cut])
            for a, z in reversed(cut):
                del words[a:z]
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()), pa.array(merged, pa.list_(pa.struct(
                {"start": pa.int64(), "end": pa.int64()})))], names)


def _most_frequent(counted: DataFrame, most: int) -> np.ndarray:
    """The prefixes that occur most, ascending, at most ``most``: all from some count on."""
    # Drawn once says nothing about an 8-gram.
    often = F.when(F.sum("draws") > 1, F.sum("drawn") * ONE_IN).otherwise(0)
    totals = settle(counted.groupBy("prefix").agg(F.greatest(F.sum("count"), often).alias("n")).filter(F.col("n") >= MANY), "prefixes")
    least, taken = 1 << 62, 0
    for row in totals.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect():
        if taken + row["count"] > most:
            break
        least, taken = row["n"], taken + row["count"]
    return np.sort(totals.filter(F.col("n") >= least).select("prefix").toArrow()["prefix"].to_numpy().view(np.uint64))


def find_repeats(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, start, end) of stretches of words of (key, text) rows that stand elsewhere too; they may overlap."""
    counted = keyed.select("text").mapInArrow(
        lambda batches: _frequent_grams(batches, length, gram), "prefix bigint, count bigint, drawn bigint, draws bigint")
    sent = keyed.sparkSession.sparkContext.broadcast(_most_frequent(counted, MAX_FREQUENT))
    records = keyed.select("key", "text").mapInArrow(
        lambda batches: _records(batches, length, gram, sent),
        "part bigint, key bigint, start bigint, known boolean, nodes binary")
    return records.repartition("part").sortWithinPartitions("part").mapInArrow(
        lambda batches: _trees(batches, length), "key bigint, start bigint, end bigint")


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
                   ) -> DataFrame:
    """Per document: its id, n_words, n_removed, kept (the words left, joined by one space) and spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = documents.select(F.col(id_col).alias("row"), text.alias("text"), F.xxhash64(id_col, text).alias("key"))
    repeats = settle(find_repeats(keyed, length), "repeats").groupBy("key").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = keyed.join(repeats, "key", "left").select("row", "text", "spans")
    id_type = keyed.schema["row"].dataType.simpleString()
    names = [id_col, "n_words", "n_removed", "kept", "spans"]
    return joined.mapInArrow(
        lambda batches: _without(batches, names),
        f"`{id_col}` {id_type}, n_words bigint, n_removed bigint, kept string, "
        "spans array<struct<start:bigint,end:bigint>>")
