"""Token ids in Arrow files of equal-length sequences.

Texts are encoded where they lie; then their ids, two bytes each, are put in order of the
documents' ids, in ranges of about equal bytes, so that no id gathers, missing or repeated. Each range
becomes two Arrow IPC files: ``tokens-N.arrow`` holds sequences of ``LENGTH`` ids and a mask of the same length, both
fixed-size lists in batches of ``SEQUENCES``, so sequence ``i`` is row ``i % SEQUENCES`` of batch
``i // SEQUENCES`` and can be mapped into memory without copying; ``documents-N.arrow`` says where
each document starts and how many ids it has. Ids take 16 bits where the vocabulary allows. Only
the last sequence of a file is filled up, and its mask says from where.

Files are written under a name of their own and then renamed, so a task that runs again leaves
the same file. One row per file comes to the driver.

Defined results: a missing or empty text has only the end id; repeated rows are written each; a
missing id comes first; rows with equal ids, however many, are ordered by a hash of their text; an empty
table writes no file.
Other columns are not used.
"""

from __future__ import annotations

import bisect
import itertools
import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.llm.words import LOWER, Words, blocks, find_words, give_back
from songloom.session import qualified, scratch_path

LENGTH = 2048
SEQUENCES = 64
END_ID = 1
# Bytes of text that are cut into pieces at once, and pieces that the tokenizer gets at once.
BLOCK_BYTES = 2 << 20
PIECES_AT_ONCE = 4096
# Documents that are written at once.
ROWS_AT_ONCE = 1024
# Bytes that the ids a worker remembers may take; its memory is emptied when it is full.
REMEMBERED_BYTES = 48 << 20
# Text of a file, about, and rows drawn to find where files end.
SHARD_BYTES = 32 << 20
SHARD_ROWS = 100
MOST_ROWS = 1_000_000

# How a tokenizer cuts text whose pieces can be told apart by bytes, see Encoder.
CUT_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Bytes by kind: 0 blank or line end, 1 letter, 2 digit, 3 other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 0x0A]] = 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x30:0x3A] = 2
_WORD = _KIND > 0
# Bytes that make a word one piece: not ASCII, or part of a contraction or of a marker's name.
_ODD = np.zeros(256, bool)
_ODD[0x80:] = _ODD[[0x27, 0x3C]] = True


def cut(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Pieces of texts: runs of ASCII letters (as small ones), digits or others, and odd words whole."""
    words = find_words(data, bounds, _WORD, lower=False)
    odd = np.concatenate([[0], np.cumsum(_ODD[data], dtype=np.int64)])
    whole = odd[words.ends] > odd[words.starts]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.starts[whole]] += 1
    np.subtract.at(edge, words.ends[whole], 1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    kind = _KIND[data]
    change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~inside[1:] & ~inside[:-1]) + 1
    edges = []
    for at in (words.starts, words.ends):
        flags = np.zeros(len(data) + 1, bool)
        flags[at] = flags[change] = True
        edges.append(np.flatnonzero(flags))
    starts, ends = edges
    return Words(np.where(inside, data, LOWER[data]), starts, ends, np.searchsorted(starts, bounds))


class Encoder:
    """Ids of texts, each distinct piece of text being encoded once by the tokenizer.

    That is so for a tokenizer that drops white space, lower-cases and parts letters, digits and
    other characters, as its definition says: it never joins two pieces, so the ids of a text are
    those of its pieces. Any other one gets the texts whole. Pieces are known by 64-bit hashes.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.by_piece = cuts_text(definition)
        # A marker of the tokenizer's own, to give it many pieces as one text and find their ends in its ids.
        self.marker = next(((t["content"], t["id"]) for t in json.loads(definition)["added_tokens"]), None) if self.by_piece else None
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of pieces, ascending
        self.number = np.zeros(0, np.int64)  # of each: its place among the ids
        self.ids = np.zeros(0, self.dtype)
        self.ends = np.zeros(1, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids, sizes = array("I"), array("I")
        for a in range(0, len(texts), PIECES_AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(texts[a:a + PIECES_AT_ONCE], add_special_tokens=False):
                ids.extend(own := e.ids)
                sizes.append(len(own))
        return np.frombuffer(ids, np.uint32).astype(self.dtype), np.frombuffer(sizes, np.uint32).astype(np.int64)

    def _encoded_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, with pieces that hold no marker joined by one."""
        own, number = self.marker
        plain = np.array(["<" not in p for p in pieces], bool)
        joined = [p for p, ok in zip(pieces, plain, strict=True) if ok]
        flat, n = [np.zeros(0, self.dtype)], np.zeros(len(pieces), np.int64)
        for a in range(0, len(joined), PIECES_AT_ONCE):
            (found,) = self.tokenizer.encode_batch_fast([own.join(joined[a:a + PIECES_AT_ONCE]) + own], add_special_tokens=False)
            flat.append(np.array(found.ids, np.uint32).astype(self.dtype))
        ids = np.concatenate(flat)
        ends = np.flatnonzero(ids == number)
        n[plain] = np.diff(np.concatenate([[-1], ends])) - 1
        rest, n[~plain] = self._encoded([p for p, ok in zip(pieces, plain, strict=True) if not ok])
        out = np.empty(int(n.sum()), self.dtype)
        of_plain = np.repeat(plain, n)
        out[of_plain], out[~of_plain] = ids[ids != number], rest
        return out, n

    def encode(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and how many each text has."""
        if not self.by_piece:
            flat, sizes = self._encoded([t or "" for t in texts.to_pylist()])
            return np.insert(flat, np.cumsum(sizes), END_ID), sizes + 1
        pieces = cut(data, bounds)
        own, first, which = np.unique(pieces.hashes(), return_index=True, return_inverse=True)
        if self.known.nbytes + self.number.nbytes + self.ids.nbytes + self.ends.nbytes > REMEMBERED_BYTES:
            self._forget()
        at = np.searchsorted(self.known, own)
        fresh = np.append(self.known, 0)[at] != own if len(self.known) else np.ones(len(own), bool)
        fresh |= at == len(self.known)
        if fresh.any():
            flat = pieces.data.tobytes()
            new = first[fresh]
            ids, sizes = self._encoded_pieces([flat[a:z].decode() for a, z in zip(
                pieces.starts[new].tolist(), pieces.ends[new].tolist(), strict=True)])
            self.known = np.insert(self.known, at[fresh], own[fresh])
            self.number = np.insert(self.number, at[fresh], len(self.number) + np.arange(len(new)))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        number = self.number[np.searchsorted(self.known, own)][which]
        starts, sizes = self.ends[number], self.ends[number + 1] - self.ends[number]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)]
        ends = total[pieces.bounds]
        return np.insert(flat, ends[1:], END_ID), np.diff(ends) + 1


def cuts_text(definition: bytes) -> bool:
    """Whether a tokenizer cuts text as :func:`cut` does, or finer."""
    tokenizer = json.loads(definition)
    before = tokenizer.get("pre_tokenizer") or {}
    split = (before.get("pretokenizers") or [{}])[0]
    return bool(
        (tokenizer.get("normalizer") or {}).get("normalizers") == CUT_NORMALIZERS and tokenizer.get("post_processor") is None
        and split.get("type") == "Split" and split.get("pattern") == {"Regex": CUT_PATTERN}
        and split.get("behavior") == "Removed" and split.get("invert") is True
        and tokenizer.get("added_tokens")
        and all(t["content"].startswith("<") and " " not in t["content"] for t in tokenizer["added_tokens"]))


_encoders: dict[int, Encoder] = {}


def _encoder(definition: bytes) -> Encoder:
    """One per worker process, so that what it remembers outlives a task."""
    key = zlib.crc32(definition)
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def _sequences(ids: np.ndarray, real: int, length: int) -> list[pa.Array]:
    mask = np.arange(len(ids)) < real
    return [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)]


class _Output:
    """An Arrow file that appears under its name when it is complete."""

    def __init__(self, path: str, schema: pa.Schema):
        self.system, self.path = fs.FileSystem.from_uri(path)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.sink = self.system.open_output_stream(self.own)
        self.writer = ipc.new_file(self.sink, schema)

    def close(self) -> None:
        self.writer.close()
        self.sink.close()
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)
        self.system.move(self.own, self.path)


def _order(row_id, mark: int) -> tuple:
    """Ids as Spark orders them, missing ones first, and equal ones by their text's hash."""
    return row_id is not None, 0 if row_id is None else row_id, mark


def _encode(batches: Iterator[pa.RecordBatch], definition, ends) -> Iterator[pa.RecordBatch]:
    """(shard, id, mark, n, ids) of each text.

    Rows that equal the first of one or more files, and so each other, are dealt out to all of these in turn.
    """
    encoder, turn = _encoder(definition.value), itertools.count()
    for batch in batches:
        for first, end, data, bounds in blocks(batch.column(2), BLOCK_BYTES):
            rows = batch.slice(first, end - first)
            ids, counts = encoder.encode(rows.column(2), data, bounds)
            shards = []
            for row_id, mark in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                key = _order(row_id, mark)
                low, high = bisect.bisect_left(ends.value, key), bisect.bisect_right(ends.value, key)
                shards.append(low if low == high else low + next(turn) % (high - low + 1))
            offsets = np.concatenate([[0], np.cumsum(counts)]) * encoder.dtype.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(
                ids.astype(encoder.dtype))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(shards, pa.int32()), rows.column(0), rows.column(1), pa.array(counts, pa.int64()), packed],
                ["shard", "id", "mark", "n", "ids"])
    give_back()


class _Shard:
    """The two files of one shard while they are written."""

    def __init__(self, folder: str, shard: int, id_type: pa.DataType, dtype: np.dtype, length: int):
        self.shard, self.length, self.done, self.n_docs = shard, length, 0, 0
        self.kept = np.zeros(0, dtype)
        self.tokens = _Output(f"{folder}/tokens-{shard:06d}.arrow", pa.schema(
            {"ids": pa.list_(pa.from_numpy_dtype(dtype), length), "mask": pa.list_(pa.bool_(), length)}))
        self.documents = _Output(f"{folder}/documents-{shard:06d}.arrow", pa.schema(
            {"doc_id": id_type, "start": pa.int64(), "n_tokens": pa.int64()}))

    def add(self, rows: pa.RecordBatch) -> None:
        counts = rows.column(3).to_numpy()
        ends = self.done + np.cumsum(counts)
        self.documents.writer.write_batch(pa.RecordBatch.from_arrays(
            [rows.column(1), pa.array(ends - counts), pa.array(counts)], ["doc_id", "start", "n_tokens"]))
        self.done, self.n_docs, whole = int(ends[-1]), self.n_docs + rows.num_rows, self.length * SEQUENCES
        self.kept = np.concatenate([self.kept, *[np.frombuffer(v.as_buffer(), self.kept.dtype) for v in rows.column(4)]])
        full = len(self.kept) // whole * whole
        for a in range(0, full, whole):
            self.tokens.writer.write_batch(pa.RecordBatch.from_arrays(
                _sequences(self.kept[a:a + whole], whole, self.length), ["ids", "mask"]))
        self.kept = self.kept[full:]

    def close(self) -> pa.RecordBatch:
        if len(self.kept):
            filled = np.concatenate([self.kept, np.zeros(-len(self.kept) % self.length, self.kept.dtype)])
            self.tokens.writer.write_batch(pa.RecordBatch.from_arrays(
                _sequences(filled, len(self.kept), self.length), ["ids", "mask"]))
        self.tokens.close()
        self.documents.close()
        return pa.RecordBatch.from_pydict(
            {"shard": [self.shard], "n_docs": [self.n_docs], "n_tokens": [self.done]}, schema=pa.schema(
                {"shard": pa.int32(), "n_docs": pa.int64(), "n_tokens": pa.int64()}))


def _write(batches: Iterator[pa.RecordBatch], folder: str, dtype: np.dtype, length: int) -> Iterator[pa.RecordBatch]:
    """Files of the shards of a task, whose rows come in order."""
    open_: _Shard | None = None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if a == z:
                continue
            if open_ is not None and open_.shard != shards[a]:
                yield open_.close()
                open_ = None
            if open_ is None:
                open_ = _Shard(folder, int(shards[a]), batch.column(1).type, dtype, length)
            for at in range(a, z, ROWS_AT_ONCE):
                open_.add(batch.slice(at, min(ROWS_AT_ONCE, z - at)))
    if open_ is not None:
        yield open_.close()
    give_back()


@dataclass
class TokenFiles:
    """Where a set of files lies: its folder, and per file its number, documents and ids."""

    folder: str
    shards: list[tuple[int, int, int]]


def _shard_ends(keyed: DataFrame) -> list[tuple]:
    """The first (id, mark) of every file but the first, from a sample of ids and lengths.

    At most about ``MOST_ROWS`` rows are drawn, by a hash; they decide only how large files are.
    """
    n_rows, n_bytes = keyed.agg(F.count("*"), F.sum("size")).first()
    shards = -(-(n_bytes or 0) // SHARD_BYTES)
    if shards < 2:
        return []
    one_in = max(1, n_rows // min(MOST_ROWS, SHARD_ROWS * shards))
    drawn = keyed.filter(F.pmod(F.xxhash64("mark", "id"), F.lit(one_in)) == 0)
    rows = sorted((_order(r["id"], r["mark"]), r["size"]) for r in drawn.toLocalIterator())
    total = np.cumsum([size for _, size in rows])
    at = np.searchsorted(total, np.arange(1, shards) * (int(total[-1]) / shards)) if len(rows) else []
    return [rows[i][0] for i in at]


def write_tokens(documents: DataFrame, definition: bytes, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", length: int = LENGTH) -> TokenFiles:
    """Encode every text and write the files, in ascending order of the ids.

    ``definition`` is the tokenizer's JSON, ``folder`` a path that all executors reach (a new
    one in the shared folder by default).
    """
    spark = documents.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "tokens"))
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    keyed = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"),
                             F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = _shard_ends(keyed.select("id", "mark", F.octet_length("text").cast("bigint").alias("size")))
    sent, starts = spark.sparkContext.broadcast(definition), spark.sparkContext.broadcast(ends)
    dtype = Encoder(definition).dtype
    encoded = keyed.mapInArrow(
        lambda batches: _encode(batches, sent, starts),
        f"shard int, id {keyed.schema['id'].dataType.simpleString()}, mark bigint, n bigint, ids binary")
    ordered = encoded.repartitionById(len(ends) + 1, "shard").sortWithinPartitions("shard", "id", "mark", "ids")
    rows = ordered.mapInArrow(
        lambda batches: _write(batches, folder, dtype, length), "shard int, n_docs bigint, n_tokens bigint").collect()
    return TokenFiles(folder, sorted((r["shard"], r["n_docs"], r["n_tokens"]) for r in rows))


class Sequences:
    """Random access to one file of sequences."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.reader = ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * SEQUENCES + self.reader.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        batch = self.reader.get_batch(i // SEQUENCES).slice(i % SEQUENCES, 1)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten()

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from one place of the file's stream to another."""
        step = self.length * SEQUENCES
        first = start // step
        parts = [np.zeros(0, np.uint32)]
        for k in range(first, -(-end // step)):
            batch = self.reader.get_batch(k)
            flat, mask = batch.column(0).flatten(), batch.column(1).flatten()
            parts.append((flat if mask.true_count == len(mask) else flat.filter(mask)).to_numpy())
        return np.concatenate(parts)[start - first * step:end - first * step].astype("<u4")


def _read(batches: Iterator[pa.RecordBatch], files: TokenFiles, before: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in batch.column(0).to_pylist():
            shard = files.shards[k][0]
            sequences = Sequences(f"{files.folder}/tokens-{shard:06d}.arrow")
            system, path = fs.FileSystem.from_uri(f"{files.folder}/documents-{shard:06d}.arrow")
            with system.open_input_file(path) as source:
                reader = ipc.open_file(source)
                for n in range(reader.num_record_batches):
                    rows = reader.get_batch(n)
                    starts, counts = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                    ids = sequences.ids(int(starts[0]), int(starts[-1] + counts[-1]))
                    crc = [zlib.crc32(ids[a:a + c]) for a, c in zip(starts - starts[0], counts, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(starts + before[k]), rows.column(2), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, files: TokenFiles, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = [0, *itertools.accumulate(n for _, _, n in files.shards)]
    n = len(files.shards)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(
        lambda batches: _read(batches, files, before),
        f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
