"""A word bigram model with Katz backoff, learned from documents and applied to all of them.

A seen bigram gets its count, discounted by Good and Turing's estimate while it is small, over the
count of its first word. What the discounts of a word leave over goes to the words that never
followed it, in proportion to their own probability: the backoff weight is what is left over
divided by the probability of exactly these words, so that all words together have 1. A word's own
probability is found by the same rule one order below, from its discounted count; what is left
there is the probability of one unknown word that stands for all that were not learned. Each
token is evaluated from the longest order down to the first that was seen.

Texts are cut into blocks of about ``BLOCK_TOKENS`` tokens, each stored as one row: the block's words
and the numbers of its tokens. Counts live in tables that are partitioned by a hash of the word
(bigrams: of the first word). Blocks send each part their distinct words or bigrams with counts;
a part adds them up and sends every block the totals it asked for, in the order it asked. So a
word costs one entry per block, however often it stands there, and the tokens never leave their
block. The number of parts grows with the corpus, so a part has about ``PART_TOKENS`` entries; a
first word with many bigrams is spread over several parts by the second, and its sums meet again.

Memory: one block, or one part. All counts are whole numbers over all documents learned from.

Where the counts of counts give a discount outside of (0, 1], it is (r - 0.5) / r. A word whose
followers are all too frequent to be discounted leaves 1 / (its count + 1) over, all its
probabilities being scaled to fit. With nothing to learn from, every token has probability 1.

Defined results: a missing or empty text has the end token only; a missing id is passed on and never
held out; repeated rows are counted and scored each; an empty table gives an empty result. Words are
told apart by 64-bit hashes. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.words import SPACED, blocks, find_words, give_back, mix
from songloom.session import settle

BLOCK_TOKENS = 2_500_000
TEXT_BYTES = 2 << 20
# Tokens of the corpus for each part, and for each further part of a first word.
PART_TOKENS = 2_000_000
SPREAD_TOKENS = 250_000
# Counts up to this one are discounted.
LARGEST = 5
# Numbers of the end of a document and of the place before its first word.
END, BEGIN = np.uint64(0x5DEECE66D0000001), np.uint64(0x5DEECE66D0000002)

_CHUNK = "part int, block bigint, kind int, payload array<binary>, stats array<bigint>"
_CHUNKS = pa.schema({"part": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "payload": pa.list_(pa.binary()),
                     "stats": pa.list_(pa.int64())})
WORDS, SUMS, STATS, BIGRAMS, CONTEXTS = range(5)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers (not below 0) in as few bytes as the largest needs, byte by byte, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = pa.decompress(data[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.int64)


def _floats(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<f8").tobytes(), "zstd", asbytes=True)


def _from_floats(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), "<f8")


def discounts(of_counts: list[int]) -> np.ndarray:
    """Share of its count that an n-gram seen r times keeps, for r = 0 .. ``LARGEST`` (0 for 0).

    ``of_counts`` says how many n-grams were seen 1, 2, .. ``LARGEST`` + 1 times.
    """
    n, keep = [0, *of_counts], np.zeros(LARGEST + 1)
    common = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGEST + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        keep[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return keep


def kept(counts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts * np.where(counts > LARGEST, 1.0, keep[np.minimum(counts, LARGEST)])


@dataclass
class Unigrams:
    """Probabilities of single words from their counts."""

    total: int                     # tokens learned from
    distinct: int                  # different ones
    of_counts: list[int]
    keep: np.ndarray = field(init=False)
    scale: float = field(init=False)
    unknown: float = field(init=False)

    def __post_init__(self):
        self.keep = discounts(self.of_counts)
        left = sum((1 - self.keep[r]) * r * self.of_counts[r - 1] for r in range(1, LARGEST + 1))
        if self.total == 0:
            self.scale, self.unknown = 0.0, 1.0
        elif left > 0:
            self.scale, self.unknown = 1 / self.total, left / self.total
        else:
            self.scale, self.unknown = 1 / (self.total + 1), 1 / (self.total + 1)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, kept(counts, self.keep) * self.scale, self.unknown)


# Blocks

def _tokenized(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """One row per block: its documents (id, held out, tokens) and its tokens by the number of their word."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids: list[pa.Array] = []
    held: list[pa.Array] = []
    hashes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def give() -> pa.RecordBatch:
        nonlocal number
        every = np.concatenate(hashes)
        words, token, count = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # small numbers for frequent words
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        out = pa.RecordBatch.from_arrays([
            pa.array([number]), pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
            pa.ListArray.from_arrays(pa.array([0, sum(map(len, held))], pa.int32()), pa.concat_arrays(held)),
            pa.array([pack(np.concatenate(sizes))]), pa.array([np.append(words[order], BEGIN).tobytes()]),
            pa.array([pack(rank[token])]), pa.array([len(every)])],
            ["block", "ids", "held", "sizes", "words", "tokens", "n"])
        for part in (ids, held, hashes, sizes):
            part.clear()
        number += 1
        return out

    waiting = 0
    for batch in batches:
        for first, end, data, bounds in blocks(batch.column(2), TEXT_BYTES):
            found = find_words(data, bounds, SPACED, lower=True)
            counts = np.diff(found.bounds)
            hashes.append(np.insert(found.hashes(), found.bounds[1:], END))
            sizes.append(counts + 1)
            ids.append(batch.column(0).slice(first, end - first))
            held.append(batch.column(1).slice(first, end - first))
            waiting += len(hashes[-1])
            if waiting >= block_tokens:
                yield give()
                waiting = 0
    if waiting:
        yield give()
    give_back()


class _Block:
    """A stored block."""

    def __init__(self, table: pa.Table):
        self.number = table["block"][0].as_py()
        self.ids = table["ids"].combine_chunks()
        self.ids = (self.ids.chunk(0) if isinstance(self.ids, pa.ChunkedArray) else self.ids).flatten()
        self.held = np.array(table["held"][0].as_py(), bool)
        self.sizes, self.tokens = unpack(table["sizes"][0].as_py()), unpack(table["tokens"][0].as_py())
        self.words = np.frombuffer(table["words"][0].as_py(), np.uint64)  # the last is the beginning
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.learned = np.repeat(~self.held, self.sizes)

    def asked(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The words by part, in the order in which the parts are asked, and where each part ends."""
        part = (mix(self.words) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.words, part))
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def bigrams(self, parts: int, numbers: np.ndarray, spread: np.ndarray) -> "_Bigrams":
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.starts] = len(self.words) - 1
        key = before * len(self.words) + self.tokens
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        own = key[order][new]
        first, second = own // len(self.words), own % len(self.words)
        a, b = numbers[first], numbers[second]
        salt = (mix(b.astype(np.uint64)) % spread[first].astype(np.uint64)).astype(np.int64)
        part = (a + salt) % parts
        asked = np.lexsort((b, a, part))
        learned = np.bincount(which, weights=self.learned, minlength=len(own)).astype(np.int64)
        return _Bigrams(which, first, second, a, b, learned, asked, np.searchsorted(part[asked], np.arange(parts + 1)))


@dataclass
class _Bigrams:
    which: np.ndarray    # of each token: its bigram
    first: np.ndarray    # words of each bigram, by their number in the block ..
    second: np.ndarray
    a: np.ndarray        # .. and in the corpus
    b: np.ndarray
    learned: np.ndarray  # how often it stands in documents to learn from
    asked: np.ndarray    # bigrams in the order in which the parts are asked
    ends: np.ndarray


def _batch(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _CHUNKS, strict=True)],
                                schema=_CHUNKS)


def _ask_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = _Block(pa.Table.from_batches([batch.slice(i, 1)]))
            n = len(block.words)
            every = np.bincount(block.tokens, minlength=n)
            learned = np.bincount(block.tokens, weights=block.learned, minlength=n).astype(np.int64)
            every[-1] = len(block.sizes)
            order, ends = block.asked(parts)
            rows = []
            for p in range(parts):
                at = order[ends[p]:ends[p + 1]]
                if len(at):
                    rows.append((p, block.number, WORDS, [block.words[at].tobytes(), pack(learned[at]), pack(every[at])], None))
            yield from _batch(rows).to_batches()


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[(counts > 0) & (counts <= LARGEST + 1)], minlength=LARGEST + 2)[1:].tolist()


def _count_words(table: pa.Table, parts: int, spread_tokens: int) -> pa.Table:
    """Totals of one part's words: a number for each word, its count and over how many parts it is spread."""
    part, numbers = table["part"][0].as_py(), table["block"].to_pylist()
    asked = table["payload"].to_pylist()
    words = np.concatenate([np.frombuffer(a[0], np.uint64) for a in asked])
    own, which = np.unique(words, return_inverse=True)
    learned, every = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    np.add.at(learned, which, np.concatenate([unpack(a[1]) for a in asked]))
    np.add.at(every, which, np.concatenate([unpack(a[2]) for a in asked]))
    rank = np.empty(len(own), np.int64)
    rank[np.argsort(-every, kind="stable")] = np.arange(len(own))  # small numbers for frequent words
    number, spread = rank * parts + part, every // spread_tokens + 1
    rows, at = [], 0
    for block, a in zip(numbers, asked, strict=True):
        w = which[at:at + len(a[0]) // 8]
        at += len(w)
        rows.append((part, block, WORDS, [pack(number[w]), pack(learned[w]), pack(spread[w])], None))
    rows.append((part, -1, STATS, [], [int(learned.sum()), int((learned > 0).sum()), *_of_counts(learned)]))
    return _batch(rows)


def _answers(table: pa.Table, kind: int, field_: int) -> np.ndarray:
    """One field of the answers of a kind, of all parts in their order."""
    rows = sorted((p, pay[field_]) for p, k, pay in zip(table["part"].to_pylist(), table["kind"].to_pylist(),
                                                        table["payload"].to_pylist(), strict=True) if k == kind)
    read = _from_floats if (kind, field_) == (CONTEXTS, 0) else unpack
    return np.concatenate([np.zeros(0, np.int64), *[read(data) for _, data in rows]])


def _ask_bigrams(blocks_: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    give_back()  # what the group before has left
    block = _Block(blocks_)
    order, _ = block.asked(parts)
    number, count, spread = (np.empty(len(order), np.int64) for _ in range(3))
    for k, values in enumerate((number, count, spread)):
        values[order] = _answers(answers, WORDS, k)
    found = block.bigrams(parts, number, spread)
    rows = []
    for p in range(parts):
        at = found.asked[found.ends[p]:found.ends[p + 1]]
        if not len(at):
            continue
        a = found.a[at]
        new = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0]))
        rows.append((p, block.number, BIGRAMS, [
            pack(a[new] // parts), pack(a[new] % parts), pack(np.diff(np.append(new, len(a)))), pack(found.b[at]),
            pack(found.learned[at]), pack(count[found.second[at]])], None))
    return _batch(rows)


def _dense(values: np.ndarray) -> np.ndarray:
    return values if not len(values) or values.max() < 1 << 31 else np.unique(values, return_inverse=True)[1].astype(np.int64)


def _count_bigrams(table: pa.Table, parts: int, unigrams: Unigrams) -> pa.Table:
    """Totals of one part's bigrams, and for each first word what its backoff weight is made from."""
    part, numbers = table["part"][0].as_py(), table["block"].to_pylist()
    asked = [[unpack(x) for x in a] for a in table["payload"].to_pylist()]
    a = np.concatenate([np.repeat(x[0] * parts + x[1], x[2]) for x in asked])
    b, learned, own = (np.concatenate([x[k] for x in asked]) for k in (3, 4, 5))
    key = _dense(a) << 32 | _dense(b)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    total = np.add.reduceat(learned[order], np.flatnonzero(new))
    rows, at = [], 0
    for block, x in zip(numbers, asked, strict=True):
        rows.append((part, block, BIGRAMS, [pack(total[which[at:at + len(x[3])]])], None))
        at += len(x[3])
    seen = np.flatnonzero(total > 0)
    if len(seen):
        first, r, p = a[order][new][seen], total[seen], unigrams.probability(own[order][new][seen])
        by = np.argsort(first, kind="stable")
        first, r, p = first[by], r[by], p[by]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(first) != 0]))
        sums = [np.add.reduceat(x, begin) for x in (r, *[(r == k).astype(np.int64) for k in range(1, LARGEST + 1)], p)]
        context = first[begin]
        for home in np.unique(context % parts):
            mine = context % parts == home
            rows.append((int(home), -1 - part, SUMS, [pack(context[mine]), *[pack(s[mine]) for s in sums[:-1]], _floats(sums[-1][mine])], None))
    rows.append((part, -1, STATS, [], _of_counts(total)))
    return _batch(rows)


def _weigh(table: pa.Table, keep: np.ndarray, least_rest: float) -> pa.Table:
    """For each word that a block asked about: its backoff weight, and twice its count as a first word.

    One is added to that number if all its probabilities are scaled, see above.
    """
    part = table["part"][0].as_py()
    rows = sorted(zip(table["kind"].to_pylist(), table["block"].to_pylist(), table["payload"].to_pylist(), strict=True),
                  key=lambda r: (r[0], r[1]))
    sums = [r[2] for r in rows if r[0] == SUMS]
    every = np.concatenate([np.zeros(0, np.int64), *[unpack(s[0]) for s in sums]])
    own, which = np.unique(every, return_inverse=True)
    added = np.zeros((LARGEST + 1, len(own)), np.int64)
    for k in range(LARGEST + 1):
        np.add.at(added[k], which, np.concatenate([np.zeros(0, np.int64), *[unpack(s[k + 1]) for s in sums]]))
    followed = np.zeros(len(own))
    np.add.at(followed, which, np.concatenate([np.zeros(0), *[_from_floats(s[-1]) for s in sums]]))
    count = added[0]
    left = sum((1 - keep[r]) * r * added[r] for r in range(1, LARGEST + 1)) / np.maximum(count, 1)
    scaled = left <= 0
    left = np.where(scaled, 1 / (count + 1), left)
    weight = np.append(left / np.maximum(1 - followed, least_rest), 1.0)
    code = np.append(2 * count + scaled, 0)
    out = []
    for kind, block, payload in rows:
        if kind == WORDS:
            number = unpack(payload[0])
            at = np.searchsorted(own, number)
            at = np.where((at < len(own)) & (np.append(own, -1)[np.minimum(at, len(own))] == number), at, len(own))
            out.append((part, block, CONTEXTS, [_floats(weight[at]), pack(code[at])], None))
    return _batch(out)


def _score(blocks_: pa.Table, answers: pa.Table, parts: int, unigrams: Unigrams, keep: np.ndarray, schema: pa.Schema) -> pa.Table:
    give_back()
    block = _Block(blocks_)
    order, _ = block.asked(parts)
    number, count, spread, code = (np.empty(len(order), np.int64) for _ in range(4))
    weight = np.empty(len(order))
    for kind, k, values in ((WORDS, 0, number), (WORDS, 1, count), (WORDS, 2, spread), (CONTEXTS, 1, code), (CONTEXTS, 0, weight)):
        values[order] = _answers(answers, kind, k)
    found = block.bigrams(parts, number, spread)
    seen = np.empty(len(found.first), np.int64)
    seen[found.asked] = _answers(answers, BIGRAMS, 0)
    below = unigrams.probability(count)
    of_first = code[found.first] // 2 + code[found.first] % 2
    p = np.where(seen > 0, kept(seen, keep) / np.maximum(of_first, 1), weight[found.first] * below[found.second])
    c = count[block.tokens]
    base = np.log10((c + 0.5) / (unigrams.total + 0.5 * (unigrams.distinct + 1)))
    by_document = lambda x: np.add.reduceat(x, block.starts)
    n = len(block.sizes)
    return pa.Table.from_arrays([
        block.ids, pa.array(block.held), pa.array(block.sizes), pa.array(by_document((c > 0).astype(np.int64))),
        pa.array(np.full(n, unigrams.total)), pa.array(by_document(base)), pa.array(by_document(np.log10(p)[found.which]))],
        schema=schema)


def _stats(rows: DataFrame, n: int) -> list[int]:
    """The parts' numbers added up."""
    sums = rows.filter(F.col("kind") == STATS).agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()
    return [s or 0 for s in sums]


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out",
                    block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS, spread_tokens: int = SPREAD_TOKENS) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Words are learned from documents whose ``held_col`` is not true. ``score`` is the base-10
    logarithm of the text's probability, ``base_score`` that by single words with add-half counts.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(held_col), F.lit(False)).alias("held"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stored = settle(rows.mapInArrow(
        lambda batches: _tokenized(batches, block_tokens),
        f"block bigint, ids array<{kind}>, held array<boolean>, sizes binary, words binary, tokens binary, n bigint"), "blocks")
    parts = max(1, -(-(stored.agg(F.sum("n")).first()[0] or 0) // part_tokens))

    asked = stored.mapInArrow(lambda batches: _ask_words(batches, parts), _CHUNK)
    words = settle(asked.groupBy("part").applyInArrow(lambda t: _count_words(t, parts, spread_tokens), _CHUNK), "words")
    total, distinct, *of_counts = _stats(words, LARGEST + 3)
    unigrams = Unigrams(total, distinct, of_counts)

    of_words = words.filter(F.col("kind") == WORDS)
    asked = stored.groupBy("block").cogroup(of_words.groupBy("block")).applyInArrow(lambda b, a: _ask_bigrams(b, a, parts), _CHUNK)
    bigrams = settle(asked.groupBy("part").applyInArrow(lambda t: _count_bigrams(t, parts, unigrams), _CHUNK), "bigrams")
    keep = discounts(_stats(bigrams, LARGEST + 1))

    contexts = settle(of_words.unionAll(bigrams.filter(F.col("kind") == SUMS)).groupBy("part").applyInArrow(
        lambda t: _weigh(t, keep, unigrams.unknown), _CHUNK), "contexts")
    answers = of_words.unionAll(bigrams.filter(F.col("kind") == BIGRAMS)).unionAll(contexts)
    found = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(b: pa.Table, a: pa.Table) -> pa.Table:
        types = [b.schema.field("ids").type.value_type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        return _score(b, a, parts, unigrams, keep, pa.schema(list(zip(names, types, strict=True))))

    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, found)
