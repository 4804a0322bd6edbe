"""Jaccard join of word n-grams with prefix filters under several global orders.

Two sets of Jaccard similarity t or more share one of their first n - ceil(t n) + 1 shingles
under any order of all shingles. Candidates share a prefix shingle under the first order, which
puts rare shingles first, and also under two random orders; only then are the sets compared.

Frequencies come from all documents: blocks of documents report the shingles that several of
their documents hold, and one in ``ONE_IN`` of all others, which tells those that are spread thinly
over very many blocks. The ``MAX_FREQUENT`` most reported ones (sent to the tasks, 12 bytes each)
stand at the end of the order. That decides only how many candidates there are, never
which pairs are found.

Documents with equal sets are one node. A group of near copies is not expanded into pairs:
nodes that share a prefix shingle are compared with one node of it first (two rounds with
different ones, the least edited first), and afterwards only pairs whose parts are still apart
are enumerated, by a second prefix filter on the shingles that nodes share.

Memory: a task holds one block of documents. No key is gathered whole: a frequent shingle is
split by salt, and the rounds use minima, counts and joins. Nodes are 64-bit hashes of sets.

Defined results: a missing or empty text has an empty set and its own component; texts with
fewer words than a shingle are one shingle; a missing id is never the smallest; repeated rows
are copies; an empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.llm.components import components
from songloom.llm.words import SPACED, blocks, find_words, give_back, mix, runs
from songloom.session import settle

WORDS = 5
PERCENT = 75
BLOCK_BYTES = 4 << 20
MAX_FREQUENT = 1 << 18
ROUNDS = 2
# Sizes of a class differ by this factor.
CLASS = 1.01
BEFORE = 64
# Of so many shingles a block reports one, whether it is frequent there or not.
ONE_IN = 256
# Nodes of a frequent shingle that meet in one task, roughly.
PER_SALT = 2048
ORDER_SEEDS = (0x9AE16A3B2F90404F, 0xC949D7C7509E6557)


def shingle_sets(texts: pa.Array, words: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, ascending distinct shingle hashes of each) for runs of rows."""
    for first, end, data, bounds in blocks(texts, limit):
        found = find_words(data, bounds, SPACED, lower=True)
        hashes = found.hashes()
        grams, sets = runs(hashes, words), []
        for a, z in zip(found.bounds[:-1], found.bounds[1:], strict=True):
            s = np.sort(grams[a:z - words + 1]) if z - a >= words else runs(hashes[a:z], max(1, z - a))
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
        yield first, end, sets


def _node(s: np.ndarray) -> int:
    """A number for a set."""
    return int(mix(np.array([mix(s).sum() ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered_prefix(s: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """The prefix of a set under a random order, ascending by hash."""
    return np.sort(s[np.argsort(mix(s ^ np.uint64(seed)))[:prefix_size(len(s), percent)]])


def _describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and a row per shingle that several sets of a block hold or that is drawn.

    Blocks draw one shingle in ``ONE_IN``: one that stands once in each of very many blocks is noticed too.
    """
    names = ["row", "n", "node", "shingle", "count", "drawn"]
    for batch in batches:
        for first, end, sets in shingle_sets(batch.column(1), words):
            nodes = [_node(s) if len(s) else 0 for s in sets]
            rows = batch.column(0).slice(first, end - first)
            yield pa.RecordBatch.from_arrays([
                rows, pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
                *[pa.nulls(len(sets), pa.int64())] * 3], names)
            once = {node: s for node, s in zip(nodes, sets, strict=True) if len(s)}
            every = np.sort(np.concatenate(list(once.values()))) if once else np.zeros(0, np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else every.astype(int)
            counts = np.diff(np.append(starts, len(every)))
            held = every[starts]
            # Drawn anew by each block, so that a shingle of many blocks is drawn in its share of them.
            block = np.uint64(np.bitwise_xor.reduce(np.array(nodes, np.int64)) & 0x7FFFFFFFFFFFFFFF)
            drawn = mix(held ^ mix(np.array([block]))) < np.uint64((1 << 64) // ONE_IN)
            told = (counts > 1) | drawn
            n = int(told.sum())
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, rows.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                pa.array(held[told].view(np.int64)), pa.array(np.where(counts > 1, counts, 0)[told]),
                pa.array(drawn[told].astype(np.int64))], names)
    give_back()


class Frequent:
    """How often frequent shingles were reported."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        maybe = np.flatnonzero(self.flags[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.shingles, s[maybe]), len(self.shingles) - 1)
            out[maybe] = np.where(self.shingles[at] == s[maybe], self.counts[at], 0)
        return out


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, sent) -> Iterator[pa.RecordBatch]:
    """(shingle, salt, node, n) for the prefix of each distinct set of a block, rare shingles first."""
    frequent: Frequent = sent.value
    for batch in batches:
        for _, _, sets in shingle_sets(batch.column(1), words):
            once = {_node(s): s for s in sets if len(s)}
            if not once:
                continue
            nodes, kept = np.fromiter(once, np.int64, len(once)), list(once.values())
            counts = frequent.of(np.concatenate(kept))
            shingles, seen, sizes, at = [], [], [], 0
            for s in kept:
                count, size = counts[at:at + len(s)], prefix_size(len(s), percent)
                at += len(s)
                # Ascending already, so a stable sort by frequency is the order.
                head = np.argsort(count, kind="stable")[:size] if count.any() else slice(size)
                shingles.append(s[head])
                seen.append(count[head])
                sizes.append(len(shingles[-1]))
            node = np.repeat(nodes, sizes)
            parts = np.concatenate(seen) // PER_SALT + 1
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(shingles).view(np.int64)),
                pa.array(((node & 0x7FFFFFFF) % parts).astype(np.int32)), pa.array(node),
                pa.array(np.repeat([len(s) for s in kept], sizes).astype(np.int32)),
                pa.array(parts > 1)], ["shingle", "salt", "node", "n", "common"])
    give_back()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by shingle, salt and node, those whose shingle several nodes hold, once each.

    All that is held back is a shingle's first row, until another node's shows that it is shared.
    """
    names = ["shingle", "node", "n"]
    last: tuple | None = None          # shingle, salt and node of the row before
    several, held = False, None        # whether its shingle is shared, and its first row if that is not known yet
    for batch in batches:
        if not batch.num_rows:
            continue
        shingle, salt, node, common = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "salt", "node", "common"))
        goes_on = last is not None and last[:2] == (shingle[0], salt[0])
        new = np.concatenate([[not goes_on], (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])])
        fresh = new | np.concatenate([[not goes_on or last[2] != node[0]], node[1:] != node[:-1]])
        group = np.cumsum(new) - int(not goes_on)
        nodes = np.bincount(group, weights=fresh).astype(np.int64)
        if goes_on:  # what came before it counts, if it is one node or more
            nodes[0] += 1 + several
        shared = nodes > 1
        if held is not None:
            if goes_on and shared[0]:
                yield held
        final = int(group[-1])
        if not goes_on or shared[0] or final > 0:
            held = None
        keep = fresh & (shared[group] | common)
        yield batch.filter(pa.array(keep)).select(names)
        if not shared[final] and not common[-1] and (final > 0 or not goes_on):
            held = batch.slice(int(np.flatnonzero(group == final)[0]), 1).select(names)
        last, several = (shingle[-1], salt[-1], node[-1]), bool(shared[final])
    give_back()


def _stored_sets(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, sets in shingle_sets(batch.column(0), words):
            once = {_node(s): s for s in sets if len(s)}
            orders = [[ordered_prefix(s, seed, percent).tobytes() for s in once.values()] for seed in ORDER_SEEDS]
            yield pa.RecordBatch.from_arrays([
                pa.array(list(once), pa.int64()), pa.array([s.tobytes() for s in once.values()], pa.binary()),
                *[pa.array(o, pa.binary()) for o in orders]], ["node", "shingles", "second", "third"])
    give_back()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that pass the filters of the other orders and then the comparison of their sets."""
    for batch in batches:
        read = {c: [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in batch.schema.names[2:]}
        keep = []
        for i in range(batch.num_rows):
            ok = all(_common(read["a_" + c][i], read["b_" + c][i]) for c in ("second", "third"))
            if ok:
                a, b = read["a_shingles"][i], read["b_shingles"][i]
                n = _common(a, b)
                ok = 100 * n >= percent * (len(a) + len(b) - n)
            keep.append(ok)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    give_back()


def _frequent(reported: DataFrame, most: int) -> Frequent:
    """The most reported shingles, at most ``most``: all from some count on."""
    # Drawn once says nothing about a shingle.
    often = F.when(F.sum("drawn") > 1, F.sum("drawn") * ONE_IN).otherwise(0)
    totals = settle(reported.groupBy("shingle").agg((F.sum("count") + often).alias("n")).filter("n > 0"), "shingles")
    least, taken = 1 << 62, 0
    for row in totals.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect():
        if taken + row["count"] > most:
            break
        least, taken = row["n"], taken + row["count"]
    rows = totals.filter(F.col("n") >= least).toArrow()
    return Frequent(rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy())


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are links."""
    columns = ("shingles", "second", "third")
    joined = pairs.select("a", "b")
    for side in ("a", "b"):
        joined = joined.join(
            sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    joined = joined.select("a", "b", *[f"{side}_{c}" for side in ("a", "b") for c in columns])
    return settle(joined.mapInArrow(lambda batches: _linked(batches, percent), "a bigint, b bigint"), "links")


def _fetch_sets(documents: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The stored set of each of the nodes, from the text of one document that has it."""
    chosen = rows.join(nodes, "node").groupBy("node").agg(F.min("row").alias("chosen")).select("chosen").distinct()
    texts = documents.join(chosen, F.col("row").eqNullSafe(F.col("chosen")), "left_semi").select("text")
    sets = texts.mapInArrow(lambda batches: _stored_sets(batches, words, percent),
                            "node bigint, shingles binary, second binary, third binary")
    return settle(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _parted(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix shingles that nodes of different parts hold, and the part of each node."""
    if labels is None:
        return held.withColumn("label", F.col("node"))
    return held.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _star_pairs(parted: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each node with the hub, of another part, that it shares most prefix shingles with.

    Each shingle has one hub: in the first turn the node with the largest share of shingles that
    others hold, which of a group of edited copies is the one edited least; later the node that is
    least by a hash of its own for each turn. A node that shares little with its hub waits for a
    later step.
    """
    random = F.xxhash64("node", F.lit(turn))
    order = F.struct((-F.col("held")).alias("held"), random.alias("random")) if turn == 0 else random
    hubs = parted.groupBy("shingle").agg(
        F.min(F.struct(order.alias("order"), "node", "n", "label")).alias("hub"),
        F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("shingle", "hub")
    shared = parted.join(hubs, "shingle").filter(
        (F.col("label") != F.col("hub.label")) & _fits(F.col("n"), F.col("hub.n"), percent)).groupBy(
            "node", "n", F.col("hub.node").alias("hub")).count().filter("count * 20 >= n")
    return shared.groupBy(F.col("node").alias("a")).agg(F.max_by("hub", F.struct("count", "hub")).alias("b"))


def _remaining_pairs(parted: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different parts that can share enough prefix shingles.

    Similar sets have a number of prefix shingles in common, see :func:`_least_common`. So among
    the prefix shingles that a node shares with any node of a size class, all but that number
    less one, the rarest, hold one that it shares with each similar set of that class: the
    prefix filter once more, on what the first one left. A group of copies has its common
    shingles at the end of that order, and those edited too much do not meet all others.
    """
    classed = parted.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(CLASS)).cast("int"))
    met = classed.groupBy("shingle", F.col("class").alias("other")).agg(
        F.min("label").alias("low"), F.max("label").alias("high"))
    holders = classed.groupBy("shingle").agg(F.count("*").alias("holders"))
    # Sizes of the class that can be similar enough. The count needed grows with them up to n and then
    # falls, there with steps up of one at most.
    low = F.greatest(F.floor(F.pow(F.lit(CLASS), F.col("other"))), F.ceil(F.col("n") * percent / 100))
    high = F.least(F.ceil(F.pow(F.lit(CLASS), F.col("other") + 1)), F.floor(F.col("n") * 100 / percent))
    above = F.when(high > F.col("n"), _least_common(F.col("n"), high, percent) - 1)
    below = F.when(low <= F.col("n"), _least_common(F.col("n"), low, percent))
    needed = F.greatest(F.least(below, above), F.lit(1))
    meeting = classed.join(met.join(holders, "shingle"), "shingle").filter(
        ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label"))) & (low <= high))
    own = Window.partitionBy("node", "other")
    ordered = own.orderBy("holders", "shingle")
    rarest = meeting.withColumn("place", F.row_number().over(ordered)).withColumn(
        "shared", F.count("*").over(own)).filter(F.col("place") <= F.col("shared") - needed + 1)
    # The shingles just before, to make a pair at the first it has in common only.
    rows = settle(rarest.withColumn("before", F.collect_list("shingle").over(ordered.rowsBetween(-BEFORE, -1))).select(
        "shingle", "node", "n", "label", "class", "other", "before"), "rows")
    left = rows.select("shingle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("l_a"),
                       F.col("class").alias("c_a"), F.col("other").alias("c_b"), F.col("before").alias("before_a"))
    right = rows.select("shingle", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("l_b"),
                        F.col("class").alias("c_b"), F.col("other").alias("c_a"), F.col("before").alias("before_b"))
    pairs = left.join(right, ["shingle", "c_a", "c_b"]).filter(
        (F.col("a") < F.col("b")) & (F.col("l_a") != F.col("l_b")) & _fits(F.col("n_a"), F.col("n_b"), percent)
        & ~F.arrays_overlap("before_a", "before_b")).select("a", "b").distinct()
    # Of these, the pairs whose prefixes have as much in common as they need.
    pairs = settle(pairs, "near")
    near = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    lists = settle(parted.join(near, "node", "left_semi").groupBy("node", "n").agg(
        F.collect_list("shingle").alias("list")), "lists")
    for side in ("a", "b"):
        pairs = pairs.join(lists.select(*[F.col(c).alias(f"{c}_{side}") for c in lists.columns]).withColumnRenamed(
            f"node_{side}", side), side)
    return pairs.select("a", "b", "n_a", "n_b", "list_a", "list_b").mapInArrow(
        lambda batches: _enough_common(batches, percent), "a bigint, b bigint")


def _enough_common(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n_a, n_b, list_a, list_b in zip(*(batch.column(c) for c in ("n_a", "n_b", "list_a", "list_b")), strict=True):
            n_a, n_b = n_a.as_py(), n_b.as_py()
            rest = -(-max(n_a, n_b) * percent // 100) - 1
            overlap = -(-(n_a + n_b) * percent // (100 + percent))
            keep.append(_common(list_a.values.to_numpy(), np.sort(list_b.values.to_numpy())) >= overlap - rest)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _least_common(a: Column, b: Column, percent: int) -> Column:
    """How many prefix shingles two sets of these sizes share at least, if they are similar enough.

    Outside of its prefix, the set whose prefix ends first has ceil(t n) - 1 shingles, so fewer
    common ones in the prefixes cannot add up to the overlap that the similarity asks for.
    """
    rest = F.ceil(F.greatest(a, b) * percent / 100) - 1
    overlap = F.ceil((a + b) * percent / (100 + percent))
    return F.greatest(overlap - rest, F.lit(1))


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """Per document: its id, n_shingles, node (equal for equal sets) and component_id.

    Two documents are linked when 100 * common shingles >= percent * shingles of both together.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = documents.schema["row"].dataType.simpleString()
    described = settle(documents.mapInArrow(
        lambda batches: _describe(batches, words),
        f"row {id_type}, n bigint, node bigint, shingle bigint, count bigint, drawn bigint"), "described")
    rows = described.filter("n IS NOT NULL").select("row", "n", "node")
    sent = spark.sparkContext.broadcast(_frequent(described.filter("shingle IS NOT NULL"), MAX_FREQUENT))

    prefixes = documents.mapInArrow(
        lambda batches: _prefixes(batches, words, percent, sent),
        "shingle bigint, salt int, node bigint, n int, common boolean")
    held = settle(prefixes.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "node").mapInArrow(
        _shared, "shingle bigint, node bigint, n int"), "prefixes")
    shares = held.groupBy("node", "n").agg(F.floor(F.count("*") * 1000 / F.col("n")).alias("held")).drop("n")
    held = settle(held.join(shares, "node"), "held")

    sets = labels = None
    for turn in range(ROUNDS + 1):
        parted = _parted(held, labels)
        pairs = settle(
            _star_pairs(parted, turn, percent) if turn < ROUNDS else _remaining_pairs(parted, percent), "pairs")
        if pairs.isEmpty():
            continue
        nodes = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
        if sets is not None:
            nodes = nodes.join(sets, "node", "left_anti")
        fetched = _fetch_sets(documents, nodes, rows, words, percent)
        sets = fetched if sets is None else sets.unionAll(fetched)
        found = _verify(pairs, sets, percent)
        if labels is not None:
            if found.isEmpty():
                continue
            # Parts as they are, each node tied to its label, and the new links.
            found = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(found)
        labels = components(found)

    if labels is None:
        labelled = rows.withColumn("label", F.col("node"))
    else:
        labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.filter("n > 0").groupBy("label").agg(F.min("row").alias("least"))
    return labelled.join(least, "label", "left").select(
        F.col("row").alias(id_col), F.col("n").alias("n_shingles"), "node",
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("row")).alias("component_id"))
