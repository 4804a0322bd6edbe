"""A Merkle manifest of a dataset: one root for all documents, and a witness for each of them.

A document's leaf is the hash of its fields. The leaves of a source are joined in runs of
``FANOUT`` until one node is left, the subroot of the source; the subroots of all sources, in
their order, are joined the same way into the root. A witness holds, level by level, the digests
of the other nodes of each run on the way up, so that a document can be checked against the root
without any other document.

Witnesses are made while leaves are appended (:class:`Frontier`): an appended leaf opens a witness,
and whenever a run is complete every witness below it is extended by the siblings within the run.
On a cluster, leaves are cut at multiples of ``FANOUT ** HEIGHT`` within their source, so every
block is a subtree of its own that a task appends in order. The roots of the blocks are then
appended in the same way, in as many rounds as it takes; a round has ``FANOUT ** HEIGHT`` times
fewer nodes than the one before. On the way back each block's own witness goes to the task that
appends the block once more, as a row ahead of its leaves, and ends all witnesses of the block.
Digests travel, texts do not: one leaf of a few dozen bytes per document.

Memory: one block of leaves in a task. A source of any size is many blocks; positions come from
counts per range, see :func:`songloom.operators.groups.row_positions`.

Defined results: a missing field is ``-``; a missing id or source comes first and is a value like
any other; rows with equal ids are ordered by their leaves, repeated rows are leaves each; an
empty table has no root and gives no rows. Columns of the table pass on whatever their names, but
``leaf``, ``witness``, ``subroot`` and ``root`` are replaced if it has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.operators.groups import row_positions
from songloom.session import settle

# Fixed value: nodes of a run.
FANOUT = 3
# Levels of a block's tree; a block has FANOUT ** HEIGHT leaves.
HEIGHT = 7
# Rows of witnesses given on at once.
ROWS = 2048

WITNESS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` if missing, else its length in bytes, ``:``, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column | str) -> Column:
    return F.sha2(F.concat(*[field(F.col(f) if isinstance(f, str) else f) for f in fields]).cast("binary"), 256)


def siblings(witness: Column) -> Column:
    """The digests of a witness, level by level and left to right, as one text."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["left"], w["right"])), "")


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness lead to."""
    return F.aggregate(witness, leaf, lambda node, w: F.sha2(F.concat(w["left"], node, w["right"]).cast("binary"), 256))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Frontier:
    """A growing tree: the open run of each level, and the witness of every leaf as far as it is known."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.open: list[list[tuple[str, int, int]]] = []  # per level: (digest, first leaf, leaf after the last)
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        n = len(self.witnesses)
        self.witnesses.append([])
        self._place(0, (leaf, n, n + 1))

    def _place(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == self.fanout:
            self._join(level)

    def _join(self, level: int) -> None:
        """The run of a level becomes a node of the next, and its siblings part of the witnesses below."""
        run, self.open[level] = self.open[level], []
        digests = [node[0] for node in run]
        for k, (_, first, end) in enumerate(run):
            step = ("".join(digests[:k]), "".join(digests[k + 1:]))
            for witness in self.witnesses[first:end]:
                witness.append(step)
        self._place(level + 1, (digest(digests), run[0][1], run[-1][2]))

    def close(self, levels: int) -> str:
        """Join what is open up to a level, shorter runs too; the node of that level."""
        for level in range(levels):
            if self.open[level]:
                self._join(level)
        return self.open[levels][0][0]


def _levels(total: int, fanout: int, height: int) -> int:
    """Levels that a block's tree has when its group has ``total`` nodes."""
    levels, nodes = 0, total
    while nodes > 1 and levels < height:
        levels, nodes = levels + 1, -(-nodes // fanout)
    return levels


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows ordered by their first two columns, group and block, one block at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = [table.column(k).to_numpy() for k in range(2)]
        new = np.flatnonzero(reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])) + 1
        first = tuple(int(k[0]) for k in keys)
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        last = tuple(int(k[-1]) for k in keys)
        edges = [0, *new.tolist(), table.num_rows]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            held.append(table.slice(a, z - a))
            if z < table.num_rows:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


def _append(leaves: pa.Table, fanout: int, height: int) -> tuple[Frontier, str]:
    tree = Frontier(fanout)
    for leaf in leaves["digest"].to_pylist():
        tree.append(leaf)
    return tree, tree.close(_levels(leaves["total"][0].as_py(), fanout, height))


def _block_roots(batches: Iterator[pa.RecordBatch], fanout: int, height: int) -> Iterator[pa.RecordBatch]:
    size = fanout ** height
    for block in _runs(batches):
        _, root = _append(block, fanout, height)
        yield pa.RecordBatch.from_pydict({
            "grp": [block["grp"][0].as_py()], "pos": [block["block"][0].as_py()],
            "total": [-(-block["total"][0].as_py() // size)], "digest": [root]},
            schema=pa.schema({"grp": pa.int64(), "pos": pa.int64(), "total": pa.int64(), "digest": pa.string()}))


def _extended(batches: Iterator[pa.RecordBatch], names: list[str], fanout: int, height: int) -> Iterator[pa.RecordBatch]:
    """Witnesses of a block's leaves, each ended by the witness of the block, which is its first row."""
    tables: list[pa.Table] = []
    offsets, left, right, subroots = [0], [], [], []

    def give() -> pa.RecordBatch:
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        rows = pa.concat_tables(tables).combine_chunks()
        out = pa.RecordBatch.from_arrays(
            [*[pa.concat_arrays(rows[c].chunks) for c in names],
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs), pa.array(subroots, pa.string())],
            [*names, "witness", "subroot"])
        for held in (tables, left, right, subroots):
            held.clear()
        offsets[:] = [0]
        return out

    for block in _runs(batches):
        head, leaves = block.slice(0, 1), block.slice(1)
        above = [(w["left"], w["right"]) for w in head["upper"][0].as_py()]
        tree, _ = _append(leaves, fanout, height)
        for start in range(0, leaves.num_rows, ROWS):
            part = tree.witnesses[start:start + ROWS]
            tables.append(leaves.slice(start, len(part)).select(names))
            for own in part:
                left += [w[0] for w in own] + [w[0] for w in above]
                right += [w[1] for w in own] + [w[1] for w in above]
                offsets.append(len(left))
            subroots += [head["subroot"][0].as_py()] * len(part)
            if len(subroots) >= ROWS:
                yield give()
    if subroots:
        yield give()


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _climb(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """The nodes (grp, pos, total, digest) of all rounds; a group ends in the round in which it has one node."""
    rounds = [nodes]
    while True:
        several = rounds[-1].filter("total > 1")
        if several.isEmpty():
            return rounds
        cut = several.select("grp", F.expr(f"pos div {fanout ** height}").alias("block"), "pos", "total", "digest")
        rounds.append(settle(_dealt(cut).mapInArrow(
            lambda batches: _block_roots(batches, fanout, height), "grp bigint, pos bigint, total bigint, digest string"),
            "block-roots"))


def _descend(rounds: list[DataFrame], tops: DataFrame, fanout: int, height: int) -> DataFrame:
    """The nodes of the first round with their witnesses; ``tops`` has (grp, round, upper, subroot) of each group's end."""
    above = None
    for k in reversed(range(len(rounds))):
        nodes = rounds[k]
        passed = [c for c in nodes.columns if c not in ("total", "digest")] if k == 0 else ["grp", "pos"]
        heads = tops.filter(F.col("round") == k).select("grp", F.lit(0).cast("bigint").alias("block"), "upper", "subroot")
        if above is not None:
            heads = heads.unionByName(above.select("grp", F.col("pos").alias("block"), F.col("witness").alias("upper"), "subroot"))
        heads = heads.select("grp", "block", F.lit(-1).cast("bigint").alias("pos"), "upper", "subroot")
        cut = nodes.withColumn("block", F.expr(f"pos div {fanout ** height}"))
        rows = cut.unionByName(heads, allowMissingColumns=True)
        front = ["grp", "block", "pos"]
        rows = _dealt(rows.select(*front, *[F.col(f"`{c}`") for c in rows.columns if c not in front]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (nodes.schema[c] for c in passed))
        above = rows.mapInArrow(
            lambda batches, passed=passed: _extended(batches, passed, fanout, height),
            f"{schema}, witness {WITNESS}, subroot string")
        if k:
            above = settle(above, "witnesses")
    return above


def build_manifest(leaves: DataFrame, group_col: str = "source", order_col: str = "doc_id", fanout: int = FANOUT,
                   height: int = HEIGHT) -> DataFrame:
    """Rows with a ``leaf``, and with ``witness`` (to the root), ``subroot`` (of their group) and ``root``.

    Groups are ordered by ``group_col``, leaves in them by ``order_col`` and then by ``leaf``.
    """
    names = [c for c in leaves.columns if c not in ("witness", "subroot", "root")]
    own = {c: f"own_{i}" for i, c in enumerate(names)}
    packed = settle(leaves.select(*[F.col(f"`{c}`").alias(own[c]) for c in names]), "leaves")
    group, leaf = own[group_col], own["leaf"]
    placed = row_positions(packed, group, own[order_col], leaf, position="at")
    groups = settle(placed.groupBy(group).agg(F.min("at").alias("grp"), F.count("*").alias("total")), "groups")
    joined = placed.join(groups.withColumnRenamed(group, "group"), placed[group].eqNullSafe(F.col("group")))
    nodes = settle(joined.select("grp", (F.col("at") - F.col("grp")).alias("pos"), "total", F.col(leaf).alias("digest"),
                                 *own.values()), "nodes")

    rounds = _climb(nodes, fanout, height)
    ends = reduce(DataFrame.unionByName, [
        n.filter("total = 1").select("grp", "digest", F.lit(k).alias("round")) for k, n in enumerate(rounds)])
    ends = settle(ends, "subroots")
    n_groups = ends.count()
    sources = row_positions(ends, "grp", position="at").select(
        F.lit(0).cast("bigint").alias("grp"), F.col("at").alias("pos"), F.lit(n_groups).cast("bigint").alias("total"),
        "digest", F.col("grp").alias("member"), "round")
    upper = _climb(settle(sources, "sources"), fanout, height)
    root = upper[-1].filter("total = 1").first()
    if root is None:
        return leaves.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast(WITNESS).alias("witness"),
                             F.lit("").alias("subroot"), F.lit("").alias("root"))
    spark = leaves.sparkSession
    top = spark.range(1).select(
        F.lit(0).cast("bigint").alias("grp"), F.lit(len(upper) - 1).alias("round"),
        F.array().cast(WITNESS).alias("upper"), F.lit("").alias("subroot"))
    sourced = settle(_descend(upper, top, fanout, height), "source-witnesses")
    tops = sourced.select(F.col("member").alias("grp"), "round", F.col("witness").alias("upper")).join(
        ends.select("grp", F.col("digest").alias("subroot")), "grp")
    found = _descend(rounds, settle(tops, "tops"), fanout, height)
    return found.select(*[F.col(own[c]).alias(c) for c in names], "witness", "subroot", F.lit(root["digest"]).alias("root"))
