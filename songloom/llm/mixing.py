"""Mixing sources to target weights with pivotal dependent rounding.

Each source has a target in words; a document of it is wanted target / source size times. The
whole part is taken for certain. The rest is a copy probability that pivotal rounding makes 0
or 1: two fractional documents meet, words move from one to the other in a random direction
until one of them is whole, and the other goes on. Expected words stay as they were, and so
does their sum, but for the last document of a source.

Rounding starts in buckets of about ``BUCKET`` documents of a source (by hash of the id, or of
the text where that is missing, so a rerun meets the same pairs), each of which leaves one fractional document at most. Those
residuals are combined ``FAN_IN`` buckets at a time, level by level, up to one per source.

Defined results: a missing or empty text has no words and is taken target-many times rounded
down, which takes no words; a missing source is a source of its own, the last one; each
repeated row is a document of its own; an empty table gives an empty result. Other columns are
not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.session import settle

# Weights of the sources in order of their names, over and over, and the most
# often that a source is taken.
WEIGHTS = (5, 2, 1)
MOST = 3

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 4096
FAN_IN = 64
# A document with more than one part in this many of the words after it in its bucket is large.
LARGE = 100
SEED = 7


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, n_docs, target (words).

    Works on a table with a row per source; what comes to the driver is a row per partition of
    it and the sums of each round.
    """
    sources = settle(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
        .orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for row in sources.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets += [F.lit(row["part"]), F.lit(before)]
        before += row["count"]
    position = F.element_at(F.create_map(*offsets), part) + inside if offsets else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    weighted = sources.select("source", "source_size", "n_docs", weight.alias("weight"))

    cap = most * F.col("source_size")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        # Words per unit of weight for the sources that are not at their limit.
        at_limit = cap <= F.col("weight") * level
        n, taken, rest = weighted.agg(
            F.count(F.when(at_limit, 1)), F.coalesce(F.sum(F.when(at_limit, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        level, capped = (total - taken) / rest, n
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return weighted.select("source", "source_size", "n_docs", target.alias("target"))


def pivot(sizes: np.ndarray, p: np.ndarray, draws: np.ndarray) -> int:
    """Round the probabilities in place, in the order given; which one is left fractional, or -1."""
    left = -1
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        if left < 0:
            left = i
            continue
        a, b = sizes[left], sizes[i]
        # Words that can move to the document left over, and from it.
        room_a, held_b = a * (1.0 - p[left]), b * p[i]
        held_a, room_b = a * p[left], b * (1.0 - p[i])
        to, off = min(room_a, held_b), min(held_a, room_b)
        if draws[i] * (to + off) < off:
            p_a, p_b = (1.0, p[i] - to / b) if room_a <= held_b else (p[left] + to / a, 0.0)
            both = room_a == held_b
        else:
            p_a, p_b = (0.0, p[i] + off / b) if held_a <= room_b else (p[left] - off / a, 1.0)
            both = held_a == room_b
        if both:
            p_a, p_b = float(p_a >= 0.5), float(p_b >= 0.5)
        p[left], p[i] = p_a, p_b
        if 0.0 < p_b < 1.0:
            left = i
        elif not 0.0 < p_a < 1.0:
            left = -1
    return left


def settle_large(sizes: np.ndarray, p: np.ndarray, draws: np.ndarray) -> None:
    """Round the documents that weigh much in their bucket against all smaller ones together.

    A large document that meets small ones one by one outlasts them and would be left over. Here
    it meets them as a pool, whose words all grow or shrink in proportion. All probabilities must
    be equal; sizes are descending. Expected words stay as they were.
    """
    pool = float(sizes.sum())
    for i in range(len(p) - 1):
        a = float(sizes[i])
        pool -= a
        q = float(p[i + 1])
        to, off = a * (1.0 - q), a * q
        if a * LARGE < pool or not 0.0 < q < 1.0 or to >= pool * q or off >= pool * (1.0 - q):
            break
        p[i] = float(draws[i] < q)
        p[i + 1:] = q - to / pool if p[i] else q + off / pool


def _rounding(level: int, root: bool) -> Callable[[pa.Table], pa.Table]:
    """Pivotal rounding within one bucket; at the root, what is left goes to the nearer number."""
    def work(table: pa.Table) -> pa.Table:
        # Large documents first: the one left over is then among the small.
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("mark", "ascending")])
        p = table["p"].to_numpy().copy()
        name = table["source"][0].as_py()
        seed = [SEED, level, zlib.crc32(repr(name).encode()), int(table["bucket"][0].as_py())]
        sizes, draws = table["size"].to_numpy().astype(float), np.random.default_rng(seed).random((2, len(p)))
        if level == 0 and (some := int((p > 0).sum())):
            settle_large(sizes[:some], p[:some], draws[0])  # documents without words stand last, at 0
        left = pivot(sizes, p, draws[1])
        if root and left >= 0:
            p[left] = round(p[left])
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return work


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key_col: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source) and copies.

    A column ``key_col`` that tells rows apart is passed on as ``key``.
    """
    key = [] if key_col is None else ["key"]
    sized = settle(documents.select(
        *[F.col(key_col).alias(k) for k in key], F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.xxhash64(text_col).alias("mark"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint").alias("size")), "sizes")
    targets = settle(source_targets(sized, weights, most), "targets")
    wanted = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    buckets = F.ceil(F.col("n_docs") / BUCKET)
    largest = targets.agg(F.max(buckets)).first()[0] or 1
    rows = (
        sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("whole", F.floor(wanted).cast("int"))
        .withColumn("p", F.when(F.col("size") > 0, wanted - F.floor(wanted)).otherwise(0.0))
        .withColumn("bucket", F.pmod(F.when(F.col("doc_id").isNull(), F.col("mark")).otherwise(F.xxhash64("doc_id")), buckets))
        .select(*key, "doc_id", "mark", "source", "size", "source_size", "target", "whole", "p", "bucket"))

    schema, done, level = rows.schema, None, 0
    while True:
        root = largest <= 1
        rounded = settle(
            rows.groupBy("source", "bucket").applyInArrow(_rounding(level, root), schema), f"rounded{level}")
        whole = rounded.filter((F.col("p") <= 0) | (F.col("p") >= 1))
        done = whole if done is None else done.unionAll(whole)
        if root:
            break
        rows = rounded.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn(
            "bucket", F.floor(F.col("bucket") / FAN_IN))
        largest, level = -(-largest // FAN_IN), level + 1
    return done.select(*key, "doc_id", "source", "size", "source_size", "target",
                       (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def repeat_documents(documents: DataFrame, mixed: DataFrame, id_col: str = "doc_id",
                     key_col: str | None = None) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.

    With a ``key_col``, as given to :func:`mix`, each row has its own decision. Without, rows that
    share an id share the decision for the shortest of them.
    """
    taken = mixed.filter("copies > 0")
    if key_col is None:
        copies = taken.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by("copies", "size").alias("_copies"))
        joined = documents.join(copies, F.col(id_col).eqNullSafe(F.col("_id")))
    else:
        copies = taken.select(F.col("key").alias("_id"), F.col("copies").alias("_copies"))
        joined = documents.join(copies, F.col(key_col) == F.col("_id"))
    columns = [documents[c] for c in documents.columns]
    return joined.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).drop("_copy")
