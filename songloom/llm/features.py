"""Hashed n-grams of bytes as features of linear models, for many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songloom.llm.words import LOWER, blocks, give_back

_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def letters(data: np.ndarray) -> np.ndarray:
    """Lower case, everything in ASCII that is no letter as a space."""
    out = LOWER[data]
    out[(out < 0x61) | (out > 0x7A) & (out < 0x80)] = 0x20
    # The capital letters of Latin-1 as UTF-8.
    high = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    capital = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
    out[capital] += 0x20
    return out


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 0x41, 0x61, 0x30, 0x61


def shape(data: np.ndarray) -> np.ndarray:
    """Letters as one of two, digits as one, the rest as it is."""
    return _SHAPE[data]


def raw(data: np.ndarray) -> np.ndarray:
    return data


@dataclass(frozen=True)
class Grams:
    """One table of n-grams: how bytes are seen, how many meet, and in how many slots they fall."""

    view: Callable[[np.ndarray], np.ndarray]
    order: int
    slots: int

    def slot(self, data: np.ndarray) -> np.ndarray:
        """Slot of the n-gram that starts at each byte; the last ``order - 1`` are not used."""
        seen = self.view(data).astype(np.uint32)
        key = np.zeros(len(seen), np.uint32)
        for k in range(self.order):
            key[:len(seen) - k] += seen[k:] * np.uint32(_FACTORS[k])
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        return (key >> np.uint32(12)) & np.uint32(self.slots - 1)


def _unused(bounds: np.ndarray, order: int) -> np.ndarray:
    """Starts from which an n-gram would reach over the end of its text."""
    ends = bounds[1:, None] - np.arange(1, order)
    return ends[ends >= bounds[:-1, None]]


def frequencies(texts: list[bytes], tables: tuple[Grams, ...]) -> np.ndarray:
    """Share of each n-gram in each text, one row per text."""
    out = np.zeros((len(texts), sum(t.slots for t in tables)), np.float32)
    for i, text in enumerate(texts):
        data, at = np.frombuffer(text, np.uint8), 0
        for t in tables:
            n = len(data) - t.order + 1
            if n > 0:
                out[i, at:at + t.slots] = np.bincount(t.slot(data)[:n], minlength=t.slots) / n
            at += t.slots
    return out


def products(data: np.ndarray, bounds: np.ndarray, tables: tuple[Grams, ...], weights: np.ndarray) -> np.ndarray:
    """``frequencies`` times ``weights`` (a column per model) without making the frequencies."""
    out = np.zeros((len(bounds) - 1, weights.shape[1]))
    sums, at = np.zeros(len(data) + 1), 0
    for t in tables:
        slot, skip = t.slot(data), _unused(bounds, t.order)
        n = np.maximum(np.diff(bounds) - t.order + 1, 1)
        for k in range(weights.shape[1]):
            value = weights[at:at + t.slots, k].astype(np.float32)[slot]
            value[skip] = 0
            np.cumsum(value, out=sums[1:], dtype=np.float64)
            out[:, k] += (sums[bounds[1:]] - sums[bounds[:-1]]) / n
        at += t.slots
    return out


def add_columns(df: DataFrame, text_col: str, new: dict[str, T.DataType],
                work: Callable[[pa.Array, np.ndarray, np.ndarray], dict[str, pa.Array]]) -> DataFrame:
    """Add columns that ``work`` makes from the texts, run of rows by run of rows.

    ``work`` gets a run's texts, their bytes and the start of each in them. All other columns are
    passed on; those of a new column's name are replaced.
    """
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, kind) for c, kind in new.items()])
    place, names = kept.index(text_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in blocks(batch.column(place)):
                part = batch.slice(first, end - first)
                made = work(part.column(place), data, bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, *[made[c] for c in new]], names)
        give_back()

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
