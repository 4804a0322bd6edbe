"""Words of many texts at once: positions and 64-bit hashes as numpy arrays.

Texts are handled as UTF-8 bytes. Every word pattern here is decided byte by byte (ASCII
separators never occur inside a longer character), so one table of 256 flags finds the
words of a whole block of documents without a loop over them.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
# Bytes or hashes that are summed up at once.
SUMMED = 1 << 20

# [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        step = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        step[0] = 1
        known = np.multiply.accumulate(step)
        if n <= 2 * SUMMED:  # more are needed for a very long word only
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into runs of rows of about ``limit`` bytes (one row at least).

    Gives (first row, end row, bytes of the run, start of each row and the end in them).
    A missing text is an empty one.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield first, end, flat[ends[first]:ends[end]], ends[first:end + 1] - ends[first]
        first = end


@dataclass
class Words:
    """Words of a run of documents, in order."""

    data: np.ndarray    # bytes, lower-cased if asked for
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray    # byte after each word
    bounds: np.ndarray  # words before each document, and all words

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word: the sum of its bytes' numbers times powers of a base.

        Words are summed up in stretches of about ``SUMMED`` bytes (one word at least).
        """
        out, first = np.empty(len(self.starts), np.uint64), 0
        while first < len(out):
            at = int(self.starts[first])
            last = max(first + 1, int(np.searchsorted(self.ends, at + SUMMED, "right")))
            n = int(self.ends[last - 1]) - at
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data[at:at + n]] * powers(_BASE, n), out=total[1:])
            starts, ends = self.starts[first:last] - at, self.ends[first:last] - at
            # Divided by the power at the word's start, so that equal words agree wherever they stand.
            out[first:last] = mix((total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts])
            first = last
        return out

    def rows(self) -> np.ndarray:
        """Document (row of the run) of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def find_words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes that ``kind`` marks, none reaching over the end of a document."""
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    stop = inside[:-1] & ~inside[1:]
    stop[cut - 1] = inside[cut - 1]
    ends = np.flatnonzero(stop) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` hashes that start at each place (places too near the end left out).

    Those that reach over the end of a document are for the caller to skip.
    """
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, SUMMED):
        z = min(n, a + SUMMED)
        part = hashes[a:z + length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_BASE, len(part)), out=total[1:])
        out[a:z] = mix((total[length:] - total[:z - a]) * powers(_INVERSE, z - a))
    return out


def give_back() -> None:
    """Return memory that is no longer used to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
