"""Vectorised word fingerprints over Arrow string columns, and the Spark expressions shared by operators.

A word is a run of ``[^\\x20\\x09-\\x0D]``. A word's fingerprint is a 64-bit polynomial of its UTF-8
bytes, taken from prefix sums, so a batch of texts is hashed without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes hashed at once; a longer text is hashed in several pieces cut at white space.
PIECE = 1 << 18

_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    found = _powers.get((base, size))
    if found is None:
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        found = _powers[(base, size)] = (both[0], both[1])
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, np.int64)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (with the end)."""
    inside = np.empty(len(raw) + 1, bool)
    np.logical_not(SPACE[raw], out=inside[:-1])
    inside[-1] = False
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (border | ~before))
    ends = np.flatnonzero(before & (border | ~inside))
    return starts, ends, np.searchsorted(starts, offsets)


def fingerprints(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit value for every word, from its bytes alone."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        lo, hi = int(starts[first]), int(ends[last - 1])
        power, inverse = _tables(base, PIECE) if hi - lo <= PIECE else _tables(base, hi - lo)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        terms = raw[lo:hi].astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: hi - lo]
        np.cumsum(terms, out=sums[1:])
        a, b = starts[first:last] - lo, ends[first:last] - lo
        out[first:last] = (sums[b] - sums[a]) * inverse[a]
        first = last
    for key in [k for k in _powers if k[1] > PIECE]:
        del _powers[key]
    return mix(out)


def second_fingerprints(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """An independent value, to tell words apart that share the first one."""
    return fingerprints(raw, starts, ends, _BASE2)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of ``k`` words of one text; a shorter text is one run."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        out = mix(out + np.uint64((0x632BE59BD9B4E019 * i) & _MASK)) + words[i : len(words) - k + 1 + i]
    return mix(out ^ np.uint64(k))


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold about ``size`` bytes (one text at least).

    Arrays over the words of a piece take some thirty times its bytes, in each of a node's tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
