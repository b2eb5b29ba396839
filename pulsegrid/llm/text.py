"""Array helpers shared by the text operators.

Every helper works on a run of documents laid end to end in one byte array, with
``offsets`` marking where each document starts.  Runs are kept to a quarter of a megabyte
so the 8-byte work arrays stay small whatever the Arrow batch holds; a document
longer than that forms a run of its own.  Python workers are reused, and keep as free
memory most of what a run once took: it counts for all later steps as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

RUN_BYTES = 1 << 18
#: Words of a longer text are hashed in stretches of about so many bytes.
STRETCH_BYTES = 4 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it can be inverted modulo 2**64
_BYTE_VALUES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def raw_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents holding at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def in_runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices, each with a run of texts in ``column``; so
    neither copies of the texts nor the batches that are given back grow with a batch."""
    for batch in batches:
        for i, j in runs(raw_strings(batch.column(column))[1]):
            yield batch.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, RUN_BYTES + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any spans of a sequence of 64-bit symbols, from prefix sums.

    ``h(a, b)`` depends on the symbols in [a, b) alone, not on where they stand.
    """

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _powers(len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * power[:-1], dtype=np.uint64, out=self.prefix[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Rolling:
        return cls(_BYTE_VALUES[data])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * _MULT)

    def grams(self, k: int) -> np.ndarray:
        """Hash of every span of k symbols."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n] + np.uint64(k * int(_MULT) & (1 << 64) - 1))


def fold(symbols: np.ndarray, seed: int) -> np.ndarray:
    """Independent second hash of 64-bit values."""
    return mix(symbols * np.uint64(0xA0761D6478BD642F) + np.uint64(seed))


def owners(offsets: np.ndarray) -> np.ndarray:
    """Document number of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


#: Letters, digits and every byte of a multi-byte character belong to words.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and stops of the runs of bytes that are ``inside`` words.  A run never
    crosses into the next document."""
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    held = np.diff(offsets) > 0
    before[offsets[:-1][held]] = False
    after[offsets[1:][held] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, stretch: int = STRETCH_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of A-Z-lowered texts: byte starts, byte stops, 64-bit hashes and word
    offsets by document.  A word never crosses into the next document."""
    low = LOWER[data]
    starts, stops = bounds(WORD_BYTE[low], offsets)
    hashes, k = np.zeros(len(starts), np.uint64), 0
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(stops, starts[k] + stretch, "right")))
        hashes[k:j] = Rolling.of_bytes(low[starts[k] : stops[j - 1]]).spans(starts[k:j] - starts[k], stops[k:j] - starts[k])
        k = j
    return starts, stops, hashes, np.searchsorted(starts, offsets, "left")


def spread_over(text: Column, most: int, pieces: int = 8) -> Column:
    """A text of up to ``most`` characters as it is; of a longer one ``pieces`` equal
    pieces spread evenly from its start to its end, ``most`` characters in all."""
    size, piece = F.length(text), most // pieces
    parts = [F.substring(text, (F.lit(1) + F.floor((size - piece) * k / (pieces - 1))).cast("int"), F.lit(piece)) for k in range(pieces)]
    return F.when(size > most, F.concat(*parts)).otherwise(text)
