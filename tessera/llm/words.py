"""Words of whole Arrow string columns as numpy arrays.

A column is one run of UTF-8 bytes, so words are found and hashed for all of its rows at once.  Word hashes are multilinear:
each byte, plus one, times an odd random number of its place in the word, summed modulo 2**64 and mixed with the length.  Two different
words share a hash with a probability of about 2**-57.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLACES = 4096
CHUNK_BYTES = 2 << 20  # numpy temporaries are some dozen times this size

SPACE = np.zeros(256, bool)  # white space of the contracts: \x20 and \x09-\x0D
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()  # A-Z to a-z, every other byte as it is
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd(n: int, seed: int) -> np.ndarray:
    """n fixed odd random numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACE = odd(PLACES, 1)


@dataclass
class Words:
    """Words of some rows: bytes, byte ranges of the words, and the number of the first word of each row (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def hashes(self) -> np.ndarray:
        lengths = self.ends - self.starts
        if not len(lengths):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        letters = self.data[place + np.repeat(self.starts, lengths)].astype(np.uint64) + np.uint64(1)
        if lengths.max() > PLACES:
            factor = np.where(place < PLACES, _PLACE[place % PLACES], mix(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1))
        else:
            factor = _PLACE[place]
        return mix(np.add.reduceat(letters * factor, begin) + lengths.astype(np.uint64))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1] if ends else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE, fold: np.ndarray = PLAIN) -> Words:
    """Longest runs of bytes outside ``gaps`` inside each row; ``fold`` maps bytes, one to one."""
    inside = np.concatenate(([False], ~gaps[data], [False]))
    cut = np.zeros(len(data) + 1, bool)  # a word also ends where its row ends
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut) & np.concatenate((inside[1:-1], [False])))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return Words(data if fold is PLAIN else fold[data], starts, ends, np.searchsorted(starts, offsets), offsets)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``limit`` bytes together (a longer row comes alone): first row, end row, bytes, offsets."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive numbers (len - width + 1 of them), by fixed odd factors per place."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, k in enumerate(odd(width, 2)):
        out += hashes[j:j + n] * k
    return mix(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all at the end."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists of the given lengths over one run of values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, kind))
