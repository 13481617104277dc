"""Membership of 64-bit names in a table of fixed size, to leave out early what a later join would drop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

BITS = 25  # 4 MB, whatever the number of names; more names only let more through


def place(names: np.ndarray) -> np.ndarray:
    return (W.mix(names.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def table_of(names: DataFrame) -> np.ndarray:
    """Packed bits of the long columns of ``names``: a name whose bit is not set is not among them."""
    slice_bytes = 1 << 15

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            for column in batch.columns:
                bits[place(column.to_numpy())] = True
        parts = np.packbits(bits).reshape(-1, slice_bytes)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["slice", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(bits, np.uint8)
                sums[i] = sums[i] | got if i in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "bits"])

    shape = "slice int, bits binary"
    table = np.zeros(((1 << BITS) // 8 // slice_bytes, slice_bytes), np.uint8)
    for row in names.mapInArrow(mark, shape).repartition("slice").mapInArrow(unite, shape).collect():  # 4 MB at most
        table[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def bits(table: np.ndarray) -> np.ndarray:
    """The table with a bool for each place."""
    return np.unpackbits(table).view(bool)


def has(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names have their bit set, without unpacking the table."""
    at = place(names)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
