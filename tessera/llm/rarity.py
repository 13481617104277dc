"""How often words occur in a whole corpus, in a table of fixed size.

Words share counters by their hash, so a counter is never below the true count of its words.  The table serves to order words from rare to
frequent and to tell which can be frequent; results never depend on a count being exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BITS = 18  # 262,144 counters: 2 MB, whatever the size of the corpus
SLICE = 4096
HOLD = 1 << 20  # words that are counted together


def slot(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def count_words(texts: DataFrame, fold: np.ndarray = W.PLAIN, bits: int = BITS) -> np.ndarray:
    """Counters of all words of the one string column of ``texts``."""

    def hashes(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in W.chunks(column):
            yield W.find_words(data, offsets, fold=fold).hashes()

    return count_hashes(texts, hashes, bits)


def count_hashes(texts: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]], bits: int = BITS) -> np.ndarray:
    """Counters of the hashes that ``hashes`` finds in the one column of ``texts``.

    Each task adds up its rows and sends the table in slices; a slice is added up where it arrives, one batch at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = np.zeros(1 << bits, np.int64), [], 0

        def add_held() -> None:
            table[:] += np.bincount(np.concatenate(held), minlength=1 << bits)
            held.clear()

        for batch in batches:
            for found in hashes(batch.column(0)):
                held.append(slot(found, bits))
                size += len(held[-1])
                if size > HOLD:
                    add_held()
                    size = 0
        if held:
            add_held()
        parts = table.reshape(-1, min(SLICE, 1 << bits))
        used = np.flatnonzero(parts.any(axis=1))
        packed = [zstandard.compress(parts[i].tobytes(), 1) for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(packed, pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zstandard.decompress(counts), np.int64)
                sums[i] = sums[i] + got if i in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    shape = "slice int, counts binary"
    got = texts.mapInArrow(count, shape).repartition("slice").mapInArrow(add, shape).collect()
    table = np.zeros((max(1, (1 << bits) // SLICE), min(SLICE, 1 << bits)), np.int64)
    for row in got:
        table[row["slice"]] += np.frombuffer(row["counts"], np.int64)
    return table.reshape(-1)
