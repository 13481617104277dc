"""Benchmark decontamination: one Aho-Corasick automaton over the words of test items, each text scanned once.

Text and items are normalised alike: A-Z in lower case, all other ASCII but a-z and 0-9 is a gap.  Both steps map byte to byte, so a word of the
normalised text has its place in the original.  The automaton holds each window with a gap at either end, so it matches whole words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
MAX_ITEM_BYTES = 256 << 20  # the item texts are held by every Python worker

_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
FOLD = bytes(_FOLD)


def fold(text: str | None) -> bytes:
    """Normalised bytes, as many as the UTF-8 of the text."""
    return (text or "").encode("utf-8", "replace").translate(FOLD)


def automaton(items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[ahocorasick.Automaton, list[list[int]]]:
    """Automaton whose values are (number of the window, its words), and the places in ``items`` of the items of each window."""
    numbers: dict[bytes, int] = {}
    owners: list[list[int]] = []
    found = ahocorasick.Automaton()
    for place, (_, text) in enumerate(items):
        words = fold(text).split()
        for at in range(max(1, len(words) - window + 1) if words else 0):
            part = words[at:at + window]
            key = b" " + b" ".join(part) + b" "
            number = numbers.setdefault(key, len(owners))
            if number == len(owners):
                owners.append([])
                found.add_word(key.decode("latin-1"), (number, len(part)))
            if not owners[number] or owners[number][-1] != place:
                owners[number].append(place)
    if owners:
        found.make_automaton()
    return found, owners


_HELD: dict[int, tuple] = {}  # the automaton of the broadcast in use, once for each Python worker


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_words, n_hit, items, spans) for each document, and the columns named in ``carry``.

    A window is ``window`` consecutive words of an item, or all words of an item that has fewer but not none.  ``n_hit`` counts the words of the
    document inside any occurrence of a window, ``items`` lists the keys, as strings in string order, of the items with occurring windows, and
    ``spans`` are the hit stretches of the original text in code points, end exclusive.

    Null and empty texts have no words, null or wordless items no windows.  Items that share a key count once; a null item key is listed as
    ``null``.  Repeated documents each get their row; further columns are ignored.  The items' size is checked before they are collected: a
    benchmark of over ``max_item_bytes`` is refused, and can be passed in parts.
    """
    items = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_item_bytes:
        raise ValueError(f"the items have {size} bytes; pass them in parts of at most {max_item_bytes}")
    listed = docs.sparkSession.sparkContext.broadcast(sorted(("null" if r["item"] is None else r["item"], r["text"] or "") for r in items.toLocalIterator()))

    names = [f"carried{i}" for i in range(len(carry))]
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_names = [k for k, _ in listed.value]
        if id(listed.value) not in _HELD:
            _HELD.clear()
            _HELD[id(listed.value)] = (*automaton(listed.value, window), listed.value)
        machine, owners, _ = _HELD[id(listed.value)]
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_hit": [], "items": [], "spans": []}
            for value in batch.column(1):
                flat = fold(value.as_py())
                words = flat.split()
                line = b" " + b" ".join(words) + b" "
                found = list(machine.iter(line.decode("latin-1"))) if owners else []
                n_hit, spans, seen = 0, [], set()
                if found:
                    n_hit, spans = _spans(value.as_py(), flat, line, found, len(words))
                    seen = {item_names[i] for number in {x[1][0] for x in found} for i in owners[number]}
                for name, x in zip(out, (len(words), n_hit, sorted(seen), spans)):
                    out[name].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())),
                                              pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["key", *names, *out])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    shape = T.StructType([T.StructField("key", slim.schema["key"].dataType), *slim.schema.fields[2:], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                          T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    return slim.mapInArrow(scan, shape).toDF(key, *carry, "n_words", "n_hit", "items", "spans")


def _spans(text: str, flat: bytes, line: bytes, found: list, n: int) -> tuple[int, list[dict]]:
    """Number of hit words, and their stretches in code points of the original text."""
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)  # gap i stands before word i
    last = np.searchsorted(gaps, np.array([end for end, _ in found]))  # the gap behind the last word
    first = last - np.array([size for _, (_, size) in found])
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last, -1)
    hit = np.cumsum(cover)[:n] > 0
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    whole = np.frombuffer(flat, np.uint8)
    inside = np.concatenate(([0], (whole != 0x20).astype(np.int8), [0]))
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    place = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80)))
    return int(hit.sum()), [{"start": int(place[starts[a]]), "end": int(place[ends[b - 1]])} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
