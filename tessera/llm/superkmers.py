"""Repeated passages: exact counting of word windows in minimiser buckets.

The minimiser of a window is its rarest word.  Consecutive windows with the same minimiser (a super-k-mer) travel as one piece of text to the
bucket of the minimiser, so that each window is counted in one place while the text is sent little more than twice.  Equal windows have
equal minimisers, so they meet; in the bucket, sorting brings them together and all of their words are compared.

Windows made of frequent words only (a passage copied into a large part of the corpus) would overfill a bucket.  Runs of them are named by their
words; equal runs are combined before the shuffle, and only the windows of different runs are compared, as a grouped minimum that is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rarity
from . import words as W
from .store import store

WINDOW = 13
BUCKET_WORDS = 400_000  # words of the corpus for each bucket
FLUSH = 24 << 20  # bytes of text that a task gathers before it packs
LONGEST = 256  # windows in one super-k-mer; longer runs are sent in pieces
HOT = 2_000  # a minimiser counted more often than this, and than 8 times the mean counter, is not packed


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[:have - width], x[width - have:])


def _windows(found: W.Words, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and of each window that lies in one row: first word and minimiser (count in the upper, hash in the lower half)."""
    hashes = found.hashes()
    if len(hashes) < width:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    order = np.minimum(counts[rarity.slot(hashes)], 0x7FFFFFFF).astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
    rows = found.rows()
    at = np.flatnonzero(rows[:len(rows) - width + 1] == rows[width - 1:])
    return hashes, at, _sliding_min(order, width)[at]


def _cut(at: np.ndarray, least: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places (in ``at``) and window counts of the super-k-mers."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (rows[at[1:]] != rows[at[:-1]])
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(since % LONGEST == 0)
    return first, np.diff(np.append(first, len(at)))


_FIELDS = (("doc", np.int64), ("tag", np.int64), ("start", np.int64), ("size", np.int64))


def _pack(rows: dict[str, np.ndarray], pieces: list[bytes]) -> bytes:
    head = b"".join(rows[name].astype(kind).tobytes() for name, kind in _FIELDS)
    return zstandard.compress(head + b"".join(pieces), 3)


def _unpack(n: int, packed: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    rows = {name: raw[i * n * 8:(i + 1) * n * 8].view(kind) for i, (name, kind) in enumerate(_FIELDS)}
    return rows, raw[len(_FIELDS) * n * 8:]


def _packer(counts: np.ndarray, hot: int, width: int, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, dict, list[bytes]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            bucket = np.concatenate([x[0] for x in held])
            rows = {k: np.concatenate([x[1][k] for x in held]) for k, _ in _FIELDS}
            pieces = [p for x in held for p in x[2]]
            order = np.argsort(bucket, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
            out, at = ([], [], []), 0
            for end in ends:
                mine = order[at:end]
                out[0].append(int(bucket[mine[0]]))
                out[1].append(len(mine))
                out[2].append(_pack({k: v[mine] for k, v in rows.items()}, [pieces[i] for i in mine.tolist()]))
                at = end
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["bucket", "n", "packed"])

        for batch in batches:
            docs, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, _, data, offsets in W.chunks(batch.column(2)):
                found = W.find_words(data, offsets)
                _, at, least = _windows(found, counts, width)
                cool = (least >> np.uint64(32)) <= hot
                at, least = at[cool], least[cool]
                if not len(at):
                    continue
                rows = found.rows()
                first, n = _cut(at, least, rows)
                begin = at[first]
                a, b = found.starts[begin], found.ends[begin + n + width - 2]
                row = rows[begin]
                whole = data.tobytes()
                held.append(((W.mix(least[first]) % np.uint64(buckets)).astype(np.int64),
                             {"doc": docs[low + row], "tag": tags[low + row], "start": begin - found.first[row], "size": b - a},
                             [whole[x:y] for x, y in zip(a.tolist(), b.tolist())]))
                size += int((b - a).sum())
                if size >= FLUSH:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return pack


def _same_windows(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal windows together, and where each new one begins.  All words are compared, not just the window's hash."""
    key = W.window_hashes(hashes, width)[at]
    order = np.argsort(key)
    here = at[order]

    def new() -> np.ndarray:
        out = np.zeros(len(here), bool)
        out[:1] = True
        for j in range(width):
            out[1:] |= hashes[here[1:] + j] != hashes[here[:-1] + j]
        return out

    begins = new()
    if (begins[1:] & (key[order][1:] == key[order][:-1])).any():  # two windows share a hash: sort by the words themselves
        order = np.lexsort([hashes[at + j] for j in range(width)])
        here = at[order]
        begins = new()
    return order, np.flatnonzero(begins)


_FLAGS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.list_(pa.int32()))])


def _flag_lists(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.Table:
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    first = np.flatnonzero(new)
    lists = W.list_array(at.astype(np.int32), np.diff(np.append(first, len(doc))), pa.int32())
    return pa.Table.from_arrays([pa.array(doc[first]), pa.array(tag[first]), lists], schema=_FLAGS)


def _judge(width: int):
    def judge(group: pa.Table) -> pa.Table:
        parts = [_unpack(n, x) for n, x in zip(group["n"].to_pylist(), group["packed"].to_pylist())]
        rows = {k: np.concatenate([p[0][k] for p in parts]) for k, _ in _FIELDS}
        offsets = np.concatenate(([0], np.cumsum(rows["size"])))
        found = W.find_words(np.concatenate([p[1] for p in parts]), offsets)
        hashes, piece = found.hashes(), found.rows()
        at = np.flatnonzero(piece[:len(piece) - width + 1] == piece[width - 1:])
        order, begins = _same_windows(hashes, at, width)
        doc = rows["doc"][piece[at[order]]]
        least = np.minimum.reduceat(doc, begins)
        later = np.flatnonzero(doc > np.repeat(least, np.diff(np.append(begins, len(doc)))))
        word = at[order[later]]
        mine = piece[word]
        return _flag_lists(doc[later], rows["tag"][mine], rows["start"][mine] + word - found.first[mine])

    return judge


def _hot_runs(counts: np.ndarray, hot: int, width: int):
    """Runs of consecutive windows whose rarest word is frequent: a name for the run's words, where it begins, and its windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, _, data, offsets in W.chunks(batch.column(2)):
                found = W.find_words(data, offsets)
                hashes, at, least = _windows(found, counts, width)
                at = at[(least >> np.uint64(32)) > hot]
                if not len(at):
                    continue
                rows = found.rows()
                first, n = _cut(at, np.zeros(len(at), np.uint64), rows)
                windows = [W.window_hashes(x, width)[at] for x in (hashes, W.mix(hashes))]
                step = np.arange(len(at), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64) + np.uint64(1)
                names = [W.mix(np.add.reduceat(W.mix(w ^ W.mix(step)), first) + n.astype(np.uint64)).view(np.int64) for w in windows]
                begin = at[first]
                row = rows[begin]
                lists = [W.list_array(w.view(np.int64), n, pa.int64()) for w in windows]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (*names, docs[low + row], tags[low + row], (begin - found.first[row]).astype(np.int32))), *lists], ["k1", "k2", "doc", "tag", "start", "w1", "w2"])

    return run


def _hot_flags(runs: DataFrame) -> DataFrame:
    """(doc, tag, at) of the repeated windows among ``runs``.  Equal runs are one row from the first shuffle on, and windows are spread out of those only."""
    names = ["k1", "k2"]
    texts = runs.groupBy(*names).agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.first(F.arrays_zip("w1", "w2")).alias("w"))
    windows = texts.select(*names, "low", "high", F.posexplode("w").alias("step", "w")).select(*names, "low", "high", "step", "w.w1", "w.w2")
    firsts = windows.groupBy("w1", "w2").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most")
    again = windows.join(firsts, ["w1", "w2"]).filter("least < high").groupBy(*names).agg(F.collect_list(F.struct("step", "least")).alias("again"))
    found = runs.select(*names, "doc", "tag", "start").join(again, names)
    at = F.transform(F.filter("again", lambda x: x["least"] < F.col("doc")), lambda x: x["step"] + F.col("start"))
    return found.select("doc", "tag", at.alias("at")).filter(F.size("at") > 0)


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc, tag, at): in which words of a document a window begins that also begins in a document with a smaller id.

    ``docs`` has doc (long, not null), tag (long, tells rows with the same doc apart) and text.
    """
    spark = docs.sparkSession
    counts = rarity.count_words(docs.select("text"))
    total = int(counts.sum())
    hot = max(HOT, 8 * total // len(counts))
    buckets = max(16, total // BUCKET_WORDS)
    table = spark.sparkContext.broadcast(counts)  # fixed size

    def pack(batches):
        yield from _packer(table.value, hot, width, buckets)(batches)

    def pick(batches):
        yield from _hot_runs(table.value, hot, width)(batches)

    flags = docs.mapInArrow(pack, "bucket long, n int, packed binary").groupBy("bucket").applyInArrow(_judge(width), "doc long, tag long, at array<int>")
    if int(counts.max(initial=0)) > hot:
        runs = store(docs.mapInArrow(pick, "k1 long, k2 long, doc long, tag long, start int, w1 array<long>, w2 array<long>"), "runs")
        flags = flags.unionByName(_hot_flags(runs))
    return flags.groupBy("doc", "tag").agg(F.flatten(F.collect_list("at")).alias("at"))


def remove_repeats(docs: DataFrame, width: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_text): each text without the words that a repeated window covers, its other words joined by one space.

    A window of ``width`` words is repeated if the same words also begin a window in a document with a smaller key; all windows are judged on the
    input.  The words are runs without white space.  Null and empty texts have no words.  A null key is neither smaller nor larger than another, so
    those rows stay whole and take nothing from others; rows that share a key take nothing from each other.  Further columns are ignored.
    """
    # Only where a key occurs twice does a row need more than its key to be found again.
    twice = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    tag = F.xxhash64(F.col(text).cast("string")) if twice else F.lit(0).cast("long")
    slim = docs.select(F.col(key).alias("key"), F.col(key).cast("long").alias("doc"), tag.alias("tag"), F.col(text).cast("string").alias("text"))
    flags = repeated_windows(slim.filter("doc IS NOT NULL AND text IS NOT NULL").select("doc", "tag", "text"), width)
    rows = slim.join(flags, ["doc", "tag"], "left").select("key", "text", "at")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for value, at in zip(batch.column(1), batch.column(2)):
                found = (value.as_py() or "").encode("utf-8", "replace").split()
                n.append(len(found))
                if not at.is_valid:
                    gone.append(0)
                    kept.append(b" ".join(found))
                    continue
                begins = np.unique(at.values.to_numpy())
                cover = np.zeros(len(found) + 1, np.int32)
                cover[begins] += 1
                cover[begins + width] -= 1
                stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                gone.append(len(found) - len(stay))
                kept.append(b" ".join([found[i] for i in stay.tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "n_removed", "kept_text"])

    shape = T.StructType([T.StructField("key", slim.schema["key"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return rows.mapInArrow(keep, shape).withColumnRenamed("key", key)
