"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words, A-Z in lower case.  A word is a number: how frequent it is, in half powers of two, then bits of its hash.  So numbers order words
from rare to frequent, the same way everywhere.  Two sets of Jaccard similarity t
or more share a word among the first n - ceil(t n) + 1 of either, so only those prefixes are sent out, each word to its bucket.  There, sets with a
word in common are paired if their sizes allow the similarity (length filter) and if, with this as their first common word, enough words follow in both
(positional filter).  For each of 128 classes of words it is sent whether the set has an odd number of them; two sets differ in at least as many words
as in classes, which rules out nearly all pairs that are not similar.  Those left are verified on the whole sets.

Equal sets are one from the start: they are named by a sum over their words and half of the odd classes, combined before each shuffle, and only their first line stays.
All lines with a set send its rarest word to one bucket, which therefore knows the first of them.

A line that met enough partners for a word, of which those count most that differ in few classes, is not compared further until these are verified.  Where none of
them was similar, a second pass sends only the words at which a line had stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import marks, rarity
from . import words as W
from .store import release, store

SIMILARITY = 0.8
CHUNK = W.CHUNK_BYTES  # of text that are cut into words together
FLUSH = 24 << 20  # bytes of text that a task gathers before it packs
BUCKET_WORDS = 1_000_000  # words of the corpus for each bucket
ENOUGH = 64  # partners for each word of a line at first
CLOSE = 32  # partners that one counts for if it differs in at most half of the classes that the similarity allows
BITS = 22  # of the table of word counts: 4 MB of levels, whatever the size of the corpus

WORD_BITS, LEVEL_BITS = 52, 6
_BLOCK = 1 << (64 - WORD_BITS)  # lines that are sorted together
_WORD, _HASH = (np.uint64((1 << b) - 1) for b in (WORD_BITS, WORD_BITS - LEVEL_BITS))
_PIECE = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first bytes of eight


def _ceil_share(n: np.ndarray, share: Fraction) -> np.ndarray:
    return -((-n * share.numerator) // share.denominator)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of each row: runs of bytes that are no white space."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_and(data != 0x20, data - np.uint8(9) > 4, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    cut = np.unique(offsets)[1:-1]
    cut = cut[inside[cut] & inside[cut + 1]]  # words of two rows that touch
    if len(cut):
        starts, ends = np.insert(starts, np.searchsorted(starts, cut), cut), np.insert(ends, np.searchsorted(ends, cut), cut)
    return starts, ends


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z in lower case, eight bytes at a time."""
    room = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    np.bitwise_or(data, (data - np.uint8(65) < 26).view(np.uint8) << 5, out=room[:len(data)])
    eights, n = room.view(np.uint64), ends - starts

    def piece(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        i, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return ((eights[i] >> shift) | ((eights[i + 1] << np.uint64(1)) << (np.uint64(63) - shift))) & _PIECE[np.minimum(left, 8)]

    out = _stir(piece(starts, n) ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    more, done = np.flatnonzero(n > 8), 8
    while len(more):
        out[more] = _stir((out[more] * np.uint64(0xD6E8FEB86659FD93)) ^ piece(starts[more] + done, n[more] - done))
        done += 8
        more = more[n[more] > done]
    return out


def word_levels(texts: DataFrame) -> tuple[np.ndarray, int]:
    """For each counter of the corpus' words how frequent they are, in half powers of two; and how many words there are."""

    def hashes(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in W.chunks(column, CHUNK):
            yield _hashes(data, *_find(data, offsets))

    counts = rarity.count_hashes(texts, hashes, BITS)
    return np.minimum(2 * np.log2(np.maximum(counts, 1)), (1 << LEVEL_BITS) - 1).astype(np.uint8), int(counts.sum())


class Lines:
    """The word sets of the lines of some rows: for each line with words its row, number, size and name; the words of all, rare ones first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, levels: np.ndarray):
        cuts = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
        starts, ends = _find(data, offsets)
        hashes = _hashes(data, starts, ends)
        per_line = np.diff(np.searchsorted(starts, cuts))
        begin = np.flatnonzero(per_line)
        line = np.repeat(np.arange(len(begin), dtype=np.uint64), per_line[begin])
        level = levels[rarity.slot(hashes, len(levels).bit_length() - 1)].astype(np.uint64)
        words = (line << np.uint64(WORD_BITS)) | (level << np.uint64(WORD_BITS - LEVEL_BITS)) | (hashes & _HASH)
        blocks = np.append(np.searchsorted(line, np.arange(0, len(begin), _BLOCK, dtype=np.uint64)), len(line))
        for a, b in zip(blocks[:-1], blocks[1:]):
            words[a:b].sort()  # by line and word; no line leaves its place
        new = np.ones(len(words), bool)
        new[1:] = words[1:] != words[:-1]
        new[blocks[:-1]] = True
        self.words, line = words[new] & _WORD, line[new]
        self.first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, len(line)))
        self.row = np.searchsorted(offsets, cuts[begin], "right") - 1
        self.number = begin - np.searchsorted(cuts, offsets[self.row])
        if len(line):
            self.k1 = np.add.reduceat(_stir(self.words), self.first).view(np.int64)
            odd = np.uint64(1) << (self.words & np.uint64(63))
            half = self.words >> np.uint64(6) & np.uint64(1)
            self.k2, self.k3 = (np.bitwise_xor.reduceat(odd * x, self.first).view(np.int64) for x in (half, np.uint64(1) - half))
        else:
            self.k1 = self.k2 = self.k3 = np.zeros(0, np.int64)

    def only(self, keep: np.ndarray) -> None:
        """Keep some of the lines."""
        self.words = self.words[np.repeat(keep, self.size)]
        for name in ("size", "row", "number", "k1", "k2", "k3"):
            setattr(self, name, getattr(self, name)[keep])
        self.first = np.cumsum(self.size) - self.size


def _first_of_equals(k1: np.ndarray, k2: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Marks one line of each name: the first in the order of ``by`` (as for lexsort: the last counts most), then of arrival."""
    order = np.lexsort((*(x for x in by if len(x) and x.min() != x.max()), k2, k1))
    new = np.ones(len(k1), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    out = np.zeros(len(k1), bool)
    out[order[new]] = True  # lexsort is stable
    return out


#: A word of a set's prefix: the set's name and size, the word's place in it, and the first line that has the set, as far as the task has seen.
_POSTING = {"word": np.uint64, "k1": np.int64, "k2": np.int64, "k3": np.int64, "n": np.uint32, "place": np.uint32, "late": np.uint8, "doc": np.int64, "tag": np.int64, "line": np.uint32}
_ORDER = ("line", "tag", "doc", "late")  # of lexsort: the last counts most
_SET = ("k1", "k2", "k3", "n", *_ORDER)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _spread(words: np.ndarray) -> np.ndarray:
    """Words as other numbers of as many bits, evenly spread: each word has its own."""
    out = words
    for _ in range(2):
        out = out * _TIMES & _WORD
        out = out ^ (out >> np.uint64(WORD_BITS // 2))
    return out


def _packer(levels: np.ndarray, share: Fraction, buckets: int, asked: np.ndarray | None):
    """Prefix words of the sets of a task, equal sets once, in pieces for each bucket.  ``asked`` marks the words that are sent; None: all."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sets = {c: np.concatenate([x[c] for x in held]) for c in (*_SET, "sent")}
            prefixes = np.concatenate([x["words"] for x in held])
            first = _first_of_equals(sets["k1"], sets["k2"], *(sets[c] for c in _ORDER))
            of = np.repeat(np.arange(len(first)), sets["sent"])
            place = np.arange(len(of)) - np.repeat(np.cumsum(sets["sent"]) - sets["sent"], sets["sent"])
            word = _spread(prefixes)
            keep = np.flatnonzero(first[of] if asked is None else first[of] & marks.has(asked, word.view(np.int64)))
            keep = keep[np.argsort(word[keep])]
            word, of, place = word[keep], of[keep], place[keep]
            bucket = ((word >> np.uint64(WORD_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            begins = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(begins[1:], len(word))
            rows = {"word": word, "place": place, **{c: sets[c][of] for c in _SET}}
            packed = [_pack({c: rows[c][a:b] for c in _POSTING}) for a, b in zip(begins, ends)]
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array((ends - begins).astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "n", "packed"])

        for batch in batches:
            late, doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for low, _, data, offsets in W.chunks(batch.column(3), CHUNK):
                lines = Lines(data, offsets, levels)
                at = low + lines.row
                lines.only(_first_of_equals(lines.k1, lines.k2, lines.number, tag[at], doc[at], late[at]))
                sent = lines.size - _ceil_share(lines.size, share) + 1
                at = low + lines.row
                place = np.arange(int(sent.sum())) - np.repeat(np.cumsum(sent) - sent, sent)
                held.append({"k1": lines.k1, "k2": lines.k2, "k3": lines.k3, "n": lines.size, "late": late[at], "doc": doc[at], "tag": tag[at], "line": lines.number, "sent": sent, "words": lines.words[np.repeat(lines.first, sent) + place]})
                size += len(data)
                if size >= FLUSH:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return pack


def _pack(rows: dict[str, np.ndarray]) -> bytes:
    """Column by column, the words as differences (they are sorted), all first bytes, then all second bytes, ...; bytes that are mostly zero vanish."""
    rows = rows | {"word": np.diff(rows["word"], prepend=np.uint64(0))}
    planes = [np.ascontiguousarray(rows[c], kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for c, kind in _POSTING.items()]
    return zstandard.compress(b"".join(planes), 1)


def _unpack(n: int, packed: bytes) -> dict[str, np.ndarray]:
    raw, at, rows = np.frombuffer(zstandard.decompress(packed), np.uint8), 0, {}
    for c, kind in _POSTING.items():
        wide = np.dtype(kind).itemsize
        rows[c] = np.ascontiguousarray(raw[at:at + n * wide].reshape(wide, n).T).view(kind)[:, 0]
        at += n * wide
    rows["word"] = np.cumsum(rows["word"], dtype=np.uint64)
    return rows


_PLACE = ["_late", "_doc", "_tag"]
_PAIR = ["a1", "a2", "b1", "b2"]
_MET = ", ".join(f"{c} long" for c in (*_PAIR, "word")) + ", _late boolean, _doc long, _tag long, line int"


def _pairer(share: Fraction, enough: int | None, asked: np.ndarray | None):
    """Pairs of an earlier set a and a later set b, with the first line of b.  A set gets its earliest ``enough`` partners for a word (a close one counts for more), and ``word`` tells that it may have
    others; None means all.  Where ``asked`` marks names, only those sets look for partners.  Else rows without a pair tell the first lines of all sets with their
    rarest word here."""
    both = share / (1 + share)

    def pair(group: pa.Table) -> pa.Table:
        parts = [_unpack(n, x) for n, x in zip(group["n"].to_pylist(), group["packed"].to_pylist())]
        rows = {c: np.concatenate([x[c] for x in parts]) for c in _POSTING}
        order = np.lexsort((*(rows[c] for c in _ORDER if rows[c].min() != rows[c].max()), rows["word"]))
        # Of equal sets the first line: a stable sort brings the postings of a set for a word together.
        names = [rows[c][order] for c in ("word", "k1", "k2")]
        same = np.argsort(_stir(names[0]) ^ names[1].view(np.uint64), kind="stable")
        new = np.ones(len(same), bool)
        new[1:] = np.logical_or.reduce([x[same][1:] != x[same][:-1] for x in names])
        order = order[np.sort(same[new])]
        rows = {c: x[order] for c, x in rows.items()}
        word, n, place, odd = rows["word"], rows["n"].astype(np.int64), rows["place"].astype(np.int64), (rows["k2"].view(np.uint64), rows["k3"].view(np.uint64))
        start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        start = np.repeat(start, np.diff(np.append(start, len(word))))
        have = np.zeros(len(word), np.int64)
        later = np.flatnonzero(np.arange(len(word)) > start)
        if asked is not None:
            later = later[marks.has(asked, rows["k1"][later])]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        least, most = _ceil_share(n, share), n * share.denominator // share.numerator
        at = start[later]
        while len(later):  # each set with the first of its word, the second, ... up to itself
            size = n[at]
            fits = np.flatnonzero((size >= least[later]) & (size <= most[later]))
            earlier, mine = at[fits], later[fits]
            both_n = n[earlier] + n[mine]
            need = _ceil_share(both_n, both)
            fits = np.minimum(n[earlier] - place[earlier], n[mine] - place[mine]) >= need
            earlier, mine, room = earlier[fits], mine[fits], (both_n - 2 * need)[fits]
            apart = sum(np.bitwise_count(x[earlier] ^ x[mine]).astype(np.int64) for x in odd)
            near = apart <= room
            earlier, mine = earlier[near], mine[near]
            out.append((earlier, mine))
            have[mine] += np.where(2 * apart[near] <= room[near], CLOSE, 1)
            at = at + 1
            stay = at < later
            if enough is not None:
                stay &= have[later] < enough
            later, at = later[stay], at[stay]
        a, b = (np.concatenate(x) for x in zip(*out))
        more = np.zeros(len(a), bool) if enough is None else have[b] >= enough
        firsts = np.flatnonzero(rows["place"] == 0) if asked is None else np.zeros(0, np.int64)
        none, at = pa.nulls(len(firsts), pa.int64()), np.concatenate((b, firsts))
        found = [pa.chunked_array([pa.array(rows[c][x]), none]) for c, x in (("k1", a), ("k2", a), ("k1", b), ("k2", b))]
        found.append(pa.chunked_array([pa.array(word[b].view(np.int64), mask=~more), none]))
        found += [pa.chunked_array([pa.array(rows[c][at].astype(kind))]) for c, kind in (("late", bool), ("doc", np.int64), ("tag", np.int64), ("line", np.int32))]
        return pa.table(found, [*_PAIR, "word", *_PLACE, "line"])

    return pair


def candidate_sets(lines: DataFrame, levels: np.ndarray, n_words: int, similarity: float = SIMILARITY, enough: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Pairs (a1, a2, b1, b2, word) of the names of line sets that the filters leave, with the first line of b (_late, _doc, _tag, line): all similar ones, and a few
    others.  a is the earlier one.  A pair comes once for each word it has in common in both prefixes.

    ``lines`` has _late, _doc, _tag and text.  ``enough`` stops a set at that many partners for a word and tells by ``word``, which is null elsewhere.  ``only``, such
    names b1 and words, restricts the later sets and the words (and lets a few others through).  Without it, rows whose names are null tell the first line of each set.
    """
    share, spark = Fraction(str(similarity)), lines.sparkSession
    sent = spark.sparkContext.broadcast(levels)  # fixed size
    buckets = max(16, n_words // BUCKET_WORDS)
    names, words = (None, None) if only is None else (spark.sparkContext.broadcast(marks.table_of(only.select(c))) for c in ("b1", "word"))

    def pack(batches):
        yield from _packer(sent.value, share, buckets, words and words.value)(batches)

    def pair(group):
        return _pairer(share, enough, names and names.value)(group)

    found = lines.mapInArrow(pack, "bucket long, n int, packed binary").groupBy("bucket").applyInArrow(pair, _MET)
    found = store(found, "candidates")
    release(spark)
    return found


def _verifier(share: Fraction):
    """Leaves the rows whose a_words and b_words, runs of 64-bit words, are similar sets."""

    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_binary())
        _, ends, data = column.buffers()
        offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1] // 8
        return np.frombuffer(data, np.uint64, offsets[-1])[offsets[0]:], offsets

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                rows, keys, sizes = np.arange(batch.num_rows, dtype=np.uint64), [], np.zeros(batch.num_rows, np.int64)
                for c in ("a_words", "b_words"):
                    words, offsets = sets(batch.column(c))
                    size = np.diff(offsets)
                    keys.append(words | np.repeat(rows, size) << np.uint64(WORD_BITS))
                    sizes += size
                key = np.sort(np.concatenate(keys))
                common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(WORD_BITS)).astype(np.int64), minlength=batch.num_rows)
                similar = common * share.denominator >= (sizes - common) * share.numerator
                yield batch.filter(pa.array(similar)).drop_columns(["a_words", "b_words"])

    return verify


def verified(pairs: DataFrame, texts: DataFrame, levels: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a1, a2, b1, b2 and others) whose whole sets have a Jaccard similarity of ``similarity`` or more."""
    share = Fraction(str(similarity))
    sent = texts.sparkSession.sparkContext.broadcast(levels)  # fixed size
    wanted = texts.sparkSession.sparkContext.broadcast(marks.table_of(pairs.select("a1", "b1")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Lines] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k1, k2, n = (np.concatenate([getattr(x, c) for x in held]) for c in ("k1", "k2", "size"))
            words, first = np.concatenate([x.words for x in held]), _first_of_equals(k1, k2)
            words, ends = words[np.repeat(first, n)].tobytes(), np.concatenate(([0], np.cumsum(n[first]) * 8))
            return pa.RecordBatch.from_arrays([pa.array(k1[first]), pa.array(k2[first]), pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(words)]).cast(pa.binary())], ["k1", "k2", "words"])

        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column(0), CHUNK):
                lines = Lines(data, offsets, sent.value)
                lines.only(marks.has(wanted.value, lines.k1))
                held.append(lines)
                size += len(data)
                if size >= FLUSH:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    whole = texts.mapInArrow(sets, "k1 long, k2 long, words binary").dropDuplicates(["k1", "k2"])
    a, b = (whole.select(F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("words").alias(f"{x}_words")) for x in "ab")
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select(*pairs.columns, "a_words", "b_words")
    return both.mapInArrow(_verifier(share), pairs.schema)


def _rebuilder(at: int):
    """Cuts lines out of column ``at``.  The last two columns list the lines with words that stay unless they are in the second list; null: none."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns - 2
            texts, total, removed = [], [], []
            for low, high, data, offsets in W.chunks(batch.column(at), CHUNK):
                valid = batch.column(at).slice(low, high - low).is_valid().to_numpy(zero_copy_only=False)
                # Each row's last line ends where the row does, the others behind a line feed.
                ends = np.concatenate((np.flatnonzero(data == 10) + 1, offsets[1:]))
                row = np.concatenate((np.searchsorted(offsets, ends[:len(ends) - (high - low)] - 1, "right") - 1, np.arange(high - low)))
                order = np.argsort(row, kind="stable")
                ends, row = ends[order], row[order]
                begins = np.concatenate(([0], ends[:-1]))
                n = np.bincount(row, minlength=high - low)
                first = np.cumsum(n) - n
                starts, _ = _find(data, offsets)
                stay = np.searchsorted(starts, begins) == np.searchsorted(starts, ends)  # lines without words
                for i, value in ((width, True), (width + 1, False)):
                    lists = batch.column(i).slice(low, high - low)
                    of, number = np.repeat(np.arange(high - low), np.asarray(lists.value_lengths().fill_null(0))), np.asarray(lists.flatten())
                    here = number < n[of]  # rows may share a place if their keys are equal as whole numbers only
                    stay[(first[of] + number)[here]] = value
                # A row's lines are joined by line feeds: behind the last that stays there is none.
                keep = np.repeat(stay, ends - begins)
                kept = np.bincount(row[stay], minlength=high - low)
                last = np.full(high - low, -1)
                last[row[stay]] = np.flatnonzero(stay)
                feed = last[(last >= 0) & (last < first + n - 1)]
                keep[ends[feed] - 1] = False
                sizes = np.add.reduceat(np.append(keep, False), offsets[:-1], dtype=np.int64) * (np.diff(offsets) > 0)
                where = np.concatenate(([0], np.cumsum(sizes)))
                text = pa.Array.from_buffers(pa.large_string(), high - low, [None, pa.py_buffer(where), pa.py_buffer(data[keep].tobytes())])
                texts.append(pc.if_else(pa.array(valid), text, pa.scalar(None, pa.large_string())).cast(pa.string()))
                total.append(n * valid)
                removed.append((n - kept) * valid)
            if texts:
                columns = [*batch.columns[:at], pa.concat_arrays(texts), *batch.columns[at + 1:width], *(pa.array(np.concatenate(x).astype(np.int64)) for x in (total, removed))]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:width], "n_lines", "n_removed"])

    return rebuild


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines taken out that are similar to an earlier one, and how many: n_lines, n_removed.

    Lines are compared as word sets by Jaccard similarity; earlier means a smaller key, or the same key and an earlier line.  All lines are judged on
    the input, whether or not the earlier line stays itself.  Lines without words stay.  A text keeps its other lines, in order and as they are,
    and an unchanged text is the same to the byte.  Null texts stay null.  Null keys come last; rows that share a key come in the order of a hash
    of their text, and rows equal in key and text are one document, so both keep the same lines.  All other columns stay as they are,
    but for two of the added names, which are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # names in the plan must be plain and different
    key, text, names, given = f"c{names.index(key)}", f"c{names.index(text)}", docs.columns, names
    twice = docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    tag = F.xxhash64(F.col(text).cast("string")) if twice else F.lit(0).cast("long")
    place_of = (F.col(key).isNull(), F.coalesce(F.col(key).cast("long"), F.lit(0)), tag)
    rows = docs.select("*", *[v.alias(k) for k, v in zip(_PLACE, place_of)])
    slim = rows.filter(F.col(text).isNotNull()).select(*_PLACE, F.col(text).cast("string").alias("text"))
    texts = slim.select("text")
    levels, n_words = word_levels(texts)
    line = [*_PLACE, "line"]
    # One similar earlier line is enough, so a line is first tried against a few; only where those fail and there may be more, against all.
    met = candidate_sets(slim, levels, n_words, similarity, enough=ENOUGH)
    pairs = met.filter("a1 is not null")
    gone = store(verified(pairs.select(*_PAIR, *line).distinct(), texts, levels, similarity).select("b1", "b2", *line).distinct(), "gone")
    left = store(pairs.filter("word is not null").select("b1", "b2", "word").distinct().join(gone.select("b1", "b2"), ["b1", "b2"], "left_anti"), "left")
    if not left.isEmpty():
        rest = candidate_sets(slim, levels, n_words, similarity, only=left).join(left.select("b1", "b2").distinct(), ["b1", "b2"], "left_semi")
        gone = gone.unionByName(store(verified(rest.select(*_PAIR, *line).distinct(), texts, levels, similarity).select("b1", "b2", *line).distinct(), "gone"))
    release(docs.sparkSession)
    lines = met.filter("a1 is null").select(*line, F.lit(False).alias("out")).unionByName(gone.select(*line, F.lit(True).alias("out")))
    of_row = lines.groupBy(*_PLACE).agg(F.collect_list(F.when(~F.col("out"), F.col("line"))).alias("_stay"), F.collect_list(F.when(F.col("out"), F.col("line"))).alias("_out"))
    joined = rows.join(of_row, _PLACE, "left").select(*names, "_stay", "_out")
    shape = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_rebuilder(names.index(text)), shape).toDF(*given, "n_lines", "n_removed")
