"""Two tokenizers aligned by byte ranges, with corpus-wide document counts of linked token pairs from inverted bitmaps.

Rows are numbered by task and place, and 65,536 numbers of one task make a container.  For each linked pair and container there is one compressed bitmap of the
documents that hold the pair (bit positions of 16 bits, or plain bits where those are shorter), and for documents that hold it more than once, multiplicity planes: plane
k has the documents where bit k of the further links is set.  Bitmaps are merged inside their task; the popcounts of containers add up to the document count
of a pair.  The bitmaps, which are postings as well, then give the score of their pair back to their documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import store

CONTAINER = 16  # bits of a place inside a container
HOLD = 3_000_000  # postings that are merged together in a task
CACHE_PIECES, CACHE_LINKS = 300_000, 4_000_000
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"  # all letters below BEYOND; those have no marks that join them
LATIN, OTHER, BEYOND = re.compile(f"[{LETTERS}]"), re.compile(f"[^{LETTERS}]"), re.compile("[^\0-ɏ]")
SAFE = re.compile(r"(?<=\S)(?= \S)")
# Letters with the space before; other characters up to a space before letters, or to letters behind a mark or one white space that is no space; else both together.
TILES = re.compile(rf" ?[{LETTERS}]+|[^{LETTERS}]+?(?:(?<=\S)(?= [{LETTERS}])|(?<=[^\s'])(?=[{LETTERS}])|(?<=\S[^\S ])(?=[{LETTERS}])|\Z)|[^{LETTERS}]+[{LETTERS}]+")
DOCUMENT = -1  # plane number of the document bitmap; ROW marks the rows of documents themselves
ROW = -2
SCORE = 127  # a row with the count of a pair, before the bitmaps of the pair


class Aligner:
    """Alignment of texts by two tokenizers, piece by piece.

    Texts are cut where the pre-tokenizer of A starts a token and no entry of B holds the two characters side by side, so that pieces are aligned by themselves
    and equal pieces once: before a single space, and, in texts of Latin letters, between letters and what is none.  What the vocabularies do not allow is not done;
    then pieces are larger or whole texts.
    """

    def __init__(self, byte_level: str, sentence_piece: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(byte_level), sentencepiece.SentencePieceProcessor(model_proto=sentence_piece)
        self.a.encode_special_tokens = True
        # The file writes bytes as printable characters: those that are printable stand for themselves, the others follow from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        entries = {i: x for x, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(byte_of.get(c, 0) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

        spec = json.loads(byte_level)
        plain = not spec["normalizer"] and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]
        texts = [x for i, x in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        after_line = [names[i] for i in self.b.encode("\nab")][:2]
        self.whole = not plain or any("▁" in x.lstrip("▁") or "\n" in x for x in texts) or after_line != ["▁", "<0x0A>"]
        self.latin = not any(LATIN.search(x) and OTHER.search(x.lstrip("▁")) for x in texts)
        self.restart()

    def restart(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # of each piece: tokens of A, of B, groups, links; links -1 where the bytes differ
        self.pair: dict[int, int] = {}
        self.links = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.groups) > CACHE_PIECES or len(self.links) > CACHE_LINKS

    def pieces(self, text: str) -> list[str]:
        """The pieces of a space and the text."""
        text = " " + text
        if self.whole:
            return [text]
        return TILES.findall(text) if self.latin and not BEYOND.search(text) else SAFE.split(text)

    def coded(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B.  B puts a space in front by itself; a piece that begins otherwise or is a space alone is read behind a line end, which joins with nothing."""
        led = [len(x) > 1 and x[0] == " " for x in pieces]
        many_a = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        many_b = self.b.encode([x[1:] if s else "\n" + x for x, s in zip(pieces, led)], num_threads=1)
        return many_a, [ids if s else ids[2:] for ids, s in zip(many_b, led)]

    def learn(self, new: list[str]) -> None:
        """Align the pieces.  Every place where a token of A or of B ends is one link, of the two tokens there; a place where both end closes a group."""
        many_a, many_b = self.coded(new)
        texts = [x.encode() for x in new]
        good = [b"".join([self.bytes_a[i] for i in a]) == x and b"".join([self.bytes_b[i] for i in b]) == x for a, b, x in zip(many_a, many_b, texts)]
        n_a, n_b, size = (np.array([len(x) if g else 0 for x, g in zip(xs, good)], np.int64) for xs in (many_a, many_b, texts))
        a, b = (np.fromiter(chain.from_iterable(x for x, g in zip(xs, good) if g), np.int64) for xs in (many_a, many_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        closes = (end_a[link_a] == ends) & (end_b[link_b] == ends) if len(ends) else np.zeros(0, bool)
        edge = np.concatenate(([0], np.cumsum(size)))
        n_links, n_groups = np.diff(np.searchsorted(ends, edge, "right")), np.diff(np.searchsorted(ends[closes], edge, "right"))
        self.facts = np.concatenate((self.facts, np.stack((n_a, n_b, n_groups, np.where(good, n_links, -1)), 1)))
        names, local = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True)
        numbers = np.array([self.pair.setdefault(x, len(self.pair)) for x in names.tolist()], np.int64)
        self.links = np.concatenate((self.links, numbers[local])) if len(local) else self.links
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(n_links)))
        # The groups as text, all of them one behind the other, then those of each piece.
        words_a, words_b = a.astype(str).tolist(), b.astype(str).tolist()
        upto_a, upto_b = (link_a[closes] + 1).tolist(), (link_b[closes] + 1).tolist()
        written = [f"{words_a[i] if j - i == 1 else ','.join(words_a[i:j])}|{words_b[k] if m - k == 1 else ','.join(words_b[k:m])}"
                   for i, j, k, m in zip([0, *upto_a], upto_a, [0, *upto_b], upto_b)]
        at = np.concatenate(([0], np.cumsum(n_groups))).tolist()
        known = len(self.groups)
        self.groups += [";".join(written[i:j]) for i, j in zip(at, at[1:])]
        self.number.update(zip(new, range(known, known + len(new))))

    def gives_back(self, text: str) -> bool:
        """Whether the tokens of both give back a space and the text, taken as a whole."""
        whole = (" " + text).encode()
        return whole == b"".join([self.bytes_a[i] for i in self.a.encode(" " + text, add_special_tokens=False).ids]) == b"".join([self.bytes_b[i] for i in self.b.encode(text)])


_HELD: dict[int, Aligner] = {}  # one for each Python worker


def bitmaps(postings: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Pair numbers and compressed bitmaps of sorted postings (pair number and place in one integer)."""
    pairs = postings >> CONTAINER
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    ends = np.append(first[1:], len(pairs))
    places = (postings & ((1 << CONTAINER) - 1)).astype("<u2")
    raw, last = places.tobytes(), places[ends - 1].astype(np.int64)
    maps = [b"\0" + raw[2 * s:2 * e] for s, e in zip(first.tolist(), ends.tolist())]
    for i in np.flatnonzero(2 * (ends - first) > last // 8 + 1).tolist():  # bits up to the last place are shorter than places
        bits = np.zeros(int(last[i]) + 1, bool)
        bits[places[first[i]:ends[i]]] = True
        maps[i] = b"\1" + np.packbits(bits, bitorder="little").tobytes()
    return pairs[first], maps


def compress(postings: np.ndarray, extra: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """Document bitmaps of sorted postings, then the planes of their links beyond the first: (plane, pair numbers, bitmaps)."""
    if len(postings):
        yield DOCUMENT, *bitmaps(postings)
    plane = 0
    while (more := extra >> np.uint32(plane) > 0).any():
        postings, extra = postings[more], extra[more]
        chosen = (extra >> np.uint32(plane)) & np.uint32(1) > 0
        if chosen.any():
            yield plane, *bitmaps(postings[chosen])
        plane += 1


def places_of(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all bitmaps one behind the other, and how many each has."""
    data, offsets = bitmap_bytes(bitmaps)
    lengths = np.diff(offsets)
    plain = data[offsets[:-1]] == 1
    sizes = np.where(plain, 0, (lengths - 1) // 2)
    found = {}
    for i in np.flatnonzero(plain).tolist():
        found[i] = np.flatnonzero(np.unpackbits(data[offsets[i] + 1:offsets[i + 1]], bitorder="little"))
        sizes[i] = len(found[i])
    begin = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    keep = np.ones(len(data), bool)
    keep[offsets[:-1]] = False
    listed = np.repeat(~plain, lengths)
    flat = data[keep & listed].view("<u2")
    out[np.repeat(~plain, sizes)] = flat
    for i, places in found.items():
        out[begin[i]:begin[i] + len(places)] = places
    return out, sizes


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def popcounts(bitmaps: pa.Array) -> np.ndarray:
    data, offsets = bitmap_bytes(bitmaps)
    if not len(bitmaps):
        return np.zeros(0, np.int64)
    kind = data[offsets[:-1]]
    return np.where(kind == 1, np.add.reduceat(_ONES[data], offsets[:-1]) - 1, (np.diff(offsets) - 1) // 2)


def bitmap_bytes(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    whole = bitmaps.cast(pa.large_binary())
    _, ends, data = whole.buffers()
    offsets = np.frombuffer(ends, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def encode(docs: DataFrame, byte_level: str, sentence_piece: str, key: str, text: str) -> DataFrame:
    """Rows of documents (plane ROW) and bitmaps of pairs, in one pass over the texts, stored."""
    with open(byte_level, encoding="utf-8") as file:
        spec = file.read()
    with open(sentence_piece, "rb") as file:
        model = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = zlib.crc32(model, zlib.crc32(spec.encode()))
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = Aligner(spec, model)
        align, part, count = _HELD[name], TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged(container: int) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            postings = np.concatenate([p for p, _ in held])
            order = np.argsort(postings, kind="stable")
            postings, extra = postings[order], np.concatenate([x for _, x in held])[order]
            names = np.fromiter(align.pair, np.int64, len(align.pair))
            for plane, pairs, maps in compress(postings, extra):
                for low in range(0, len(maps), 20_000):
                    some = slice(low, low + 20_000)
                    ids, n = names[pairs[some]], len(maps[some])
                    yield batch_of(shape, {"container": np.full(n, container), "plane": np.full(n, plane, np.int32), "a": (ids >> 32).astype(np.int32), "b": (ids & 0xFFFFFFFF).astype(np.int32), "bits": pa.array(maps[some], pa.binary())}, n)
            held.clear()

        for batch in batches:
            for low, high, _, _ in W.chunks(batch.column(1), 1 << 20):
                at = low
                while at < high:
                    container = part << 33 | count >> CONTAINER
                    end = min(high, at + (1 << CONTAINER) - (count & ((1 << CONTAINER) - 1)))
                    texts = [x or "" for x in batch.column(1).slice(at, end - at).to_pylist()]
                    facts, hashes, postings, extra = documents(align, texts, count & ((1 << CONTAINER) - 1))
                    held.append((postings, extra))
                    size += len(postings)
                    n = end - at
                    yield batch_of(shape, {"container": np.full(n, container), "plane": np.full(n, ROW, np.int32), "place": np.arange(n, dtype=np.int32) + (count & ((1 << CONTAINER) - 1)),
                                           "key": batch.column(0).slice(at, n), "groups_sha256": pa.array(hashes), **{k: facts[:, i] for i, k in enumerate(NUMBERS)}}, n)
                    count += n
                    at = end
                    if size > HOLD or align.full() or not count & ((1 << CONTAINER) - 1):
                        yield from merged(container)
                        size = 0
                        if align.full():
                            align.restart()
        if held:
            yield from merged(part << 33 | (count - 1) >> CONTAINER)

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    long, integer = T.LongType(), T.IntegerType()
    shape = T.StructType([T.StructField("container", long), T.StructField("plane", integer), T.StructField("a", integer), T.StructField("b", integer), T.StructField("bits", T.BinaryType()),
                          T.StructField("place", integer), T.StructField("key", slim.schema["key"].dataType), *[T.StructField(k, long) for k in NUMBERS], T.StructField("groups_sha256", T.StringType())])
    return store(slim.mapInArrow(run, shape), "pair-bitmaps")


def batch_of(shape: T.StructType, columns: dict, n: int) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(shape)
    arrays = [pa.nulls(n, f.type) if f.name not in columns else columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def documents(align: Aligner, texts: list[str], place: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Facts and group hashes of texts, and their postings (pair number and place) with the links of each beyond the first."""
    parts = [align.pieces(x) if x else [] for x in texts]
    get = align.number.get
    found = [list(map(get, p)) for p in parts]
    new = list({w for p, f in zip(parts, found) if None in f for w, i in zip(p, f) if i is None})
    if new:
        align.learn(new)
        found = [f if None not in f else [align.number[w] for w in p] for p, f in zip(parts, found)]
    facts, first = align.facts, align.first
    flat = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
    size = np.array([len(f) for f in found], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    sums = np.zeros((len(texts), 4), np.int64)
    np.add.at(sums, owner, facts[flat])
    bad = np.zeros(len(texts), bool)
    bad[owner[facts[flat, 3] < 0]] = True
    for i in np.flatnonzero(bad).tolist():
        if align.gives_back(texts[i]):
            raise ValueError("a piece differs from its tokens where its text does not")
    sums[bad] = 0
    groups = align.groups
    hashes = ["" if b or not f else hashlib.sha256(";".join([groups[i] for i in f]).encode()).hexdigest() for f, b in zip(found, bad.tolist())]
    good = ~bad[owner]
    flat, owner = flat[good], owner[good]
    n = first[flat + 1] - first[flat]
    begin = np.cumsum(n) - n
    links = align.links[np.arange(int(n.sum())) + np.repeat(first[flat] - begin, n)] if len(flat) else np.zeros(0, np.int64)
    postings, counts = np.unique(links << CONTAINER | (np.repeat(owner, n) + place), return_counts=True)
    return sums, hashes, postings, (counts - 1).astype(np.uint32)


def pair_counts(planes: DataFrame) -> DataFrame:
    """(a, b, count, best) from the document bitmaps: popcounts added up for each pair, and whether no pair of the same A id has a higher count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(popcounts(batch.column(2)))], ["a", "b", "n"])

    counts = planes.filter(F.col("plane") == DOCUMENT).select("a", "b", "bits").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = store(counts, "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, byte_level: str, sentence_piece: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Alignment of each whole text by two tokenizers: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A is a byte-level BPE file of the ``tokenizers`` library and reads a space and the text; B is a ``sentencepiece`` model that puts a space in front itself.  Special
    strings are plain text.  Byte offsets where tokens of both end cut them into groups; tokens whose byte ranges overlap are linked.  The count of a pair of ids is
    the number of rows that hold it linked.  ``n_best`` counts links whose pair has the highest count of its A id, ties included; ``count_sum`` adds up the counts over all links.

    Null and empty texts, and texts that the tokens do not give back byte for byte, have zeros and an empty hash.  Repeated rows and rows without a key are documents
    like others; further columns are ignored; an empty table gives an empty one.  A text is taken whole, piece by piece; memory follows the longest text.

    The bitmaps are stored once in the shared folder and shuffled once, by container.  The counts come to the containers by the pairs' ids alone; the scores of a container add up in
    arrays of fixed size while its bitmaps stream by, each behind its count.  No group holds more than the bitmaps of one container of one pair.
    """
    planes = encode(docs, byte_level, sentence_piece, key, text)
    rows = planes.filter(F.col("plane") == ROW)
    maps = planes.filter(F.col("plane") > ROW).select("container", "plane", "a", "b", "bits")
    asked = maps.filter(F.col("plane") == DOCUMENT).select("container", "a", "b").distinct()
    scores = asked.join(pair_counts(planes), ["a", "b"]).withColumn("plane", F.lit(SCORE))
    facts = ["place", "key", *NUMBERS, "groups_sha256"]
    columns = {f.name: f.dataType for f in (*maps.schema, *scores.schema, *rows.select(*facts).schema)}
    parts = [df.select(*[F.col(c) if c in df.columns and not (df is rows and c in ("a", "b", "bits")) else F.lit(None).cast(t).alias(c) for c, t in columns.items()]) for df in (maps, scores, rows)]
    meet = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # For each pair its count, then its bitmaps; the rows of documents come last.
    meet = meet.repartition("container").sortWithinPartitions("container", F.col("a").asc_nulls_last(), "b", F.col("plane").desc())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best, now = np.zeros(1 << CONTAINER, np.int64), np.zeros(1 << CONTAINER, np.int64), None
        last = 0, 0  # count and whether it is the highest, of the pair before
        for batch in batches:
            containers = batch.column("container").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], containers[1:] != containers[:-1]))) if len(containers) else []
            for low, high in zip(cuts, [*cuts[1:], len(containers)]):
                if containers[low] != now:
                    now = containers[low]
                    total[:], best[:] = 0, 0
                some = batch.slice(int(low), int(high - low))
                plane = some.column("plane").to_numpy()
                n_maps = int((plane > ROW).sum())
                if n_maps:
                    is_score = plane[:n_maps] == SCORE
                    behind = np.cumsum(is_score)
                    count = np.concatenate(([last[0]], some.column("count").slice(0, n_maps).drop_null().to_numpy()))
                    wins = np.concatenate(([last[1]], some.column("best").slice(0, n_maps).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)))
                    last = count[-1], wins[-1]
                    chosen = np.flatnonzero(~is_score)
                    places, sizes = places_of(some.column("bits").take(pa.array(chosen)))
                    weight = np.left_shift(np.int64(1), np.maximum(plane[chosen], 0).astype(np.int64))
                    np.add.at(total, places, np.repeat(weight * count[behind[chosen]], sizes))
                    np.add.at(best, places, np.repeat(weight * wins[behind[chosen]], sizes))
                if n_maps < len(plane):
                    part = some.slice(n_maps)
                    place = part.column("place").to_numpy()
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("key", *NUMBERS)], pa.array(best[place]), pa.array(total[place]), part.column("groups_sha256")], [f.name for f in shape])

    long = T.LongType()
    shape = T.StructType([rows.schema["key"], *[T.StructField(k, long) for k in (*NUMBERS, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])
    return meet.mapInArrow(add, shape).withColumnRenamed("key", key)
