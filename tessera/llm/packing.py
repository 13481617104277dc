"""Whole documents packed into token sequences of a fixed length, by bin completion with branch and bound.

Only lengths matter to a packing, so the search works on counts of rows for each length: at most as many numbers as a sequence has tokens, whatever the size of
the corpus.  A filling is chosen for the largest length that is left and taken as often as the counts allow.  A plan is a list of fillings with their numbers of
copies; rows find their places in it by their rank among the rows of equal length, as arithmetic in parallel tasks.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import store

CACHE_RUNS, CACHE_WORDS = 400_000, 250_000
LONG = 64  # longer words are not remembered
JOINED = 2000  # words that go through the library as one text
# What is fixed in Unicode below U+0250: letters, numbers, white space.  None of these characters is changed by composition.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"
# The file's own pattern, of which SPLIT is the part below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # fillings as ((length, how many), ...) with the number of sequences filled so


@dataclass
class Lists:
    """Lists of ids one behind the other."""

    size: np.ndarray
    ids: np.ndarray

    def plus(self, more: Lists) -> Lists:
        return Lists(np.concatenate((self.size, more.size)), np.concatenate((self.ids, more.ids)))

    def take(self, at: np.ndarray) -> Lists:
        size = self.size[at]
        begin = np.cumsum(size) - size
        first = np.cumsum(self.size) - self.size
        return Lists(size, self.ids[np.arange(int(size.sum())) + np.repeat(first[at] - begin, size)])


class WordIds:
    """Token ids of whole texts for a BPE file that lower-cases, drops white space and cuts texts into words by ``PATTERN``.

    Such a tokenizer treats a run between two ASCII white-space characters by itself, so that the ids of a text are those of its runs in a row.  All runs of a batch
    are found and hashed as arrays (two independent 64-bit hashes), and their ids gathered from those of earlier runs.  In texts of characters below U+0250 new runs
    are cut into words here, and new words go through the library's BPE; runs of other texts, and of texts with special strings, go through the whole tokenizer.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        shape = json.loads(spec)
        steps = [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (shape["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or split != [PATTERN, None] or shape["model"]["end_of_word_suffix"] != "</w>" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in shape["added_tokens"]):
            raise ValueError("only a tokenizer that composes, lower-cases and cuts words by the fixed pattern is taken")
        self.library = Tokenizer.from_str(spec)
        spaced = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, shape["pre_tokenizer"]["pretokenizers"][1]]}
        self.bare = Tokenizer.from_str(json.dumps(shape | {"normalizer": None, "added_tokens": [], "pre_tokenizer": spaced}))  # for words that are cut and lower-cased
        self.closes = np.zeros(max(shape["model"]["vocab"].values()) + 1, bool)
        self.closes[[i for k, i in shape["model"]["vocab"].items() if k.endswith("</w>")]] = True
        self.special = [t["content"].encode() for t in shape["added_tokens"]]
        self.find = re.compile(SPLIT).findall
        self.restart()

    def restart(self) -> None:
        none = np.zeros(0, np.int64)
        self.name, self.proof, self.runs, self.seen = none.astype(np.uint64), none.astype(np.uint64), Lists(none, np.zeros(0, np.uint32)), np.zeros(0, bool)
        self.number: dict[str, int] = {}  # of each word
        self.words = Lists(none, np.zeros(0, np.uint32))

    def learn_words(self, words: set[str]) -> None:
        """Many words go through the library as one text: each ends with its one id that ends a word."""
        new = list(words.difference(self.number))
        if new:
            coded = self.bare.encode_batch_fast([" ".join(new[i:i + JOINED]) for i in range(0, len(new), JOINED)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in coded), np.uint32)
            size = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
            if len(size) != len(new):
                raise ValueError("words and ids do not agree")
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.words = self.words.plus(Lists(size, ids))

    def of_runs(self, runs: list[bytes], latin: np.ndarray) -> Lists:
        """Ids of new runs."""
        if len(self.number) > CACHE_WORDS:
            self.number, self.words = {}, Lists(np.zeros(0, np.int64), np.zeros(0, np.uint32))
        find = self.find
        parts = [find(x.decode().lower()) if p else [] for x, p in zip(runs, latin.tolist())]
        flat = list(chain.from_iterable(parts))
        self.learn_words(set(flat))
        known = self.words.take(np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat)))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        size = np.zeros(len(runs), np.int64)
        np.add.at(size, np.repeat(np.arange(len(runs)), n), known.size)
        if latin.all():
            return Lists(size, known.ids)
        whole = self.library.encode_batch_fast([x.decode() for x, p in zip(runs, latin.tolist()) if not p], add_special_tokens=False)
        others = Lists(np.array([len(x.ids) for x in whole], np.int64), np.fromiter(chain.from_iterable(x.ids for x in whole), np.uint32))
        place = np.empty(len(runs), np.int64)
        place[latin], place[~latin] = np.arange(int(latin.sum())), int(latin.sum()) + np.arange(len(whole))
        return Lists(size[latin], known.ids).plus(others).take(place)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and how many each text has."""
        latin = self.latin(data, offsets)
        folded = np.where(np.repeat(latin, np.diff(offsets)), W.LOWER[data], data)
        runs = W.find_words(folded, offsets)
        row = runs.rows()
        if not len(row):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        name, proof = two_hashes(runs, latin[row])
        order = np.argsort(name, kind="stable")
        fresh = np.concatenate(([True], (name[order][1:] != name[order][:-1]) | (proof[order][1:] != proof[order][:-1])))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        one = order[fresh]  # a run of each kind
        at = np.minimum(np.searchsorted(self.name, name[one]), max(len(self.name) - 1, 0))
        known = (self.name[at] == name[one]) & (self.proof[at] == proof[one]) if len(self.name) else np.zeros(len(one), bool)
        new = one[~known]
        raw = folded.tobytes()
        coded = self.of_runs([raw[a:b] for a, b in zip(runs.starts[new].tolist(), runs.ends[new].tolist())], latin[row[new]])
        place = np.empty(len(one), np.int64)
        place[known], place[~known] = at[known], len(self.name) + np.arange(len(new))
        all_runs = self.runs.plus(coded)
        out = all_runs.take(place[number])
        per_row = np.bincount(row, out.size, len(offsets) - 1).astype(np.int64)
        self.seen[at[known]] = True
        self.remember(name[new], proof[new], all_runs, runs.ends[new] - runs.starts[new] <= LONG)
        return out.ids, per_row

    def remember(self, name: np.ndarray, proof: np.ndarray, all_runs: Lists, short: np.ndarray) -> None:
        """Keep the new runs that are short.  Where there are too many, those that have not come again go, or all."""
        keep = np.concatenate((np.ones(len(self.name), bool), short))
        if len(keep) > CACHE_RUNS:
            keep[:len(self.name)] = self.seen
            if 2 * keep.sum() > CACHE_RUNS:
                keep[:len(self.name)] = False
        name, proof, seen = np.concatenate((self.name, name)), np.concatenate((self.proof, proof)), np.concatenate((self.seen, np.zeros(len(name), bool)))
        order = np.flatnonzero(keep)
        order = order[np.argsort(name[order], kind="stable")]
        self.name, self.proof, self.seen, self.runs = name[order], proof[order], seen[order], all_runs.take(order)

    def latin(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts of characters below U+0250 without special strings, and without the separators that only Python takes for white space."""
        odd = (data >= 0xCA) | ((data >= 0x1C) & (data <= 0x1F))
        lead = np.flatnonzero(data == 0xC9)
        odd[lead] = data[np.minimum(lead + 1, len(data) - 1)] >= 0x90
        out = np.diff(np.concatenate(([0], np.cumsum(odd)))[offsets]) == 0
        raw = data.tobytes()
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = False
                at = raw.find(x, at + 1)
        return out


_PLACES = W.odd(2 * LONG, 11), W.odd(2 * LONG, 12)


def two_hashes(runs: W.Words, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent multilinear hashes of each run and its kind."""
    lengths = runs.ends - runs.starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    letters = runs.data[place + np.repeat(runs.starts, lengths)].astype(np.uint64) + np.uint64(1)
    out = []
    for i, table in enumerate(_PLACES):
        far = place >= len(table)
        factor = table[place % len(table)]
        if far.any():
            factor[far] = W.mix(place[far].astype(np.uint64) + np.uint64(1000 * i + 77)) | np.uint64(1)
        out.append(W.mix(np.add.reduceat(letters * factor, begin) + (2 * lengths + kind).astype(np.uint64)))
    return out[0], out[1]


_HELD: dict[int, WordIds] = {}  # one tokenizer for each Python worker


def pieces(docs: DataFrame, path: str, size: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: (key, piece, start, length, ids_crc32, part, nth), stored.

    ``nth`` counts the pieces of one length inside a task, ``part`` is the task.  Null and empty texts are one piece of the end id alone.
    """
    with open(path, encoding="utf-8") as file:
        spec = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = zlib.crc32(spec.encode())
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = WordIds(spec)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for low, high, data, offsets in W.chunks(batch.column(1), 1 << 20):
                ids, n = _HELD[name](data, offsets)
                whole = n + 1  # with the end id
                ends = np.cumsum(whole)
                full = np.full(int(ends[-1]), end_id, "<u4")
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                per = -(-whole // size)
                row = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                length = np.minimum(whole[row] - piece * size, size)
                raw, begin = memoryview(full.tobytes()), ends[row] - whole[row] + piece * size
                sums = [zlib.crc32(raw[4 * a:4 * (a + x)]) for a, x in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - first
                nth += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(length),
                                                  pa.array(sums, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)], [f.name for f in shape])

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    long = T.LongType()
    shape = T.StructType([T.StructField("key", slim.schema["key"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", long), T.StructField("length", long),
                          T.StructField("ids_crc32", long), T.StructField("part", T.IntegerType()), T.StructField("nth", long)])
    return store(slim.mapInArrow(run, shape), "pieces")


# -- the search -----------------------------------------------------------------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing of the counted lengths needs.

    For each k: lengths above size - k share a sequence with nothing of k or more, those above size / 2 not with each other, and what the rest of the lengths of k or
    more cannot put beside the middle ones needs sequences of its own.
    """
    size = len(counts) - 1
    lengths = np.arange(size + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * lengths)
    half = size // 2
    k = np.arange(half + 1)
    large, middle = n[size] - n[size - k], n[size - k] - n[half]
    room = middle * size - (total[size - k] - total[half])
    small = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return int((large + middle + np.maximum(0, -(-(small - room) // size))).max())


def best_fit(counts: np.ndarray) -> Plan:
    """Best-fit decreasing on counts: lengths from the largest, each into the fullest sequences with room."""
    size = len(counts) - 1
    open_: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(size + 1)]  # by room
    open_rooms: set[int] = set()
    done: Plan = []

    def put(filling, copies: int, room: int) -> None:
        if room and copies:
            open_[room].append((filling, copies))
            open_rooms.add(room)
        elif copies:
            done.append((filling, copies))

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in open_rooms if r >= length), default=0)
            filling, copies = open_[room].pop() if room else ((), left)
            if room and not open_[room]:
                open_rooms.discard(room)
            room = room or size
            each = min(room // length, left)
            whole = min(copies, left // each)
            put((*filling, (length, each)), whole, room - each * length)
            if room < size or filling:
                put(filling, copies - whole, room)
            left -= whole * each
    return done + [x for at in open_ for x in at]


def fillings(counts: np.ndarray, room: int, below: int, effort: int) -> list[tuple[int, ...]]:
    """Undominated sets of counted lengths, each at most ``below``, that fit into ``room``, fullest first.

    A set is dominated where an unused length could take the place of some of its members and fill more.  An exact single fit dominates all others.
    ``effort`` bounds the sets that are looked at; larger members come first.
    """
    have = counts.copy()
    if 0 < room <= below and have[room]:
        return [(room,)]
    sizes = np.flatnonzero(have)
    sizes = sizes[(sizes > 0) & (sizes <= min(below, room))][::-1].tolist()
    if not sizes:
        return [()]
    found: list[tuple[int, ...]] = []
    smallest, tried = sizes[-1], 0

    def undominated(chosen: tuple[int, ...], waste: int) -> bool:
        sums = {0}
        for x in chosen:
            sums |= {s + x for s in sums}
        return not any((have[s + 1:s + waste + 1] > 0).any() for s in sums if s <= below)

    stack = [((), room, 0)]
    while stack and tried < effort:
        chosen, left, start = stack.pop()
        tried += 1
        if left < smallest:
            if left == 0 or undominated(chosen, left):
                found.append(chosen)
                if left == 0 and len(found) > 8:
                    break
            continue
        fits = start + int(np.searchsorted(-np.array(sizes[start:]), -left)) if sizes[start] > left else start
        options = []
        for i in range(fits, len(sizes)):
            x = sizes[i]
            if have[x] > chosen.count(x):
                options.append(((*chosen, x), left - x, i))
            if len(options) >= 12:
                break
        if not options and undominated(chosen, left):
            found.append(chosen)
        stack += options[::-1]
    if not found:  # the effort was spent: larger members first, as many as fit
        chosen, left = [], room
        for x in sizes:
            while x <= left and have[x] > chosen.count(x):
                chosen.append(x)
                left -= x
        found = [tuple(chosen)]
    return sorted(set(found), key=lambda c: (room - sum(c), len(c), [-x for x in c]))


def search(counts: np.ndarray, branch: int, nodes: int, effort: int) -> tuple[int, Plan]:
    """The best plan that a depth-first search finds which takes the ``branch``-th filling at its first choice.

    Each node fills the largest length that is left; the filling is taken as often as the counts allow.  A node is cut off where the sequences so far
    and the lower bound of the rest are no fewer than the incumbent, which is best fit at first.
    """
    best = best_fit(counts)
    incumbent = sum(n for _, n in best)
    least = lower_bound(counts)
    size = len(counts) - 1
    root = counts.astype(np.int64)
    path: Plan = []
    left = nodes
    used = 0
    # A frame is (counts before the choice, choices not yet tried, sequences used before).
    frames: list[tuple[np.ndarray, list[tuple[tuple[tuple[int, int], ...], int]], int]] = []

    def choices(state: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        largest = int(np.flatnonzero(state)[-1])
        state[largest] -= 1
        sets = fillings(state, size - largest, largest, effort)
        state[largest] += 1
        out = []
        for extra in sets[:4]:
            members, times = np.unique((largest, *extra), return_counts=True)
            copies = int((state[members] // times).min())
            out.append((tuple(zip(members[::-1].tolist(), times[::-1].tolist())), copies))
        return out[::-1]

    state = root
    first = True
    while incumbent > least and left > 0:
        if not state.any():
            if used < incumbent:
                incumbent, best = used, list(path)
            options = []
        elif used + lower_bound(state) >= incumbent:
            options = []
        else:
            options = choices(state)
            if first:
                options, first = options[::-1][branch:branch + 1], False
        frames.append((state, options, used))
        while frames and not frames[-1][1]:
            frames.pop()
            if frames and path:
                path.pop()
        if not frames:
            break
        before, options, used_before = frames[-1]
        filling, copies = options.pop()
        state = before.copy()
        for x, times in filling:
            state[x] -= times * copies
        path.append((filling, copies))
        used = used_before + copies
        left -= 1
    return incumbent, best


def best_plan(spark: SparkSession, counts: np.ndarray, branches: int, nodes: int, effort: int) -> Plan:
    """The plan with the fewest sequences of a search whose first choices are dealt over tasks.  A plan has at most a few fillings for each length."""
    plan = best_fit(counts)
    if sum(n for _, n in plan) == lower_bound(counts):
        return plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for branch in batch.column(0).to_pylist():
                n, found = search(counts, branch, nodes, effort)
                rows = [(at, copies, x, times) for at, (filling, copies) in enumerate(found) for x, times in filling]
                yield pa.RecordBatch.from_arrays([pa.array([branch]), pa.array([n]), pa.array([np.array(rows, np.int64).tobytes()], pa.binary())], ["branch", "n", "plan"])

    row = spark.range(branches, numPartitions=branches).mapInArrow(run, "branch long, n long, plan binary").orderBy("n", "branch").first()
    plan, last = [], -1
    for at, copies, x, times in np.frombuffer(row["plan"], np.int64).reshape(-1, 4).tolist():
        if at != last:
            plan.append([(), copies])
            last = at
        plan[-1][0] = (*plan[-1][0], (x, times))
    return [(filling, copies) for filling, copies in plan]


def seats(plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Where ranks of a length go: sorted names (length, first rank) and rows (first rank, how many a sequence, first sequence, first offset)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, copies in plan:
        at = 0
        for length, times in filling:
            first = taken.get(length, 0)
            rows.append((length << 44 | first, first, times, sequence, at))
            taken[length] = first + times * copies
            at += length * times
        sequence += copies
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return rows[:, 0].copy(), rows[:, 1:].copy()


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", branches: int = 8, nodes: int = 4000, effort: int = 400) -> DataFrame:
    """All documents in as few sequences of at most ``size`` tokens as the search finds: one row for each piece.

    A document is its token ids and the end id; only longer ones are cut, into pieces of ``size`` tokens and a last, shorter one.  Returns (key, piece, start,
    length, ids_crc32, sequence_id, offset).  The pieces of a sequence lie one behind the other from offset 0.  Null and empty texts are one end id; repeated
    rows and rows without a key are documents like others; very long texts are cut like others; further columns are ignored; an empty table gives an empty one.

    ``branches``, ``nodes`` and ``effort`` bound the search, not the rows: the incumbent is a whole best-fit packing from the start.  The search ends early where
    it meets the lower bound.  What goes through the driver is one count for each length and the plan, both bounded by ``size``.  ``path`` is a tokenizer file as
    described in ``WordIds``; it is read on the driver.
    """
    rows = pieces(docs, path, size, end_id, key, text)
    tasks = rows.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    names, runs = seats(best_plan(docs.sparkSession, counts, branches, nodes, effort))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(tasks.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            first, times, sequence, at = runs[np.searchsorted(names, length << 44 | rank, "right") - 1].T
            copy, slot = np.divmod(rank - first, times)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + copy), pa.array(at + slot * length)], [f.name for f in shape])

    narrow = ranked.select("key", "piece", "start", "length", "ids_crc32", "rank")
    shape = T.StructType([*rows.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return narrow.mapInArrow(place, shape).withColumnRenamed("key", key)
