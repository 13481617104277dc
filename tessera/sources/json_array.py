"""Objects of huge top-level JSON arrays, read in parallel from ranges of one file.

Spark's text reader cuts files into ranges by itself.  With ``}`` as its line separator it yields pieces that end where an object can end, also from a file that is one
line.  Whether a piece begins inside a string, and how deep, depends on all that comes before, so there are two passes.  The first finds for each range what it does to
either state (outside a string or inside one): the state behind it, the change of depth, and the least depth in between.  These maps are composed along each file, which gives every
range its true state, depth and byte.  The second pass cuts the objects of each range; the parts of an object that crosses ranges are put together by the range it
began in.  Parsing is left to ``from_json``.  Memory is one batch and one object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import cut

QUOTE, BACKSLASH, OPEN, CLOSE = ord('"'), ord("\\"), ord("{"), ord("}")
DEPTH = np.zeros(256, np.int64)
DEPTH[[ord("{"), ord("[")]], DEPTH[[ord("}"), ord("]")]] = 1, -1
BETWEEN = np.zeros(256, bool)  # what may stand between the objects of an array
BETWEEN[[0x20, 0x09, 0x0A, 0x0D, ord(",")]] = True


def pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, start, size, piece) of all ranges; rows of a range come in order, one behind the other."""
    meta = F.col("_metadata")
    return (spark.read.option("lineSep", "}").text(paths)
            .select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("piece")))


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that belong to one range of one file."""
    start = batch.column("start").to_numpy()
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1
    edges = [0, *cuts.tolist(), len(start)]
    return zip(edges[:-1], edges[1:])


def joined(column: pa.Array) -> np.ndarray:
    """The pieces one behind the other, each with the separator that the reader has taken off."""
    whole = column.cast(pa.large_binary())
    _, ends, data = whole.buffers()
    offsets = np.frombuffer(ends, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    out = np.empty(len(raw) + len(whole), np.uint8)
    close = np.cumsum(np.diff(offsets) + 1) - 1
    text = np.ones(len(out), bool)
    text[close] = False
    out[text], out[close] = raw, CLOSE
    return out


def brackets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets, whether a string is open there (if none was at the beginning), and the number of quotes.

    A quote behind an odd run of backslashes belongs to its string.  Pieces begin behind a closing brace, so no run reaches across the beginning.
    """
    quotes = np.flatnonzero(data == QUOTE)
    slash = data == BACKSLASH
    if slash.any() and len(quotes):
        last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        before = np.where(quotes > 0, last_other[np.maximum(quotes - 1, 0)], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    places = np.flatnonzero(DEPTH[data])
    return places, np.searchsorted(quotes, places) % 2 == 1, len(quotes)


NONE = 1 << 40  # least depth of a range without brackets


def range_maps(rows: DataFrame) -> DataFrame:
    """One row for each range: its bytes, and for a beginning outside and inside a string the state behind it, the change of depth and the least depth.

    The closing brace at the very end is left out, as the file may end without it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n_bytes, state, depth, least = None, 0, [0, 1], [0, 0], [NONE, NONE]

        def done() -> Iterator[pa.RecordBatch]:
            if now:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, n_bytes, *state, *depth, *least)], names)

        for batch in batches:
            for low, high in runs(batch):
                part = batch.slice(low, high - low)
                this = tuple(part.column(c)[0].as_py() for c in ("file", "start", "size"))
                data = joined(part.column("piece"))
                n = len(data)
                if this != now:
                    yield from done()
                    now, n_bytes, state, depth, least = this, 0, [0, 1], [0, 0], [NONE, NONE]
                    data = data[:-1]
                else:
                    data = np.concatenate(([np.uint8(CLOSE)], data[:-1]))
                places, inside, quotes = brackets(data)
                steps = DEPTH[data[places]]
                n_bytes += n
                for s in (0, 1):
                    path = np.cumsum(steps[inside == bool(state[s])])
                    if len(path):
                        least[s] = min(least[s], depth[s] + int(path.min()))
                        depth[s] += int(path[-1])
                    state[s] = (state[s] + quotes) % 2
        yield from done()

    names = ["file", "start", "size", "n_bytes", "state0", "state1", "depth0", "depth1", "least0", "least1"]
    return rows.mapInArrow(run, "file string, start long, size long, n_bytes long, state0 long, state1 long, depth0 long, depth1 long, least0 long, least1 long")


def composed(maps: DataFrame) -> DataFrame:
    """State, depth and byte at the beginning of each range, the range in which an object that is open there began, and whether the file's array ends.

    A file is as many rows as it has ranges (one for some 128 MB).  An array is closed where the depth comes back to 0; what follows is not looked at.
    """

    def along(table: pa.Table) -> pa.Table:
        rows = table.sort_by("start").to_pylist()
        closes = sum(r["n_bytes"] for r in rows) == rows[-1]["size"]  # else the last brace is not there
        inside, depth, byte, opened, closed, out = 0, 0, 0, None, False, []
        for i, r in enumerate(rows):
            last = i == len(rows) - 1
            out.append({"file": r["file"], "start": r["start"], "size": r["size"], "inside": inside, "depth": depth, "byte": byte, "opened": r["start"] if opened is None else opened, "closed": closed,
                        "cut": last and not closes, "last": last})
            after, change, least = r[f"state{inside}"], r[f"depth{inside}"], r[f"least{inside}"]
            if after == 0 and (closes or not last):
                change -= 1
                least = min(least, change)
            closed = closed or depth + least <= 0
            opened = None if depth + change < 2 else r["start"] if opened is None or depth + least <= 1 else opened
            inside, depth, byte = after, depth + change, byte + r["n_bytes"]
        return pa.Table.from_pylist([x | {"ended": closed} for x in out], schema=shape)

    shape = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("inside", pa.int32()), ("depth", pa.int64()), ("byte", pa.int64()), ("opened", pa.int64()), ("closed", pa.bool_()),
                       ("cut", pa.bool_()), ("last", pa.bool_()), ("ended", pa.bool_())])
    return maps.groupBy("file").applyInArrow(along, "file string, start long, size long, inside int, depth long, byte long, opened long, closed boolean, cut boolean, last boolean, ended boolean")


@dataclass
class Cutter:
    """Cuts the bytes of one range into objects; a part that is not closed is held until more bytes come."""

    file: str
    inside: int
    depth: int
    byte: int
    closed: bool
    carried: bool  # the held part began in an earlier range
    held: list[bytes]
    held_byte: int = 0

    def fail(self, what: str, at: int) -> None:
        raise ValueError(f"{self.file}: {what} at byte {at}")

    def objects(self, data: np.ndarray) -> Iterator[tuple[int, bytes, bool]]:
        """(byte, text, whether it was carried in) of the objects that end in ``data``."""
        if self.closed:
            return
        begin = self.byte
        if begin == 0 and self.depth == 0:
            used = np.flatnonzero(~BETWEEN[data] | (data == ord(",")))
            if not len(used) or data[used[0]] != ord("["):
                self.fail("expected a top-level JSON array", int(used[0]) if len(used) else len(data))
        places, inside, quotes = brackets(data)
        places = places[inside == bool(self.inside)]
        after = self.depth + np.cumsum(DEPTH[data[places]])
        end = np.flatnonzero(after <= 0)
        limit = len(data)
        if len(end):  # the array is closed here
            limit, self.closed = int(places[end[0]]), True
            if data[limit] != ord("]"):
                self.fail("the array is closed by another bracket", begin + limit)
            places, after = places[:end[0]], after[:end[0]]
        starts = places[(after == 2) & (DEPTH[data[places]] > 0)]
        ends = places[(after == 1) & (DEPTH[data[places]] < 0)]
        wrong = starts[data[starts] != OPEN]
        if len(wrong):
            self.fail("expected an object", begin + int(wrong[0]))
        wrong = ends[data[ends] != CLOSE]
        if len(wrong):
            self.fail("an object is closed by another bracket", begin + int(wrong[0]))
        is_open = self.depth >= 2
        edge = np.zeros(limit + 1, np.int8)
        edge[starts] += 1
        edge[ends + 1] -= 1
        outside = np.cumsum(edge[:limit]) + is_open == 0
        bad = np.flatnonzero(outside & ~BETWEEN[data[:limit]])
        if begin == 0 and len(bad) and data[bad[0]] == ord("["):
            bad = bad[1:]
        if len(bad):
            self.fail("expected an object", begin + int(bad[0]))
        raw = data[:limit].tobytes()
        firsts = ([-1] if is_open else []) + starts.tolist()
        for s, e in zip(firsts, ends.tolist()):
            if s < 0:
                yield (self.held_byte, b"".join([*self.held, raw[:e + 1]]), self.carried)
                self.held, self.carried = [], False
            else:
                yield begin + s, raw[s:e + 1], False
        if len(firsts) > len(ends):
            s = firsts[-1]
            if self.closed:
                self.fail("an object is not closed", begin + limit)
            if s >= 0:
                self.held_byte, self.held = begin + s, []
            self.held.append(raw[max(s, 0):])
        self.byte += len(data)
        self.inside = (self.inside + quotes) % 2
        self.depth = int(after[-1]) if len(after) else self.depth


def objects(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(file, byte, object, part, opened): whole objects, and parts of objects that cross ranges with the range in which theirs began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, opened = None, None, 0

        def emit(found: list[tuple[str, int, bytes, int | None]]) -> Iterator[pa.RecordBatch]:
            if found:
                columns = zip(*[(f, at, None if o is not None else x, x if o is not None else None, o) for f, at, x, o in found])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["file", "byte", "object", "part", "opened"])

        def rest() -> Iterator[pa.RecordBatch]:
            if at and at.held:
                yield from emit([(at.file, at.held_byte, b"".join(at.held), opened if at.carried else now[1])])

        for batch in batches:
            for low, high in runs(batch):
                part = batch.slice(low, high - low)
                first = {c: part.column(c)[0].as_py() for c in part.schema.names if c != "piece"}
                if (first["file"], first["start"]) != now:
                    yield from rest()
                    now, opened = (first["file"], first["start"]), first["opened"]
                    at = Cutter(first["file"], first["inside"], first["depth"], first["byte"], first["closed"], first["depth"] >= 2, [], first["byte"])
                data = joined(part.column("piece"))
                if first["cut"] and at.byte + len(data) == first["size"] + 1:
                    data = data[:-1]  # the file does not end with the separator
                yield from emit([(at.file, byte, text, opened if carried else None) for byte, text, carried in at.objects(data)])
        yield from rest()

    return rows.drop("size").join(F.broadcast(states), ["file", "start"]).mapInArrow(run, "file string, byte long, object binary, part binary, opened long")


def read_json_array(spark: SparkSession, paths: str | list[str], schema: str, place: bool = False) -> DataFrame:
    """Objects of top-level JSON arrays, in parallel over ranges of each file.

    ``place`` adds the file and the byte at which each object begins (``_file``, ``_byte``).  Commas and white space between objects are skipped and what follows the closing bracket is
    not read.  Empty text, text that is no array, an element that is no object and an array that is cut off fail with the file and the byte; text inside an object
    that is not JSON, or not of the schema, fails the job when it is parsed.  Compressed files are read by one task each.

    The first pass over the files runs at once.  The states of the ranges, some 60 bytes for 128 MB of input, go to the tasks of the second pass.
    """
    rows = pieces(spark, paths)
    states = cut(composed(range_maps(rows)))
    files = rows.inputFiles()  # also those without a byte, which no task reads
    if len(files) > states.select("file").distinct().count():
        missing = sorted({f.replace("///", "/") for f in files} - {r.file.replace("///", "/") for r in states.select("file").distinct().collect()})
        raise ValueError(f"{missing[0]}: empty JSON document at byte 0")
    broken = states.filter("last AND NOT ended").select("file", "size").head()
    if broken:
        objects(rows.filter(F.col("file") == broken.file), states).write.format("noop").mode("overwrite").save()  # an earlier fault is told first
        raise ValueError(f"{broken.file}: unterminated JSON array at byte {broken.size}")
    found = objects(rows, states)
    parts = found.filter("opened IS NOT NULL").groupBy("file", "opened").agg(F.min("byte").alias("byte"), F.sort_array(F.collect_list(F.struct("byte", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"].cast("string")), "")
    whole = found.filter("opened IS NULL").select("file", "byte", F.col("object").cast("string").alias("text")).unionByName(parts.select("file", "byte", text.alias("text")))
    # A filter of the caller may be evaluated together with the filters above; parts have no ``object``, so that nothing but whole objects is parsed.
    parsed = whole.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("o"), F.col("file").alias("_file"), F.col("byte").alias("_byte"))
    return parsed.select("o.*", "_file", "_byte") if place else parsed.select("o.*")

