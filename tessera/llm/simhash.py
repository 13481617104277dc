"""Near-duplicate documents: SimHash fingerprints linked by an exact search in vantage-point trees.

A node of the tree holds a vantage fingerprint v and a radius r.  Fingerprints within r of v go inside, the others outside.  A pair within
``distance`` bits that the node separates has its inner end within ``distance`` of the boundary (triangle inequality), so that end is also
sent outside, as a query.  A query goes down every branch that the triangle bounds leave open.  The upper part of the tree, fitted on a
bounded sample, deals the fingerprints to shards; inside a shard the same rule goes on down to small leaves, where distances are counted.
The sample decides only how even the shards are: the search is exact for any tree.

Near duplicates are pairs of similar shingle sets.  Fingerprints of such pairs may differ in more bits than any radius allows, so a prefix-filter join on
the shingles finds, beside the trees, every pair that is similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import marks, rarity
from . import words as W
from .components import components
from .store import store

SEED = 42
LEAF = 192
PIECE = 1 << 15  # shingles hashed at a time
SAMPLE = 16_384  # fingerprints of which the upper tree is fitted
COUNTER_BITS = 22  # of the table of shingle counts: 16 MB, whatever the size of the corpus
BUCKET_SHINGLES = 2_000_000  # shingles of the corpus for each bucket
HELD = 1 << 20  # postings that a task gathers before it packs
SHARD = 20_000  # distinct fingerprints in a shard, about; fewer where the session has more shuffle partitions


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, repeats included, some at a time."""
    words = text.encode("utf-8", "replace").translate(bytes(W.LOWER)).split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[:max(1, len(words) - shingle + 1)].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + PIECE], ends[at:at + PIECE])], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted."""
    pieces = list(shingle_hashes(text or "", shingle))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)


def fingerprint_of(pieces: Iterator[np.ndarray]) -> int:
    """64-bit SimHash: bit i is set if more than half of the hashes have it set."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed long.  Null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x.as_py() or "", shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["key", "fp"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, T.StructType([T.StructField("key", slim.schema["key"].dataType), T.StructField("fp", T.LongType())]))


# Trees


def _vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Of a few spread points, the one whose median distance cuts most evenly; None if no cut separates the points."""
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = np.bitwise_count(points ^ v)
        r = int(np.partition(d, len(d) // 2)[len(d) // 2])
        for radius in (r - 1, r):
            inside = int((d <= radius).sum())
            near = int(((d > radius - 3) & (d <= radius)).sum())
            worth = min(inside, len(d) - inside) - near // 4
            if 0 < inside < len(d) and (best is None or worth > best[0]):
                best = (worth, v, radius)
    return best and best[1:]


def fit_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Upper tree as a table of nodes (vantage, radius, inner, outer); a child below 0 is shard -child - 1."""
    nodes: list = []
    shards = 0

    def grow(points: np.ndarray, share: int) -> int:
        nonlocal shards
        cut = _vantage(points) if share > 1 and len(points) >= 8 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        inside = np.bitwise_count(points ^ cut[0]) <= cut[1]
        nodes[at] = (int(cut[0]), cut[1], grow(points[inside], share // 2), grow(points[~inside], share - share // 2))
        return at

    grow(sample, leaves)
    return nodes


def deal(nodes: list, points: np.ndarray, distance: int, home: bool = True) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, places in points, whether they live there or only ask there)."""
    todo = [(0 if nodes else -1, np.arange(len(points)), home)]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -at - 1, rows, home
            continue
        v, radius, inner, outer = nodes[at]
        d = np.bitwise_count(points[rows] ^ np.uint64(v)).astype(np.int64)
        if home:
            todo += [(inner, rows[d <= radius], True), (outer, rows[d > radius], True), (outer, rows[(d <= radius) & (d > radius - distance)], False)]
        else:
            todo += [(inner, rows[d <= radius + distance], False), (outer, rows[d > radius - distance], False)]


def _pairs(points: np.ndarray, home: np.ndarray, ask: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within ``distance``: home with home, and home with ask, each at least once."""
    todo = [(home, ask)]
    while todo:
        home, ask = todo.pop()
        if not len(home) or len(home) + len(ask) < 2:
            continue
        cut = _vantage(points[home]) if len(home) > LEAF else None
        if cut is None:
            everyone = np.concatenate((home, ask))
            for at in range(0, len(everyone), 4 * LEAF):  # blocks, should no vantage point separate a large leaf
                for to in range(0, len(home), LEAF):
                    near = np.bitwise_count(points[everyone[at:at + 4 * LEAF], None] ^ points[None, home[to:to + LEAF]]) <= distance
                    a, b = np.nonzero(near)
                    a, b = everyone[at + a], home[to + b]
                    yield a[a != b], b[a != b]
            continue
        v, radius = cut
        dh, da = (np.bitwise_count(points[x] ^ v).astype(np.int64) for x in (home, ask))
        todo.append((home[dh <= radius], ask[da <= radius + distance]))
        todo.append((home[dh > radius], np.concatenate((ask[da > radius - distance], home[(dh <= radius) & (dh > radius - distance)]))))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each pair, and all that share a label with them, the smaller label.  ``labels`` are places of label owners."""
    while len(a):
        x, y = labels[a], labels[b]
        if (open_ := x != y).sum() == 0:
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def local_stars(points: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, smallest point of its local component) that connect what all pairs of the shard connect."""
    points, first = np.unique(points, return_inverse=True)
    lives = np.zeros(len(points), bool)
    np.logical_or.at(lives, first, home)
    labels = np.arange(len(points))
    for a, b in _pairs(points, np.flatnonzero(lives), np.flatnonzero(~lives), distance):
        join_labels(labels, a, b)
    far = np.flatnonzero(labels != np.arange(len(points)))
    return points[far], points[labels[far]]


def fingerprint_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints`` (fp): their components are those of all pairs within ``distance`` bits."""
    total = prints.count()
    leaves = max(total // SHARD, min(total // LEAF, SAMPLE // 16, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sample = prints.orderBy(F.xxhash64(F.col("fp"), F.lit(7)), "fp").limit(SAMPLE).toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    nodes = fit_tree(sample, leaves)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, rows, home in deal(nodes, points, distance):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), pa.array(points[rows].view(np.int64)), pa.array(np.full(len(rows), home))], ["shard", "fp", "home"])

    def search(shard: pa.Table) -> pa.Table:
        a, b = local_stars(shard["fp"].to_numpy().view(np.uint64), shard["home"].to_numpy(), distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.mapInArrow(send, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(search, "a long, b long")


def classes(docs: DataFrame, distance: int = 2, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): the class of each document, named by the smallest key that its links reach.

    Equal fingerprints are one node, so copies cost nothing in the search; fingerprints link at ``distance`` or fewer differing bits.
    Null and wordless texts have fingerprint 0 and link like any other.  A null key is never the name of a class that has another key.
    Repeated rows are kept as they are; further columns are ignored; an empty table gives an empty result.
    """
    mine = store(fingerprints(docs, shingle, key, text), "fingerprints")
    nodes = store(mine.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return mine.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


# Near duplicates by verified similarity


def _sketches(docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """(key, tag, fp, n): hash of the text (0 for all wordless texts), fingerprint of the different shingles and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, prints, sizes = batch.column(1).to_numpy().copy(), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            for i, value in enumerate(batch.column(2)):
                hashes = shingle_set(value.as_py(), shingle)
                prints[i], sizes[i] = fingerprint_of(iter([hashes])), len(hashes)
            tags[sizes == 0] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags), pa.array(prints.view(np.int64)), pa.array(sizes)], ["key", "tag", "fp", "n"])

    slim = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("tag"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, T.StructType([T.StructField("key", slim.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in ("tag", "fp", "n"))]))


def candidate_pairs(nodes: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of tags, some repeated, within ``distance`` bits whose shingle counts allow the similarity.  ``nodes`` has tag, fp, n (positive).

    Sets of similarity t differ in size by a factor of t at most, so nodes are parted by size first: each class is searched for itself and for the
    class below.  Inside, the vantage-point search is exact.
    """
    leaves = max(1, nodes.count() // SHARD)
    sample = nodes.orderBy(F.xxhash64("fp", F.lit(7)), "fp").select("fp").limit(SAMPLE).toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    tree = fit_tree(sample, leaves)
    step = -np.log(similarity)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags, points, n = (batch.column(c).to_numpy() for c in ("tag", "fp", "n"))
            points = points.view(np.uint64)
            level = np.floor(np.log(n) / step + 1e-9).astype(np.int64)
            for shard, rows, home in deal(tree, points, distance):
                yield _sent(level[rows], shard, tags[rows], points[rows], n[rows], home)
            for shard, rows, _ in deal(tree, points, distance, home=False):
                yield _sent(level[rows] + 1, shard, tags[rows], points[rows], n[rows], False)

    def search(group: pa.Table) -> pa.Table:
        tags, points, n, home = (group[c].to_numpy() for c in ("tag", "fp", "n", "home"))
        points, found = points.view(np.uint64), []
        for a, b in _pairs(points, np.flatnonzero(home), np.flatnonzero(~home), distance):
            ok = (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9) & (tags[a] != tags[b])
            found.append(np.stack([np.minimum(tags[a[ok]], tags[b[ok]]), np.maximum(tags[a[ok]], tags[b[ok]])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    shape = "level long, shard int, tag long, fp long, n long, home boolean"
    return nodes.select("tag", "fp", "n").mapInArrow(send, shape).groupBy("level", "shard").applyInArrow(search, "a long, b long")


def _sent(level: np.ndarray, shard: int, tags: np.ndarray, points: np.ndarray, n: np.ndarray, home: bool) -> pa.RecordBatch:
    columns = [level, np.full(len(level), shard, np.int32), tags, points.view(np.int64), n, np.full(len(level), home)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["level", "shard", "tag", "fp", "n", "home"])


_POSTING = np.dtype([("shingle", np.uint64), ("tag", np.int64), ("n", np.uint32), ("place", np.uint32)])


def shared_postings(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(shingle, tag, n, place): the shingles that texts (tag, text) share with others, of each text's prefix, which is rare shingles first.

    Sets of n shingles with the similarity have a shingle in common among the first n - ceil(similarity * n) + 1 of either, in any one order.
    """

    def hashes_of(column: pa.Array) -> Iterator[np.ndarray]:
        for value in column:
            yield shingle_set(value.as_py(), shingle)

    counts = rarity.count_hashes(texts.select("text"), hashes_of, COUNTER_BITS)
    buckets = max(16, int(counts.sum()) // BUCKET_SHINGLES)
    sent = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, 0x7FFFFFFF).astype(np.int32))  # fixed size

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = (W.mix(rows["shingle"]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((rows["shingle"], bucket))
        rows, bucket = rows[order], bucket[order]
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(rows))
        begins = np.concatenate(([0], ends[:-1]))
        parts = [zstandard.compress(b"".join(np.ascontiguousarray(rows[a:b][c]).tobytes() for c in _POSTING.names), 1) for a, b in zip(begins, ends)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array((ends - begins).astype(np.int32)), pa.array(parts, pa.binary())], ["bucket", "n", "packed"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for tag, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingle_set(value.as_py(), shingle)
                if not len(hashes):
                    continue
                first = np.lexsort((hashes, sent.value[rarity.slot(hashes, COUNTER_BITS)]))[:len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]
                rows = np.empty(len(first), _POSTING)
                rows["shingle"], rows["tag"], rows["n"], rows["place"] = hashes[first], tag, len(hashes), np.arange(len(first))
                held.append(rows)
                size += len(rows)
                if size >= HELD:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def shared(group: pa.Table) -> pa.Table:
        parts = []
        for n, raw in zip(group["n"].to_pylist(), group["packed"].to_pylist()):
            rows, raw, at = np.empty(n, _POSTING), zstandard.decompress(raw), 0
            for name in _POSTING.names:
                rows[name] = np.frombuffer(raw, _POSTING[name], n, at)
                at += n * _POSTING[name].itemsize
            parts.append(rows)
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["tag"], rows["shingle"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1])
        rows = rows[new]  # equal texts are one
        same = rows["shingle"][1:] == rows["shingle"][:-1]
        rows = rows[np.append(same, False) | np.append(False, same)]
        return pa.table({"shingle": rows["shingle"].view(np.int64) if len(rows) else pa.array([], pa.int64()), "tag": rows["tag"], "n": rows["n"].astype(np.int64), "place": rows["place"].astype(np.int64)})

    return texts.select("tag", "text").mapInArrow(post, "bucket long, n int, packed binary").groupBy("bucket").applyInArrow(shared, "shingle long, tag long, n long, place long")


def prefix_pairs(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of tags of ``texts`` (tag, text), a < b, among them all whose sets of shingles have the similarity.

    A common shingle counts if the sizes allow the similarity and if, with it as the first common one, enough shingles follow in both.  Pairs are
    formed by a plain equi join, whose large partitions adaptive execution splits.
    """
    held = store(shared_postings(texts, shingle, similarity), "postings")
    a, b = (held.select("shingle", F.col("tag").alias(x), F.col("n").alias(f"{x}_n"), (F.col("n") - F.col("place")).alias(f"{x}_left")) for x in "ab")
    sizes = F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-6
    follow = F.least("a_left", "b_left") * (1 + similarity) >= similarity * (F.col("a_n") + F.col("b_n")) - 1e-6
    return a.join(b, (a["shingle"] == b["shingle"]) & (F.col("a") < F.col("b")) & sizes & follow).select("a", "b")


def one_of_each(docs: DataFrame, shingle: int = 5, distance: int = 2, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest key, null last, then text hash.

    Texts link if the Jaccard similarity of their sets of ``shingle``-word shingles is at least ``similarity``; groups are connected components.  The trees
    propose the pairs whose fingerprints differ in at most ``distance`` bits, a prefix-filter join all others, so ``distance`` does not change the result.
    All wordless and null texts are one group.  Of rows equal in key and text one stays, whichever.
    All columns stay as they are, whatever their names.  An empty table gives an empty one; very long texts are read whole, one at a time.
    """
    mine = store(_sketches(docs, shingle, key, text), "sketches")
    nodes = store(mine.groupBy("tag", "fp", "n").agg(F.min(F.struct(F.col("key").isNull().alias("late"), "key")).alias("first")), "nodes")
    texts = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(F.col(text).cast("string")).alias("tag"), F.col(text).cast("string").alias("text"))
    near = candidate_pairs(nodes.filter("n > 0"), distance, similarity)
    pairs = store(near.unionByName(prefix_pairs(texts, shingle, similarity)).distinct(), "pairs")
    wanted = docs.sparkSession.sparkContext.broadcast(marks.table_of(pairs.select("a", "b")))  # fixed size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.bits(wanted.value)
        for batch in batches:
            for at in np.flatnonzero(bits[marks.place(batch.column(0).to_numpy())]).tolist():
                hashes = shingle_set(batch.column(1)[at].as_py(), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))], ["tag", "shingles"])

    whole = texts.mapInArrow(sets, "tag long, shingles array<long>").dropDuplicates(["tag"])
    a, b = (whole.select(F.col("tag").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    common = F.size(F.array_intersect("a_set", "b_set"))
    links = pairs.join(a, "a").join(b, "b").filter(common >= similarity * (F.size("a_set") + F.size("b_set") - common) - 1e-9).select("a", "b")
    roots = components(links)
    rooted = nodes.join(roots, nodes["tag"] == roots["node"], "left").select("tag", "first", F.coalesce("root", "tag").alias("root"))
    stay = rooted.groupBy("root").agg(F.min(F.struct("first", "tag")).alias("one")).select("one.first.key", "one.first.late", "one.tag")
    named = stay.select(F.col("key").alias("k"), F.col("tag").alias("t"))
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    mark = "__tag"
    while mark in docs.columns:
        mark += "_"
    rows = docs.withColumn(mark, F.when(words == 0, F.lit(0)).otherwise(F.xxhash64(F.col(text).cast("string"))))
    kept = rows.join(named, rows[key].eqNullSafe(named["k"]) & (rows[mark] == named["t"]), "left_semi")
    return kept.dropDuplicates([key, mark]).drop(mark)
