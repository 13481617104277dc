"""Ranked lexical search of a query set over all documents by branch and bound in frequency-pattern trees.

A document is restricted to the terms of the queries and written in the order of their corpus frequency, so that documents share the paths of a trie.  A node
holds, for each term below it, the largest tf, and the smallest m; the score of a document that had them all bounds every document of the subtree.  Each
query descends depth first, best bound first, and leaves out what cannot reach its best rows so far.  Documents that follow one path lie next to each
other, so a node is a range of documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import store

GAPS = np.zeros(256, bool)  # bytes outside the terms of the contract
GAPS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LEAF = 16  # documents that are scored one by one
TREE_ROWS, TREE_POSTINGS = 16_384, 3_000_000  # a tree is built when so much is gathered
BLOCK = 1_000_000  # term occurrences of the queries that are searched together
FLOOR_PART = 32  # one in so many documents is searched first, to give each query a floor
NO_KEY = np.iinfo(np.int64).max  # rows without a key come last among equal scores


def term_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, hashes of all terms, and the row of each (from the first)."""
    for low, high, data, offsets in W.chunks(column, 1 << 20):
        found = W.find_words(data, offsets, gaps=GAPS, fold=W.LOWER)
        yield low, high, found.hashes(), found.rows()


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary rows of consecutive 32-bit numbers; ``first`` has the first number of each row and the end."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(first * 4)), pa.py_buffer(np.ascontiguousarray(values, "<i4"))]).cast(pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and how many each row has."""
    whole = column.cast(pa.large_binary())
    _, ends, data = whole.buffers()
    offsets = np.frombuffer(ends, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw.view("<i4"), np.diff(offsets) // 4


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term, times) of all queries; ``item`` numbers the rows, stored so that it stays."""
    rows = store(items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("item_key"), F.col(text).cast("string").alias("text")), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, owner in term_rows(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(owner)), pa.array(hashes.view(np.int64))], ["item", "term"])

    terms = rows.select("item", "text").mapInArrow(run, "item long, term long").groupBy("item", "term").agg(F.count("*").alias("times"))
    return rows.select("item", "item_key"), store(terms, "query-terms")


def restricted(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, n, terms, tfs) of every document, stored: places in the sorted ``vocabulary`` and their occurrences as packed 32-bit numbers."""
    bits = 20
    maybe = np.zeros(1 << bits, bool)
    maybe[(vocabulary >> np.uint64(64 - bits)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, hashes, owner in term_rows(batch.column(1)):
                some = np.flatnonzero(maybe[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
                at = np.minimum(np.searchsorted(vocabulary, hashes[some]), len(vocabulary) - 1)
                hit = vocabulary[at] == hashes[some]
                codes, tfs = np.unique(owner[some][hit] << 32 | at[hit], return_counts=True)
                rows = codes >> 32
                first = np.searchsorted(rows, np.arange(high - low + 1))
                n = np.bincount(owner, minlength=high - low)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n.astype(np.int64)), packed(codes & 0xFFFFFFFF, first), packed(tfs, first)], ["key", "n", "terms", "tfs"])

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return store(slim.mapInArrow(run, "key long, n long, terms binary, tfs binary"), "restricted")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column(0))[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary of a block
        out[r["term"]] = r["n"]
    return out


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of tf occurrences gives in a document of m, before its weight; grows with tf and shrinks with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Tree:
    """Nodes as ranges of documents in path order; the children of a node are consecutive numbers.  Postings of documents and, by term, of nodes."""

    low: np.ndarray
    high: np.ndarray
    children: list[tuple[int, int]]  # empty for leaves
    row: np.ndarray  # input row of each document in path order
    start: np.ndarray  # first posting of each document
    term: np.ndarray
    value: np.ndarray  # saturation of each posting
    node_first: np.ndarray  # first node posting of each term, by term
    node: np.ndarray
    node_value: np.ndarray


def build(ranks: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, m: np.ndarray, vocabulary: int) -> Tree:
    """The tree of documents given by term ranks (ascending in each document, 0 the most frequent), tf, terms per document and m."""
    begin = np.cumsum(sizes) - sizes
    raw, ends = ranks.astype(">u4").tobytes(), begin + sizes
    paths = [raw[4 * s:4 * e] for s, e in zip(begin.tolist(), ends.tolist())]
    row = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
    paths = [paths[i] for i in row.tolist()]
    size = sizes[row]
    start = np.concatenate(([0], np.cumsum(size)))
    pick = np.arange(int(size.sum())) + np.repeat(begin[row] - start[:-1], size)
    term, tf, m = ranks[pick].astype(np.int64), tfs[pick].astype(np.int64), m[row]

    def shared(low: int, high: int, depth: int) -> int:
        a, b = paths[low], paths[high - 1]
        n = min(len(a), len(b)) // 4
        while depth < n and a[4 * depth:4 * depth + 4] == b[4 * depth:4 * depth + 4]:
            depth += 1
        return depth

    def branches(low: int, high: int, depth: int) -> list[tuple[int, int]]:
        """Ranges of the documents that agree on one term more; the first are those that end here."""
        out = []
        while low < high:
            head = paths[low][4 * depth:4 * depth + 4]
            a, b = low + 1, high
            while a < b:  # the range is sorted
                mid = (a + b) // 2
                if paths[mid][4 * depth:4 * depth + 4] == head:
                    a = mid + 1
                else:
                    b = mid
            out.append((low, a))
            low = a
        return out

    lows, highs, children, levels = [0], [len(paths)], [(0, 0)], [0]
    todo = [(0, 0)]
    while todo:
        at, depth = todo.pop()
        low, high = lows[at], highs[at]
        if high - low <= LEAF:
            continue
        parts, stack = [], [(low, high, depth)]
        while stack:  # a branch that holds most of the node is opened here: then each level is smaller by a factor
            a, b, d = stack.pop()
            d = shared(a, b, d)
            if max(len(paths[a]), len(paths[b - 1])) <= 4 * d:  # equal paths, which end here
                parts.append((a, b, d))
                continue
            for x, y in branches(a, b, d)[::-1]:
                if 4 * (y - x) > 3 * (high - low):
                    stack.append((x, y, d + 1))
                else:
                    parts.append((x, y, d + 1))
        parts.sort()
        groups: list[tuple[int, int, int]] = []
        for x, y, d in parts:  # small neighbours share a leaf
            if groups and y - groups[-1][0] <= LEAF:
                groups[-1] = (groups[-1][0], y, d)
            else:
                groups.append((x, y, d))
        if len(groups) == 1:  # equal paths: cut in halves
            half = (low + high) // 2
            groups = [(low, half, groups[0][2]), (half, high, groups[0][2])]
        children[at] = (len(lows), len(lows) + len(groups))
        for x, y, d in groups:
            todo.append((len(lows), d))
            lows.append(x)
            highs.append(y)
            children.append((0, 0))
            levels.append(levels[at] + 1)

    low, high, level = np.array(lows), np.array(highs), np.array(levels)
    least = np.minimum.reduceat(m, low) if len(low) == 1 else np.array([m[a:b].min() for a, b in zip(lows, highs)])
    owner = np.repeat(np.arange(len(size)), size)
    entries = []
    for depth in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level == depth)
        nodes = nodes[np.argsort(low[nodes])]
        at = np.searchsorted(low[nodes], owner, "right") - 1
        inside = (at >= 0) & (owner < high[nodes][at])
        code = term[inside] * len(low) + nodes[at[inside]]
        order = np.argsort(code, kind="stable")
        code, best = code[order], tf[inside][order]
        if len(code):
            cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            entries.append((code[cut], np.maximum.reduceat(best, cut)))
    code = np.concatenate([c for c, _ in entries]) if entries else np.zeros(0, np.int64)
    best = np.concatenate([b for _, b in entries]) if entries else np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    code, best = code[order], best[order]
    node = code % len(low)
    return Tree(low, high, children, row, start, term, saturation(tf, np.repeat(m, size)), np.searchsorted(code // len(low), np.arange(vocabulary + 1)), node, saturation(best, least[node]))


@dataclass
class Found:
    rows: list[tuple[int, int, int]]  # (score, -key, row) of the best documents
    scored: int  # documents whose score was computed


def descend(tree: Tree, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, keys: np.ndarray, k: int, floor: int) -> Found:
    """The k best documents of the tree for one query, by score and then key; below ``floor`` they may be left out.  ``dense`` is a zeroed scratch array."""
    spans = [(int(tree.node_first[t]), int(tree.node_first[t + 1]), int(w)) for t, w in zip(terms.tolist(), weights.tolist())]
    at = np.concatenate([np.arange(a, b) for a, b, _ in spans]) if spans else np.zeros(0, np.int64)
    if not len(at):
        return Found([], 0)
    bound = np.bincount(tree.node[at], tree.node_value[at] * np.repeat([w for *_, w in spans], [b - a for a, b, _ in spans]).astype(float), len(tree.low))
    dense[terms] = weights
    heap: list[tuple[int, int, int]] = []
    least, scored = max(1, floor), 0
    stack = [0]
    while stack:
        node = stack.pop()
        if bound[node] < least:
            continue
        first, end = tree.children[node]
        if first < end:
            below = bound[first:end]
            order = np.argsort(below, kind="stable")
            stack += (order[np.searchsorted(below[order], least):] + first).tolist()  # the best bound is opened first
            continue
        low, high = int(tree.low[node]), int(tree.high[node])
        a, b = int(tree.start[low]), int(tree.start[high])
        gained = np.concatenate(([0], np.cumsum(dense[tree.term[a:b]] * tree.value[a:b])))
        scores = np.diff(gained[tree.start[low:high + 1] - a])
        scored += high - low
        for i in np.flatnonzero(scores >= least).tolist():
            row = int(tree.row[low + i])
            entry = (int(scores[i]), -int(keys[row]), row)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == k:
                least = max(least, heap[0][0])
    dense[terms] = 0
    return Found(heap, scored)


@dataclass
class Queries:
    """A block of queries as ranks and weights, with the corpus figures that scores need."""

    items: np.ndarray
    first: np.ndarray  # first term of each query and the end
    rank: np.ndarray
    weight: np.ndarray
    rank_of: np.ndarray  # of each place in the vocabulary
    documents: int
    occurrences: int


def searched(rows: DataFrame, queries: Queries, k: int, floors: dict[int, int]) -> DataFrame:
    """(item, score, key, scored): the best rows of each tree for each query.  A task builds trees of bounded size one after the other."""

    def search(keys: list[pa.Array], n: list[np.ndarray], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key = pa.concat_arrays(keys)
        sizes = np.concatenate([s for *_, s in parts])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ranks = queries.rank_of[np.concatenate([t for t, *_ in parts])]
        order = np.lexsort((ranks, owner))
        m = 100 - 75 + 75 * np.concatenate(n) * queries.documents // max(queries.occurrences, 1)
        tree = build(ranks[order], np.concatenate([f for _, f, _ in parts])[order], sizes, m, len(queries.rank_of))
        tie = key.fill_null(int(NO_KEY)).to_numpy()
        dense = np.zeros(len(queries.rank_of), np.int64)
        out: list[tuple[int, int, int, int]] = []
        for i, item in enumerate(queries.items.tolist()):
            span = slice(int(queries.first[i]), int(queries.first[i + 1]))
            found = descend(tree, queries.rank[span], queries.weight[span], dense, tie, k, floors.get(item, 0))
            out += [(item, score, row, found.scored) for score, _, row in found.rows]
        if out:
            item, score, row, scored = map(np.array, zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), key.take(pa.array(row)), pa.array(scored)], ["item", "score", "key", "scored"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, parts, size, postings = [], [], [], 0, 0
        for batch in batches:
            terms, sizes = unpacked(batch.column("terms"))
            keys.append(batch.column("key"))
            n.append(batch.column("n").to_numpy())
            parts.append((terms.copy(), unpacked(batch.column("tfs"))[0].copy(), sizes))
            size, postings = size + batch.num_rows, postings + len(terms)
            if size >= TREE_ROWS or postings >= TREE_POSTINGS:
                yield from search(keys, n, parts)
                keys, n, parts, size, postings = [], [], [], 0, 0
        if size:
            yield from search(keys, n, parts)

    return rows.filter(F.length("terms") > 0).mapInArrow(run, "item long, score long, key long, scored long")


def best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each query by a BM25-like integer score: (item, rank, key, score), scores above 0 only.

    Terms are the longest runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased, told apart by a 64-bit hash.  Equal scores are ordered by
    key, rows without a key last; keys must be integers.  Null and empty texts have no terms: such documents are never found and such queries find nothing.
    Repeated rows are documents or queries of their own.  Very long texts are read in runs of bytes.  Further columns are ignored; empty tables give an empty one.

    Queries are searched in blocks of about a million term occurrences, each against all documents; a block and its vocabulary are what the driver holds.
    Documents are tokenised once for each block and stored as restricted vectors.  A first search over one in 32 documents gives each query a
    floor, which no document among its best can be below; the second search covers all documents.  A tree holds at most some 16,000 documents.
    """
    names, terms = query_terms(items, item, item_text)
    total = terms.agg(F.sum("times")).first()[0] or 0
    blocks = -(-total // BLOCK)
    spark, out = docs.sparkSession, None
    for b in range(blocks):
        block = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").toArrow()
        owner, term, times = (block.column(c).to_numpy() for c in ("item", "term", "times"))
        vocabulary, place = np.unique(term.view(np.uint64), return_inverse=True)
        rows = restricted(docs, vocabulary, key, text)
        df = document_frequencies(rows, len(vocabulary))
        figures = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
        weight = np.array([math.floor(1000 * math.log((2 * figures["documents"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        rank_of = np.empty(len(vocabulary), np.int64)
        rank_of[np.lexsort((vocabulary, -df))] = np.arange(len(vocabulary))
        ids, first = np.unique(owner, return_index=True)
        queries = Queries(ids, np.append(first, len(owner)), rank_of[place], weight[place] * times, rank_of, figures["documents"], figures["occurrences"])
        part = rows.filter(F.pmod(F.xxhash64("key", "n"), F.lit(FLOOR_PART)) == 0)
        floors = {r["item"]: r["score"] for r in best_rows(searched(part, queries, k, {}), k).filter(F.col("rank") == k).select("item", "score").collect()}
        found = best_rows(searched(rows, queries, k, floors), k).select("item", "rank", "key", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item long, rank int, key long, score long")
    return out.join(names, "item").select(F.col("item_key").alias(item), "rank", F.col("key").alias(key), "score")
