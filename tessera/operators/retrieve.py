"""Batch retrieval: lexical and vector top-k, documents of the hits, and search prompts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as T
from .scale import cut, skew_join, top_k

K1, B = 0.9, 0.4  # defaults of the lexical index
BLOCK, GROUP = 32, 128  # documents of a posting block, blocks of a group
QUERIES, FIRST = 1024, 8  # queries that are searched together; one group in so many is searched first
SLACK = 1e-9  # a bound and the score it bounds are added up in different orders
PLACES = 9  # scores are compared after rounding to so many decimal places
MOST_ROWS, TILE, FIRST_BALLS = 16_384, 256, 2  # vectors of a ball part, query rows that are multiplied at once, balls that give a block its floor
GRID, HELD = 6, 131_072  # groups of parts on a side of the grid, queries that a task holds at once


def tokens(c) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(T.col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, qid: str, qtext: str, did: str, dtext: str) -> DataFrame:
    """Best k documents per query by BM25, exact; queries with fewer matching documents get fewer rows.

    Postings of the query words are stored once, in groups of some ``BLOCK * GROUP`` documents of about the same length, a packed row for each (``posting_groups``).  Queries are packed rows as well, of about
    ``QUERIES`` each, and a task searches the queries of one row in the documents of another.  There, the largest weight of each word in each block of ``BLOCK``
    documents bounds the block for a query; only blocks whose bound reaches the query's floor are opened (``search_group``).  The floor is the k-th best score of
    one group in ``FIRST``, searched before the others, and rises as better documents are found.
    """
    terms = cut(_each_token(queries.select(F.col(qid).alias("_q"), tokens(qtext).alias("_t"))).groupBy("_q", "term").agg(F.count(F.lit(1)).alias("qf")))
    words = terms.select("term").distinct().withColumn("word", F.xxhash64("term"))  # query words are told apart by 64 bits
    groups, size = posting_groups(words, corpus, did, dtext)
    df = groups.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("word", F.ln(1 + (F.col("_N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one-row side
    weights = terms.join(words, "term").join(idf, "word").select("_q", "word", (F.col("qf") * F.col("idf")).alias("qw"))
    asked = cut(weights.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("word", "qw"))).alias("w")))
    early = F.pmod(F.xxhash64("group"), F.lit(FIRST)) == 0
    first = cut(searched(asked.withColumn("floor", F.lit(0.0)), groups.filter(early), k))
    floor = top_k(first, ["_q"], [F.desc("score")], k, "place").filter(F.col("place") == k).select("_q", F.col("score").alias("floor"))
    rest = searched(asked.join(floor, "_q", "left").fillna(0.0, ["floor"]), groups.filter(~early), k)
    total = first.unionByName(rest)
    return top_k(total, ["_q"], [F.desc(F.round("score", PLACES)), F.col("_d")], k).select(F.col("_q").alias(qid), F.col("_d").alias(did), "score", "rank")


def posting_groups(words: DataFrame, corpus: DataFrame, did: str, dtext: str) -> tuple[DataFrame, DataFrame]:
    """(groups, size): postings of the words in packed groups of documents, stored, and one row with the number of documents and their mean length.

    Documents of about the same length share a group, as their weights are alike.  Which group a document is in comes from its length and a hash of its id, so nothing is sorted
    across tasks; a length that very many documents have is as many groups as it needs.
    """
    docs = corpus.select(F.col(did).alias("_d"), tokens(dtext).alias("_t")).select("_d", F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"))
    # words outside the queries are one row for each document, so that documents without any query word are counted
    found = cut(docs.join(words, "term", "left").groupBy("_d", "dl", "word").agg(F.count(F.lit(1)).alias("tf")))
    shelf = F.floor(2 * F.log2(F.col("dl") + 1)).cast("long")
    shelves = cut(found.select("_d", "dl").distinct().groupBy(shelf.alias("_shelf")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")))  # at most 62 rows
    size = shelves.agg(F.sum("n").alias("_N"), (F.sum("words") / F.sum("n")).alias("_avg"))
    few = shelves.select("_shelf", F.ceil(F.col("n") / (BLOCK * GROUP)).alias("_groups")).crossJoin(size)
    posts = found.filter("word IS NOT NULL").withColumn("_shelf", shelf).join(F.broadcast(few), "_shelf")
    weight = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
    group = F.shiftleft("_shelf", 48) + F.pmod(F.xxhash64("_d"), F.col("_groups"))
    posts = posts.select(group.alias("group"), F.col("_d").cast("long").alias("d"), "dl", "word", weight.alias("w"))

    def pack(table: pa.Table) -> pa.Table:
        d, dl, word, w = (table.column(c).to_numpy() for c in ("d", "dl", "word", "w"))
        order = np.lexsort((word, d, dl))
        d, word, w = d[order], word[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        kinds, counts = np.unique(word, return_counts=True)
        binary = lambda x, t: pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary())
        return pa.table({"group": table.column("group").slice(0, 1), "words": pa.array([kinds.tolist()], pa.list_(pa.int64())), "counts": pa.array([counts.tolist()], pa.list_(pa.int64())),
                         "ids": binary(d[first], "<i8"), "first": binary(np.append(first, len(d)), "<i8"), "word": binary(np.searchsorted(kinds, word), "<i4"), "w": binary(w, "<f8")})

    return cut(posts.repartition(_tasks(posts), "group").groupBy("group").applyInArrow(pack, "group long, words array<long>, counts array<long>, ids binary, first binary, word binary, w binary")), size


@dataclass
class Group:
    """Documents of a group, ordered by length, with their postings and the largest weight of each word in each block."""

    ids: np.ndarray
    first: np.ndarray  # first posting of each document and the end
    word: np.ndarray  # place in the sorted words of the group
    w: np.ndarray
    block_first: np.ndarray  # of each word: where its blocks begin
    block: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, first: np.ndarray, word: np.ndarray, w: np.ndarray, words: int) -> Group:
        blocks = -(-len(ids) // BLOCK)
        code = word.astype(np.int64) * blocks + np.repeat(np.arange(len(ids)) // BLOCK, np.diff(first))
        order = np.argsort(code, kind="stable")
        code = code[order]
        cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        return Group(ids, first, word, w, np.searchsorted(code[cuts] // blocks, np.arange(words + 1)), code[cuts] % blocks, np.maximum.reduceat(w[order], cuts))


def search_group(group: Group, words: np.ndarray, weights: np.ndarray, dense: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, blocks opened) of the k best documents for one query, and of those that tie with them; documents under ``floor`` may be missing.

    ``words`` are places in the group's words, ``dense`` is a zeroed scratch array.  Blocks are opened by falling bound, a few at a time, until the next bound is below the floor.
    """
    spans = [np.arange(group.block_first[x], group.block_first[x + 1]) for x in words.tolist()]
    at = np.concatenate(spans)
    bound = np.bincount(group.block[at], group.most[at] * np.repeat(weights, [len(x) for x in spans]), -(-len(group.ids) // BLOCK))
    bound = bound * (1 + SLACK) + 2 * 10.0 ** -PLACES
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 2 * 10.0 ** -PLACES]
    dense[words] = weights
    ids, scores, opened = [], [], 0
    step = max(1, k // BLOCK + 1)
    while opened < len(order) and bound[order[opened]] >= floor:
        some = order[opened:opened + step]
        opened += len(some)
        docs = np.concatenate([np.arange(b * BLOCK, min((b + 1) * BLOCK, len(group.ids))) for b in some.tolist()])
        n = group.first[docs + 1] - group.first[docs]
        place = np.arange(int(n.sum())) + np.repeat(group.first[docs] - (np.cumsum(n) - n), n)
        score = np.bincount(np.repeat(np.arange(len(docs)), n), dense[group.word[place]] * group.w[place], len(docs))
        keep = score > 0
        ids.append(group.ids[docs[keep]])
        scores.append(score[keep])
        if sum(map(len, scores)) >= k:
            every = np.concatenate(scores)
            floor = max(floor, float(np.partition(every, len(every) - k)[len(every) - k]))
        step *= 2
    dense[words] = 0
    every, names = (np.concatenate(x) if x else np.zeros(0) for x in (scores, ids))
    keep = every >= floor - 2 * 10.0 ** -PLACES
    return names[keep].astype(np.int64), every[keep], opened


def searched(asked: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(_q, _d, score): the best documents of each group for each query (_q, w, floor)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / QUERIES)).alias("blocks")
    dealt = asked.crossJoin(F.broadcast(asked.agg(blocks)))  # one-row side
    packed = dealt.groupBy(F.pmod(F.xxhash64("_q"), F.col("blocks")).alias("_b")).agg(F.collect_list(F.struct("_q", "floor", "w")).alias("asked"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i] for c in batch.schema.names}
                words = np.array(at["words"].values)
                read = lambda c, t: np.frombuffer(at[c].as_py(), t)  # noqa: E731, B023
                group = Group.of(read("ids", "<i8"), read("first", "<i8"), read("word", "<i4"), read("w", "<f8"), len(words))
                dense, out = np.zeros(len(words)), []
                queries = at["asked"].values
                owner, floor, lists = queries.field("_q").to_pylist(), queries.field("floor").to_pylist(), queries.field("w")
                for j in range(len(owner)):
                    entry = lists[j].values
                    word, weight = np.array(entry.field("word")), np.array(entry.field("qw"))
                    place = np.minimum(np.searchsorted(words, word), len(words) - 1)
                    have = words[place] == word
                    if have.any():
                        ids, score, _ = search_group(group, place[have], weight[have], dense, k, floor[j])
                        out.append((np.full(len(ids), j), ids, score))
                if out:
                    j, ids, score = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([queries.field("_q").take(pa.array(j)), pa.array(ids), pa.array(score)], ["_q", "_d", "score"])

    pairs = packed.crossJoin(groups.drop("counts")).repartition(_tasks(groups), "_b", "group")  # query rows and groups, not queries and documents
    return pairs.mapInArrow(search, _hits(asked.schema["_q"].dataType))


def _tasks(df: DataFrame) -> int:
    """As many tasks as the session's shuffles have: rows that are small but dear are not put together by their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _hits(kind) -> StructType:
    return StructType([StructField("_q", kind), StructField("_d", LongType()), StructField("score", DoubleType())])


def _each_token(df: DataFrame) -> DataFrame:
    """One row per token of ``_t``.  The outer form keeps Spark from tokenising once more to test for empty arrays."""
    return df.select(*[c for c in df.columns if c != "_t"], F.explode_outer("_t").alias("term")).filter("term IS NOT NULL")


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, qid: str, qvec: str, did: str, dvec: str, block_rows: int | None = None) -> DataFrame:
    """Best k corpus vectors per query by inner product, exact.

    Corpus and queries lie in balls around centres from the corpus, as packed matrices of about ``block_rows`` vectors at most.  For queries and vectors of two balls the inner product is
    at most that of the middles plus what the radii add (Cauchy-Schwarz).  Each block of queries first meets the balls with the highest bounds, which gives the block a floor;
    of the others it meets those whose bound reaches the floor (``met``).  What meets is multiplied in Arrow tasks: a part goes once to each group of parts it meets, not once to each part.

    All vectors have the same dimension; rows without a vector are left out.  No vector passes through the driver.  The centres, one for each ball that is needed and 256 at most,
    are one row.  Where no bound helps, as for vectors without structure, every block meets every ball.
    """
    n = corpus.count()
    rows = block_rows or min(MOST_ROWS, max(4096, -(-n // 64)))
    n_balls = max(1, min(256, -(-n // rows)))
    sample = corpus.select(F.col(dvec).cast("array<double>").alias("v")).filter("v IS NOT NULL").distinct()
    centres = sample.orderBy(F.xxhash64("v")).limit(n_balls).agg(F.collect_list("v").alias("centres")) if n_balls > 1 else None
    sides = [df.select(F.lit(side).alias("side"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")) for side, df, key, vector in (("d", corpus, did, dvec), ("q", queries, qid, qvec))]
    packed = pack_balls(sides[0].unionByName(sides[1]).filter("v IS NOT NULL"), centres, rows)
    left, right = (packed.filter(F.col("side") == side).drop("side") for side in "qd")
    first, rest = meetings(left, right, k)
    found = first.select("q", "d", "score").unionByName(met(left, right, rest, k))
    return top_k(found, ["q"], [F.desc("score"), F.col("d")], k).select(F.col("q").alias(qid), F.col("d").alias(did), "score", "rank")


def pack_balls(vectors: DataFrame, centres: DataFrame | None, rows: int) -> DataFrame:
    """(side, ball, part, n, ids, matrix, centre, radius), stored: vectors (side, k, v) by their nearest centre, in parts of about ``rows``.

    ``centres`` is one row; without it all vectors are one ball.  A ball with many vectors, as one of equal ones is, is cut into parts by a hash of the key; a part has a middle and a radius of its own.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = None
        for batch in batches:
            if batch.num_rows:
                c = np.array(batch.column("centres")[0].as_py()) if c is None else c
                x = _matrix(batch.column("v"))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1))], ["side", "k", "v", "ball"])

    def pack(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v").combine_chunks())
        middle = x.mean(axis=0)
        radius = float(np.sqrt(((x - middle) ** 2).sum(1).max()))
        return pa.table({"side": table.column("side").slice(0, 1), "ball": table.column("ball").slice(0, 1), "part": table.column("part").slice(0, 1), "n": [len(x)], "ids": pa.array([table.column("k").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "matrix": pa.array([x.astype("<f8").tobytes()], pa.binary()), "centre": pa.array([middle.tolist()]), "radius": [radius]})

    slim = vectors.select("side", "k", "v")
    placed = slim.withColumn("ball", F.lit(0).cast("long")) if centres is None else cut(slim.crossJoin(F.broadcast(centres)).mapInArrow(nearest, "side string, k long, v array<double>, ball long"))  # one row on the other side
    parts = placed.groupBy("side", "ball").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    dealt = placed.join(parts, ["side", "ball"]).select("side", "k", "v", "ball", F.pmod(F.xxhash64("k"), F.col("parts")).alias("part"))
    return cut(dealt.groupBy("side", "ball", "part").applyInArrow(pack, "side string, ball long, part long, n long, ids binary, matrix binary, centre array<double>, radius double"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def meetings(left: DataFrame, right: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(best products of each block with its most promising balls, further pairs of parts that can hold one of the k best)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(dot(c, c))
    q, d = ([F.col(c).alias(a + c) for c in ("ball", "part", "n", "centre", "radius")] for a in "qd")
    pairs = left.select(*q, norm(F.col("centre")).alias("qnorm")).crossJoin(right.select(*d, norm(F.col("centre")).alias("dnorm")))  # parts, not vectors
    bound = dot(F.col("qcentre"), F.col("dcentre")) + F.col("qradius") * F.col("dnorm") + F.col("dradius") * F.col("qnorm") + F.col("qradius") * F.col("dradius")
    pairs = pairs.select("qball", "qpart", "qn", "dball", "dpart", bound.alias("bound"))
    tried = top_k(pairs, ["qball", "qpart"], [F.desc("bound"), F.col("dball"), F.col("dpart")], FIRST_BALLS, "place").drop("place")
    first = cut(products(left, right, tried, k))
    kth = top_k(first, ["q"], [F.desc("score")], k, "place").filter(F.col("place") == k)
    floor = kth.groupBy("qball", "qpart").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("have"))
    rest = pairs.join(tried.select("qball", "qpart", "dball", "dpart"), ["qball", "qpart", "dball", "dpart"], "left_anti").join(floor, ["qball", "qpart"], "left")
    enough = F.col("bound") + SLACK * (1 + F.abs("bound")) >= F.col("floor")
    every = F.when(F.col("have") == F.col("qn"), F.col("floor") - SLACK * (1 + F.abs("floor"))).alias("floor")
    return first, rest.filter(F.col("floor").isNull() | (F.col("have") < F.col("qn")) | enough).select("qball", "qpart", "dball", "dpart", every)


def products(left: DataFrame, right: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(qball, qpart, q, d, score): the k best of each pair of parts for each query."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
                a_ids, b_ids = np.frombuffer(at("q_ids"), "<i8"), np.frombuffer(at("d_ids"), "<i8")
                a, b = np.frombuffer(at("q_matrix"), "<f8").reshape(len(a_ids), -1), np.frombuffer(at("d_matrix"), "<f8").reshape(len(b_ids), -1)
                for low in range(0, len(a), TILE):
                    s = a[low:low + TILE] @ b.T
                    least = np.partition(s, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else s.min(axis=1)
                    row, col = np.nonzero(s >= least[:, None])
                    score = s[row, col]
                    order = np.lexsort((b_ids[col], -score, row))
                    row, col, score = row[order], col[order], score[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    n = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at("qball"))), pa.array(np.full(n, at("qpart"))), pa.array(a_ids[low + row[keep]]), pa.array(b_ids[col[keep]]), pa.array(score[keep])],
                                                     ["qball", "qpart", "q", "d", "score"])

    side = lambda df, a: df.select(F.col("ball").alias(f"{a}ball"), F.col("part").alias(f"{a}part"), F.col("ids").alias(f"{a}_ids"), F.col("matrix").alias(f"{a}_matrix"))
    met = pairs.join(side(left, "q"), ["qball", "qpart"]).join(side(right, "d"), ["dball", "dpart"])
    return met.repartition(_tasks(left), "qball", "qpart", "dball", "dpart").mapInArrow(multiply, "qball long, qpart long, q long, d long, score double")


class Best:
    """The k best vectors so far for each query of a part, by falling score, then id; scores under ``floor`` may be missing."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: float | None):
        self.ids, self.vectors, self.k, self.floor = ids, vectors, k, -np.inf if floor is None else floor
        self.score, self.name = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for low in range(0, len(self.ids), TILE):
            s = self.vectors[low:low + TILE] @ vectors.T
            least = np.maximum(self.score[low:low + TILE, -1], self.floor)
            free = np.flatnonzero(np.isneginf(least))
            if len(free) and len(ids) > self.k:
                least[free] = np.partition(s[free], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            row, col = np.nonzero(s >= least[:, None])
            some = np.unique(row)
            owner = np.concatenate((np.repeat(some, self.k), row))
            score, name = np.concatenate((self.score[low + some].ravel(), s[row, col])), np.concatenate((self.name[low + some].ravel(), ids[col]))
            order = np.lexsort((name, -score, owner))
            owner, score, name = owner[order], score[order], name[order]
            keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < self.k
            self.score[low + some], self.name[low + some] = score[keep].reshape(-1, self.k), name[keep].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.name[row, col]), pa.array(self.score[row, col])], ["q", "d", "score"])


def _grouped(parts: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """(ball, part, group) of parts in groups of about as many vectors, at most ``most`` and a part, and the number of groups."""
    n, vectors = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, min(n, max(GRID, -(-vectors // most) if most else 0)))
    before = F.coalesce(F.sum("n").over(W.orderBy("ball", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    return parts.select("ball", "part", F.floor(before * groups / max(1, vectors)).cast("int").alias("group")), groups


def met(left: DataFrame, right: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(q, d, score): of ``pairs`` of parts (qball, qpart, dball, dpart, floor), the k best of each cell for each query; products under a pair's floor may be missing.

    Query parts and corpus parts lie in groups, and a cell is two groups.  A task holds the queries of a cell with their best and reads the corpus parts one after the other, so that a part is
    sent once for each cell that needs it: at most ``GRID`` times, or vectors / ``HELD`` times where the queries are very many.
    """
    (q_groups, nq), (d_groups, nd) = _grouped(left, HELD), _grouped(right)
    of = lambda df, a: df.select(F.col("ball").alias(f"{a}ball"), F.col("part").alias(f"{a}part"), F.col("group").alias(f"{a}group"))
    placed = cut(pairs.join(of(q_groups, "q"), ["qball", "qpart"]).join(of(d_groups, "d"), ["dball", "dpart"]).withColumn("cell", F.col("qgroup") * nd + F.col("dgroup")).drop("qgroup", "dgroup"))
    asking = placed.groupBy("cell", F.col("qball").alias("ball"), F.col("qpart").alias("part")).agg(F.first("floor").alias("floor"))  # one floor for a query part
    asked = placed.groupBy("cell", F.col("dball").alias("ball"), F.col("dpart").alias("part")).agg(F.collect_list(F.struct("qball", "qpart")).alias("by"))
    queries = asking.join(left.select("ball", "part", "ids", "matrix"), ["ball", "part"]).withColumns({"side": F.lit(0), "by": F.lit(None)})
    vectors = asked.join(right.select("ball", "part", "ids", "matrix"), ["ball", "part"]).withColumns({"side": F.lit(1), "floor": F.lit(None)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
                ids = np.frombuffer(at("ids"), "<i8")
                matrix = np.frombuffer(at("matrix"), "<f8").reshape(len(ids), -1)
                if at("cell") != cell:
                    yield from (best.rows() for best in held.values())
                    cell, held = at("cell"), {}
                if at("side") == 0:
                    held[at("ball"), at("part")] = Best(ids, matrix, k, at("floor"))
                else:
                    for by in at("by"):
                        held[by["qball"], by["qpart"]].offer(ids, matrix)
        yield from (best.rows() for best in held.values())

    dealt = queries.unionByName(vectors).repartitionById(nq * nd, F.col("cell")).sortWithinPartitions("cell", "side", "ball", "part")
    return dealt.mapInArrow(search, "q long, d long, score double")


def attach_documents(hits: DataFrame, corpus: DataFrame, did: str, text: str) -> DataFrame:
    """Documents of the hits; the first line is the title, the rest the text."""
    docs = corpus.select(F.col(did).alias("_id"), F.col(text).alias("_x"))
    rows = skew_join(hits, docs, [(did, "_id")], hits.columns)
    title = F.substring_index("_x", "\n", 1)
    return (rows.withColumn("title", F.regexp_replace(title, '"', ""))
            .withColumn("contents", F.when(F.col("_x").contains("\n"), F.substring(F.col("_x"), F.length(title) + 2, F.length("_x"))).otherwise("")).drop("_id", "_x"))


def build_search_prompts(df: DataFrame, instruction: str, question: str, truth: Column, fallback: Column, source: Column) -> DataFrame:
    """Search tasks: instruction plus question, expected answer (or its fallback), tagged source and the tool's arguments."""
    gold = F.coalesce(truth, fallback)
    return df.select(
        F.concat(F.lit("searchR1_"), source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(instruction), F.col(question)).alias("content"))).alias("prompt"),
        F.struct(F.lit("rule").alias("method"), gold.alias("ground_truth")).alias("reward_spec"),
        F.struct(F.lit("search").alias("tool"), F.struct(gold.alias("ground_truth"), F.col(question).alias("question"), source.alias("data_source")).alias("create_kwargs")).alias("extra_info"))
