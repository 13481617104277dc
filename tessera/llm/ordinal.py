"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight vector scores a text and ordered thresholds cut the score into grades: P(grade <= j) = sigmoid(threshold_j - score).  The score thus gives an
expected grade, and for each grade the probability of it or a better one.  Features are the words of the text, their beginnings and a few of its shapes, each present or
absent, hashed to ``SLOTS`` weights.  The model is fitted on a bounded sample of rated rows, and every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

BITS = 20
SLOTS = 1 << BITS
MAX_RATED = 10_000  # rated rows that are fitted on, about; more are thinned evenly by the hash of their key
MIN_ROWS = 3  # rows in which a feature must be present
MIN_Z = 3.0  # how clearly a feature must shift the mean rating, in standard errors
PENALTY = 2e-4
STEPS = 400

STEMS = (4, 5, 6, 7)  # bytes at the beginning of longer words, as features beside the words

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_SHAPES = W.odd(4 * 8, 9).reshape(4, 8)  # a hash for each shape and share


def _slots(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows and slots of all features that are present, with repeats."""
    hashes, rows, n = found.hashes(), found.rows(), len(found.first) - 1
    size = np.maximum(np.diff(found.first), 1)
    last, before = found.data[found.ends - 1], found.data[np.maximum(found.ends - 2, 0)]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    bare = _PUNCTUATION[last] & (found.ends - found.starts == 1)
    tail = _PUNCTUATION[last] & _PUNCTUATION[before] & (found.ends - found.starts > 1)
    digit = (last >= 48) & (last <= 57)
    shape_rows, shape_hashes = [], []
    for i, flag in enumerate((again, bare, tail, digit)):
        share = np.bincount(rows[flag], minlength=n) / size
        level = np.searchsorted([0.0, 0.01, 0.03, 0.1, 0.3, 0.6], share)  # none, up to 1 %, ...
        shape_rows.append(np.flatnonzero(level))
        shape_hashes.append(_SHAPES[i][level[level > 0]])
    part_rows, part_hashes = [], []
    for length in STEMS:
        long = np.flatnonzero(found.ends - found.starts > length)
        starts = found.starts[long]
        part_rows.append(rows[long])
        part_hashes.append(W.mix(W.Words(found.data, starts, starts + length, found.first, found.offsets).hashes() ^ np.uint64(length)))
    hashed = np.concatenate([hashes, *shape_hashes, *part_hashes])
    return np.concatenate([rows, *shape_rows, *part_rows]), (hashed >> np.uint64(64 - BITS)).astype(np.int64)


def _features(column: pa.Array, only: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, and the distinct (row, slot) of each chunk; of the slots in ``only`` where given."""
    for low, high, data, offsets in W.chunks(column):
        rows, slots = _slots(W.find_words(data, offsets, fold=W.LOWER))
        if only is not None:
            rows, slots = rows[only[slots]], slots[only[slots]]
        both = np.unique(rows * SLOTS + slots)
        yield low, high, both // SLOTS, both % SLOTS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(parts: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> Model:
    """Penalised maximum likelihood over features that shift the rating clearly, by gradient steps with momentum and scaling.

    ``parts`` list, for some rows after the others, how many features each row has and the slots of all.  Thresholds start at the smoothed shares of the grades and stay ordered.
    """
    n = len(grades)
    share = (np.bincount(grades, minlength=n_grades) + 0.5) / (n + 0.5 * n_grades)
    upto = np.clip(np.cumsum(share)[:-1], 1e-6, 1 - 1e-6)
    thresholds = np.log(upto / (1 - upto))
    weights = np.zeros(SLOTS)
    if not n:
        return Model(weights, thresholds)
    seen, shift, at = np.zeros(SLOTS), np.zeros(SLOTS), 0
    off = grades - grades.mean()
    for lengths, slots in parts:
        seen += np.bincount(slots, minlength=SLOTS)
        shift += np.bincount(slots, np.repeat(off[at:at + len(lengths)], lengths), minlength=SLOTS)
        at += len(lengths)
    z = shift / np.sqrt(np.maximum(seen, 1)) / max(grades.std(), 1e-9)
    use = np.flatnonzero((seen >= MIN_ROWS) & (np.abs(z) >= MIN_Z))
    place = np.full(SLOTS, -1)
    place[use] = np.arange(len(use))
    rows, cols, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for lengths, slots in parts:
        kept = place[slots] >= 0
        rows.append(np.repeat(np.arange(at, at + len(lengths)), lengths)[kept])
        cols.append(place[slots[kept]])
        at += len(lengths)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    gaps = np.log(np.diff(thresholds))  # thresholds are the first and positive gaps
    value = np.concatenate((np.zeros(len(use)), thresholds[:1], gaps))
    speed, spread = np.zeros_like(value), np.zeros_like(value)
    k = len(use)
    for t in range(1, STEPS + 1):
        cut = np.concatenate((value[k:k + 1], value[k] + np.cumsum(np.exp(value[k + 1:]))))
        score = np.bincount(rows, value[cols], minlength=n)
        below = 1 / (1 + np.exp(-np.clip(np.concatenate(([-50.0], cut, [50.0]))[None, :] - score[:, None], -50, 50)))
        low, high = below[np.arange(n), grades], below[np.arange(n), grades + 1]
        slope = below * (1 - below)
        likely = np.maximum(high - low, 1e-12)
        by_score = (slope[np.arange(n), grades + 1] - slope[np.arange(n), grades]) / likely  # of minus log likelihood
        by_cut = np.zeros(len(cut))
        for j in range(len(cut)):
            by_cut[j] = (np.where(grades == j + 1, slope[:, j + 1] / likely, 0) - np.where(grades == j, slope[:, j + 1] / likely, 0)).sum()
        by_gap = np.array([by_cut[j + 1:].sum() for j in range(len(cut) - 1)]) * np.exp(value[k + 1:])
        grad = np.concatenate((np.bincount(cols, by_score[rows], minlength=k) / n + PENALTY * value[:k], [by_cut.sum() / n], by_gap / n))
        speed = 0.9 * speed + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad ** 2
        value -= 0.1 * (speed / (1 - 0.9 ** t)) / (np.sqrt(spread / (1 - 0.99 ** t)) + 1e-8)
    weights[use] = value[:k]
    return Model(weights, np.concatenate((value[k:k + 1], value[k] + np.cumsum(np.exp(value[k + 1:])))))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, key: str = "doc_id", text: str = "text", rating: str = "grade", max_rated: int = MAX_RATED) -> Model:
    """Fit on the rated documents; of more than ``max_rated`` ratings those are taken whose key has a small hash.

    Features are hashed where the texts are; the driver gets slots of about ``max_rated`` rows at most, never texts.
    """
    rated = ratings.filter(F.col(key).isNotNull() & F.col(rating).between(0, n_grades - 1)).groupBy(key).agg(F.min(rating).cast("int").alias("grade"))
    count = rated.count()
    if count > max_rated:
        rated = rated.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 40)) < int((1 << 40) * max_rated / count))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(rated.withColumnRenamed(key, "key")), "key").select("text", "grade")  # at most about max_rated short rows

    def hash_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, at, slots in _features(batch.column(0)):
                lengths = np.bincount(at, minlength=high - low)
                yield pa.RecordBatch.from_arrays([W.list_array(slots.astype(np.int32), lengths, pa.int32()), batch.column(1).slice(low, high - low)], ["slots", "grade"])

    got = rows.mapInArrow(hash_features, "slots array<int>, grade int").toArrow()
    parts = [(x.value_lengths().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)) for x in got["slots"].chunks]
    return fit(parts, got["grade"].to_numpy().astype(np.int64), n_grades)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with expected_grade and p_at_least, the probabilities of each grade from 1 on or a better one.

    Null and empty texts have no features and get what the thresholds alone say.  All columns of ``docs`` stay; two of these names are replaced.
    """
    used = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds))  # at most SLOTS weights
    keep = [f for f in docs.schema.fields if f.name not in ("expected_grade", "p_at_least")]
    place = [f.name for f in keep].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, thresholds = sent.value
        weights = np.zeros(SLOTS)
        weights[at] = values
        model = Model(weights, thresholds)
        known = weights != 0
        for batch in batches:
            for low, high, rows, slots in _features(batch.column(place), known):
                scores = np.bincount(rows, weights[slots], minlength=high - low)
                p = model.probabilities(scores)
                part = batch.slice(low, high - low)
                tails = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), p.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.sum(axis=1)), tails], [f"c{i}" for i in range(part.num_columns + 2)])

    shape = T.StructType([*keep, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_at_least", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in shape.fields]
    numbered = [f"c{i}" for i in range(len(names))]  # names in the plan must be plain and different
    shape = T.StructType([T.StructField(n, f.dataType) for n, f in zip(numbered, shape.fields)])
    return docs.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(keep, numbered)]).mapInArrow(run, shape).toDF(*names)


def grade(quality: Column, toxic: Column) -> Column:
    """Ratings of two judgements: 0 toxic, 1 poor, 2 good; null where nothing is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)
