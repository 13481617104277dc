"""Homomorphic fingerprints of documents as multisets of paragraphs, in column expressions only.

A paragraph is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of two.  So the
order of paragraphs does not matter, and a paragraph is put in or taken out by one addition or subtraction (``merge``, ``take_out``).

The vector has two parts.  Eight lanes of 32 bits are hashes of the whole paragraph: they tell different multisets apart.  Sixty lanes of 31 bits count,
for each bit of the hash of each pair of neighbouring words in the paragraph, how often it is set; as sums of random signs they estimate the
inner product of two documents' word-pair counts, hence how alike they are.  Two of those lanes share a long.  A text has at most 2^31 bytes, so
at most 2^30 words: no lane of a whole text runs over.  Merged texts of more than 2^31 words together may: equality still holds, likeness does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DENSE = 8
SHIFTS = 30
FIELD = 31  # bits of a counting lane
LOW = (1 << 32) - 1
STRIDE, RUN = 8, 127  # hashes are first counted in runs, a byte for each bit: the highest byte holds 127 at most
BYTES = 0x0101010101010101
WRAP = (1 << 62) - 1
PARAGRAPH = "\\n"
GAP = r"[\x20\x09-\x0D]+"
SLABS = 4  # slices of the key range for each shuffle partition


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(paragraph: Column) -> Column:
    """Hashes of the neighbouring words of a paragraph, its ends included."""
    words = F.transform(F.array_remove(F.split(paragraph, GAP), ""), lambda w: F.xxhash64(w))
    return _once(words, lambda h: F.zip_with(h, F.array_prepend(h, F.lit(0).cast("long")), lambda a, b: F.xxhash64(a, b)))


def _runs(units: Column) -> Column:
    """For each run of ``RUN`` hashes: how often each bit is set, in ``STRIDE`` longs.  Bit ``STRIDE * i + j`` is counted in byte i of long j."""
    start = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(STRIDE)])
    step = lambda a, h: F.struct(*[(a[f"c{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(BYTES))).alias(f"c{j}") for j in range(STRIDE)])
    begins = F.when(F.size(units) > 0, F.sequence(F.lit(1), F.size(units), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return F.transform(begins, lambda i: F.aggregate(F.slice(units, i, F.lit(RUN)), start, step))


def _spread_out(run: Column) -> Column:
    """The counting lanes of a run, packed as in a fingerprint: lane j holds bit j and, ``FIELD`` bits up, bit j + FIELD."""
    bit = lambda b: F.shiftrightunsigned(run[f"c{b % STRIDE}"], STRIDE * (b // STRIDE)).bitwiseAND(F.lit(255).cast("long"))
    return F.array(*[bit(j) + F.shiftleft(bit(j + FIELD), FIELD) for j in range(SHIFTS)])


def fingerprint(text: Column) -> Column:
    """The fingerprint as longs: number of word pairs, dense lanes, packed counting lanes.  Null is an empty text, which has no paragraph."""
    paragraphs = F.array_remove(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), "")
    zero = F.lit(0).cast("long")

    def lane(p: Column, k: int) -> Column:
        return F.aggregate(p, zero, lambda a, x: (a + F.xxhash64(x, F.lit(k)).bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW)))

    def count(units: Column) -> Column:
        return F.concat(F.array(F.size(units).cast("long")), _once(_runs(units), lambda runs: F.aggregate(runs, F.array(*[zero] * SHIFTS), lambda a, run: F.zip_with(a, _spread_out(run), lambda x, y: x + y))))

    def whole(p: Column) -> Column:
        counted = _once(F.flatten(F.transform(p, _pairs)), count)
        return _once(counted, lambda c: F.concat(F.slice(c, 1, 1), F.array(*[lane(p, k) for k in range(DENSE)]), F.slice(c, 2, SHIFTS)))

    return _once(paragraphs, whole)


def _combine(a: Column, b: Column, sign: int) -> Column:
    place = lambda i: F.when(i == 0, F.lit((1 << 62) - 1)).when(i <= DENSE, F.lit(LOW)).otherwise(F.lit(WRAP))
    # Adding the modulus first keeps a difference from going below zero.
    both = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: (x["a"] + (x["b"] if sign > 0 else place(i) + 1 - x["b"])).bitwiseAND(place(i)))
    return both


def merge(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _combine(a, b, 1)


def take_out(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of ``a`` without those of ``b``, which ``a`` must hold."""
    return _combine(a, b, -1)


def signs(print_: Column) -> Column:
    """The counting lanes as sums of random signs, one double each."""
    packed = F.slice(print_, DENSE + 2, SHIFTS)
    lanes = F.flatten(F.transform(packed, lambda c: F.array(*[F.shiftrightunsigned(c, FIELD * i).bitwiseAND(F.lit((1 << FIELD) - 1)) for i in range(2)])))
    return F.transform(lanes, lambda x: (2 * x - F.get(print_, F.lit(0))).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Tanimoto likeness of the word-pair counts of two fingerprints, 0 to 1; equal fingerprints give exactly 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    def of(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        return _once(F.struct(dot(x, y).alias("xy"), dot(x, x).alias("xx"), dot(y, y).alias("yy")), lambda d: d["xy"] / F.nullif(d["xx"] + d["yy"] - d["xy"], F.lit(0.0)))
    guess = _once(F.struct(signs(a).alias("x"), signs(b).alias("y")), of)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(guess, F.lit(0.0)))))


def written(print_: Column) -> Column:
    """The fingerprint as lower-case hex."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(rows: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Each row with a struct ``next`` of ``columns`` of the row that follows it by ``key``, then ``order``; the last is followed by the first.

    The key range is cut into slabs at estimated quantiles, so that no window holds more than a slab.  The rows that begin a slab also go, as
    guests, to the end of the slab before: one shuffle of the rows is all.  Null keys come first.
    """
    spark = rows.sparkSession
    n = SLABS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    slab = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    begins = rows.select(key).withColumn("slab", slab).groupBy("slab").agg(F.min(F.col(key)).alias("begin"), F.bool_or(F.col(key).isNull()).alias("empty"))
    begins = begins.select("slab", F.when(F.col("empty"), F.lit(None)).otherwise(F.col("begin")).alias("begin"))
    in_order = W.orderBy("slab")  # a row for each slab
    begins = begins.withColumn("before", F.coalesce(F.lag("slab").over(in_order), F.last("slab").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))).drop("slab")
    placed = rows.withColumn("slab", slab)
    placed = placed.join(F.broadcast(begins), placed[key].eqNullSafe(begins["begin"]), "left").drop("begin")  # at most n rows
    homes = F.when(F.col("before").isNull(), F.array(F.struct(F.col("slab"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("slab"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("slab"), F.lit(True).alias("guest"))))
    dealt = placed.withColumn("home", F.explode(homes)).withColumns({"slab": F.col("home.slab"), "guest": F.col("home.guest")}).drop("home", "before")
    turn = W.partitionBy("slab").orderBy("guest", F.col(key).asc_nulls_first(), *order)
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(turn)).filter("NOT guest").drop("slab", "guest")


def edited_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) of each document and its edited text.

    The edited text has the last floor(n / 2) code points replaced by the first as many, or all, of the next document by key.  Null texts are
    empty.  Rows that share a key follow each other by the hash of their text; a null key comes first; a single document is its own next.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"tag": F.xxhash64("text"), "print": fingerprint(F.col("text"))})
    rows = with_next(rows, "key", ["text", "print"], ["tag"])
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.select("key", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited_text"),
                       F.col("print").alias("fingerprint"), F.col("next.print").alias("next_print"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    return rows.select(F.col("key").alias(key), "n_chars", "edited_text", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
