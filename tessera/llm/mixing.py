"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The document rates closest to one (in relative entropy, at most ``most``) that give each source its target of words are exponential tilts,
min(most, exp(lambda * size)).  A source's lambda solves one equation of the convex dual; all sources take their safeguarded Newton steps together, as
grouped sums over the classes of documents of one source and size.  The rates are then rounded: cumulatively from large classes to
small ones, and what is still missing is made up with the largest classes that fit.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scale import ranked
from .store import store

WORD = r"[\x20\x09-\x0D]+"
SPLIT = 4096  # hash buckets of one class


def targets(sources: DataFrame, weights: list[int], most: float) -> DataFrame:
    """(src, source, source_size, target): all words shared out by weight; a target stops at ``most`` times its source and the excess is shared again.

    Sources are numbered by code point, null last.  The level of words for each unit of weight rises until no share is above its stop.
    """
    known = store(ranked(sources, [F.col("source").asc_nulls_last()], name="src"), "sources")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights)).cast("int"))
    known = known.withColumns({"weight": weight, "stop": F.col("source_size") * float(most)})
    level = 0.0
    while True:
        below = F.col("stop") < level * F.col("weight")
        row = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(below, F.col("stop"))).alias("stopped"), F.sum(F.when(~below, F.col("weight"))).alias("open")).first()
        after = ((row["all"] or 0) - (row["stopped"] or 0.0)) / row["open"] if row["open"] else level
        if after <= level:
            return known.select("src", "source", "source_size", F.least("stop", level * F.col("weight")).alias("target"))
        level = after


def tilts(classes: DataFrame, most: float, rounds: int = 80) -> DataFrame:
    """(src, lam): the tilt of each source whose target is open.  ``classes`` has src, size (positive), n, target, scale."""
    z = F.col("size") / F.col("scale")
    state = classes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("have"), F.first("target").alias("target"), F.min(z).alias("least"))
    low = F.when(F.col("target") < F.col("have"), F.log(F.col("target") / F.col("have")) / F.col("least")).otherwise(0.0)
    high = F.when(F.col("target") < F.col("have"), F.lit(0.0)).otherwise(F.lit(log(most)) / F.col("least"))
    state = store(state.select("src", F.lit(0.0).alias("lam"), low.alias("low"), high.alias("high"), F.lit(float("inf")).alias("gap")), "tilts")
    rate = F.exp(F.col("lam") * z)
    for _ in range(rounds):
        sums = classes.join(state, "src").groupBy("src", "lam", "low", "high").agg(
            (F.sum(F.col("n") * F.col("size") * F.least(F.lit(float(most)), rate)) - F.first("target")).alias("off"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * z * rate).otherwise(0.0)).alias("slope"), F.first("target").alias("target"))
        gap = F.abs("off") / (0.5 + 1e-9 * F.col("target"))
        sums = sums.withColumns({"low": F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") - F.col("off") / F.nullif("slope", F.lit(0.0))
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = store(sums.select("src", F.when(gap <= 1, F.col("lam")).otherwise(step).alias("lam"), "low", "high", gap.alias("gap")), "tilts")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= 1:
            break
    return state.select("src", F.round("lam", 10).alias("lam"))  # sums of doubles differ in their last bits from run to run


def copies(classes: DataFrame, most: int) -> DataFrame:
    """``classes`` (src, size, n, rate, target) with ``total``, the copies that each class gets together, never above most * n."""
    down = W.partitionBy("src").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)  # a row for each size, not for each document
    upto = F.round(F.sum(F.col("n") * F.col("rate")).over(down))
    rows = classes.withColumn("upto", upto).withColumn("total", F.greatest(F.lit(0), F.least(F.col("n") * most, (F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("src").orderBy(F.desc("size"))), F.lit(0.0))).cast("long")))).drop("upto")
    while True:
        rows = store(rows, "copies")
        left = rows.groupBy("src").agg((F.first("target") - F.sum(F.col("total") * F.col("size"))).alias("left"))
        room = F.when(F.col("left") > 0, F.col("n") * most - F.col("total")).otherwise(F.col("total"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left")) & (room > 0)
        pick = rows.join(left, "src").filter(fits).groupBy("src", "left").agg(F.max(F.struct("size", room.alias("room"))).alias("best"))
        m = F.least(F.floor(F.abs("left") / F.col("best.size")), F.col("best.room")) * F.signum("left")
        pick = store(pick.select("src", F.col("best.size").alias("size"), m.cast("long").alias("more")), "picks")
        if pick.isEmpty():
            return rows
        rows = rows.join(pick, ["src", "size"], "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0))).drop("more")


def mix(docs: DataFrame, weights: list[int] = [1, 2, 3], most: int = 3, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size, source_size, target, rate, copies, taken) for each document.

    ``size`` counts the words of the text (null: none).  Sources share all words by ``weights``, repeated in code-point order with null last; targets stop at
    ``most`` times their source.  ``copies`` is at most ``most`` and ``taken`` is copies times size; a source's taken words miss its target by
    less than its smallest document where larger ones leave room.  Choices follow hashes of the keys, so reruns agree.  Wordless
    documents keep one copy.  Repeated rows are documents of their own; an empty table gives an empty result; further columns are ignored.
    """
    slim = store(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
                             F.coalesce(F.size(F.array_remove(F.split(F.col(text).cast("string"), WORD), "")), F.lit(0)).cast("long").alias("size")), "sizes")
    slim = slim.withColumn("size", F.greatest("size", F.lit(0).cast("long")))
    known = store(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    rows = slim.join(known.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sizes = store(rows.groupBy("src", "size").agg(F.count("*").alias("n"), F.first("target").alias("target"), F.first("source_size").alias("source_size")), "classes")
    open_ = F.col("target") < F.col("source_size") * float(most)
    scale = sizes.groupBy("src").agg(F.max("size").alias("scale"))
    solved = tilts(sizes.filter(open_ & (F.col("size") > 0)).join(scale, "src"), most)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(open_, F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))).otherwise(F.lit(float(most)))
    done = copies(sizes.join(scale, "src").join(solved, "src", "left").withColumn("rate", rate).select("src", "size", "n", "rate", "target"), most)
    done = done.select("src", "size", "rate", F.floor(F.col("total") / F.col("n")).alias("base"), (F.col("total") % F.col("n")).alias("extra"))
    # Which documents of a class get one copy more: the first by hash, found bucket by bucket, so that a class of any size is never in one task.
    rows = rows.withColumn("h", F.xxhash64("key", "size")).withColumn("b", F.pmod("h", F.lit(SPLIT)))
    of_class = W.partitionBy("src", "size").orderBy("b")
    buckets = rows.groupBy("src", "size", "b").agg(F.count("*").alias("here")).withColumn("upto", F.sum("here").over(of_class.rowsBetween(W.unboundedPreceding, 0)))
    buckets = buckets.join(done, ["src", "size"]).withColumn("open", F.greatest(F.lit(0), F.least(F.col("here"), F.col("extra") - F.col("upto") + F.col("here"))))
    rows = rows.join(buckets.select("src", "size", "b", "rate", "base", "open"), ["src", "size", "b"])
    rank = F.row_number().over(W.partitionBy("src", "size", "b").orderBy("h", "key"))
    n = F.col("base") + (rank <= F.col("open")).cast("long")
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "rate", n.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
