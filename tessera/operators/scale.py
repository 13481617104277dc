"""Building blocks that keep exact results when one key holds a large share of the rows.

Three shapes recur in the operators: a global (or per-group) position, a running total, and a group statistic
attached to every row.  A plain window would put a whole group in one task, so each is built here from range
partitions, per-partition totals and salted joins instead.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
LOCAL_BITS = 33  # low bits of monotonically_increasing_id hold the row number inside a partition


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.  Where none is named, a private one, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tessera-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Store the columns as Parquet in the shared folder, so that every later read sees the same rows.  For narrow tables."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that sits in fewer input splits than there are cores, over all cores.

    For costly work per row on small tables.  A table with enough splits is returned as it is, without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [l.eqNullSafe(r) for l, r in zip(left, right)])


def with_group_stats(df: DataFrame, by: list[str], aggs: list[Column], spread: list[str] | None = None,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach aggregates of each group to its rows.

    The aggregates are combined map-side.  Groups over ``hot_rows`` (at most rows/hot_rows of them, which bounds the
    broadcast) are spread over several salts by a hash of ``spread``, the columns that tell rows of a group apart.
    """
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    stats = stats.withColumn("_fan", F.ceil(F.col("_rows") / hot_rows).cast("int"))
    hot = F.broadcast(stats.filter("_fan > 1").select(*[F.col(c).alias(f"_h_{c}") for c in by],
                                                      F.col("_fan").alias("_hfan")))
    rows = (df.join(hot, _same([df[c] for c in by], [hot[f"_h_{c}"] for c in by]), "left")
            .withColumn("_salt", F.coalesce(
                F.pmod(F.xxhash64(*(spread or df.columns)), F.col("_hfan").cast("long")), F.lit(0)).cast("int"))
            .drop("_hfan", *[f"_h_{c}" for c in by]))
    side = (stats.select(*[F.col(c).alias(f"_g_{c}") for c in by],
                         *[c for c in stats.columns if c not in by and c != "_fan"],
                         F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)).alias("_gsalt")))
    cond = _same([rows[c] for c in by], [side[f"_g_{c}"] for c in by]) & (rows["_salt"] == side["_gsalt"])
    return rows.join(side, cond, "inner").drop("_salt", "_gsalt", *[f"_g_{c}" for c in by])


def flag_members(df: DataFrame, key: str, members: DataFrame, flag: str) -> DataFrame:
    """Mark the rows whose ``key`` occurs in the one-column ``members``.

    A plain join: the session's size threshold decides on a broadcast, and adaptive execution splits a hot key's rows.
    """
    side = members.select(F.col(members.columns[0]).alias("_m")).distinct()
    return df.join(side, df[key] == side["_m"], "left").withColumn(flag, F.col("_m").isNotNull()).drop("_m")


def positions(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Add the exact 0-based position of each row under the total order ``order``.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the sizes of the
    partitions before (one row per partition, so the broadcast is bounded by the partition count).
    """
    slabs = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id()))
    slabs = (slabs.withColumn("_slab", F.shiftright("_mid", LOCAL_BITS).cast("int"))
             .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))).drop("_mid"))
    sizes = slabs.groupBy("_slab").agg((F.max("_loc") + 1).alias("_size"))
    before = (sizes.withColumn("_off", F.coalesce(
        F.sum("_size").over(W.orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("_slab", "_off"))
    return (slabs.join(F.broadcast(before), "_slab").withColumn(name, F.col("_off") + F.col("_loc"))
            .drop("_off", "_loc"))


def ranked(df: DataFrame, order: list, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Exact 1-based rank (row_number) under ``order``, inside each group of ``by`` when given."""
    if not by:
        return positions(df, order, "_pos").withColumn(name, F.col("_pos") + 1).drop("_slab", "_pos")
    placed = positions(df, [F.col(c) for c in by] + order, "_pos").drop("_slab")
    return (with_group_stats(placed, by, [F.min("_pos").alias("_first")], spread=["_pos"])
            .withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first", "_rows"))


def running_total(df: DataFrame, order: list, values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Inclusive running sums ``{name: value}`` under ``order``, inside each group of ``by`` when given."""
    by = by or []
    placed = positions(df, [F.col(c) for c in by] + order, "_pos")
    for i, value in enumerate(values.values()):
        placed = placed.withColumn(f"_v{i}", value)
    inner = W.partitionBy("_slab", *by).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    totals = placed.groupBy("_slab", *by).agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(values))])
    outer = W.partitionBy(*by).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("_slab").alias("_bs"), *[F.col(c).alias(f"_b_{c}") for c in by],
                           *[F.coalesce(F.sum(f"_t{i}").over(outer), F.lit(0)).alias(f"_o{i}")
                             for i in range(len(values))])
    out = placed.select("*", *[F.sum(f"_v{i}").over(inner).alias(f"_r{i}") for i in range(len(values))])
    cond = _same([out["_slab"]] + [out[c] for c in by], [before["_bs"]] + [before[f"_b_{c}"] for c in by])
    out = out.join(before, cond)
    for i, name in enumerate(values):
        out = out.withColumn(name, F.col(f"_r{i}") + F.col(f"_o{i}"))
    drop = [f"_{k}{i}" for i in range(len(values)) for k in "vro"]
    return out.drop("_slab", "_pos", "_bs", *drop, *[f"_b_{c}" for c in by])


def numbered(df: DataFrame, order: list, by: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Exact 0-based position of each row under ``order``, inside each group of ``by`` when given, for rows of any width.

    Only keys are sorted and stored: distinct keys with their counts, and the running total of the counts, which is where the rows of a key begin.  It comes
    back by a join on the keys, so that a row's content is read once and moved once.  Rows with equal keys get the positions of that key in any order.
    """
    by = by or []
    cols = [*by, *order]
    keys = [f"_k{i}" for i in range(len(cols))]
    rows = df.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, cols)})
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(counts, [F.col(k) for k in keys[len(by):]], {"_upto": F.col("_n")}, by=keys[:len(by)])
    side = upto.select(*[F.col(k).alias(f"_s{k}") for k in keys], (F.col("_upto") - F.col("_n")).alias("_first"))
    met = rows.join(side, _same([rows[k] for k in keys], [side[f"_s{k}"] for k in keys]))
    among = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0))) - 1  # the join has already dealt the rows by key
    return met.withColumn(name, F.col("_first") + among).drop("_first", *keys, *[f"_s{k}" for k in keys])


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows per group.  The rank filter lets Spark keep only k rows per group on the map side."""
    return (df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
            .filter(F.col(name) <= k))


def previous_row(df: DataFrame, order: list, cols: list[str], name: str = "prev") -> DataFrame:
    """Struct of ``cols`` from the row before, under one global order."""
    placed = positions(df, order, "_pos")
    here = F.struct(*cols)
    ends = placed.groupBy("_slab").agg(F.max_by(here, "_pos").alias("_end"))
    ends = ends.select("_slab", F.lag("_end").over(W.orderBy("_slab")).alias("_end"))
    inner = W.partitionBy("_slab").orderBy("_pos")
    return (placed.withColumn(name, F.lag(here).over(inner)).join(F.broadcast(ends), "_slab")
            .withColumn(name, F.coalesce(F.col(name), F.col("_end"))).drop("_slab", "_pos", "_end"))


def salted_join(rows: DataFrame, side: DataFrame, keys: list[tuple[str, str]], spread: list[str], how: str = "inner",
                fan: int = 8) -> DataFrame:
    """Equi join of many rows to a side that has few rows per key.  A key's rows are spread over ``fan`` tasks.

    ``keys`` pairs a column of ``rows`` with a column of ``side``; no name may occur on both sides.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(fan)).cast("int"))
    right = side.withColumn("_sidesalt", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    cond = reduce(lambda a, b: a & b, [left[l] == right[r] for l, r in keys]) & (left["_salt"] == right["_sidesalt"])
    return left.join(right, cond, how).drop("_salt", "_sidesalt")


def skew_join(rows: DataFrame, side: DataFrame, keys: list[tuple[str, str]], spread: list[str], how: str = "inner",
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi join to a side that may itself be large.  Only keys with more than ``hot_rows`` rows are salted.

    Rows are counted per key (map-side first); the hot keys, at most rows/hot_rows of them, are broadcast to both sides.
    Rows of a hot key are spread over as many salts as it needs and the matching side rows are copied that often; all
    other rows are joined as they are.  Rows without a key never match, so they are spread too.
    """
    lk, rk = [l for l, _ in keys], [r for _, r in keys]
    counts = rows.groupBy(*lk).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = counts.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(lk)], F.ceil(F.col("_n") / hot_rows).cast("int").alias("_fan"))
    names = [f"_h{i}" for i in range(len(lk))]

    def marked(df, cols):
        return df.join(F.broadcast(hot), reduce(lambda a, b: a & b, [df[c] == hot[h] for c, h in zip(cols, names)]), "left").drop(*names)

    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in lk])
    bucket = F.xxhash64(*spread)
    salt = F.when(empty, F.pmod(bucket, F.lit(1024))).when(F.col("_fan").isNotNull(), F.pmod(bucket, F.col("_fan").cast("long"))).otherwise(0)
    left = marked(rows, lk).withColumn("_salt", salt.cast("int")).drop("_fan")
    right = marked(side, rk).withColumn("_sidesalt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))).drop("_fan")
    cond = reduce(lambda a, b: a & b, [left[l] == right[r] for l, r in keys]) & (left["_salt"] == right["_sidesalt"])
    return left.join(right, cond, how).drop("_salt", "_sidesalt")
