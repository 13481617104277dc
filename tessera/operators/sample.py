"""Sampling, splitting, mixing, token quotas and packing.

Randomness is a seeded hash of the row key, so every choice is the same for any partitioning and any retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .scale import cut, numbered, ranked, running_total

def seeded_hash(key: list[str], seed: int | str) -> Column:
    return F.sha2(F.concat_ws(T.UNIT, F.lit(str(seed)), *[F.col(c).cast("string") for c in key]), 256)


def unit_interval(hex_digest: Column) -> Column:
    """First 32 bits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def hash_rank(df: DataFrame, key: list[str], seed: int, name: str = "rank", upto: int | None = None) -> DataFrame:
    """Exact 1-based rank under the seeded hash order.

    The leading 16 bits of the hash cut the rows into 65,536 even buckets; the bucket sizes (a bounded table) give each
    bucket its offset and only rows of one bucket are sorted together.
    """
    rows = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(
        W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rows = rows.join(F.broadcast(offsets), "_b")
    if upto is not None:
        rows = rows.filter(F.col("_off") < upto)
    local = F.row_number().over(W.partitionBy("_b").orderBy("_h", *key))
    return rows.withColumn(name, F.col("_off") + local).drop("_h", "_b", "_off")


def sample_k(df: DataFrame, k: int, seed: int, key: list[str]) -> DataFrame:
    """Uniform sample of exactly k rows (all rows when there are fewer)."""
    return hash_rank(df, key, seed, "_rk", upto=k).filter(F.col("_rk") <= k).drop("_rk")


def resample_to(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """Exactly n rows: every row n // len times, plus a random remainder without repeats.  ``copy`` numbers the repeats."""
    size = df.agg(F.count(F.lit(1)).alias("_len"))
    rows = hash_rank(df, key, seed, "_rk").crossJoin(F.broadcast(size))  # one-row side
    copies = F.floor(F.lit(n) / F.col("_len")).cast("int") + (F.col("_rk") <= n % F.col("_len")).cast("int")
    return (rows.withColumn("_c", copies).filter("_c > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c", "_rk", "_len"))


def train_val_split(df: DataFrame, ratio: float, seed: int, key: list[str]) -> DataFrame:
    """Adds ``split``.  For a ratio between 0 and 1 the validation part has max(int(n * ratio), 1) rows."""
    if ratio in (0, 1):
        return df.withColumn("split", F.lit("validation" if ratio else "train"))
    size = df.agg(F.greatest(F.floor(F.count(F.lit(1)) * F.lit(ratio)), F.lit(1)).alias("_val"))
    rows = hash_rank(df, key, seed, "_rk").crossJoin(F.broadcast(size))  # one-row side
    return (rows.withColumn("split", F.when(F.col("_rk") <= F.col("_val"), "validation").otherwise("train"))
            .drop("_rk", "_val"))


def take_skip_split(df: DataFrame, n: int, ratio: float, order: list) -> DataFrame:
    """First n rows in order; the first int(n * ratio) of them are the validation part."""
    val = int(n * ratio)
    rows = numbered(df, order, name="_p").filter(F.col("_p") < n)
    return rows.withColumn("split", F.when(F.col("_p") < val, "validation").otherwise("train")).drop("_p")


def concat(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def interleave(df: DataFrame, source: str, prob: dict[str, float], order: list[str], seed: int,
               stop: str = "first_exhausted") -> DataFrame:
    """Mix sources by probability.  Row i of a source sits at (i + jitter) / p, so draws follow the probabilities.

    ``first_exhausted`` ends at the source that runs out first; ``all_exhausted`` repeats short sources until the
    longest has been used up.  Adds ``mix_key`` (the order of the mixed stream) and ``round``.  A source without a probability fails
    the query; give it zero rows or a probability.
    """
    p = F.create_map(*[x for k, v in prob.items() for x in (F.lit(k), F.lit(v))])
    unknown = F.raise_error(F.concat(F.lit("no probability for source "), F.coalesce(F.col(source).cast("string"), F.lit("null"))))
    share = F.coalesce(F.try_element_at(p, F.coalesce(F.col(source), F.lit(""))), unknown.cast("double"))
    rows = numbered(df, order, [source], "_i")
    jitter = unit_interval(seeded_hash([source, *order], seed))
    rows = rows.withColumn("mix_key", (F.col("_i") + jitter) / share)
    ends = rows.groupBy(source).agg(F.max("mix_key").alias("_end"), F.count(F.lit(1)).alias("_n"))
    if stop == "first_exhausted":
        last = ends.agg(F.min("_end").alias("_stop"))
        return (rows.crossJoin(F.broadcast(last)).filter(F.col("mix_key") <= F.col("_stop"))  # one-row side
                .withColumn("round", F.lit(0)).drop("_i", "_stop"))
    last = ends.agg(F.max("_end").alias("_stop"))
    spans = ends.crossJoin(F.broadcast(last)).select(
        F.col(source).alias("_s"), (F.col("_n") / F.try_element_at(p, F.col(source))).alias("_span"), "_stop")
    rows = rows.join(F.broadcast(spans), F.col(source) == F.col("_s"))  # one row per entry of prob
    rounds = F.sequence(F.lit(0), F.floor(F.col("_stop") / F.col("_span")).cast("int"))
    return (rows.withColumn("round", F.explode(rounds))
            .withColumn("mix_key", F.col("mix_key") + F.col("round") * F.col("_span"))
            .filter(F.col("mix_key") <= F.col("_stop")).drop("_i", "_s", "_span", "_stop"))


def shuffle(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """Full shuffle: a range-partitioned sort by the seeded hash."""
    return df.orderBy(seeded_hash(key, seed), *key)


def shuffle_buffer(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """Bounded form: rows are permuted inside their partition only; nothing is exchanged."""
    return df.sortWithinPartitions(seeded_hash(key, seed), *key)


def bucket_lengths(c) -> Column:
    c = T.col(c)
    return F.when(c <= 2048, "0-2048").when(c <= 4096, "2049-4096").when(c <= 8192, "4097-8192")


def token_quotas(df: DataFrame, strata: list[str], length: str, target: int) -> DataFrame:
    """Available tokens and quota int(available * min(1, target / total)) per stratum."""
    per = df.groupBy(*strata).agg(F.sum(length).alias("available"), F.count(F.lit(1)).alias("candidates"))
    total = per.agg(F.sum("available").alias("_total"))
    ratio = F.least(F.lit(1.0), F.lit(float(target)) / F.col("_total"))
    return (per.crossJoin(F.broadcast(total))  # one-row side
            .withColumn("quota", F.floor(F.col("available") * ratio).cast("long")).drop("_total"))


def overflow_prefix(rows: DataFrame, strata: list[str], digest: str, length: str, quotas: DataFrame, few: int = 4096) -> tuple[DataFrame, int]:
    """(strata, quota, _prefix, _used) of the strata that overflow their quota, stored, and the length of the prefixes.

    ``_prefix`` begins the digest of the first row in digest order that overflows, ``_used`` is the sum of the lengths of all rows with smaller prefixes.  Each
    level adds up the rows below the prefixes found so far by two more digits and descends into the first sum that passes the quota.  It ends where at most ``few`` rows of a stratum share
    the prefix, or where the digest does.
    """
    path = quotas.withColumn("_prefix", F.lit("")).withColumn("_used", F.lit(0).cast("long"))
    depth = 0
    while True:
        depth += 2
        below = rows.join(path, strata).filter(F.substring(digest, 1, depth - 2) == F.col("_prefix"))
        sums = below.groupBy(*strata, "quota", "_used", F.substring(digest, 1, depth).alias("_next")).agg(F.sum(length).alias("_sum"), F.count(F.lit(1)).alias("_n"))
        upto = F.col("_used") + F.sum("_sum").over(W.partitionBy(*strata).orderBy("_next"))  # at most 256 rows of hexadecimal digits
        first = sums.withColumn("_upto", upto).filter(F.col("_upto") > F.col("quota")).groupBy(*strata).agg(F.min_by(F.struct("quota", "_next", (F.col("_upto") - F.col("_sum")).alias("_used"), "_n"), "_next").alias("_s"))
        path = cut(first.select(*strata, "_s.quota", F.col("_s._next").alias("_prefix"), "_s._used", "_s._n"))
        most = path.agg(F.max("_n")).first()[0]
        if (most or 0) <= few or depth >= 64:
            return path.drop("_n"), depth
        path = path.drop("_n")


def stratified_token_quota(df: DataFrame, strata: list[str], key: list[str], digest: str, length: str, target: int,
                           variant: str = "greedy") -> DataFrame:
    """Fill each stratum's token quota in digest order; a row that would overflow is skipped and filling goes on.

    Works for strata of any size.  Up to the first overflow the fill is all rows, and where that is is found by the token sums of digest prefixes
    (``overflow_prefix``); only the rows of one last prefix are sorted.  From there less than one row length R of the quota is left: of every length v only the first R // v rows can still fit (a rejected length stays
    rejected), so the sequential part sees at most R * (1 + 1/2 + ... + 1/R) rows per stratum.
    ``variant='prefix'`` stops at the first overflow.
    """
    slim = cut(df.select(*strata, *key, digest, F.col(length).cast("long").alias("_len")))  # lengths and digests are computed once
    quotas = cut(token_quotas(slim, strata, "_len", target).select(*strata, "quota"))
    path, depth = overflow_prefix(slim, strata, digest, "_len", quotas)
    met = slim.join(path, strata, "left")
    head = F.substring(digest, 1, depth)
    whole = met.filter(F.col("_prefix").isNull() | (head < F.col("_prefix"))).select(*strata, *key, digest, "_len")
    inside = met.filter(head == F.col("_prefix")).select(*strata, *key, digest, "_len", "_used", "quota")
    run = cut(running_total(inside, [F.col(digest)] + [F.col(c) for c in key], {"_run": F.col("_len")}, by=strata).withColumn("_run", F.col("_run") + F.col("_used")))
    within = run.filter(F.col("_run") <= F.col("quota"))
    prefix = whole.unionByName(within.select(*strata, *key, digest, "_len"))
    if variant == "prefix":
        return prefix.select(*strata, *key, digest, F.col("_len").alias(length))
    left = path.join(within.groupBy(*strata).agg(F.max("_run").alias("_end")), strata, "left").select(*strata, (F.col("quota") - F.coalesce("_end", "_used")).alias("_left"))
    beyond = met.filter(head > F.col("_prefix")).select(*strata, *key, digest, "_len").unionByName(run.filter(F.col("_run") > F.col("quota")).select(*strata, *key, digest, "_len"))
    rest = beyond.join(left, strata).filter(F.col("_len") <= F.col("_left"))
    placed = ranked(rest.select(*strata, *key, digest, "_len", "_left"), [F.col(digest)] + [F.col(c) for c in key],
                      [*strata, "_len"], "_rk")
    tail = placed.filter((F.col("_len") == 0) | (F.col("_rk") * F.col("_len") <= F.col("_left")))
    zero, tail = tail.filter("_len = 0"), tail.filter("_len > 0")
    shape = tail.select(*strata, *key, digest, "_len").schema

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([digest, *key], kind="stable")
        left, keep = int(pdf["_left"].iloc[0]), []
        for v in pdf["_len"]:
            keep.append(v <= left)
            left -= v if v <= left else 0
        return pdf.loc[keep, shape.names]

    filled = tail.groupBy(*strata).applyInPandas(fill, shape)
    return concat([prefix.select(*shape.names), zero.select(*shape.names), filled]).withColumnRenamed("_len", length)


def _best_fit(items: list[tuple], room: int) -> list[list[tuple]]:
    """Longest first, each into the fullest bin that still has room for it."""
    bins: list[list[tuple]] = []
    space: list[int] = []
    for item in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [(s, i) for i, s in enumerate(space) if s >= item[1]]
        if fits:
            at = min(fits)[1]
            bins[at].append(item)
            space[at] -= item[1]
        else:
            bins.append([item])
            space.append(room - item[1])
    return bins


def pack_sequences(df: DataFrame, key: str, length: str, max_len: int, shards: int, interval: int = 128) -> DataFrame:
    """Bins of total length at most ``max_len``.

    Rows are spread over ``shards`` by a hash of the key.  A shard is read in batches of ``interval``; the last bin of a
    batch stays open and joins the next batch.  Result: (shard, bin, slot, key, length, reason); a longer row is in no bin and
    has the reason ``too_long``.  State inside a task is one batch and one open bin.
    """
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    slim = (df.select(shard.alias("shard"), F.col(key).cast("long").alias("_k"), F.col(length).cast("long").alias("_l"))
            .repartition(shards, "shard").sortWithinPartitions("shard", "_k"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, waiting, fresh, number = None, [], 0, 0

        def emit(bins, sid):
            nonlocal number
            rows = []
            for b in bins:
                rows += [(sid, number, slot, k, v) for slot, (k, v) in enumerate(b)]
                number += 1
            return pd.DataFrame(rows, columns=["shard", "bin", "slot", "k", "len"]).assign(reason=None)

        for frame in frames:
            long = frame["_l"] > max_len
            if long.any():
                out = frame[long].rename(columns={"_k": "k", "_l": "len"})
                yield out.assign(bin=pd.array([None] * len(out), "Int64"), slot=pd.array([None] * len(out), "Int32"), reason="too_long")[["shard", "bin", "slot", "k", "len", "reason"]]
                frame = frame[~long]
            for sid, k, v in zip(frame["shard"], frame["_k"], frame["_l"]):
                if sid != current:
                    if waiting:
                        yield emit(_best_fit(waiting, max_len), current)
                    current, waiting, fresh, number = sid, [], 0, 0
                waiting.append((k, v))
                fresh += 1
                if fresh == interval:
                    bins = _best_fit(waiting, max_len)
                    yield emit(bins[:-1], current)
                    waiting, fresh = bins[-1], 0
        if waiting:
            yield emit(_best_fit(waiting, max_len), current)

    packed = slim.mapInPandas(pack, "shard int, bin long, slot int, k long, len long, reason string")
    return packed.withColumnsRenamed({"k": key, "len": length})


def merge_packed(df: DataFrame, by: list[str], order: list[str], lists: list[str], length: str,
                 singles: list[str] | None = None) -> DataFrame:
    """One row per bin: lists joined in member order, positions restarting per member, lengths added, singles listed.

    A bin holds at most one maximum sequence length, so the collected arrays are bounded.
    """
    fields = [*order, *lists, length, *(singles or [])]
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_m"))
    position = F.flatten(F.transform("_m", lambda m: F.when(m[length] > 0, F.sequence(F.lit(0), m[length].cast("int") - 1))
                                     .otherwise(F.array().cast("array<int>"))))
    def member(c):
        return F.transform("_m", lambda m: m[c])

    return rows.select(*by, *[F.flatten(member(c)).alias(c) for c in lists],
                       position.alias("position_ids"),
                       F.aggregate("_m", F.lit(0).cast("long"), lambda a, m: a + m[length].cast("long")).alias(length),
                       *[member(c).alias(c) for c in singles or []])


def truncate_tokens(df: DataFrame, lists: list[str], limit: int, how: str = "right") -> DataFrame:
    """Cut parallel arrays on the right or left; ``reject`` marks over-long rows in ``_reject`` instead."""
    length = F.greatest(*[F.size(c) for c in lists], F.lit(0))
    if how == "reject":
        return df.withColumn("_reject", F.when(length > limit, F.lit("over_max_length")))
    for c in lists:
        kept = F.slice(c, 1, limit) if how == "right" else F.slice(c, F.greatest(F.size(c) - limit + 1, F.lit(1)), F.lit(limit))
        df = df.withColumn(c, kept)
    return df


def data_range(df: DataFrame, piece: int, pieces: int, order: list) -> DataFrame:
    """The ``piece``-th (0-based) contiguous run of len // pieces rows; the tail belongs to no piece."""
    return _shard(df, pieces, order, even=False).filter(F.col("shard") == piece)


def even_shards(df: DataFrame, shards: int, order: list) -> DataFrame:
    """Adds ``shard``: contiguous ranges whose sizes differ by at most one, larger ones first."""
    return _shard(df, shards, order, even=True)


def _shard(df: DataFrame, n: int, order: list, even: bool) -> DataFrame:
    rows = numbered(df, order, name="_p")
    size = rows.agg(F.count(F.lit(1)).alias("_len"))
    rows = rows.crossJoin(F.broadcast(size))  # one-row side
    small, extra, p = F.floor(F.col("_len") / n), F.col("_len") % n, F.col("_p")
    if even:
        big = extra * (small + 1)
        shard = F.when(p < big, F.floor(p / (small + 1))).otherwise(extra + F.floor((p - big) / small))
    else:
        shard = F.when(p < small * n, F.floor(p / small))
    return rows.withColumn("shard", shard.cast("int")).drop("_p", "_len")


def drop_tail(df: DataFrame, multiple: int, order: list) -> DataFrame:
    """The first rows in order, cut to a multiple of ``multiple``."""
    rows = numbered(df, order, name="_p")
    size = rows.agg((F.floor(F.count(F.lit(1)) / multiple) * multiple).alias("_keep"))
    return rows.crossJoin(F.broadcast(size)).filter(F.col("_p") < F.col("_keep")).drop("_p", "_keep")  # one-row side


def split_into_batches(df: DataFrame, n: int, seed: int, key: list[str], drop_last: bool = False) -> DataFrame:
    """Shuffled batches 0..n-1 of equal size; a short last batch is filled with repeats of random rows (``pad``)."""
    size = df.agg(F.count(F.lit(1)).alias("_len"))
    rows = hash_rank(df, key, seed, "_rk").crossJoin(F.broadcast(size))  # one-row side
    if drop_last:
        batch = F.floor(F.col("_len") / n)
        return (rows.filter(F.col("_rk") <= batch * n).withColumn("batch", F.floor((F.col("_rk") - 1) / batch).cast("int"))
                .withColumn("pad", F.lit(False)).drop("_rk", "_len"))
    batch = F.ceil(F.col("_len") / n)
    missing = batch * n - F.col("_len")
    # a padded slot repeats the row whose rank is the slot number again; fewer than n slots are padded, so
    # repeats go round only when there are fewer rows than that
    spots = F.concat(F.array(F.col("_rk")), F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.floor((missing - F.col("_rk")) / F.col("_len")).cast("int"), F.lit(0))),
                 lambda j: F.col("_rk") + j * F.col("_len") <= missing),
        lambda j: F.col("_len") + F.col("_rk") + j * F.col("_len")))
    rows = rows.withColumn("_spot", F.explode(spots))
    return (rows.withColumn("batch", F.floor((F.col("_spot") - 1) / batch).cast("int"))
            .withColumn("pad", F.col("_spot") > F.col("_len")).drop("_rk", "_len", "_spot"))
