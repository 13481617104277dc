"""Incremental versions of the batch steps on Structured Streaming.

The batch operators define the semantics.  What a stream adds is said at each function: a horizon for duplicates, windows
for metrics, and micro-batches whose outputs are folders named by the batch id, so that a repeated batch overwrites itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sample import pack_sequences
from .key_log import KeyLog


def source(spark: SparkSession, folder: str, name: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """File stream over one table of a folder (a file or a folder of files), oldest files first.  The schema is fixed, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(f"{folder}/{name}*")


def stream_normalize(stream: DataFrame, recipe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any row-wise recipe or normalisation; it has no state, so it is the batch expression."""
    return recipe(stream)


def stream_dedup(stream: DataFrame, digest: Column, ts: str, horizon: str) -> DataFrame:
    """Exact duplicates removed inside the horizon.  State holds the digests of that time span, not of all time."""
    rows = stream.withColumn("digest", digest).withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["digest"])


def stream_rollout_metrics(stream: DataFrame, ts: str, window: str, late: str, reward: str, tokens: str) -> DataFrame:
    """Reward and token statistics per tumbling window."""
    n, r = F.col(tokens), F.col(reward)
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("rollouts"), F.avg(r).alias("avg_score"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"),
        F.avg(n).alias("avg_tokens"), F.coalesce(F.avg(F.when(r > 0, n)), F.lit(0.0)).alias("avg_tokens_rewarded"),
        F.coalesce(F.avg(F.when(r == 0, n)), F.lit(0.0)).alias("avg_tokens_unrewarded")).select(F.col("w.start").alias("start"), *[
            F.col(c) for c in ("rollouts", "avg_score", "min_tokens", "max_tokens", "avg_tokens", "avg_tokens_rewarded", "avg_tokens_unrewarded")])


#: A sample that waits: which of uid, sample and ms are null is told by the bits of ``empty``.
_WAITING = np.dtype([("uid", np.int64), ("sample", np.int64), ("reward", np.float64), ("ms", np.int64), ("empty", np.int8)])
NO_UID, NO_SAMPLE, NO_TIME = 1, 2, 4


class _Groups(StatefulProcessor):
    """Samples of the prompts of a bucket until they are complete, or until the event time is past the last one's patience.

    The samples that wait are one packed value, and the bucket has one timer, for the group that is due first: a batch costs a few calls of the state store for a bucket, not for a prompt.
    """

    def __init__(self, n_samples: int, patience_ms: int):
        self.n_samples, self.patience_ms = n_samples, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "samples binary, due long")

    def _known(self) -> tuple[np.ndarray, int | None]:
        state = self.waiting.get()
        return (np.zeros(0, _WAITING), None) if state is None else (np.frombuffer(state[0], _WAITING), state[1])

    def _keep(self, rows: np.ndarray, due: int, timer: int | None) -> None:
        """Replace what waits; ``timer`` is the one that is set."""
        if timer is not None and (timer != due or not len(rows)):
            self.handle.deleteTimer(timer)
        if not len(rows):
            self.waiting.clear()
            return
        self.waiting.update((rows.tobytes(), due))
        if timer != due:
            self.handle.registerTimer(due)

    def _by_prompt(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows by prompt, in order of arrival; where each prompt begins, how many rows it has and when it is due."""
        rows = rows[np.lexsort((rows["uid"], rows["empty"] & NO_UID))]
        none = rows["empty"] & NO_UID
        first = np.flatnonzero(np.concatenate(([True], (rows["uid"][1:] != rows["uid"][:-1]) | (none[1:] != none[:-1]))))
        late = np.maximum.reduceat(np.where(rows["empty"] & NO_TIME, np.iinfo(np.int64).min, rows["ms"]), first)
        if (late == np.iinfo(np.int64).min).any():
            raise ValueError("a group of samples has no time")
        return rows, first, np.diff(np.append(first, len(rows))), late + self.patience_ms

    def _out(self, rows: np.ndarray, reason) -> pd.DataFrame:
        column = lambda c, bit: pd.Series(rows[c]).astype("Int64").mask((rows["empty"] & bit) != 0) if (rows["empty"] & bit).any() else rows[c]
        return pd.DataFrame({"uid": column("uid", NO_UID), "sample": column("sample", NO_SAMPLE), "reward": rows["reward"], "reason": pd.Series(reason, index=range(len(rows)), dtype=object)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows)
        came = np.empty(len(new), _WAITING)
        for c in _WAITING.names:
            came[c] = new[c].to_numpy(dtype=_WAITING[c])
        known, timer = self._known()
        have, first, n, due = self._by_prompt(np.concatenate((known, came)))
        whole = n >= self.n_samples
        out = np.repeat(whole, n)
        if whole.any():
            reward = have["reward"]
            same = (np.fmin.reduceat(reward, first) == np.fmax.reduceat(reward, first)) & ~np.isnan(reward[first]) & (self.n_samples > 1)
            yield self._out(have[out], np.where(np.repeat(same, n)[out], "uniform", None))
        self._keep(have[~out], int(due[~whole].min(initial=np.iinfo(np.int64).max)), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        have, first, n, due = self._by_prompt(self._known()[0])
        over = (due < timerValues.getCurrentWatermarkInMs()) | (due <= expiredTimerInfo.getExpiryTimeInMs())
        out = np.repeat(over, n)
        yield self._out(have[out], "unfinished")
        self._keep(have[~out], int(due[~over].min(initial=np.iinfo(np.int64).max)), None)  # the timer that ran out is gone


def stream_complete_groups(stream: DataFrame, uid: str, sample: str, reward: str, n_samples: int, ts: str, late: str, patience_s: int, buckets: int = 256) -> DataFrame:
    """(uid, sample, reward, reason) of prompt groups, released once all their samples are there.

    A group whose rewards are all equal comes out with the reason ``uniform``.  A group that is not complete when the watermark is ``patience_s`` seconds past its last sample
    comes out as it is, with the reason ``unfinished``.  Either way its state is freed, so state is bounded by the samples of that time span.  Prompts are dealt
    over ``buckets`` by a hash; a task holds the samples of a bucket that wait and those that come.  The number must not change while a checkpoint is in use.  Needs the RocksDB state store
    (``run(..., rocksdb=True)``).
    """
    at = F.col(ts).cast("timestamp")
    empty = sum((F.when(c.isNull(), bit).otherwise(0) for c, bit in ((F.col(uid).cast("long"), NO_UID), (F.col(sample).cast("long"), NO_SAMPLE), (at, NO_TIME))), F.lit(0))
    filled = lambda c: F.coalesce(c, F.lit(0).cast("long"))  # noqa: E731  a long with nulls would lose digits in pandas
    slim = stream.select(F.pmod(F.xxhash64(F.col(uid).cast("long")), F.lit(buckets)).alias("bucket"), filled(F.col(uid).cast("long")).alias("uid"), filled(F.col(sample).cast("long")).alias("sample"),
                         F.col(reward).cast("double").alias("reward"), at.alias("ts"), filled(F.unix_millis(at)).alias("ms"), empty.cast("byte").alias("empty"))
    return slim.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(
        _Groups(n_samples, 1000 * patience_s), "uid long, sample long, reward double, reason string", "Append", "EventTime")


def batch_writer(path: str, transform: Callable[[DataFrame, int], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch is one folder, overwritten when the batch is repeated."""
    def write(df: DataFrame, batch: int) -> None:
        (transform(df, batch) if transform else df).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/run_id=*/batch=*").withColumn("run_id", F.col("run_id").cast("string"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def group_collector(path: str) -> Callable[[DataFrame, int], None]:
    """Stages the complete groups of every batch; how many are used is decided when they are read."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def collected_groups(spark: SparkSession, path: str, target_rows: int) -> DataFrame:
    """The first ``target_rows`` staged rows of released groups by (uid, sample), whatever batches they came in."""
    return read_batches(spark, path).filter("reason IS NULL").orderBy("uid", "sample").limit(target_rows)


def packer(out: str, open_bins: str, key: str, length: str, max_len: int, shards: int) -> Callable[[DataFrame, int], None]:
    """Packs each micro-batch together with the bins left open by the one before.

    The last bin of each shard stays open: its rows are the carry table of the batch (at most one bin per shard).  Rows longer than ``max_len`` are
    written with their reason and are in no bin.  The staged batch is deleted when it has been split; the carry table of the batch before stays until then, so that a
    repeated batch finds it.
    """
    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        rows = df.select(F.col(key).cast("long").alias(key), F.col(length).cast("long").alias(length))
        if batch and _exists(spark, f"{open_bins}/batch={batch - 1}"):
            rows = rows.unionByName(spark.read.parquet(f"{open_bins}/batch={batch - 1}").select(key, length))
        staged = f"{out}-staged/batch={batch}"
        pack_sequences(rows, key, length, max_len, shards).write.mode("overwrite").parquet(staged)
        packed = spark.read.parquet(staged)
        last = packed.groupBy(F.col("shard").alias("_s")).agg(F.max("bin").alias("_last"))
        marked = packed.join(F.broadcast(last), F.col("shard") == F.col("_s")).withColumn("open", F.coalesce(F.col("bin") == F.col("_last"), F.lit(False))).drop("_s", "_last")
        marked.filter("NOT open").drop("open").write.mode("overwrite").parquet(f"{out}/batch={batch}")
        marked.filter("open").drop("open").write.mode("overwrite").parquet(f"{open_bins}/batch={batch}")
        for old in (staged, f"{open_bins}/batch={batch - 2}"):
            _delete(spark, old)
    return write


def resume(df: DataFrame, finished: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones (a column ``key`` of texts)."""
    return df if finished is None else df.join(finished.select(F.col("key").alias("_done")), F.col(key).cast("string") == F.col("_done"), "left_anti")


def resumable_sink(path: str, key: str, transform: Callable[[DataFrame], DataFrame], run: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Processes only keys that no other batch or run has written.

    Folders are named by run and batch, so a run that counts its batches from 0 again touches nothing of the runs before; a batch that is repeated
    in its own run is written again.  ``run`` names the run; by default each sink is one of its own.  Which keys are written is looked up in a ``KeyLog`` beside the
    folders, so a batch does not read the batches before it.  Folders that a job left without an entry in the log, as it died in between, are entered at the
    first batch of the next sink.
    """
    run = run or uuid.uuid4().hex
    ready = False

    def write(df: DataFrame, batch: int) -> None:
        nonlocal ready
        log = KeyLog(df.sparkSession, f"{path}-keys", buckets)
        if not ready:
            _enter_missing(log, path, key, run, batch)
            ready = True
        folder = f"{path}/run_id={run}/batch={batch}"
        done = log.finished(df.select(key), key, run, batch)
        transform(resume(df, done, key)).write.mode("overwrite").parquet(folder)
        log.append(df.sparkSession.read.parquet(folder), key, run, batch)
    return write


def _enter_missing(log: KeyLog, path: str, key: str, run: str, batch: int) -> None:
    for owner in sorted(log._names(path)):
        for part in sorted(log._names(f"{path}/{owner}")):
            name, number = owner.removeprefix("run_id="), int(part.removeprefix("batch="))
            if (name, number) != (run, batch) and "_SUCCESS" in log._names(f"{path}/{owner}/{part}") and not log.holds(name, number):
                log.append(log.spark.read.parquet(f"{path}/{owner}/{part}"), key, name, number)


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", rocksdb: bool = False) -> None:
    """Process what is there and stop.  ``rocksdb`` keeps the state of this stream in RocksDB, as timers need."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if rocksdb:
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(name, before)
