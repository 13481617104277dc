"""Finished keys as a compacted log: sorted into buckets, with a Bloom filter for each bucket of each run.

A batch of finished keys is appended as one run.  When ``FAN`` runs of a level have come together they are merged into one run of the next level, so that the number of runs
grows with the logarithm of the number of batches, and a key is written again as often.  A lookup tests its keys against the filters of their buckets, and reads only
buckets of runs where a filter holds one of them.  The list of runs is a small versioned table; a run counts from the version that names it, so that a job that
dies in between leaves the log as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8  # runs of a level that are merged
BITS, HASHES = 12, 6  # bits of a filter for each key, and places set: one foreign key in about 300 passes
RUN_SHAPE = "name string, level int, owner string, first long, last long"


@dataclass(frozen=True)
class Run:
    """A run and what it holds: the batches ``first`` to ``last`` of each owner."""

    name: str
    level: int
    holds: tuple[tuple[str, int, int], ...]


def bit_places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of each 64-bit hash in a filter of ``size`` bits, a row for each hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(size)).astype(np.int64)


def filter_of(hashes: np.ndarray) -> bytes:
    size = max(64, BITS * len(hashes) + 7 & ~7)
    bits = np.zeros(size, bool)
    bits[bit_places(hashes, size).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(bits, np.uint8)
    at = bit_places(hashes, 8 * len(packed))
    return ((packed[at >> 3] >> (at & 7)) & 1).all(axis=1)


class KeyLog:
    """Keys that are finished, with the owner and the batch that finished them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.jvm = spark.sparkContext._jvm
        self.files = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return [s.getPath().getName() for s in self.files.listStatus(where)] if self.files.exists(where) else []

    def _version(self) -> int:
        """The last list of runs that was written to its end."""
        return max((int(n) for n in self._names(f"{self.path}/runs") if self._names(f"{self.path}/runs/{n}").count("_SUCCESS")), default=-1)

    def runs(self) -> list[Run]:
        version = self._version()
        rows = self.spark.read.schema(RUN_SHAPE).json(f"{self.path}/runs/{version}").collect() if version >= 0 else []
        held: dict[tuple[str, int], list[tuple[str, int, int]]] = {}
        for r in rows:
            held.setdefault((r["name"], r["level"]), []).append((r["owner"], r["first"], r["last"]))
        return [Run(name, level, tuple(sorted(holds))) for (name, level), holds in sorted(held.items())]

    def _publish(self, runs: list[Run]) -> None:
        before = self._version()
        rows = [(r.name, r.level, *h) for r in runs for h in r.holds]
        self.spark.createDataFrame(rows, RUN_SHAPE).coalesce(1).write.mode("overwrite").json(f"{self.path}/runs/{before + 1}")
        for name in {*self._names(f"{self.path}/keys")} - {r.name for r in runs}:  # merged runs and those that were never published
            for kind in ("keys", "filters"):
                self.files.delete(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{name}"), True)
        for version in self._names(f"{self.path}/runs"):
            if int(version) < before:
                self.files.delete(self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/{version}"), True)

    def _write(self, keys: DataFrame, name: str) -> None:
        """Keys (key, hash, owner, batch) as one run: a folder for each bucket, and the filters of all buckets in one table."""
        bucket = F.pmod("hash", F.lit(self.buckets)).cast("int").alias("bucket")
        keys.select("key", "hash", "owner", "batch", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/keys/{name}")

        def build(table: pa.Table) -> pa.Table:
            hashes = table.column("hash").to_numpy().view(np.uint64)
            return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "n": [len(hashes)], "bits": pa.array([filter_of(hashes)], pa.binary())})

        written = self.spark.read.parquet(f"{self.path}/keys/{name}").select("hash", "bucket").distinct() if keys.head() else keys.select("hash", bucket)
        written.groupBy("bucket").applyInArrow(build, "bucket int, n long, bits binary").write.mode("overwrite").parquet(f"{self.path}/filters/{name}")

    def holds(self, owner: str, batch: int) -> bool:
        return any(o == owner and first <= batch <= last for r in self.runs() for o, first, last in r.holds)

    def append(self, keys: DataFrame, key: str, owner: str, batch: int) -> None:
        """The distinct keys of a batch; a batch that is already there is left as it is."""
        runs = self.runs()
        if any(o == owner and first <= batch <= last for r in runs for o, first, last in r.holds):
            return
        name = uuid.uuid4().hex
        text = F.col(key).cast("string")
        self._write(keys.select(text.alias("key"), F.xxhash64(text).alias("hash"), F.lit(owner).alias("owner"), F.lit(batch).cast("long").alias("batch")).distinct(), name)
        runs.append(Run(name, 0, ((owner, batch, batch),)))
        level = 0
        while len(same := [r for r in runs if r.level == level]) >= FAN:
            name = uuid.uuid4().hex
            self._write(self._keys([r.name for r in same]), name)
            runs = [r for r in runs if r.level != level] + [Run(name, level + 1, spans([h for r in same for h in r.holds]))]
            level += 1
        self._publish(runs)

    def _keys(self, names: list[str]) -> DataFrame:
        """The keys of some runs.  Each run is a table of its own, with its buckets as folders."""
        return reduce(DataFrame.unionByName, [self.spark.read.schema("key string, hash long, owner string, batch long, bucket int").parquet(f"{self.path}/keys/{n}") for n in names])

    def candidates(self, keys: DataFrame, key: str) -> DataFrame:
        """(run, bucket, key) where a filter of the key's bucket holds the key: all that are there, and few others."""
        names = [r.name for r in self.runs()]
        filters = reduce(DataFrame.unionByName, [self.spark.read.schema("bucket int, n long, bits binary").parquet(f"{self.path}/filters/{n}").select(F.lit(n).alias("run"), "bucket", "bits") for n in names])

        def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
            hashes, out = asked.column("hash").to_numpy().view(np.uint64), []
            for run, bits in zip(held.column("run").to_pylist(), held.column("bits").to_pylist()) if len(hashes) else ():
                some = asked.column("key").filter(pa.array(may_hold(bits, hashes)))
                out.append(pa.table({"run": pa.array([run] * len(some), pa.string()), "bucket": asked.column("bucket").slice(0, len(some)).cast(pa.int32()), "key": some}))
            return pa.concat_tables(out) if out else pa.table({"run": pa.array([], pa.string()), "bucket": pa.array([], pa.int32()), "key": pa.array([], pa.string())})

        text = F.col(key).cast("string")
        asked = keys.select(text.alias("key"), F.xxhash64(text).alias("hash")).distinct().withColumn("bucket", F.pmod("hash", F.lit(self.buckets)).cast("int"))
        return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, "run string, bucket int, key string")

    def finished(self, keys: DataFrame, key: str, owner: str, batch: int) -> DataFrame | None:
        """Those of the keys that another batch has finished, as text; None where there are none.  Only buckets with candidates are read."""
        if not self.runs():
            return None
        maybe = self.candidates(keys, key)
        places = maybe.groupBy("run").agg(F.collect_set("bucket").alias("buckets")).collect()  # runs and buckets, not keys
        if not places:
            return None
        there = reduce(DataFrame.unionByName, [self._keys([r["run"]]).filter(F.col("bucket").isin(r["buckets"])) for r in places])
        return there.filter((F.col("owner") != owner) | (F.col("batch") != batch)).select("key").distinct()


def spans(holds: list[tuple[str, int, int]]) -> tuple[tuple[str, int, int], ...]:
    """Batch ranges with those that touch put together."""
    out: list[tuple[str, int, int]] = []
    for owner, first, last in sorted(holds):
        if out and out[-1][0] == owner and first <= out[-1][2] + 1:
            out[-1] = (owner, out[-1][1], max(last, out[-1][2]))
        else:
            out.append((owner, first, last))
    return tuple(out)
