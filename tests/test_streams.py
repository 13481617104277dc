"""Streams over several micro-batches: timers, horizons, carried bins, and the log of finished keys."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.plans.stream_queries import fed
from tessera.streaming import key_log
from tessera.streaming import stream as S


def test_unfinished_groups_come_out_once_and_state_goes(spark, tmp_path):
    minute = "timestamp '2024-01-01' + make_dt_interval(0, 0, m)"
    rows = [(1, 0, 0.0, 0), (1, 1, 1.0, 1), (2, 0, 1.0, 0), (3, 0, 0.5, 2), (2, 1, 1.0, 3), (6, 0, 0.2, 4), (4, 0, 0.1, 30), (3, 1, 0.7, 31), (5, 0, 0.0, 60), (4, 1, 0.2, 61)]
    steps = [0, 0, 0, 0, 0, 0, 1, 1, 2, 2]
    d = spark.createDataFrame([(*r, s) for r, s in zip(rows, steps)], "uid long, sample long, reward double, m int, step int").withColumn("ts", F.expr(minute))
    groups = S.stream_complete_groups(fed(d, str(tmp_path), "step", 3), "uid", "sample", "reward", 2, "ts", "1 minute", 10 * 60)
    S.run(groups, f"{tmp_path}/ck", S.group_collector(f"{tmp_path}/out"), rocksdb=True)
    got = sorted((r.uid, r.sample, r.reason) for r in S.read_batches(spark, f"{tmp_path}/out").collect())
    # 3 and 4 are complete before the watermark passes their timers, 6 never is, 5 is not yet due at the end
    assert got == [(1, 0, None), (1, 1, None), (2, 0, "uniform"), (2, 1, "uniform"), (3, 0, None), (3, 1, None), (4, 0, None), (4, 1, None), (6, 0, "unfinished")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_groups_due_at_the_watermark_and_without_id(spark, tmp_path):
    at = "timestamp '2024-01-01' + make_dt_interval(0, 0, m)"
    rows = [(None, 0, 0.5, 0, 0), (None, 1, 0.5, 0, 0), (2**60 + 1, 0, 1.0, 0, 0), (8, 0, None, 0, 0), (8, 1, 0.5, 0, 0), (9, 0, 0.1, 1, 0), (7, 0, 0.5, 11, 0), (5, 0, 0.5, 11, 1), (9, 1, 0.2, 12, 2)]
    d = spark.createDataFrame(rows, "uid long, sample long, reward double, m int, step int").withColumn("ts", F.expr(at))
    groups = S.stream_complete_groups(fed(d, str(tmp_path), "step", 3), "uid", "sample", "reward", 2, "ts", "1 minute", 10 * 60)
    S.run(groups, f"{tmp_path}/ck", S.group_collector(f"{tmp_path}/out"), rocksdb=True)
    got = [(r.uid, r.sample, r.reward, r.reason) for r in S.read_batches(spark, f"{tmp_path}/out").collect()]
    want = [(None, 0, 0.5, "uniform"), (None, 1, 0.5, "uniform"), (2**60 + 1, 0, 1.0, "unfinished"), (8, 0, None, None), (8, 1, 0.5, None), (9, 0, 0.1, None), (9, 1, 0.2, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


class Store:
    """A state store of one bucket that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_bucket_of_prompts_costs_a_few_calls():
    store, groups = Store(), S._Groups(4, 100)
    groups.init(store)
    clock = lambda at: type("Clock", (), {"getCurrentWatermarkInMs": lambda _: at, "getExpiryTimeInMs": lambda _: at})()
    rows = lambda uid, sample, ms: pd.DataFrame({"uid": uid, "sample": sample, "reward": sample * 0.5, "ms": ms, "empty": 0})
    uid = np.arange(2000)
    start = [rows(uid, np.full(2000, s), 10 + uid) for s in range(3)]
    assert list(groups.handleInputRows((0,), iter(start), clock(0))) == [] and store.timers == {110}
    done = pd.concat(groups.handleInputRows((0,), iter([rows(uid[::2], np.full(1000, 3), 10 + uid[::2])]), clock(0)))
    assert len(done) == 4000 and set(done["uid"]) == set(range(0, 2000, 2)) and done["reason"].isna().all() and store.timers == {111}
    store.timers.remove(111)
    late = pd.concat(groups.handleExpiredTimer((0,), clock(1110), clock(111)))
    assert sorted(set(late["uid"])) == list(range(1, 1000, 2)) and len(late) == 1500 and set(late["reason"]) == {"unfinished"} and store.timers == {1111}
    store.timers.remove(1111)
    assert len(pd.concat(groups.handleExpiredTimer((0,), clock(9999), clock(1111)))) == 1500 and store.value is None and not store.timers
    assert store.calls < 16


def test_filters_hold_every_key():
    rng = np.random.default_rng(1)
    mine, other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    bits = key_log.filter_of(mine)
    assert key_log.may_hold(bits, mine).all() and key_log.may_hold(bits, other).mean() < 0.01
    assert key_log.may_hold(key_log.filter_of(mine[:1]), mine[:1]).all()


def test_log_of_many_batches_stays_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_log, "FAN", 3)
    log = key_log.KeyLog(spark, str(tmp_path / "keys"), buckets=4)
    for b in range(10):
        log.append(spark.range(100 * b, 100 * b + 100).toDF("k"), "k", "run", b)
        log.append(spark.range(5).toDF("k"), "k", "run", b)  # a batch that is there is left as it is
    runs = log.runs()
    assert sorted(r.level for r in runs) == [0, 2] and spans_of(runs) == [("run", 0, 9)]
    assert sorted(log._names(f"{tmp_path}/keys/keys")) == sorted(r.name for r in runs) and len(log._names(f"{tmp_path}/keys/runs")) <= 2
    keys = spark.range(950, 1100).toDF("k")
    assert log.finished(keys, "k", "other", 0).count() >= 50
    found = S.resume(keys, log.finished(keys, "k", "other", 0), "k")
    assert sorted(r.k for r in found.collect()) == list(range(1000, 1100))
    own = S.resume(keys, log.finished(keys, "k", "run", 9), "k")  # the batch itself, repeated
    assert own.count() == 150
    # keys of one bucket of the last run: nothing else is opened, but for chance hits of a filter
    places = log.candidates(spark.range(900, 905).toDF("k"), "k").select("run").distinct().collect()
    assert {r.run for r in places} >= {next(r.name for r in runs if r.level == 0)} and len(places) <= 2
    assert log.candidates(spark.range(10 ** 6, 10 ** 6 + 40).toDF("k"), "k").count() < 5


def spans_of(runs):
    return list(key_log.spans([h for r in runs for h in r.holds]))


def test_sink_after_a_job_that_died(spark, tmp_path):
    path = str(tmp_path / "out")
    work = lambda df: df.select("k", F.lit(1).alias("x"))
    S.resumable_sink(path, "k", work, run="a")(spark.range(10).toDF("k"), 0)
    spark.range(10, 20).toDF("k").withColumn("x", F.lit(1)).write.parquet(f"{path}/run_id=a/batch=1")  # written, but the job died before the log had it
    S.resumable_sink(path, "k", work, run="b")(spark.range(30).toDF("k"), 0)
    out = S.read_runs(spark, path)
    assert sorted(r.k for r in out.collect()) == list(range(30))
    S.resumable_sink(path, "k", work, run="b")(spark.range(30).toDF("k"), 0)  # repeated in its own run: the same rows again
    assert sorted(r.k for r in S.read_runs(spark, path).filter("run_id = 'b'").collect()) == list(range(20, 30))


def test_packer_carries_bins_over_batches(spark, tmp_path):
    d = spark.createDataFrame([(i, 100 + i % 7, i % 3) for i in range(60)] + [(99, 5000, 1)], "k long, n long, step int")
    S.run(fed(d, str(tmp_path), "step", 3), f"{tmp_path}/ck", S.packer(f"{tmp_path}/out", f"{tmp_path}/open", "k", "n", 1000, 1))
    done, left = S.read_batches(spark, f"{tmp_path}/out"), S.read_batches(spark, f"{tmp_path}/open")
    assert sorted(left.select("batch").distinct().toPandas()["batch"]) == [1, 2]
    last = left.filter("batch = 2")
    rows = done.unionByName(last).collect()
    assert sorted(r.k for r in rows) == sorted([*range(60), 99]) and [r.k for r in rows if r.reason] == [99]
    carried = {r.k for r in left.filter("batch = 1").collect()}
    assert carried and all(r.batch == 2 for r in rows if r.k in carried)
