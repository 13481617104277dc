"""Streams over the given tables: each query runs its stream to the end of the table and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators.audit import turn
from ..streaming import stream as S
from .derived import select
from .registry import query
from .sample_queries import PACKED, packed_rows
from .table_queries import scratch


def stream_of(t, name):
    return S.source(t.spark, t.folder, f"{name}.parquet", getattr(t, name).schema)


def fed(rows, path, step, steps):
    """The rows as a stream of one micro-batch for each value of ``step``: a file each, written one after the other."""
    for i in range(steps):
        rows.filter(F.expr(step) == i).coalesce(1).write.parquet(f"{path}/in/{i:03d}")
    return S.source(rows.sparkSession, f"{path}/in", "", rows.schema, files_per_batch=1)


@query("stream_normalize", "X1", "SELECT doc_id, lang AS query, text AS response FROM documents")
def _(t):
    path = scratch(t, "x1")
    rows = stream_of(t, "documents").select("doc_id", F.col("lang").alias("question"), F.col("text").alias("answer"))
    S.run(S.stream_normalize(rows, N.qr_to_messages), f"{path}/ck", S.batch_writer(f"{path}/out"))
    m = F.col("messages")
    return S.read_batches(t.spark, f"{path}/out").select("doc_id", turn(m, 0).alias("query"), turn(m, 1).alias("response"))


# Ten micro-batches of three days.  A digest is known for a horizon of one step behind the watermark, which itself is a step behind the batch before: a copy
# comes again from the fourth step after the one that was kept.
STEP = "(EXTRACT(DAY FROM ts) - 1) // 3"
DEDUP = f"""WITH RECURSIVE s AS (SELECT DISTINCT sha256(event_type || chr(31) || props || chr(31) || user_id % 3) AS digest, CAST({STEP} AS BIGINT) AS step FROM events),
  k AS (SELECT digest, min(step) AS step FROM s GROUP BY digest
        UNION ALL SELECT digest, step FROM (SELECT s.digest, s.step, row_number() OVER (PARTITION BY s.digest ORDER BY s.step) AS i FROM k JOIN s ON s.digest = k.digest AND s.step >= k.step + 4) WHERE i = 1)
  SELECT digest, step FROM k"""


@query("stream_dedup", "X2", DEDUP)
def _(t):
    path = scratch(t, "x2")
    step = F.floor((F.dayofmonth("ts") - 1) / 3)
    rows = t.events.select("event_type", "props", "user_id", step.alias("step"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(step * 3)).alias("ts"))
    digest = F.sha2(F.concat_ws("\u001f", "event_type", "props", (F.col("user_id") % 3).cast("string")), 256)
    S.run(S.stream_dedup(fed(rows, path, "step", 10), digest, "ts", "3 days").select("digest", "step"), f"{path}/ck", S.batch_writer(f"{path}/out"))
    return S.read_batches(t.spark, f"{path}/out").select("digest", "step")


@query("stream_rollout_metrics", "X3", """SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS start, count(*) AS rollouts, round(avg(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END), 6) AS avg_score, min(user_id) AS min_tokens, max(user_id) AS max_tokens,
  round(avg(user_id), 6) AS avg_tokens, round(coalesce(avg(user_id) FILTER (event_id % 3 <> 0 AND value > 0), 0), 6) AS avg_tokens_rewarded, round(coalesce(avg(user_id) FILTER (event_id % 3 = 0 OR value = 0), 0), 6) AS avg_tokens_unrewarded FROM events GROUP BY 1""")
def _(t):
    path = scratch(t, "x3")
    rows = select(stream_of(t, "events"), ts="ts", r="CASE WHEN event_id % 3 = 0 THEN 0E0 ELSE value END", n="user_id")
    S.run(S.stream_rollout_metrics(rows, "ts", "1 day", "2 days", "r", "n"), f"{path}/ck", S.batch_writer(f"{path}/out"), mode="update")
    out = S.read_batches(t.spark, f"{path}/out")
    # update mode writes a window again when it changes; its last batch holds the final state
    last = out.groupBy("start").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("start", "batch")]), "batch").alias("s")).select("start", "s.*")
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("start"), *[F.round(c, 6).alias(c) if ty == "double" else c for c, ty in last.dtypes if c != "start"])


GROUP = dict(uid="CAST(floor(event_id / 4) AS BIGINT)", sample="event_id % 4", reward="CASE WHEN floor(event_id / 4) % 5 = 0 THEN 1E0 ELSE value END", ts="ts")
SENT = "NOT (floor(event_id / 4) % 7 = 3 AND event_id % 4 = 2)"  # one sample of every seventh group never comes
GROUP_CTE = ("g AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in GROUP.items()) + f" FROM events WHERE {SENT}), "
             "k AS (SELECT uid, count(*) AS n, min(reward) AS lo, max(reward) AS hi, max(ts) AS last FROM g GROUP BY uid)")


def released(t, path):
    """Groups of six micro-batches, each file five days of events.  A group may begin in one and end in the next."""
    rows = fed(select(t.events.filter(SENT), **GROUP).withColumn("step", F.floor((F.dayofmonth("ts") - 1) / 5)), path, "step", 6)
    groups = S.stream_complete_groups(rows, "uid", "sample", "reward", 4, "ts", "1 day", 2 * 86_400)
    S.run(groups, f"{path}/ck", S.group_collector(f"{path}/out"), rocksdb=True)


@query("stream_filter_groups", "X4", f"WITH {GROUP_CTE} SELECT uid, sample, reward FROM g JOIN k USING (uid) WHERE n = 4 AND lo < hi ORDER BY uid, sample LIMIT 1000")
def _(t):
    path = scratch(t, "x4")
    released(t, path)
    return S.collected_groups(t.spark, f"{path}/out", 1000).select("uid", "sample", "reward")


# An unfinished group comes out once the watermark, a day behind the last event, is two days past its last sample; younger ones are still waiting.
@query("stream_unfinished_groups", "X4", f"""WITH {GROUP_CTE} SELECT uid, sample, reward, CASE WHEN n < 4 THEN 'unfinished' WHEN lo = hi THEN 'uniform' END AS reason FROM g JOIN k USING (uid)
  WHERE n = 4 OR last + INTERVAL 2 DAY <= (SELECT max(ts) FROM g) - INTERVAL 1 DAY""")
def _(t):
    path = scratch(t, "x4")
    released(t, path)
    return S.read_batches(t.spark, f"{path}/out").select("uid", "sample", "reward", "reason")


@query("stream_pack", "X5", PACKED)
def _(t):
    path = scratch(t, "x5")
    rows = fed(t.documents.select("doc_id", "n_chars", (F.col("doc_id") % 4).alias("step")), path, "step", 4)
    S.run(rows, f"{path}/ck", S.packer(f"{path}/out", f"{path}/open", "doc_id", "n_chars", 4096, 8))
    done = S.read_batches(t.spark, f"{path}/out")
    left = S.read_batches(t.spark, f"{path}/open").filter("batch = 3")
    return packed_rows(done.unionByName(left), ["batch", "shard", "bin"])


@query("resumable_sink", "X6 J3", "SELECT doc_id, n_chars * 2 AS doubled, CASE WHEN doc_id % 3 = 0 THEN 'first' WHEN doc_id % 3 = 1 THEN 'second' ELSE 'third' END AS run FROM documents")
def _(t):
    path = scratch(t, "x6")

    def work(name):
        return lambda df: df.select("doc_id", (F.col("n_chars") * 2).alias("doubled"), F.lit(name).alias("run"))

    d = t.documents.select("doc_id", "n_chars")
    S.resumable_sink(f"{path}/out", "doc_id", work("first"))(d.filter("doc_id % 3 = 0"), 0)
    second = S.resumable_sink(f"{path}/out", "doc_id", work("second"))  # a run of its own: its batches begin at 0 again
    second(d.filter("doc_id % 3 < 2"), 0)
    second(d.filter("doc_id % 3 < 2"), 0)  # the same batch again, as after a restart
    S.resumable_sink(f"{path}/out", "doc_id", work("third"))(d, 0)
    return S.read_runs(t.spark, f"{path}/out").drop("batch", "run_id")
