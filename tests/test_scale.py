"""Building blocks under skew: one key holds a third of the rows and thresholds are small enough to force every branch."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import metrics as M
from tessera.operators import normalize as N
from tessera.operators import retrieve as X
from tessera.operators import rollouts as R
from tessera.operators import sample as S
from tessera.operators import scale as C


def skewed(n=900, seed=1):
    rng = random.Random(seed)
    return [(("hot" if i % 3 == 0 else f"k{rng.randrange(60)}"), i, rng.randrange(40), rng.random()) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, v int, x double").repartition(7)


def test_group_stats_salted(df, rows):
    sums, sizes = Counter(), Counter()
    for k, _, v, _ in rows:
        sums[k] += v
        sizes[k] += 1
    out = C.with_group_stats(df, ["k"], [F.sum("v").alias("s")], spread=["id"], hot_rows=20).collect()
    assert len(out) == len(rows)
    assert all(r.s == sums[r.k] and r["_rows"] == sizes[r.k] for r in out)


def test_group_stats_null_key(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id long")
    out = {r.id: r.n for r in C.with_group_stats(d, ["k"], [F.count("*").alias("n")], spread=["id"], hot_rows=1).collect()}
    assert out == {1: 2, 2: 2, 3: 1}


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_ranks_do_not_depend_on_partitioning(spark, df, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        by_group = defaultdict(list)
        for k, i, v, _ in rows:
            by_group[k].append((v, i))
        want = {i: n + 1 for k in by_group for n, (v, i) in enumerate(sorted(by_group[k]))}
        got = C.ranked(df, [F.col("v"), F.col("id")], ["k"]).collect()
        assert {r.id: r["rank"] for r in got} == want
        order = {i: n for n, (v, i) in enumerate(sorted((v, i) for _, i, v, _ in rows))}
        assert {r.id: r.pos for r in C.positions(df, ["v", "id"]).collect()} == order
        run, acc = {}, Counter()
        for k, i, v, _ in sorted(rows, key=lambda r: r[1]):
            acc[k] += v
            run[i] = acc[k]
        got = C.running_total(df, [F.col("id")], {"t": F.col("v")}, by=["k"]).collect()
        assert {r.id: r.t for r in got} == run
        sample = {r.id for r in S.sample_k(df, 50, 7, ["id"]).collect()}
        large = {r.id for r in S.hash_rank(df, ["id"], 7, upto=50).filter("rank <= 50").collect()}
        assert sample == large and len(sample) == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_previous_row(df, rows):
    want, prev = {}, None
    for k, i, v, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        want[i] = prev
        prev = v
    got = C.previous_row(df, [F.col("k"), F.col("id")], ["v"]).collect()
    assert {r.id: (r.prev.v if r.prev else None) for r in got} == want


def test_flag_members_and_salted_join(spark, df, rows):
    m = spark.createDataFrame([("hot",), ("k1",), ("none",)], "m string")
    got = C.flag_members(df, "k", m, "hit").collect()
    assert len(got) == len(rows) and all(r.hit == (r.k in ("hot", "k1")) for r in got)
    j = C.salted_join(df, spark.createDataFrame([("hot", 5)], "kk string, w int"), [("k", "kk")], ["id"])
    assert j.count() == sum(r[0] == "hot" for r in rows)


@pytest.mark.parametrize("hot", [10, 10 ** 6])
def test_skew_join(spark, df, rows, hot):
    holes = df.withColumn("k", F.when(F.col("id") % 5 != 1, F.col("k")))
    side = spark.createDataFrame([("hot", 5), ("k1", 6), ("k2", 7), ("zz", 8)], "kk string, w int")
    want = Counter((i, {"hot": 5, "k1": 6, "k2": 7}.get(k) if i % 5 != 1 else None) for k, i, _, _ in rows)
    got = Counter((r.id, r.w) for r in C.skew_join(holes, side, [("k", "kk")], ["id"], "left", hot_rows=hot).collect())
    assert got == want
    inner = C.skew_join(holes, side, [("k", "kk")], ["id"], hot_rows=hot).count()
    assert inner == sum(n for (_, w), n in want.items() if w)


def test_greedy_quota_against_brute_force(spark):
    rng = random.Random(5)
    for trial in range(3):
        data = [("hot" if i % 3 == 0 else f"s{i % 4}", i, f"{rng.getrandbits(64):016x}", rng.choice([0, 1, 3, 7, 40, 90, 333])) for i in range(400)]
        d = spark.createDataFrame(data, "s string, id long, digest string, n long")
        target = [3000, 900, 10 ** 9][trial]
        total = sum(r[3] for r in data)
        ratio = min(1, target / total)
        want = set()
        for s in {r[0] for r in data}:
            pool = sorted((r for r in data if r[0] == s), key=lambda r: (r[2], r[1]))
            quota, used = int(sum(r[3] for r in pool) * ratio), 0
            for _, i, _, n in pool:
                if used + n <= quota:
                    used += n
                    want.add(i)
        got = [r.id for r in S.stratified_token_quota(d, ["s"], ["id"], "digest", "n", target).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_packing_keeps_tokens_and_limit(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(1, 100)) for i in range(1000)]
    d = spark.createDataFrame(data, "id long, n long")
    for shards in (1, 4):
        out = S.pack_sequences(d, "id", "n", 128, shards, interval=32).collect()
        assert sorted((r.id, r.n) for r in out) == data
        bins = Counter()
        for r in out:
            bins[(r.shard, r.bin)] += r.n
        assert max(bins.values()) <= 128
        again = S.pack_sequences(d.repartition(5), "id", "n", 128, shards, interval=32).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_split_and_resample(df, rows):
    split = S.train_val_split(df, 0.1, 3, ["id"]).collect()
    assert Counter(r.split for r in split) == {"train": 810, "validation": 90}
    again = S.resample_to(df, 2000, 3, ["id"]).collect()
    copies = Counter(r.id for r in again)
    assert len(again) == 2000 and set(copies.values()) == {2, 3} and len(copies) == 900


def test_dedup_keeps_first_of_hot_copies(spark):
    data = [("s", i, "same" if i % 2 else f"t{i % 50}") for i in range(500)]
    d = spark.createDataFrame(data, "source string, row_id long, t string")
    got = sorted(r.row_id for r in A.dedup_conversations(d, ["source", "row_id"], F.sha2("t", 256), hot_rows=20).collect())
    first = {}
    for _, i, t in data:
        first.setdefault(t, i)
    assert got == sorted(first.values())


def test_waterfall_adds_up(spark):
    data = [("s1" if i % 3 else "s2", i, ["candidate", "tag_invalid"][i % 4 == 0], f"{(i % 7) * 613566756:08x}") for i in range(300)]
    d = spark.createDataFrame(data, "source string, row_id long, reason string, digest string")
    for r in A.filter_waterfall(d, 0.5, ["source", "row_id"]).collect():
        assert r.raw == sum(v for k, v in r.asDict().items() if k not in ("source", "raw"))
        assert r.raw == sum(x[0] == r.source for x in data)


def test_auc_and_ranks(spark):
    rng = random.Random(9)
    data = [(i, rng.randrange(12) / 12, rng.randrange(2)) for i in range(300)]
    d = spark.createDataFrame(data, "id long, pred_c double, gold_c int")
    pos, neg = [p for _, p, g in data if g], [p for _, p, g in data if not g]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert M.roc_auc(d, "c").first()[0] == pytest.approx(want, abs=1e-12)
    flipped = d.withColumn("pred_c", -F.col("pred_c"))
    assert M.roc_auc(flipped, "c").first()[0] == pytest.approx(1 - want, abs=1e-12)


def test_dense_topk_in_several_blocks(spark):
    rng = random.Random(4)
    vec = [(i, [rng.random() - 0.5 for _ in range(8)]) for i in range(120)]
    d = spark.createDataFrame(vec, "id long, v array<double>").repartition(5)
    q = d.limit(30).select(F.col("id").alias("q"), F.col("v").alias("qv"))
    def found(**kw):
        return sorted((r.q, r.id, round(r.score, 9), r["rank"]) for r in X.dense_topk(q, d, 5, "q", "qv", "id", "v", **kw).collect())

    one, many = found(), found(block_rows=7)
    assert one == many and len(one) == 150
    best = defaultdict(list)
    for r in q.collect():
        best[r.q] = sorted(((-sum(a * b for a, b in zip(r.qv, v)), i) for i, v in vec))[:5]
    assert all([i for _, i in best[k]] == [t[1] for t in sorted((x for x in one if x[0] == k), key=lambda x: x[3])] for k in best)


def test_advantages_sum_to_zero(spark, df):
    out = R.grpo_advantage(df, "k", "id", "x", hot_rows=25).groupBy("k").agg(F.sum("advantage").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r.s) < 1e-6 for r in out if r.n > 1)


def test_numbered_stores_keys_only(spark, monkeypatch):
    stored = []
    cut = C.cut
    monkeypatch.setattr(C, "cut", lambda df: stored.append(set(df.columns)) or cut(df))
    data = [(i % 3 or None, i * 7 % 50, f"long text {i}") for i in range(200)]
    d = spark.createDataFrame(data, "g int, v int, payload string")
    flat = sorted((r["pos"], r.v) for r in C.numbered(d, ["v"]).collect())
    assert [p for p, _ in flat] == list(range(200)) and [v for _, v in flat] == sorted(v for _, v, _ in data)
    by = defaultdict(list)
    for r in C.numbered(d, ["v", "payload"], ["g"], "row").collect():
        by[r.g].append((r.row, r.v, r.payload))
    for g in by:
        assert [(v, p) for _, v, p in sorted(by[g])] == sorted((v, p) for k, v, p in data if k == g) and [r for r, *_ in sorted(by[g])] == list(range(len(by[g])))
    assert stored and not any(c in names for names in stored for c in ("payload", "v", "g"))


def test_quota_with_equal_digests(spark):
    """A digest that holds most rows cannot be split by its prefix; the fill is still the one in order."""
    rng = random.Random(3)
    data = [("a", i, "00ff" * 16 if i % 3 else f"{rng.randrange(16 ** 8):08x}" * 8, rng.randrange(1, 30)) for i in range(300)] + [("b", i, f"{i:064x}", 5) for i in range(20)] + [("c", 1, "0" * 64, 10 ** 6)]
    d = spark.createDataFrame(data, "s string, k long, digest string, n long")
    available = {s: sum(r[3] for r in data if r[0] == s) for s in "abc"}
    for target in (700, 10 ** 9):
        ratio = min(1.0, target / sum(available.values()))
        want = set()
        for s in "abc":
            left = int(available[s] * ratio)
            for r in sorted((r for r in data if r[0] == s), key=lambda r: (r[2], r[1])):
                if r[3] <= left:
                    left -= r[3]
                    want.add((s, r[1]))
        for few in (1, 4096):
            real = S.overflow_prefix
            S.overflow_prefix = lambda *a, f=few: real(*a, few=f)
            try:
                got = {(r.s, r.k) for r in S.stratified_token_quota(d, ["s"], ["k"], "digest", "n", target).collect()}
            finally:
                S.overflow_prefix = real
            assert got == want


def test_bm25_in_small_groups(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randrange(5, 40))) + f" t{i // 30}") for i in range(900)]
    queries = [(i, f"w0 w1 t{i}") for i in range(12)] + [(90, "none of it"), (91, "w0 w1 w55"), (92, "")]
    monkeypatch.setattr(X, "BLOCK", 8)
    monkeypatch.setattr(X, "GROUP", 4)
    d, q = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(queries, "q long, qt string")
    got = defaultdict(list)
    for r in X.bm25_topk(q, d, 5, "q", "qt", "id", "t").collect():
        got[r.q].append((r["rank"], r.id, r.score))
    sizes = {i: len(t.split()) for i, t in docs}
    mean = sum(sizes.values()) / len(docs)
    df = Counter(w for _, t in docs for w in set(t.split()))
    for i, text in queries:
        scores = []
        for k, t in docs:
            tf = Counter(t.split())
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 0.9 * (0.6 + 0.4 * sizes[k] / mean)) for w in text.split() if tf[w])
            if s:
                scores.append((-round(s, 9), k))
        assert [k for _, k in sorted(scores)[:5]] == [k for _, k, _ in sorted(got[i])]
        assert [s for *_, s in sorted(got[i])] == pytest.approx([-s for s, _ in sorted(scores)[:5]], abs=1e-7)


def test_blocks_under_the_floor_stay_closed(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 8)
    rng = np.random.default_rng(2)
    n, words = 800, 40
    sizes = rng.integers(2, 12, n)
    word = np.concatenate([np.sort(rng.choice(words, s, replace=False, p=(p := 1 / np.arange(1, words + 1)) / p.sum())) for s in sizes]).astype(np.int32)
    w, first = rng.random(len(word)), np.concatenate(([0], np.cumsum(sizes)))
    group = X.Group.of(np.arange(n) + 5000, first, word, w, words)
    owner, dense, opened = np.repeat(np.arange(n), sizes), np.zeros(words), 0
    for _ in range(50):
        asked = np.concatenate((rng.choice(4, 2, replace=False), rng.choice(np.arange(20, words), 1)))
        idf = np.where(np.arange(words) < 4, 0.2, 4.0)
        weight = idf[asked]
        score = np.bincount(owner, np.where(np.isin(word, asked), w * idf[word], 0), n)
        want = sorted(((-s, i + 5000) for i, s in enumerate(score) if s > 0))[:6]
        for floor in (0.0, -want[-1][0]):
            ids, scores, some = X.search_group(group, asked, weight, dense, 6, floor)
            assert [i for _, i in sorted(zip(-scores, ids))[:6]] == [i for _, i in want] and not dense.any()
        opened += some
    assert opened < 0.4 * 50 * n / 8


def test_dense_topk_leaves_far_balls_out(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 10) for _ in range(6)] for _ in range(12)]
    vec = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 12]]) for i in range(600)]
    d = spark.createDataFrame(vec + [(1000 + i, vec[0][1]) for i in range(150)] + [(2000, None)], "id long, v array<double>")
    q = d.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = defaultdict(list)
    for r in X.dense_topk(q, d, 4, "q", "qv", "id", "v", block_rows=40).collect():
        got[r.q].append((r["rank"], r.id))
    rows = {i: v for i, v in vec} | {1000 + i: vec[0][1] for i in range(150)}
    for i in (0, 7, 333, 1100):
        want = sorted(((-round(sum(a * b for a, b in zip(rows[i], v)), 9), k) for k, v in rows.items()))[:4]
        scores = lambda ids: [round(sum(a * b for a, b in zip(rows[i], rows[k])), 6) for k in ids]  # noqa: E731, B023
        assert scores(k for _, k in sorted(got[i])) == scores(k for _, k in want)
    assert len(got) == 750
    sample = spark.createDataFrame([(centres,)], "centres array<array<double>>")
    both = d.filter("v IS NOT NULL").select(F.explode(F.array(F.lit("q"), F.lit("d"))).alias("side"), F.col("id").alias("k"), "v")
    packed = X.pack_balls(both, sample, 40)
    left, right = packed.filter("side = 'q'"), packed.filter("side = 'd'")
    assert right.agg(F.max("n")).first()[0] < 110
    first, rest = X.meetings(left, right, 4)
    assert rest.count() < 0.5 * left.count() * right.count()


def test_dense_topk_sends_a_part_once_to_each_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 10, (400, 4)).astype(float)  # many equal scores
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    sides = d.select(F.explode(F.array(F.lit("q"), F.lit("d"))).alias("side"), "k", "v")
    packed = X.pack_balls(sides, spark.createDataFrame([(x[:20].tolist(),)], "centres array<array<double>>"), 10)
    left, right = packed.filter("side = 'q'").drop("side"), packed.filter("side = 'd'").drop("side")
    every = left.select(F.col("ball").alias("qball"), F.col("part").alias("qpart")).crossJoin(right.select(F.col("ball").alias("dball"), F.col("part").alias("dpart"))).withColumn("floor", F.lit(None).cast("double"))
    parts = left.count()
    sent, sends = [], type(left).repartitionById
    monkeypatch.setattr(type(left), "repartitionById", lambda df, n, c: sent.append((df.count(), n)) or sends(df, n, c))
    rows = X.met(left, right, every, 3).collect()
    # whatever the number of pairs, a part goes to as many cells as the grid has groups on the other side
    assert parts > 3 * X.GRID and sent == [(2 * parts * X.GRID, X.GRID ** 2)]
    got, score = defaultdict(list), x @ x.T
    for r in rows:
        got[r.q].append((-round(r.score, 6), r.d))
    assert all(sorted(got[i])[:3] == sorted((-round(s, 6), j) for j, s in enumerate(score[i]))[:3] for i in range(400))


def test_token_recursions_take_some_rows_at_a_time(spark, monkeypatch):
    lists = [[1.0, None, 2.0], None, [], [1.0, 2.0, 3.0], [5.0], [4.0, 4.0], [2.0] * 9, [1.0, 1.0]]
    others = [[1.0, 1.0, 0.0], [1.0, 2.0], [], [1.0, 1.0], None, [1.0, 2.0, 3.0], [0.5] * 9, [1.0, 1.0]]
    a, b = pa.array(lists, pa.list_(pa.float64())), pa.array(others, pa.list_(pa.float64()))
    seen = []

    def add(lengths, out, x, y):
        seen.append((len(out), len(x), len(y)))
        assert lengths.sum() == len(out)
        out[:] = x + y

    want = [[2.0, None, 2.0], None, [], [2.0, 3.0, None], None, [5.0, 6.0, None], [2.5] * 9, [2.0, 2.0]]
    monkeypatch.setattr(R, "SLICE_TOKENS", 6)
    assert R._by_slices(add, a, b).to_pylist() == want and R._by_slices(add, a[1:], b[1:]).to_pylist() == want[1:]
    assert len(seen) > 6 and all(x == y == z and x in (0, 2, 3, 6, 9) for x, y, z in seen)
    d = spark.createDataFrame(list(zip(range(8), lists, others)), "k int, r array<double>, m array<double>").coalesce(1).orderBy("k")
    rows = d.select(R.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("x"), R.gae_advantages(F.col("r"), F.col("m"), 0.9, 0.8).alias("y")).collect()
    assert [r.x for r in rows][:6] == [[None, None, 2.0], None, [], [None, None, 3.0], None, [None, None, None]]
    assert rows[7].x == [1.5, 1.0] and [round(y, 9) for y in rows[7].y] == [0.9, 0.0]


def test_long_recursions_are_dealt_by_their_tokens(spark, tmp_path, monkeypatch):
    names = "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame([(i % 40, i, i % 7, i, 1.0, 0.05, 0.02) for i in range(2000)], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    from tessera.plans import rollout_queries as Q
    monkeypatch.setattr(Q, "TASK_TOKENS", 100)
    out = Q.query.__globals__["QUERIES"]["long_token_recursions"](spark, str(tmp_path))
    assert ", 20" in next(x for x in out._jdf.queryExecution().logical().toString().split("\n") if "RepartitionByExpression" in x)
    assert out.agg(F.count("*"), F.sum("n")).first() == (40, 2000)


def test_long_sessions_come_in_parts(spark):
    steps = [("hot", i, "0" if i in (0, 3) else "1", f"o{i}", f"a{i}") for i in range(500)] + [("b", i, "0", f"o{i}", "x") for i in range(3)]
    d = spark.createDataFrame(steps, "k string, i long, idx string, obs string, act string").withColumn("task", F.lit("do"))
    out = N.session_messages(N.sessionize_steps(d, "k", "i", "idx", step="step"), "k", "i", "task", "obs", "act", "step", max_steps=50).collect()
    hot = sorted((r.session, r.part, [m.content for m in r.messages]) for r in out if r.k == "hot")
    assert all(len(m) <= 100 for *_, m in hot) and len(hot) == 1 + 10
    flat = [x for *_, m in hot for x in m]
    want = [x for i in range(500) for x in (f"o{i}\ndo" if i in (0, 3) else f"o{i}", f"a{i}")]
    assert flat == want and len([r for r in out if r.k == "b"]) == 3
