"""Cases in which a cap, a size switch or a dropped row would change the result."""

import pytest
from pyspark.errors import PySparkException

from tessera.functions.rewards import arithmetic
from tessera.operators import recipes, rollouts, sample, tables
from tessera.streaming import stream

NODE = "tree_id long, node_id long, parent_id long, outcome_reward double, process_reward double, terminated boolean, correct boolean"


def chain(spark, n):
    return spark.createDataFrame([(1, i, i - 1 if i else None, float(i), 1.0, i == n - 1, True) for i in range(n)], NODE)


def test_paths_of_any_depth(spark):
    row = rollouts.tree_path_scores(chain(spark, 20)).first()
    assert (row.depth, row.mean_outcome, row.min_outcome) == (20, 9.5, 0.0)


def test_broken_trees_fail(spark):
    ring = spark.createDataFrame([(1, i, (i + 1) % 3, 1.0, 1.0, True, True) for i in range(3)], NODE)
    with pytest.raises(ValueError, match="cycle"):
        rollouts.tree_path_scores(ring)
    orphan = spark.createDataFrame([(1, 1, 9, 1.0, 1.0, True, True)], NODE)
    with pytest.raises(PySparkException, match="missing"):
        rollouts.tree_path_scores(orphan).collect()


def test_runs_keep_each_others_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(10).withColumnRenamed("id", "k")
    stream.resumable_sink(path, "k", lambda d: d)(rows.filter("k < 5"), 0)
    again = stream.resumable_sink(path, "k", lambda d: d)
    again(rows, 0)
    again(rows, 0)
    assert sorted(r.k for r in stream.read_runs(spark, path).collect()) == list(range(10))


def test_packers_report_rows_that_are_too_long(spark, tmp_path):
    rows = spark.createDataFrame([(i, 4097 + i if i % 5 == 0 else 100 + i) for i in range(60)], "k long, n long")
    want = [(i, 4097 + i, "too_long") if i % 5 == 0 else (i, 100 + i, None) for i in range(60)]
    got = sample.pack_sequences(rows, "k", "n", 4096, 3)
    assert sorted((r.k, r.n, r.reason) for r in got.collect()) == want
    assert got.filter("(reason IS NULL) <> (bin IS NOT NULL AND slot IS NOT NULL)").count() == 0
    write = stream.packer(f"{tmp_path}/out", f"{tmp_path}/open", "k", "n", 4096, 3)
    write(rows.filter("k < 30"), 0)
    write(rows.filter("k >= 30"), 1)
    done = spark.read.parquet(f"{tmp_path}/out").unionByName(spark.read.parquet(f"{tmp_path}/open/batch=1"), allowMissingColumns=True)
    assert sorted((r.k, r.n, r.reason) for r in done.collect()) == want


def test_source_without_probability_fails(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, k int")
    for bad in (rows.filter("s IS NOT NULL"), rows.filter("s = 'a' OR s IS NULL")):
        with pytest.raises(PySparkException, match="no probability"):
            sample.interleave(bad, "s", {"a": 1.0}, ["k"], 7).collect()


def test_winsorise_is_exact(spark):
    rows = spark.range(1, 20_001).selectExpr("CAST(id AS DOUBLE) AS v").union(spark.sql("SELECT CAST(NULL AS DOUBLE)"))
    got = tables.winsorise(rows, "v", 0.05, 0.95)
    assert got.selectExpr("min(v)", "max(v)", "count(*)", "count(v)").first() == (1000.0, 19000.0, 20001, 20000)


def test_undeclared_categories_stay(spark):
    rows = spark.createDataFrame([("x", 20), ("y", 10), ("z", 70)], "c string, v int")
    assert [(r.c, r.position, r.share) for r in tables.ordered_totals(rows, "c", ["y", "x"], "v").collect()] == [("y", 1, .1), ("x", 2, .2), ("z", None, .7)]


def test_every_picture_stays(spark):
    pictures = spark.createDataFrame([(1, [1, 9, 1], "a"), (2, [], "b"), (3, None, "c")], "image_id int, category_ids array<int>, other string")
    names = spark.createDataFrame([(1, "cat")], "id int, name string")
    assert sorted((r.image_id, r.ref, r.other) for r in recipes.coco_detection(pictures, names).collect()) == [(1, ["cat", None, "cat"], "a"), (2, [], "b"), (3, None, "c")]


def test_powers_are_bounded_by_length():
    assert arithmetic("1**2000") == 1.0 and arithmetic("2**2000 - 2**2000 + 3") == 3.0 and arithmetic("(-1)**3001") == -1.0
    with pytest.raises(ArithmeticError):
        arithmetic("9**9**9")
