"""Huge JSON arrays in ranges: every cut of a text gives the objects that a parser of the whole text gives."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import io, json_array

HARD = [{"a": i, "s": x} for i, x in enumerate(['plain', 'a } b', '{"x": [1, 2}', 'back\\', '\\"}', '"', '\\\\"', '}{][', 'é 日本 \U0001f600 }', "", '\n}\n', "a" * 300])]


@pytest.fixture
def ranges(spark):
    """Reads files in ranges of some bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "8")

    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size, indent", [(61, None), (160, 3), (10**6, None)])
def test_objects_of_any_ranges(spark, tmp_path, ranges, size, indent):
    ranges(size)
    rows = [{**r, "n": {"deep": [{"x": r["s"]}, [], {}]}, "more": [r["a"], {"}": "]"}]} for r in HARD]
    for i, ascii_only in enumerate((True, False)):
        (tmp_path / f"{i}.json").write_text("  " + json.dumps(rows, indent=indent, ensure_ascii=ascii_only) + "\n")
    got = io.read_json_array(spark, str(tmp_path), "a int, s string, n struct<deep: array<string>>, more array<string>", place=True).collect()
    assert sorted((r.a, r.s) for r in got) == sorted((r["a"], r["s"]) for r in rows * 2)
    raw = {str(i): (tmp_path / f"{i}.json").read_bytes() for i in (0, 1)}
    for r in got:
        text = raw[r._file[-6]][r._byte:]
        assert json.JSONDecoder().raw_decode(text.decode())[0] == rows[[x["s"] for x in rows].index(r.s)]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    ranges(1 << 20)
    n = 100_000
    with open(tmp_path / "big.json", "w") as file:
        file.write(json.dumps([{"i": i, "t": f"text {i} }} \\ \" {i % 7}"} for i in range(n)]))  # one line
    df = io.read_json_array(spark, str(tmp_path / "big.json"), "i long, t string")
    assert df.filter(F.col("t") == F.format_string('text %d } \\ " %d', F.col("i"), F.col("i") % 7)).agg(F.count("*"), F.count_distinct("i"), F.sum("i")).first() == (n, n, n * (n - 1) // 2)
    tasks = json_array.objects(json_array.pieces(spark, str(tmp_path / "big.json")), json_array.composed(json_array.range_maps(json_array.pieces(spark, str(tmp_path / "big.json")))))
    assert tasks.select(F.spark_partition_id().alias("p")).distinct().count() > 3


@pytest.mark.parametrize("size", [5])
@pytest.mark.parametrize("text, why", [
    ("", "empty JSON document at byte 0"), ("   ", "expected a top-level JSON array at byte 3"), ('{"a": 1}', "expected a top-level JSON array at byte 0"), (',[{"a": 1}]', "expected a top-level JSON array at byte 0"),
    ('[{"a": 1}, 5]', "expected an object at byte 11"), ('[{"a": 1}, [{"a": 2}]]', "expected an object at byte 11"), ('["}"]', "expected an object at byte 1"), ('[{"a": 1}, {"a": 2}', "unterminated JSON array at byte 19"),
    ('[{"a": 1}, ', "unterminated JSON array at byte 11"), ('[{"a": 1}, {"a": ', "unterminated JSON array at byte 17"), ('[{"a": "x}, {]', "unterminated JSON array at byte 14"), ('[{"a": 1]]', "closed by another bracket at byte 8"),
    ('[{"a": 1}}', "closed by another bracket at byte 9")])
def test_faults_are_told_with_their_byte(spark, tmp_path, ranges, size, text, why):
    ranges(size)
    (tmp_path / "bad.json").write_text(text)
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    with pytest.raises(Exception, match=why):
        io.read_json_array(spark, str(tmp_path), "a int").collect()


def test_commas_empty_arrays_and_what_follows(spark, tmp_path, ranges):
    ranges(6)
    for name, text in (("a", "[]"), ("b", ' [ , {"a": 1},, {"a": 2},] {"a": 3} ["'), ("c", '[\n\n]\n'), ("d", "[{}]")):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(str(r.a) for r in io.read_json_array(spark, str(tmp_path), "a int").collect()) == ["1", "2", "None"]


def test_text_that_is_no_json_inside_an_object_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": one}]')
    with pytest.raises(Exception):
        io.read_json_array(spark, str(tmp_path / "x.json"), "a int").collect()


def test_brackets_against_a_plain_scan():
    rng = random.Random(4)
    for _ in range(300):
        text = bytes(rng.choice(b'{}[]"\\a,') for _ in range(rng.randrange(0, 40)))
        inside, skip, want, quotes = False, False, [], 0
        run = 0
        for i, c in enumerate(text):
            if c == ord('"') and run % 2 == 0:
                inside, quotes = not inside, quotes + 1
            elif c in b"{}[]":
                want.append((i, inside))
            run = run + 1 if c == ord("\\") else 0
        places, got, n = json_array.brackets(np.frombuffer(text, np.uint8))
        assert (list(zip(places.tolist(), got.tolist())), n) == (want, quotes)
