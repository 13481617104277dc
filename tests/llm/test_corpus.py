"""Line join, archives, grades, mixing and the pipeline against brute force, exact round trips and held-out accuracy."""

import collections
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import linejoin, mixing, ordinal, rarity, superkmers, warc
from tessera.llm import queries as Q

WS = r"[^\x20\x09-\x0D]+"
SF = "/root/testdata/sf0.001"


def low(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def kept_lines(rows, t=0.8):
    """(key, text) in order of key, null last; the text with its lines that are unlike all earlier ones."""
    sets, out = [], []
    for k, x in rows:
        keep = []
        for line in (x or "").split("\n"):
            s = frozenset(re.findall(WS, low(line)))
            if not s or not any(len(s & o) >= t * len(s | o) - 1e-9 for o in sets):
                keep.append(line)
            if s:
                sets.append(s)
        out.append((k, None if x is None else "\n".join(keep)))
    return out


def test_similar_lines(docs_of, small):
    rows = [r for r in small if r[0] not in (None, 71)] + [(80, "a b c d\nA b c d e\n\n e d c b a f"), (81, "b a c d"), (82, small[0][1].replace("w0 ", "new ")), (None, "last words of all of us here\na b c d")]
    got = linejoin.dedup_lines(docs_of(rows))
    assert got.columns == ["doc_id", "text", "source", "key", "tag", "n_words", "n_lines", "n_removed"]
    want = kept_lines(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_similar_lines_of_repeated_rows(docs_of):
    rows = [(1, "p q r s t\nu v w"), (1, "p q r s t\nu v w"), (2, "u v w"), (2, "x y z")]
    got = sorted((r.doc_id, r.text) for r in linejoin.dedup_lines(docs_of(rows)).collect())
    assert got == [(1, "p q r s t\nu v w"), (1, "p q r s t\nu v w"), (2, ""), (2, "x y z")]
    assert linejoin.dedup_lines(docs_of([])).count() == 0


def test_similar_lines_in_any_order_of_arrival(spark):
    """Equal lines stand for the earliest of them, whichever row a task reads first."""
    base = [" ".join(f"{c}{i}" for i in range(9)) for c in "abcdefgh"]
    rows = [(50, base[0]), (20, base[0] + " new"), (5, base[0]), (None, base[1]), (7, base[1] + " new"), (6, base[1])]
    rows += [(i * 37 % 101 + 100, f"{base[i % 8]} new\n{base[i * 5 % 8]}" if i % 3 else base[i * 3 % 8]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.text) for r in linejoin.dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == sorted(kept_lines(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))), key=repr)


def varied_lines():
    """Lines of up to 150 words, each with copies of which some words are changed: about as many as similarity allows, or a few more."""
    rng, rows = np.random.default_rng(7), []
    for i in range(24):
        n = int(rng.integers(5, 150))
        base = [f"w{j}" for j in rng.choice(900, n, replace=False)] + [f"rare{i % 8}"]
        for _ in range(10):
            line = list(base)
            for at in rng.choice(n, int(rng.integers(0, n // 6 + 2)), replace=False):
                line[at] = f"x{rng.integers(900)}"
            rows.append(" ".join(line))
    return [(i, "\n".join(rows[j] for j in some)) for i, some in enumerate(np.array_split(rng.permutation(len(rows)), 60))]


@pytest.mark.parametrize("enough", [None, 1])
def test_similar_lines_about_the_limit(spark, monkeypatch, enough):
    """Against brute force; with one partner a word at first, so that a second pass must look for the others."""
    if enough:
        monkeypatch.setattr(linejoin, "ENOUGH", enough)
    rows = varied_lines()
    got = linejoin.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == kept_lines(rows)
    lines = {k: len(x.split("\n")) for k, x in rows}
    assert all(r.n_lines == lines[r.doc_id] and r.n_lines - r.n_removed == (len(r.text.split("\n")) if r.text else 0) for r in got)
    assert sum(r.n_removed for r in got) > 80


def test_similar_lines_read_the_texts_four_times(spark):
    """To count words, to send prefixes, to verify and to cut; not again while no line is left with partners untried.  Once before that, for the keys alone."""
    read = spark.sparkContext.accumulator(0)
    rows = varied_lines()

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(seen, "doc_id long, text string")
    assert linejoin.dedup_lines(docs).agg(F.sum(F.length("text"))).collect()[0][0] > 0
    assert read.value <= 5 * len(rows)


def test_similar_lines_words(spark):
    """Words and lines of whole columns, also where rows touch, are empty or end in a line feed, and where more lines come than are sorted at once."""
    texts = ["a B\n\nb a", "", "c", "averyveryverylongwordindeed x\n", "", " \n", "\n".join(f"{i} é{i}" for i in range(9000)), "A b"]
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(x.encode()) for x in texts])))
    lines = linejoin.Lines(np.frombuffer(data, np.uint8), offsets, np.zeros(1 << 22, np.uint8))
    want = [(i, j, len(set(low(x).split()))) for i, t in enumerate(texts) for j, x in enumerate(t.split("\n")) if x.split()]
    assert [*zip(lines.row.tolist(), lines.number.tolist(), lines.size.tolist())] == want
    name = {(i, j): k for i, j, k in zip(lines.row.tolist(), lines.number.tolist(), lines.k1.tolist())}
    assert name[0, 0] == name[0, 2] == name[7, 0] and len(set(name.values())) == len(want) - 2
    first = sorted(set(lines.words[:2].tolist()))
    assert lines.words[:2].tolist() == first and lines.words[-2:].tolist() == first


def test_counts_of_words(spark, small):
    texts = spark.createDataFrame([(x,) for _, x in small], "text string").repartition(4)
    assert rarity.count_words(texts).sum() == sum(len(re.findall(WS, x or "")) for _, x in small)
    assert superkmers._sliding_min(np.array([5, 3, 4, 1, 2, 9]), 3).tolist() == [3, 1, 1, 1]


PAGES = [(1, "http://a/1", "x" * 99), (2, None, "x" * 99), (3, "http://a/\r\n3", "y" * 100), (5, "u", "y" * 100), (4, "u", "y" * 100), (6, "u", None), (7, "u", ""), (8, "u", "日" * 40), (9, "u", "日" * 40), (10, "u", "z" * 600_000),
         (None, "u", "y" * 100), (3, "again", "y" * 100)]


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, page string").repartition(2)
    got = sorted(map(tuple, warc.round_trip(pages).drop("payload_digest").collect()), key=repr)
    first = {"y" * 100: 3, "日" * 40: 8}
    want = []
    for k, _, x in PAGES:
        to = first.get(x)
        again = to is not None and k is not None and k != to
        want.append((k, len((x or "").encode()), "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_archives():
    import hashlib
    digest = hashlib.sha256(b"hello").hexdigest()
    whole = warc.record("response", "<urn:page:1>", b"hello", digest) * 2
    assert [p for _, p in warc.read_records(io.BytesIO(whole))] == [b"hello", b"hello"]
    assert list(warc.read_records(io.BytesIO(b""))) == []
    for bad in (whole[:-3], warc.record("response", "<urn:page:1>", b"hellO", digest), b"plain text"):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_records(io.BytesIO(bad)))


def test_grades_on_held_out_ratings(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal.train(docs, labels.filter(~held), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal.score(docs, model).join(labels.filter(held), "doc_id").select("grade", (F.get("p_at_least", F.lit(1)) >= 0.5).alias("good"), "expected_grade").toPandas()
    assert (got.good == (got.grade == 2)).mean() > 0.85
    assert got[got.grade == 2].expected_grade.mean() > got[got.grade == 1].expected_grade.mean() > got[got.grade == 0].expected_grade.mean()


def test_grades_without_ratings(spark, docs_of, small):
    none = spark.createDataFrame([], "doc_id long, grade int")
    got = ordinal.score(docs_of(small), ordinal.train(docs_of(small), none, 3))
    assert got.columns[:6] == docs_of(small).columns and got.count() == len(small)
    one = spark.createDataFrame([(1, 2), (1, 2), (2, None), (3, 9), (None, 1)], "doc_id long, grade int")
    assert ordinal.score(docs_of([]), ordinal.train(docs_of(small), one, 3)).count() == 0


@pytest.mark.parametrize("rows", [
    [(i, "w " * (i * 37 % 50), "abcde"[i * i % 5]) for i in range(300)] + [(301, None, None), (302, "x " * 9, None), (303, "", "a"), (7, "w " * 40, "b"), (7, "w " * 40, "b")],
    [(1, "a b c", "only")], [(1, None, None), (2, "", "x")], []])
def test_mix(docs_of, rows):
    got = mixing.mix(docs_of(rows)).collect()
    again = mixing.mix(docs_of(rows, parts=5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    size = collections.Counter()
    for _, x, s in rows:
        size[s] += len(re.findall(WS, x or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in names:
        smallest = min((len(re.findall(WS, x or "")) for _, x, o in rows if o == s and x and x.strip()), default=0)
        assert abs(taken[s] - target[s]) <= max(smallest, 1)


def test_rates_are_exponential_tilts(docs_of):
    rows = [(i, "w " * (1 + i * 13 % 40), "ab"[i % 2]) for i in range(200)]
    for source, group in __import__("itertools").groupby(sorted(mixing.mix(docs_of(rows)).collect(), key=lambda r: r.source), key=lambda r: r.source):
        tilt = [np.log(r.rate) / r.size for r in group if r.rate < 3]
        assert max(tilt) - min(tilt) < 1e-9


def test_stages(spark):
    """Each stage against a plain version over its own input."""
    SF = "/root/testdata/sf0.01"  # enough ratings to fit on
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "benchmark_free", "mix"]
    good = stages["quality"](spark, docs, SF).cache()
    assert good.columns == docs.columns and 0.6 * docs.count() < good.count() < docs.count()
    cut = stages["lines"](spark, good, SF).cache()
    want = kept_lines(sorted((r.doc_id, r.text) for r in good.collect()))
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == want
    assert cut.filter("n_chars <> char_length(text)").count() == 0
    one = stages["near_duplicates"](spark, cut, SF).cache()
    assert one.columns == docs.columns and one.filter("text = ''").count() <= 1 < cut.filter("text = ''").count()
    clean = stages["benchmark_free"](spark, one, SF).cache()
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    dirty = set()
    for r in one.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r.text))
        if any(tuple(w[i:i + 10]) in windows for i in range(len(w))):
            dirty.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - dirty and dirty
    mixed = stages["mix"](spark, clean, SF)
    assert mixed.columns[:5] == docs.columns and mixed.filter("copies < 1 OR copies > 3").count() == 0
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}


def test_near_duplicates_at_the_threshold(spark, docs_of):
    """The stage with its own parameters against brute force: pairs just above and just below 0.8, and a passage repeated more or less often."""
    rng = np.random.default_rng(11)
    new = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    rows = []
    for i in range(120):  # 100 shingles each, of which 89 or 88 are shared: 0.802 or 0.786
        words, common = new(104), 93 if i % 3 else 92
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:common] + new(104 - common)))]
    head, passage = new(60), new(9)
    rows += [(1000, " ".join(head + passage * 2)), (1001, " ".join(head + passage * 40))]
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (x.split() for _, x in rows)]
    gone = {rows[j][0] for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(gone) == 81
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), SF).collect()}
    assert got == {k for k, _ in rows} - gone


def test_pipeline_is_its_stages(spark):
    first, second = (sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second and first


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_sql(spark, name):
    from compare import compare, duck
    text, ok = compare(spark, duck(SF), name, Q.QUERIES[name], Q.ORACLES[name], SF)
    assert ok, text


def test_every_operator_has_its_query():
    assert {re.match(r"op(\d+)_", n)[1] for n in Q.QUERIES} == {str(i) for i in range(1, 14)}


def test_stages_on_odd_tables(spark, docs_of, small):
    """Nulls, empty texts, repeated rows, ties, empty tables and columns with the stages' own names."""
    rows = [(k, x) for k, x in small if k is not None]
    docs = docs_of(rows).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("lang", F.lit(None).cast("string"))
    docs = docs.withColumns({c: F.lit("own") for c in ("__tag", "_row", "_mixed", "copies", "size", "_key")})
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        got = out.collect()
        if name == "mix":
            assert sorted(out.columns) == sorted([*docs.columns, "source_size", "target", "taken"])
            assert all(r["copies"] in (1, 2, 3) and r._row == "own" and r["taken"] == r["copies"] * r["size"] for r in got) and len(got) <= len(rows)
        else:
            assert out.columns == docs.columns and all(r["__tag"] == "own" and r.copies == "own" for r in got)
        if name != "lines":
            assert stage(spark, docs.limit(0), SF).collect() == []


def test_repeated_rows_are_mixed_once_each(spark, docs_of):
    docs = docs_of([(1, "a b c")] * 3 + [(None, "a b c")] * 2 + [(2, None)] * 2)
    got = corpus_pipeline.mix(spark, docs, SF).collect()
    assert len(got) <= 7 and sum(r.taken for r in got) <= 15
    assert sum(r.size for r in corpus_pipeline.mix(spark, docs, SF).collect()) == sum(r.size for r in got)
