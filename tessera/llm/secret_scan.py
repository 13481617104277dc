"""Secrets in texts, told from copied examples by how many owners and repositories in the whole corpus share a value.

One pass finds the spans of fixed patterns and, beside them, bare runs of characters that look generated.  Values leave the task only as digests.
Their distinct repositories and owners are counted over the corpus: a value of few owners and few repositories looks live, one of many of either
is a widely copied example.  The patterns' spans are all reported; a bare run is reported, as kind ``live``, if its value looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import store

# The patterns and the least length of what they must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

KINDS = ["assign", "access", "hex", "live"]
RUN = 20  # characters of a bare run, at least
ENTROPY = 3.5  # bits per character of a bare run, at least
MAX_OWNERS = 2
MAX_REPOSITORIES = 10

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# A longest run of one character class fails or passes by its length alone, so the length can stand in the pattern.
_ACCESS = re.compile(ACCESS.replace("+", "{%d,}" % (LEAST["access"] - 4)))
_HEX = re.compile(HEX.replace("+", "{%d,}" % LEAST["hex"]))
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed patterns, leftmost and without overlap for each kind, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def bare_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs of mixed letters and digits of high entropy that touch none of the ``taken`` spans."""
    found = []
    for m in _RUN.finditer(text):
        run, n = m[0], len(m[0])
        if not (re.search("[0-9]", run) and re.search("[a-z]", run) and re.search("[A-Z]", run)):
            continue
        if -sum(c / n * log2(c / n) for c in Counter(run).values()) < ENTROPY or any(a < m.end() and m.start() < b for a, _, b, _ in taken):
            continue
        found.append((m.start(), 3, m.end(), run))
    return found


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())])
_SPAN_TYPE = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for value in batch.column(batch.num_columns - 1):
            text = value.as_py() or ""
            found = base_spans(text)
            found += bare_spans(text, found)
            spans.append([{"start": a, "kind": k, "end": b, "value": hashlib.blake2b(v.encode("utf-8", "replace"), digest_size=16).hexdigest()} for a, k, b, v in found])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, pa.list_(_SPAN))], [*batch.schema.names[:-1], "found"])


def written(spans) -> F.Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS,
         max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(key, base, spans, n_live, n_example) for each document.

    ``base`` has the spans of the fixed patterns as (start, kind, end) in code points, end exclusive; ``spans`` also has the added ones.  ``n_live``
    counts the spans whose value at most ``max_owners`` owners and at most ``max_repositories`` repositories have, ``n_example`` the others.  Null and
    empty texts have no spans.  A null owner or repository counts as one of its own.  Repeated rows each get their row; further columns are ignored.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.struct(F.col(owner)).alias("owner"), F.struct(F.col(repository)).alias("repo"), F.col(text).cast("string").alias("text"))
    slim = slim.withColumns({c: F.xxhash64(F.to_json(c)) for c in ("owner", "repo")})  # a null has a hash of its own
    shape = T.StructType([*slim.schema.fields[:-1], T.StructField("found", T._parse_datatype_string(_SPAN_TYPE))])
    rows = store(slim.mapInArrow(_scan, shape), "secrets")
    uses = rows.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", F.col("s.value").alias("value"))
    shared = uses.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    live = uses.select("row", "value").distinct().join(shared, "value").filter((F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories)).groupBy("row").agg(F.collect_set("value").alias("live"))
    judged = rows.join(live, "row", "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    kept = F.filter("found", lambda s: (s["kind"] < 3) | F.array_contains("live", s["value"]))
    return judged.select(F.col("key").alias(key), plain(F.filter("found", lambda s: s["kind"] < 3)).alias("base"), plain(kept).alias("spans"),
                         F.size(F.filter("found", lambda s: F.array_contains("live", s["value"]))).cast("long").alias("n_live"),
                         F.size(F.filter("found", lambda s: ~F.array_contains("live", s["value"]))).cast("long").alias("n_example"))
