"""The operators over the given tables, with production parameters, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, fp_tree, linejoin, mixing, multiset_hash, oracles, ordinal, packing, pair_bitmaps, secret_scan, simhash, superkmers, token_counts,
               warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql:
        ORACLES[fn.__name__] = sql
    return fn


def with_sql(sql: str):
    return lambda fn: query(fn, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_simhash_classes(spark, sf_dir):
    found = simhash.classes(table(spark, sf_dir, "documents"), distance=2, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@with_sql(oracles.REPEATED_PASSAGES)
def op8_repeated_passages(spark, sf_dir):
    kept = superkmers.remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@with_sql(oracles.BENCHMARK_HITS)
def op3_benchmark_hits(spark, sf_dir):
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_secret_spans(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"), owner="source", repository="doc_id")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secret_scan.written("base"), 256).alias("base_sha256"),
                        secret_scan.written("spans").alias("spans"), "n_live", "n_example")


@query
def op5_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@with_sql("""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY ALL)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first < page_id THEN first END AS refers_to
    FROM d LEFT JOIN f USING (payload_digest)""")
def op2_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op7_multiset_fingerprints(spark, sf_dir):
    found = multiset_hash.edited_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), multiset_hash.written(F.col("fingerprint")).alias("fingerprint"),
                        multiset_hash.written(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op6_source_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=[1, 2, 3], most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query
def op4_quality_grades(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ordinal.train(docs, labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade")), n_grades=3, max_rated=10_000)
    graded = ordinal.score(docs.select("doc_id", "text"), model)
    good = F.get("p_at_least", F.lit(1))
    return graded.select("doc_id", "expected_grade", F.get("p_at_least", F.lit(0)).alias("p_not_toxic"), good.alias("p_good"), (good >= 0.5).alias("keep"))


@query
def op1_similar_lines(spark, sf_dir):
    done = linejoin.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), similarity=0.8)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_token_pair_counts(spark, sf_dir):
    return pair_bitmaps.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_packed_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0)


@with_sql(oracles.RANKED_SEARCH)
def op13_ranked_search(spark, sf_dir):
    return fp_tree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
