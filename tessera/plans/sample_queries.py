"""Sampling, splitting, mixing and packing queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sample as S
from .derived import CORPUS_CTE, TOKEN_CTE, corpus, token_rollouts
from .registry import query


def hx(seed, *cols):
    return f"sha256('{seed}'" + "".join(f" || chr(31) || {c}" for c in cols) + ")"


DOC = ["doc_id"]
RANKED = f"r AS (SELECT *, row_number() OVER (ORDER BY {hx(7, 'doc_id')}, doc_id) AS rk, count(*) OVER () AS n FROM documents)"
POS = "r AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)"


@query("sample_k", "D1", f"SELECT doc_id, source FROM documents ORDER BY {hx(7, 'doc_id')}, doc_id LIMIT 100")
def _(t):
    return S.sample_k(t.documents.select("doc_id", "source"), 100, 7, DOC)


@query("hash_sample_large", "D1", f"WITH {RANKED} SELECT doc_id, rk AS rank FROM r WHERE rk <= 640")
def _(t):
    return S.hash_rank(t.documents.select("doc_id"), DOC, 7, upto=640).filter("rank <= 640")


@query("resample_to", "D2", f"WITH {RANKED} SELECT doc_id, CAST(unnest(range(1, 2500 // n + CASE WHEN rk <= 2500 % n THEN 1 ELSE 0 END + 1)) AS INT) AS copy FROM r")
def _(t):
    return S.resample_to(t.documents.select("doc_id"), 2500, 7, DOC)


@query("train_val_split", "D3", f"WITH {RANKED} SELECT doc_id, CASE WHEN rk <= greatest(floor(n * 0.05::DOUBLE), 1) THEN 'validation' ELSE 'train' END AS split FROM r")
def _(t):
    return S.train_val_split(t.documents.select("doc_id"), 0.05, 7, DOC)


@query("take_skip_split", "D4", f"WITH {POS} SELECT doc_id, CASE WHEN p < 60 THEN 'validation' ELSE 'train' END AS split FROM r WHERE p < 300")
def _(t):
    return S.take_skip_split(t.documents.select("source", "doc_id"), 300, 0.2, ["source", "doc_id"]).drop("source")


@query("concat_datasets", "D5", "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def _(t):
    return S.concat([t.documents.select(F.col("doc_id").alias("id"), "text", "lang"),
                     t.benchmark.select(F.col("item_id").alias("id"), "text")])


PROB = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
MIX = f"""pr AS (SELECT * FROM (VALUES ('en', 0.4::DOUBLE), ('de', 0.3::DOUBLE), ('fr', 0.2::DOUBLE), ('es', 0.1::DOUBLE)) v(lang, p)),
  k AS (SELECT lang, doc_id, p, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1
    + ('0x' || substr({hx(7, 'lang', 'doc_id')}, 1, 8))::BIGINT / 4294967296.0::DOUBLE) / p AS mix_key FROM documents JOIN pr USING (lang)),
  e AS (SELECT lang, max(mix_key) AS last, count(*) AS n, any_value(p) AS p FROM k GROUP BY lang)"""


@query("interleave_first_exhausted", "D6", f"WITH {MIX} SELECT lang, doc_id, round(mix_key, 6) AS mix_key FROM k WHERE mix_key <= (SELECT min(last) FROM e)")
def _(t):
    return (S.interleave(t.documents.select("lang", "doc_id"), "lang", PROB, ["doc_id"], 7)
            .select("lang", "doc_id", F.round("mix_key", 6).alias("mix_key")))


@query("interleave_all_exhausted", "D6", f"""WITH {MIX}, s AS (SELECT lang, n / p AS span, (SELECT max(last) FROM e) AS stop FROM e),
  x AS (SELECT k.lang, doc_id, unnest(range(0, CAST(floor(stop / span) AS BIGINT) + 1)) AS round, mix_key, span, stop FROM k JOIN s USING (lang))
  SELECT lang, doc_id, CAST(round AS INT) AS round, round(mix_key + round * span, 6) AS mix_key FROM x WHERE mix_key + round * span <= stop""")
def _(t):
    return (S.interleave(t.documents.select("lang", "doc_id"), "lang", PROB, ["doc_id"], 7, "all_exhausted")
            .select("lang", "doc_id", "round", F.round("mix_key", 6).alias("mix_key")))


@query("shuffle", "D7", f"WITH {RANKED} SELECT doc_id, rk AS rank FROM r")
def _(t):
    return S.hash_rank(t.documents.select("doc_id"), DOC, 7)


@query("shuffle_buffer", "D7", "SELECT doc_id FROM documents")
def _(t):
    return S.shuffle_buffer(t.documents.select("doc_id"), 7, DOC)


BUCKET_SQL = ("CASE WHEN chars * 4 <= 2048 THEN '0-2048' WHEN chars * 4 <= 4096 THEN '2049-4096' WHEN chars * 4 <= 8192 THEN '4097-8192' END")


@query("bucket_lengths", "D8", f"WITH {CORPUS_CTE} SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM corpus GROUP BY 1")
def _(t):
    return corpus(t).groupBy(S.bucket_lengths(F.col("chars") * 4).alias("bucket")).agg(F.count("*").alias("n"))


def _pool(t):
    return (corpus(t).select("source", "row_id", (F.col("chars") * 4).alias("tokens"),
                             F.sha2(F.concat_ws("\u001f", "source", F.col("row_id").cast("string")), 256).alias("digest"))
            .withColumn("bucket", S.bucket_lengths("tokens")).filter("bucket IS NOT NULL"))


POOL = f"""{CORPUS_CTE}, pool AS (SELECT source, row_id, chars * 4 AS tokens, sha256(source || chr(31) || row_id) AS digest, {BUCKET_SQL} AS bucket
   FROM corpus WHERE chars * 4 <= 8192), tot AS (SELECT sum(tokens) AS total FROM pool),
  qt AS (SELECT source, bucket, sum(tokens)::BIGINT AS available, count(*) AS candidates, floor(sum(tokens) * least(1.0::DOUBLE, {{0}}::DOUBLE / any_value(total)))::BIGINT AS quota
   FROM pool, tot GROUP BY source, bucket)"""


@query("token_quotas", "D9", f"WITH {POOL.format(200000)} SELECT * FROM qt")
def _(t):
    return S.token_quotas(_pool(t), ["source", "bucket"], "tokens", 200000)


@query("stratified_token_quota_prefix", "D9", f"""WITH {POOL.format(200000)}, c AS (SELECT *, sum(tokens) OVER (PARTITION BY source, bucket ORDER BY digest, source, row_id) AS run FROM pool)
  SELECT c.source, c.bucket, row_id, digest, tokens FROM c JOIN qt USING (source, bucket) WHERE run <= quota""")
def _(t):
    return S.stratified_token_quota(_pool(t), ["source", "bucket"], ["row_id"], "digest", "tokens", 200000, "prefix")


# the fill is sequential, so SQL states it by recursion over the rank inside a stratum
@query("stratified_token_quota", "D9", f"""WITH RECURSIVE {POOL.format(200000)}, o AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY digest, row_id) AS i FROM pool),
  f AS (SELECT source, bucket, 0::BIGINT AS i, 0::BIGINT AS used, FALSE AS hit, NULL::BIGINT AS row_id, NULL::BIGINT AS tokens FROM qt
   UNION ALL SELECT o.source, o.bucket, o.i, CASE WHEN f.used + o.tokens <= quota THEN f.used + o.tokens ELSE f.used END, f.used + o.tokens <= quota, o.row_id, o.tokens
   FROM f JOIN o ON o.source = f.source AND o.bucket = f.bucket AND o.i = f.i + 1 JOIN qt ON qt.source = f.source AND qt.bucket = f.bucket)
  SELECT source, bucket, row_id, tokens FROM f WHERE hit""")
def _(t):
    return S.stratified_token_quota(_pool(t), ["source", "bucket"], ["row_id"], "digest", "tokens", 200000).drop("digest")


# The assignment itself is left to the packer; what must hold for it is stated for every row: it is there once, its bin is within the limit and without gaps, and it
# is rejected where it is longer than a bin.
PACKED = """SELECT doc_id, n_chars, CASE WHEN n_chars > 4096 THEN 'too_long' END AS reason, count(*) OVER (PARTITION BY doc_id) AS times, TRUE AS fits, TRUE AS gapless FROM documents"""


def packed_rows(rows, by):
    """Packed rows with what is true of their bins."""
    bins = rows.filter("reason IS NULL").groupBy(*by).agg((F.sum("n_chars") <= 4096).alias("fits"), ((F.count("slot") == F.max("slot") + 1) & (F.count_distinct("slot") == F.count("*"))).alias("gapless"))
    rejected = F.col("reason").isNotNull() & F.col("bin").isNull()
    times = rows.groupBy("doc_id").agg(F.count("*").alias("times"))
    return rows.join(bins, by, "left").join(times, "doc_id").select("doc_id", "n_chars", "reason", "times", F.coalesce("fits", rejected).alias("fits"), F.coalesce("gapless", rejected).alias("gapless"))


@query("pack_sequences", "D10", PACKED)
def _(t):
    return packed_rows(S.pack_sequences(t.documents, "doc_id", "n_chars", 4096, 8), ["shard", "bin"])


@query("merge_packed", "D11", f"""WITH {TOKEN_CTE} SELECT uid, array_to_string(flatten(list(ids ORDER BY sample)), ',') AS ids,
  array_to_string(flatten(list([0, 1, 2] ORDER BY sample)), ',') AS position_ids, count(*) * 3 AS length, string_agg(stop, ',' ORDER BY sample) AS channels FROM tr GROUP BY uid""")
def _(t):
    rows = token_rollouts(t).select("uid", "sample", "ids", "stop", F.size("ids").cast("long").alias("length"))
    m = S.merge_packed(rows, ["uid"], ["sample"], ["ids"], "length", ["stop"])
    return m.select("uid", F.array_join("ids", ",").alias("ids"), F.array_join("position_ids", ",").alias("position_ids"),
                    "length", F.array_join("stop", ",").alias("channels"))


WORDS = "list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda w: w <> '')"


@query("truncate_tokens", "D12", f"""WITH w AS (SELECT conv_id, turn, {WORDS} AS ws FROM conversations)
  SELECT conv_id, turn, array_to_string(ws[1:8], ' ') AS head, array_to_string(ws[greatest(len(ws) - 7, 1):], ' ') AS tail, len(ws) > 8 AS rejected FROM w""")
def _(t):
    ws = t.conversations.select("conv_id", "turn", F.filter(F.split("text", r"[\t-\r ]+"), lambda w: w != "").alias("ws"))
    rows = ws.withColumn("l", F.col("ws")).withColumn("r", F.col("ws"))
    rows = S.truncate_tokens(S.truncate_tokens(S.truncate_tokens(rows, ["r"], 8), ["l"], 8, "left"), ["ws"], 8, "reject")
    return rows.select("conv_id", "turn", F.array_join("r", " ").alias("head"), F.array_join("l", " ").alias("tail"),
                       F.col("_reject").isNotNull().alias("rejected"))


@query("data_range", "D14", f"WITH {POS} SELECT doc_id FROM r WHERE p >= n // 7 * 2 AND p < n // 7 * 3")
def _(t):
    return S.data_range(t.documents.select("source", "doc_id"), 2, 7, ["source", "doc_id"]).select("doc_id")


@query("even_shards", "D15", f"""WITH {POS} SELECT doc_id, CAST(CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1)
   ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT) AS shard FROM r""")
def _(t):
    return S.even_shards(t.documents.select("source", "doc_id"), 7, ["source", "doc_id"]).select("doc_id", "shard")


@query("drop_tail", "D16", f"WITH {POS} SELECT doc_id FROM r WHERE p < n // 64 * 64")
def _(t):
    return S.drop_tail(t.documents.select("source", "doc_id"), 64, ["source", "doc_id"]).select("doc_id")


@query("split_into_batches", "D17", f"""WITH {RANKED}, b AS (SELECT (n + 10) // 11 AS size, n FROM r LIMIT 1),
  s AS (SELECT unnest(range(1, size * 11 + 1)) AS spot, size, n FROM b)
  SELECT doc_id, CAST((spot - 1) // size AS INT) AS batch, spot > s.n AS pad FROM s JOIN r ON r.rk = (spot - 1) % s.n + 1""")
def _(t):
    return S.split_into_batches(t.documents.select("doc_id"), 11, 7, DOC)


@query("split_into_batches_drop_last", "D17", f"""WITH {RANKED} SELECT doc_id, CAST((rk - 1) // (n // 11) AS INT) AS batch, FALSE AS pad FROM r WHERE rk <= n // 11 * 11""")
def _(t):
    return S.split_into_batches(t.documents.select("doc_id"), 11, 7, DOC, drop_last=True)
