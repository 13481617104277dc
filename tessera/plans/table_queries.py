"""Sources and sinks, table recipes, joins and retrieval, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import normalize as N
from ..operators import retrieve as X
from ..operators import tables as W
from ..operators.scale import shared_folder
from ..sources import io
from .derived import CORPUS_CTE, ROLLOUT_CTE, corpus, rollouts, select
from .registry import query


def r6(df, *keep):
    return df.select(*[c if c in keep or t != "double" else F.round(c, 6).alias(c) for c, t in df.dtypes])


def scratch(t, name):
    """A new folder under the cluster's shared folder (a private one only where none is named)."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks: written, read back, compared

@query("json_array_roundtrip", "S1", "SELECT doc_id, text, lang FROM documents")
def _(t):
    path = scratch(t, "json-array")
    # one array per file, as raw corpora come; a file holds a thousand ids at most
    lines = t.documents.select(F.floor(F.col("doc_id") / 1000).alias("part"), F.to_json(F.struct("doc_id", "text", "lang")).alias("j"))
    arrays = lines.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return io.read_json_array(t.spark, path, "doc_id long, text string, lang string").select("doc_id", "text", "lang")


@query("records_roundtrip", "S2 S4 S6", "SELECT 'jsonl' AS fmt, doc_id, text FROM documents UNION ALL SELECT 'gz', doc_id, text FROM documents UNION ALL SELECT 'csv', doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE replace(text, chr(13), '') END FROM documents UNION ALL SELECT 'parquet', doc_id, text FROM documents")
def _(t):
    d = t.documents.select("doc_id", "text")
    base = scratch(t, "records")
    io.write_jsonl(d, f"{base}/jsonl")
    d.write.option("compression", "gzip").json(f"{base}/gz")
    d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.replace("text", F.lit("\r"), F.lit("")))).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{base}/csv")
    schema = "doc_id long, text string"
    parts = [io.read_records(t.spark, f"{base}/jsonl", "jsonl", schema).withColumn("fmt", F.lit("jsonl")), io.read_gz_jsonl(t.spark, f"{base}/gz", schema).withColumn("fmt", F.lit("gz")),
             io.read_records(t.spark, f"{base}/csv", "csv", schema).withColumn("fmt", F.lit("csv")), io.land(d, f"{base}/parquet").withColumn("fmt", F.lit("parquet"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("read_sources", "S3", "SELECT 'docs' AS source, doc_id AS id, lang FROM documents UNION ALL SELECT 'bench', item_id, NULL FROM benchmark")
def _(t):
    parts = {"docs": t.documents.select(F.col("doc_id").alias("id"), "lang"), "bench": t.benchmark.select(F.col("item_id").alias("id")), "weak": t.labels.select(F.col("doc_id").alias("id"))}
    return io.read_sources(parts, "all", weak=("weak",))


@query("with_row_index", "S5", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row FROM documents")
def _(t):
    return io.with_row_index(t.documents.select("source", "doc_id"), [F.col("doc_id")], ["source"])


@query("row_refs", "S6", f"WITH {CORPUS_CTE} SELECT source, row_id, sha256(prompt) AS digest, chars AS tokens FROM corpus")
def _(t):
    path = scratch(t, "refs")
    io.write_row_refs(corpus(t).select("source", "row_id", F.sha2("prompt", 256).alias("digest"), F.col("chars").alias("tokens"), "answer"), path, ("source", "row_id", "digest", "tokens"))
    return t.spark.read.parquet(path)


@query("write_by_source", "S7", f"WITH {ROLLOUT_CTE} SELECT replace(coalesce(source, 'unknown'), '/', '_') AS source, uid, sample FROM rollouts")
def _(t):
    path = scratch(t, "by-source")
    io.write_by_source(rollouts(t).select("source", "uid", "sample"), path, "source")
    return t.spark.read.schema("uid long, sample long, source string").json(path)


@query("write_rl_parquet", "S8", "SELECT 'math' AS data_source, 'gsm8k' AS env_class, 'user' AS role, text AS content, 'rule' AS method, '' || n_chars AS ground_truth, doc_id AS index, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
def _(t):
    d = t.documents.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))
    rows = io.rl_rows(d, F.lit("math"), F.col("text"), "gsm8k", F.col("n_chars").cast("string"), {"split": F.col("split"), "index": F.col("doc_id")})
    path = scratch(t, "rl")
    io.write_rl_parquet(rows.withColumn("split", F.col("extra_info.split")), path)
    out = t.spark.read.parquet(path)
    return out.select("data_source", "env_class", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "reward_spec.method", "reward_spec.ground_truth", "extra_info.index", "split")


@query("dataset_manifest", "S9", f"""WITH {CORPUS_CTE} SELECT source, count(*) AS raw, count(*) FILTER (turns = 2) AS kept, count(*) FILTER (turns <> 2) AS dropped,
  coalesce(sum(('0x' || substr(sha256(answer), 1, 8))::BIGINT) FILTER (turns = 2), 0)::BIGINT AS content_digest FROM corpus GROUP BY source""")
def _(t):
    rows = corpus(t).withColumn("outcome", F.when(F.col("turns") == 2, "kept").otherwise("short"))
    return io.dataset_manifest(rows, "outcome", F.sha2("answer", 256))


@query("preview_page", "S10", """WITH n AS (SELECT count(*) AS total_rows, greatest((count(*) + 199) // 200, 1) AS total_pages FROM documents), a AS (SELECT *, least(2, total_pages)::BIGINT AS page FROM n),
  p AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT '' || doc_id AS doc_id, substr(text, 1, 500) AS text, lang, source, '' || n_chars AS n_chars, total_rows, 5 AS total_columns, total_pages, page FROM p, a WHERE i // 200 = page - 1""")
def _(t):
    page, totals = io.preview_page(t.documents, ["doc_id"], 2, 5000)
    return page.crossJoin(totals)  # totals are one row


CAT = ("documents", "orders", "nation")


@query("table_catalog", "S11", " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS n_rows, {c}::INT AS n_columns, '{cols}' AS columns" for n, c, cols in (
    ("documents", 5, "doc_id,text,lang,source,n_chars"), ("orders", 6, "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority"), ("nation", 3, "n_nationkey,n_name,n_regionkey"))))
def _(t):
    return io.table_catalog({n: getattr(t, n) for n in CAT})


# ---- table recipes

@query("table_totals", "W1", "SELECT count(o_totalprice) AS count, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 6) AS mean FROM orders")
def _(t):
    return W.totals(t.orders, "o_totalprice").select("count", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("join_totals", "W2 J6", "SELECT c_mktsegment, round(sum(o_totalprice), 4) AS total, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return W.join_totals(o, t.customer, "c_custkey", "c_mktsegment", "o_totalprice").select("c_mktsegment", F.round("total", 4).alias("total"), "count")


@query("clean_rows", "W3", "SELECT count(*) AS count, round(sum(v), 4) AS total, round(avg(v), 6) AS mean FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) WHERE v <= 200000")
def _(t):
    rows = t.orders.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))
    return W.totals(W.clean_rows(rows, "v", 200000.0), "v").select("count", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("ordered_totals", "W4", """WITH s AS (SELECT o_orderpriority AS p, sum(o_totalprice) AS total FROM orders GROUP BY 1)
  SELECT p AS o_orderpriority, round(total, 4) AS total, CASE p WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS position, round(total / sum(total) OVER (), 6) AS share FROM s""")
def _(t):
    return W.ordered_totals(t.orders, "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"], "o_totalprice").select("o_orderpriority", F.round("total", 4).alias("total"), "position", F.round("share", 6).alias("share"))


@query("value_counts", "W5", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return W.value_counts(t.events, "event_type")


@query("describe", "W5", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c})::DOUBLE AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM part" for c in ("p_size", "p_retailprice")))
def _(t):
    return r6(W.describe(t.part, ["p_size", "p_retailprice"]))


@query("crosstab", "W5", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def _(t):
    return W.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("many_partners", "W6", "SELECT l_partkey, count(DISTINCT l_suppkey) AS partners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(t):
    return W.many_partners(t.lineitem, "l_partkey", "l_suppkey")


@query("modelling_table", "W7 J2", "SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    c = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    out = W.modelling_table(t.orders.select("o_orderkey", "o_custkey"), [(c, "o_custkey"), (t.nation, "n_nationkey"), (t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")])
    return out.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("chi_square", "W8", """WITH c AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT r, c, (SELECT sum(n) FROM c x WHERE x.r = a.r) * (SELECT sum(n) FROM c x WHERE x.c = b.c) / (SELECT sum(n) FROM c) AS e FROM (SELECT DISTINCT r FROM c) a, (SELECT DISTINCT c FROM c) b)
  SELECT round(sum((coalesce(n, 0) - e) ** 2 / e), 6) AS chi2, 8::BIGINT AS dof, sum(n)::BIGINT AS n FROM e LEFT JOIN c USING (r, c)""")
def _(t):
    return r6(W.chi_square(t.orders, "o_orderpriority", "o_orderstatus"))


@query("stratified_rates", "W8", """WITH x AS (SELECT l_returnflag AS stratum, l_linestatus AS g, CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0 END AS e FROM lineitem) SELECT coalesce(stratum, 'pooled') AS stratum, g AS "group", count(*) AS n, round(avg(e), 6) AS rate FROM x GROUP BY GROUPING SETS ((stratum, g), (g))""")
def _(t):
    return r6(W.stratified_rates(t.lineitem, "l_returnflag", "l_linestatus", F.col("l_discount") > 0.04))


@query("winsorise", "W9", "WITH q AS (SELECT quantile_disc(o_totalprice, 0.05) AS a, quantile_disc(o_totalprice, 0.95) AS b FROM orders) SELECT o_orderkey, greatest(least(o_totalprice, b), a) AS o_totalprice FROM orders, q")
def _(t):
    return W.winsorise(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 0.05, 0.95)


# Twelve Newton steps on the three coefficients, each from sums over all rows, solved by Cramer's rule.
def _det(*m):
    a, b, c, d, e, f, g, h, i = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _replaced(col):
    rows = [["h00", "h01", "h02"], ["h01", "h11", "h12"], ["h02", "h12", "h22"]]
    return _det(*[f"g{r}" if c == col else rows[r][c] for r in range(3) for c in range(3)])


NEWTON = f"""WITH RECURSIVE x AS (SELECT quality::DOUBLE AS y, n_chars / 1000.0::DOUBLE AS u, toxic::DOUBLE AS v FROM documents JOIN labels USING (doc_id)),
  b AS (SELECT 0 AS i, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 UNION ALL SELECT i + 1, b0 + {_replaced(0)} / det, b1 + {_replaced(1)} / det, b2 + {_replaced(2)} / det FROM (
    SELECT *, {_det('h00', 'h01', 'h02', 'h01', 'h11', 'h12', 'h02', 'h12', 'h22')} AS det FROM (
      SELECT i, b0, b1, b2, sum(y - p) AS g0, sum((y - p) * u) AS g1, sum((y - p) * v) AS g2, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * u) AS h01, sum(p * (1 - p) * v) AS h02,
        sum(p * (1 - p) * u * u) AS h11, sum(p * (1 - p) * u * v) AS h12, sum(p * (1 - p) * v * v) AS h22 FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS p FROM b, x WHERE i < 12) GROUP BY i, b0, b1, b2)))
  SELECT unnest(['intercept', 'kilochars', 'toxic']) AS term, round(unnest([b0, b1, b2]), 4) AS coefficient FROM b WHERE i = 12"""


@query("logistic_regression", "W10", NEWTON)
def _(t):
    rows = t.documents.join(t.labels, "doc_id").select("quality", (F.col("n_chars") / 1000).alias("kilochars"), "toxic")
    return W.logistic_regression(rows, "quality", ["kilochars", "toxic"]).select("term", F.round("coefficient", 4).alias("coefficient"))


@query("group_traits", "W11", """WITH x AS (SELECT p_brand, p_type, p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS price FROM part) SELECT p_brand, count(*) AS n, count(*) FILTER (p_size IS NULL) AS p_size_missing, round(avg(p_size), 6) AS p_size_mean,
  round(avg(p_size) FILTER (p_type = 'PROMO') - avg(p_size) FILTER (p_type = 'ECONOMY'), 6) AS p_size_gap, count(*) FILTER (price IS NULL) AS price_missing, round(avg(price), 6) AS price_mean, round(avg(price) FILTER (p_type = 'PROMO') - avg(price) FILTER (p_type = 'ECONOMY'), 6) AS price_gap FROM x GROUP BY 1""")
def _(t):
    rows = t.part.withColumn("price", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")))
    return r6(W.group_traits(rows, "p_brand", "p_type", "PROMO", "ECONOMY", ["p_size", "price"]))


@query("grouped_correlation", "W12", "SELECT coalesce(l_returnflag, 'overall') AS l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def _(t):
    return r6(W.grouped_correlation(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice"))


@query("change_between", "W13", """WITH v AS (SELECT o_custkey, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 2) AS before, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1998), 2) AS after FROM orders GROUP BY 1),
  c AS (SELECT *, round(after - before, 2) AS change FROM v WHERE before IS NOT NULL AND after IS NOT NULL) SELECT o_custkey, before, after, change, after >= before AS recovered, rank() OVER (ORDER BY change DESC) AS rank FROM c""")
def _(t):
    rows = t.orders.select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    out = W.change_between(rows, "o_custkey", "y", "v", 1996, 1998)
    return out.select("o_custkey", *[F.col(c).cast("double").alias(c) for c in ("before", "after", "change")], "recovered", "rank")


@query("reconcile", "W14", """WITH f AS (SELECT l_orderkey AS k, sum(l_quantity) AS q, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), c AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 0 - o_orderkey - 1 ELSE o_orderkey END AS k, q + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS q, n + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS n FROM orders LEFT JOIN f ON f.k = o_orderkey)
  SELECT coalesce(f.k, c.k) AS k, f.q AS fine_q, f.n AS fine_n, c.q AS coarse_q, c.n AS coarse_n, CASE WHEN f.k IS NULL THEN 'missing_in_fine' WHEN c.k IS NULL THEN 'missing_in_coarse' ELSE 'differs: ' || array_to_string(list_filter([CASE WHEN f.q <> c.q THEN 'q' END, CASE WHEN f.n <> c.n THEN 'n' END], lambda x: x IS NOT NULL), ',') END AS problem
  FROM f FULL JOIN c ON f.k = c.k WHERE f.k IS NULL OR c.k IS NULL OR f.q <> c.q OR f.n <> c.n""")
def _(t):
    fine = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"), F.lit(1.0).alias("n"))
    agg = fine.groupBy("k").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
    k = F.col("o_orderkey")
    coarse = (t.orders.join(agg, agg["k"] == k, "left")
              .select(F.when(k % 17 == 0, -k - 1).otherwise(k).alias("k"), (F.col("q") + (k % 11 == 0).cast("int")).alias("q"), (F.col("n") + (k % 13 == 0).cast("int")).alias("n")))
    return W.reconcile(fine, coarse, ["k"], ["q", "n"])


@query("yearly_growth", "W15", "WITH y AS (SELECT c_mktsegment, year(o_orderdate)::INT AS year, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT c_mktsegment, year, round(total, 2) AS total, round(total / lag(total) OVER (PARTITION BY c_mktsegment ORDER BY year) - 1, 6) AS growth FROM y")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return W.yearly_growth(rows, "c_mktsegment", F.year("o_orderdate"), "o_totalprice").select("c_mktsegment", "year", F.round("total", 2).alias("total"), F.round("growth", 6).alias("growth"))


@query("peak_slots", "W16", """WITH p AS (SELECT CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, hour(ts)::INT AS slot, avg(value) AS mean, count(*) AS support FROM events GROUP BY ALL)
  SELECT day_type, slot, round(mean, 6) AS mean, support FROM p QUALIFY row_number() OVER (PARTITION BY day_type ORDER BY p.mean DESC, slot) = 1""")
def _(t):
    day = F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday")
    return r6(W.peak_slots(t.events, day, F.hour("ts"), "value"))


@query("condition_totals", "W16", "SELECT event_type, value > 10 AS high, round(sum(value), 4) AS total, count(*) AS support FROM events GROUP BY ALL")
def _(t):
    return W.condition_totals(t.events, [F.col("event_type"), F.col("value") > 10], ["event_type", "high"], "value").select("event_type", "high", F.round("total", 4).alias("total"), "support")


@query("filtered_ranking", "W17", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND c_acctbal > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return W.filtered_ranking(rows, (F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderstatus") == "F") & (F.col("c_acctbal") > 1000), [F.desc("o_totalprice"), F.col("o_orderkey")], 50, ["o_orderkey", "c_name", "o_totalprice"])


# ---- retrieval

BM25 = """WITH q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> '') AS t FROM benchmark), qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(t) AS term FROM q) GROUP BY ALL),
  d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> '') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
  p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  h AS (SELECT item_id, doc_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / a))) AS score FROM qt JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h)"""


@query("bm25_topk", "T1", BM25 + " SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def _(t):
    return r6(X.bm25_topk(t.benchmark, t.spread("documents"), 10, "item_id", "text", "doc_id", "text"))


DENSE = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT query_id, e.vec_id, list_inner_product(v, e.embedding::DOUBLE[]) AS score FROM q, embeddings e),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query("dense_topk", "T2", DENSE + " SELECT query_id, vec_id, round(score, 5) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def _(t):
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    out = X.dense_topk(q, t.embeddings, 10, "query_id", "qv", "vec_id", "embedding")
    return out.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@query("attach_documents", "T3", BM25 + """ SELECT item_id, r.doc_id, rank::INT AS rank, replace(string_split(text, chr(10))[1], '"', '') AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS contents FROM r JOIN documents USING (doc_id) WHERE rank <= 3""")
def _(t):
    hits = X.bm25_topk(t.benchmark, t.spread("documents"), 3, "item_id", "text", "doc_id", "text").drop("score")
    return X.attach_documents(hits, t.documents, "doc_id", "text")


@query("build_search_prompts", "T4", "SELECT doc_id, 'searchR1_' || source AS data_source, 'Answer. Question: ' || text AS content, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'fallback' END AS ground_truth, 'search' AS tool FROM documents")
def _(t):
    d = t.documents.withColumn("gold", F.when(F.col("doc_id") % 3 == 0, F.col("lang")))
    rows = X.build_search_prompts(d.withColumn("src", F.col("source")), "Answer. Question: ", "text", F.col("gold"), F.lit("fallback"), F.concat(F.col("src"), F.lit("|"), F.col("doc_id").cast("string")))
    key = F.split("data_source", r"\|")
    return rows.select(key[1].cast("long").alias("doc_id"), key[0].alias("data_source"), F.col("prompt")[0]["content"].alias("content"), "reward_spec.ground_truth", "extra_info.tool")
