"""Inputs derived from the given tables, written once as SQL expressions that Spark and the oracle both evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NL = "chr(10)"


def select(df: DataFrame, **cols: str) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])


def sql_cols(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in cols.items())


DOC_BASE = dict(source="source", row_id="doc_id", prompt="'Describe: ' || text", body="text",
                chars="CAST(length(text) AS BIGINT)")
BENCH_BASE = dict(source="'bench'", row_id="item_id", prompt=f"'  ' || text || {NL} || chr(9)", body="text",
                  chars="CAST(length(text) AS BIGINT)")


def block(*parts: str) -> str:
    return f" || {NL} || ".join(parts)


ANSWER = "CASE chars % 12 " + " ".join(f"WHEN {k} THEN {v}" for k, v in {
    0: block("'<Analyze>'", "body", "'</Analyze>'", "'  <Answer>'", "'n = ' || chars", "'</Answer>'"),
    1: block("'<Analyze>'", "'<Code>'", "body", "'</Code>'", "'</Analyze>'"),
    2: block("'<Answer>'", "body"),
    3: block("'<Understand>'", "body", "'</Understand>'", "'<Code>'", "'```Python'", "'print(' || chars || ')'", "'```'", "'</Code>'",
             "'<Execute>'", "'' || chars", "'</Execute>'", "'<Answer>'", "'it is ' || chars", "'</Answer>'"),
    4: block("body", "'```python'", "'x = 1'"),
    5: f"body || {NL} || repeat('this very line comes back more than ten times' || {NL}, CAST(9 + chars % 4 AS INT))",
    6: "'   '",
    7: block("'</Answer>'", "body"),
}.items()) + " ELSE body END"
CORPUS = dict(
    source="source", row_id="row_id", id="CASE WHEN row_id % 50 = 7 THEN row_id % 9 ELSE row_id END",
    role1="CASE WHEN chars % 17 = 3 THEN 'system' ELSE 'user' END", turns="CASE WHEN chars % 19 = 4 THEN 1 ELSE 2 END",
    prompt="prompt", answer=ANSWER, chars="chars",
    input_tokens="CASE WHEN chars % 29 = 3 THEN -1 ELSE chars END", output_tokens="chars % 101",
    total_tokens="chars + chars % 101 + CASE WHEN chars % 23 = 5 THEN 1 ELSE 0 END")
CORPUS_CTE = (f"base AS (SELECT {sql_cols(DOC_BASE)} FROM documents UNION ALL SELECT {sql_cols(BENCH_BASE)} FROM benchmark), "
              f"corpus AS (SELECT {sql_cols(CORPUS)} FROM base)")


def corpus(t) -> DataFrame:
    """Documents and benchmark items as two-turn records with tags, fences, repeated lines and token counts."""
    base = select(t.spread("documents"), **DOC_BASE).unionByName(select(t.benchmark, **BENCH_BASE))
    flat = select(base, **CORPUS)
    first = F.struct(F.col("role1").alias("role"), F.col("prompt").alias("content"))
    second = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    return flat.withColumn("messages", F.when(F.col("turns") == 2, F.array(first, second)).otherwise(F.array(first)))


# Rollouts: one order is one prompt, its lines are the samples.
ROLLOUT = dict(
    uid="l_orderkey",
    sample="((l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)",
    reward="CASE WHEN l_orderkey % 7 = 3 THEN 0.5E0 WHEN l_orderkey % 11 = 5 THEN 0E0 ELSE l_discount * 10 END",
    price="l_extendedprice",
    source="CASE l_orderkey % 4 WHEN 0 THEN 'web/a' WHEN 1 THEN 'web/b' WHEN 2 THEN 'lab' ELSE NULL END",
    tokens="CAST(l_quantity AS BIGINT)",
    stop="CASE WHEN l_linestatus = 'F' THEN 'stop' ELSE 'length' END")
ROLLOUT_CTE = f"rollouts AS (SELECT {sql_cols(ROLLOUT)} FROM lineitem)"


def rollouts(t) -> DataFrame:
    return select(t.lineitem, **ROLLOUT)


# Token-level rollouts: short integer and float lists made from the numbers of a line.
TOKEN_ROLLOUT = {**ROLLOUT,
                 "rewards": "{arr}(l_discount * 10, l_tax * 10, l_discount * 20)",
                 "val": "{arr}(l_tax * 5, l_discount * 5, l_tax * 10)",
                 "mask": "{arr}(1, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END)",
                 "logp": "{arr}(0E0 - l_discount - 0.5E0, 0E0 - l_tax - 0.4E0, 0E0 - l_discount - l_tax)",
                 "base_logp": "{arr}(0E0 - l_tax - 0.5E0, 0E0 - l_discount - 0.3E0, 0E0 - l_tax - 0.1E0)",
                 "ids": "{arr}(CAST(l_partkey % 100 AS INT), CAST(l_suppkey % 100 AS INT), CAST(l_linenumber AS INT))"}


def token_rollouts(t) -> DataFrame:
    return select(t.spread("lineitem"), **{k: v.format(arr="array") for k, v in TOKEN_ROLLOUT.items()})


TOKEN_CTE = "tr AS (SELECT " + sql_cols({k: v.format(arr="list_value") for k, v in TOKEN_ROLLOUT.items()}) + " FROM lineitem)"
