"""Audit queries over the derived corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from .derived import CORPUS_CTE, corpus, select
from .registry import query

WS = T.SPACE
TAG = r"(?m)^[ \t]*<(/?(?:Analyze|Understand|Code|Execute|Answer))>"


def squash_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '\\A | \\z', '', 'g')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def copies_sql(x: str) -> str:
    return (f"coalesce(list_max(map_values(list_aggregate(list_filter(list_transform(regexp_split_to_array({x}, "
            f"'{T.LINE_END}'), lambda s: {strip_sql('s')}), lambda s: length(s) > 30), 'histogram'))), 0)")


CHECKED_CTE = f"""{CORPUS_CTE}, tok AS (
  SELECT *, regexp_extract_all(answer, '{TAG}', 1) AS tk,
    turns = 2 AND role1 = 'user' AND {strip_sql('prompt')} <> '' AND {strip_sql('answer')} <> '' AS schema_ok,
    (length(answer) - length(replace(answer, '```', ''))) / 3 % 2 = 1 AS fence_open,
    {copies_sql('answer')} AS line_copies,
    CASE WHEN turns = 2 THEN sha256(role1 || chr(31) || prompt || chr(30) || 'assistant' || chr(31) || answer)
         ELSE sha256(role1 || chr(31) || prompt) END AS digest,
    {squash_sql('prompt')} AS nprompt FROM corpus),
checked AS (SELECT *, len(list_filter(range(len(tk) // 2), lambda i: starts_with(tk[2*i+1], '/') OR tk[2*i+2] <> '/' || tk[2*i+1])) = 0
    AND len(tk) % 2 = 0 AS tags_ok, list_filter(tk, lambda x: NOT starts_with(x, '/')) AS seq,
    nprompt IN (SELECT {squash_sql('text')} FROM benchmark) AS is_eval FROM tok)"""


@query("check_schema", "Q1", f"WITH {CHECKED_CTE} SELECT source, schema_ok, count(*) AS n FROM checked GROUP BY ALL")
def _(t):
    return A.check_schema(corpus(t)).groupBy("source", "schema_ok").agg(F.count("*").alias("n"))


@query("check_action_tags", "Q2",
       f"WITH {CHECKED_CTE} SELECT source, row_id, array_to_string(seq, '->') AS seq, tags_ok FROM checked WHERE turns = 2")
def _(t):
    rows = corpus(t).filter("turns = 2")
    return A.check_action_tags(rows, "answer").select(
        "source", "row_id", F.array_join("tag_sequence", "->").alias("seq"), "tags_ok")


@query("tag_sequence_histogram", "Q3",
       f"WITH {CHECKED_CTE} SELECT CASE WHEN len(seq) = 0 THEN '<none>' ELSE array_to_string(seq, '->') END AS sequence, "
       "count(*) AS n FROM checked GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def _(t):
    return A.tag_sequence_histogram(corpus(t), "answer", n=20)


@query("tag_presence", "Q4", f"WITH {CHECKED_CTE} " + " UNION ALL ".join(
    f"SELECT '{a}' AS action, count(*) FILTER (list_contains(seq, '{a}')) AS n FROM checked" for a in T.ACTIONS))
def _(t):
    return A.tag_presence(corpus(t), "answer")


@query("check_token_fields", "Q5", f"""WITH {CORPUS_CTE} SELECT source, count(*) AS n_rows,
  count(*) FILTER (input_tokens < 0) AS invalid_input, count(*) FILTER (output_tokens < 0) AS invalid_output,
  count(*) FILTER (total_tokens < 0) AS invalid_total,
  count(*) FILTER (input_tokens >= 0 AND input_tokens + output_tokens <> total_tokens) AS sum_mismatch,
  count(*) FILTER (total_tokens > 2000) AS over_limit,
  round(count(*) FILTER (total_tokens > 2000) / count(*), 6) AS over_limit_rate FROM corpus GROUP BY source""")
def _(t):
    return A.check_token_fields(corpus(t), 2000, by=["source"])


@query("check_code_fences", "Q6", f"""WITH {CHECKED_CTE} SELECT fence_open,
  contains(lower(answer), '```python') AS has_python_fence, count(*) AS n FROM checked GROUP BY ALL""")
def _(t):
    return (A.check_code_fences(corpus(t), "answer").groupBy("fence_open", "has_python_fence")
            .agg(F.count("*").alias("n")))


@query("check_line_repetition", "Q7",
       f"WITH {CHECKED_CTE} SELECT source, row_id, CAST(line_copies AS BIGINT) AS line_copies, line_copies >= 10 AS repetitive FROM checked")
def _(t):
    return (A.check_line_repetition(corpus(t), "answer")
            .select("source", "row_id", F.col("line_copies").cast("long").alias("line_copies"), "repetitive"))


@query("exclude_eval_prompts", "Q8 J3", f"WITH {CHECKED_CTE} SELECT source, row_id FROM checked WHERE NOT is_eval")
def _(t):
    return A.exclude_eval_prompts(corpus(t), "prompt", t.benchmark, "text").select("source", "row_id")


@query("dedup_conversations", "Q9", f"""WITH {CHECKED_CTE} SELECT source, row_id, length(answer) AS chars FROM checked
  QUALIFY row_number() OVER (PARTITION BY digest ORDER BY source, row_id) = 1""")
def _(t):
    return (A.dedup_conversations(corpus(t), ["source", "row_id"])
            .select("source", "row_id", F.length("answer").cast("long").alias("chars")))


@query("filter_waterfall", "Q10 Q11", f"""WITH {CHECKED_CTE}, reasons AS (
  SELECT source, row_id, digest, CASE WHEN NOT schema_ok THEN 'schema_invalid' WHEN NOT tags_ok THEN 'tag_invalid'
    WHEN fence_open THEN 'unclosed_fence' WHEN line_copies >= 10 THEN 'repetitive_answer'
    WHEN is_eval THEN 'exact_eval_prompt' ELSE 'candidate' END AS r FROM checked),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY digest, r ORDER BY source, row_id) AS rn FROM reasons),
 final AS (SELECT source, CASE WHEN r <> 'candidate' THEN r WHEN rn > 1 THEN 'exact_duplicate'
    WHEN ('0x' || substr(digest, 1, 8))::BIGINT < 1073741824 THEN 'sampled' ELSE 'outside_sample' END AS reason FROM ranked)
 SELECT source, """ + ", ".join(f"count(*) FILTER (reason = '{c}') AS {c}" for c in (
    "schema_invalid", "tag_invalid", "unclosed_fence", "repetitive_answer", "exact_eval_prompt", "exact_duplicate",
    "outside_sample", "sampled")) + ", count(*) AS raw FROM final GROUP BY source")
def _(t):
    return A.filter_waterfall(A.repair_reasons(corpus(t), t.benchmark, "text"), 0.25, ["source", "row_id"])


@query("length_filter", "Q12 D13", f"WITH {CORPUS_CTE} SELECT source, count(*) AS n, sum(total_tokens)::BIGINT AS tokens "
       "FROM corpus WHERE total_tokens <= 1200 GROUP BY source")
def _(t):
    return (A.length_filter(corpus(t), "total_tokens", 1200).groupBy("source")
            .agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")))


@query("length_distribution", "Q13", f"""WITH {CORPUS_CTE}, long AS (
  SELECT 'total_tokens' AS field, total_tokens AS v FROM corpus UNION ALL SELECT 'answer_chars', length(answer) FROM corpus
  UNION ALL SELECT 'prompt_chars', length(prompt) FROM corpus),
 r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY field) AS n FROM long)
 SELECT field, any_value(n) AS count, min(v) AS min,
  max(v) FILTER (i = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(v) FILTER (i = round_even((n - 1) * 0.9::DOUBLE, 0)) AS p90,
  max(v) FILTER (i = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95, max(v) FILTER (i = round_even((n - 1) * 0.99::DOUBLE, 0)) AS p99,
  max(v) AS max, round(sum(v)::DOUBLE / any_value(n), 2) AS mean FROM r GROUP BY field""")
def _(t):
    rows = corpus(t).select("total_tokens", F.length("answer").alias("answer_chars"), F.length("prompt").alias("prompt_chars"))
    return A.length_distribution(rows, ["total_tokens", "answer_chars", "prompt_chars"])


@query("role_sequence_histogram", "Q14",
       "WITH s AS (SELECT conv_id, string_agg(role, '->' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) "
       "SELECT roles, count(*) AS n FROM s GROUP BY roles")
def _(t):
    from ..operators.normalize import turns_to_messages
    return A.role_sequence_histogram(turns_to_messages(t.conversations, "conv_id", "turn", "role", "text"))


KEYS_JSON = ("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{\"z\": 1, \"a\": ' || user_id || '}' "
             "ELSE '{\"messages\": [], \"id\": 3}' END")


@query("key_set_histogram", "Q14", f"SELECT array_to_string(list_sort(json_keys({KEYS_JSON})), ',') AS keys, count(*) AS n "
       "FROM events GROUP BY 1")
def _(t):
    return A.key_set_histogram(select(t.events, j=KEYS_JSON), "j")


@query("id_diagnostics", "Q15 S5", f"""WITH {CORPUS_CTE}, r AS (SELECT source, row_id, id,
   row_number() OVER (PARTITION BY source ORDER BY row_id) - 1 AS pos, lag(id) OVER (PARTITION BY source ORDER BY row_id) AS prev FROM corpus)
  SELECT source, count(DISTINCT id) AS unique_ids, count(*) - count(DISTINCT id) AS repeated_rows,
   count(*) FILTER (id <> pos) AS off_position_rows, count(*) FILTER (id <= prev) AS resets FROM r GROUP BY source""")
def _(t):
    return A.id_diagnostics(corpus(t))


@query("id_reset_examples", "Q15", f"""WITH {CORPUS_CTE}, r AS (SELECT source, row_id, id, lag(id) OVER (PARTITION BY source ORDER BY row_id) AS previous_id FROM corpus)
  SELECT source, row_id, previous_id, id, row_number() OVER (PARTITION BY source ORDER BY row_id) AS example FROM r WHERE id <= previous_id
  QUALIFY example <= 20""")
def _(t):
    return A.id_reset_examples(corpus(t)).withColumn("example", F.col("example").cast("long"))


ERRORS_SQL = f"""errs AS (
  SELECT source, row_id, unnest(list_filter([
    CASE WHEN turns = 1 OR role1 <> 'user' THEN 'unexpected_role_sequence' END,
    CASE WHEN turns = 1 THEN 'unexpected_message_shape' END,
    CASE WHEN turns = 2 AND (length(prompt) = 0 OR length(answer) = 0) THEN 'empty_or_non_string_content' END,
    CASE WHEN filled AND NOT tags_ok THEN 'malformed_action_tags' END,
    CASE WHEN filled AND input_tokens < 0 THEN 'invalid_input_tokens' END,
    CASE WHEN filled AND output_tokens < 0 THEN 'invalid_output_tokens' END,
    CASE WHEN filled AND total_tokens < 0 THEN 'invalid_total_tokens' END,
    CASE WHEN filled AND least(input_tokens, output_tokens, total_tokens) >= 0 AND input_tokens + output_tokens <> total_tokens THEN 'token_sum_mismatch' END
  ], lambda x: x IS NOT NULL)) AS kind FROM (SELECT *, turns = 2 AND length(prompt) > 0 AND length(answer) > 0 AS filled FROM checked)),
  er AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY source, row_id) AS rk FROM errs)"""


@query("error_report", "Q16", f"""WITH {CHECKED_CTE}, {ERRORS_SQL}
  SELECT kind, count(*) AS n, string_agg(source || ':' || row_id, ';' ORDER BY rk) FILTER (rk <= 20) AS examples FROM er GROUP BY kind""")
def _(t):
    return A.error_report(corpus(t), A.record_errors(), F.concat_ws(":", "source", "row_id"), ["source", "row_id"])


@query("expect_count", "Q17", "SELECT 'record_count_mismatch' AS kind, 3::BIGINT AS expected, count(*) AS actual FROM documents")
def _(t):
    return A.expect_count(t.documents, 3)


@query("audit_corpus", "Q18 Q3 Q4 Q5 Q13 Q14 Q16", f"""WITH {CHECKED_CTE}, {ERRORS_SQL},
  good AS (SELECT * FROM checked WHERE turns = 2 AND length(prompt) > 0 AND length(answer) > 0),
  long AS (SELECT 'input_tokens' AS f, input_tokens AS v FROM good UNION ALL SELECT 'output_tokens', output_tokens FROM good
    UNION ALL SELECT 'total_tokens', total_tokens FROM good UNION ALL SELECT 'user_chars', length(prompt) FROM good
    UNION ALL SELECT 'assistant_chars', length(answer) FROM good),
  r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM long),
  st AS (""" + " UNION ALL ".join(
    [f"SELECT f || '.{n}' AS item, {e}::DOUBLE AS value FROM r GROUP BY f" for n, e in
     [("count", "count(*)"), ("min", "min(v)"), ("max", "max(v)"), ("mean", "round(avg(v), 2)")]
     + [(n, f"max(v) FILTER (i = round_even((n - 1) * {q}::DOUBLE, 0))") for n, q in A.QUANTILES]]) + """)
  SELECT 'content' AS section, 'tagged_records' AS item, count(*) FILTER (len(seq) > 0)::DOUBLE AS value FROM good
  UNION ALL SELECT 'content', 'python_fence_records', count(*) FILTER (contains(lower(answer), '```python')) FROM good
  UNION ALL SELECT 'content', 'over_limit', count(*) FILTER (total_tokens > 2000) FROM good """ + " ".join(
    f"UNION ALL SELECT 'content', 'opens_{a}', count(*) FILTER (list_contains(seq, '{a}')) FROM good" for a in T.ACTIONS) + """
  UNION ALL SELECT 'content', 'duplicate_conversations', count(*) - count(DISTINCT digest) FROM good
  UNION ALL SELECT 'records', 'records', count(*) FROM checked
  UNION ALL SELECT 'role_sequence', CASE WHEN turns = 2 THEN role1 || '->assistant' ELSE role1 END AS x, count(*) FROM checked GROUP BY x
  UNION ALL SELECT 'error', kind, count(*) FROM er GROUP BY kind
  UNION ALL SELECT 'length', item, value FROM st
  UNION ALL SELECT * FROM (SELECT 'tag_sequence', CASE WHEN len(seq) = 0 THEN '<none>' ELSE array_to_string(seq, '->') END AS x, count(*) AS c
    FROM good GROUP BY x ORDER BY c DESC, x LIMIT 20)""")
def _(t):
    return A.audit_corpus(corpus(t), 2000, sequences=20)


CODE = dict(problem_id="doc_id", response="CASE doc_id % 7 WHEN 0 THEN text WHEN 1 THEN '```python' || chr(10) || 'import Subprocess' || chr(10) || '```' || text "
            "WHEN 2 THEN text || '```python x ``` then ```python' || chr(10) || 'eval(a)' || '```' WHEN 3 THEN '```python open(/etc/x); socket ```' "
            "WHEN 4 THEN '```python shutil.rmtree(a)' || text || '```' ELSE '```python' || text || '```' END", lang="lang")
CODE_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in CODE.items()) + " FROM documents"


def _risk(tokens):
    return "(" + " OR ".join(f"contains(code, '{x}')" for x in tokens) + ")"


@query("audit_generated_code", "Q19", f"""WITH a AS ({CODE_SQL}), b AS (SELECT *, regexp_extract_all(response, '(?s)```python.*?```')[-1] AS blk FROM a),
  c AS (SELECT *, blk IS NULL AS missing, coalesce(lower(blk), '') AS code FROM b)
  SELECT lang, count(*) AS records, """ + ", ".join(f"count(*) FILTER ({_risk(v)}) AS {k}" for k, v in A.RISK_TOKENS.items()) + f""",
  count(*) FILTER (missing) AS missing_block, count(*) FILTER ({_risk(A.REVIEW_TOKENS)}) AS dynamic_review,
  count(*) FILTER (NOT ({' OR '.join(_risk(v) for v in A.RISK_TOKENS.values())})) AS passed FROM c GROUP BY lang""")
def _(t):
    return A.code_risk_summary(select(t.documents, **CODE), "response", ["lang"])


COVER = dict(id="CASE WHEN doc_id % 97 = 5 THEN doc_id + 1 ELSE doc_id END", score="CASE WHEN doc_id % 53 = 2 THEN 7 ELSE quality END")


@query("check_id_coverage", "Q20 J5", "WITH a AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COVER.items()) + """ FROM labels),
  s AS (SELECT id, count(*) AS n, count(*) FILTER (score NOT IN (0, 1)) AS bad FROM a GROUP BY id), w AS (SELECT doc_id AS want FROM documents)
  SELECT coalesce(id, want) AS id, CASE WHEN n IS NULL THEN 'missing' WHEN want IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' ELSE 'bad_score' END AS problem
  FROM s FULL JOIN w ON id = want WHERE n IS NULL OR want IS NULL OR n > 1 OR bad > 0""")
def _(t):
    return A.check_id_coverage(select(t.labels, **COVER), "id", t.documents.select("doc_id"), "score")


@query("token_volume_estimate", "Q21 D1", f"""WITH {CORPUS_CTE}, s AS (SELECT CASE WHEN chars <= 8192 THEN chars ELSE 0 END::DOUBLE AS v, chars FROM corpus
   ORDER BY sha256('42' || chr(31) || source || chr(31) || row_id), source, row_id LIMIT 256),
  g AS (SELECT count(*) AS sample_size, avg(v) AS m, stddev_samp(v) AS sd, count(*) FILTER (chars > 8192) AS over_limit FROM s), c AS (SELECT count(*) AS records FROM corpus)
  SELECT records, sample_size, over_limit, round_even(m * records, 0)::BIGINT AS estimated_tokens,
   round_even((m - 1.96 * (sd / sqrt(sample_size))) * records, 0)::BIGINT AS low, round_even((m + 1.96 * (sd / sqrt(sample_size))) * records, 0)::BIGINT AS high,
   ceil(m * records / 8192)::BIGINT AS packed_sequences FROM g, c""")
def _(t):
    return A.token_volume_estimate(corpus(t), ["source", "row_id"], "chars", 256, 42)
