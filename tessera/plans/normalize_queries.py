"""Normalisation and recipe queries, with their SQL.  Message arrays are written as 'role=content' lines to compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import normalize as N
from ..operators import recipes as P
from ..operators.audit import turn
from .derived import select
from .registry import query


def flat(c="messages"):
    return F.array_join(F.transform(c, lambda m: F.concat(F.coalesce(m["role"], F.lit("?")), F.lit("="), F.coalesce(m["content"], F.lit("?")))), "\n").alias(c)


def line(*pairs):
    """SQL of the same text: line(('user', expr), …)."""
    return " || chr(10) || ".join(f"'{r}=' || {e}" for r, e in pairs)


@query("rename_aliases", "N1", "SELECT doc_id AS id, text AS response, lang AS query, source AS Input, source AS System_Prompt2 FROM documents")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("OutPut"), F.col("lang").alias("query"), F.col("source").alias("Input"), F.col("source").alias("System_Prompt2"))
    return N.rename_aliases(d, {**N.QR_ALIASES, "system": ["system_prompt"]})


@query("qr_to_messages", "N2 N3", f"SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'system=' || lang || chr(10) ELSE '' END || {line(('user', chr(39) + 'h1' + chr(39)), ('assistant', 'source'))} || chr(10) || 'assistant=h4' || chr(10) || "
       f"CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'user=' || lang || chr(10) END || 'assistant=' || text AS messages FROM documents")
def _(t):
    d = t.documents
    hist = F.array(F.array(F.lit("h1"), F.col("source")), F.array(F.lit(None).cast("string"), F.lit("h4")))
    rows = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("system_prompt"), hist.alias("history"),
                    F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("Question"), F.array("text").alias("answers"))
    return N.auto_normalize(rows, key="id").select("id", flat())


@query("alpaca_to_messages", "N2 N4", "SELECT doc_id AS id, 'user=' || CASE doc_id % 3 WHEN 0 THEN lang || chr(10) || source WHEN 1 THEN lang ELSE source END || chr(10) || 'assistant=' || text AS messages FROM documents")
def _(t):
    k = F.col("doc_id") % 3
    rows = t.documents.select(F.col("doc_id").alias("id"), F.when(k != 2, F.col("lang")).alias("instruction"), F.when(k == 1, "").otherwise(F.col("source")).alias("input"), F.col("text").alias("output"))
    return N.auto_normalize(rows).select("id", flat())


ROLE_IN = "CASE WHEN turn % 5 = 4 THEN 'function-response' WHEN role = 'user' THEN 'human' WHEN role = 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 'gpt' ELSE 'bot' END ELSE role END"
ROLE_OUT = "CASE WHEN turn % 5 = 4 THEN 'tool_response' ELSE role END"


@query("standardize_messages", "N2 N5", f"""SELECT conv_id, CASE WHEN min_by(role, turn) <> 'system' THEN 'system=be kind' || chr(10) ELSE '' END || string_agg({ROLE_OUT} || '=' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id""")
def _(t):
    turns = select(t.conversations, conv_id="conv_id", turn="turn", r=ROLE_IN, x="text")
    m = N.turns_to_messages(turns, "conv_id", "turn", "r", "x")
    raw = m.select("conv_id", F.transform("messages", lambda x: F.struct(x["role"].alias("from"), x["content"].alias("value"))).alias("conversations"), F.lit("be kind").alias("system"))
    return N.auto_normalize(raw).select("conv_id", flat())


@query("sharegpt_pairs", "N2 N6", f"SELECT doc_id AS id, {line(('system', 'lang'), ('user', 'source'), ('assistant', 'text'), ('user', chr(39) + 'more' + chr(39)), ('assistant', 'lang'))} AS messages FROM documents")
def _(t):
    p = F.array(F.struct(F.col("source").alias("human"), F.col("text").alias("assistant")), F.struct(F.lit("more").alias("human"), F.col("lang").alias("assistant")))
    return N.auto_normalize(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("system"), p.alias("conversation"))).select("id", flat())


def _mixed(t):
    k = F.col("doc_id") % 5
    m = (F.when(k == 0, F.array().cast("array<struct<role:string,content:string,extra:string>>"))
         .when(k == 1, F.array(F.struct(F.lit("robot").alias("role"), F.col("text").alias("content"), F.lit("x").alias("extra"))))
         .when(k == 2, F.array(F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"), F.lit("x").alias("extra"))))
         .otherwise(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), F.lit("x").alias("extra")))))
    return t.documents.select("doc_id", "source", m.alias("messages"))


@query("validate_messages", "N7", "SELECT source, CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'unknown_role' WHEN 2 THEN 'null_content' END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    return N.validate_messages(_mixed(t)).groupBy("source", F.col("_reject").alias("reason")).agg(F.count("*").alias("n"))


@query("quarantine", "N12", "SELECT CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'unknown_role' WHEN 2 THEN 'null_content' ELSE 'good' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    good, report = N.quarantine(N.validate_messages(_mixed(t)))
    return report.unionByName(good.groupBy(F.lit("good").alias("reason")).agg(F.count("*").alias("n")))


@query("check_preference_pair", "N8", "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'different_prompt' WHEN 1 THEN 'no_rejected' WHEN 2 THEN 'same_answer' END AS reason, CASE doc_id % 4 WHEN 1 THEN NULL WHEN 2 THEN text ELSE lang END AS rejected_response FROM documents")
def _(t):
    k = F.col("doc_id") % 4
    good = P.chat(F.col("source"), F.col("text"))
    bad = (F.when(k == 0, P.chat(F.lit("other"), F.col("lang"))).when(k == 1, F.array(N.message("user", F.col("source")))).when(k == 2, good).otherwise(P.chat(F.col("source"), F.col("lang"))))
    rows = t.documents.select(F.col("doc_id").alias("id"), good.alias("messages"), bad.alias("rejected_messages"))
    return N.check_preference_pair(rows).select("id", F.col("_reject").alias("reason"), "rejected_response")


@query("project_standard", "N9 N10", "SELECT CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN NULL ELSE doc_id % 7 END::INT AS label, lang AS channel, n_chars / 2 AS margin, source AS solution FROM documents")
def _(t):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, "3.0").when(k == 1, "n/a").otherwise((F.col("doc_id") % 7).cast("string"))
    rows = t.documents.select("doc_id", N.cast_label(raw).alias("label"), F.col("lang").alias("channel"), (F.col("n_chars") / 2).alias("margin"), F.col("source").alias("solution"), "text")
    return N.project_standard(rows, keep=("solution",))


@query("normalize_boxes", "N11", """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, least(l_quantity, l_linenumber * 10.0) AS x1, greatest(l_quantity, l_linenumber * 10.0) AS x2, least(l_discount, l_tax) AS y1, greatest(l_discount, l_tax) AS y2, l_quantity AS px,
  CASE WHEN l_linenumber = 7 THEN 'box_size' END AS problem FROM lineitem""".replace("10.0", "10.0::DOUBLE"))
def _(t):
    q, d, x, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber") * 10.0
    boxes = F.array(F.array(q, d, n, x), F.array(q, d))
    b = N.normalize_boxes(boxes)
    bad = N.boxes_problem(F.when(F.col("l_linenumber") == 7, F.array(F.array(q, d, x))).otherwise(boxes))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", b[0][0].alias("x1"), b[0][2].alias("x2"), b[0][1].alias("y1"), b[0][3].alias("y2"), b[1][0].alias("px"), bad.alias("problem"))


@query("fill_template", "N13", "SELECT item_id, 'Task: ads' || chr(10) || 'Keywords: ' || text || chr(10) || 'Ad:' AS prompt FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", N.fill_template("Task: ads\nKeywords: {{QUERY}}\nAd:", "text").alias("prompt"))


@query("classification_prompt", "N14", """SELECT doc_id, 'Task: Rate' || chr(10) || 'Sentence: ' || text || chr(10) || 'Category: bad, good' || chr(10) || 'Output:' AS query, CASE quality WHEN 0 THEN 'bad' ELSE 'good' END AS response,
  'Task: Rate' || chr(10) || 'Sentence1: ' || lang || chr(10) || 'Sentence2: ' || source || chr(10) || 'Category: bad, good' || chr(10) || 'Output:' AS pair_query FROM documents JOIN labels USING (doc_id)""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.col("text").alias("sentence"), F.col("lang").alias("sentence1"), F.col("source").alias("sentence2"), F.col("quality").alias("label"))
    one = N.classification_prompt(rows, ["bad", "good"], "Rate")
    return N.classification_prompt(one.withColumnRenamed("query", "q"), ["bad", "good"], "Rate", pair=True).select("doc_id", F.col("q").alias("query"), "response", F.col("query").alias("pair_query"))


@query("flatten_multipart", "N15", "SELECT page_id, url || '<image>' || html || '<image>' AS text FROM pages")
def _(t):
    part = lambda ty, x: F.struct(F.lit(ty).alias("type"), x.alias("text"))
    none = F.lit(None).cast("string")
    parts = F.array(part("text", F.col("url")), part("image", none), part("text", F.col("html")), part("image", none))
    return t.pages.select("page_id", N.flatten_multipart(parts).alias("text"))


@query("media_manifest_filter", "N16 J4", "SELECT event_id, 'data/' || user_id AS path FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def _(t):
    rows = t.events.select("event_id", F.concat(F.lit("old/"), F.col("user_id").cast("string")).alias("path"))
    manifest = t.customer.filter("c_nationkey < 12").select(F.concat(F.lit("data/"), F.col("c_custkey").cast("string")).alias("file"))
    return N.media_manifest_filter(rows, "path", manifest, "file", {"old/": "data/"}).select("event_id", "path")


STEP = dict(user_id="user_id", event_id="event_id", idx="CASE WHEN event_type = 'login' OR event_id % 17 = 0 THEN '0' ELSE '' || event_id % 9 + 1 END".replace("'' || event_id % 9 + 1", "'7'"), event_type="event_type", props="props")
STEP_SQL = "s AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in STEP.items()) + " FROM events), z AS (SELECT *, sum(CASE WHEN idx = '0' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS session FROM s)"


@query("sessionize_steps", "N17", f"WITH {STEP_SQL} SELECT user_id, event_id, session FROM z")
def _(t):
    return N.sessionize_steps(select(t.events, **STEP), "user_id", "event_id", "idx").select("user_id", "event_id", "session")


@query("session_messages", "N17", f"""WITH {STEP_SQL}, y AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY event_id) AS i FROM z)
  SELECT user_id, session, (i - 1) // 3 AS part, string_agg('user=' || props || CASE WHEN i = 1 THEN chr(10) || 'do it' ELSE '' END || chr(10) || 'assistant=' || event_type, chr(10) ORDER BY event_id) AS messages FROM y GROUP BY ALL""")
def _(t):
    s = N.sessionize_steps(select(t.events, **STEP), "user_id", "event_id", "idx", step="step").withColumn("task", F.lit("do it"))
    return N.session_messages(s, "user_id", "event_id", "task", "props", "event_type", "step", max_steps=3).select("user_id", "session", "part", flat())


@query("spans_to_tags", "N18", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<o>' || substr(text, 3, 1) || '<o>' || substr(text, 6) WHEN doc_id % 3 = 1 THEN substr(text, 1, 1) || '<o>' || substr(text, 3) END AS text FROM documents")
def _(t):
    k = F.col("doc_id") % 3
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    spans = F.when(k == 0, F.array(pair(3, 5), pair(0, 2))).when(k == 1, F.array(pair(1, 2))).otherwise(F.array(pair(0, 3), pair(2, 5)))
    return t.documents.select("doc_id", N.spans_to_tags(F.col("text"), spans, "<o>").alias("text"))


# ---- recipes

DOC = "documents"


def qr(df, *keep):
    return df.select(*keep, "query", "response")


@query("recipes_instruction", "recipes", rf"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE lang END AS alpaca_zh, regexp_replace(text, '\A{T.SPACE}+|{T.SPACE}+\z', '', 'g') AS long, 'Sql Table information:' || chr(10) || source || chr(10) || lang AS sql_query,
  'Let''s think step by step:' || chr(10) || text || chr(10) || 'So the final sql is:' || chr(10) || lang AS sql_response, text || chr(10) || chr(10) || 'Answer: ' || n_chars AS blossom, lang || chr(10) || source || chr(10) || 'c1c3' || text AS law FROM documents""")
def _(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("输入："), F.col("text"))).otherwise(F.col("lang")).alias("input"), F.col("lang").alias("sql"), F.col("lang").alias("sql_prompt"), F.col("source").alias("sql_context"),
                           F.col("text").alias("sql_explanation"), F.col("text").alias("output"), F.col("n_chars").cast("string").alias("answer"), F.col("lang").alias("query"), F.col("lang").alias("type"), F.col("source").alias("title"),
                           F.lit("c1").alias("chapter1"), F.lit(None).cast("string").alias("chapter2"), F.lit("c3").alias("chapter3"), F.concat(F.lit("Answer: "), F.col("text")).alias("response"), "text")
    a = P.alpaca_zh(d).select("doc_id", F.col("input").alias("alpaca_zh"))
    b = P.long_alpaca(d).select("doc_id", F.col("response").alias("long"))
    s = P.text2sql(d, "doc_id").withColumnsRenamed({"query": "sql_query", "response": "sql_response"})
    m = P.blossom_math(d, "doc_id").select("doc_id", F.col("response").alias("blossom"))
    w = P.tigerbot_law(d.withColumn("response", F.col("text")), "doc_id").withColumnRenamed("response", "law")
    out = a
    for x in (b, s, m, w):
        out = out.join(x, "doc_id")
    return out


@query("recipe_leetcode", "recipes", "SELECT doc_id, text AS query, '```python' || chr(10) || lang || chr(10) || '```' || chr(10) || chr(10) || source AS response FROM documents")
def _(t):
    d = t.documents.select("doc_id", F.concat(F.lit("# "), F.col("text"), F.lit("```python\n"), F.col("lang"), F.lit("\n``` ")).alias("code_with_problem"), F.col("source").alias("explanation_only"))
    return P.leetcode_python(d, "doc_id")


@query("recipe_ruozhiba", "recipes", "SELECT doc_id, 'assistant=' || CASE WHEN doc_id % 2 = 0 THEN source || '，' || lang ELSE lang END AS messages FROM documents WHERE doc_id % 3 <> 2")
def _(t):
    k = F.col("doc_id")
    d = t.documents.select("doc_id", F.when(k % 3 == 2, "").otherwise(F.concat(F.lit("12."), F.when(k % 2 == 0, F.col("source")).otherwise(F.col("lang")))).alias("title"),
                           F.when((k % 2 == 0) & (k % 3 != 2), F.col("lang")).alias("abs"))
    return P.ruozhiba(d).select("doc_id", flat())


@query("recipe_ms_bench", "recipes", """WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'You are a helpful assistant.' WHEN conv_id % 7 = 3 AND turn = 1 THEN text || ' MOSS' ELSE text END AS x FROM conversations),
  k AS (SELECT conv_id FROM m GROUP BY conv_id HAVING NOT bool_or(NOT (turn = 0 AND x = 'You are a helpful assistant.') AND regexp_matches(lower(x), 'moss|human:|assistant:|user:')))
  SELECT conv_id, string_agg(role || '=' || x, chr(10) ORDER BY turn) FILTER (NOT (turn = 0 AND role = 'system' AND x = 'You are a helpful assistant.')) AS messages FROM m JOIN k USING (conv_id) GROUP BY conv_id""")
def _(t):
    rows = select(t.conversations, conv_id="conv_id", turn="turn", role="role", x="CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'You are a helpful assistant.' WHEN conv_id % 7 = 3 AND turn = 1 THEN text || ' MOSS' ELSE text END")
    m = N.turns_to_messages(rows, "conv_id", "turn", "role", "x").withColumn("messages", F.transform("messages", lambda x: F.struct(x["role"].alias("from"), x["content"].alias("value"))))
    return P.ms_bench(m).select("conv_id", flat())


@query("recipes_filters", "recipes", """SELECT 'msagent' AS recipe, doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'firefly', doc_id FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT 'orpo', doc_id FROM documents WHERE doc_id % 5 <> 2
  UNION ALL SELECT 'stsb', doc_id FROM documents WHERE n_chars % 10 >= 6 UNION ALL SELECT 'guanaco', doc_id FROM documents WHERE doc_id % 4 IN (0, 3)""")
def _(t):
    d, k = t.documents, F.col("doc_id")
    tag = lambda df, n: df.select(F.lit(n).alias("recipe"), "doc_id")
    sysm = F.concat(F.lit('1. {"plugin_name": "a"'), F.when(k % 3 == 0, '2. {"plugin_name": "b"').otherwise('2. {"plugin_name": "a"'))
    m = F.array(F.struct(F.when(k % 3 == 1, "user").otherwise("system").alias("from"), sysm.alias("value")), F.struct(F.lit("user").alias("from"), F.col("text").alias("value")))
    ins = F.when(k % 4 == 0, "").when(k % 4 == 1, "hello User: a").when(k % 4 == 2, "User: a Assistant:").otherwise("User: a Assistant: b")
    return (tag(P.msagent_mini(d.select("doc_id", m.alias("messages"))), "msagent")
            .unionByName(tag(P.firefly(d.select("doc_id", F.when(k % 4 == 1, "NER").otherwise("Chat").alias("kind"))), "firefly"))
            .unionByName(tag(P.orpo_mix(d.select("doc_id", F.when(k % 5 == 2, "toxic-dpo-v0.2").otherwise("x").alias("source"))), "orpo"))
            .unionByName(tag(P.stsb(d.select("doc_id", F.col("lang").alias("sentence1"), F.col("text").alias("sentence2"), (F.col("n_chars") % 10 / 10).alias("score")), 0.6), "stsb"))
            .unionByName(tag(P.guanaco(d.select("doc_id", ins.alias("instruction"), F.col("text").alias("input"), F.col("lang").alias("output"))), "guanaco")))


@query("recipes_similarity", "recipes", """SELECT doc_id, 'Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.' || chr(10) || 'Sentence 1: ' || text || chr(10) || 'Sentence 2: ' || lang || chr(10) || 'Similarity score: ' AS query,
  '0.' || n_chars % 10 AS response, (n_chars % 10) / 10 AS label FROM documents""")
def _(t):
    d = t.documents.select("doc_id", F.col("text").alias("sentence1"), F.col("lang").alias("sentence2"), (F.col("n_chars") % 10 / 10).alias("score"))
    return P.stsb_generate(d, "doc_id").join(P.stsb_regression(d, "doc_id").drop("query"), "doc_id")


@query("recipes_rows", "recipes", """SELECT 'mteb' AS recipe, doc_id, lang AS query, p AS response FROM documents, (VALUES ('p1'), ('p2')) v(p) UNION ALL SELECT 'hc3', doc_id,
  'Classification Task: Are the following responses from a human or from ChatGPT?' || chr(10) || 'Question: ' || lang || chr(10) || 'Answer: ' || CASE p WHEN 'Human' THEN text ELSE source END || chr(10) || 'Category: Human, ChatGPT' || chr(10) || 'Output:', p FROM documents, (VALUES ('Human'), ('ChatGPT')) v(p)
  UNION ALL SELECT 'countdown', doc_id, 'Using the numbers [' || doc_id || ', 3], create an equation that equals ' || n_chars || '.' || chr(10) || 'You can use basic arithmetic operations (+, -, *, /) and each number can only be used once.' || chr(10) ||
  'Show your work in <think> </think> tags. And return the final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 * 4 = 4 </answer>.', '' || n_chars FROM documents""")
def _(t):
    d = t.documents
    a = P.mteb_rerank(d.select("doc_id", F.col("lang").alias("query"), F.array(F.lit("p1"), F.lit("p2")).alias("positive"), F.array("text").alias("negative")), "doc_id")
    b = P.hc3(d.select("doc_id", F.col("lang").alias("query"), F.array("text").alias("human_answers"), F.array("source").alias("chatgpt_answers")), "doc_id")
    e = P.countdown(d.select("doc_id", F.array("doc_id", F.lit(3)).alias("nums"), F.col("n_chars").alias("response")), "doc_id").withColumn("response", F.col("target").cast("string"))
    tag = lambda df, n: df.select(F.lit(n).alias("recipe"), "doc_id", "query", "response")
    return tag(a, "mteb").unionByName(tag(b, "hc3")).unionByName(tag(e, "countdown"))


@query("recipes_parsed", "recipes", f"""SELECT 'agent' AS recipe, doc_id, {line(('user', 'lang'), ('assistant', 'source'))} AS messages FROM documents UNION ALL SELECT 'lmsys', doc_id, {line(('user', 'lang'), ('assistant', 'source'))} FROM documents
  UNION ALL SELECT 'xlam', doc_id, 'user=' || text || chr(10) || 'tool_call={{"name":"f","arguments":{{"x":' || n_chars || '}}}}' || chr(10) || 'tool_call={{"name":"g","arguments":{{}}}}' FROM documents
  UNION ALL SELECT 'xlam_grpo', doc_id, 'Action: f' || chr(10) || 'Action Input: {{"x":' || n_chars || '}}' FROM documents
  UNION ALL SELECT 'toolbench', doc_id, {line(('user', 'text'), ('assistant', 'lang'))} FROM documents""")
def _(t):
    d = t.documents
    two = lambda r, v, sep: F.concat(F.lit(f"[{{'{r}': 'user', '{v}': '"), F.col("lang"), F.lit(f"'}}{sep}{{'{r}': 'assistant', '{v}': '"), F.col("source"), F.lit("'}]"))
    calls = F.concat(F.lit('[{"name":"f","arguments":{"x":'), F.col("n_chars").cast("string"), F.lit("}},"), F.lit('{"name":"g","arguments":{}}]'))
    tag = lambda df, n: df.select(F.lit(n).alias("recipe"), "doc_id", flat())
    one = F.concat(F.lit('[{"name":"f","arguments":{"x":'), F.col("n_chars").cast("string"), F.lit("}}]"))
    g = P.xlam_grpo(d.select("doc_id", F.col("lang").alias("query"), one.alias("response"), F.lit("").alias("tools")), "doc_id")
    tb = F.array(F.struct(F.lit("user").alias("from"), F.col("text").alias("value")), F.struct(F.when(F.col("doc_id") % 2 == 0, "caller").otherwise("conclusion").alias("from"), F.col("lang").alias("value")))
    return (tag(P.agent_instruct(d.select("doc_id", two("from", "value", "\n ").alias("conversations"))), "agent")
            .unionByName(tag(P.lmsys(d.select("doc_id", two("role", "content", "\n").alias("conversation"))), "lmsys"))
            .unionByName(tag(P.xlam(d.select("doc_id", F.col("text").alias("query"), calls.alias("answers"), F.lit("").alias("tools"))), "xlam"))
            .unionByName(g.select(F.lit("xlam_grpo").alias("recipe"), "doc_id", F.col("solution").alias("messages")))
            .unionByName(tag(P.toolbench(d.select("doc_id", tb.alias("messages"))), "toolbench")))


@query("recipes_dialogue", "recipes", f"""SELECT 'hh' AS recipe, doc_id, {line(('user', 'lang'), ('assistant', 'source'), ('user', chr(39) + 'q2' + chr(39)), ('assistant', chr(39) + 'a2' + chr(39)))} AS messages FROM documents
  UNION ALL SELECT 'hh_cn', doc_id, {line(('user', 'text'), ('assistant', 'lang'))} FROM documents UNION ALL SELECT 'dolly', doc_id, 'user=' || CASE WHEN doc_id % 2 = 0 THEN 'Here gives some useful information:' || chr(10) || text || chr(10) ELSE '' END || lang || chr(10) || 'assistant=' || source FROM documents
  UNION ALL SELECT 'dureader', doc_id, 'user=Task: Question Generation' || chr(10) || 'Context: ' || source || chr(10) || 'Answer: ' || lang || chr(10) || 'Question:' || chr(10) || 'assistant=' || lang FROM documents
  UNION ALL SELECT 'room', doc_id, {line(('system', chr(39) * 2), ('user', 'text'), ('assistant', 'lang'))} FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'chatml', doc_id, {line(('user', 'text'))} FROM documents
  UNION ALL SELECT 'guanaco', doc_id, {line(('user', chr(39) + ' a ' + chr(39)), ('assistant', chr(39) + ' b' + chr(39)), ('user', 'lang'), ('assistant', 'source'))} FROM documents""")
def _(t):
    d, k = t.documents, F.col("doc_id")
    tag = lambda df, n: df.select(F.lit(n).alias("recipe"), "doc_id", flat())
    chosen = F.concat(F.lit("\n\nHuman: "), F.col("lang"), F.lit("\n\nAssistant: "), F.col("source"), F.lit("\n\nHum: q2\n\nAssistant: a2\n\nHuman: unpaired"))
    tt = lambda r, x: F.struct(F.lit(r).alias("role"), x.alias("text"))
    fv = lambda r, x: F.struct(r.alias("from"), x.alias("value"))
    room = F.array(fv(F.when(k % 2 == 0, "user").otherwise("system"), F.col("text")), fv(F.lit("ann"), F.lit("hi")), fv(F.lit("bob"), F.col("lang")))
    return (tag(P.hh_rlhf(d.select("doc_id", chosen.alias("chosen"), chosen.alias("rejected"))), "hh")
            .unionByName(tag(P.hh_rlhf_cn(d.select("doc_id", F.array(tt("human", F.col("text"))).alias("context"), tt("gpt", F.col("lang")).alias("chosen"), tt("gpt", F.col("source")).alias("rejected"))), "hh_cn"))
            .unionByName(tag(P.dolly(d.select("doc_id", F.when(k % 2 == 0, F.col("text")).otherwise("").alias("context"), F.col("lang").alias("instruction"), F.col("source").alias("response"))), "dolly"))
            .unionByName(tag(P.dureader(d.select("doc_id", F.concat("lang", F.lit("[SEP]"), "source").alias("text1"), F.col("lang").alias("text2"))), "dureader"))
            .unionByName(tag(P.multi_role_agent(d.select("doc_id", room.alias("conversations"))), "room"))
            .unionByName(tag(P.function_call_chatml(d.select("doc_id", F.array(N.message("system", F.col("lang")), N.message("user", F.col("text"))).alias("messages"), F.lit("a\n\nb").alias("function_description"))), "chatml"))
            .unionByName(tag(P.guanaco(d.select("doc_id", F.lit("User: a Assistant: b").alias("instruction"), F.concat(F.lit("User: "), F.col("lang")).alias("input"), F.col("source").alias("output"))), "guanaco")))


@query("recipes_text_edits", "recipes", """SELECT doc_id, 'I am ' || CASE WHEN lang = 'zh' THEN '小' ELSE 'Bot' END || ' by {{AUTHOR}}?/x' AS query, 'p' || text AS response, text AS emoji FROM documents""")
def _(t):
    d = t.documents.select("doc_id", F.col("lang").alias("tag"), F.lit("I am {{NAME}} by {{AUTHOR}}?").alias("query"), F.col("text").alias("response"))
    a = P.self_cognition(d, name=("小", "Bot"), query_suffix="/x", response_prefix="p")
    e = P.emoji(t.documents.select("doc_id", F.lit("").alias("query"), F.concat(F.col("text"), F.lit("️")).alias("response"), F.lit("").alias("rejected_response"))).select("doc_id", F.col("response").alias("emoji"))
    return a.drop("tag").join(e, "doc_id")


@query("recipes_media_text", "recipes", """SELECT 'coco2014' AS recipe, doc_id, 'please describe the image.' AS query, string_split(text, '&&')[1] AS response FROM documents UNION ALL SELECT 'aishell', doc_id, '语音转文本', replace(text, ' ', '') FROM documents
  UNION ALL SELECT 'egoschema', doc_id, lang || chr(10) || 'x' || chr(10) || 'y', chr(CAST(65 + doc_id % 2 AS INT)) FROM documents UNION ALL SELECT 'clevr', doc_id, text || ' Output the thinking process in <think> </think> and final answer (number) in <answer> </answer> tags.', lang FROM documents
  UNION ALL SELECT 'latexocr', doc_id, 'Using LaTeX to perform OCR on the image.', lang FROM documents UNION ALL SELECT 'science', doc_id, text, source || chr(10) || 'So the final answer is: ' || CASE WHEN doc_id % 2 = 0 THEN 'no' ELSE 'yes' END FROM documents
  UNION ALL SELECT 'gqa', doc_id, text, lang FROM documents UNION ALL SELECT 'ocrvqa', doc_id, text, lang FROM documents""")
def _(t):
    d = t.documents
    tag = lambda df, n: df.select(F.lit(n).alias("recipe"), "doc_id", "query", "response")
    chat = lambda df, n: df.select(F.lit(n).alias("recipe"), "doc_id", turn(F.col("messages"), 0).alias("query"), turn(F.col("messages"), 1).alias("response"))
    k2 = (F.col("doc_id") % 2).cast("string")
    return (tag(P.coco2014(d.select("doc_id", F.col("text").alias("caption"))), "coco2014")
            .unionByName(tag(P.aishell(d.select("doc_id", F.col("text").alias("Text:LABEL"))), "aishell"))
            .unionByName(tag(P.egoschema(d.select("doc_id", F.col("lang").alias("query"), F.array(F.lit("x"), F.lit("y")).alias("option"), k2.alias("response"))), "egoschema"))
            .unionByName(tag(P.clevr(d.select("doc_id", F.col("text").alias("query"), F.col("lang").alias("response"))), "clevr"))
            .unionByName(tag(P.RECIPES["latexocr"](d.select("doc_id", F.col("lang").alias("response"))), "latexocr"))
            .unionByName(chat(P.science_qa(d.select("doc_id", F.col("text").alias("question"), F.array(F.lit("no"), F.lit("yes")).alias("choices"), k2.alias("answer"), F.col("source").alias("solution"))), "science"))
            .unionByName(chat(P.gqa(d.select("doc_id", F.col("text").alias("question"), F.col("lang").alias("fullAnswer"))), "gqa"))
            .unionByName(chat(P.ocrvqa(d.select("doc_id", F.array("text").alias("questions"), F.array("lang").alias("answers")), "doc_id"), "ocrvqa")))


@query("recipes_random_prompts", "recipes", f"""SELECT doc_id, text AS sa1b, regexp_replace(text, '\\A{T.SPACE}+|{T.SPACE}+\\z', '', 'g') AS pixelprose, TRUE AS known_prompt FROM documents""")
def _(t):
    d = t.documents
    a = P.sa1b(d.select("doc_id", F.col("text").alias("global_caption")), "doc_id")
    b = P.pixelprose(d.select("doc_id", F.concat(F.lit("This image displays:  "), F.col("text")).alias("vlm_caption")), "doc_id").withColumnRenamed("messages", "m2")
    ok = turn(F.col("messages"), 0).isin(*P.PICTURE_QUESTIONS_ZH) & turn(F.col("m2"), 0).isin(*P.PICTURE_QUESTIONS)
    return a.join(b, "doc_id").select("doc_id", turn(F.col("messages"), 1).alias("sa1b"), turn(F.col("m2"), 1).alias("pixelprose"), ok.alias("known_prompt"))


@query("recipe_refcoco", "recipes", """SELECT doc_id, task, '/data/train2014/' || doc_id || '.jpg' AS image, text AS ref, concat_ws(',', round_even(n_chars * 0.5, 0)::INT, round_even(doc_id * 0.25, 0)::INT, round_even(n_chars + 0.5, 0)::INT, doc_id + 1) AS bbox,
  CASE task WHEN 'caption' THEN '<ref-object>' ELSE '<bbox>' END AS response, TRUE AS known_prompt FROM documents, (VALUES ('caption'), ('grounding')) v(task)""")
def _(t):
    rows = t.documents.select("doc_id", F.array("text", "lang").alias("captions"), F.expr("'coco/train2014/' || doc_id || '.jpg'").alias("image_path"),
                              F.expr("array(n_chars * 0.5E0, doc_id * 0.25E0, n_chars + 0.5E0, doc_id + 1E0)").alias("bbox"))
    parts = []
    for task in ("caption", "grounding"):
        known = F.col("query").isin([q for some in P.GROUNDING[task].values() for q in some])
        out = P.RECIPES["refcoco"](rows, "doc_id", task, images="/data/")
        parts.append(out.select("doc_id", F.lit(task).alias("task"), F.col("images")[0].alias("image"), F.col("objects.ref")[0].alias("ref"), F.array_join(F.col("objects.bbox")[0].cast("array<string>"), ",").alias("bbox"), "response", known.alias("known_prompt")))
    return parts[0].unionByName(parts[1])


@query("recipe_coco_detection", "recipes", """SELECT o_orderkey AS image_id, o_orderstatus AS status, 'Task: Object Detection' AS query,
  CASE o_orderkey % 10 WHEN 3 THEN '' ELSE a.n_name || ',' || coalesce(b.n_name, '?') END AS ref FROM orders LEFT JOIN nation a ON a.n_nationkey = o_custkey % 25 LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 30""")
def _(t):
    pics = t.orders.select(F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("status"),
                         F.expr("CASE WHEN o_orderkey % 10 = 3 THEN array() ELSE array(o_custkey % 25, o_orderkey % 30) END").alias("category_ids"))  # some without boxes, some unknown
    cats = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return P.coco_detection(pics, cats).select("image_id", "status", "query", F.array_join("ref", ",", "?").alias("ref"))
