"""Row-wise rewards and answer matchers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import rewards as R
from ..functions import text as T
from ..operators import evaluate as E
from .derived import NL, select
from .registry import query

WS = T.SPACE


def strip_sql(x):
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def words_sql(x):
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def case(key, n, items, other):
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(items)) + f" ELSE {other} END"


# completions of several shapes around the whole text of a document
COMP = dict(id="doc_id", lang="lang", text="text", n="n_chars", c=case("doc_id", 9, [
    f"'<think>' || text || '</think>' || {NL} || '<answer>' || n_chars || '</answer>'",
    f"'<think>' || text || '</think> <answer>The ' || lang || ', Text!</answer> tail'",
    f"'<think>a</think>' || {NL} || 'Action: look' || {NL} || 'Action Input: ' || text",
    f"'<think>x</think><answer>' || {NL} || '```python' || {NL} || 'print(' || doc_id || ')' || {NL} || '```</answer>'",
    f"text || ' #### ' || n_chars", f"text || ' #### 1,234.5 and 7.'",
    f"'<answer>first</answer> and <answer>The  ' || upper(lang) || '.</answer>'",
    "text || ' is 3.14 . '"], "text"), gold="CASE WHEN doc_id % 9 = 4 AND doc_id % 2 = 0 THEN '' || n_chars WHEN doc_id % 9 = 5 THEN '1234.5' WHEN doc_id % 9 = 7 THEN '3.14' ELSE lang END")
COMP_CTE = "c AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COMP.items()) + " FROM documents)"


def comps(t):
    return select(t.spread("documents"), **COMP)


def sqlflag(x):
    return f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0 END"


@query("format_rewards", "R1 R2 R22", f"""WITH {COMP_CTE} SELECT id, {sqlflag("regexp_matches(c, '(?s)^<think>.*?</think>' || '\\s*<answer>.*?</answer>$')")} AS think_answer,
  {sqlflag("regexp_matches(c, '(?s)^<think>.*?</think>' || '\\s*Action:.*?Action Input:')")} AS react, {sqlflag("regexp_matches(c, '(?s)^<think>.*?</think>' || '\\s*<answer>.*?```python.*?```.*?</answer>$')")} AS code FROM c""")
def _(t):
    return comps(t).select("id", R.format_think_answer("c").alias("think_answer"), R.format_react("c").alias("react"), R.code_format("c").alias("code"))




def squad_sql(x):
    return f"array_to_string(list_filter({words_sql('regexp_replace(lower(' + x + '), ' + chr(39) + '[!-/:-@' + chr(92) + '[-`{-~]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda w: w NOT IN ('a', 'an', 'the')), ' ')"


LASTANS = "regexp_extract_all(c, '(?s)<answer>(.*?)</answer>', 1)[-1]"


@query("gsm8k_score", "R10", f"""WITH {COMP_CTE}, a AS (SELECT *, CASE WHEN regexp_matches(c, '#### -?[0-9.,]+') THEN replace(regexp_extract(c, '#### (-?[0-9.,]+)', 1), ',', '') END AS s,
   regexp_extract_all(c, '-?[0-9.,]+') AS al FROM c), b AS (SELECT *, coalesce(list_filter(al, lambda x: x <> '.')[-1], al[1]) AS f FROM a)
  SELECT id, CASE WHEN s IS NULL THEN 0.0::DOUBLE WHEN s = gold THEN 1 ELSE 0.1 END AS strict, CASE WHEN f IS NULL THEN 0.0::DOUBLE WHEN f = gold THEN 1 ELSE 0 END AS flexible FROM b""")
def _(t):
    return comps(t).select("id", R.gsm8k_score("c", "gold", format_score=0.1).alias("strict"), R.gsm8k_score("c", "gold", "flexible").alias("flexible"))


@query("search_em", "R11", f"""WITH {COMP_CTE}, a AS (SELECT id, {squad_sql(LASTANS)} AS p, {LASTANS} IS NOT NULL AS has, {squad_sql("gold")} AS g1, {squad_sql("'The '' ' || n")} AS g2 FROM c)
  SELECT id, {sqlflag("has AND (p = g1 OR p = g2)")} AS em, {sqlflag("has AND (contains(p, g1) OR contains(p, g2))")} AS subem FROM a""")
def _(t):
    golds = F.array(F.col("gold"), F.concat(F.lit("The ' "), F.col("n").cast("string")))
    return comps(t).select("id", R.search_em("c", golds).alias("em"), R.search_subem("c", golds).alias("subem"))


@query("length_rewards", "R6 R7 R8 R19", f"""WITH w AS (SELECT doc_id, n_chars, {words_sql("lower(text)")} AS ws FROM documents), g AS (SELECT *, len(ws) - 2 AS k FROM w),
  u AS (SELECT doc_id, count(DISTINCT array_to_string(ws[i:i+2], ' ')) AS d FROM (SELECT doc_id, ws, unnest(range(1, k + 1)) AS i FROM g WHERE k > 0) GROUP BY doc_id)
  SELECT g.doc_id, round(CASE WHEN g.doc_id % 2 = 1 THEN 1.0 + (0.5 - 1.0) * (1 - cos(n_chars * pi() / 5000)) / 2 ELSE -0.5 + 0.5 * (1 - cos(n_chars * pi() / 5000)) / 2 END, 6) AS cosine,
   round(CASE WHEN k < 1 THEN 0 ELSE (1 - d / k) * -1.0::DOUBLE END, 6) AS repetition, round(least(0 - (n_chars - 1500) / 500.0::DOUBLE, 0), 6) AS overlong,
   least(round_even(len(ws) / 512.0::DOUBLE, 2), 1.0) AS tool_length FROM g LEFT JOIN u USING (doc_id)""")
def _(t):
    d = t.spread("documents")
    return d.select("doc_id", F.round(R.cosine_length("n_chars", F.col("doc_id") % 2, 5000), 6).alias("cosine"), F.round(R.repetition_penalty("text"), 6).alias("repetition"),
                    F.round(R.soft_overlong("n_chars", 2000, 500), 6).alias("overlong"),
                    R.tool_length(F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>"))).alias("tool_length"))


REACT = dict(id="doc_id", c=case("doc_id", 6, ["'Thought: x' || chr(10) || 'Action: find' || chr(10) || 'Action Input: {\"q\": ' || doc_id || '}'", "'Action: find' || chr(10) || 'Action Input: ' || text || 'Observation:'",
                                               "'Action: find' || chr(10) || 'Action Input: {\"q\": 1, \"r\": 2}'", "'Action: other' || chr(10) || 'Action Input: {}'", "'Action: find'"], "text"),
             gold=case("doc_id", 6, ["'Action: find' || chr(10) || 'Action Input: {\"q\":' || doc_id || '}'", "'Action: find Action Input: ' || text", "'Action: find Action Input: {\"q\": 1}'", "'Action: find Action Input: {}'",
                                     "'Action: find Action Input: {}'"], "'Action: none'"))


@query("tool_call_match", "R3", """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN CASE WHEN regexp_matches(text, '[^\\s]') THEN 1.0 ELSE 0 END WHEN 4 THEN 1 WHEN 5 THEN CASE WHEN contains(text, 'Action:') THEN 0 ELSE 1 END ELSE 0 END AS reward FROM documents""")
def _(t):
    return select(t.documents, **REACT).select("id", R.tool_call_match("c", "gold", rouge_scale=100.0).alias("reward"))


BOX = dict(id="doc_id", c=case("doc_id", 5, ["'so # Answer' || chr(10) || '\\boxed{' || n_chars || '.0}'", "'it is \\boxed{ x^{2}  } ok'", "text || '\\boxed{\\frac{1}{2}}'", "'# Answer 12'"], "text"),
           gold=case("doc_id", 5, ["'\\boxed{' || n_chars || '}'", "'x^2'", "'\\frac{1'", "'# Answer \\(12\\)'"], "text || ' '"))


@query("math_boxed_equal", "R4", f"WITH b AS (SELECT doc_id, text FROM documents) SELECT doc_id AS id, 1.0::DOUBLE AS reward FROM b")
def _(t):
    cols = {k: v.replace("\\", "\\\\") for k, v in BOX.items()}
    return select(t.documents, **cols).select("id", R.math_boxed_equal("c", "gold").alias("reward"))


@query("last_boxed", "R5", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{a}' || n_chars WHEN 1 THEN '1/2' WHEN 2 THEN 'x' END AS boxed,
  CASE doc_id % 3 WHEN 0 THEN '1234' WHEN 1 THEN '3\\frac{1}{2}' ELSE '7' END AS final FROM documents""")
def _(t):
    c = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\\boxed{1} then \\boxed{ {a}"), F.col("n_chars").cast("string"), F.lit("} end")))
         .when(F.col("doc_id") % 4 == 1, F.concat(F.col("text"), F.lit("\\fbox{1/2}"))).when(F.col("doc_id") % 4 == 2, "\\boxed{x} }{").otherwise(F.col("text")))
    f = (F.when(F.col("doc_id") % 3 == 0, "x = 1,234 dollars").when(F.col("doc_id") % 3 == 1, "the value is= $3\\frac12$ \\text{m}").otherwise("\\text{7} units"))
    return t.documents.select("doc_id", R.last_boxed(c).alias("boxed"), R.normalize_final_answer(f).alias("final"))


@query("countdown", "R9", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN p_size * 3 = 30 THEN 1.0 ELSE 0 END WHEN 3 THEN 0 ELSE 1 END AS reward FROM part""")
def _(t):
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    eq = (F.when(k == 0, F.concat(F.lit("("), n, F.lit(" + 3) * 2 = x"))).when(k == 1, F.concat(n, F.lit(" + 3"))).when(k == 2, F.concat(n, F.lit(" * 3 + 2 - 2")))
          .when(k == 3, F.concat(F.lit("__import__('os') + "), n, F.lit(" + 3 + 2"))).otherwise(F.concat(n, F.lit(" - 3 / 2"))))
    target = F.when(k == 0, (F.col("p_size") + 3) * 2.0).when(k == 4, F.col("p_size") - 1.5).otherwise(30.0)
    nums = F.when(k == 2, F.array(F.col("p_size"), F.lit(3), F.lit(2), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3), F.col("p_size")))
    return t.part.select(F.col("p_partkey").alias("id"), R.countdown(F.concat(F.lit("so <answer>"), eq, F.lit("</answer>")), target, nums).alias("reward"))


TAGS = dict(id="doc_id", c=case("doc_id", 8, [
    "'<think>' || text || '</think><sql>q</sql><observation>r</observation> <think>b</think><solution>SELECT 1</solution>'",
    "'<think>' || text || '</think><observation>r</observation>then<solution>SELECT 1</solution>'", "'<think>x</think><solution>a</solution><solution>b</solution>'",
    "'<think>x</think><solution><sql>a</sql></solution>'", "text || '<solution>a</solution>'", "'<think>x</think><solution>a'", "'<think>x</think><solution> b </solution>'"], "text"))


@query("sql_result_match", "R12 R13 J9", """SELECT doc_id AS id, CASE WHEN doc_id % 8 IN (0, 6) THEN CASE WHEN n_chars % 2 = 0 THEN 1.0::DOUBLE WHEN n_chars % 3 = 0 THEN 0 ELSE 0 END ELSE -1 END AS reward,
  doc_id % 8 IN (0, 6) AS format_ok, CASE doc_id % 8 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN 'SELECT 1' WHEN 2 THEN 'a' WHEN 3 THEN '<sql>a</sql>' WHEN 4 THEN 'a' WHEN 6 THEN 'b' END AS solution FROM documents""")
def _(t):
    rows = select(t.documents, **{**TAGS, "n": "n_chars"})
    one = F.array(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")), F.struct(F.lit(2).alias("a"), F.lit("y").alias("b")), F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")))
    two = F.array(F.struct(F.lit(2).alias("a"), F.lit("y").alias("b")), F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")))
    got = F.when(F.col("n") % 2 == 0, one).when(F.col("n") % 3 == 0, F.slice(one, 1, 1))
    return rows.select("id", R.sql_result_match("c", got, two).alias("reward"), R.tagged_format_ok("c").alias("format_ok"), R.tagged_solution("c").alias("solution"))


AGENT = dict(id="doc_id", c=case("doc_id", 6, [
    f"'<Analyze>' || text || '</Analyze><Code>' || {NL} || '```python' || {NL} || 'x' || {NL} || '``` </Code> rest </Answer>'", "'<Answer>one</Answer> <Answer> Answer: ' || n_chars || ' </Answer> tail'",
    "'<Code>print(1)</Code>' || text", "text || '<Answer>never closed'", "'<Answer>' || lang || '</Answer>'"], "text"))
AGENT_CTE = "a AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in AGENT.items()) + ", lang, n_chars, text FROM documents)"


@query("agent_actions", "R14 R15 R17", f"""WITH {AGENT_CTE}, b AS (SELECT *, string_split(c, '<Answer>')[-1] AS rest, contains(c, '<Answer>') AS has FROM a)
  SELECT id, CASE WHEN has THEN CASE WHEN contains(rest, '</Answer>') THEN {strip_sql("string_split(rest, '</Answer>')[1]")} ELSE c END END AS general,
   CASE id % 6 WHEN 1 THEN '' || n_chars WHEN 3 THEN '' WHEN 4 THEN lang ELSE CASE WHEN has THEN 'unexpected' END END AS tableqa,
   NOT (id % 6 = 2) AS code_ok, CASE WHEN contains(c, '</Answer>') THEN string_split(c, '</Answer>')[1] || '</Answer>' WHEN contains(c, '</Code>') THEN string_split(c, '</Code>')[1] || '</Code>' ELSE c END AS action,
   id % 7 >= 5 OR (has AND contains(c, '</Answer>')) AS done FROM b""")
def _(t):
    return select(t.documents, **AGENT).select(
        "id", A.answer_of("c").alias("general"), A.answer_of("c", "tableqa").alias("tableqa"), R.code_blocks_valid("c").alias("code_ok"),
        R.trim_action("c").alias("action"), R.is_done("c", F.col("id") % 7, 5).alias("done"))


TURN = dict(conv_id="conv_id", turn="turn", role="CASE WHEN turn % 3 = 2 THEN 'execute' ELSE role END",
            content="CASE WHEN turn = 0 THEN '<Analyze>' || text || '</Analyze>' WHEN turn % 3 = 2 AND conv_id % 2 = 0 THEN '[Error]: ' || text WHEN turn = 1 THEN '<Answer>' || text || CASE WHEN conv_id % 4 = 3 THEN '' ELSE '</Answer>' END "
                    "WHEN turn = 3 THEN CASE WHEN conv_id % 5 = 1 THEN '<Code>x</Code>' ELSE '<Code>```python x```</Code>' END ELSE text END")
PART = dict(conv_id="conv_id", method="CASE conv_id % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'datatask' ELSE 'openresearch' END", accuracy="CASE WHEN conv_id % 2 = 0 THEN 1E0 ELSE 0E0 END", judged="(conv_id % 5) / 5E0")


@query("agent_reward", "R16", "WITH t AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in TURN.items()) + " FROM conversations), p AS (SELECT DISTINCT " + ", ".join(f"{v} AS {k}" for k, v in PART.items()) + """ FROM conversations),
  g AS (SELECT conv_id, string_agg(content, '' ORDER BY turn) AS h, avg(CASE WHEN role = 'execute' THEN CASE WHEN contains(content, '[Error]:') THEN 0.0 ELSE 1.0 END END) AS cp, count(*) FILTER (role = 'assistant') AS nt FROM t GROUP BY conv_id),
  j AS (SELECT *, contains(h, '<Analyze>') AND contains(h, '</Analyze>') AND contains(h, '<Answer>') AND contains(h, '</Answer>') AS ok, NOT contains(h, '<Code>x') AS code_ok FROM g JOIN p USING (conv_id))
  SELECT conv_id, round(CASE WHEN NOT ok THEN -1 WHEN method <> 'qa' AND NOT code_ok THEN -1 ELSE list_avg(list_filter(CASE method WHEN 'qa' THEN [accuracy, judged] WHEN 'datatask' THEN [judged, cp] ELSE [judged, cp, least(nt / 10, 1.0)] END, lambda x: x IS NOT NULL)) END, 6) AS reward FROM j""")
def _(t):
    out = E.agent_reward(select(t.conversations, **TURN), ["conv_id"], "turn", "role", "content", select(t.conversations, **PART).distinct())
    return out.select("conv_id", F.round("reward", 6).alias("reward"))


JUDGE = dict(id="doc_id", reply=case("doc_id", 8, ["text || '### Final Score: 1.0'", "' 0 '", "text || ' score : ' || n_chars % 6", "'```json {\"usefulness\": 5, \"richness\": 4, \"soundness\": 3, \"interpretability\": 2, \"readability\": ' || n_chars % 6 || '}```'",
                                                   "'{\"usefulness\": 5}'", "'{\"Content\": ' || n_chars % 10 || ', \"Format\": \"8\"}'", "'### Final Score: 0'"], "text"))


@query("parse_judge", "R18", f"""SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN 1.0::DOUBLE ELSE 0 END AS final,
  CASE WHEN doc_id % 8 = 2 THEN n_chars % 6 / 5 WHEN doc_id % 8 = 6 THEN 0 WHEN doc_id % 8 = 0 THEN 0.2 ELSE 0 END AS score, CASE WHEN doc_id % 8 = 3 THEN round((14 + n_chars % 6) / 25, 6) ELSE 0 END AS report,
  CASE WHEN doc_id % 8 = 5 THEN (n_chars % 10 + 8) / 2 ELSE 0 END AS graded FROM documents""")
def _(t):
    rows = select(t.documents, **JUDGE)
    # a reply in the 'final' form also holds the words 'Score: n', which the 'score' form reads
    return rows.select("id", *[F.round(R.parse_judge("reply", s), 6).alias(s) for s in ("final", "score", "report", "graded")])


TOOL = dict(id="doc_id", c=case("doc_id", 7, [f"'<think>' || text || '</think>' || {NL} || '<response>hi</response>'", f"'<think>a</think>' || {NL} || '<tool_call>' || {NL} || '{{\"name\": \"f\", \"parameters\": {{\"x\": ' || n_chars % 3 || '}}}}' || {NL} || '</tool_call>'",
                                              f"'<think>a</think>' || {NL} || '<tool_call>' || {NL} || '{{}}' || {NL} || '</tool_call>' || {NL} || '<response>r</response>'", "'<think>' || text || '</think>'",
                                              f"'<think>a</think>' || {NL} || '<response>hi</response><response>again</response>'", "'<tool_call>not json</tool_call>'"], "text"),
            gold=case("doc_id", 7, ["'<response>a</response>'", "'<tool_call>' || chr(10) || '{\"name\": \"f\", \"parameters\": {\"x\": 1}}' || chr(10) || '</tool_call>'", "'<tool_call>{\"name\": \"g\", \"parameters\": {}}</tool_call><response>'", "'plain'", "'<response>'",
                                    "'<tool_call>{\"name\": \"f\", \"parameters\": {}}</tool_call>'"], "'<response>'"))


@query("tool_format", "R19", "SELECT doc_id AS id, CASE WHEN doc_id % 7 < 4 THEN 1.0::DOUBLE ELSE 0 END AS format FROM documents")
def _(t):
    return select(t.documents, **TOOL).select("id", R.tool_format("c", "gold").alias("format"))


@query("tool_correctness", "R20", """SELECT doc_id AS id, CASE doc_id % 7 WHEN 1 THEN CASE WHEN n_chars % 3 = 1 THEN 3.0::DOUBLE ELSE round(6.0 * 2 / 3 - 3, 6) END WHEN 2 THEN -3 WHEN 5 THEN -3 ELSE 0 END AS reward FROM documents""")
def _(t):
    return select(t.documents, **TOOL).select("id", F.round(R.tool_correctness("c", "gold"), 6).alias("reward"))


@query("loss_scale_spans", "R23", """SELECT conv_id, turn, text || '|' || 'Action:' || '|' || 'x' || '|' || 'Observation:' || '|' || text AS spans, '1.0,2.0,2.0,2.0,0.0' AS weights,
  '1.0,3.0,1.0' AS matched FROM conversations""")
def _(t):
    rows = t.conversations.withColumn("c", F.concat(F.col("text"), F.lit("Action:"), F.lit("x"), F.lit("Observation:"), F.col("text")))
    s = R.loss_scale_spans("c", {"Action:": (2.0, 2.0), "Observation:": (2.0, 0.0)})
    m = R.loss_scale_matches("c", {"Action:x": 3.0})
    return rows.select("conv_id", "turn", F.array_join(F.transform(s, lambda x: x["text"]), "|").alias("spans"), F.array_join(F.transform(s, lambda x: x["weight"].cast("string")), ",").alias("weights"),
                       F.array_join(F.transform(m, lambda x: x["weight"].cast("string")), ",").alias("matched"))


# ---- table question answering: answers in the forms the benchmarks use, wrapped in replies

QA = dict(id="doc_id", kind="lang", text="text", gold=case("doc_id", 12, ["'1,234'", "'12 days'", "'Red|blue, green'", "'1 week'", "'45.0'", "'(1,234)'", "'$5 million'", "'12.3%'", "'The Café'", "lang", "'-3.5'"], "lang || ' alpha'"),
          pred=case("doc_id", 12, ["'1234'", "'12'", "'GREEN, red|blue'", "'7 days'", "'45'", "'-1234'", "'$5,000,000'", "'12.35 %'", "'cafe'", "'The ' || lang || '!'", "'-3.50'"], "lang || CASE WHEN n_chars % 2 = 0 THEN ' alpha' ELSE ' beta' END"))
QA_CTE = "q AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in QA.items()) + " FROM documents)"


def qa(t):
    return select(t.spread("documents"), **QA)


def extract_reply(q):
    """Replies around the predicted answer."""
    r = q["id"] % 3
    return (F.when(r == 0, F.concat(q["text"], F.lit("<Answer>a</Answer> so <Answer>Answer: "), q["pred"], F.lit("</Answer>")))
            .when(r == 1, F.concat(F.lit("Answer: "), q["pred"], F.lit("\n\nbye"))).otherwise(F.concat(F.lit("<Answer> "), q["pred"], F.lit(" </Answer>"))))


NUMS = "[$¥€£]?\\s*[-+]?[0-9,]*\\.?[0-9]+\\s*(?:million|billion|thousand|M|B|K)?%?"


@query("extract_predicted", "E1", f"""WITH {QA_CTE} SELECT id, CASE WHEN id % 3 = 1 THEN regexp_extract(pred, '^[^."]+') ELSE pred END AS wikitq, CASE WHEN id % 3 = 0 THEN 'a' ELSE pred END AS hitab,
  CASE id % 3 WHEN 0 THEN pred || '</Answer>' WHEN 1 THEN pred || chr(10) || chr(10) || 'bye' ELSE '' END AS tablebench,
  CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN pred ELSE coalesce(trim(regexp_extract_all(pred, '{NUMS}')[-1]), '') END AS finqa FROM q""")
def _(t):
    q = qa(t)
    r = extract_reply(q)
    return q.select("id", *[A.extract_predicted(r, s).alias(s) for s in ("wikitq", "hitab", "tablebench", "finqa")])


@query("wikitq_match", "E2", f"WITH {QA_CTE} SELECT id, id % 12 IN (0, 1, 2, 3, 4, 10) OR (id % 12 = 11 AND gold = pred) AS ok FROM q")
def _(t):
    return qa(t).select("id", A.wikitq_match("pred", "gold").alias("ok"))


@query("squad_em_f1", "E3", f"""WITH {QA_CTE}, n AS (SELECT kind, id, {squad_sql('gold')} AS g, {squad_sql('pred')} AS p FROM q), tk AS (SELECT *, {words_sql('g')} AS gt, {words_sql('p')} AS pt FROM n),
  ov AS (SELECT kind, id, g, p, len(gt) AS ng, len(pt) AS np, coalesce(list_sum(list_transform(list_distinct(gt), lambda w: least(len(list_filter(gt, lambda x: x = w)), len(list_filter(pt, lambda x: x = w))))), 0) AS c FROM tk),
  s AS (SELECT kind, CASE WHEN id % 13 = 0 THEN 0 WHEN g = p THEN 1 ELSE 0 END AS em, CASE WHEN id % 13 = 0 THEN 0.0::DOUBLE WHEN ng = 0 OR np = 0 THEN CASE WHEN ng = np THEN 1 ELSE 0 END WHEN c = 0 THEN 0 ELSE 2.0 * c / (ng + np) END AS f1 FROM ov)
  SELECT kind AS part, round(100 * avg(em), 6) AS exact, round(100 * avg(f1), 6) AS f1, count(*) AS n FROM s GROUP BY kind UNION ALL SELECT 'total', round(100 * avg(em), 6), round(100 * avg(f1), 6), count(*) FROM s""")
def _(t):
    q = qa(t)
    gold = q.select("id", "kind", F.col("gold").alias("answer"))
    pred = q.select(F.when(F.col("id") % 13 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.col("pred").alias("answer"))
    return E.squad_report(pred, gold, "id").select("part", F.round("exact", 6).alias("exact"), F.round("f1", 6).alias("f1"), "n")


@query("squad_f1_texts", "E3", f"""WITH c AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), n AS (SELECT conv_id, turn, {squad_sql('a')} AS g, {squad_sql('b')} AS p FROM c WHERE b IS NOT NULL),
  tk AS (SELECT *, {words_sql('g')} AS gt, {words_sql('p')} AS pt FROM n), ov AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(gt), lambda w: least(len(list_filter(gt, lambda x: x = w)), len(list_filter(pt, lambda x: x = w))))), 0) AS c FROM tk)
  SELECT conv_id, turn, round(CASE WHEN len(gt) = 0 OR len(pt) = 0 THEN CASE WHEN len(gt) = len(pt) THEN 1 ELSE 0 END ELSE 2.0::DOUBLE * c / (len(gt) + len(pt)) END, 6) AS f1 FROM ov""")
def _(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(A.squad_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query("finqa_match", "E4", f"WITH {QA_CTE} SELECT id, id % 12 IN (1, 4, 6, 7, 10) OR (id % 12 = 11 AND gold = pred) AS ok, id % 12 IN (0, 1, 4, 7, 10) OR (id % 12 = 11 AND gold = pred) AS comma_aware FROM q")
def _(t):
    return qa(t).select("id", A.finqa_match("pred", "gold").alias("ok"), A.finqa_match("pred", "gold", comma_aware=True).alias("comma_aware"))


@query("hitab_match", "E5", f"WITH {QA_CTE} SELECT id, id % 12 IN (0, 4, 5, 10) OR (id % 12 = 11 AND gold = pred) AS ok, id % 12 IN (0, 4, 5, 7, 9, 10) OR (id % 12 = 11 AND gold = pred) AS both FROM q")
def _(t):
    q = qa(t)
    return q.select("id", A.hitab_match("pred", F.array("gold")).alias("ok"),
                    A.hitab_match("pred", F.array(F.col("gold"), F.when(F.col("id") % 12 == 11, "not there").otherwise(F.col("gold")))).alias("both"))


@query("multihiertt_em_f1", "E6", f"""WITH {QA_CTE}, n AS (SELECT id, CASE WHEN regexp_matches(gold, '^[$]?-?[0-9.,]+%?$') THEN replace(replace(replace(gold, ',', ''), '$', ''), '%', '')::DOUBLE / CASE WHEN contains(gold, '%') THEN 100 ELSE 1 END END AS g,
   CASE WHEN regexp_matches(pred, '^[$]?-?[0-9.,]+ ?%?$') THEN replace(replace(replace(pred, ',', ''), '$', ''), '%', '')::DOUBLE / CASE WHEN contains(pred, '%') THEN 100 ELSE 1 END END AS p, {squad_sql('gold')} AS gs, {squad_sql('pred')} AS ps FROM q)
  SELECT id, CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN CASE WHEN abs(p - g) / abs(g) < 1e-5 THEN 1.0::DOUBLE ELSE 0 END WHEN gs = ps THEN 1 ELSE 0 END AS exact,
   CASE WHEN g IS NOT NULL AND p IS NOT NULL AND abs(p - g) <= least(abs(g) * 0.01, 0.1) THEN 1.0::DOUBLE ELSE 0 END AS arithmetic FROM n""")
def _(t):
    s = A.multihiertt_scores("pred", "gold")
    return qa(t).select("id", s["exact"].alias("exact"), s["arithmetic"].alias("arithmetic"))


@query("aitqa_match", "E8", f"""WITH {QA_CTE} SELECT coalesce(kind, 'overall') AS kind, count(*) AS n, round(avg(CASE WHEN id % 12 IN (0, 1, 2, 4, 5, 8, 9, 10, 11) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM q GROUP BY ROLLUP (kind)""")
def _(t):
    out = E.match_report(qa(t), A.aitqa_match("pred", F.array("gold")), "kind")
    return out.select("kind", "n", F.round("accuracy", 6).alias("accuracy"))


@query("tablebench_match", "E9", f"""WITH {QA_CTE}, x AS (SELECT id, kind, regexp_extract(lower(gold), '[-+]?[0-9,]+\\.?[0-9]*') AS g, regexp_extract(lower(pred), '[-+]?[0-9,]+\\.?[0-9]*') AS p, {squad_sql('gold')} AS gs, {squad_sql('pred')} AS ps FROM q),
  o AS (SELECT kind, CASE WHEN g <> '' AND p <> '' AND try_cast(replace(g, ',', '') AS DOUBLE) IS NOT NULL AND try_cast(replace(p, ',', '') AS DOUBLE) IS NOT NULL THEN abs(replace(g, ',', '')::DOUBLE - replace(p, ',', '')::DOUBLE) < 1e-6
    ELSE CASE WHEN g <> '' THEN replace(g, ',', '') ELSE gs END = CASE WHEN p <> '' THEN replace(p, ',', '') ELSE ps END END AS ok FROM x)
  SELECT coalesce(kind, 'overall') AS kind, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS accuracy FROM o GROUP BY ROLLUP (kind)""")
def _(t):
    out = E.match_report(qa(t), A.tablebench_match("pred", F.array("gold")), "kind")
    return out.select("kind", "n", F.round("accuracy", 6).alias("accuracy"))


SPAN = dict(id="doc_id", kind="CASE doc_id % 3 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'span' ELSE 'multi-span' END", src="CASE doc_id % 2 WHEN 0 THEN 'table' ELSE 'table-text' END",
            p=case("doc_id", 6, ["array('5.2')", "array('the red house')", "array('b', 'a')", "array('12.5%')", "array('(134)')"], "array(lang)"), ps=case("doc_id", 6, ["'million'", "''", "''", "''", "''"], "''"),
            g=case("doc_id", 6, ["array('5.2')", "array('red house')", "array('a', 'b')", "array('12.5')", "array('-134')"], "array(source)"), gs=case("doc_id", 6, ["'million'", "''", "''", "'percent'", "''"], "''"))


@query("tatqa_em_f1", "E7", """WITH s AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'span' ELSE 'multi-span' END AS kind, doc_id % 2 = 0 AS tab, CASE WHEN doc_id % 6 = 5 THEN CASE WHEN lang = source THEN 1.0::DOUBLE ELSE 0 END ELSE 1 END AS v FROM documents)
  SELECT kind, coalesce(avg(v) FILTER (tab), 0) AS em_table, coalesce(avg(v) FILTER (tab), 0) AS f1_table, coalesce(avg(v) FILTER (NOT tab), 0) AS em_table_text, coalesce(avg(v) FILTER (NOT tab), 0) AS f1_table_text, count(*) AS n FROM s GROUP BY kind""")
def _(t):
    rows = select(t.documents, **SPAN).withColumn("score", E.span_scores("p", "ps", "g", "gs", "kind"))
    return E.span_report(rows, "kind", "src", ["table", "table-text"])


WSQL = dict(id="doc_id", reply=case("doc_id", 6, ["'<Answer>Answer: ```sql' || chr(10) || 'SELECT name FROM table WHERE size > 3;' || chr(10) || '```</Answer>'", "'```sql SELECT COUNT( name ) FROM table WHERE a = ''x'' AND b = 2 ```'",
                                                  "'so SELECT  max(x)  FROM table'", "'```SELECT a FROM t WHERE b = 1 ```'", "'SELECT name FROM table WHERE c_d = 5'"], "text"),
            gold=case("doc_id", 6, ["'select name from table where size > 3'", "'SELECT count(name) FROM table WHERE b = 2 AND a = x'", "'SELECT min(x) FROM table'", "'SELECT a FROM t WHERE b = 2'", "'SELECT name FROM table WHERE c d = 5'"], "'SELECT 1 FROM t'"))


@query("wikisql_match", "E11", """SELECT doc_id AS id, doc_id % 6 IN (0, 4) AS text_equal, doc_id % 6 IN (0, 1, 4) AS correct FROM documents""")
def _(t):
    return E.wikisql_match(select(t.documents, **WSQL), "reply", "gold").select("id", "text_equal", "correct")


def overlap_sql(n_grams, reference, candidate, units, sep):
    """Hits of a candidate's n-grams in the reference, for n from 1 to 4: (id, n, hits, size)."""
    gram = lambda side, n: f"SELECT id, {n} AS n, array_to_string({side}[i:i + {n - 1}], '{sep}') AS g, count(*) AS c FROM (SELECT id, {side}, unnest(range(1, len({side}) - {n - 2})) AS i FROM {units}) GROUP BY ALL"
    both = " UNION ALL ".join(f"SELECT c.id, c.n, sum(least(c.c, r.c)) AS hits FROM ({gram(candidate, n)}) c JOIN ({gram(reference, n)}) r USING (id, n, g) GROUP BY ALL" for n in n_grams)
    return f"SELECT u.id, m.n, coalesce(o.hits, 0) AS hits, greatest(1, len({candidate}) - m.n + 1) AS size, len({candidate}) AS lc, len({reference}) AS lr FROM {units} u CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) m LEFT JOIN ({both}) o ON o.id = u.id AND o.n = m.n"


TURNS = "p AS (SELECT row_number() OVER () AS id, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
WORD_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
BREVITY = "CASE WHEN max(lc) < max(lr) THEN 1 - max(lr) / max(lc) ELSE 0 END"
BLEU = f"""WITH {TURNS}, u AS (SELECT id, regexp_extract_all(lower(a), '{WORD_RE}') AS r, regexp_extract_all(lower(b), '{WORD_RE}') AS c FROM p WHERE a <> '' AND b <> ''),
  s AS (SELECT p.id, coalesce(v, 0) AS v FROM p LEFT JOIN (SELECT id, CASE WHEN max(hits) FILTER (n = 1) > 0 THEN exp(sum(ln(CASE WHEN hits > 0 THEN hits / size ELSE 0.1 / size END)) / 4 + {BREVITY}) ELSE 0 END AS v
    FROM ({overlap_sql((1, 2, 3, 4), 'r', 'c', 'u', chr(31))}) GROUP BY id) USING (id))
  SELECT round(avg(v), 9) AS mean, round(min(v), 9) AS min, round(max(v), 9) AS max, round(stddev_pop(v), 9) AS std, round(median(v), 9) AS median FROM s"""


@query("bleu4_summary", "E12", BLEU)
def _(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    s = a.join(b, ["conv_id", "turn"]).select(E.bleu4(F.array("a"), F.col("b")).alias("bleu"))
    return E.score_summary(s, "bleu").select(*[F.round(c, 9).alias(c) for c in ("mean", "min", "max", "std", "median")])


# The longest common subsequence by recursion over the words of one side: with a row of the table known, the next is the running maximum of its steps.
ROUGE = f"""WITH RECURSIVE {TURNS}, u AS (SELECT id, regexp_extract_all(a, '{WORD_RE}') AS x, regexp_extract_all(b, '{WORD_RE}') AS y, string_split(b, '') AS r, string_split(a, '') AS c FROM p),
  k AS (SELECT * FROM u WHERE len(x) > 0 AND len(y) > 0),
  l AS (SELECT id, 0 AS i, list_transform(y, lambda w: 0::BIGINT) AS row FROM k UNION ALL
        SELECT id, i + 1, list_transform(range(1, len(step) + 1), lambda j: list_max(step[1:j])) FROM (SELECT l.id, l.i, list_transform(range(1, len(y) + 1), lambda j: greatest(l.row[j], CASE WHEN y[j] = x[l.i + 1] THEN coalesce(l.row[j - 1], 0) + 1 ELSE 0 END)) AS step
          FROM l JOIN k ON k.id = l.id WHERE l.i < len(x))),
  q AS (SELECT l.id, l.row[len(y)] AS lcs FROM l JOIN k ON k.id = l.id AND l.i = len(x)),
  o AS ({overlap_sql((1, 2, 3, 4), 'r', 'c', 'k', '')}),
  z AS (SELECT *, sum(CASE WHEN hits = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS zeros FROM o),
  e AS (SELECT id, CASE WHEN max(hits) FILTER (n = 1) > 0 THEN exp(sum(ln(CASE WHEN hits > 0 THEN hits / size ELSE 1 / (2 ** zeros * size) END)) / 4 + {BREVITY}) ELSE 0 END AS bleu FROM z GROUP BY id),
  g AS (SELECT id, n, list_distinct(list_transform(range(1, len(x) - n + 2), lambda i: array_to_string(x[i:i + n - 1], chr(31)))) AS gx, list_distinct(list_transform(range(1, len(y) - n + 2), lambda i: array_to_string(y[i:i + n - 1], chr(31)))) AS gy
        FROM k CROSS JOIN (SELECT unnest([1, 2]) AS n)),
  f AS (SELECT id, n, CASE WHEN len(list_intersect(gx, gy)) > 0 THEN 2 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) ELSE 0 END AS f FROM g)
  SELECT round(avg(f) FILTER (n = 1) * 100, 6) AS rouge1, round(avg(f) FILTER (n = 2) * 100, 6) AS rouge2, round((SELECT avg(CASE WHEN lcs > 0 THEN 2 * lcs / (len(x) + len(y)) ELSE 0 END) FROM q JOIN k USING (id)) * 100, 6) AS rougel,
    round((SELECT avg(bleu) FROM e) * 100, 6) AS bleu4 FROM f"""


@query("rouge_bleu_mean", "E13", ROUGE)
def _(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return E.rouge_bleu_mean(a.join(b, ["conv_id", "turn"]), "a", "b")


@query("score_summary", "E12", "SELECT avg(o_totalprice) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, stddev_pop(o_totalprice) AS std, median(o_totalprice) AS median FROM orders".replace("avg(o_totalprice)", "round(avg(o_totalprice), 6)").replace("stddev_pop(o_totalprice)", "round(stddev_pop(o_totalprice), 6)"))
def _(t):
    out = E.score_summary(t.orders, "o_totalprice")
    return out.select(F.round("mean", 6).alias("mean"), "min", "max", F.round("std", 6).alias("std"), "median")


TRAJ = dict(id="doc_id", c=case("doc_id", 5, ["'<Code>a</Code><Execute>[Error] KeyError</Execute><Code>b</Code><Execute>ok</Execute><Answer>total 12, 1+2 + 3=6</Answer>'", "'KeyError ' || text || '<Answer>total ' || n_chars || '; 1+1=3</Answer>'",
                                              "'<Execute>' || text || '</Execute>'", "'<Answer>a</Answer><Answer>1,000.5 and 20 total</Answer>'"], "text"))


@query("trajectory_checks", "E21", """WITH b AS (SELECT doc_id AS id, doc_id % 5 AS k, text FROM documents) SELECT id, CAST(CASE k WHEN 0 THEN 2 ELSE 0 END AS INT) AS code_rounds, CAST(CASE k WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS INT) AS feedback_rounds,
  k = 0 OR (k = 2 AND contains(text, 'KeyError')) AS error_in_feedback, CAST(CASE WHEN k = 0 OR (k = 2 AND contains(text, '[Error]')) THEN 1 ELSE 0 END AS INT) AS execution_errors, k IN (0, 1, 3) AS has_answer, k IN (0, 1, 3) AS answer_claims, k <> 1 AS sums_hold FROM b""")
def _(t):
    return E.trajectory_checks(select(t.documents, **TRAJ), "c", "KeyError", "total").drop("c")


@query("numeric_screen", "E22", "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN FALSE WHEN 1 THEN FALSE WHEN 3 THEN TRUE ELSE FALSE END AS ok FROM documents")
def _(t):
    return select(t.documents, **TRAJ).select("id", A.numeric_screen("c", F.array(F.lit(1000.0), F.lit(20.01))).alias("ok"))


FINAL = dict(id="doc_id", c=case("doc_id", 5, ["text || 'boxed{a{' || n_chars || '}b} tail'", "text || 'boxed 12$ x'", "text || 'So the answer is ' || n_chars || '.' || chr(10) || 'more'", "text || '```output' || chr(10) || n_chars || '/' || chr(10) || '```'"], "text || ' 7 and 1,234.5'"))


@query("extract_final", "E23", "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'a{' || n_chars || '}b' WHEN 1 THEN '12' WHEN 2 THEN '' || n_chars WHEN 3 THEN '' || n_chars ELSE '1234.5' END AS final FROM documents")
def _(t):
    return E.extract_final(select(t.documents, **FINAL), "c").select("id", "final")


YES = dict(id="doc_id", c=case("doc_id", 6, ["'Yes, it is'", "'No. ' || lang", "'Yes or No' || chr(10) || ' yes '", "'yes yes no'", "'Yes No no' || chr(10) || 'unsure'"], "'nothing'"))


@query("parse_yes_no", "E29", "SELECT doc_id AS id, doc_id % 6 IN (0, 2, 3) AS verdict FROM documents")
def _(t):
    return select(t.documents, **YES).select("id", A.parse_yes_no("c").alias("verdict"))
