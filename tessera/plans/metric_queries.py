"""Competition metrics and evaluation reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import metrics as M
from .derived import select
from .registry import query


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def rounded(df, *keep):
    return df.select(*[c if c in keep or t != "double" else r6(c) for c, t in df.dtypes])


GOLD = dict(o_orderkey="o_orderkey", v="o_totalprice", c="o_custkey % 10", s="o_orderstatus")
# some predictions carry keys that no gold row has
PRED = dict(o_orderkey="CASE WHEN o_orderkey % 17 = 3 THEN 0 - o_orderkey - 1 ELSE o_orderkey END", v="o_totalprice * (0.9E0 + (o_custkey % 21) * 0.01E0)", c="CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 10 ELSE (o_custkey + o_orderkey) % 10 END",
            s="CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE o_orderstatus END")
PAIR = (f"g AS (SELECT {', '.join(f'{v} AS {k}' for k, v in GOLD.items())} FROM orders), p AS (SELECT {', '.join(f'{v} AS {k}' for k, v in PRED.items())} FROM orders), "
        "pr AS (SELECT o_orderkey, p.v AS pv, g.v AS gv, p.c AS pc, g.c AS gc, p.s AS ps, g.s AS gs FROM p JOIN g USING (o_orderkey))")


def pairs(t):
    return M.keyed(select(t.orders, **PRED), select(t.orders, **GOLD), ["o_orderkey"], ["v", "c", "s"])


@query("regression_metrics", "M1 M2 M3 M4 M5 M11 J1", f"""WITH {PAIR} SELECT round(avg((pv - gv) ** 2) / 1e6, 6) AS mse, round(sqrt(avg((pv - gv) ** 2)), 6) AS rmse,
  round(sqrt(avg((ln(1 + pv) - ln(1 + gv)) ** 2)), 6) AS rmsle, round(avg(abs(pv - gv)), 6) AS mae, round(100 * avg(2 * abs(pv - gv) / (abs(pv) + abs(gv))), 6) AS smape,
  round(1 - avg((pv - gv) ** 2) / var_pop(gv), 6) AS r2, round(corr(pv, gv), 6) AS pearson FROM pr""")
def _(t):
    return rounded(M.score(pairs(t), ["mse", "rmse", "rmsle", "mae", "smape", "r2", "pearson"], "v").withColumn("mse", F.col("mse") / 1e6))


@query("smape_zero_rules", "M4", """WITH x AS (SELECT l_discount AS p, l_tax AS g FROM lineitem)
  SELECT round(100 * avg(CASE WHEN abs(p) + abs(g) = 0 THEN 0 ELSE 2 * abs(p - g) / (abs(p) + abs(g)) END), 6) AS zeroed,
   round(avg(CASE WHEN abs(p) + abs(g) > 0 THEN 2 * abs(p - g) / (abs(p) + abs(g)) END), 6) AS ratio, FALSE AS undefined_is_number FROM x""")
def _(t):
    p, g = F.col("l_discount"), F.col("l_tax")
    a = t.lineitem.agg(M.smape(p, g, zero="zero").alias("zeroed"), (~F.isnan(M.smape(p, g))).alias("undefined_is_number"))
    b = t.lineitem.filter(p + g > 0).agg(M.smape(p, g, scale=1.0).alias("ratio"))
    return rounded(a.crossJoin(b))  # one row each


@query("mean_rmsle", "M2", f"WITH {PAIR} SELECT round((sqrt(avg((ln(1 + pv) - ln(1 + gv)) ** 2)) + sqrt(avg((ln(1 + pc) - ln(1 + gc)) ** 2))) / 2, 6) AS mean_rmsle FROM pr")
def _(t):
    return rounded(M.mean_over_columns(pairs(t), M.rmsle, ["v", "c"], "mean_rmsle"))


@query("matrix_mae", "M3", f"WITH {PAIR} SELECT round((avg(abs(pv - gv)) + avg(abs(pc - gc))) / 2, 6) AS mae FROM pr")
def _(t):
    return rounded(M.mean_over_columns(pairs(t), M.mae, ["v", "c"], "mae"))


@query("median_absolute_error", "M3", f"WITH {PAIR} SELECT round(median(abs(pv - gv)), 6) AS median_ae FROM pr")
def _(t):
    return rounded(M.median_absolute_error(pairs(t), "v"))


BIN = "b AS (SELECT doc_id, quality AS g, CAST((doc_id * 7 + quality * 20) % 53 AS DOUBLE) / 53 AS p, CASE WHEN (doc_id * 7 + quality * 20) % 53 > 26 THEN 1 ELSE 0 END AS h, toxic AS g2, CAST(doc_id * 3 % 11 AS DOUBLE) / 11 AS p2 FROM labels)"


def binary(t):
    gold = t.labels.select("doc_id", F.col("quality").alias("p"), F.col("quality").alias("h"), F.col("toxic").alias("p2"))
    pred = select(t.labels, doc_id="doc_id", p="CAST((doc_id * 7 + quality * 20) % 53 AS DOUBLE) / 53", h="CASE WHEN (doc_id * 7 + quality * 20) % 53 > 26 THEN 1 ELSE 0 END",
                  p2="CAST(doc_id * 3 % 11 AS DOUBLE) / 11")
    return M.keyed(pred, gold, ["doc_id"], ["p", "h", "p2"])


AUC = "(SELECT sum(CASE WHEN x.{p} > y.{p} THEN 1.0::DOUBLE WHEN x.{p} = y.{p} THEN 0.5 ELSE 0 END) / count(*) FROM b x, b y WHERE x.{g} = 1 AND y.{g} = 0)"


@query("roc_auc", "M6", f"WITH {BIN} SELECT round({AUC.format(p='p', g='g')}, 6) AS roc_auc")
def _(t):
    return rounded(M.roc_auc(binary(t), "p"))


@query("mean_roc_auc", "M6", f"WITH {BIN} SELECT round(({AUC.format(p='p', g='g')} + {AUC.format(p='p2', g='g2')}) / 2, 6) AS roc_auc")
def _(t):
    return rounded(M.mean_roc_auc(binary(t), ["p", "p2"]))


@query("log_loss", "M7", f"WITH {BIN} SELECT round(0 - avg(CASE WHEN g = 1 THEN ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) ELSE ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END), 6) AS log_loss FROM b")
def _(t):
    return rounded(M.score(binary(t), ["log_loss"], "p"))


@query("log_loss_multiclass", "M7", """WITH x AS (SELECT l_linenumber % 3 AS k, l_quantity AS a, l_discount * 100 + 1 AS b, l_tax * 100 + 1 AS c FROM lineitem)
  SELECT round(0 - avg(ln(CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END / (a + b + c))), 6) AS log_loss FROM x""")
def _(t):
    p = [F.col("l_quantity"), F.col("l_discount") * 100 + 1, F.col("l_tax") * 100 + 1]
    g = [(F.col("l_linenumber") % 3 == i).cast("int") for i in range(3)]
    return t.lineitem.agg(F.round(M.log_loss_multi(p, g), 6).alias("log_loss"))


@query("accuracy", "M8", f"WITH {PAIR} SELECT round(avg(CASE WHEN pc = gc THEN 1.0 ELSE 0 END), 6) AS by_class, round(avg(CASE WHEN ps = gs THEN 1.0 ELSE 0 END), 6) AS by_status FROM pr")
def _(t):
    return pairs(t).agg(r6(M.accuracy(F.col("pred_c"), F.col("gold_c")), "by_class"), r6(M.accuracy(F.col("pred_s"), F.col("gold_s")), "by_status"))


@query("f1_scores", "M9", f"""WITH {PAIR}, l AS (SELECT DISTINCT gc AS k FROM pr UNION SELECT pc FROM pr),
  f AS (SELECT k, 2.0::DOUBLE * count(*) FILTER (pc = k AND gc = k) / (count(*) FILTER (gc = k) + count(*) FILTER (pc = k)) AS f1 FROM pr, l GROUP BY k)
  SELECT round(max(f1) FILTER (k = 1), 6) AS f1_binary, round(avg(f1), 6) AS f1_macro, round((SELECT avg(CASE WHEN pc = gc THEN 1.0 ELSE 0 END) FROM pr), 6) AS f1_micro FROM f""")
def _(t):
    return rounded(M.f1_scores(pairs(t), "c"))


@query("quadratic_weighted_kappa", "M10", f"""WITH {PAIR}, o AS (SELECT gc, pc, count(*) AS n FROM pr GROUP BY ALL), r AS (SELECT gc, sum(n) AS n FROM o GROUP BY gc), c AS (SELECT pc, sum(n) AS n FROM o GROUP BY pc)
  SELECT round(1 - (SELECT sum((gc - pc) ** 2 / 81.0::DOUBLE * n) FROM o) / (SELECT sum((r.gc - c.pc) ** 2 / 81.0::DOUBLE * r.n * c.n) / (SELECT sum(n) FROM o) FROM r, c), 6) AS qwk""")
def _(t):
    return rounded(M.quadratic_weighted_kappa(pairs(t), "c", 10))


RANK = "SELECT corr(rx, ry) AS s FROM (SELECT rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0::DOUBLE AS ry FROM pr)"


@query("mean_spearman", "M11", f"WITH {PAIR} SELECT round(((SELECT s FROM ({RANK.format('pv', 'gv')})) + (SELECT s FROM ({RANK.format('pc', 'gc')}))) / 2, 6) AS spearman")
def _(t):
    return rounded(M.mean_spearman(pairs(t), ["v", "c"]))


GINI = "(SELECT (sum(cs) / max(tot) - (max(n) + 1) / 2.0::DOUBLE) / max(n) FROM (SELECT sum(gc) OVER (ORDER BY {0} DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS cs, sum(gc) OVER () AS tot, count(*) OVER () AS n FROM pr))"


@query("normalized_gini", "M12", f"WITH {PAIR} SELECT round({GINI.format('pc')} / {GINI.format('gc')}, 6) AS normalized_gini")
def _(t):
    return rounded(M.normalized_gini(pairs(t), "c", ["o_orderkey"]))


@query("hit_at_3", "M13", """WITH x AS (SELECT p_name AS p, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE 'ring' END AS g FROM part)
  SELECT round(avg(CASE WHEN list_contains(string_split(p, ' ')[1:3], g) THEN 1.0 ELSE 0 END), 6) AS hit_at_3 FROM x""")
def _(t):
    x = t.part.select(F.col("p_name").alias("pred_x"), F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[1]).otherwise("ring").alias("gold_x"))
    return rounded(M.score(x, ["hit_at_3"], "x"))


WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query("word_jaccard", "M14", f"""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
  w AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(nxt), '{WS}+'), lambda x: x <> '')) AS b FROM c WHERE nxt IS NOT NULL)
  SELECT round(avg(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))), 6) AS word_jaccard FROM w""")
def _(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("pred_x"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold_x"))
    return rounded(M.score(a.join(b, ["conv_id", "turn"]), ["word_jaccard"], "x"))


CLAIM = dict(id="doc_id", g="CASE WHEN doc_id % 19 = 0 THEN NULL WHEN n_chars % 3 = 0 THEN 'SUPPORTS' WHEN n_chars % 3 = 1 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END",
             p="CASE WHEN doc_id % 23 = 1 THEN NULL WHEN doc_id % 4 = 0 THEN 'REFUTES' WHEN n_chars % 3 = 0 THEN 'SUPPORTS' ELSE 'NOT ENOUGH INFO' END")
CLAIM_CTE = "c AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CLAIM.items()) + " FROM documents)"
LABELS = ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO"]


@query("label_accuracy", "E10", f"""WITH {CLAIM_CTE} SELECT count(*) AS total, count(*) FILTER (g = p) AS correct, count(*) FILTER (g <> p) AS incorrect, count(*) FILTER (g IS NULL) AS missing_truth,
  count(*) FILTER (g IS NOT NULL AND p IS NULL) AS missing_prediction, round(count(*) FILTER (g = p) / count(*) FILTER (g IS NOT NULL AND p IS NOT NULL), 6) AS accuracy FROM c""")
def _(t):
    return rounded(E.label_accuracy(select(t.documents, **CLAIM), "g", "p"))


@query("label_confusion", "E10", f"""WITH {CLAIM_CTE} SELECT g AS label, {', '.join(f"count(*) FILTER (p = '{x}') AS pred_{x.lower().replace(' ', '_')}" for x in LABELS)}, count(p) AS total, count(*) FILTER (g = p) AS correct,
  round(count(*) FILTER (g = p) / count(p), 6) AS accuracy FROM c WHERE g IS NOT NULL GROUP BY g""")
def _(t):
    return rounded(E.label_confusion(select(t.documents, **CLAIM), "g", "p", LABELS))


SEQ = dict(k="l_orderkey", lab="{a}(-100, CAST(l_linenumber AS INT), CASE WHEN l_quantity > 40 THEN -100 ELSE CAST(l_quantity AS INT) END)",
           pre="{a}(CAST(l_linenumber AS INT), CASE WHEN l_discount > 0.05 THEN 7 ELSE CAST(l_quantity AS INT) END, 0)")


@query("token_seq_accuracy", "E14", "WITH s AS (SELECT " + ", ".join(f"{v.format(a='list_value')} AS {k}" for k, v in SEQ.items()) + """ FROM lineitem),
  u AS (SELECT list_filter([1, 2], lambda i: lab[i + 1] <> -100) AS idx, lab, pre FROM s), x AS (SELECT len(idx) AS n, len(list_filter(idx, lambda i: lab[i + 1] = pre[i])) AS ok FROM u)
  SELECT round(sum(ok) / sum(n), 6) AS token_acc, round(avg(CASE WHEN ok = n THEN 1.0 ELSE 0 END), 6) AS seq_acc FROM x""")
def _(t):
    return rounded(E.token_seq_accuracy(select(t.lineitem, **{k: v.format(a="array") for k, v in SEQ.items()}), "pre", "lab"))


@query("throughput_summary", "E15", """WITH m AS (SELECT event_id % 4000 AS rid, max({'t': ts, 'p': user_id, 'g': CAST(round(value) AS BIGINT)}) AS u, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), l AS (SELECT u.p AS p, u.g AS g, a, b FROM m),
  s AS (SELECT sum(p)::BIGINT AS num_prompt_tokens, sum(g)::BIGINT AS num_generated_tokens, count(*) AS num_samples, (epoch_us(max(b)) - epoch_us(min(a))) / 1e6::DOUBLE AS runtime FROM l)
  SELECT num_prompt_tokens, num_generated_tokens, num_samples, round(runtime, 6) AS runtime, round(num_samples / runtime, 6) AS samples_per_s, round(num_generated_tokens / runtime, 6) AS tokens_per_s FROM s""")
def _(t):
    log = select(t.events, rid="event_id % 4000", p="user_id", g="CAST(round(value) AS BIGINT)", ts="ts")
    return rounded(E.throughput_summary(log, "rid", "p", "g", "ts"))


RUNS = dict(model="CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'tuned' END", library="lang", perturbation="CASE WHEN n_chars % 5 = 0 THEN 'Surface' WHEN n_chars % 5 = 1 THEN 'Semantic' ELSE 'Origin' END",
            score="CASE WHEN (doc_id * 13 + n_chars) % 7 < 3 + doc_id % 2 THEN 1 ELSE 0 END")
RUNS_CTE = "r AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in RUNS.items()) + """ FROM documents),
  lng AS (SELECT model, 'overall' AS dimension, 'overall' AS category, count(*) AS count, sum(score)::BIGINT AS passed FROM r GROUP BY model
   UNION ALL SELECT model, 'library', library, count(*), sum(score)::BIGINT FROM r GROUP BY model, library UNION ALL SELECT model, 'perturbation', perturbation, count(*), sum(score)::BIGINT FROM r GROUP BY model, perturbation)"""


@query("pass_rate_by", "E16", f"WITH {RUNS_CTE} SELECT *, round(passed / count, 6) AS pass_rate FROM lng")
def _(t):
    return rounded(E.pass_rate_by(select(t.documents, **RUNS), "score", ["library", "perturbation"], "model"))


@query("compare_models", "J7 E16", f"""WITH {RUNS_CTE} SELECT dimension, category, round(max(passed / count) FILTER (model = 'base'), 6) AS base, round(max(passed / count) FILTER (model = 'tuned'), 6) AS other,
  round((max(passed / count) FILTER (model = 'tuned') - max(passed / count) FILTER (model = 'base')) * 100, 6) AS delta_points FROM lng GROUP BY ALL""")
def _(t):
    return rounded(E.compare_models(E.pass_rate_by(select(t.documents, **RUNS), "score", ["library", "perturbation"], "model"), "model", "base", "tuned"))


VERDICT = "CASE WHEN n_chars % 3 = 0 THEN 'It is TRUE' WHEN n_chars % 3 = 1 THEN 'false' ELSE 'True.' END"


@query("challenge_accuracy", "E17", f"""WITH v AS (SELECT source, count(*) FILTER (contains(lower({VERDICT}), 'true')) AS ok, count(*) AS n FROM documents GROUP BY source)
  SELECT round(sum(ok) / sum(n), 6) AS accuracy, round(avg(ok / n), 6) AS challenge_accuracy, sum(n)::BIGINT AS questions, count(*) AS challenges FROM v""")
def _(t):
    return rounded(E.challenge_accuracy(select(t.documents, source="source", v=VERDICT), "v", "source"))


TASK = dict(name="p_partkey", baseline="p_retailprice * 0.5E0", gold_best="CASE WHEN p_partkey % 9 = 0 THEN p_retailprice * 0.2E0 ELSE p_retailprice END", cost="p_size * 0.01E0", time="p_size * 1E0")
RESULT = dict(name="CASE WHEN p_partkey % 5 = 2 THEN 0 - p_partkey - 1 ELSE p_partkey END", pred="CASE WHEN p_partkey % 6 = 1 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice * (0.3E0 + p_partkey % 8 * 0.1E0) END")


@query("normalized_task_score", "E18", "WITH t AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in TASK.items()) + " FROM part), r AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in RESULT.items()) + """ FROM part)
  SELECT count(*) AS tasks, round(avg(CASE WHEN r.name IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS completion_rate, round(sum(cost), 6) AS cost, round(sum(time), 6) AS time,
   round(avg(CASE WHEN pred IS NULL OR isnan(pred) THEN 0 ELSE greatest((pred - baseline) / (gold_best - baseline), 0) END), 6) AS score FROM t LEFT JOIN r ON t.name = r.name""")
def _(t):
    return rounded(E.normalized_task_score(select(t.part, **TASK), select(t.part, **RESULT), "name"))


HIST = dict(run="user_id", step="event_id", passed="CAST(20 + event_id % 14 AS INT)", has_code="CAST(24 + event_id * 3 % 9 AS INT)", ended="CAST(25 + event_id * 5 % 8 AS INT)", repetitive="CAST(event_id % 6 AS INT)")


@query("dev_gate", "E19", "WITH h AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in HIST.items()) + """ FROM events), f AS (SELECT run, step, passed,
   passed <= 28 - 8 OR has_code <= 31 - 8 OR repetitive >= 8 AS severe, passed <= 28 - 4 OR ended <= 31 - 4 OR repetitive >= 1 + 4 AS moderate,
   passed >= 28 AND has_code >= 31 AND ended >= 31 AND repetitive <= 2 AS qualified FROM h),
  l AS (SELECT *, severe OR (moderate AND coalesce(lag(moderate) OVER (PARTITION BY run ORDER BY step), FALSE)) AS stop, row_number() OVER (PARTITION BY run, qualified ORDER BY passed DESC, step) = 1 AND qualified AS best FROM f)
  SELECT run, step, severe, moderate, qualified, stop, best FROM l""")
def _(t):
    out = E.dev_gate(select(t.events, **HIST), {"passed": 28, "has_code": 31, "ended": 31, "repetitive": 1})
    return out.select("run", "step", "severe", "moderate", "qualified", "stop", "best")


CODE = dict(step="user_id", passed="event_id % 3 = 0", has_code="event_id % 5 <> 0", finish_reason="CASE WHEN event_id % 7 < 5 THEN 'stop' ELSE 'length' END", repetitive="event_id % 11 = 0")


@query("code_verdict_summary", "E20", "WITH c AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CODE.items()) + """ FROM events) SELECT step, count(*) AS count, count(*) FILTER (passed) AS passed, count(*) FILTER (has_code) AS has_code,
  count(*) FILTER (finish_reason = 'stop') AS ended, count(*) FILTER (finish_reason = 'length') AS length_limited, count(*) FILTER (repetitive) AS repetitive FROM c GROUP BY step""")
def _(t):
    return E.code_verdict_summary(select(t.events, **CODE), ["step"])


VP = "v AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y, CASE WHEN a.label = b.label THEN 1 ELSE 0 END + a.vec_id % 3 AS l FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def vector_pairs(t):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("x"), F.col("label").alias("la"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"), F.col("label").alias("lb"))
    return a.join(b, "vec_id").withColumn("l", (F.col("la") == F.col("lb")).cast("int") + F.col("vec_id") % 3)


SIMS = {"cosine": "list_inner_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_inner_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_inner_product(y::DOUBLE[], y::DOUBLE[])))", "dot": "list_inner_product(x::DOUBLE[], y::DOUBLE[])",
        "manhattan": "0 - list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i]::DOUBLE - y[i]::DOUBLE)))", "euclidean": "0 - sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i]::DOUBLE - y[i]::DOUBLE) ** 2)))"}


@query("pair_similarity_metrics", "E25", f"WITH {VP}, s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS similarity, l, {e} AS s FROM v" for n, e in SIMS.items()) + """),
  r AS (SELECT similarity, l, s, rank() OVER (PARTITION BY similarity ORDER BY l) + (count(*) OVER (PARTITION BY similarity, l) - 1) / 2.0::DOUBLE AS rl,
    rank() OVER (PARTITION BY similarity ORDER BY s) + (count(*) OVER (PARTITION BY similarity, s) - 1) / 2.0::DOUBLE AS rs FROM s)
  SELECT similarity, round(corr(l, s), 4) AS pearson, round(corr(rl, rs), 4) AS spearman FROM r GROUP BY similarity""")
def _(t):
    out = E.pair_similarity_metrics(vector_pairs(t), "x", "y", "l")
    return out.select("similarity", F.round("pearson", 4).alias("pearson"), F.round("spearman", 4).alias("spearman"))


CAND = "vec_id - vec_id % 5"


def anchors_candidates(t):
    e = t.embeddings.withColumn("anchor", F.expr(CAND)).withColumn("batch", F.expr("vec_id - vec_id % 20"))
    a = e.filter("vec_id % 5 = 0").select("anchor", "batch", F.col("embedding").alias("vec"))
    c = e.filter("vec_id % 5 <> 0").select("anchor", "batch", F.col("vec_id").alias("cand"), F.col("embedding").alias("vec"), (F.col("vec_id") % 5 == 1).alias("positive"))
    return a, c


def margin_sql(on):
    return f"""WITH e AS (SELECT vec_id, {CAND} AS anchor, vec_id - vec_id % 20 AS batch, embedding::DOUBLE[] AS vec FROM embeddings),
  s AS (SELECT a.anchor, list_inner_product(a.vec, c.vec) AS s, c.vec_id % 5 = 1 AND a.anchor = c.anchor AS pos FROM e a JOIN e c ON a.{on} = c.{on} AND a.vec_id % 5 = 0 AND c.vec_id % 5 <> 0),
  p AS (SELECT anchor, max(s) FILTER (pos) AS p, max(s) FILTER (NOT pos) AS h, sum(s) FILTER (NOT pos) AS ns, count(*) FILTER (NOT pos) AS nn FROM s GROUP BY anchor)
  SELECT round(avg(p - h), 5) AS margin, round(sum(ns) / sum(nn), 5) AS mean_neg, round(avg(p), 5) AS mean_pos FROM p"""


@query("contrastive_margin", "E26", margin_sql("anchor"))
def _(t):
    a, c = anchors_candidates(t)
    return E.contrastive_margin(a.drop("batch"), c.drop("batch"), "anchor").select(*[F.round(x, 5).alias(x) for x in ("margin", "mean_neg", "mean_pos")])


@query("contrastive_margin_in_batch", "E26", margin_sql("batch"))
def _(t):
    a, c = anchors_candidates(t)
    return E.contrastive_margin(a, c, "anchor", "batch").select(*[F.round(x, 5).alias(x) for x in ("margin", "mean_neg", "mean_pos")])


@query("rerank_mrr_ndcg", "E27", """WITH d AS (SELECT event_id, value AS s, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS l FROM events),
  q AS (SELECT *, sum(l) OVER (ORDER BY event_id) AS q FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, event_id) AS rk, count(*) OVER (PARTITION BY q) AS n FROM q)
  SELECT round(avg(1 / rk), 6) AS mrr, round(avg(1 / log2(rk + 1)), 6) AS ndcg, count(*) AS queries FROM r WHERE l = 1 AND n >= 2""")
def _(t):
    rows = select(t.events, event_id="event_id", s="value", l="CASE WHEN event_type = 'error' THEN 1 ELSE 0 END")
    return rounded(E.rerank_mrr_ndcg(E.queries_from_labels(rows, ["event_id"], "l"), "query", "s", "l", "event_id"))


@query("channel_loss", "E28", """WITH o AS (SELECT l_orderkey AS k, l_quantity AS loss, CASE WHEN l_linenumber = 3 THEN -100 ELSE 1 END AS lab, l_linenumber = 1 AS first, l_partkey, l_suppkey, l_quantity FROM lineitem),
  t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_partkey, l_suppkey, l_quantity) AS i FROM o), m AS (SELECT *, sum(CASE WHEN i = 1 OR first THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS mem FROM t)
  SELECT CASE WHEN mem = 1 THEN 'code' WHEN mem = 2 THEN 'math' ELSE 'chat' END AS channel, round(sum(loss) / count(*), 6) AS loss, count(*) AS tokens FROM m WHERE lab <> -100 GROUP BY 1""")
def _(t):
    toks = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_linenumber")))
    rows = t.lineitem.groupBy("l_orderkey").agg(toks.alias("t")).select(
        "l_orderkey", F.transform("t", lambda x: x["l_quantity"]).alias("loss"), F.transform("t", lambda x: F.when(x["l_linenumber"] == 3, -100).otherwise(1)).alias("lab"),
        F.transform("t", lambda x, i: F.when((i == 0) | (x["l_linenumber"] == 1), 0).otherwise(i)).alias("pos"),
        F.concat(F.array(F.lit("code"), F.lit("math")), F.array_repeat(F.lit("chat"), 20)).alias("ch"))
    return rounded(E.channel_loss(rows, "l_orderkey", "ch", "loss", "lab", "pos"))


@query("experiment_report", "E30", """SELECT 'run-' || p_partkey AS name, p_brand AS "group", p_type AS args, p_size::DOUBLE AS arc, CASE WHEN p_partkey % 3 = 0 THEN p_size / 2.0::DOUBLE END AS gsm8k,
  round(p_size * 10 / (p_size + 5.0::DOUBLE), 6) AS samples_per_s, round(p_size * 100 / (p_size + 5.0::DOUBLE), 6) AS tokens_per_s FROM part""")
def _(t):
    one = F.struct(F.lit("arc").alias("name"), (F.col("p_size") * 1.0).alias("score"))
    two = F.struct(F.lit("gsm8k").alias("name"), (F.col("p_size") / 2.0).alias("score"))
    runs = t.part.select(F.concat(F.lit("run-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("group"), F.col("p_type").alias("args"),
                         (F.col("p_size") * 10).alias("samples"), (F.col("p_size") * 100).alias("tokens"), (F.col("p_size") + 5.0).alias("seconds"),
                         F.when(F.col("p_partkey") % 3 == 0, F.array(one, two)).otherwise(F.array(one)).alias("reports"))
    return rounded(E.experiment_report(runs, ["arc", "gsm8k"]))


@query("serialize_table", "E24", """SELECT n_regionkey, 'n_nationkey | n_name' || chr(10) || string_agg(n_nationkey || ' | ' || n_name || chr(10), '' ORDER BY sha256('7' || chr(31) || n_regionkey || chr(31) || n_nationkey)) AS text FROM nation GROUP BY n_regionkey""")
def _(t):
    return E.serialize_table(t.nation, "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"], perturb="row_shuffle")


@query("serialize_table_csv", "E24", """SELECT conv_id, '"role","turn"' || chr(10) || string_agg('"' || role || '","' || turn || '"' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def _(t):
    return E.serialize_table(t.conversations, "conv_id", "turn", ["role", "turn"], fmt="csv")


@query("case_pass_rate", "R21", "SELECT l_orderkey AS uid, round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0 END), 6) AS reward, count(*) AS cases FROM lineitem GROUP BY l_orderkey")
def _(t):
    return rounded(E.case_pass_rate(t.lineitem.select(F.col("l_orderkey").alias("uid"), (F.col("l_discount") < 0.05).alias("ok")), ["uid"], "ok"))
