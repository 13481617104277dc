"""Rollout queries, with their SQL.  One order is one prompt, its lines are the samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollouts as R
from .derived import ROLLOUT_CTE, TOKEN_CTE, rollouts, select, token_rollouts
from .registry import query


def r6(c):
    return F.round(c, 6).alias(c)


REW = dict(uid="uid", sample="sample", a="CASE WHEN sample % 5 = 0 THEN NULL ELSE reward END", b="CASE WHEN sample % 15 = 0 THEN NULL ELSE tokens * 0.1E0 END",
           tokens="tokens", stop="stop")
REW_CTE = ROLLOUT_CTE + ", w AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in REW.items()) + " FROM rollouts)"


@query("weighted_reward", "A1", f"WITH {REW_CTE} SELECT uid, sample, round(coalesce(a, 0) * 0.7 + coalesce(b, 0) * 0.3, 6) AS reward, a IS NULL AND b IS NULL AS missing FROM w")
def _(t):
    w = select(rollouts(t), **REW)
    return w.select("uid", "sample", F.round(R.weighted_reward({"a": 0.7, "b": 0.3}), 6).alias("reward"), R.all_missing(["a", "b"]).alias("missing"))


G = f"{ROLLOUT_CTE}, g AS (SELECT *, avg(reward) OVER u AS m, stddev_samp(reward) OVER u AS s, count(*) OVER u AS n FROM rollouts WINDOW u AS (PARTITION BY uid))"


@query("grpo_advantage", "A2", f"WITH {G} SELECT uid, sample, round(CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - m) / (s + 1e-6) END, 4) AS advantage FROM g")
def _(t):
    return R.grpo_advantage(rollouts(t), "uid", "sample", "reward").select("uid", "sample", F.round("advantage", 4).alias("advantage"))


@query("grpo_advantage_centered", "A2", f"WITH {G} SELECT uid, sample, round(CASE WHEN n = 1 THEN reward ELSE reward - m END, 6) AS advantage FROM g")
def _(t):
    return R.grpo_advantage(rollouts(t), "uid", "sample", "reward", norm_by_std=False).select("uid", "sample", r6("advantage"))


@query("rloo_advantage", "A3", f"WITH {G} SELECT uid, sample, round(CASE WHEN n = 1 THEN 0 ELSE (reward - m) * n / (n - 1) END, 6) AS advantage FROM g")
def _(t):
    return R.rloo_advantage(rollouts(t), "uid", "sample", "reward").select("uid", "sample", r6("advantage"))


TG = (f"{TOKEN_CTE}, g AS (SELECT uid, sample, mask, list_sum(rewards) AS score, avg(list_sum(rewards)) OVER u AS m, stddev_samp(list_sum(rewards)) OVER u AS s, count(*) OVER u AS n "
      "FROM tr WINDOW u AS (PARTITION BY uid))")


def _on_tokens(advantage):
    return f"WITH {TG}, a AS (SELECT *, {advantage} AS adv FROM g) SELECT uid, sample, round(score, 6) AS score, " + ", ".join(f"round(adv * mask[{i + 1}], 4) AS t{i}" for i in range(3)) + " FROM a"


def _token_columns(df):
    return df.select("uid", "sample", F.round("score", 6).alias("score"), *[F.round(F.get("advantages", F.lit(i)), 4).alias(f"t{i}") for i in range(3)])


@query("grpo_token_advantage", "A2", _on_tokens("CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - m) / (s + 1e-6) END"))
def _(t):
    return _token_columns(R.token_group_advantage(token_rollouts(t), "uid", "sample", "rewards", "mask"))


@query("rloo_token_advantage", "A3", _on_tokens("CASE WHEN n = 1 THEN 0 ELSE (score - m) * n / (n - 1) END"))
def _(t):
    return _token_columns(R.token_group_advantage(token_rollouts(t), "uid", "sample", "rewards", "mask", "rloo"))


def _flat(df, cols):
    return df.select("uid", "sample", *[F.round(F.get(c, F.lit(i)), 5).alias(f"{c}_{i}") for c in cols for i in range(3)])


RET = """x AS (SELECT *, rewards[3] AS r3, rewards[2] + {g} * rewards[3] * mask[3] AS r2 FROM tr),
  y AS (SELECT *, rewards[1] + {g} * r2 * mask[2] AS r1 FROM x)"""
MOM = """tok AS (SELECT unnest([{0}1, {0}2, {0}3]) AS v, unnest(mask) AS m FROM {1}),
  st AS (SELECT avg(v) FILTER (m <> 0) AS mu, var_samp(v) FILTER (m <> 0) AS var, var_pop(v) FILTER (m <> 0) AS vp, avg(v) AS al FROM tok)"""


@query("reinforce_pp_advantage", "A4", f"WITH {TOKEN_CTE}, {RET.format(g=0.9)}, {MOM.format('r', 'y')} SELECT uid, sample, " + ", ".join(
    f"round(r{i + 1}, 5) AS returns_{i}, round((r{i + 1} - mu) / sqrt(var + 1e-8) * mask[{i + 1}], 5) AS advantages_{i}" for i in range(3)) + " FROM y, st")
def _(t):
    return _flat(R.reinforce_pp_advantage(token_rollouts(t), "rewards", "mask", 0.9), ["returns", "advantages"])


GAE = """x AS (SELECT *, rewards[3] - val[3] AS a3 FROM tr), x2 AS (SELECT *, rewards[2] + 0.9 * val[3] - val[2] + 0.9 * 0.8 * a3 AS a2 FROM x),
  y AS (SELECT *, rewards[1] + 0.9 * val[2] - val[1] + 0.9 * 0.8 * a2 AS a1 FROM x2)"""


@query("gae", "A5", f"WITH {TOKEN_CTE}, {GAE}, {MOM.format('a', 'y')} SELECT uid, sample, " + ", ".join(
    f"round(a{i + 1} + val[{i + 1}], 5) AS returns_{i}, round((a{i + 1} - mu) / sqrt(var + 1e-8), 5) AS advantages_{i}" for i in range(3)) + " FROM y, st")
def _(t):
    return _flat(R.gae(token_rollouts(t), "rewards", "val", "mask", 0.9, 0.8), ["returns", "advantages"])


@query("normalize_advantages", "A6", f"WITH {TOKEN_CTE}, y AS (SELECT *, rewards[1] AS r1, rewards[2] AS r2, rewards[3] AS r3 FROM tr), {MOM.format('r', 'y')} SELECT uid, sample, " + ", ".join(
    f"round((r{i + 1} - al) / sqrt(greatest(vp + (mu - al) ** 2, 1e-8)), 5) AS n_{i}, round((r{i + 1} - mu) / sqrt(var + 1e-8) + mu, 5) AS w_{i}" for i in range(3)) + " FROM y, st")
def _(t):
    rows = R.normalize_advantages(token_rollouts(t), "rewards", "mask", out="n")
    return _flat(R.whiten(rows, "rewards", "mask", shift_mean=False, out="w"), ["n", "w"])


KL = {"k1": "$", "abs": "abs($)", "k2": "0.5 * $ * $", "k3": "exp(0 - $) + $ - 1"}


def kl_sql(kind):
    return "[" + ", ".join("(" + KL[kind].replace("$", f"(logp[{i}] - base_logp[{i}])") + f") * mask[{i}]" for i in (1, 2, 3)) + "]"


@query("approx_kl", "A7", f"WITH {TOKEN_CTE}, k AS (SELECT *, " + ", ".join(f"{kl_sql(k)} AS {k}" for k in KL) + " FROM tr) SELECT uid, sample, " + ", ".join(
    f"round(list_sum({k}) / greatest(list_sum(mask), 1), 6) AS {k}_mean, round(list_max(list_transform({k}, lambda x: abs(x))), 6) AS {k}_max" for k in KL)
    + ", round(rewards[1] - 0.1 * k3[1], 6) AS penalised_first FROM k")
def _(t):
    out = token_rollouts(t)
    for k in KL:
        out = R.kl_penalty(out, "rewards", "logp", "base_logp", "mask", 0.1, k).withColumnsRenamed({"kl_mean": f"{k}_mean", "kl_max": f"{k}_max"}).drop("kl")
        out = out.withColumn(f"pen_{k}", F.get("penalised", F.lit(0))).drop("penalised")
    return out.select("uid", "sample", *[r6(f"{k}_{s}") for k in KL for s in ("mean", "max")], F.round("pen_k3", 6).alias("penalised_first"))


def loss_sql(kind):
    ratio = {"gspo": "exp(least((" + " + ".join(f"(logp[{i}] - base_logp[{i}]) * mask[{i}]" for i in (1, 2, 3)) + ") / greatest(list_sum(mask), 1), 10))"}
    parts = []
    for i in (1, 2, 3):
        r = ratio.get(kind, f"exp(logp[{i}] - base_logp[{i}])")
        a = f"(rewards[{i}] - 0.5)"
        s1, s2 = f"{r} * {a}", f"least(greatest({r}, 0.8), 1.2) * {a}"
        loss = f"(0 - least({s1}, {s2}))"
        if kind == "dual_clip":
            loss = f"CASE WHEN {a} < 0 THEN least({loss}, 0 - {a} * 3) ELSE {loss} END"
        if kind == "tis":
            loss = f"{loss} * least(exp(base_logp[{i}] - logp[{i}]), 1.1)"
        parts.append((f"({loss}) * mask[{i}]", f"(CASE WHEN 0 - {s2} > 0 - {s1} THEN 1.0 ELSE 0.0 END) * mask[{i}]"))
    return f"SELECT '{kind}' AS kind, {' + '.join(p[0] for p in parts)} AS l, {' + '.join(p[1] for p in parts)} AS c, list_sum(mask) AS n FROM tr"


@query("policy_loss_terms", "A8", f"WITH {TOKEN_CTE}, q AS ({' UNION ALL '.join(loss_sql(k) for k in ('regular', 'dual_clip', 'gspo', 'tis'))}) SELECT kind, "
       "round(sum(l) / greatest(sum(n), 1), 6) AS token_mean, round(avg(l / greatest(n, 1)), 6) AS sequence_mean, round(avg(l / 8), 6) AS seq_mean_token_sum_norm, "
       "round(sum(c) / greatest(sum(n), 1), 6) AS clip_ratio FROM q GROUP BY kind")
def _(t):
    rows = token_rollouts(t).withColumn("adv", F.transform("rewards", lambda r: r - 0.5))
    parts = []
    for kind in ("regular", "dual_clip", "gspo", "tis"):
        args = dict(rollout_logp="logp", cap=1.1, kind="regular") if kind == "tis" else dict(kind=kind)
        parts.append(R.policy_loss_terms(rows, "logp", "base_logp", "adv", "mask", **args).select(F.lit(kind).alias("kind"), "loss_sum", "clipped", "n_tokens"))
    terms = parts[0]
    for p in parts[1:]:
        terms = terms.unionByName(p)
    out = R.reduce_loss(terms, 8, ["kind"])
    return out.select("kind", *[r6(c) for c in out.columns if c != "kind"])


@query("rewards_to_tokens", "A9", f"WITH {TOKEN_CTE} SELECT uid, sample, round(reward, 6) AS last_reward, 0.0::DOUBLE AS before_last, 3 AS n FROM tr")
def _(t):
    rows = token_rollouts(t).withColumn("tr", R.rewards_to_tokens(F.col("reward"), F.col("ids")))
    return rows.select("uid", "sample", F.round(F.get("tr", F.lit(2)), 6).alias("last_reward"),
                       (F.get("tr", F.lit(0)) + F.get("tr", F.lit(1))).alias("before_last"), F.size("tr").alias("n"))


@query("rollout_score", "A10", f"WITH {ROLLOUT_CTE}, g AS (SELECT uid, sum(reward) AS s, count(*) AS n FROM rollouts GROUP BY uid) SELECT round(sum(s) / sum(n), 6) AS avg_score, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_at_n FROM g")
def _(t):
    return R.rollout_score(rollouts(t), "uid", "reward").select(r6("avg_score"), r6("pass_at_n"))


@query("per_source_metrics", "A11", f"""WITH {ROLLOUT_CTE}, g AS (SELECT source, uid, sum(reward) AS s, count(*) AS n FROM rollouts GROUP BY GROUPING SETS ((source, uid), (uid))),
  h AS (SELECT replace(coalesce(source, 'unknown'), '/', '_') AS source, uid, sum(reward) AS s, count(*) AS n FROM rollouts GROUP BY ALL UNION ALL SELECT 'all', uid, sum(reward), count(*) FROM rollouts GROUP BY uid)
  SELECT source, round(sum(s) / sum(n), 6) AS avg_score, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_at_n FROM h GROUP BY source""")
def _(t):
    return R.per_source_metrics(rollouts(t), "uid", "reward", "source", overall=True).select("source", r6("avg_score"), r6("pass_at_n"))


@query("rollout_token_stats", "A12", f"""WITH {ROLLOUT_CTE} SELECT stop, min(tokens) AS min_tokens, max(tokens) AS max_tokens, round(avg(tokens), 6) AS avg_tokens, round(stddev_pop(tokens), 6) AS std_tokens,
  round(coalesce(avg(tokens) FILTER (reward > 0), 0), 6) AS avg_tokens_rewarded, round(coalesce(avg(tokens) FILTER (reward = 0), 0), 6) AS avg_tokens_unrewarded FROM rollouts GROUP BY stop""")
def _(t):
    out = R.rollout_token_stats(rollouts(t), "tokens", "reward", ["stop"])
    return out.select("stop", "min_tokens", "max_tokens", *[r6(c) for c in out.columns if c.startswith(("avg", "std"))])


@query("zero_and_mask", "A13", f"""WITH {TOKEN_CTE} SELECT uid, sample, round(CASE WHEN stop = 'stop' THEN reward ELSE 0 END, 6) AS reward,
  array_to_string(CASE WHEN ids[3] = 4 THEN mask ELSE [0, 0, 0] END, ',') AS mask FROM tr""")
def _(t):
    return token_rollouts(t).select("uid", "sample", F.round(R.zero_if_not_stop("reward", "stop"), 6).alias("reward"),
                                    F.array_join(R.mask_overlong(F.col("mask"), F.col("ids"), 4), ",").alias("mask"))


VARIED = f"{ROLLOUT_CTE}, v AS (SELECT uid, min(reward) < max(reward) AS good FROM rollouts GROUP BY uid)"


@query("filter_uniform_groups", "A14", f"WITH {VARIED} SELECT uid, sample, round(reward, 6) AS reward FROM rollouts JOIN v USING (uid) WHERE good ORDER BY uid, sample LIMIT 2000")
def _(t):
    return (R.filter_uniform_groups(rollouts(t), "uid", "sample", "reward", ["uid", "sample"], 4, 500).select("uid", "sample", r6("reward")))


@query("replace_uniform_groups", "A15", f"""WITH {VARIED}, gr AS (SELECT uid, row_number() OVER (ORDER BY sha256('5' || chr(31) || uid)) AS i FROM v WHERE good),
  br AS (SELECT uid AS slot, row_number() OVER (ORDER BY sha256('5' || chr(31) || uid)) AS i FROM v WHERE NOT good),
  c AS (SELECT count(*) FILTER (good) AS g, count(*) AS a FROM v),
  p AS (SELECT slot, gr.uid FROM br, c JOIN gr ON gr.i = CASE WHEN g >= a - g THEN br.i ELSE ('0x' || substr(sha256('6' || chr(31) || slot), 1, 12))::BIGINT % g + 1 END WHERE g > a * 0.3)
  SELECT r.uid, sample, r.uid AS slot, FALSE AS keep_sampling FROM rollouts r JOIN v ON v.uid = r.uid AND good UNION ALL SELECT p.uid, sample, slot, FALSE FROM p JOIN rollouts r ON r.uid = p.uid""")
def _(t):
    return R.replace_uniform_groups(rollouts(t), "uid", "sample", "reward", 4, 0.3, 5).select("uid", "sample", "slot", "keep_sampling")


@query("replace_uniform_groups_too_few", "A15", f"WITH {ROLLOUT_CTE} SELECT uid, sample, uid AS slot, TRUE AS keep_sampling FROM rollouts")
def _(t):
    return R.replace_uniform_groups(rollouts(t), "uid", "sample", "reward", 4, 0.99, 5).select("uid", "sample", "slot", "keep_sampling")


BROKEN = dict(ids="CASE WHEN sample % 7 = 1 THEN slice(ids, 1, 2) WHEN sample % 31 = 2 THEN slice(ids, 1, 0) ELSE ids END", mask="mask", rw="rewards",
              lp="CASE WHEN sample % 5 = 0 THEN NULL WHEN sample % 11 = 3 THEN slice(logp, 1, 1) ELSE logp END")


@query("validate_rollouts", "A16", f"""WITH {TOKEN_CTE}, b AS (SELECT CASE WHEN sample % 7 = 1 THEN 2 WHEN sample % 31 = 2 THEN 0 ELSE 3 END AS n,
   CASE WHEN sample % 5 = 0 THEN NULL WHEN sample % 11 = 3 THEN 1 ELSE 3 END AS lp FROM tr),
  e AS (SELECT unnest(list_filter([CASE WHEN n = 0 THEN 'empty_response' END, CASE WHEN n <> 3 THEN 'mask_length' END, CASE WHEN n <> 3 THEN 'reward_length' END,
   CASE WHEN lp <> n THEN 'logprob_length' END, CASE WHEN n = 3 AND coalesce(lp, n) = n THEN 'valid' END], lambda x: x IS NOT NULL)) AS kind FROM b)
  SELECT kind, count(*) AS n FROM e GROUP BY kind""")
def _(t):
    return R.validate_rollouts(select(token_rollouts(t), **BROKEN), ids="ids", mask="mask", token_rewards="rw", logp="lp")


@query("reward_function_stats", "A17", f"""WITH {REW_CTE}, x AS (SELECT uid, coalesce(a, 0) * 0.7 + coalesce(b, 0) * 0.3 AS r FROM w), g AS (SELECT stddev_samp(r) AS s, sum(r) AS t, count(*) AS n FROM x GROUP BY uid)
  SELECT 'a' AS name, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS std FROM w UNION ALL SELECT 'b', round(avg(b), 6), round(stddev_samp(b), 6) FROM w
  UNION ALL SELECT 'total', round(sum(t) / sum(n), 6), round(avg(s), 6) FROM g""")
def _(t):
    return R.reward_function_stats(select(rollouts(t), **REW), "uid", ["a", "b"], {"a": 0.7, "b": 0.3}).select("name", r6("mean"), r6("std"))


@query("completion_stats", "A17", f"WITH {REW_CTE} SELECT round(avg(tokens), 6) AS mean_length, min(tokens) AS min_length, max(tokens) AS max_length, round(avg(CASE WHEN stop = 'length' THEN 1.0 ELSE 0.0 END), 6) AS clipped_ratio FROM w")
def _(t):
    out = R.completion_stats(rollouts(t), "tokens", F.col("stop") == "length")
    return out.select(r6("mean_length"), "min_length", "max_length", r6("clipped_ratio"))


BEST = dict(uid="uid", sample="sample", orm="CASE WHEN reward > 0.3E0 THEN 1E0 ELSE 0E0 END", prm="tokens * 0.02E0")


@query("best_of_n", "A18", f"""WITH {ROLLOUT_CTE}, b AS (SELECT {', '.join(f'{v} AS {k}' for k, v in BEST.items())} FROM rollouts),
  s AS (SELECT *, orm > 0 AND prm > 0.3 AS ok, min(orm) OVER u AS ol, max(orm) OVER u AS oh, min(prm) OVER u AS pl, max(prm) OVER u AS ph FROM b WINDOW u AS (PARTITION BY uid)),
  n AS (SELECT *, CASE WHEN ol = oh THEN CASE WHEN ol = 0 THEN 0 ELSE least(1.0, ol) END ELSE (orm - ol) / (oh - ol + 1e-5) END AS o,
    CASE WHEN pl = ph THEN CASE WHEN pl = 0 THEN 0 ELSE least(1.0, pl) END ELSE (prm - pl) / (ph - pl + 1e-5) END AS p FROM s),
  k AS (SELECT *, p + o * 10 AS score, row_number() OVER (PARTITION BY uid ORDER BY p + o * 10 DESC, sample) AS rk, bool_or(ok) OVER (PARTITION BY uid) AS any_ok,
    count(*) FILTER (o > 0) OVER (PARTITION BY uid) AS solved, last_value(sample) OVER (PARTITION BY uid ORDER BY p + o * 10 DESC, sample ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rejected FROM n)
  SELECT uid, sample AS chosen, rejected, round(score, 6) AS score, CAST(rk AS INT) AS rank FROM k WHERE any_ok AND ok AND rk <= 2 AND solved - 1 < 3""")
def _(t):
    out = R.best_of_n(select(rollouts(t), **BEST), "uid", "sample", "orm", "prm", 2, 0.3, 0.75, 4)
    return out.select("uid", "chosen", "rejected", r6("score"), "rank")


TASK_TOKENS = 1_000_000
LONG = """WITH RECURSIVE l AS (SELECT l_suppkey AS uid, l_discount * 10 AS r, l_tax * 5 AS v, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE 1 END AS m,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS back FROM lineitem),
  w AS (SELECT uid, back, m, v, r AS ret, r - v AS adv FROM l WHERE back = 1
    UNION ALL SELECT l.uid, l.back, l.m, l.v, l.r + 0.9 * w.ret * w.m, l.r + 0.9 * w.v - l.v + 0.9 * 0.8 * w.adv FROM l JOIN w ON l.uid = w.uid AND l.back = w.back + 1)
  SELECT uid, count(*) AS n, round(sum(ret), 4) AS returns, round(sum(ret * back) / count(*), 4) AS weighted, round(sum(adv), 4) AS advantages, round(sum(adv * back) / count(*), 4) AS weighted_advantages FROM w GROUP BY uid"""


@query("long_token_recursions", "A4 A5", LONG)
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("uid"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 5).alias("v"),
                                                                       F.when(F.col("l_linenumber") % 5 == 0, 0).otherwise(1).alias("m")).alias("x"))
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_TOKENS))  # a batch that Python gets holds a task's lists at most
    lists = rows.repartition(tasks, "uid").groupBy("uid").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a supplier's lines, as one long response
    out = lists.select("uid", F.col("x.r").alias("r"), R.discounted_returns(F.col("x.r"), F.col("x.m"), 0.9).alias("ret"), R.gae_advantages(F.col("x.r"), F.col("x.v"), 0.9, 0.8).alias("adv"))
    both = out.select("uid", F.posexplode(F.arrays_zip("ret", "adv")).alias("at", "y"), F.size("r").alias("n"))
    back = F.col("n") - F.col("at")
    return both.groupBy("uid").agg(F.count("*").alias("n"), F.round(F.sum("y.ret"), 4).alias("returns"), F.round(F.sum(F.col("y.ret") * back) / F.count("*"), 4).alias("weighted"),
                                   F.round(F.sum("y.adv"), 4).alias("advantages"), F.round(F.sum(F.col("y.adv") * back) / F.count("*"), 4).alias("weighted_advantages"))


TREE = dict(tree_id="doc_id % 20", node_id="CAST(floor(doc_id / 20) AS BIGINT)",
            parent_id="CASE WHEN doc_id < 20 THEN NULL ELSE CAST(floor((floor(doc_id / 20) - 1) / 2) AS BIGINT) END",
            outcome_reward="(n_chars % 10) / 10E0", process_reward="(n_chars % 7) / 10E0", step_text="lang",
            terminated="n_chars % 3 = 0", correct="n_chars % 2 = 0")
TREE_CTE = "nodes AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in TREE.items()) + " FROM documents)"


@query("tree_preferences", "A19", f"""WITH {TREE_CTE}, k AS (SELECT *, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY outcome_reward DESC, node_id DESC) AS hi,
   row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY outcome_reward, node_id) AS lo FROM nodes WHERE parent_id IS NOT NULL)
  SELECT g.tree_id, g.parent_id AS node_id, g.node_id AS good, g.outcome_reward AS good_score, b.node_id AS bad, b.outcome_reward AS bad_score
  FROM k g JOIN k b ON g.tree_id = b.tree_id AND g.parent_id = b.parent_id AND g.hi = 1 AND b.lo = 1 WHERE g.outcome_reward - b.outcome_reward > 0.25""")
def _(t):
    return R.tree_preferences(select(t.documents, **TREE), 0.25)


@query("tree_path_scores", "A19", f"""WITH RECURSIVE {TREE_CTE}, w AS (SELECT tree_id, node_id, terminated, correct, 1 AS depth, outcome_reward AS so, outcome_reward AS mo, process_reward AS sp, process_reward AS mp FROM nodes WHERE parent_id IS NULL
   UNION ALL SELECT n.tree_id, n.node_id, n.terminated, n.correct, depth + 1, so + outcome_reward, least(mo, outcome_reward), sp + process_reward, least(mp, process_reward)
   FROM w JOIN nodes n ON n.tree_id = w.tree_id AND n.parent_id = w.node_id)
  SELECT tree_id, node_id, correct, depth, round(so / depth, 6) AS mean_outcome, mo AS min_outcome, round(sp / depth, 6) AS mean_process, mp AS min_process FROM w WHERE terminated""")
def _(t):
    out = R.tree_path_scores(select(t.documents, **TREE))
    return out.select("tree_id", "node_id", "correct", "depth", r6("mean_outcome"), "min_outcome", r6("mean_process"), "min_process")


CHAIN = {**TREE, "tree_id": "CAST(floor(doc_id / 150) AS BIGINT)", "node_id": "doc_id", "parent_id": "CASE WHEN doc_id % 150 = 0 THEN NULL ELSE doc_id - 1 END"}


@query("tree_path_chain", "A19", "WITH nodes AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CHAIN.items()) + """ FROM documents),
  w AS (SELECT *, count(*) OVER p AS depth, avg(outcome_reward) OVER p AS so, min(outcome_reward) OVER p AS mo, avg(process_reward) OVER p AS sp, min(process_reward) OVER p AS mp
    FROM nodes WINDOW p AS (PARTITION BY tree_id ORDER BY node_id))
  SELECT tree_id, node_id, correct, CAST(depth AS INT) AS depth, round(so, 6) AS mean_outcome, mo AS min_outcome, round(sp, 6) AS mean_process, mp AS min_process FROM w WHERE terminated""")
def _(t):
    out = R.tree_path_scores(select(t.documents, **CHAIN))
    return out.select("tree_id", "node_id", "correct", "depth", r6("mean_outcome"), "min_outcome", r6("mean_process"), "min_process")


@query("message_digest", "A20", "SELECT conv_id, turn, md5('{\"conv_id\":' || conv_id || ',\"role\":\"' || role || '\",\"turn\":' || turn || '}') AS digest FROM conversations")
def _(t):
    rows = t.conversations.withColumn("choices", F.lit("x")).drop("text")
    return rows.select("conv_id", "turn", R.message_digest(rows).alias("digest"))


@query("complete_choices", "J8", f"""WITH {ROLLOUT_CTE}, r AS (SELECT uid, sample, row_number() OVER (PARTITION BY uid ORDER BY sample) AS i FROM rollouts),
  c AS (SELECT uid, string_agg(sample::VARCHAR, ',' ORDER BY sample) AS choices, count(*) AS n FROM r WHERE i <= 4 GROUP BY uid)
  SELECT o_orderkey AS uid, choices FROM orders LEFT JOIN c ON uid = o_orderkey AND n = 4""")
def _(t):
    cache = R.complete_choices(rollouts(t), "uid", "sample", 4).select("uid", F.array_join(F.transform("choices", lambda c: c.cast("string")), ",").alias("choices"))
    return t.orders.select(F.col("o_orderkey").alias("uid")).join(cache, "uid", "left")
