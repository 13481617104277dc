"""Rollout groups: weighted rewards, advantages, group filters, preference pairs, diagnostics.

A rollout table has ``uid`` (the prompt), ``sample`` (the try, unique inside a uid) and a reward; token-level operators
work on parallel arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from .sample import hash_rank, seeded_hash
from .scale import cut, numbered, skew_join, top_k, with_group_stats

FLOATS = "array<double>"
SLICE_TOKENS = 1 << 20  # tokens that a recursion takes at once


def weighted_reward(weights: dict[str, float]) -> Column:
    """Weighted sum that ignores missing (null or NaN) rewards; 0 when all are missing."""
    parts = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) * w for c, w in weights.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def all_missing(cols: list[str]) -> Column:
    flag = F.lit(True)
    for c in cols:
        flag = flag & (F.col(c).isNull() | F.isnan(F.col(c).cast("double")))
    return flag


def _grouped(df: DataFrame, uid: str, sample: str, score: str, **kw) -> DataFrame:
    return with_group_stats(df, [uid], [F.avg(score).alias("_mean"), F.stddev_samp(score).alias("_std")], spread=[sample], **kw)


def grpo_advantage(df: DataFrame, uid: str, sample: str, score: str, eps: float = 1e-6, norm_by_std: bool = True,
                   singleton: str = "raw", **kw) -> DataFrame:
    """(score - group mean) / (sample deviation + eps).

    A group of one keeps its score over (1 + eps) with ``raw``, gives 0 with ``zero`` and null with ``null``.
    """
    one = {"raw": F.col(score) / (1.0 + eps) if norm_by_std else F.col(score), "zero": F.lit(0.0),
           "null": F.lit(None).cast("double")}[singleton]
    diff = F.col(score) - F.col("_mean")
    many = diff / (F.col("_std") + eps) if norm_by_std else diff
    return (_grouped(df, uid, sample, score, **kw).withColumn("advantage", F.when(F.col("_rows") == 1, one).otherwise(many))
            .drop("_rows", "_mean", "_std"))


def rloo_advantage(df: DataFrame, uid: str, sample: str, score: str, **kw) -> DataFrame:
    """(score - mean) * n / (n - 1): the distance to the mean of the other tries; 0 for a group of one."""
    n = F.col("_rows")
    return (_grouped(df, uid, sample, score, **kw)
            .withColumn("advantage", F.when(n == 1, 0.0).otherwise((F.col(score) - F.col("_mean")) * n / (n - 1)))
            .drop("_rows", "_mean", "_std"))


def token_group_advantage(df: DataFrame, uid: str, sample: str, rewards: str, mask: str, kind: str = "grpo", **kw) -> DataFrame:
    """Group advantages of token-level rewards: adds ``score``, the sum of a response's token rewards, and ``advantages``, the response's advantage at every token of its mask and
    0 elsewhere.  The returns are the same numbers.  ``kind`` is ``grpo`` or ``rloo``; further arguments are those of the scalar form.
    """
    total = F.aggregate(F.coalesce(rewards, F.array().cast(FLOATS)), F.lit(0.0), lambda s, r: s + F.coalesce(r.cast("double"), F.lit(0.0)))
    scalar = {"grpo": grpo_advantage, "rloo": rloo_advantage}[kind](df.withColumn("score", total), uid, sample, "score", **kw)
    return scalar.withColumn("advantages", F.transform(mask, lambda m: F.col("advantage") * m)).drop("advantage")


def _backward(lengths: np.ndarray, step) -> None:
    """Call ``step(places, rows)`` for the last tokens of all rows, then those before them, and so on.

    Rows are taken longest first, so the rows that still have a token are a prefix; the work is the number of tokens, in one array step for each
    token of the longest row.  ``rows`` counts in that order.
    """
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths)[order]
    open_ = len(order) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), "right")
    for back, n in enumerate(open_):
        step(ends[:n] - 1 - back, n)


def _by_slices(step_of, *lists: pa.Array) -> pa.Array:
    """Lists of numbers from lists of numbers, some rows at a time, so that the work space is that of ``SLICE_TOKENS`` or of the longest row.

    ``step_of`` gets the tokens of each list on end, the rows' lengths and the output, and fills it.  A row with a list that is null is null; a shorter list is filled up with NaN.
    """
    lengths = [pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    good = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in lists])
    longest = np.where(good, np.maximum.reduce(lengths), 0)
    ends = np.cumsum(longest)
    out = np.zeros(int(ends[-1]) if len(ends) else 0)
    low = 0
    while low < len(good):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
        n = longest[low:high]
        tokens = []
        for x, have in zip(lists, lengths):
            flat = x.slice(low, high - low).flatten().to_numpy(zero_copy_only=False)
            have = have[low:high]
            if not np.array_equal(have, n):
                filled = np.full(int(n.sum()), np.nan)
                take = np.where(good[low:high], have, 0)
                place = lambda first, n=take: np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
                filled[place(np.cumsum(n) - n)] = flat[place(np.cumsum(have) - have)]
                flat = filled
            tokens.append(flat)
        step_of(n, out[before:int(ends[high - 1])], *tokens)
        low = high
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(out, from_pandas=True), mask=pa.array(~good))  # NaN is null


@F.arrow_udf(ArrayType(DoubleType()))
def _returns(rewards: pa.Array, mask: pa.Array, gamma: pa.Array) -> pa.Array:
    g = gamma[0].as_py() if len(gamma) else 0.0

    def fill(lengths, out, r, m):
        run = np.zeros(len(lengths))

        def step(at, n):
            out[at] = r[at] + g * run[:n]
            run[:n] = out[at] * m[at]

        _backward(lengths, step)

    return _by_slices(fill, rewards, mask)


@F.arrow_udf(ArrayType(DoubleType()))
def _gae(rewards: pa.Array, values: pa.Array, gamma: pa.Array, lam: pa.Array) -> pa.Array:
    g, keep = (gamma[0].as_py(), gamma[0].as_py() * lam[0].as_py()) if len(gamma) else (0.0, 0.0)

    def fill(lengths, out, r, v):
        run, after = np.zeros(len(lengths)), np.zeros(len(lengths))

        def step(at, n):
            out[at] = run[:n] = r[at] + g * after[:n] - v[at] + keep * run[:n]
            after[:n] = v[at]

        _backward(lengths, step)

    return _by_slices(fill, rewards, values)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Returns from the end to the start; the running value is dropped behind a masked token.  Linear in the number of tokens."""
    return _returns(rewards.cast(FLOATS), mask.cast(FLOATS), F.lit(float(gamma)))


def gae_advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening.  Linear in the number of tokens."""
    return _gae(rewards.cast(FLOATS), values.cast(FLOATS), F.lit(float(gamma)), F.lit(float(lam)))


def masked_stats(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: count, mean, sample and population variance over the unmasked tokens, and the mean over all tokens."""
    tokens = df.select(F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("t")).select("t.v", "t.m")
    kept = F.when(F.col("m") != 0, F.col("v"))
    return tokens.agg(F.count(kept).alias("_n"), F.avg(kept).alias("_mu"), F.var_samp(kept).alias("_var"),
                      F.var_pop(kept).alias("_vpop"), F.avg("v").alias("_all"))


def whiten(df: DataFrame, values: str, mask: str, shift_mean: bool = True, out: str | None = None) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) with moments over the unmasked tokens of the whole table (Bessel-corrected)."""
    stats = F.broadcast(masked_stats(df, values, mask))  # one row
    scale = F.sqrt(F.col("_var") + 1e-8)
    white = F.transform(F.col(values), lambda v: (v - F.col("_mu")) / scale + (F.lit(0.0) if shift_mean else F.col("_mu")))
    return df.crossJoin(stats).withColumn(out or values, white).drop("_n", "_mu", "_var", "_vpop", "_all")


def normalize_advantages(df: DataFrame, values: str, mask: str, out: str | None = None) -> DataFrame:
    """Centre on the mean over all tokens; divide by the root of the masked mean square (at least 1e-8)."""
    stats = F.broadcast(masked_stats(df, values, mask))  # one row
    spread = F.col("_vpop") + F.pow(F.col("_mu") - F.col("_all"), 2)
    white = F.transform(F.col(values), lambda v: (v - F.col("_all")) / F.sqrt(F.greatest(spread, F.lit(1e-8))))
    return df.crossJoin(stats).withColumn(out or values, white).drop("_n", "_mu", "_var", "_vpop", "_all")


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def reinforce_pp_advantage(df: DataFrame, rewards: str, mask: str, gamma: float) -> DataFrame:
    rows = df.withColumn("returns", discounted_returns(F.col(rewards), F.col(mask), gamma))
    return whiten(rows, "returns", mask, out="advantages").withColumn("advantages", times(F.col("advantages"), F.col(mask)))


def gae(df: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    rows = df.withColumn("advantages", gae_advantages(F.col(rewards), F.col(values), gamma, lam))
    rows = rows.withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))
    return whiten(rows, "advantages", mask)


def approx_kl(logp: Column, base: Column, mask: Column | None = None, kind: str = "k3") -> Column:
    """Per-token divergence estimates: k1, abs, k2 or k3 (its exponent clamped to 20, its value to 10)."""
    def one(p, q):
        d = p - q
        if kind == "k1":
            return d
        if kind == "abs":
            return F.abs(d)
        if kind == "k2":
            return d * d * 0.5
        r = T.clip(-d, -20.0, 20.0)
        return T.clip(F.exp(r) - r - 1, -10.0, 10.0)

    kl = F.zip_with(logp, base, one)
    return times(kl, mask) if mask is not None else kl


def masked_row_mean(values: Column, mask: Column) -> Column:
    return T.total(times(values, mask)) / F.greatest(T.total(mask), F.lit(1.0))


def kl_penalty(df: DataFrame, rewards: str, logp: str, base: str, mask: str, coef: float, kind: str = "k3") -> DataFrame:
    """Rewards minus coef * KL, with the mean and the largest absolute KL of each row."""
    rows = df.withColumn("kl", approx_kl(F.col(logp), F.col(base), F.col(mask), kind))
    return (rows.withColumn("kl_mean", masked_row_mean(F.col("kl"), F.col(mask)))
            .withColumn("kl_max", F.array_max(F.transform("kl", F.abs)))
            .withColumn("penalised", F.zip_with(rewards, "kl", lambda r, k: r - k * max(0.0, coef))))


def policy_loss_terms(df: DataFrame, logp: str, old: str, adv: str, mask: str, kind: str = "regular", low: float = 0.2,
                      high: float = 0.2, dual: float = 3.0, rollout_logp: str | None = None, cap: float = 2.0) -> DataFrame:
    """Per row: masked loss sum, clipped tokens, unmasked tokens.  ``kind`` is regular, dual_clip or gspo.

    With ``rollout_logp`` each token's loss is weighted by the truncated ratio of old to rollout probability.
    """
    lp, op, a, m = F.col(logp), F.col(old), F.col(adv), F.col(mask)
    if kind == "gspo":
        level = F.least(masked_row_mean(F.zip_with(lp, op, lambda x, y: x - y), m), F.lit(10.0))
        ratio = F.transform(lp, lambda _: F.exp(level))
    else:
        ratio = F.zip_with(lp, op, lambda x, y: F.exp(x - y))
    rows = df.withColumn("_ratio", ratio).withColumn("_t", F.arrays_zip(F.col("_ratio").alias("r"), a.alias("a")))
    bounded = F.transform("_t", lambda t: T.clip(t["r"], 1 - low, 1 + high) * t["a"])
    plain = F.transform("_t", lambda t: t["r"] * t["a"])
    rows = rows.withColumn("_s1", plain).withColumn("_s2", bounded)
    loss = F.zip_with("_s1", "_s2", lambda x, y: -F.least(x, y))
    if kind == "dual_clip":
        loss = F.zip_with(loss, a, lambda l, g: F.when(g < 0, F.least(l, -g * dual)).otherwise(l))
    if rollout_logp:
        loss = times(loss, F.zip_with(op, F.col(rollout_logp), lambda x, y: F.least(F.exp(x - y), F.lit(cap))))
    clipped = F.zip_with("_s1", "_s2", lambda x, y: (-y > -x).cast("double"))
    return (rows.withColumn("loss_sum", T.total(times(loss, m))).withColumn("clipped", T.total(times(clipped, m)))
            .withColumn("n_tokens", T.total(m)).drop("_ratio", "_t", "_s1", "_s2"))


def reduce_loss(terms: DataFrame, max_seq_len: int, by: list[str] | None = None) -> DataFrame:
    """The three reductions and the clip fraction, from the per-row terms in one pass."""
    n = F.greatest(F.sum("n_tokens"), F.lit(1.0))
    return terms.groupBy(*(by or [])).agg(
        (F.sum("loss_sum") / n).alias("token_mean"),
        F.avg(F.col("loss_sum") / F.greatest("n_tokens", F.lit(1.0))).alias("sequence_mean"),
        F.avg(F.col("loss_sum") / max_seq_len).alias("seq_mean_token_sum_norm"),
        (F.sum("clipped") / n).alias("clip_ratio"))


def rewards_to_tokens(reward: Column, ids: Column) -> Column:
    """The scalar reward on the last token, zeros before."""
    return F.when(F.size(ids) > 0, F.concat(F.array_repeat(F.lit(0.0), F.size(ids) - 1), F.array(reward.cast("double"))))


def rollout_score(df: DataFrame, uid: str, reward: str, by: list[str] | None = None) -> DataFrame:
    """Mean reward and the share of prompts whose rewards add up to more than 0."""
    per = df.groupBy(*(by or []), uid).agg(F.sum(reward).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*(by or [])).agg((F.sum("_s") / F.sum("_n")).alias("avg_score"),
                                        F.avg((F.col("_s") > 0).cast("double")).alias("pass_at_n"))


def source_label(c) -> Column:
    """Missing sources are 'unknown'; slashes do not survive in names."""
    return F.replace(F.coalesce(T.col(c), F.lit("unknown")), F.lit("/"), F.lit("_"))


def per_source_metrics(df: DataFrame, uid: str, reward: str, source: str, overall: bool = False) -> DataFrame:
    rows = df.withColumn("_src", F.coalesce(F.col(source), F.lit("unknown")))
    out = rollout_score(rows, uid, reward, ["_src"]).withColumn("source", source_label("_src")).drop("_src")
    if overall:
        out = out.unionByName(rollout_score(df, uid, reward).withColumn("source", F.lit("all")))
    return out


def rollout_token_stats(df: DataFrame, tokens: str, reward: str, by: list[str] | None = None) -> DataFrame:
    n = F.col(tokens)
    return df.groupBy(*(by or [])).agg(
        F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(n).alias("avg_tokens"), F.stddev_pop(n).alias("std_tokens"),
        F.coalesce(F.avg(F.when(F.col(reward) > 0, n)), F.lit(0.0)).alias("avg_tokens_rewarded"),
        F.coalesce(F.avg(F.when(F.col(reward) == 0, n)), F.lit(0.0)).alias("avg_tokens_unrewarded"))


def zero_if_not_stop(reward: str, stop: str) -> Column:
    return F.when(F.col(stop) == "stop", F.col(reward)).otherwise(F.lit(0.0))


def mask_overlong(mask: Column, ids: Column, eos: int) -> Column:
    """All zeros unless the response ends with the end-of-sequence id."""
    done = F.coalesce(F.get(ids, F.size(ids) - 1) == eos, F.lit(False))
    return F.when(done, mask).otherwise(F.transform(mask, lambda m: m * 0))


def _spread(df: DataFrame, uid: str, sample: str, reward: str, n_samples: int) -> DataFrame:
    lone = F.lit(n_samples == 1)
    return (with_group_stats(df, [uid], [F.min(reward).alias("_lo"), F.max(reward).alias("_hi")], spread=[sample])
            .withColumn("_good", lone | (F.col("_lo") < F.col("_hi"))).drop("_lo", "_hi", "_rows"))


def filter_uniform_groups(df: DataFrame, uid: str, sample: str, reward: str, order: list[str], n_samples: int,
                          target: int | None = None) -> DataFrame:
    """Groups whose rewards are all equal are dropped; then the first target * n_samples rows in order."""
    kept = _spread(df, uid, sample, reward, n_samples).filter("_good").drop("_good")
    if target is None:
        return kept
    rows = target * n_samples
    return numbered(kept, order, name="_p").filter(F.col("_p") < rows).drop("_p")


def replace_uniform_groups(df: DataFrame, uid: str, sample: str, reward: str, n_samples: int, min_ratio: float,
                           seed: int) -> DataFrame:
    """Each uniform group becomes a copy of a varied one when varied groups exceed ``min_ratio`` of all.

    Replacements are drawn without repeats while there are enough varied groups.  Adds ``slot`` (the uid whose place the
    row takes) and ``keep_sampling`` (true when there were too few varied groups and nothing was replaced).
    """
    groups = (df.groupBy(F.col(uid).alias("_u")).agg(F.min(reward).alias("_lo"), F.max(reward).alias("_hi"))
              .withColumn("_good", F.lit(n_samples == 1) | (F.col("_lo") < F.col("_hi"))).select("_u", "_good"))
    tally = groups.agg(F.count_if("_good").alias("_ng"), F.count(F.lit(1)).alias("_all"))
    good = hash_rank(groups.filter("_good"), ["_u"], seed, "_gr").select(F.col("_u").alias("_from"), "_gr")
    bad = hash_rank(groups.filter("NOT _good"), ["_u"], seed, "_br").crossJoin(F.broadcast(tally))  # one-row side
    enough = F.col("_ng") > F.col("_all") * min_ratio
    draw = F.pmod(F.conv(F.substring(seeded_hash(["_u"], seed + 1), 1, 12), 16, 10).cast("long"), F.col("_ng")) + 1
    want = F.when(F.col("_ng") >= F.col("_all") - F.col("_ng"), F.col("_br")).otherwise(draw)
    pairs = bad.filter(enough).withColumn("_want", want).join(good, F.col("_want") == F.col("_gr")).select("_from", F.col("_u").alias("_slot"))
    marks = groups.crossJoin(F.broadcast(tally)).select("_u", (F.col("_good") | ~enough).alias("_stay"), (~enough).alias("keep_sampling"))
    stay = (skew_join(df, marks, [(uid, "_u")], [uid, sample]).filter("_stay").drop("_u", "_stay")
            .withColumn("slot", F.col(uid)))
    copies = (skew_join(df, pairs, [(uid, "_from")], [uid, sample]).drop("_from").withColumnRenamed("_slot", "slot")
              .withColumn("keep_sampling", F.lit(False)))
    return stay.unionByName(copies)


def rollout_errors(ids: str, mask: str, token_rewards: str | None = None, logp: str | None = None) -> Column:
    """Kinds of shape errors of one row."""
    n = F.size(ids)
    kinds = [("empty_response", n <= 0), ("mask_length", F.size(mask) != n)]
    if token_rewards:
        kinds.append(("reward_length", F.col(token_rewards).isNotNull() & (F.size(token_rewards) != n)))
    if logp:
        kinds.append(("logprob_length", F.col(logp).isNotNull() & (F.size(logp) != n)))
    kinds.append(("all_masked", ~F.exists(mask, lambda m: m != 0)))
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in kinds]))


def validate_rollouts(df: DataFrame, **cols) -> DataFrame:
    """Error counts over all rows plus the number of rows without an error."""
    rows = df.select(rollout_errors(**cols).alias("e"))
    return rows.select(F.explode(F.when(F.size("e") == 0, F.array(F.lit("valid"))).otherwise(F.col("e"))).alias("kind")) \
        .groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def reward_function_stats(df: DataFrame, uid: str, rewards: list[str], weights: dict[str, float]) -> DataFrame:
    """Mean and deviation per reward function over the rows where it applied, then of the weighted total, whose
    deviation is the mean of the deviations inside groups."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in rewards]).unpivot([], rewards, "name", "v")
    per = (long.groupBy("name").agg(F.avg(F.nanvl("v", F.lit(None))).alias("mean"), F.stddev_samp(F.nanvl("v", F.lit(None))).alias("std")))
    groups = (df.withColumn("_r", weighted_reward(weights)).groupBy(uid)
              .agg(F.stddev_samp("_r").alias("_s"), F.sum("_r").alias("_t"), F.count(F.lit(1)).alias("_n")))
    total = groups.agg((F.sum("_t") / F.sum("_n")).alias("mean"), F.avg("_s").alias("std")).withColumn("name", F.lit("total"))
    return per.unionByName(total)


def completion_stats(df: DataFrame, length: str, truncated: Column) -> DataFrame:
    return df.agg(F.avg(length).alias("mean_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"),
                  F.avg(truncated.cast("double")).alias("clipped_ratio"))


def _min_max(c: str, lo: str, hi: str) -> Column:
    same = F.when(F.col(lo) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col(lo)))
    return F.when(F.col(lo) == F.col(hi), same).otherwise((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo) + 1e-5))


def best_of_n(df: DataFrame, uid: str, sample: str, outcome: str, process: str, k: int, process_threshold: float,
              easy_share: float | None = None, n_return: int | None = None) -> DataFrame:
    """The k best tries of each prompt, each paired with the worst one as rejected.

    The score is process + 10 * outcome, both min-max normalised per prompt.  Tries must pass both thresholds (outcome
    above 0); prompts without such a try, and with ``easy_share`` those solved too often, give nothing.  The reference
    answer is one of the tries.  Ties go to the smaller sample.
    """
    rows = df.withColumn("_ok", (F.col(outcome) > 0) & (F.col(process) > process_threshold))
    rows = with_group_stats(rows, [uid], [F.min(outcome).alias("_ol"), F.max(outcome).alias("_oh"), F.min(process).alias("_pl"),
                                          F.max(process).alias("_ph"), F.max("_ok").alias("_any")], spread=[sample]).drop("_rows")
    rows = (rows.filter("_any").withColumn("_o", _min_max(outcome, "_ol", "_oh"))
            .withColumn("score", _min_max(process, "_pl", "_ph") + F.col("_o") * 10))
    worst = rows.groupBy(F.col(uid).alias("_wu")).agg(
        F.max_by(sample, F.struct(-F.col("score"), F.col(sample))).alias("rejected"), F.count_if(F.col("_o") > 0).alias("_solved"))
    best = top_k(rows, [uid], [F.desc("score"), F.col(sample)], k).filter("_ok")
    out = best.join(worst, best[uid] == worst["_wu"])
    if easy_share is not None:
        out = out.filter(F.col("_solved") - 1 < int(n_return * easy_share))
    return out.select(uid, F.col(sample).alias("chosen"), "rejected", "score", "rank")


def tree_preferences(nodes: DataFrame, threshold: float) -> DataFrame:
    """Best and worst child of every parent whose outcomes differ by more than ``threshold``.

    Among equal outcomes the later child is the best and the earlier one the worst.
    """
    kids = nodes.filter("parent_id IS NOT NULL")
    this = F.struct("node_id", "outcome_reward", "step_text")
    key = F.struct("outcome_reward", "node_id")
    pairs = kids.groupBy("tree_id", "parent_id").agg(F.max_by(this, key).alias("g"), F.min_by(this, key).alias("b"))
    return (pairs.filter(F.col("g.outcome_reward") - F.col("b.outcome_reward") > threshold)
            .select("tree_id", F.col("parent_id").alias("node_id"), F.col("g.node_id").alias("good"),
                    F.col("g.outcome_reward").alias("good_score"), F.col("b.node_id").alias("bad"),
                    F.col("b.outcome_reward").alias("bad_score")))


def tree_path_scores(nodes: DataFrame) -> DataFrame:
    """Mean and minimum of the outcome and process rewards on the path from the root to each terminal leaf.

    Paths grow by doubling: each round joins a partial path to the one that ends at its upper end, so trees of depth d
    need log2(d) joins, whatever the number of trees.  A cycle, or a parent that is not there, fails the query.
    """
    path = nodes.select("tree_id", "node_id", F.col("parent_id").alias("up"), F.lit(1).alias("len"), *[
        F.col(c).alias(f"{f}_{c[0]}") for c in ("outcome_reward", "process_reward") for f in ("sum", "min")])
    total, rounds = nodes.count(), 0
    while True:
        path = cut(path)  # both sides of the next join read the same stored rows; the plan stays one round deep
        if path.filter("up IS NOT NULL").isEmpty():
            break
        if 1 << rounds > total:  # a path of that many nodes passes one of them twice
            raise ValueError("the nodes of a tree form a cycle")
        rounds += 1
        side = path.select(*[F.col(c).alias(f"x_{c}") for c in path.columns])
        j = path.join(side, (path["tree_id"] == side["x_tree_id"]) & (path["up"] == side["x_node_id"]), "left")
        lost = F.col("up").isNotNull() & F.col("x_node_id").isNull()
        j = j.withColumn("len", F.when(lost, F.raise_error(F.lit("a node's parent is missing")).cast("int")).otherwise(F.col("len")))
        path = j.select("tree_id", "node_id", F.col("x_up").alias("up"), (F.col("len") + F.coalesce("x_len", F.lit(0))).alias("len"),
                        *[(F.col(f"sum_{k}") + F.coalesce(f"x_sum_{k}", F.lit(0.0))).alias(f"sum_{k}") for k in "op"],
                        *[F.least(f"min_{k}", f"x_min_{k}").alias(f"min_{k}") for k in "op"])
    leaf = nodes.filter("terminated").select("tree_id", "node_id", "correct")
    return leaf.join(path, ["tree_id", "node_id"]).select(
        "tree_id", "node_id", "correct", F.col("len").alias("depth"),
        (F.col("sum_o") / F.col("len")).alias("mean_outcome"), F.col("min_o").alias("min_outcome"),
        (F.col("sum_p") / F.col("len")).alias("mean_process"), F.col("min_p").alias("min_process"))


def message_digest(df: DataFrame, drop: tuple[str, ...] = ("choices",)) -> Column:
    """Stable id of a row: MD5 of its JSON with sorted columns, without the choices."""
    cols = sorted(c for c in df.columns if c not in drop)
    return F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def complete_choices(rows: DataFrame, key: str, choice: str, n: int) -> DataFrame:
    """Cached choices of each row, only where at least n of them are there.  A group holds n choices by construction."""
    top = top_k(rows.select(key, choice), [key], [F.col(choice)], n)
    return (top.groupBy(key).agg(F.array_sort(F.collect_list(choice)).alias("choices"))
            .filter(F.size("choices") == n))


ADVANTAGES = {"grpo": grpo_advantage, "rloo": rloo_advantage, "reinforce_pp": reinforce_pp_advantage, "gae": gae}
POLICY_LOSSES = ("regular", "dual_clip", "gspo")
