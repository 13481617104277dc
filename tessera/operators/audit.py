"""Corpus audit and repair: structure checks, exact de-duplication, evaluation-prompt exclusion, accounting.

A corpus is a DataFrame with ``source`` and ``row_id`` (together the row identity and its order) and ``messages``,
an array of (role, content).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scale import cut, flag_members, previous_row, ranked, running_total, top_k, with_group_stats

MESSAGES = "array<struct<role:string,content:string>>"
QUANTILES = (("p50", 0.50), ("p90", 0.90), ("p95", 0.95), ("p99", 0.99))
# Substrings that block generated code, per risk class, and those that only ask for a review.
RISK_TOKENS = {
    "sensitive_path": ("/proc", "/data", "/root", "/home", "/etc", "/var/run/secrets", ".ssh", "serviceaccount"),
    "network": ("socket", "requests", "urllib", "http.client", "ftplib", "paramiko"),
    "process": ("subprocess", "os.system", "os.popen", "import pty", "from pty", "fork(", "execv(", "spawn("),
    "destructive": ("rmtree(", "unlink(", "remove(", "removedirs(", "rmdir("),
}
REVIEW_TOKENS = ("eval(", "exec(", "compile(", "__import__(", "ctypes")


# ---- column checks

def pair_is_valid(messages: Column) -> Column:
    """Exactly one user turn then one assistant turn, both with visible content."""
    return F.coalesce(
        (F.size(messages) == 2)
        & (F.array_join(F.transform(messages, lambda m: m["role"]), ">", "?") == "user>assistant")
        & F.forall(messages, lambda m: F.coalesce(m["content"].rlike(T.VISIBLE), F.lit(False))), F.lit(False))


def turn(messages: Column, i: int) -> Column:
    return F.get(messages, F.lit(i))["content"]


def fence_is_open(answer: Column) -> Column:
    return T.count_of(answer, T.FENCE) % 2 == 1


def in_hash_fraction(digest: Column, fraction: float) -> Column:
    """First 32 bits of a hex digest fall under ``fraction`` of their range."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(fraction * 2 ** 32)


def first_failing(rules: list[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """Name of the first rule whose condition holds; a null condition does not fail."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules], F.lit(otherwise))


# ---- corpus operators

def check_schema(df: DataFrame) -> DataFrame:
    return df.withColumn("schema_ok", pair_is_valid(F.col("messages")))


def check_action_tags(df: DataFrame, answer: str, tags=T.ACTIONS) -> DataFrame:
    return (df.withColumn("_tk", T.tag_tokens(answer, tags))
            .withColumn("tag_sequence", T.tag_sequence(F.col("_tk")))
            .withColumn("tags_ok", T.tags_valid(F.col("_tk"))).drop("_tk"))


def tag_sequence_histogram(df: DataFrame, answer: str, n: int | None = None, tags=T.ACTIONS) -> DataFrame:
    """Tag sequences by how often they occur: all, or the ``n`` most frequent."""
    seq = T.tag_sequence(T.tag_tokens(answer, tags))
    label = F.when(F.size(seq) == 0, "<none>").otherwise(F.array_join(seq, "->"))
    counts = df.groupBy(label.alias("sequence")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sequence")
    return counts if n is None else counts.limit(n)


def tag_presence(df: DataFrame, answer: str, tags=T.ACTIONS) -> DataFrame:
    """Rows that open each action at least once; one pass, one output row per action."""
    seq = T.tag_sequence(T.tag_tokens(answer, tags))
    wide = df.select(seq.alias("seq")).agg(*[F.count_if(F.array_contains("seq", t)).alias(t) for t in tags])
    return wide.unpivot([], list(tags), "action", "n")


def check_token_fields(df: DataFrame, max_length: int, input_col="input_tokens", output_col="output_tokens",
                       total_col="total_tokens", by: list[str] | None = None) -> DataFrame:
    def good(c):
        v = F.col(c).try_cast("long")
        return F.when(v >= 0, v)

    i, o, t = good(input_col), good(output_col), good(total_col)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(i.isNull()).alias("invalid_input"), F.count_if(o.isNull()).alias("invalid_output"),
        F.count_if(t.isNull()).alias("invalid_total"),
        F.count_if(i + o != t).alias("sum_mismatch"), F.count_if(t > max_length).alias("over_limit"),
    ).withColumn("over_limit_rate", F.round(F.col("over_limit") / F.col("n_rows"), 6))


def check_code_fences(df: DataFrame, answer: str) -> DataFrame:
    return (df.withColumn("fence_open", fence_is_open(F.col(answer)))
            .withColumn("has_python_fence", F.lower(answer).contains(T.FENCE + "python")))


def check_line_repetition(df: DataFrame, answer: str, min_len: int = 30, k: int = 10) -> DataFrame:
    return (df.withColumn("line_copies", T.long_line_copies(answer, min_len))
            .withColumn("repetitive", F.col("line_copies") >= k))


def prompt_digest(c) -> Column:
    return F.sha2(T.squash(c), 256)


def flag_eval_prompts(df: DataFrame, prompt: str, bench: DataFrame, bench_prompt: str, flag: str = "is_eval_prompt") -> DataFrame:
    """Mark rows whose white-space-normalised prompt equals a benchmark prompt.  Only digests are joined."""
    keys = bench.select(prompt_digest(bench_prompt).alias("d"))
    return flag_members(df.withColumn("_pd", prompt_digest(prompt)), "_pd", keys, flag).drop("_pd")


def exclude_eval_prompts(df: DataFrame, prompt: str, bench: DataFrame, bench_prompt: str) -> DataFrame:
    return flag_eval_prompts(df, prompt, bench, bench_prompt, "_hit").filter(~F.col("_hit")).drop("_hit")


def first_copies(df: DataFrame, digest: Column, order: list[str]) -> DataFrame:
    """One row per digest: the columns of ``order`` of its first occurrence, and the number of copies.

    The minimum is combined map-side, so a text copied millions of times reaches the reducer as a few rows.
    """
    return (df.groupBy(digest.alias("digest"))
            .agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("copies"))
            .select("digest", *[F.col(f"_first.{c}").alias(c) for c in order], "copies"))


def later_copies(df: DataFrame, digest: Column, order: list[str], **kw) -> DataFrame:
    """Keys of the rows that repeat an earlier row.  Only digests and keys are exchanged; hot digests are salted."""
    slim = cut(df.select(digest.alias("_digest"), *order))  # the texts are read and hashed once
    first = with_group_stats(slim, ["_digest"], [F.min(F.struct(*order)).alias("_first")], spread=order, **kw)
    return first.filter(F.struct(*order) > F.col("_first")).select(*order)


def dedup_conversations(df: DataFrame, order: list[str], digest: Column | None = None, **kw) -> DataFrame:
    """Exact duplicates removed; the first occurrence under ``order`` stays.

    The rows to drop are looked up, not the rows to keep: where they are few, the session broadcasts them and the text is not shuffled.
    """
    digest = T.conversation_digest(F.col("messages")) if digest is None else digest
    return df.join(later_copies(df, digest, order, **kw), order, "left_anti")


def repair_reasons(df: DataFrame, bench: DataFrame, bench_prompt: str, tags=T.ACTIONS) -> DataFrame:
    """Checks in the order cheap to costly; adds ``digest`` and ``reason`` (null while the row is still a candidate)."""
    m = F.col("messages")
    rows = df.withColumn("_ok", pair_is_valid(m)).withColumn("_a", F.when(F.col("_ok"), turn(m, 1)))
    rows = flag_members(rows.withColumn("_pd", F.when(F.col("_ok"), prompt_digest(turn(m, 0)))), "_pd",
                        bench.select(prompt_digest(bench_prompt).alias("d")), "_eval")
    a = F.col("_a")
    reason = first_failing([
        ("schema_invalid", ~F.col("_ok")),
        ("tag_invalid", ~T.tags_valid(T.tag_tokens(a, tags))),
        ("unclosed_fence", fence_is_open(a)),
        ("repetitive_answer", T.long_line_copies(a) >= 10),
        ("exact_eval_prompt", F.col("_eval")),
    ], "candidate")
    return (rows.withColumn("reason", reason).withColumn("digest", T.conversation_digest(m))
            .drop("_ok", "_a", "_pd", "_eval"))


def filter_waterfall(checked: DataFrame, fraction: float, order: list[str]) -> DataFrame:
    """Rows per source and outcome.  Outcomes exclude each other, so they add up to the raw count of the source.

    Copies are counted as candidates minus first occurrences per source; no row is joined back.
    """
    candidate = F.col("reason") == "candidate"
    # the texts are read and checked once; everything below works on the stored counts per source, reason and digest
    parts = cut(checked.groupBy("source", "reason", F.when(candidate, F.col("digest")).alias("d"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("f")))
    outcome = parts.groupBy("source", "reason").agg(F.sum("n").alias("n"))
    firsts = parts.groupBy("d").agg(F.min(F.when(candidate, F.col("f"))).alias("f")).filter("f IS NOT NULL")
    label = F.when(in_hash_fraction(F.col("d"), fraction), "sampled").otherwise("outside_sample")
    kept = firsts.groupBy(F.col("f.source").alias("source"), label.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    moved = kept.select("source", F.lit("candidate").alias("reason"), (-F.col("n")).alias("n"))
    both = outcome.unionByName(kept).unionByName(moved)
    named = F.when(F.col("reason") == "candidate", "exact_duplicate").otherwise(F.col("reason"))
    names = ["schema_invalid", "tag_invalid", "unclosed_fence", "repetitive_answer", "exact_eval_prompt",
             "exact_duplicate", "outside_sample", "sampled"]
    return both.groupBy("source").agg(
        *[F.sum(F.when(named == c, F.col("n")).otherwise(0)).alias(c) for c in names],
        F.sum("n").alias("raw"))


def length_filter(df: DataFrame, length: str | Column, limit: int) -> DataFrame:
    return df.filter(T.col(length) <= limit)


def length_distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, extremes, nearest-rank percentiles (rank rounded half to even) and mean of each length column.

    Values are counted first; ranks come from running totals over the distinct values only.
    """
    long = df.select(*[F.col(c).cast("long").alias(c) for c in cols]).unpivot([], cols, "field", "value")
    counts = cut(long.filter("value IS NOT NULL").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))
    placed = running_total(counts, [F.col("value")], {"upto": F.col("n")}, by=["field"])
    sizes = counts.groupBy("field").agg(F.sum("n").alias("count"))
    joined = placed.join(F.broadcast(sizes), "field")  # one row per length column
    return joined.groupBy("field").agg(
        F.first("count").alias("count"), F.min("value").alias("min"),
        *[F.min(F.when(F.col("upto") > F.rint((F.col("count") - 1) * q), F.col("value"))).alias(name)
          for name, q in QUANTILES],
        F.max("value").alias("max"),
        F.round(F.sum(F.col("value") * F.col("n")) / F.first("count"), 2).alias("mean"))


def length_distribution_approx(df: DataFrame, cols: list[str], accuracy: int = 10000) -> DataFrame:
    """One-pass variant with ``percentile_approx`` sketches."""
    long = df.select(*[F.col(c).cast("long").alias(c) for c in cols]).unpivot([], cols, "field", "value")
    return long.filter("value IS NOT NULL").groupBy("field").agg(
        F.count(F.lit(1)).alias("count"), F.min("value").alias("min"),
        *[F.percentile_approx("value", q, accuracy).alias(name) for name, q in QUANTILES],
        F.max("value").alias("max"), F.round(F.avg("value"), 2).alias("mean"))


def key_set_histogram(df: DataFrame, json_col: str) -> DataFrame:
    keys = F.array_join(F.array_sort(F.json_object_keys(json_col)), ",")
    return df.groupBy(keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def role_sequence_histogram(df: DataFrame) -> DataFrame:
    seq = F.array_join(F.transform("messages", lambda m: m["role"]), "->", "None")
    return df.groupBy(seq.alias("roles")).agg(F.count(F.lit(1)).alias("n"))


def id_diagnostics(df: DataFrame, source: str = "source", row: str = "row_id", id_col: str = "id") -> DataFrame:
    """Per source: distinct ids, rows that repeat an id, rows whose id is not their 0-based position, resets."""
    slim = df.select(source, row, F.col(id_col).alias("id"))
    per_id = slim.groupBy(source, "id").agg(F.count(F.lit(1)).alias("n"))
    ids = per_id.groupBy(source).agg(F.count(F.lit(1)).alias("unique_ids"), (F.sum("n") - F.count(F.lit(1))).alias("repeated_rows"))
    pos = ranked(slim, [F.col(row)], [source], "_rk")
    moved = pos.groupBy(source).agg(F.count_if(F.col("id") != F.col("_rk") - 1).alias("off_position_rows"))
    drops = id_resets(df, source, row, id_col).groupBy(source).agg(F.count(F.lit(1)).alias("resets"))
    return (ids.join(moved, source).join(drops, source, "left")
            .withColumn("resets", F.coalesce("resets", F.lit(0))))


def id_resets(df: DataFrame, source: str = "source", row: str = "row_id", id_col: str = "id") -> DataFrame:
    slim = df.select(source, row, F.col(id_col).alias("id"))
    prev = previous_row(slim, [F.col(source), F.col(row)], [source, "id"])
    return (prev.filter((F.col(f"prev.{source}") == F.col(source)) & (F.col("id") <= F.col("prev.id")))
            .select(source, row, F.col("prev.id").alias("previous_id"), "id"))


def id_reset_examples(df: DataFrame, cap: int = 20, **names) -> DataFrame:
    source, row = names.get("source", "source"), names.get("row", "row_id")
    return top_k(id_resets(df, **names), [source], [F.col(row)], cap, "example")


def error_report(df: DataFrame, errors: Column, ref: Column, order: list[str], cap: int = 20) -> DataFrame:
    """Count per error kind and the first ``cap`` row references of each kind."""
    each = df.select(F.explode(errors).alias("kind"), ref.alias("ref"), *order)
    counts = each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    firsts = (top_k(each, ["kind"], [F.col(c) for c in order], cap)
              .groupBy("kind").agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda s: s["ref"]), ";").alias("examples")))
    return counts.join(firsts, "kind")


def expect_count(df: DataFrame, expected: int) -> DataFrame:
    """One row when the number of records is not the expected one, none otherwise."""
    n = df.agg(F.count(F.lit(1)).alias("actual"))
    return (n.filter(F.col("actual") != expected)
            .select(F.lit("record_count_mismatch").alias("kind"), F.lit(expected).cast("long").alias("expected"), "actual"))


def record_errors(max_kinds: bool = True) -> Column:
    """Error kinds of one corpus row; kinds may overlap, unlike the outcomes of the waterfall."""
    m = F.col("messages")
    roles = F.array_join(F.transform(m, lambda x: x["role"]), "->", "None")
    shaped = F.size(m) == 2
    filled = shaped & F.forall(m, lambda x: F.coalesce(F.length(x["content"]) > 0, F.lit(False)))
    kinds = [
        ("unexpected_role_sequence", roles != "user->assistant"),
        ("unexpected_message_shape", ~shaped),
        ("empty_or_non_string_content", shaped & ~filled),
        ("malformed_action_tags", filled & ~T.tags_valid(T.tag_tokens(turn(m, 1)))),
        ("invalid_input_tokens", filled & ~F.coalesce(F.col("input_tokens") >= 0, F.lit(False))),
        ("invalid_output_tokens", filled & ~F.coalesce(F.col("output_tokens") >= 0, F.lit(False))),
        ("invalid_total_tokens", filled & ~F.coalesce(F.col("total_tokens") >= 0, F.lit(False))),
        ("token_sum_mismatch", filled & (F.least("input_tokens", "output_tokens", "total_tokens") >= 0)
         & (F.col("input_tokens") + F.col("output_tokens") != F.col("total_tokens"))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in kinds]))


def audit_corpus(df: DataFrame, max_length: int, expected: int | None = None, sequences: int | None = None) -> DataFrame:
    """The whole report as (section, item, value) rows, all from one stored projection of the check columns.

    ``sequences`` keeps that many of the most frequent tag sequences; by default all are reported.
    """
    m = F.col("messages")
    # rows that pass the shape tests carry the content checks; the stored rows hold no text
    slim = cut(df.select("source", "row_id", "id", "input_tokens", "output_tokens", "total_tokens",
                         record_errors().alias("errors"),
                         F.array_join(F.transform(m, lambda x: x["role"]), "->", "None").alias("roles"),
                         F.length(turn(m, 0)).alias("user_chars"), F.length(turn(m, 1)).alias("assistant_chars"),
                         T.tag_sequence(T.tag_tokens(turn(m, 1))).alias("seq"),
                         F.lower(turn(m, 1)).contains(T.FENCE + "python").alias("python"),
                         T.conversation_digest(m).alias("digest")))
    good = slim.filter(~F.exists("errors", lambda e: e.isin("unexpected_message_shape", "empty_or_non_string_content")))
    scalars = good.agg(
        F.count_if(F.size("seq") > 0).alias("tagged_records"), F.count_if("python").alias("python_fence_records"),
        F.count_if(F.col("total_tokens") > max_length).alias("over_limit"),
        *[F.count_if(F.array_contains("seq", a)).alias(f"opens_{a}") for a in T.ACTIONS])
    out = [scalars.select(*[F.col(c).cast("double").alias(c) for c in scalars.columns])
           .unpivot([], scalars.columns, "item", "value").withColumn("section", F.lit("content")),
           slim.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("item", F.lit("records"))
           .withColumn("section", F.lit("records")),
           slim.groupBy(F.col("roles").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value"))
           .withColumn("section", F.lit("role_sequence")),
           slim.select(F.explode("errors").alias("item")).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("value"))
           .withColumn("section", F.lit("error")),
           good.groupBy("digest").agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.sum("extra").cast("double").alias("value"))
           .withColumn("item", F.lit("duplicate_conversations")).withColumn("section", F.lit("content"))]
    label = F.when(F.size("seq") == 0, "<none>").otherwise(F.array_join("seq", "->"))
    counts = good.groupBy(label.alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    if sequences is not None:
        counts = counts.orderBy(F.desc("value"), "item").limit(sequences)
    out.append(counts.withColumn("section", F.lit("tag_sequence")))
    lengths = length_distribution(good, ["input_tokens", "output_tokens", "total_tokens", "user_chars", "assistant_chars"])
    stats = ["count", "min", "p50", "p90", "p95", "p99", "max", "mean"]
    out.append(lengths.select("field", *[F.col(c).cast("double").alias(c) for c in stats])
               .unpivot(["field"], stats, "stat", "value")
               .select(F.concat_ws(".", "field", "stat").alias("item"), "value").withColumn("section", F.lit("length")))
    if expected is not None:
        out.append(expect_count(slim, expected).select(F.col("kind").alias("item"), F.col("actual").cast("double").alias("value"))
                   .withColumn("section", F.lit("error")))
    return reduce(lambda a, b: a.unionByName(b), out).select("section", "item", "value")


def last_python_block(answer: Column) -> Column:
    """Last fenced python block, lower-cased; null when there is none."""
    return F.lower(T.found_last(answer, r"(?s)```python.*?```", 0))


def audit_generated_code(df: DataFrame, answer: str) -> DataFrame:
    """Row flags: block missing, one flag per risk class, dynamic evaluation, and the resulting pass flag."""
    rows = df.withColumn("code", last_python_block(F.col(answer)))
    code = F.coalesce("code", F.lit(""))

    def hit(tokens):
        return reduce(lambda a, b: a | b, [code.contains(t) for t in tokens])

    for name, tokens in RISK_TOKENS.items():
        rows = rows.withColumn(name, hit(tokens))
    return (rows.withColumn("missing_block", F.col("code").isNull()).withColumn("dynamic_review", hit(REVIEW_TOKENS))
            .withColumn("passed", ~reduce(lambda a, b: a | b, [F.col(n) for n in RISK_TOKENS])))


def code_risk_summary(df: DataFrame, answer: str, by: list[str] | None = None) -> DataFrame:
    rows = audit_generated_code(df, answer)
    flags = [*RISK_TOKENS, "missing_block", "dynamic_review", "passed"]
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(f).alias(f) for f in flags])


def check_id_coverage(df: DataFrame, id_col: str, expected: int | DataFrame, score: str | None = None) -> DataFrame:
    """Ids missing from or surplus to the expected ones, ids seen more than once, and scores other than 0 and 1.

    ``expected`` is a table whose first column holds the ids, or a number n for 0..n-1.
    """
    spark = df.sparkSession
    bad = F.count_if(~F.coalesce(F.col(score).isin(0, 1), F.lit(False))) if score else F.lit(0)
    seen = df.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"), bad.alias("bad_scores"))
    ids = spark.range(expected) if isinstance(expected, int) else expected
    want = ids.select(F.col(ids.columns[0]).cast("long").alias("_want")).distinct()
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected") \
        .when(F.col("n") > 1, "repeated").when(F.col("bad_scores") > 0, "bad_score")
    return (seen.join(want, seen["id"] == want["_want"], "full_outer")
            .select(F.coalesce("id", "_want").alias("id"), problem.alias("problem")).filter("problem IS NOT NULL"))


def token_volume_estimate(df: DataFrame, key: list[str], length: str, n: int, seed: int, limit: int = 8192) -> DataFrame:
    """Mean, standard error, 95 % interval, total and packed-sequence estimate from a uniform sample of n rows."""
    from .sample import sample_k
    picked = sample_k(df.select(*key, length), n, seed, key)
    v = F.when(F.col(length) <= limit, F.col(length)).otherwise(0).cast("double")
    stats = picked.agg(F.count(F.lit(1)).alias("sample_size"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                       F.count_if(F.col(length) > limit).alias("over_limit"))
    total = df.agg(F.count(F.lit(1)).alias("records"))
    se = F.col("sd") / F.sqrt(F.col("sample_size"))
    return stats.crossJoin(total).select(  # both sides are one row
        "records", "sample_size", "over_limit",
        F.rint(F.col("mean") * F.col("records")).cast("long").alias("estimated_tokens"),
        F.rint((F.col("mean") - 1.96 * se) * F.col("records")).cast("long").alias("low"),
        F.rint((F.col("mean") + 1.96 * se) * F.col("records")).cast("long").alias("high"),
        F.ceil(F.col("mean") * F.col("records") / limit).alias("packed_sequences"))
