"""Projection of raw corpora to the standard record: ``messages`` plus at most nine other columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .audit import MESSAGES
from .scale import running_total, with_group_stats

# The standard columns, the accepted roles and the aliases of columns and roles.
STANDARD = ("messages", "rejected_response", "label", "images", "videos", "audios", "tools",
            "objects", "channel", "margin")
ROLES = ("system", "user", "tool_call", "tool_response", "tool", "assistant")
QR_ALIASES = {
    "system": ["system", "system_prompt"],
    "query": ["query", "prompt", "input", "instruction", "question", "problem"],
    "response": ["response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text",
                 "completion", "content"],
}
MESSAGE_ALIASES = {"messages": ["messages", "conversation", "conversations"],
                   "system": ["system", "system_prompt"]}
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "gpt", "bot")
CALL_ROLES = ("function_call",)
OBSERVATION_ROLES = ("function_response", "observation", "observations")


def turns_to_messages(df: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """One row per conversation from one row per turn."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return (df.groupBy(key).agg(turns.alias("_t"))
            .select(key, F.transform("_t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")))


def message(role, content: Column) -> Column:
    return F.struct((role if isinstance(role, Column) else F.lit(role)).alias("role"), content.alias("content"))


def no_messages() -> Column:
    return F.array().cast(MESSAGES)


def rename_aliases(df: DataFrame, aliases: dict[str, list[str]] | dict[str, str]) -> DataFrame:
    """Case-insensitive renaming to standard names.

    When two columns of the table claim one standard name, neither is renamed; a column that already has the name keeps it.
    """
    target = {}
    for name, value in aliases.items():
        for alias in ([name] if isinstance(value, str) else value):
            target[alias.lower()] = value if isinstance(value, str) else name
    claims: dict[str, list[str]] = {}
    for c in df.columns:
        if c.lower() in target:
            claims.setdefault(target[c.lower()], []).append(c)
    return df.withColumnsRenamed({c[0]: name for name, c in claims.items() if len(c) == 1 and c[0] != name})


def auto_normalize(df: DataFrame, **kwargs) -> DataFrame:
    """Choose the path by column names: chat messages, instruction records or question/answer pairs."""
    names = {c.lower() for c in df.columns}
    if names & set(MESSAGE_ALIASES["messages"]):
        df = rename_aliases(df, MESSAGE_ALIASES)
        fields = {f.name for f in df.schema["messages"].dataType.elementType.fields}
        if fields >= {"human", "assistant"}:
            return sharegpt_pairs_to_messages(df)
        role = "role" if "role" in fields else "from"
        content = "content" if "content" in fields else "value"
        return standardize_messages(df, role, content)
    if {"instruction", "input"} <= names:
        return alpaca_to_messages(df)
    return qr_to_messages(df, **kwargs)


def pick_one(choices: Column, key: Column, seed: int) -> Column:
    """A seeded choice from an array, the same on every run."""
    return F.get(choices, F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.size(choices).cast("long")).cast("int"))


def history_pairs(history: Column) -> Column:
    """[[question, answer], …] as turns, dropping null halves."""
    flat = F.flatten(F.transform(history, lambda p: F.array(message("user", F.get(p, F.lit(0))), message("assistant", F.get(p, F.lit(1))))))
    return F.filter(flat, lambda m: m["content"].isNotNull())


def qr_to_messages(df: DataFrame, key: str | None = None, seed: int = 42) -> DataFrame:
    """system / history / query / response columns (any of them may be missing) to messages.

    A history given as text is read as a JSON list of pairs.  A list of responses is reduced to one by a seeded choice.
    """
    df = rename_aliases(df, QR_ALIASES)
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = []

    def single(role, c):
        m = F.array(message(role, c.cast("string")))
        return F.filter(m, lambda x: x["content"].isNotNull())

    if "system" in have:
        parts.append(single("system", F.col("system")))
    if "history" in have:
        h = F.col("history")
        if not have["history"].startswith("array"):
            h = F.from_json(h, "array<array<string>>")
        parts.append(F.coalesce(history_pairs(h), no_messages()))
    if "query" in have:
        parts.append(single("user", F.col("query")))
    if "response" in have:
        r = F.col("response")
        if have["response"].startswith("array"):
            r = pick_one(r, F.col(key) if key else F.concat_ws(T.UNIT, r), seed)
        parts.append(single("assistant", r))
    used = [c for c in ("system", "history", "query", "response") if c in have]
    return df.withColumn("messages", F.concat(*parts)).drop(*used)


def alpaca_to_messages(df: DataFrame, **kwargs) -> DataFrame:
    """instruction and input make the query, joined by a line end when both have text."""
    df = df.withColumnRenamed("output", "response")
    i, x = F.coalesce("instruction", F.lit("")), F.coalesce("input", F.lit(""))
    query = F.when((i != "") & (x != ""), F.concat(i, F.lit("\n"), x)).otherwise(F.concat(i, x))
    return qr_to_messages(df.withColumn("query", query).drop("instruction", "input"), **kwargs)


def standard_role(role: Column) -> Column:
    tool = F.replace(role, F.lit("-"), F.lit("_"))
    return (F.when(role.isin(*USER_ROLES), "user").when(role.isin(*ASSISTANT_ROLES), "assistant")
            .when(tool.isin(*CALL_ROLES), "tool_call").when(tool.isin(*OBSERVATION_ROLES), "tool_response").otherwise(role))


def standardize_messages(df: DataFrame, role_key: str = "role", content_key: str = "content",
                         inner_key: str | None = None) -> DataFrame:
    """Any role/content naming to the standard one; a ``system`` column becomes the first turn unless there is one."""
    m = F.col("messages")
    if inner_key:
        m = F.transform(m, lambda x: x[inner_key])
    turns = F.transform(m, lambda x: message(standard_role(x[role_key]), x[content_key].cast("string")))
    if "system" in df.columns:
        lead = F.when(F.col("system").isNotNull() & ~F.coalesce(F.get(turns, F.lit(0))["role"] == "system", F.lit(False)),
                      F.array(message("system", F.col("system")))).otherwise(no_messages())
        turns = F.concat(lead, turns)
        df = df.withColumn("messages", turns).drop("system")
    else:
        df = df.withColumn("messages", turns)
    return df.filter(F.size("messages") > 0)


def sharegpt_pairs_to_messages(df: DataFrame) -> DataFrame:
    """Objects holding one exchange each become two turns each."""
    turns = F.flatten(F.transform("messages", lambda p: F.array(message("user", p["human"]), message("assistant", p["assistant"]))))
    if "system" in df.columns:
        turns = F.concat(F.when(F.col("system").isNotNull(), F.array(message("system", F.col("system")))).otherwise(no_messages()), turns)
    return df.withColumn("messages", turns).drop("system")


def messages_problem(messages: Column) -> Column:
    """Reason why a conversation is unusable, null when it is fine."""
    return (F.when(messages.isNull() | (F.size(messages) == 0), "empty")
            .when(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))), "unknown_role")
            .when(F.exists(messages, lambda m: m["content"].isNull()), "null_content"))


def validate_messages(df: DataFrame) -> DataFrame:
    """Extra keys of a turn are stripped; ``_reject`` holds the reason of unusable rows."""
    slim = F.transform("messages", lambda m: message(m["role"], m["content"]))
    return df.withColumn("messages", slim).withColumn("_reject", messages_problem(F.col("messages")))


def check_preference_pair(df: DataFrame, chosen: str = "messages", rejected: str = "rejected_messages") -> DataFrame:
    """The last assistant turn of the rejected conversation becomes ``rejected_response``.

    Both conversations must share their user turns; a rejected answer that is null or equal to the chosen one is a reject.
    """
    def of(c, role):
        return F.transform(F.filter(F.col(c), lambda m: m["role"] == role), lambda m: m["content"])

    def last(a):
        return F.get(F.reverse(a), F.lit(0))

    good, bad = last(of(chosen, "assistant")), last(of(rejected, "assistant"))
    reason = (F.when(~F.coalesce(of(chosen, "user") == of(rejected, "user"), F.lit(False)), "different_prompt")
              .when(bad.isNull(), "no_rejected").when(bad == good, "same_answer"))
    return df.withColumn("rejected_response", bad).withColumn("_reject", reason).drop(rejected)


def cast_label(c) -> Column:
    return T.col(c).try_cast("double").cast("int")


def project_standard(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the standard columns and those named in ``keep`` (``solution`` for scoring)."""
    return df.select(*[c for c in df.columns if c in STANDARD or c in keep])


def normalize_boxes(boxes: Column) -> Column:
    """Corners ordered so that x1 <= x2 and y1 <= y2; points stay."""
    def one(b):
        g = [F.get(b, F.lit(i)) for i in range(4)]
        return F.when(F.size(b) == 4, F.array(F.least(g[0], g[2]), F.least(g[1], g[3]), F.greatest(g[0], g[2]), F.greatest(g[1], g[3]))).otherwise(b)
    return F.transform(boxes, one)


def boxes_problem(boxes: Column) -> Column:
    return F.when(F.exists(boxes, lambda b: ~F.size(b).isin(2, 4)), "box_size")


def quarantine(df: DataFrame, strict: bool = False, reason: str = "_reject") -> tuple[DataFrame, DataFrame]:
    """(good rows, report of rejects per reason).  ``strict`` fails the job at the first reject instead."""
    if strict:
        stop = F.when(F.col(reason).isNotNull(), F.raise_error(F.concat(F.lit("rejected row: "), F.col(reason))).cast("boolean")).otherwise(F.lit(True))
        good = df.filter(stop)
    else:
        good = df.filter(F.col(reason).isNull())
    report = df.filter(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return good.drop(reason), report


def fill_template(template: str, query: str | Column, mark: str = "{{QUERY}}") -> Column:
    return F.replace(F.lit(template), F.lit(mark), T.col(query))


def classification_prompt(df: DataFrame, labels: list[str], task: str, label: str = "label", pair: bool = False) -> DataFrame:
    """Sentence (or sentence pair) and label index to a prompt and a label text; rows without a label are dropped."""
    listing = ", ".join(labels)
    if pair:
        body = F.concat(F.lit("Sentence1: "), F.col("sentence1"), F.lit("\nSentence2: "), F.col("sentence2"))
    else:
        body = F.concat(F.lit("Sentence: "), F.col("sentence"))
    prompt = F.concat(F.lit(f"Task: {task}\n"), body, F.lit(f"\nCategory: {listing}\nOutput:"))
    names = F.array(*[F.lit(x) for x in labels])
    return (df.filter(F.col(label).isNotNull())
            .withColumn("query", prompt).withColumn("response", F.get(names, F.col(label).cast("int"))))


def flatten_multipart(parts: Column) -> Column:
    """Content parts (type, text) to one text; pictures leave a mark."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "image", "<image>").otherwise(F.coalesce(p["text"], F.lit("")))), "")


def media_manifest_filter(df: DataFrame, path: str, manifest: DataFrame, manifest_path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Rows whose media file exists, after rewriting path prefixes.  The manifest is shuffled or broadcast by its size."""
    p = F.col(path)
    new = reduce(lambda acc, kv: F.when(p.startswith(kv[0]), F.concat(F.lit(kv[1]), F.substring(p, F.lit(len(kv[0]) + 1), F.length(p)))).otherwise(acc),
                 (prefixes or {}).items(), p)
    rows = df.withColumn(path, new)
    return rows.join(manifest.select(F.col(manifest_path).alias(path)).distinct(), path, "left_semi")


def sessionize_steps(df: DataFrame, key: str, order: str, index: str, start: str = "0", step: str | None = None) -> DataFrame:
    """Adds ``session``: the running number of step indices equal to ``start`` inside a key, and under the name ``step`` the 0-based number of the row in its session.

    A key of any size is cut over many tasks, since the session number and the row number are running totals; a session begins at its smallest row number.
    """
    opens = F.when(F.col(index) == start, 1).otherwise(0).cast("long")
    if step is None:
        return running_total(df, [F.col(order)], {"session": opens}, by=[key])
    rows = running_total(df, [F.col(order)], {"session": opens, "_row": F.lit(1).cast("long")}, by=[key])
    return with_group_stats(rows, [key, "session"], [F.min("_row").alias("_first")], spread=["_row"]).withColumn(step, F.col("_row") - F.col("_first")).drop("_row", "_first", "_rows")


def session_messages(df: DataFrame, key: str, order: str, task: str, content: str, action: str, step: str, max_steps: int = 4096) -> DataFrame:
    """One conversation per session, as (key, session, part, messages): the observation of each step is a user turn (the first carries the task), the action
    the assistant turn.

    ``step`` is the number of the row in its session.  A session of more than ``max_steps`` steps comes out as parts in order, so that no array grows with a session; no step is
    left out.
    """
    part = F.floor(F.col(step) / max_steps).cast("long").alias("part")
    rows = df.groupBy(key, "session", part).agg(F.array_sort(F.collect_list(F.struct(order, step, task, content, action))).alias("_s"))
    turns = F.flatten(F.transform("_s", lambda s: F.array(
        message("user", F.when(s[step] == 0, F.concat(s[content], F.lit("\n"), s[task])).otherwise(s[content])),
        message("assistant", s[action]))))
    return rows.select(key, "session", "part", turns.alias("messages"))


def spans_to_tags(caption: Column, spans: Column, open_tag: str = "<ref-object>") -> Column:
    """Half-open character spans of a caption replaced by a tag; null when there are none or two overlap."""
    def rebuild(s):
        n = F.size(s)
        idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        clash = F.exists(idx, lambda i: (i > 0) & (F.get(s, i)["a"] < F.get(s, i - 1)["b"]))

        def piece(i):
            before = F.coalesce(F.when(i > 0, F.get(s, i - 1)["b"]), F.lit(0))
            return F.concat(F.substring(caption, before + 1, F.get(s, i)["a"] - before), F.lit(open_tag))

        tail = F.substring(caption, F.get(s, n - 1)["b"] + 1, F.length(caption))
        return F.when((n > 0) & ~clash, F.concat(F.array_join(F.transform(idx, piece), ""), tail))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(F.get(x, F.lit(0)).alias("a"), F.get(x, F.lit(1)).alias("b"))))
    return T.bind(ordered, rebuild)
