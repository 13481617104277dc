"""Text expressions shared by the operators.  All are Catalyst expressions over string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.split() treats as white space, as a Java/RE2 class.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Fixed value: the line ends of str.splitlines().
VISIBLE = "[^" + SPACE[1:]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# The action tags of the agent transcripts.
ACTIONS = ("Analyze", "Understand", "Code", "Execute", "Answer")
FENCE = "```"
UNIT = "\u001f"
RECORD = "\u001e"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def rx(text) -> Column:
    return F.lit(text)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row.

    An expression named inside a lambda is evaluated for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squash(c) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def strip(c) -> Column:
    return F.regexp_replace(col(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def words(c) -> Column:
    """White-space tokens; an empty text has none."""
    return bind(squash(c), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def lines(c) -> Column:
    return F.transform(F.split(col(c), LINE_END), strip)


def count_of(c, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def after_last(c, mark: str) -> Column:
    """Text behind the last occurrence of a literal; the whole text when it is absent."""
    return F.element_at(F.split(col(c), r"\Q" + mark + r"\E", -1), -1)


def after_first(c, mark: str) -> Column:
    """Text between the first and the second occurrence of a literal (null when absent)."""
    return F.get(F.split(col(c), r"\Q" + mark + r"\E", -1), F.lit(1))


def before_first(c, mark: str) -> Column:
    return F.substring_index(col(c), mark, 1)


def found(c, pattern: str, group: int = 1) -> Column:
    """Capture of the first match, null (not '') when nothing matches."""
    return F.get(F.transform(F.array(col(c)), lambda t: F.when(F.regexp_like(t, F.lit(pattern)), F.regexp_extract(t, pattern, group))), F.lit(0))


def found_all(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def found_last(c, pattern: str, group: int = 1) -> Column:
    return F.get(F.reverse(found_all(c, pattern, group)), F.lit(0))


def tag_tokens(c, tags=ACTIONS) -> Column:
    """Line-start tags in order, as 'Name' for an opening and '/Name' for a closing tag."""
    one = "|".join(tags)
    return F.regexp_extract_all(col(c), F.lit(rf"(?dm)^[ \t]*<(/?(?:{one}))>"), F.lit(1))


def tags_valid(tokens: Column) -> Column:
    """Open and close tags alternate and every close names the tag before it."""
    def paired(t):
        n = F.size(t)
        return F.when(n == 0, True).when(n % 2 == 1, False).otherwise(F.forall(
            F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(2)),
            lambda i: (~F.get(t, i).startswith("/")) & (F.get(t, i + 1) == F.concat(F.lit("/"), F.get(t, i)))))

    return bind(tokens, paired)


def tag_sequence(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.startswith("/"))


def max_copies(items: Column) -> Column:
    """Largest multiplicity in an array: sort it, then walk the runs once."""
    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["prev"].eqNullSafe(x), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), start, step, lambda acc: acc["best"])


def long_line_copies(c, min_len: int = 30) -> Column:
    """How often the commonest stripped line longer than ``min_len`` occurs."""
    def long(s):
        return F.length(s) > min_len

    # stripping only shortens, so short lines are out before the costlier step
    kept = F.filter(F.transform(F.filter(F.split(col(c), LINE_END), long), strip), long)
    return bind(kept, lambda k: F.when(F.size(k) < 2, F.size(k)).otherwise(max_copies(k)))


def conversation_digest(messages: Column) -> Column:
    """SHA-256 of role and content of every turn, joined by control characters that separate fields and records."""
    flat = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(UNIT), m["content"])), RECORD)
    return F.sha2(flat, 256)


def clip(c, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def mean_of(values: Column) -> Column:
    """Mean of the non-null items of an array, null when there are none."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return bind(kept, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, v: a + v) / F.size(k)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two string arrays."""
    def count(p):
        return F.aggregate(F.array_intersect(p["a"], p["b"]), F.lit(0), lambda acc, w: acc + F.least(
            F.size(F.filter(p["a"], lambda x: x == w)), F.size(F.filter(p["b"], lambda x: x == w))))

    return bind(F.struct(a.alias("a"), b.alias("b")), count)
