"""Answer extraction and matching for question answering over tables.  Column in, Column out."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

PUNCT = r"[!-/:-@\[-`{-~]"
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
# Period phrases that count as equal.
PERIODS = {"1 week": "7 days", "2 weeks": "14 days", "1 year": "12 months"}
LEADS = ("the answer is", "answer:", "=", "approximately", "about", "around")


def _accent_table() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, by the Unicode rule."""
    src, dst = "", ""
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            src, dst = src + chr(cp), dst + base
    return src, dst


ACCENTED, PLAIN = _accent_table()


def fold_accents(c) -> Column:
    return F.regexp_replace(F.translate(T.col(c), ACCENTED, PLAIN), r"[\x{300}-\x{36f}]", "")


def to_double(c) -> Column:
    """Number of a plain numeric text, null otherwise."""
    c = T.col(c)
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def number_text(d: Column) -> Column:
    """Whole numbers without a fraction, others as doubles print."""
    return T.bind(d, lambda x: F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string")))


def squad_normalize(c) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single blanks."""
    bare = F.regexp_replace(F.lower(T.col(c)), PUNCT, "")
    return T.squash(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def squad_exact(gold, pred) -> Column:
    return (squad_normalize(gold) == squad_normalize(pred)).cast("double")


def token_f1(gold: Column, pred: Column) -> Column:
    """F1 of two token arrays as multisets; two empty ones agree."""
    def f1(x):
        g, p = F.size(x["g"]), F.size(x["p"])
        same = T.bag_overlap(x["g"], x["p"])
        return F.when((g == 0) | (p == 0), (g == p).cast("double")).otherwise(2 * same / (g + p))

    return T.bind(F.struct(gold.alias("g"), pred.alias("p")), f1)


def squad_f1(gold, pred) -> Column:
    return token_f1(T.words(squad_normalize(gold)), T.words(squad_normalize(pred)))


# ---- extraction

def answer_block(c, mode: str = "last") -> Column:
    """Trimmed content of the first or last <Answer> element, null without one."""
    pattern = r"(?s)<Answer>(.*?)</Answer>"
    return T.strip(T.found_last(c, pattern) if mode == "last" else T.found(c, pattern))


def extract_predicted(c, style: str) -> Column:
    c = T.col(c)
    if style == "wikitq":
        bare = F.replace(c, F.lit("**"), F.lit(""))
        block = answer_block(bare)
        inner = T.strip(F.regexp_replace(T.after_last(block, "Answer:"), r"^\.+|\.+$", ""))
        line = T.strip(T.found(bare, r'Answer:\s*(.+?)(?:\n|$|\.|")'))
        return F.when(block.isNotNull(), inner).otherwise(line)
    if style == "hitab":
        block = answer_block(c, "first")
        line = T.strip(T.found_last(c, r"(?is)Answer:\s*(.*?)(?:\z|\n|\.(?:\s|\z))"))
        return F.coalesce(T.strip(T.after_last(block, "Answer:")), line, c)
    if style == "tablebench":
        return F.coalesce(T.strip(T.found(c, r"(?s)Answer:\s*(.*)\z")), F.lit(""))
    if style == "finqa":
        body = F.coalesce(answer_block(c, "first"), c)
        marked = T.strip(T.found_last(body, r"(?s)Answer:\s*(.*?)(?:\n\s*\n|\n\s*Used cells:|\z)"))
        for junk in ("</answer>", "<answer>", "Answer:"):
            marked = F.replace(marked, F.lit(junk), F.lit(""))
        number = T.strip(T.found_last(body, r"([$¥€£]?\s*[-+]?[0-9,]*\.?[0-9]+\s*(?:million|billion|thousand|M|B|K)?%?)"))
        lower = T.strip(T.found_last(body, r"answer:\s*(.*?)(?:\n|\z)"))
        return F.coalesce(marked, lower, number, F.lit(""))
    raise ValueError(style)


def answer_of(c, mode: str = "general") -> Column:
    """Content of the last answer element of a transcript; null without an opening tag.

    An unclosed element gives '' in ``tableqa`` mode, where text behind 'Answer:' counts, and the whole text otherwise.
    """
    c = T.col(c)
    rest = T.after_last(c, "<Answer>")
    closed = rest.contains("</Answer>")
    body = T.strip(T.before_first(rest, "</Answer>"))
    if mode == "tableqa":
        inner = F.when(closed, body).otherwise("")
        out = F.when(inner.contains("Answer:"), T.strip(T.after_first(inner, "Answer:"))).otherwise(inner)
    else:
        out = F.when(closed, body).otherwise(c)
    return F.when(c.contains("<Answer>"), out)


# ---- matchers; each gives true or false, never null

def wikitq_normalize(c) -> Column:
    """Numbers without commas, known units and periods, sorted lists, and plain text without accents and punctuation."""
    unit = r"^([\d,]+)\s*(days|years|pages|km\/h|mph)$"

    def rules(a):
        bare = F.replace(a, F.lit(","), F.lit(""))
        items = F.filter(F.transform(F.split(a, r"[|,]\s*"), T.strip), lambda s: s != "")
        out = (F.when(a.rlike(unit), F.concat(F.replace(F.regexp_extract(a, unit, 1), F.lit(","), F.lit("")), F.lit(" "), F.regexp_extract(a, unit, 2)))
               .when(a.rlike(r"^[\d,]+$"), bare))
        for k, v in PERIODS.items():
            out = out.when(a == k, v)
        return (out.when(bare.rlike(NUMBER), number_text(to_double(bare)))
                .when(a.rlike(r"[|,]"), F.array_join(F.array_sort(items), "|"))
                .otherwise(T.squash(F.regexp_replace(fold_accents(a), r"(?U)[^\w\s]", ""))))

    return T.bind(T.strip(F.lower(F.coalesce(T.col(c), F.lit("")))), rules)


def wikitq_match(pred, gold) -> Column:
    def items(c):
        return F.array_sort(F.array_distinct(F.split(F.lower(T.col(c)), r"[|,]\s*")))

    def same(v):
        p, g = v["p"], v["g"]
        number_of_unit = p.rlike(r"^\d+$") & g.rlike(r"^\d+\s+[a-z/]+$") & (p == F.regexp_extract(g, r"^(\d+)", 1))
        as_set = (F.size(v["ps"]) > 1) & (F.size(v["gs"]) > 1) & (v["ps"] == v["gs"])
        return (p == g) | number_of_unit | as_set

    both = F.struct(wikitq_normalize(pred).alias("p"), wikitq_normalize(gold).alias("g"), items(pred).alias("ps"), items(gold).alias("gs"))
    return F.coalesce(T.bind(both, same), F.lit(False)) & T.col(pred).isNotNull() & T.col(gold).isNotNull()


def _money(c, comma_aware: bool) -> Column:
    def parts(low):
        unit = (F.when(low.contains("%"), "%").when(low.contains("million"), "million").when(low.contains("billion"), "billion")
                .when(low.contains("$"), "$").otherwise(""))
        return F.struct(low.alias("low"), T.found(low, r"([-+]?[0-9]*\.?[0-9]+)").try_cast("double").alias("v"), unit.alias("u"))

    low = F.lower(T.strip(c))
    return T.bind(F.regexp_replace(low, r"(\d),(?=\d)", "$1") if comma_aware else low, parts)


def finqa_match(pred, gold, comma_aware: bool = False) -> Column:
    """Financial answers: absolute 0.01, two percentages to one decimal, else 5 %; a percentage never meets an amount.

    The number pattern of the default reads '1,234' as 1; ``comma_aware`` reads it as 1234.
    """
    def same(v):
        p, g = v["p"], v["g"]
        pct = (p["u"] == "%") & (g["u"] == "%")
        rel = F.abs(p["v"] - g["v"]) / F.greatest(F.abs(g["v"]), F.lit(1.0)) < 0.05
        tenth = F.abs(F.bround(p["v"], 1) - F.bround(g["v"], 1)) < 0.15
        numeric = (F.abs(p["v"] - g["v"]) < 0.01) | (((p["u"] == "%") == (g["u"] == "%")) & F.when(pct, tenth).otherwise(rel))
        return F.when(p["v"].isNull() | g["v"].isNull(), p["low"] == g["low"]).otherwise(numeric)

    both = F.struct(_money(pred, comma_aware).alias("p"), _money(gold, comma_aware).alias("g"))
    return F.coalesce(T.bind(both, same), F.lit(False)) & (F.coalesce(T.col(pred), F.lit("")) != "")


def hitab_normalize(c) -> Column:
    a = F.regexp_replace(T.strip(F.regexp_replace(F.lower(T.col(c)), r"(?U)[^\w\s.]", "")), f"{T.SPACE}+", " ")
    for lead in LEADS:
        a = T.bind(a, _without(lead))
    return a


def _without(lead: str):
    return lambda x: F.when(x.startswith(lead), T.strip(F.substring(x, F.lit(len(lead) + 1), F.length(x)))).otherwise(x)


def _near(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < 1e-6, F.lit(False))


def hitab_match(pred, golds: Column) -> Column:
    """A number with a unit, all of several golds contained, an equal number, or an equal text."""
    def check(v):
        p, parts, g = v["p"], v["parts"], v["g"]
        head, whole = v["head"], v["whole"]
        with_unit = (F.size(parts) > 1) & F.exists(g, lambda x: _near(head, to_double(x)))
        every = (F.size(g) > 1) & F.forall(g, lambda x: p.contains(x) | F.exists(parts, lambda w: _near(to_double(x), to_double(w))))
        return with_unit | every | F.exists(g, lambda x: _near(whole, to_double(x))) | F.array_contains(g, p)

    p = hitab_normalize(pred)
    parts = T.words(p)
    bound = F.struct(p.alias("p"), parts.alias("parts"), F.transform(golds, hitab_normalize).alias("g"),
                     to_double(F.get(parts, F.lit(0))).alias("head"), to_double(p).alias("whole"))
    some = (F.size(golds) > 0) & (F.coalesce(T.col(pred), F.lit("")) != "")
    return F.coalesce(T.bind(bound, check) & some, F.lit(False))


def loose_number(c) -> Column:
    """Number of a text without currency signs, commas and underscores; a percent sign divides by 100; null otherwise."""
    bare = F.regexp_replace(T.col(c), r"[$,_]", "")
    v = to_double(F.replace(bare, F.lit("%"), F.lit("")))
    return F.when(bare.contains("%"), v / 100).otherwise(v)


def _arith_close(p: Column, g: Column, zero: float = 1e-5) -> Column:
    tol = F.greatest(F.least(F.abs(g) * 0.01, F.lit(0.1)), F.least(F.abs(g) / 1000, F.lit(0.1)))
    return F.when(F.abs(g) < 1e-10, F.abs(p) < zero).otherwise(F.abs(p - g) <= tol)


def multihiertt_scores(pred, gold) -> dict[str, Column]:
    """exact (relative 1e-5 for numbers), arithmetic (tolerance up to 0.1) and f1."""
    p, g = loose_number(pred), loose_number(gold)
    both = p.isNotNull() & g.isNotNull()
    rel = F.when(g == 0, F.abs(p) < 1e-5).otherwise(F.abs(p - g) / F.greatest(F.abs(g), F.lit(1e-10)) < 1e-5)
    arith = F.coalesce(F.when(both, _arith_close(p, g)), F.lit(False))
    return {"exact": F.coalesce(F.when(both, rel.cast("double")).otherwise(squad_exact(gold, pred)), F.lit(0.0)),
            "arithmetic": arith.cast("double"),
            "f1": F.coalesce(F.when(both, arith.cast("double")).otherwise(squad_f1(gold, pred)), F.lit(0.0))}


def aitqa_normalize(c) -> Column:
    a = F.regexp_replace(T.strip(F.lower(T.col(c))), r"(?:million|billion|thousand)s?|gallons?", "")
    a = F.regexp_replace(a, r"(?s)^\((.*)\)$", "-$1")
    return T.bind(F.regexp_replace(a, r"[$,%]", ""),
                  lambda x: F.coalesce(number_text(to_double(x)), F.regexp_replace(x, r"[^0-9.\-]", "")))


def _any_equal(pred: Column, golds: Column, normalize) -> Column:
    """Some gold equals the prediction after normalising, as a number within 1e-6 where both are numbers."""
    def check(v):
        def one(g):
            n = normalize(g)
            x = to_double(n)
            return F.when(x.isNotNull() & v["n"].isNotNull(), F.abs(x - v["n"]) < 1e-6).otherwise(n == v["p"])
        return F.exists(golds, one)

    p = normalize(pred)
    return F.coalesce(T.bind(F.struct(p.alias("p"), to_double(p).alias("n")), check), F.lit(False))


def aitqa_match(pred, golds: Column) -> Column:
    return _any_equal(pred, golds, aitqa_normalize) & (F.coalesce(T.col(pred), F.lit("")) != "")


def tablebench_normalize(c) -> Column:
    """First number of the text, else the text without articles and punctuation."""
    def rules(s):
        raw = F.replace(T.found(s, r"([-+]?[\d,]+\.?\d*)"), F.lit(","), F.lit(""))
        num = T.bind(raw, lambda r: F.coalesce(number_text(to_double(r)), r))
        return F.coalesce(num, squad_normalize(s))

    return T.bind(T.strip(F.lower(F.coalesce(T.col(c), F.lit("")))), rules)


def tablebench_match(pred, golds: Column) -> Column:
    return _any_equal(pred, golds, tablebench_normalize)


def parse_yes_no(c) -> Column:
    """Verdict of a judge's reply: the only verdict word, else the last line, else the commoner word, else no."""
    c = T.col(c)
    yes, no = c.rlike(r"(?U)\bYes\b"), c.rlike(r"(?U)\bNo\b")
    filled = F.filter(F.transform(F.split(c, "\n"), T.strip), lambda s: s != "")
    last = F.lower(F.element_at(F.concat(F.array(F.lit("")), filled), -1))
    ny, nn = (F.regexp_count(F.lower(c), F.lit(rf"(?U)\b{w}\b")) for w in ("yes", "no"))
    return (F.when(yes & ~no, True).when(no & ~yes, False).when(last == "yes", True).when(last == "no", False)
            .otherwise(ny > nn))


def numeric_screen(c, expected: Column) -> Column:
    """Every expected number occurs behind the last answer tag within max(0.02, 0.1 %)."""
    c = T.col(c)
    body = F.when(c.contains("<Answer>"), T.after_last(c, "<Answer>")).otherwise("")
    nums = F.transform(F.regexp_extract_all(F.replace(body, F.lit(","), F.lit("")), F.lit(r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda s: s.cast("double"))
    near = T.bind(nums, lambda ns: F.forall(expected, lambda v: F.exists(
        ns, lambda n: F.abs(n - v) <= F.greatest(F.lit(0.02), F.abs(v) * 0.001))))
    return (body != "") & near


def sums_are_right(c) -> Column:
    """All equations a+b+…=c in a text hold."""
    flat = F.replace(T.col(c), F.lit(" "), F.lit(""))
    eqs = F.regexp_extract_all(flat, F.lit(r"(\d+(?:\+\d+)+=\d+)"), F.lit(1))

    def holds(e):
        left, right = F.split(e, "=")[0], F.split(e, "=")[1]
        return F.aggregate(F.split(left, r"\+"), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) == right.cast("long")

    return F.forall(eqs, holds)


def extract_sql(c) -> Column:
    """SQL text of a reply: inside a marked or plain code fence, else from SELECT on."""
    c = T.col(c)
    body = F.coalesce(answer_block(c, "first"), c)
    return T.strip(F.coalesce(
        T.found_last(body, r"(?is)Answer:\s*```sql\s*(.*?)\s*(?:```|\z)"), T.found_last(body, r"(?s)```sql\s*(.*?)\s*```"),
        T.found_last(body, r"(?s)```\s*(.*?)\s*```"), T.found_last(body, r"(?is)(SELECT\s+.*?FROM\s+.*?(?:WHERE\s+.*?)?(?:;|\z))")))


def normalize_sql(c) -> Column:
    s = F.regexp_replace(F.lower(T.squash(F.coalesce(T.col(c), F.lit("")))), "['\"]", "")
    s = F.replace(F.regexp_replace(s, ";+$", ""), F.lit("_"), F.lit(" "))
    return F.regexp_replace(s, r"(count|sum|avg|min|max) *\(([^)]+)\)", "$1 $2")
