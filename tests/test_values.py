"""Expected values for small inputs: advantages, divergences, scores, answers and table recipes."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers as N
from tessera.functions import rewards as W
from tessera.functions import text as T
from tessera.operators import evaluate as E
from tessera.operators import rollouts as R
from tessera.operators import sample as S
from tessera.operators import tables as B
from tessera.sources import io


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def scores(spark, data):
    return spark.createDataFrame(data, "uid string, sample int, reward double")


GROUPS = [("a", 0, 6.0), ("a", 1, 3.0), ("b", 2, 9.0), ("b", 3, 12.0)]


def test_leave_one_out_and_group_centre(spark):
    d = scores(spark, GROUPS + [("c", 4, 1.0)])
    assert [r.advantage for r in R.rloo_advantage(d, "uid", "sample", "reward").orderBy("sample").collect()] == [3, -3, -3, 3, 0]
    got = R.grpo_advantage(scores(spark, GROUPS), "uid", "sample", "reward", norm_by_std=False).orderBy("sample").collect()
    assert [r.advantage for r in got] == [1.5, -1.5, -1.5, 1.5]
    lone = {s: R.grpo_advantage(d, "uid", "sample", "reward", singleton=s).filter("uid = 'c'").first().advantage for s in ("raw", "zero", "null")}
    assert lone["raw"] == pytest.approx(1 / (1 + 1e-6)) and lone["zero"] == 0 and lone["null"] is None


def test_returns_and_gae(spark):
    r = F.array(*map(F.lit, (1.0, 2.0, 3.0)))
    got = one(spark, R.discounted_returns(r, F.array(*map(F.lit, (1, 1, 0))), 1.0), R.discounted_returns(r, F.array(*map(F.lit, (1, 1, 1))), 0.5))
    assert got == [[3, 2, 3], [2.75, 3.5, 3]]
    adv, = one(spark, R.gae_advantages(r, F.array(*map(F.lit, (0.5, 1.0, 1.5))), 1.0, 0.0))
    assert adv == [1.5, 2.5, 1.5]


def test_divergence(spark):
    p, q, m = (F.array(*map(F.lit, x)) for x in ((.2, .3, .5), (.1, .2, .4), (1.0, 1.0, 0.0)))
    got = dict(zip(("k1", "abs", "k2", "k3"), one(spark, *[R.approx_kl(p, q, m, k) for k in ("k1", "abs", "k2", "k3")])))
    assert got["k1"] == pytest.approx([.1, .1, 0]) and got["abs"] == pytest.approx([.1, .1, 0]) and got["k2"] == pytest.approx([.005, .005, 0])
    assert got["k3"] == pytest.approx([math.exp(-.1) - 1 + .1] * 2 + [0])


def test_scores_by_source_and_uniform_groups(spark):
    d = spark.createDataFrame([("1", 0, .5, "d1"), ("2", 1, .7, None), ("3", 2, .9, "d1"), ("4", 3, .4, None)], "uid string, sample int, reward double, source string")
    got = {r.source: (r.avg_score, r.pass_at_n) for r in R.per_source_metrics(d, "uid", "reward", "source").collect()}
    assert got["d1"] == (pytest.approx(.7), 1) and got["unknown"] == (pytest.approx(.55), 1)
    u = scores(spark, [("1", 0, 1.0), ("1", 1, 2.0), ("2", 2, 1.0), ("2", 3, 1.0), ("3", 4, 3.0), ("3", 5, 4.0)])
    out = R.replace_uniform_groups(u, "uid", "sample", "reward", 2, 0.3, 1).collect()
    assert len(out) == 6 and "2" not in {r.uid for r in out} and {r.slot for r in out} == {"1", "2", "3"}
    assert {r.uid for r in R.filter_uniform_groups(u, "uid", "sample", "reward", ["sample"], 2).collect()} == {"1", "3"}


@pytest.mark.parametrize("text,gold,want", [("#### 42", "42", 1), ("#### 43", "42", 0), ("forty two", "42", 0), ("#### 1,042", "1042", 1)])
def test_number_marker(spark, text, gold, want):
    assert one(spark, W.gsm8k_score(F.lit(text), F.lit(gold))) == [want]


@pytest.mark.parametrize("pred,golds,want", [("<answer>The Mark Norman!</answer>", ["mark norman"], 1), ("<answer>Somebody</answer>", ["mark norman"], 0),
                                            ("no tags", ["mark norman"], 0), ("<answer>b</answer>", ["a1", "B"], 1)])
def test_search_match(spark, pred, golds, want):
    assert one(spark, W.search_em(F.lit(pred), F.array(*map(F.lit, golds)))) == [want]


@pytest.mark.parametrize("text,want", [("", True), ("<Code>\nx\n</Code>", True), ("<Code>\n<Answer>\n</Answer>\n</Code>", False), ("<Code>\n", False), ("</Code>\n", False),
                                       ("a <Code> b", True), ("<Code>\n</Answer>\n", False), ("  <Code>\r\n\t</Code>", True), ("<Code>\r</Code>", False)])
def test_tag_grammar(spark, text, want):
    assert one(spark, T.tags_valid(T.tag_tokens(F.lit(text)))) == [want]


def test_tag_grammar_against_a_stack(spark):
    import random
    import re
    rng = random.Random(1)
    parts = ["<Code>", "</Code>", "<Answer>", "</Answer>", "\n", " ", "x", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)]

    def check(s):
        open_tag = None
        for close, name in re.findall(r"(?m)^[ \t]*<(/?)(Analyze|Understand|Code|Execute|Answer)>", s):
            if bool(close) != (open_tag is not None) or (close and open_tag != name):
                return False
            open_tag = None if close else name
        return open_tag is None

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.tags_valid(T.tag_tokens("t")).alias("ok")).collect()
    assert {r.i: r.ok for r in got} == {i: check(t) for i, t in enumerate(texts)}


def test_lines_and_space(spark):
    text = "a" * 31 + "\r\n" + " " + "a" * 31 + "\x0b" + "a" * 31 + " 　" + "a" * 31
    got = one(spark, T.long_line_copies(F.lit(text)), T.squash(F.lit("　 a\x1fb\t c ")), F.size(T.words(F.lit(" \n"))), T.count_of(F.lit("``````x"), "```"))
    assert got == [4, " ".join("　 a\x1fb\t c ".split()), 0, 2]


@pytest.mark.parametrize("text,want", [(r"\boxed{\frac{1}{2}} and \boxed{x_{1}}", "x_{1}"), (r"\fbox{3}", "3"), ("none", None), (r"\boxed{open", None)])
def test_last_boxed(spark, text, want):
    assert one(spark, W.last_boxed(F.lit(text))) == [want]


@pytest.mark.parametrize("eq,target,want", [("(1 + 2) * 3 = 9", 9, 1), ("1 + 2 + 3", 9, 0), ("3 ** 2 * 1", 9, 1), ("(3 - 2) / 1", 1, 1), ("3 / (2 - 1 - 1)", 1, 0), ("9", 9, 0), ("3*2+import 1", 7, 0)])
def test_countdown(spark, eq, target, want):
    nums = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, W.countdown(F.lit(f"so <answer>{eq}</answer>"), F.lit(target), nums)) == [want]


def test_tool_scores(spark):
    gold = '<tool_call>{"name": "f", "parameters": {"x": 1, "y": 2}}</tool_call>'
    near = '<tool_call>{"name": "f", "parameters": {"x": 1}}</tool_call>'
    # names 1, keys 1/2, one value right of 1 + 1 + 2 possible
    got = one(spark, W.tool_correctness(F.lit(gold), F.lit(gold)), W.tool_correctness(F.lit(near), F.lit(gold)), W.tool_correctness(F.lit("x"), F.lit(gold)), W.tool_correctness(F.lit("x"), F.lit("none")))
    assert got == [3, pytest.approx(6 * 2.5 / 4 - 3), -3, 0]


def test_repetition_and_length_scores(spark):
    got = one(spark, W.repetition_penalty(F.lit("a b c a b c a b c")), W.repetition_penalty(F.lit("a b")), W.soft_overlong(F.lit(95), 100, 20), W.soft_overlong(F.lit(10), 100, 20),
              W.cosine_length(F.lit(0), F.lit(1.0)), W.cosine_length(F.lit(1000), F.lit(0.0)))
    assert got == [pytest.approx(-(1 - 3 / 7)), 0, -0.75, 0, 1.0, 0.0]


def test_loss_spans(spark):
    spans, = one(spark, W.loss_scale_spans(F.lit("hi Action: go Observation: x"), {"Action:": (2.0, 3.0), "Observation:": (2.0, 0.0)}))
    assert [tuple(s) for s in spans] == [("hi ", 1), ("Action:", 2), (" go ", 3), ("Observation:", 2), (" x", 0)]


@pytest.mark.parametrize("pred,gold,want", [("1,234", "1234", True), ("12", "12 days", True), ("b, a", "a|b", True), ("Café", "cafe", True), ("7 days", "1 week", True), ("x", "y", False), ("5.50", "5.5", True)])
def test_wikitq(spark, pred, gold, want):
    assert one(spark, N.wikitq_match(F.lit(pred), F.lit(gold))) == [want]


@pytest.mark.parametrize("pred,gold,want", [("$5.2 million", "5.2", True), ("12.31%", "12.3%", True), ("12%", "0.12", False), ("104", "100", True), ("110", "100", False), ("yes", "Yes", True), ("", "1", False)])
def test_finqa(spark, pred, gold, want):
    assert one(spark, N.finqa_match(F.lit(pred), F.lit(gold))) == [want]


@pytest.mark.parametrize("text,want", [("Yes", True), ("No way", False), ("Yes and No\nyes", True), ("Yes No\nNO", False), ("Yes No no\nwell", False), ("", False)])
def test_yes_no(spark, text, want):
    assert one(spark, N.parse_yes_no(F.lit(text))) == [want]


def test_span_scores(spark):
    data = [(["5.2"], "million", ["5.2"], "million", "arithmetic"), (["red house"], "", ["the red house"], "", "span"), (["a"], "", ["b"], "", "span"), (["12.5%"], "", ["12.5"], "percent", "arithmetic"), ([], "", ["x"], "", "span"),
            (["red and blue"], "", ["red", "blue"], "", "multi-span"), (["b; a | c"], "", ["a", "b", "c"], "", "multi-span"), (["1,200 and x"], "", ["x", "1200"], "", "multi-span"), (["3.0"], "", ["3"], "", "count"),
            (["$(134)"], "", ["-134"], "", "span"), (["2 million"], "", ["2000000"], "", "arithmetic"), (["a cat sat"], "", ["cat ran"], "", "span")]
    d = spark.createDataFrame(data, "p array<string>, ps string, g array<string>, gs string, k string")
    got = [tuple(r.s) for r in d.select(E.span_scores("p", "ps", "g", "gs", "k").alias("s")).collect()]
    assert got == [(1, 1), (1, 1), (0, 0), (1, 1), (0, 0), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (0, .5)]


def test_bleu_and_rouge(spark):
    a, b = "the cat sat on the mat", "the cat sat on a mat"
    d = spark.createDataFrame([(a, b), (a, a), (a, "")], "p string, g string")
    bleu = [r.x for r in d.select(E.bleu4(F.array("p"), F.col("g")).alias("x")).collect()]
    assert bleu[1] == pytest.approx(1) and bleu[2] == 0
    assert bleu[0] == pytest.approx(math.exp((math.log(5 / 6) + math.log(3 / 5) + math.log(2 / 4) + math.log(1 / 3)) / 4))
    rows = [r.s for r in d.select(E.rouge_bleu("p", "g").alias("s")).collect()]
    assert rows[1].rougel == 1 and rows[0].rougel == pytest.approx(5 / 6 * 1) and rows[0].rouge1 == pytest.approx(2 * 5 / (5 + 6)) and rows[2].rouge1 is None


def test_gate(spark):
    h = spark.createDataFrame([("r", 1, 23, 31, 31, 1), ("r", 2, 27, 31, 31, 1), ("r", 3, 27, 31, 31, 1), ("r", 4, 31, 31, 31, 1)], "run string, step int, passed int, has_code int, ended int, repetitive int")
    got = {r.step: (r.severe, r.moderate, r.stop, r.best) for r in E.dev_gate(h, dict(passed=31, has_code=31, ended=31, repetitive=1)).collect()}
    assert got == {1: (True, True, True, False), 2: (False, True, True, False), 3: (False, True, True, False), 4: (False, False, False, True)}


def test_table_questions(spark):
    orders = spark.createDataFrame([(1, 1, "Jan", 100), (2, 2, "Jan", 200), (3, 1, "Feb", 150), (4, 3, "Feb", 50), (5, 2, "Mar", 300), (6, 3, "Mar", 200)], "order_id int, customer_id int, month string, amount int")
    people = spark.createDataFrame([(1, "East"), (2, "West"), (3, "East")], "customer_id int, region string")
    dirty = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 30), (5, 1000)], "id int, value int")
    t = B.totals(orders, "amount").first()
    assert (t["count"], t.total, round(t["mean"], 2)) == (6, 1000, 166.67)
    assert {r.region: r.total for r in B.join_totals(orders, people, "customer_id", "region", "amount").collect()} == {"East": 500, "West": 500}
    c = B.totals(B.clean_rows(dirty, "value", 100), "value").first()
    assert (c["count"], c["mean"]) == (3, 20)
    assert [(r.month, r.total, r.share) for r in B.ordered_totals(orders, "month", ["Jan", "Feb", "Mar"], "amount").collect()] == [("Jan", 300, .3), ("Feb", 200, .2), ("Mar", 500, .5)]


def test_csv_keeps_empty_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nNA,\n,x\n")
    got = io.read_records(spark, str(tmp_path / "a.csv"), "csv", "a string, b string").collect()
    assert [tuple(r) for r in got] == [("NA", ""), ("", "x")]


def test_json_array_must_be_whole(spark, tmp_path):
    (tmp_path / "ok.json").write_text('[\n{"a": 1},\n {"a": 2}]')
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a":')
    assert [r.a for r in io.read_json_array(spark, str(tmp_path / "ok.json"), "a int").collect()] == [1, 2]
    with pytest.raises(Exception):
        io.read_json_array(spark, str(tmp_path / "cut.json"), "a int").collect()


def test_bucket_edges(spark):
    got = one(spark, *[S.bucket_lengths(F.lit(n)) for n in (2048, 2049, 4096, 4097, 8192, 8193)])
    assert got == ["0-2048", "2049-4096", "2049-4096", "4097-8192", "4097-8192", None]


def test_reward_registry():
    assert {"format", "toolbench", "math", "cosine", "repetition", "soft_overlong", "react_format"} <= set(W.REWARDS)
    W.register_reward("always", lambda c: F.lit(1.0))
    assert "always" in W.REWARDS


def test_tool_call_variants(spark):
    calls = lambda *xs: "<tool_call>\n" + "\n".join(xs) + "\n</tool_call>"
    f, g = '{"name": "f", "parameters": {"x": 1, "y": %d}}', '{"name": "g", "parameters": {}}'
    gold, pred = F.lit(calls(f % 2, g)), F.lit(calls(g, f % 3))
    # names agree, f has its names and one of two values, g all it can: 4 of 5.  In order the names differ: 3 of 5.  As whole calls: names and g, 2 of 3.
    got = one(spark, *[W.tool_correctness(pred, gold, **kw) for kw in ({}, {"exact": True}, {"grain": "call"}, {"grain": "all"}, {"high": 1.0, "low": -1.0})],
              W.tool_correctness(F.lit(calls(f % 2, g)), gold, grain="all"), W.tool_correctness(F.lit("<tool_call>[1]</tool_call>"), gold))
    assert [round(x, 9) for x in got] == [1.8, 0.6, 1.0, -3.0, 0.6, 3.0, -3.0]
    assert W.tool_bounds(0, scheme="two_phase") == (1.0, -1.0) and W.tool_bounds(30, scheme="two_phase") == (3.0, -3.0)
    assert W.tool_bounds(0, scheme="scheduled") == (2.0, -2.0) and W.tool_bounds(75, scheme="scheduled") == (2.5, -2.5) and W.tool_bounds(900, scheme="scheduled") == (3.0, -3.0)
