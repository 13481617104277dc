"""Named dataset recipes: how the columns of known corpora become standard records.

Each recipe maps DataFrame to DataFrame with column expressions only.  Random choices are seeded by the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .audit import MESSAGES
from .normalize import message, no_messages, pick_one, standardize_messages
from .sample import seeded_hash, unit_interval

RECIPES: dict[str, Callable[..., DataFrame]] = {}

# Prompts, prefixes, markers and word lists of the corpora.
SQL_QUERY = ("Sql Table information:\n", "Let's think step by step:\n", "\nSo the final sql is:\n")
SIMILARITY_PROMPT = ("Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.\nSentence 1: ", "\nSentence 2: ", "\nSimilarity score: ")
COUNTDOWN_PROMPT = ("Using the numbers ", ", create an equation that equals ", ".\nYou can use basic arithmetic operations (+, -, *, /) and each number can only be used once.\n"
                    "Show your work in <think> </think> tags. And return the final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 * 4 = 4 </answer>.")
HUMAN_OR_MACHINE = ("Classification Task: Are the following responses from a human or from ChatGPT?\nQuestion: ", "\nAnswer: ", "\nCategory: Human, ChatGPT\nOutput:")
QUESTION_GENERATION = ("Task: Question Generation\nContext: ", "\nAnswer: ", "\nQuestion:")
ROOM_NOTES = "\n\n【注意事项】\n1. 这是聊天室，不要发送私信给任何人\n2. 仅代表你个人说话,不要扮演其他人，只根据对话历史进行回复\n3. 长话短说，不要说太多话，不要超过50字 "
ROOM_HISTORY = "\n\n【chat history】"
BENCH_SYSTEM = "You are a helpful assistant."
BENCH_BANNED = ("moss", "human:", "assistant:", "user:")
FIREFLY_KINDS = ("ProseGeneration", "MRC", "JinYongGeneration", "TextCorrection", "ClassicalChinese", "BELLE", "StoryGeneration", "Couplet", "Cot",
                 "Dictionary", "Translation", "Program", "SentimentAnalyze", "OpenQA", "AncientPoem", "TextMatching", "NLI", "Summary",
                 "KeywordRecognition", "ProductDesc", "LyricGeneration", "Composition", "MusicComment", "NER")
GUANACO_MARKS = ("User:", "User：", "Assistant：", "Assistant:", "Asssistent:", "Assistent:", "Assistenz:")
PICTURE_QUESTIONS_ZH = ("图片中展示了什么", "讲述一下图片中内容", "告诉我里面有什么", "图片内容是啥")
PICTURE_QUESTIONS = ("Give the description of this image.", "Describe this picture", "What is the proper title of this image?")
PROMPTS = {"gpt4v": "What is the caption of this image?", "garbage": "Task: Classify household waste.", "coco2014": "please describe the image.", "aishell": "语音转文本",
           "textcaps": "What is the caption of this image?", "textcaps_emb": "", "latexocr": "Using LaTeX to perform OCR on the image.", "captcha": "recognize the content.",
           "coco": "Task: Object Detection"}
GROUNDING = {
    "grounding": {
        "en": ["<ref-object>", "The positions of <ref-object> is", "Find the positions of <ref-object>", "Where is <ref-object>", "Find <ref-object>", "Show me <ref-object>", "Detect <ref-object>",
               "Locate <ref-object>", "Tell me the location of <ref-object>", "Give the location of <ref-object>", "Provide the bounding box coordinate of <ref-object>"],
        "zh": ["<ref-object>", "<ref-object>的位置在图片中", "<ref-object>在图片中", "<ref-object>在", "找到<ref-object>的位置", "<ref-object>在哪里", "提供<ref-object>的坐标位置"]},
    "caption": {
        "en": ["<bbox>", "The object at position <bbox>", "This <bbox> is", "What is the object at <bbox>", "Describe <bbox>", "<bbox> is", "The bounding box coordinate <bbox> contains"],
        "zh": ["<bbox>", "<bbox>是什么", "<bbox>的位置包含", "描述<bbox>", "<bbox>中是", "坐标<bbox>描述了什么", "描述<bbox>中的事物"]}}
GROUNDING_ANSWER = {"grounding": "<bbox>", "caption": "<ref-object>"}
GROUNDING_CHINESE = 0.2  # share of Chinese prompts
CLEVR_SUFFIX = " Output the thinking process in <think> </think> and final answer (number) in <answer> </answer> tags."


def recipe(name: str):
    def add(fn):
        RECIPES[name] = fn
        return fn
    return add


def text(*parts) -> Column:
    """Concatenation of literals (str) and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def c(name: str) -> Column:
    return F.col(name)


def drop_prefix(x: Column, prefix: str, trim: bool = False) -> Column:
    rest = F.substring(x, F.lit(len(prefix) + 1), F.length(x))
    return F.when(x.startswith(prefix), T.strip(rest) if trim else rest).otherwise(x)


def pair(df: DataFrame, query: Column, response: Column, *keep: str) -> DataFrame:
    return df.select(*keep, query.alias("query"), response.alias("response"))


def chat(user: Column, assistant: Column) -> Column:
    return F.array(message("user", user), message("assistant", assistant))


@recipe("alpaca_zh")
def alpaca_zh(df):
    return df.withColumn("input", drop_prefix(c("input"), "输入："))


@recipe("long_alpaca")
def long_alpaca(df):
    return df.withColumn("response", drop_prefix(c("response"), "Answer: ", trim=True))


@recipe("ruozhiba")
def ruozhiba(df):
    """Title and abstract of a post without its list number, as an assistant-only row."""
    title = F.coalesce(F.when(F.coalesce(c("abs"), F.lit("")) != "", text(c("title"), "，", c("abs"))), c("title"))
    body = F.coalesce(T.found(title, r"\d+[.,\s,、](.+)"), title)
    return df.withColumn("_b", body).filter(F.coalesce(c("_b"), F.lit("")) != "").withColumn(
        "messages", F.array(message("assistant", c("_b")))).drop("_b", "title", "abs")


@recipe("math_trn")
def math_trn(df):
    return df.select("query", "response")


@recipe("ms_bench")
def ms_bench(df):
    """Default system turn removed; conversations with a banned marker dropped."""
    m = c("messages")
    lead = (F.get(m, F.lit(0))["from"] == "system") & (F.get(m, F.lit(0))["value"] == BENCH_SYSTEM)
    rest = F.when(lead, F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    banned = F.exists(rest, lambda x: F.lower(x["value"]).rlike("|".join(BENCH_BANNED)))
    return standardize_messages(df.filter(~banned).withColumn("messages", rest), "from", "value")


@recipe("msagent_mini")
def msagent_mini(df):
    """Needs a system turn that names more than one plugin."""
    first = F.get(c("messages"), F.lit(0))
    plugins = F.array_distinct(F.regexp_extract_all(first["value"], F.lit(r'\d\. \{"plugin_name": "(.+?)"'), F.lit(1)))
    return standardize_messages(df.filter((first["from"] == "system") & (F.size(plugins) > 1)), "from", "value")


@recipe("firefly")
def firefly(df):
    return df.filter(c("kind").isin(*FIREFLY_KINDS))


@recipe("text2sql")
def text2sql(df, *keep):
    a, b, d = SQL_QUERY
    return pair(df, text(a, c("sql_context"), "\n", c("sql_prompt")), text(b, c("sql_explanation"), d, c("sql")), *keep)


@recipe("toolbench")
def toolbench(df):
    m = F.transform("messages", lambda x, i: F.struct(F.when((i == 1) & x["from"].isin("caller", "conclusion"), "assistant").otherwise(x["from"]).alias("from"), x["value"].alias("value")))
    return standardize_messages(df.withColumn("messages", m), "from", "value")


@recipe("blossom_math")
def blossom_math(df, *keep):
    return pair(df, c("query"), text(c("output"), "\n\nAnswer: ", c("answer")), *keep)


@recipe("tigerbot_law")
def tigerbot_law(df, *keep):
    chapters = F.concat_ws("", "chapter1", "chapter2", "chapter3")
    return df.select(*keep, text(c("type"), "\n", c("title"), "\n", chapters, c("response")).alias("response"))


@recipe("leetcode_python")
def leetcode_python(df, *keep):
    """Problem before the fence, code and explanation behind it; without a fence the last character opens the code."""
    x = c("code_with_problem")
    at = F.locate("```python", x)
    cut = F.when(at > 0, at).otherwise(F.length(x))
    return pair(df, drop_prefix(F.substring(x, F.lit(1), cut - 1), "# "), text(T.strip(F.substring(x, cut, F.length(x))), "\n\n", c("explanation_only")), *keep)


@recipe("stsb")
def stsb(df, threshold: float | None = None):
    out = df.withColumnsRenamed({"sentence1": "query", "sentence2": "response", "score": "label"})
    return out if threshold is None else out.filter(c("label").cast("double") >= threshold)


@recipe("stsb_generate")
def stsb_generate(df, *keep):
    a, b, d = SIMILARITY_PROMPT
    return pair(df, text(a, c("sentence1"), b, c("sentence2"), d), F.format_string("%.1f", c("score").cast("double")), *keep)


@recipe("stsb_regression")
def stsb_regression(df, *keep):
    a, b, d = SIMILARITY_PROMPT
    return df.select(*keep, text(a, c("sentence1"), b, c("sentence2"), d).alias("query"), c("score").alias("label"))


@recipe("mteb_rerank")
def mteb_rerank(df, *keep):
    """One row per positive; the negatives stay a list."""
    return df.select(*keep, "query", F.explode("positive").alias("response"), c("negative").alias("rejected_response"))


def parse_turns(raw: Column, repairs: list[tuple[str, str]], schema: str) -> Column:
    for old, new in repairs:
        raw = F.replace(raw, F.lit(old), F.lit(new))
    return F.from_json(raw, schema, {"allowSingleQuotes": "true"})


@recipe("agent_instruct")
def agent_instruct(df, raw: str = "conversations"):
    m = parse_turns(c(raw), [("}\n {", "},\n {")], "array<struct<`from`:string,value:string>>")
    return standardize_messages(df.withColumn("messages", m).drop(raw), "from", "value")


@recipe("lmsys")
def lmsys(df, raw: str = "conversation"):
    m = parse_turns(c(raw), [("}\n {", "},{"), ("}\n{", "},{"), ("}{", "},{"), ("}\n  {", "},{")], MESSAGES)
    return standardize_messages(df.withColumn("messages", m).drop(raw))


@recipe("multi_role_agent")
def multi_role_agent(df):
    """The room's history becomes part of the system text; rows without a user opening or an answer are dropped."""
    m = c("conversations")
    first, last = F.get(m, F.lit(0)), F.element_at(m, -1)["value"]
    system = F.when(first["from"] == "system", first["value"]).otherwise("")
    noted = F.when(~system.contains("【注意事项】") & (system != ""), text(system, ROOM_NOTES)).otherwise(system)
    middle = F.slice(m, F.lit(2), F.greatest(F.size(m) - 2, F.lit(0)))
    history = F.array_join(F.transform(middle, lambda x: text("\n ", x["from"], ":", x["value"])), "")
    query = F.when(first["from"] == "user", first["value"]).otherwise("")
    full = F.when((first["from"] != "user") & ~system.contains("next_speakers:"), text(noted, ROOM_HISTORY, history)).otherwise(system)
    return (df.filter((query != "") & (F.coalesce(last, F.lit("")) != ""))
            .withColumn("messages", F.array(message("system", full), message("user", query), message("assistant", last))).drop("conversations"))


@recipe("countdown")
def countdown(df, *keep):
    a, b, d = COUNTDOWN_PROMPT
    nums = text("[", F.array_join(F.transform("nums", lambda n: n.cast("string")), ", "), "]")
    return df.select(*keep, "nums", c("response").alias("target"), text(a, nums, b, c("response").cast("string"), d).alias("query"))


@recipe("hc3")
def hc3(df, key: str, *keep, as_label: bool = False, seed: int = 42):
    """One human and one machine row per question, each with one of its answers."""
    a, b, d = HUMAN_OR_MACHINE

    def row(i, name, answers):
        shown = text(a, c("query"), b, pick_one(c(answers), text(c(key).cast("string"), name), seed), d)
        return F.struct(shown.alias("query"), (F.lit(i).alias("label") if as_label else F.lit(name).alias("response")))

    each = F.explode(F.array(row(0, "Human", "human_answers"), row(1, "ChatGPT", "chatgpt_answers")))
    return df.select(key, *keep, each.alias("r")).select(key, *keep, "r.*")


@recipe("dureader")
def dureader(df):
    a, b, d = QUESTION_GENERATION
    parts = F.split(c("text1"), r"\[SEP\]", -1)
    return df.withColumn("messages", chat(text(a, parts[1], b, parts[0], d), c("text2"))).drop("text1", "text2")


def transcript_turns(x: Column) -> Column:
    """Human:/Assistant: transcript to alternating turns; an unpaired last part is left out."""
    parts = F.transform(F.split(T.strip(x), "\n\nHuman:|\n\nAssistant:|\n\nHum:", -1), T.strip)
    parts = F.transform(parts, lambda p, i: F.when(i == 0, drop_prefix(p, "Human:", trim=True)).otherwise(p))

    def turns(p):
        even = F.slice(p, F.lit(1), F.size(p) - F.size(p) % 2)
        return F.transform(even, lambda t, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), t))

    return T.bind(parts, turns)


@recipe("hh_rlhf")
def hh_rlhf(df):
    return df.withColumn("messages", transcript_turns(c("chosen"))).withColumn("rejected_messages", transcript_turns(c("rejected"))).drop("chosen", "rejected")


@recipe("hh_rlhf_cn")
def hh_rlhf_cn(df):
    """context (role, text), chosen and rejected turn: the chosen turn is appended, the rejected text kept."""
    m = F.concat(c("context"), F.array(c("chosen")))
    return standardize_messages(df.withColumn("messages", m).withColumn("rejected_response", c("rejected.text")).drop("context", "chosen", "rejected"), "role", "text")


@recipe("xlam")
def xlam(df):
    calls = F.from_json(c("answers"), "array<string>")
    return df.withColumn("messages", F.concat(F.array(message("user", c("query"))), F.transform(calls, lambda x: message("tool_call", x)))).drop("query", "answers")


@recipe("xlam_grpo")
def xlam_grpo(df, key: str, seed: int = 42):
    """One call, chosen by the row, as an action text that is both answer and solution."""
    pick = pick_one(F.from_json(c("response"), "array<struct<name:string,arguments:string>>"), c(key), seed)
    action = text("Action: ", pick["name"], "\nAction Input: ", pick["arguments"])
    return df.withColumn("response", action).withColumn("solution", c("response"))


@recipe("emoji")
def emoji(df):
    for k in ("query", "response", "rejected_response"):
        df = df.withColumn(k, F.replace(c(k), F.lit("️"), F.lit("")))
    return df


@recipe("guanaco")
def guanaco(df):
    """User:/Assistant: text to alternating turns; malformed or half-empty histories are dropped."""
    marks = "|".join(GUANACO_MARKS)
    ins = c("instruction")
    keys = F.regexp_extract_all(ins, F.lit(f"({marks})"), F.lit(1))
    lead = F.get(F.split(ins, marks, 2), F.lit(0))
    bodies = F.slice(F.split(ins, marks, -1), F.lit(2), F.size(keys))
    order = F.forall(F.transform(keys, lambda k, i: F.when(i % 2 == 0, F.lower(k).contains("user")).otherwise(F.lower(k).contains("ass"))), lambda ok: ok)
    good = (ins == "") | ((lead == "") & order & (F.size(keys) % 2 == 0) & F.forall(bodies, lambda b: b != ""))
    turns = F.when(ins == "", no_messages()).otherwise(F.transform(bodies, lambda b, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), b)))
    last = chat(drop_prefix(c("input"), "User:", trim=True), c("output"))
    return df.filter(good).withColumn("messages", F.concat(turns, last)).drop("instruction", "input", "output")


@recipe("function_call_chatml")
def function_call_chatml(df):
    """Tools from the blank-line separated description; the system turn goes."""
    m = c("messages")
    tools = F.when(F.coalesce(c("function_description"), F.lit("")) != "", F.split(c("function_description"), "\n\n", -1))
    rest = F.when(F.get(m, F.lit(0))["role"] == "system", F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    return df.withColumn("tools", tools).withColumn("messages", rest).drop("function_description")


@recipe("dolly")
def dolly(df):
    lead = F.when(F.coalesce(c("context"), F.lit("")) != "", text("Here gives some useful information:\n", c("context"), "\n")).otherwise("")
    return df.withColumn("messages", chat(F.concat(lead, c("instruction")), c("response"))).drop("context", "instruction", "response")


@recipe("orpo_mix")
def orpo_mix(df):
    return df.filter(c("source") != "toxic-dpo-v0.2").withColumnsRenamed({"chosen": "messages", "rejected": "rejected_messages"})


@recipe("self_cognition")
def self_cognition(df, name: tuple[str, str] | None = None, author: tuple[str, str] | None = None, query_suffix: str = "", response_prefix: str = ""):
    """Placeholders filled by language (Chinese, other), suffix and prefix added."""
    for mark, pair_ in (("{{NAME}}", name), ("{{AUTHOR}}", author)):
        if pair_:
            value = F.when(c("tag") == "zh", pair_[0]).otherwise(pair_[1])
            for k in ("query", "response"):
                df = df.withColumn(k, F.replace(c(k), F.lit(mark), value))
    return df.withColumn("query", text(c("query"), query_suffix)).withColumn("response", text(response_prefix, c("response")))


# ---- text side of the picture, sound and video corpora

def with_prompt(name: str):
    def fn(df):
        return df.withColumn("query", F.lit(PROMPTS[name]))
    return fn


for _name in PROMPTS:
    RECIPES[_name] = with_prompt(_name)


@recipe("coco2014")
def coco2014(df):
    return with_prompt("coco2014")(df.withColumn("response", F.substring_index(c("caption"), "&&", 1)).drop("caption"))


@recipe("aishell")
def aishell(df, label: str = "Text:LABEL"):
    return with_prompt("aishell")(df.withColumn("response", F.translate(F.col(f"`{label}`"), " ", "")).drop(label))


@recipe("sa1b")
def sa1b(df, key: str, caption: str = "global_caption", nested: bool = False, seed: int = 42):
    answer = F.get_json_object(F.replace(c(caption), F.lit("'"), F.lit('"')), "$.global_caption") if nested else c(caption)
    ask = pick_one(F.array(*[F.lit(q) for q in PICTURE_QUESTIONS_ZH]), c(key), seed)
    return df.withColumn("messages", chat(ask, answer)).drop(caption)


@recipe("pixelprose")
def pixelprose(df, key: str, seed: int = 42):
    ask = pick_one(F.array(*[F.lit(q) for q in PICTURE_QUESTIONS]), c(key), seed)
    return df.withColumn("messages", chat(ask, drop_prefix(c("vlm_caption"), "This image displays:", trim=True))).drop("vlm_caption")


@recipe("egoschema")
def egoschema(df, as_label: bool = False):
    """Question with its options; the answer is the letter (or the index as a label)."""
    query = text(c("query"), "\n", F.array_join("option", "\n"))
    if as_label:
        return df.withColumn("query", query).withColumn("label", c("response").cast("int")).drop("response", "option")
    return df.withColumn("query", query).withColumn("response", F.chr(F.lit(65) + c("response").cast("int"))).drop("option")


@recipe("ocrvqa")
def ocrvqa(df, key: str, seed: int = 42):
    one = pick_one(F.arrays_zip("questions", "answers"), c(key), seed)
    return df.withColumn("messages", chat(one["questions"], one["answers"])).drop("questions", "answers")


@recipe("science_qa")
def science_qa(df):
    picked = F.get("choices", c("answer").cast("int"))
    return df.withColumn("messages", chat(c("question"), text(c("solution"), "\nSo the final answer is: ", picked))).drop("question", "choices", "answer", "solution")


@recipe("gqa")
def gqa(df):
    return df.withColumn("messages", chat(c("question"), c("fullAnswer"))).drop("question", "fullAnswer")


@recipe("coco_detection")
def coco_detection(df, categories: DataFrame):
    """Category ids of the boxes to names by a dimension table (id, name), in box order.

    Every picture and column stays: one without boxes has an empty list, null ids stay null, an unknown category has the name null.
    The dimension has one row per category (some dozens), held as one map; a category listed twice fails.
    """
    names = categories.agg(F.map_from_entries(F.collect_list(F.struct(c("id"), c("name")))).alias("_names"))
    named = df.crossJoin(F.broadcast(names))  # one-row side
    named = named.withColumn("ref", F.transform("category_ids", lambda i: F.try_element_at("_names", i)))
    return with_prompt("coco")(named.drop("_names"))


@recipe("refcoco")
def refcoco(df, key: str, task: str = "caption", images: str = "", seed: int = 42):
    """Referring expressions: the first caption and the box, rounded half to even, with a prompt for the ``task`` (``caption`` or ``grounding``) picked by the row's key.

    Adds query, response, images (the file below the folder ``images``) and objects.  Rows whose file is missing go by ``media_manifest_filter``, as elsewhere.
    """
    prompt = {lang: pick_one(F.array(*[F.lit(q) for q in GROUNDING[task][lang]]), c(key), seed) for lang in ("en", "zh")}
    share = unit_interval(seeded_hash([key], f"{seed}/language"))
    path = F.concat(F.lit(images), F.replace(c("image_path"), F.lit("coco/train2014"), F.lit("train2014")))
    objects = F.struct(F.array(F.get("captions", F.lit(0))).alias("ref"), F.array(F.transform("bbox", lambda x: F.bround(x.cast("double"), 0).cast("int"))).alias("bbox"))
    out = df.withColumns({"query": F.when(share < GROUNDING_CHINESE, prompt["zh"]).otherwise(prompt["en"]), "response": F.lit(GROUNDING_ANSWER[task]), "images": F.array(path), "objects": objects})
    return out.drop("captions", "bbox", "image_path")


@recipe("clevr")
def clevr(df):
    return df.withColumn("query", text(F.coalesce(c("query"), F.lit("")), CLEVR_SUFFIX))
