import math

import pytest
from pyspark.sql import functions as F

from curlew.functions import rollouts, scores, text, vectors


def one(spark, column, **fields):
    row = spark.createDataFrame([tuple(v for v, _ in fields.values())], ", ".join(f"{k} {t}" for k, (_, t) in fields.items())) if fields else spark.range(1)
    return row.select(column.alias("x")).first().x


def S(v):
    return (v, "string")


@pytest.mark.parametrize(("raw", "expected"), [("x\n\t ", "x"), ("  a b", "a b"), ("", ""), (None, None)])
def test_strip(spark, raw, expected):
    assert one(spark, text.strip("t"), t=S(raw)) == expected


@pytest.mark.parametrize(("path", "name"), [("/a/b/qa_low.jsonl", "qa"), ("/a/_low.jsonl", "_low"), ("mcq.json", "mcq")])
def test_dataset_from_path(spark, path, name):
    assert one(spark, text.dataset_from_path("t"), t=S(path)) == name


def test_pair_texts(spark):
    assert one(spark, text.qa_pair("p", "a"), p=S("x\r\ny "), a=S(None)) == "Q: x\ny\n A: "
    assert one(spark, text.prompt_answer("p", "a", "c"), p=S("x"), a=S(None), c=S("y")) == "x\ny"
    assert one(spark, text.prompt_answer("p", "a", "c"), p=S(" "), a=S(None), c=S(None)) is None
    assert one(spark, text.instruction_text_of_record("p", "c", "i", "o"), p=S(None), c=S(None), i=S("in"), o=S("out")) == "Instruction: in\nAnswer: out"
    assert one(spark, text.without_answer_line("p"), p=S("Q?\nA) 1\nanswer : B ")) == "Q?\nA) 1"


def test_generation_parts(spark):
    g = "<THINK> a\nb </THINK> <answer>c</answer> tail"
    cot, out = text.generated_parts("g")
    assert one(spark, cot, g=S(g)) == "a\nb"
    assert one(spark, out, g=S(g)) == "c"
    assert one(spark, out, g=S(" plain ")) == "plain"
    assert one(spark, text.until_answer_end("g"), g=S(g)) == "<THINK> a\nb </THINK> <answer>c</answer>"
    assert one(spark, text.answer_content("g"), g=S("<ANSWER>x</ANSWER>")) == "<ANSWER>x</ANSWER>"
    assert one(spark, text.answer_content("g"), g=S(" \n plain\t")) == "plain"


def test_roles_and_preferences(spark):
    assert one(spark, text.split_by_roles("t", ["Human", "Assistant"]), t=S("Human: a Assistant: b Human: c")) == {"Human": ["a", "c"], "Assistant": ["b"]}
    got = one(spark, text.preference_suffixes("a", "b"), a=(["x", "y", "z"], "array<string>"), b=(["x", "n", "m"], "array<string>"))
    assert [(r.turn, r.chosen, r.rejected) for r in got] == [(2, ["y", "z"], ["n", "m"]), (3, ["z"], ["m"])]
    got = one(spark, text.preference_suffixes("a", "b"), a=(["x"], "array<string>"), b=(["x"], "array<string>"))
    assert [(r.turn, r.chosen) for r in got] == [(1, ["x"])]
    assert one(spark, text.last_words("t", 2), t=S("a b c")) == "b c"


def test_names():
    nested = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert text.flatten_names(nested) == {"a/b": 1, "a/c/d": 2, "e": 3}
    assert text.unflatten_names(text.flatten_names(nested)) == nested


@pytest.mark.parametrize(("raw", "number"), [("so 1,234 then -5", "5"), ("x -2.5.", "-2.5"), ("none", "none")])
def test_last_number(spark, raw, number):
    assert one(spark, text.last_number("t"), t=S(raw)) == number


def test_answers(spark):
    assert one(spark, text.stated_answer("t"), t=S("So the answer is (B). ok")) == "(B)"
    assert one(spark, text.reference_number("t"), t=S("work #### 1,200")) == "1200"
    assert one(spark, text.reference_answers("t"), t=S("a; b.;")) == ["a.", "b."]
    assert one(spark, text.trim_answer("t"), t=S("A: yes\n\nindeed Q: next")) == "yes indeed"
    assert one(spark, text.question_prompt("q", ["a", "b"]), q=S("Q"), a=S("1"), b=S("2")) == "Q\nA. 1\nB. 2\nAnswer:"


REPLIES = [
    ('{"Rarity": 1, "Complexity": 2, "Informativeness": 3, "Overall rating": 8}', [1, 2, 3, 8]),
    ('Sure: {"Rarity": 1, "Overall": 5} ok', [1, 0, 0, 5]),
    ('[{"Rarity": 4}] {"Rarity": 1}', [4, 0, 0, 0]),
    ('{"Rarity": {"x": 1}}', [0, 0, 0, 0]),
    ("[note] {\"Rarity\": 2}", [0, 0, 0, 0]),
    ("exception", [0, 0, 0, 0]),
    (None, [0, 0, 0, 0]),
]


@pytest.mark.parametrize(("raw", "expected"), REPLIES)
def test_parse_scores(raw, expected):
    assert scores.parse_scores(raw)[0] == expected


def test_parse_last_scores():
    full = '{"Rarity": 1, "Complexity": 2, "Informativeness": 3, "Overall rating": 8}'
    assert scores.parse_scores('{"x": 1} ' + full, last=True) == [[1, 2, 3, 8]]
    assert scores.parse_scores(full + ' {"Rarity": 1}', last=True) == [[0, 0, 0, 0]]


def test_compress(spark):
    got = spark.createDataFrame([(v,) for v in (0, 4, 5, 8, 9, 10)], "v int").select(scores.compress("v").alias("c")).collect()
    assert [r.c for r in got] == [0, 0, 1, 4, 5, 5]


def test_whole_score(spark):
    got = spark.createDataFrame([("4",), ("2.5",), ("3.5",), ("x",), (None,)], "v string").select(scores.whole_score("v").alias("c")).collect()
    assert [r.c for r in got] == [4, 2, 4, None, None]


@pytest.mark.parametrize(("source", "id_", "task"), [("MCQ ", "x", "mcq"), ("web", "a-tfq:1", "tfq"), (None, "cs qa", "qa"), (None, None, "qa")])
def test_task_type(spark, source, id_, task):
    assert one(spark, scores.task_type("s", "i"), s=S(source), i=S(id_)) == task


def test_rewards(spark):
    r = "<think>a</think><answer>Q: x A: y</answer>"
    assert one(spark, scores.format_reward("r", F.lit("qa")), r=S(r)) == 1.0
    assert one(spark, scores.format_reward("r", F.lit("mcq_x")), r=S(r)) == 0.5
    assert one(spark, scores.format_reward("r", F.lit("qa_x")), r=S(r)) == 1.0
    assert one(spark, scores.format_reward("r", F.lit("para")), r=S(None)) == 0.5
    assert one(spark, scores.math_accuracy("r", F.lit("1/2")), r=S("so \\boxed{1 / 2}")) == 1.0
    assert one(spark, scores.math_format_reward("r"), r=S("<think> a </think> \\boxed{1}")) == 1.0
    assert one(spark, scores.tagged_accuracy("r", F.lit("7")), r=S("<answer> 7 </answer>")) == 1.0
    assert one(spark, scores.final_answer_accuracy("r", F.lit("\\frac{1}{2}")), r=S("Answer: 3\nAnswer: $\\frac12$")) == 1.0
    assert one(spark, scores.final_answer_accuracy("r", F.lit("3")), r=S("no answer")) == -1.0
    with pytest.raises(ValueError, match="more than 0"):
        scores.normal_weights(0, 0, 0)


@pytest.mark.parametrize(("raw", "normal"), [("x = 1,200 dollars", "1200"), ("\\text{yes}", "yes"), ("\\sqrt3", "\\sqrt{3}"), ("a \\boxed{5}", "5")])
def test_normal_final_answer(spark, raw, normal):
    assert one(spark, scores.normal_final_answer("t"), t=S(raw)) == normal


def test_vectors(spark):
    d = "array<double>"
    assert one(spark, vectors.cosine_distance("a", "b"), a=([1.0, 0.0], d), b=([0.0, 2.0], d)) == 1.0
    assert one(spark, vectors.normalised("a"), a=([0.0, 0.0], d)) == [0.0, 0.0]
    assert one(spark, vectors.rounded("a", 0), a=([0.5, 1.5, -0.5], d)) == [0.0, 2.0, 0.0]
    assert one(spark, vectors.mean_pool("t", "m"), t=([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], "array<array<double>>"), m=([1, 1, 0], "array<int>")) == [2.0, 3.0]


def test_token_expressions(spark):
    i, d = "array<bigint>", "array<double>"
    assert one(spark, rollouts.response_mask("a", 2), a=([5, 2, 7, 2], i)) == [1, 1, 0, 0]
    assert one(spark, rollouts.response_mask("a", 9), a=([5, 2], i)) == [1, 1]
    assert one(spark, rollouts.position_ids("a"), a=([0, 0, 1, 1], i)) == [0, 0, 0, 1]
    assert one(spark, rollouts.token_reward(F.lit(2.0), F.lit(2), F.lit(3))) == [0.0, 2.0, 0.0]
    assert one(spark, rollouts.discounted_returns("r", "m", 0.5), r=([1.0, 1.0, 4.0], d), m=([1, 1, 1], "array<int>")) == [2.5, 3.0, 4.0]
    assert one(spark, rollouts.gae("r", "v", 1.0, 1.0), r=([0.0, 1.0], d), v=([0.5, 0.25], d)) == [0.5, 0.75]
    assert one(spark, rollouts.padded("a", 4, 0, left=True), a=([1, 2], i)) == [0, 0, 1, 2]
    assert one(spark, rollouts.padded("a", 2, 0, left=True), a=([1, 2, 3], i)) == [2, 3]
    assert one(spark, rollouts.padded("a", 2, 0), a=([1, 2, 3], i)) == [1, 2]
    assert one(spark, rollouts.prompt_masked("a", F.lit(2)), a=([4, 5, 6], i)) == [-100, -100, 6]
    assert one(spark, rollouts.subsequence_at("a", [5, 6]), a=([4, 5, 6], i)) == 2
    assert one(spark, rollouts.subsequence_at("a", [7]), a=([4], i)) == 0


def test_losses(spark):
    d = "array<double>"
    got = one(spark, rollouts.policy_loss("o", "n", "a"), o=([0.0, 0.0], d), n=([1.0, 2.0], d), a=([1.0, -1.0], d))
    assert got == pytest.approx([-1.2, 3.0])
    assert one(spark, rollouts.value_loss("p", "r", "v"), p=([2.0], d), r=([0.0], d), v=([0.0], d)) == [2.0]
    assert one(spark, rollouts.kl_penalty("o", "n", "low_var_kl"), o=([0.0], d), n=([1.0], d)) == pytest.approx([math.e - 2])
    mc = one(spark, rollouts.multiple_choice(F.lit(-1.0), "t", "f"), t=([-1.0, -3.0], d), f=([-2.0], d))
    assert (mc.mc1, mc.mc3) == (1.0, 0.5)


@pytest.mark.parametrize("style", sorted(text.CHAT_STYLES))
def test_chat_styles(spark, style):
    m = [("system", "s"), ("user", "u"), ("assistant", "a"), ("tool", "t")]
    got = one(spark, text.chat("m", style), m=(m, "array<struct<role: string, content: string>>"))
    marks = text.CHAT_STYLES[style]
    parts = "".join(marks[r][0] + c + marks[r][1] for r, c in m if r in marks)
    assert got == marks["open"] + parts + marks["close"]


def test_overall_rating_falls_back():
    from curlew.functions.scores import parse_scores

    for first in ("0", "null"):
        assert parse_scores('{"Rarity": 1, "Complexity": 2, "Informativeness": 3, "Overall rating": %s, "Overall": 7}' % first) == [[1, 2, 3, 7]]
    assert parse_scores('x { y {"Rarity": 3, "Complexity": 4, "Informativeness": 5, "Overall": 6} z') == [[3, 4, 5, 6]]
    assert parse_scores('[ open {"Rarity": 3} {"Rarity": 4}') == [[3, 0, 0, 0]]
    assert parse_scores('{"Rarity": 3, "Complexity": 1, "Informativeness": 1, "Overall rating": 1} {"Rarity": 4, "Complexity": 1, "Informativeness": 1, "Overall rating": 1} {', last=True) == [[4, 1, 1, 1]]
