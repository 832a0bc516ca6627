import re

import pytest
from pyspark.sql import functions as F

from winnow import constants as K
from winnow.functions import text as X


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r[1] for r in rows.select("n", column(F.col("t"))).orderBy("n").collect()]


def test_strip_equals_python(spark):
    texts = [" a ", "\t\n a\u3000", "\x1c\x1d\x1e\x1fa\x85", "\u00a0\u2003x y\u2028", "", "   ", "\u200bz"]
    assert values(spark, texts, X.strip) == [t.strip() for t in texts]


def test_format_score_equals_python_pattern(spark):
    good = "<think>a\nb</think>\n <answer>x \\boxed{1} y</answer>"
    texts = [
        good, good + "\n", good + "\n\n", " " + good, good + "\r", good + "\u2028", good + "x",
        "<think></think><answer>\\boxed{}</answer>",
        "<think>a</think>\u3000<answer>\\boxed{1}</answer>",
        "<think>a</think> b <answer>\\boxed{1}</answer>",
        "<think>a</think> <answer>boxed{1}</answer>",
    ]
    expected = [0.25 if re.match(K.FORMAT_PATTERN, t, re.DOTALL) else 0.0 for t in texts]
    assert values(spark, texts, X.format_score) == expected
    assert 0.25 in expected and 0.0 in expected


@pytest.mark.parametrize(
    "text, letter",
    [
        ("work... \\boxed{C}", "C"),
        ("The final answer is (D).", "D"),
        ("Compare A and B before deciding.", None),
        ("\\boxed{ a } then \\boxed{b}", "B"),
        ("answer is A, no: answer: (e)", "E"),
        ("answer is Apple", None),
        ("answer is A but \\boxed{D}", "D"),
    ],
)
def test_choice(spark, text, letter):
    assert values(spark, [text], X.answer_choice) == [letter]


@pytest.mark.parametrize(
    "question, choices",
    [
        ("Pick (A) 1 (B) 2", {"A": "1", "B": "2"}),
        ("(A) x. (B) y... (C) z\n", {"A": "x", "B": "y", "C": "z"}),
        ("(A) old (B) b (A) new", {"A": "new", "B": "b"}),
        ("(A) 2 apples (big) (B) 3", {"B": "3"}),
        ("none here", {}),
        ("(A)two\nlines (B) end", {"A": "two\nlines", "B": "end"}),
    ],
)
def test_choices_map(spark, question, choices):
    """Expected maps follow the rule: text up to the next choice or the end, no open bracket."""
    (found,) = values(spark, [question], X.answer_choices)
    assert [(c["letter"], c["value"]) for c in found] == list(choices.items())


def test_number(spark):
    texts = ["1,234.5 then 7", "-3", "v2.", "none", "total 12,000", "5-3"]
    assert values(spark, texts, X.answer_number) == [7.0, -3.0, 2.0, None, 12000.0, -3.0]


def test_boxed_nesting(spark):
    texts = ["\\boxed{1} \\boxed{\\frac{1}{2}}", "\\boxed{\\frac{\\sqrt{2}}{2}}", "\\boxed{}", "x"]
    assert values(spark, texts, X.answer_boxed) == ["\\frac{1}{2}", None, None, None]
    assert values(spark, texts, X.last_box) == ["\\frac{1}{2}", "\\frac{\\sqrt{2}}{2}", None, None]


@pytest.mark.parametrize("depth", range(1, 12))
def test_box_of_any_depth(spark, depth):
    nested = "2"
    for _ in range(depth - 1):
        nested = "\\sqrt{1+" + nested + "}"
    assert values(spark, ["\\boxed{12} but \\boxed{" + nested + "} }{"], X.last_box) == [nested]


def test_odd_boxes(spark):
    texts = [
        "\\boxed{open \\boxed{3}",
        "\\boxed{1} \\boxed{",
        "\\boxed{1} \\boxed{}",
        "\\boxed{\\boxed{4}+1}",
        "} } \\boxed{ \u00e9\U0001f600 } {",
        "\\boxed \\\\boxed{5}",
        "",
        None,
    ]
    expected = ["3", "1", "1", "\\boxed{4}+1", "\u00e9\U0001f600", "5", None, None]
    assert values(spark, texts, X.last_box) == expected
    long = "x{y}" * 20_000
    assert values(spark, ["\\boxed{" + long + "}" + long], X.last_box) == [long]


def test_names(spark):
    names = ["AIME", "aime-25", "Math 500 test", "AMC", "GSM8K", "AIME2025"]
    expected = ["aime2025", "aime2025", "math500", "amc23", "gsm8k", "aime2025"]
    assert values(spark, names, X.canonical_name) == expected
    paths = ["aime2025/test.json", "/d/AMC 23/test.jsonl", "file:///x/gsm8k/a.parquet", "math500.json"]
    assert values(spark, paths, X.name_from_path) == ["aime2025", "amc23", "gsm8k", "math500"]
    parts = ["a b/c", "__", "m-1.5_x", "?"]
    assert values(spark, parts, X.safe_component) == ["a_b_c", "model", "m-1.5_x", "model"]
    methods = values(spark, ["GSM8K", "aqua", "aime", "MultiArith"], X.grading_method)
    assert methods == ["simple_number", "multiple_choice", "latex", "simple_number"]


def test_prompts(spark):
    (plain,) = values(spark, ["question"], lambda c: X.render_plain_prompt(c, "system"))
    assert plain == "system: system\n\nuser: question\n\nassistant:"
    with pytest.raises(ValueError, match="template"):
        X.render_chat_prompt(F.lit("q"), None, strict=True)
    (chat,) = values(
        spark,
        ["q"],
        lambda c: X.render_chat_prompt(
            c, "s", turn_prefix="[{role}]", turn_suffix=";", generation_prefix="[assistant]"
        ),
    )
    assert chat == "[system]s;[user]q;[assistant]"


def test_instruction_form(spark):
    (text,) = values(spark, ["do"], lambda c: X.render_instruction(c, F.lit("done")))
    assert text.splitlines() == [
        "Below is an instruction that describes a task. "
        "Write a response that appropriately completes the request.  ",
        "",
        " " * 16 + "#### Instruction:",
        " " * 16 + "do",
        " " * 16,
        " " * 16 + "#### Response:",
        " " * 16 + "done",
    ]
