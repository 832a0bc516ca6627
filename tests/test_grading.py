import os
import re
import time

import pytest
from pyspark.sql import functions as F

from winnow.functions import grading as G
from winnow.operators import grade, metrics


def verdicts(spark, rows, **options):
    df = spark.createDataFrame(
        [(n, *r) for n, r in enumerate(rows)], "n int, response string, answer string, question string"
    )
    out = grade.with_verdict(df, **options).orderBy("n").collect()
    return [r["verified"] for r in out]


@pytest.mark.parametrize(
    "response, answer, verdict",
    [
        ("\\boxed{12}", "12", True),
        ("\\boxed{12}", "$12$", True),
        ("\\boxed{12.0}", "12", True),
        ("\\boxed{\\frac{1}{2}}", "0.5", True),
        ("\\boxed{\\dfrac12}", "\\frac{1}{2}", True),
        ("\\boxed{-\\frac{3}{4}}", "-0.75", True),
        ("\\boxed{3/4}", "\\frac{3}{4}", True),
        ("\\boxed{1,000}", "1000", True),
        ("\\boxed{x = 5}", "5", True),
        ("\\boxed{5\\text{ cm}}", "5", True),
        ("\\boxed{\\text{Evelyn}}", "Evelyn", True),
        ("\\boxed{90^\\circ}", "90", True),
        ("\\boxed{\\left( 3, \\frac{\\pi}{2} \\right)}", "(3,\\frac{\\pi}{2})", True),
        ("\\boxed{0.3333333}", "1/3", True),
        ("\\boxed{13}", "12", False),
        ("first \\boxed{12} last \\boxed{13}", "12", False),
        ("no answer at all", "12", False),
        ("\\boxed{x+1}", "1+x", True),
        ("\\boxed{(x+1)^2}", "x^2+2x+1", None),
        ("the answer is $12$", "12", None),
        ("\\boxed{12}", " $ ", None),
    ],
)
def test_native_math(spark, response, answer, verdict):
    assert verdicts(spark, [(response, answer, "q")]) == [verdict]


FORMS = [
    ("2x+1", "1+2x", True), ("x+1", "x+2", False), ("x+1", "y+1", None), ("xy", "y\\cdot x", True), ("x+x", "2x", True),
    ("3-2i", "-2i+3", True), ("3-2i", "3+2i", False), ("x^2", "x*x", None), ("x^{2}+1", "1+x^2", True), ("-\\frac{3}{4}x", "-0.75x", True),
    ("1e3", "1000", True), ("1e3", "1001", False), ("1.5e-3", "0.0015", True), ("2\\times10^{3}", "2000", True), ("10^{-2}", "0.01", True),
    ("\\sqrt{12}", "2\\sqrt3", True), ("\\sqrt{2}", "1.5", False), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}", True),
    ("2\\pi", "\\pi\\cdot 2", True), ("2\\pi", "3\\pi", False), ("\\frac{\\pi}{2}", "\\pi/2", True), ("\\frac{x}{2}+y", "y+x/2", True),
    ("50\\%", "0.5", True), ("50\\%", "50", None), ("50\\%", "50.0\\%", True), ("50\\%", "60\\%", False),
    ("(1,2)", "(2,1)", False), ("\\left(x+1, \\frac{1}{2}\\right)", "(1+x,0.5)", True), ("(1,2)", "[1,2]", False), ("(1,2]", "(1,\\frac{4}{2}]", True),
    ("\\{1,2,3\\}", "\\{3,2,1\\}", True), ("\\{1,2\\}", "\\{1,3\\}", False), ("\\{1,1\\}", "\\{1\\}", None), ("1,2", "2,1", None), ("1,2", "1,3", False),
    ("(-\\infty,3)\\cup(5,\\infty)", "(-\\infty, 6/2)\\cup(5,\\infty)", True), ("(-\\infty,2)", "(-\\infty,3)", False), ("x\\in[1,2]", "[1,4/2]", True),
    ("\\text{Evelyn}", "\\text{Alice}", None), ("listen", "silent", None), ("5cm", "5", None), ("3!", "6", None), ("1/0", "2", None),
    ("\\sin x", "\\cos x", None), ("2(x+1)", "2x+2", None), ("x_1", "x_2", None), ("x<3", "x>3", None), ("\\begin{pmatrix}1\\\\2\\end{pmatrix}", "1", None),
    ("0", "x-x", True), ("e", "2.718281828", None), ("\\frac{3}{x}", "3/x", True), ("(5)", "5", True), ("1e999", "1e998", None), ("x^2+", "x^2", None),
]


def test_canonical_forms_decide_both_ways_round(spark):
    rows = [(f"\\boxed{{{a}}}", b) for a, b, _ in FORMS] + [(f"\\boxed{{{b}}}", a) for a, b, _ in FORMS]
    got = verdicts(spark, [(*r, "q") for r in rows])
    assert [(r, g) for r, g in zip(rows, got)] == [(r, f[2]) for r, f in zip(rows, FORMS * 2)]


def test_choice_of_an_equal_form(spark):
    question = "Which? (A) x+2 (B) 1+2x (C) 1000"
    rows = [("\\boxed{2x+1}", "B", question), ("\\boxed{2x+1}", "A", question), ("\\boxed{1e3}", "C", question), ("\\boxed{y}", "A", question)]
    assert verdicts(spark, rows) == [True, False, True, None]


def test_choice_answers(spark):
    question = "Which? (A) 10 (B) \\frac{1}{2} (C) 0.5 (D) 7 (E) none"
    rows = [
        ("\\boxed{A}", "A", question),
        ("\\boxed{B}", "a", question),
        ("the answer is (D)", "$D$", question),
        ("\\boxed{7}", "D", question),
        ("\\boxed{1/2}", "B", question),
        ("\\boxed{0.5}", "C", question),  # the first choice of that value is B
        ("\\boxed{99}", "A", question),  # no choice: falls through to math, 99 against A
        ("nothing", "A", question),
    ]
    assert verdicts(spark, rows) == [True, False, True, True, True, False, None, False]


def test_number_check(spark):
    rows = [("it is 1,234", "1234", True), ("12.0005", "12", True), ("12.01", "12", False),
            ("none", "abc", False), ("5", "abc", None), ("5", "5d", None), ("5", " 5e0 ", True),
            ("5", "nan", False), ("5", "5_0", False)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, t string, g string, e boolean")
    out = df.select("n", "e", G.verify_number(F.col("t"), F.col("g")).alias("v")).orderBy("n").collect()
    assert [r["v"] for r in out] == [r["e"] for r in out]


def test_external_grader(spark):
    def grader(response, answer):
        if response == "slow":
            time.sleep(30)
        if response == "bad":
            raise KeyError("x")
        return {"acc": response == answer} if response.startswith("d") else response == answer

    rows = [("a", "a"), ("a", "b"), ("d", "d"), ("d", "e"), ("bad", ""), ("slow", "")]
    df = spark.createDataFrame(rows, "response string, answer string").coalesce(1)
    out = grade.with_external_verdict(df, grader, timeout=0.5).collect()
    assert [r["verified"] for r in out] == [True, False, True, False, None, None]
    assert [r["grader_error"] for r in out][4:] == ["KeyError:'x'", "TimeoutError:grader timed out"]


def test_a_grader_stuck_in_c_code_is_killed_at_the_deadline(spark):
    """An alarm would wait for the regular expression to return, which takes years."""

    def grader(response, answer):
        if response == "stuck":
            re.match(r"(a+)+$", "a" * 60 + "b")
        if response == "gone":
            os._exit(3)
        return response == answer

    rows = [("a", "a"), ("stuck", ""), ("b", "a"), (None, "a"), ("gone", ""), ("stuck", ""), ("c", "c")] + [("d", "d")] * 200
    df = spark.createDataFrame(rows, "response string, answer string").coalesce(1)
    begun = time.monotonic()
    out = [(r["verified"], r["grader_error"]) for r in grade.with_external_verdict(df, grader, timeout=1.0).collect()]
    late, gone = (None, "TimeoutError:grader timed out"), (None, "ChildProcessError:grader ended")
    assert out == [(True, None), late, (False, None), (None, None), gone, late] + [(True, None)] * 201
    assert time.monotonic() - begun < 60


def test_external_grader_sees_only_open_rows(spark):
    def grader(response, answer):
        if "x+1" not in response:
            raise AssertionError("decided row sent to the grader")
        return True

    rows = [("\\boxed{(x+1)^2}", "x^2+2x+1", ""), ("\\boxed{2}", "2", ""), ("\\boxed{3}", "2", "")]
    df = spark.createDataFrame(rows, "response string, answer string, question string").coalesce(1)
    out = grade.with_verdict(df, grader=grader).collect()
    assert [(r["verified"], r["grader_error"]) for r in out] == [(True, None), (True, None), (False, None)]


def test_prompts_are_not_broadcast_to_their_candidates(spark, tmp_path):
    """A small file may hold many rows: its size is no ground to collect them in the driver."""
    prompts = [(1, "p"), (2, "q"), (3, "r")]
    spark.createDataFrame(prompts, "position bigint, question string").write.parquet(f"{tmp_path}/prompts")
    benchmark = spark.read.parquet(f"{tmp_path}/prompts")
    lists = spark.createDataFrame([(2, ["c", "d"]), (1, ["a"])], "position bigint, texts array<string>")
    candidates = lists.selectExpr("position", "transform(texts, t -> struct(t as text)) as candidates")
    rows = metrics.exploded(benchmark, candidates)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows.collect()) == [(1, "p", 0, "a"), (2, "q", 0, "c"), (2, "q", 1, "d")]
