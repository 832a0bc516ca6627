"""Graders over tables of responses, with a caller's grader for what the native checks leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from winnow import constants as K
from winnow.functions import grading as G
from winnow.functions import text as X
from winnow.functions.canonical import ANSWERS, forms_equal, forms_of_answers
from winnow.functions.stage import stage

_ANY_MATH = r"\\boxed|\$|\\\(|\\\["


def with_math_verdict(
    df: DataFrame, prediction: str, gold: str, *, out: str = "verified"
) -> DataFrame:
    """Native level of math equality: true, false, or null when it cannot decide.

    The last boxed value is compared with gold as normalised text, as a number, and where that leaves it
    open by canonical form. Blank gold is null. A response with neither a box nor any math delimiter holds
    no answer and is false. Percent signs on both sides cancel.
    """
    rows = stage(df, _mv_box=X.last_box(F.col(prediction)))
    rows = stage(
        rows,
        _mv_pred=G.without_assignment(G.normal_math(F.col("_mv_box"))),
        _mv_gold=G.without_assignment(G.normal_math(G.without_dollars(F.col(gold)))),
    )
    percent = r"(?<=\d)%$"
    both = F.col("_mv_pred").rlike(percent) & F.col("_mv_gold").rlike(percent)
    pred, truth = (
        F.when(both, F.regexp_replace(c, percent, "")).otherwise(F.col(c)) for c in ("_mv_pred", "_mv_gold")
    )
    rows = stage(rows, _mv_pred=pred, _mv_gold=truth)
    pred, truth = F.col("_mv_pred"), F.col("_mv_gold")
    no_answer = pred.isNull() & ~F.col(prediction).rlike(_ANY_MATH)
    verdict = (
        F.when(F.coalesce(truth, F.lit("")) == "", F.lit(None).cast("boolean"))
        .when(no_answer, F.lit(False))
        .otherwise(G.math_equal(truth, pred, G.math_number(truth), G.math_number(pred)))
    )
    rows = stage(rows, _mv_verdict=verdict)
    open_ = F.col("_mv_verdict").isNull()
    rows = stage(rows, **{ANSWERS: F.when(open_, F.array(truth, pred))})
    rows = stage(rows, _mv_forms=forms_of_answers()).drop(ANSWERS)
    by_form = F.when(open_, forms_equal(F.col("_mv_forms")[0], F.col("_mv_forms")[1]))
    helpers = ("box", "pred", "gold", "verdict", "forms")
    return stage(rows, **{out: F.coalesce("_mv_verdict", by_form)}).drop(*(f"_mv_{h}" for h in helpers))


def with_choice_verdict(
    df: DataFrame, prediction: str, question: str, gold: str, *, out: str = "verified"
) -> DataFrame:
    """Whether the first choice whose value equals the boxed value is the gold letter.

    Null when nothing is boxed, the question has no choices, or no choice has that value.
    """
    boxed = F.when(F.col(gold).isNotNull(), X.answer_boxed(F.col(prediction)))
    rows = stage(df, _cv_pred=G.without_assignment(G.normal_math(boxed)))
    choices = F.transform(
        X.answer_choices(F.when(F.col("_cv_pred").isNotNull(), F.col(question))),
        lambda c: F.struct(
            c["letter"].alias("letter"),
            G.without_assignment(G.normal_math(c["value"])).alias("text"),
        ),
    )
    pred = F.col("_cv_pred")
    rows = stage(rows, _cv_choices=choices, _cv_num=G.math_number(pred))
    texts = F.concat(F.array(pred), F.transform("_cv_choices", lambda c: c["text"]))
    rows = stage(rows, **{ANSWERS: F.when(pred.isNotNull(), texts)})
    rows = stage(rows, _cv_forms=forms_of_answers()).drop(ANSWERS)
    forms = F.col("_cv_forms")
    formed = F.transform("_cv_choices", lambda c, i: c.withField("form", F.get(forms, i + 1)))
    letter = G.choice_of_value(formed, pred, F.col("_cv_num"), F.get(forms, F.lit(0)))
    return stage(rows, **{out: letter == F.col(gold)}).drop("_cv_pred", "_cv_choices", "_cv_num", "_cv_forms")


def with_native_verdict(
    df: DataFrame,
    *,
    prediction: str = "response",
    answer: str = "answer",
    question: str | None = "question",
    out: str = "verified",
) -> DataFrame:
    """Chosen letter, then choice value, then math equality; null is undecided.

    Letters and choices count only for a gold answer A-E; other rows skip both.
    """
    gold = F.upper(G.without_dollars(F.col(answer)))
    rows = stage(df, _letter=F.when(gold.isin(*K.CHOICE_LETTERS), gold))
    letter = F.col("_letter")
    chosen = F.when(letter.isNotNull(), X.answer_choice(F.col(prediction)))
    rows = stage(rows, _by_letter=chosen == letter)
    if question is None:
        rows = rows.withColumn("_by_value", F.lit(None).cast("boolean"))
    else:
        rows = stage(rows, _open=F.when(F.col("_by_letter").isNull(), letter))
        rows = with_choice_verdict(rows, prediction, question, "_open", out="_by_value")
    rows = with_math_verdict(rows, prediction, answer, out="_by_math")
    verdict = F.coalesce("_by_letter", "_by_value", "_by_math")
    names = [c for c in df.columns if c != out]
    return rows.select(*names, verdict.alias(out))


def with_verdict(
    df: DataFrame,
    *,
    prediction: str = "response",
    answer: str = "answer",
    question: str | None = "question",
    grader: G.Grader | None = None,
    timeout: float = 20.0,
    out: str = "verified",
) -> DataFrame:
    """Add the native verdict; null is undecided and counts as incorrect.

    A `grader` decides the rows the native checks leave open; then `grader_error` is added.
    """
    names = {"prediction": prediction, "answer": answer, "question": question}
    if grader is None:
        return with_native_verdict(df, **names, out=out)
    rows = with_native_verdict(df, **names, out="_native")
    outer = G.external_grade(
        F.col(prediction), F.col(answer), grader, when=F.col("_native").isNull(), timeout=timeout
    )
    return rows.withColumn("_outer", outer).select(
        *(c for c in df.columns if c != out),
        F.coalesce("_native", "_outer.verified").alias(out),
        F.col("_outer.grader_error").alias("grader_error"),
    )


def with_external_verdict(
    df: DataFrame,
    grader: G.Grader,
    *,
    prediction: str = "response",
    answer: str = "answer",
    timeout: float = 20.0,
) -> DataFrame:
    """`verified` and `grader_error` from a caller's grader for every row."""
    graded = df.withColumn(
        "_grade", G.external_grade(F.col(prediction), F.col(answer), grader, timeout=timeout)
    )
    return graded.select(*df.columns, "_grade.verified", "_grade.grader_error")


def with_verdict_by_dataset(
    df: DataFrame,
    *,
    dataset: str = "dataset",
    prediction: str = "response",
    answer: str = "answer",
    question: str = "question",
    out: str = "verified",
) -> DataFrame:
    """Number, letter or composite grading, chosen by benchmark name; adds `method`."""
    response, gold = F.col(prediction), F.col(answer)
    method = F.col("method")
    rows = stage(df, method=X.grading_method(F.col(dataset)))
    # Rows of the other methods give the composite check nothing to work on.
    rows = rows.withColumn("_response", F.when(method == "latex", response))
    rows = with_native_verdict(
        rows, prediction="_response", answer=answer, question=question, out="_latex"
    )
    verdict = (
        F.when(method == "simple_number", G.verify_number(response, gold))
        .when(method == "multiple_choice", G.verify_letter(response, gold))
        .otherwise(F.col("_latex"))
    )
    return rows.select(*df.columns, "method", verdict.alias(out))
