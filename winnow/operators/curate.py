"""Curation of chat records: drop reasons, the report of drops, and the indexed result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow import constants as K
from winnow.functions import grading as G
from winnow.functions import text as X
from winnow.functions.messages import first_message
from winnow.functions.stage import stage
from winnow.operators.grade import with_math_verdict
from winnow.operators.ordering import SCAN_ORDER, dense_index
from winnow.session import materialize

STRUCTURAL = "structural"
DENIED = "denied"
FORMAT = "format"
NO_REFERENCE = "no_reference"
INCORRECT = "incorrect"
UNDECIDED = "undecided"
REASONS = (STRUCTURAL, DENIED, FORMAT, NO_REFERENCE, INCORRECT, UNDECIDED)


def is_structural(messages: Column) -> Column:
    """At least two messages, both roles present, both contents non-blank."""
    user, assistant = (first_message(messages, r)["content"] for r in ("user", "assistant"))
    return F.coalesce(
        (F.size(messages) >= 2) & ~X.is_blank(user) & ~X.is_blank(assistant), F.lit(False)
    )


def reference_answer(messages: Column) -> Column:
    """Reference answer of the first message, null when absent or empty."""
    return X.nonempty(F.try_element_at(messages, F.lit(1))["info"]["reference_answer"])


def with_drop_reason(
    df: DataFrame,
    *,
    messages: str = "messages",
    denied: tuple[str, ...] = K.DENIED_CONTENT,
    denied_by: Column | None = None,
    grader: G.Grader | None = None,
    timeout: float = 20.0,
    out: str = "reason",
) -> DataFrame:
    """Add the first rule a record fails, null for a kept one.

    The deny-list is compared with the assistant content unless `denied_by` names another value,
    such as the source. Rules run from cheap to costly; a record that an earlier rule drops never
    reaches the answer check, and only answers the native check leaves open reach a `grader`.
    """
    m = F.col(messages)
    rows = stage(df, _answer=X.strip(first_message(m, "assistant")["content"]))
    answer = F.col("_answer")
    early = (
        F.when(~is_structural(m), F.lit(STRUCTURAL))
        .when((answer if denied_by is None else denied_by).isin(*denied), F.lit(DENIED))
        .when(X.format_score(answer) == 0.0, F.lit(FORMAT))
        .when(reference_answer(m).isNull(), F.lit(NO_REFERENCE))
    )
    rows = stage(rows, _early=early)
    passed = F.col("_early").isNull()
    rows = stage(
        rows, _graded=F.when(passed, answer), _gold=F.when(passed, reference_answer(m))
    )
    rows = with_math_verdict(rows, "_graded", "_gold", out="_right")
    right = F.col("_right")
    if grader is not None:
        outer = G.external_grade(
            F.col("_graded"), F.col("_gold"), grader, when=passed & right.isNull(), timeout=timeout
        )
        rows = rows.withColumn("_outer", outer)
        right = F.coalesce(right, F.col("_outer.verified"))
    return rows.select(*df.columns, _reason(F.col("_early"), right).alias(out))


def _reason(early: Column, right: Column) -> Column:
    """The early reason, else `incorrect` for a wrong answer, `undecided` where no check could tell."""
    late = F.when(right.isNull(), F.lit(UNDECIDED)).when(~right, F.lit(INCORRECT))
    return F.coalesce(early, late)


def kept(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNull()).drop(reason)


def drop_report(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per reason, kept ones under `kept`, in one pass."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def indexed(df: DataFrame, *order: str) -> DataFrame:
    """Kept records numbered from zero in input order, or in the order of a unique key.

    Input order is that of `with_scan_order`, which must be part of `df`; it needs no shuffle. A
    key does, so the kept records are written first and the filters run once.
    """
    if order:
        return dense_index(materialize(df, "kept"), *order)
    return dense_index(df, *SCAN_ORDER).drop(*SCAN_ORDER)


def head(df: DataFrame, rows: int) -> DataFrame:
    """The first rows of an indexed table: a filter, no sort."""
    return df.where(F.col("idx") < rows)
