"""Grading columns: number, letter and value checks, and the native level of math equality."""

from __future__ import annotations

import itertools
import multiprocessing
from collections.abc import Callable, Iterable, Iterator, Mapping
from multiprocessing.connection import Connection
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from winnow.functions import text as X
from winnow.functions.canonical import forms_equal

# Text that float() accepts; a cast alone would also take Java suffixes such as "1d".
_FLOAT = (
    r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
)


def parse_float(c: Column) -> Column:
    """Numeric value of a text, null when it is not a number."""
    return F.when(c.rlike(_FLOAT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def verify_number(prediction: Column, gold: Column, miss: float = 1e-3) -> Column:
    """Whether the last number of the prediction is within `miss` of gold.

    No number gives false; gold that is not numeric gives null.
    """
    number = X.answer_number(prediction)
    return F.when(number.isNull(), F.lit(False)).otherwise(
        F.abs(parse_float(gold) - number) <= miss
    )


def verify_letter(prediction: Column, gold: Column) -> Column:
    """Whether the chosen letter is gold; no letter gives false."""
    return F.coalesce(X.answer_choice(prediction) == F.upper(X.strip(gold)), F.lit(False))


# --- math equality, native level ----------------------------------------------------------------

_NUM = r"\d+(?:\.\d+)?|\.\d+"


def normal_math(c: Column) -> Column:
    """LaTeX answer with spacing, sizing, units and spelling variants removed.

    A text wrapper around the whole answer is opened, any other one is a unit and goes.
    """
    wrapped = r"\\(?:text|textbf|mathrm|mbox)\{([^{}]*)\}"
    s = F.regexp_replace(c, r"\\(?:left|right|displaystyle|,|;|:|!| )|\$|\\(?=%)", "")
    s = F.regexp_replace(s, rf"^\s*{wrapped}\s*$", "$1")
    s = F.regexp_replace(s, rf"{wrapped}|\^\{{?\\circ\}}?|\\degree|\s+", "")
    s = F.regexp_replace(s, r"\.$", "")
    s = F.regexp_replace(s, r"\\[dt]frac", r"\\frac")
    s = F.regexp_replace(s, r"\\cdot|\\times", "*")
    s = F.regexp_replace(s, r"\\(frac|sqrt)(\d)", r"\\$1{$2}")
    s = F.regexp_replace(s, r"\\frac\{(\d+)\}(\d)", r"\\frac{$1}{$2}")
    return F.regexp_replace(s, r"(?<=^|\D)(\d{1,3}),(?=\d{3}(?:\D|$))", "$1")


def without_assignment(c: Column) -> Column:
    """Right-hand side of `x=...`, other text unchanged."""
    return F.regexp_replace(c, r"^[A-Za-z]=", "")


def math_number(normal: Column) -> Column:
    """Value of a normalised plain number, fraction or quotient; null for anything else."""
    plain = normal.rlike(rf"^[+-]?(?:{_NUM}|\d+\.)$")
    frac = rf"^([+-]?)\\frac\{{([+-]?(?:{_NUM}))\}}\{{([+-]?(?:{_NUM}))\}}$"
    ratio = rf"^([+-]?)({_NUM})/({_NUM})$"

    def quotient(pattern: str) -> Column:
        sign = F.when(F.regexp_extract(normal, pattern, 1) == "-", -1.0).otherwise(1.0)
        top = F.regexp_extract(normal, pattern, 2).try_cast("double")
        bottom = F.regexp_extract(normal, pattern, 3).try_cast("double")
        return F.when(bottom != 0, sign * top / bottom)

    return (
        F.when(plain, normal.try_cast("double"))
        .when(normal.rlike(frac), quotient(frac))
        .when(normal.rlike(ratio), quotient(ratio))
    )


def math_equal(gold: Column, pred: Column, gold_num: Column, pred_num: Column) -> Column:
    """Equality of normalised answers: equal text, else numbers equal to six decimals, else null."""
    return F.when(gold == pred, F.lit(True)).when(
        gold_num.isNotNull() & pred_num.isNotNull(), F.round(gold_num, 6) == F.round(pred_num, 6)
    )


def choice_of_value(choices: Column, pred: Column, pred_num: Column, pred_form: Column) -> Column:
    """Letter of the first choice `struct<letter, text, form>` equal to a normalised answer, else null."""
    same = F.filter(
        choices,
        lambda c: F.coalesce(
            math_equal(c["text"], pred, math_number(c["text"]), pred_num),
            forms_equal(c["form"], pred_form),
            F.lit(False),
        ),
    )
    return F.try_element_at(same, F.lit(1))["letter"]


def without_dollars(c: Column) -> Column:
    return F.regexp_replace(X.strip(c), r"^\$+|\$+$", "")


# --- a caller's grader --------------------------------------------------------------------------

GRADE = T.StructType(
    [T.StructField("verified", T.BooleanType()), T.StructField("grader_error", T.StringType())]
)

Grader = Callable[[str, str], Any]


_CHUNK = 64  # pairs sent to the child at once


def _truth(result: Any) -> bool:
    """A mapping is reduced to its `acc` entry."""
    return bool(result.get("acc") if isinstance(result, Mapping) else result)


def _serve(grader: Grader, pipe: Connection, parents: Connection) -> None:
    """In the child: answer every pair of every list with a verdict or "Type:message"."""
    parents.close()  # else the child would not see that its parent is gone
    while True:
        try:
            pairs = pipe.recv()
        except EOFError:
            return
        for pair in pairs:
            try:
                answer = _truth(grader(*pair)), None
            except Exception as error:
                answer = None, f"{type(error).__name__}:{error}"
            pipe.send(answer)


class Child:
    """A forked process that grades, and can be killed in the middle of anything, C code included."""

    def __init__(self, grader: Grader) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(target=_serve, args=(grader, theirs, self.pipe), daemon=True)
        self.process.start()
        theirs.close()

    def next_answer(self, timeout: float) -> tuple[bool | None, str | None]:
        """The next verdict; a TimeoutError when time is up, an EOFError when the process is gone."""
        if not self.pipe.poll(timeout):
            raise TimeoutError("grader timed out")
        return self.pipe.recv()

    def stop(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()


def graded(
    grader: Grader, pairs: Iterable[tuple[str | None, str | None]], timeout: float
) -> Iterator[tuple[bool | None, str | None]]:
    """A verdict, or null and "Type:message", for each pair; both null where a text is missing.

    The grader runs in a child process. Past the deadline the child is killed, whatever it is doing, and
    another takes the pairs that are left. A grader that ends its process gets an error for that pair.
    """
    child: Child | None = None
    rows = iter(pairs)
    try:
        while chunk := list(itertools.islice(rows, _CHUNK)):
            asked = [p for p in chunk if None not in p]
            answers: list[tuple[bool | None, str | None]] = []
            while len(answers) < len(asked):
                if child is None:
                    child = Child(grader)
                child.pipe.send(asked[len(answers) :])
                while len(answers) < len(asked):
                    try:
                        answers.append(child.next_answer(timeout))
                    except (TimeoutError, EOFError, ConnectionError) as error:
                        late = isinstance(error, TimeoutError)
                        answers.append((None, "TimeoutError:grader timed out" if late else "ChildProcessError:grader ended"))
                        child.stop()
                        child = None
                        break
            left = iter(answers)
            yield from (next(left) if None not in p else (None, None) for p in chunk)
    finally:
        if child is not None:
            child.stop()


def external_grade(
    response: Column,
    answer: Column,
    grader: Grader,
    *,
    when: Column | None = None,
    timeout: float = 20.0,
) -> Column:
    """struct<verified, grader_error> from a caller's Python grader.

    Only rows where `when` holds carry their text to Python; the others travel as nulls and come
    back as nulls, so the plan needs neither a second scan nor a union.
    """

    @F.pandas_udf(GRADE)
    def grade(responses: pd.Series, answers: pd.Series) -> pd.DataFrame:
        rows = list(graded(grader, zip(responses, answers), timeout))
        out = pd.DataFrame(rows, columns=["verified", "grader_error"], dtype=object)
        return out

    if when is not None:
        response, answer = F.when(when, response), F.when(when, answer)
    return grade(response, answer)
