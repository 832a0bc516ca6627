"""Validations: each returns the violating rows; `check` turns them into a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ValidationError(ValueError):
    """Rows that must not exist were found."""


def check(violations: DataFrame, message: str, *, show: int = 5) -> None:
    """Fail when there is any violating row, naming the first few. Nothing is dropped silently."""
    rows = violations.limit(show).collect()
    if rows:
        raise ValidationError(f"{message}: {[r.asDict() for r in rows]}")
