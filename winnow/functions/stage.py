"""Computed-once columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever is built on them.

    Catalyst copies the expression of a projected column into every filter that moves below the
    projection, and merges neighbouring projections; a chain of regular expressions then multiplies.
    A one-element `inline` is a step neither rule crosses. It stays in generated code and moves no
    row.
    """
    rest = [c for c in df.columns if c not in columns]
    values = F.array(F.struct(*(c.alias(name) for name, c in columns.items())))
    return df.select(*rest, F.inline(values))
