"""Columns over an array of chat messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_message(messages: Column, role: str) -> Column:
    """First message of a role, null when there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))


def first_content(messages: Column, role: str, *, missing: str | None = None) -> Column:
    """Content of the first message of a role; `missing` replaces an absent role."""
    found = first_message(messages, role)
    if missing is None:
        return found["content"]
    return F.when(found.isNull(), F.lit(missing)).otherwise(found["content"])
