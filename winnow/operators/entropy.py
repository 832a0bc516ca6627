"""Entropy tables: merge, last-wins dedupe, and choice of the two rounds to compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

ROUNDS = ((0, 1), (1, 2), (2, 3))


def merge_entropies(
    tables: list[DataFrame], *, idx: str = "idx", line: str | None = None
) -> DataFrame:
    """One row per idx with every field any table has; for a field the later table wins.

    A union and one partial aggregation instead of a chain of full joins. `line` orders repeated
    keys within a table.
    """
    numbered = [t.withColumn("_file", F.lit(n)) for n, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    fields = [c for c in rows.columns if c not in (idx, line, "_file")]

    def latest(field: str, order: str):
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.col(order))).alias(field)

    if line is not None:
        rows = rows.groupBy(idx, "_file").agg(*(latest(f, line) for f in fields))
    return rows.groupBy(idx).agg(*(latest(f, "_file") for f in fields))


def dedupe_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key. Partial aggregates, so a key with many rows stays cheap."""
    others = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in others)).select(*df.columns)


def entropy_pair(df: DataFrame) -> DataFrame:
    """Name the two rounds to compare `entropy_0` and `entropy_1`: the first pair present."""
    for before, after in ROUNDS:
        old, new = f"entropy_{before}", f"entropy_{after}"
        if old in df.columns and new in df.columns:
            if before == 0:
                return df
            # The first column may be a source of the second: read both before naming either.
            renamed = {"entropy_0": F.col(old), "entropy_1": F.col(new)}
            rest = [c for c in df.columns if c not in renamed]
            return df.select(*rest, *(c.alias(n) for n, c in renamed.items()))
    raise ValueError(f"need two consecutive entropy columns, got {df.columns}")
