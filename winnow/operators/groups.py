"""Group statistics joined back to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """Add aggregates of each row's group, as an unordered window would.

    A window sends a whole group to one task. Here the statistics are partial aggregates, one row a group,
    and the join back is one whose rows adaptive execution splits where a group is hot. Null keys form a
    group of their own. `df` is read twice, so hand in narrow columns or a written table.
    """
    groups = df.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(*(c.alias(n) for n, c in stats.items()))
    same = reduce(Column.__and__, (df[k].eqNullSafe(groups[f"_key_{k}"]) for k in keys))
    return df.join(groups, same, "left").select(*(df[c] for c in df.columns), *stats)
