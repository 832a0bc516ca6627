"""Connected components of a graph given as links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from winnow.llm.common import materialize


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """Every id that occurs in a link (`a`, `b`), as `id`, with the smallest id it can reach.

    A round points each id to its smallest neighbour, follows pointers until they stay (each pass
    doubles the distance), and replaces both ends of the links that are left by what they point to.
    Rounds are logarithmic in the longest path. All steps are joins and partial aggregates on narrow
    rows, written to the shared folder, so an id with very many links is split like any skewed join
    key. No links give an empty table.
    """
    edges = links.select("a", "b").where("a != b")
    labels: DataFrame | None = None
    while True:
        both = edges.union(edges.select("b", "a"))
        pointers = materialize(
            both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), label
        )
        while True:
            ahead = pointers.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
            moved = materialize(
                pointers.join(ahead, F.col("to") == F.col("_id")).select(
                    "id", F.col("_to").alias("to"), (F.col("to") != F.col("_to")).alias("_moved")
                ),
                label,
            )
            pointers = moved.select("id", "to")
            if moved.where("_moved").isEmpty():
                break
        if labels is None:
            labels = pointers.select("id", F.col("to").alias(label))
        else:
            step = pointers.select(F.col("id").alias("_id"), "to")
            labels = materialize(
                labels.join(step, F.col(label) == F.col("_id"), "left").select(
                    "id", F.coalesce("to", label).alias(label)
                ),
                label,
            )
        left, right = (pointers.select(F.col("id").alias(f"_{e}"), F.col("to").alias(f"_to_{e}")) for e in "ab")
        edges = materialize(
            edges.join(left, F.col("a") == F.col("_a"))
            .join(right, F.col("b") == F.col("_b"))
            .select(F.col("_to_a").alias("a"), F.col("_to_b").alias("b"))
            .where("a != b")
            .distinct(),
            label,
        )
        if edges.isEmpty():
            return labels
