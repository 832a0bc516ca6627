"""Total order without a single-task step: dense index and running sum.

Both rest on one table. The rows are range-partitioned and sorted by a unique key, numbered
within their partition, and written once. A per-partition aggregate of that table has at most one
row per shuffle partition, so its running total is a bounded window and its broadcast is bounded by
the partition count, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_scan_order(df: DataFrame) -> DataFrame:
    """Add `_file`, `_block`, `_row`: the input order of a file scan. Apply directly to the scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


SCAN_ORDER = ("_file", "_block", "_row")


def sorted_table(df: DataFrame, *order: str | Column) -> DataFrame:
    """Written copy of `df` with `_part` (range partition) and `_pos` (row within it)."""
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_rid", F.monotonically_increasing_id())
    )
    table = materialize(ranged, "sorted")
    return table.select(
        *df.columns,
        F.shiftright("_rid", _ROW_BITS).alias("_part"),
        F.col("_rid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_pos"),
    )


def _before(table: DataFrame, total: Column) -> DataFrame:
    """Per partition, the sum of `total` over all earlier partitions."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("_part").agg(total.alias("_total"))
    return F.broadcast(
        parts.select(
            "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
        )
    )


def dense_index(df: DataFrame, *order: str, out: str = "idx", start: int = 0) -> DataFrame:
    """Number rows start, start + 1, ... in the order of a unique key.

    Rows still lying as a file scan delivered them, ordered by `SCAN_ORDER`, are numbered without
    a shuffle; any other order is range-partitioned. Costly filters run once in the first case; in
    the second the range partitioner samples first, so hand in a written table.
    """
    if order == SCAN_ORDER:
        return _scan_index(df, out, start)
    return _range_index(df, order, out, start)


def _range_index(df: DataFrame, order: tuple[str, ...], out: str, start: int) -> DataFrame:
    table = sorted_table(df, *order)
    rows = table.join(_before(table, F.count(F.lit(1))), "_part")
    index = (F.col("_before") + F.col("_pos") + start).cast("bigint")
    kept = [c for c in df.columns if c != out]
    return rows.select(*kept, index.alias(out))


def _scan_index(df: DataFrame, out: str, start: int) -> DataFrame:
    """Dense index in scan order: one write, one count per file split, no shuffle of rows.

    Rows are sorted inside their task first, which leaves rows that still lie as scanned where they
    are; so a row's number is the rows of earlier splits plus its place in its own, whatever moved
    rows within a task before. The running count over splits goes through `sorted_table`, and Spark
    broadcasts the result, one row per split, only below its own size limit. If a split's rows were
    spread over tasks since the scan, all rows are range-partitioned instead.
    """
    placed = df.sortWithinPartitions(*SCAN_ORDER).withColumn("_rid", F.monotonically_increasing_id())
    table = materialize(placed, "scan")
    splits = table.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_first"), F.max("_rid").alias("_end")
    )
    splits = sorted_table(splits, "_file", "_block")
    torn = splits.where(F.col("_end") - F.col("_first") + 1 != F.col("_n"))
    if not torn.isEmpty():
        return _range_index(table.drop("_rid"), SCAN_ORDER, out, start)
    sums = running_sum(splits, "_n", "_up_to").join(_before(splits, F.sum("_n")), "_part")
    earlier = F.col("_before") + F.col("_up_to") - F.col("_n")
    offsets = materialize(sums.select("_file", "_block", "_first", earlier.alias("_earlier")), "splits")
    index = (F.col("_earlier") + F.col("_rid") - F.col("_first") + start).cast("bigint")
    kept = [c for c in df.columns if c != out]
    return table.join(offsets, ["_file", "_block"]).select(*kept, index.alias(out))


def running_sum(table: DataFrame, value: str, out: str = "hi") -> DataFrame:
    """Inclusive running sum, within each `_part`, of an integer column over a `sorted_table`."""
    place = Window.partitionBy("_part").orderBy("_pos")
    return table.withColumn(out, F.sum(value).over(place.rowsBetween(Window.unboundedPreceding, 0)))
