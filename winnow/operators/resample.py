"""Weighted draw with replacement, its statistics, and the shuffle and shards that follow it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow.functions.exact import exact_sum
from winnow.functions.stage import stage
from winnow.operators.ordering import dense_index
from winnow.session import materialize

# Small groups sort mostly by their group number; a row's slices still fit one array.
DRAWS_PER_GROUP = 1024
CELLS = 4096
# Parts the total weight is cut into; a power of two, so that a draw's place is a shift.
PARTS = 1 << 60


def last_per_key(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """One row per key: the value of the row that sorts last. Partial aggregation, no window."""
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(key).agg(F.max_by(value, by).alias(value))


def _one_per_key(weights: DataFrame, key: str, value: str) -> DataFrame:
    """Key and value, failing on a key that comes twice; the join reuses this partitioning."""
    again = F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string")))
    only = F.when(F.count(F.lit(1)) > 1, again.cast(weights.schema[value].dataType)).otherwise(F.max(value))
    return weights.where(F.col(key).isNotNull()).groupBy(key).agg(only.alias(value))


def rows_without_index(dataset: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows that no weight can be joined to; `join_weights` fails on the first of them."""
    return dataset.where(F.col(idx).isNull())


def join_weights(
    dataset: DataFrame,
    weights: DataFrame,
    *,
    idx: str = "idx",
    weight: str = "sampling_weight",
    order: list[str] | None = None,
) -> DataFrame:
    """Dataset rows with their weight: 0.0 and `missing` = true where the weight table has none.

    A second weight of an idx is an error, unless `order` says which of several comes last. Only
    the join key needs to be in `dataset`: keep wide columns for `gather`. A null idx is an error.
    """
    if order is None:
        table = _one_per_key(weights, idx, weight)
    else:
        table = last_per_key(weights, idx, weight, *order)
    checked = F.when(
        F.col(idx).isNull(), F.raise_error(F.lit(f"dataset row without {idx}"))
    ).otherwise(F.col(idx))
    rows = dataset.withColumn(idx, checked).join(
        table.withColumn("_found", F.lit(True)), idx, "left"
    )
    return rows.select(
        *dataset.columns,
        F.coalesce(F.col(weight), F.lit(0.0)).alias(weight),
        F.col("_found").isNull().alias("missing"),
    )


def uniform_hash(seed: int, c: Column) -> Column:
    """Uniform integer below 2**60 from seed and counter: bits of md5, the same on any cluster."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _place(hashed: Column, total: int) -> Column:
    """`hashed * total / 2**60`, cut to a whole number, in integers throughout."""
    product = hashed.cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    return F.call_function("div", product, F.lit(PARTS).cast("decimal(19,0)"))


def _parts(weight: Column, total: Column) -> Column:
    """Share of the total weight in whole parts of 2**-60; equal parts when nothing has weight.

    Any positive weight gets a part at least. A negative weight is an error.
    """
    share = (
        F.when(weight < 0, F.raise_error(F.lit("negative weight")).cast("double"))
        .when(total > 0, F.when(weight > 0, F.greatest(F.round(weight / total * float(PARTS)), F.lit(1.0))).otherwise(0.0))
        .otherwise(1.0)
    )
    return share.cast("bigint")


def quantised(df: DataFrame, *, weight: str = "sampling_weight") -> DataFrame:
    """Add `q`, the share of the total weight in whole parts of 2**-60.

    Integer parts make every later sum exact. When no weight is positive all rows get the same part.
    """
    stats = df.agg(exact_sum(F.col(weight)).alias("_sum"))
    q = _parts(F.col(weight), F.col("_sum"))
    return df.crossJoin(F.broadcast(stats)).select(*df.columns, q.alias("q"))


def new_size(n_rows: int, multiplier: float) -> int:
    """Number of draws; zero is an error."""
    n_new = int(n_rows * multiplier)
    if n_new <= 0:
        raise ValueError(f"multiplier {multiplier} leaves no draws from {n_rows} rows")
    return n_new


def _running(idx: str):
    """Task function over rows sorted by `idx`: rows with a part, the running sum `hi`, the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, q = batch.column(0), batch.column(1)
            again = keys.slice(1).filter(pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)))
            if last is not None and last.is_valid and keys[0] == last:
                again = keys.slice(0, 1)
            if len(again):
                raise ValueError(f"repeated {idx}: {again[0]}")
            last = keys[len(keys) - 1]
            hi = np.cumsum(q.to_numpy(zero_copy_only=False)) + before
            before = int(hi[-1])
            columns = [keys, q, pa.array(hi), pa.array(np.full(len(q), part))]
            out = pa.RecordBatch.from_arrays(columns, names=[idx, "q", "hi", "_part"])
            yield out.filter(pc.greater(q, 0))

    return run


def weighted_draws(
    weighted: DataFrame,
    *,
    multiplier: float = 1.0,
    seed: int = 42,
    idx: str = "idx",
    weight: str = "sampling_weight",
    draws_per_group: int = DRAWS_PER_GROUP,
) -> DataFrame:
    """Draws `(draw, idx)`: inverse-CDF match of n·multiplier uniforms to running weight.

    `weighted` holds one row per idx; a repeated idx is an error. Rows are sorted by idx into range
    partitions of about equal row count, whose weights tile the whole. A draw finds its partition
    through a table of at most 4,096 cells, and its row by a window over one slice of that
    partition. A slice holds a fixed share of the weight, hence about `draws_per_group` draws, and
    at most a partition's rows: neither a row with a third of the weight nor a third of the rows
    with almost none makes a hot group. Columns are a few bytes wide throughout. Running sums are
    taken in the pass that writes the sorted rows, which holds one number from batch to batch.
    """
    spark = weighted.sparkSession
    table = materialize(weighted.select(idx, weight), "weights")
    facts = table.agg(
        F.count(F.lit(1)).alias("n"), exact_sum(F.col(weight)).alias("weight")
    ).first()
    n_new = new_size(facts["n"], multiplier)
    q = _parts(F.col(weight), F.lit(facts["weight"] or 0.0))
    kind = table.select(idx, F.lit(0).cast("bigint").alias("q")).schema
    kind = kind.add("hi", "long").add("_part", "long")
    ranged = table.select(idx, q.alias("q")).repartitionByRange(idx).sortWithinPartitions(idx)
    table = materialize(ranged.mapInArrow(_running(idx), kind), "ranges")

    # One row per range partition, so this fits the driver whatever the data.
    sums = table.groupBy("_part").agg(F.max("hi").alias("mass")).collect()
    masses = sorted((r["_part"], r["mass"]) for r in sums)
    starts = [0, *accumulate(m for _, m in masses)]
    total = starts.pop()
    offsets = spark.createDataFrame(
        [(part, n, start) for n, ((part, _), start) in enumerate(zip(masses, starts))],
        "_part bigint, part bigint, start bigint",
    )
    width = min(total, max(1, -(-total * draws_per_group // n_new)))  # weight per slice

    spans = table.join(F.broadcast(offsets), "_part")
    hi = F.col("start") + F.col("hi")
    spans = spans.select(idx, "part", (hi - F.col("q")).alias("lo"), (hi - 1).alias("end"))
    slices = F.sequence(F.expr(f"lo div {width}"), F.expr(f"end div {width}"))
    per_part = total // width + 1
    points = spans.select(idx, "part", "lo", F.explode(slices).alias("slice")).select(
        (F.col("part") * F.lit(per_part) + F.col("slice")).alias("group"),
        F.greatest(F.col("lo"), F.col("slice") * width).alias("at"),
        F.lit(None).cast("bigint").alias("draw"),
        idx,
    )
    uniform = _place(uniform_hash(seed, F.col("id")), total)
    # Staged, or the null checks a join infers would hash every draw again.
    probes = stage(spark.range(n_new), at=uniform).withColumnRenamed("id", "draw")
    probes = _with_part(probes, starts, total).select(
        (F.col("part") * F.lit(per_part) + F.expr(f"at div {width}")).alias("group"),
        "at",
        "draw",
        F.lit(None).cast(weighted.schema[idx].dataType).alias(idx),
    )
    # A point comes before the draws at its place: null draw numbers sort first.
    place = Window.partitionBy("group").orderBy("at", "draw")
    seen = F.last(idx, True).over(place.rowsBetween(Window.unboundedPreceding, 0))
    hits = points.unionByName(probes).withColumn("_idx", seen).where("draw is not null")
    return materialize(hits.select("draw", F.col("_idx").alias(idx)), "draws")


def _with_part(probes: DataFrame, starts: list[int], total: int) -> DataFrame:
    """Add the number of the last start that is not above `at`.

    The range is cut into equal cells, and a cell at the starts inside it, so a lookup is a hash
    join with a range condition on at most CELLS plus one row per start. Where many starts crowd
    into a cell few probes fall there.
    """
    cell = max(1, -(-total // CELLS))
    rows = []
    for part, (lo, hi) in enumerate(zip(starts, [*starts[1:], total])):
        for number in range(lo // cell, (hi - 1) // cell + 1):
            rows.append(
                (number, max(lo, number * cell), min(hi, (number + 1) * cell), part)
            )
    cells = probes.sparkSession.createDataFrame(
        rows, "_cell bigint, _lo bigint, _hi bigint, part bigint"
    )
    inside = (
        (F.expr(f"at div {cell}") == F.col("_cell"))
        & (F.col("at") >= F.col("_lo"))
        & (F.col("at") < F.col("_hi"))
    )
    return probes.join(F.broadcast(cells), inside).select(*probes.columns, "part")


def gather(dataset: DataFrame, draws: DataFrame, *, idx: str = "idx") -> DataFrame:
    """Rows of `dataset` in as many copies as drawn, with their `draw` number.

    A plain join: the draws of a row with a large share of them are narrow, and adaptive execution
    splits their partition and reads the dataset's rows again for each piece.
    """
    return dataset.join(draws.select("draw", idx), idx).select("draw", *dataset.columns)


def resample_stats(draws: DataFrame, n_rows: DataFrame, *, idx: str = "idx") -> DataFrame:
    """One row: original and new size, rows used, rows drawn more than once, duplicate draws.

    `n_rows` is a one-row table with the column `original_rows`.
    """
    counts = draws.groupBy(idx).agg(F.count(F.lit(1)).alias("_n"))
    stats = counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("new_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.count_if(F.col("_n") > 1).alias("repeated_rows"),
    )
    return n_rows.crossJoin(stats).withColumn(
        "duplicate_draws", F.col("new_rows") - F.col("unique_rows")
    )


def optimiser_steps(rows: Column, *, epochs: int, processes: int, batch: int, accumulation: int) -> Column:
    """Whole optimiser steps for a row count."""
    return F.floor(rows * epochs / F.lit(processes * batch * accumulation)).cast("bigint")


def seeded_shuffle(df: DataFrame, *, seed: int = 42, idx: str = "idx", out: str = "shuffled") -> DataFrame:
    """Pseudo-random order from seed and idx alone, as a dense position."""
    mixed = df.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}:"), F.col(idx).cast("string")).cast("binary")))
    return dense_index(mixed, "_mix", idx, out=out).drop("_mix")


def with_shard(
    df: DataFrame, shards: int, *, position: str = "idx", contiguous: bool = True, out: str = "shard"
) -> DataFrame:
    """Shard number of a dense position: equal runs (the first ones longer by one), or round robin.

    For runs, a position outside 0 to rows - 1 is an error.
    """
    if not contiguous:
        return df.withColumn(out, F.pmod(F.col(position), F.lit(shards)).cast("int"))
    count = df.agg(F.count(F.lit(1)).alias("_rows"))
    size, longer = F.expr(f"_rows div {shards}"), F.col("_rows") % shards
    edge = longer * (size + 1)
    shard = F.when(
        F.col(position) < edge, F.floor(F.col(position) / (size + 1))
    ).otherwise(longer + F.floor((F.col(position) - edge) / size))
    sparse = F.raise_error(F.concat(F.lit(f"{position} is not a dense position: "), F.col(position).cast("string")))
    inside = F.col(position).between(0, F.col("_rows") - 1)
    return df.crossJoin(F.broadcast(count)).select(
        *df.columns, F.when(inside, shard.cast("int")).otherwise(sparse.cast("int")).alias(out)
    )


def write_shards(df: DataFrame, path: str, *, shard: str = "shard", mode: str = "errorifexists") -> None:
    """One folder per shard, in the columnar format trainers read."""
    df.write.mode(mode).partitionBy(shard).parquet(path)
