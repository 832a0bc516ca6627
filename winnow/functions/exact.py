"""Order-independent sums and exact quantiles without a group that grows with the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from winnow.session import materialize

_BINS = 1024
_SKETCH = 10_000  # the sketch's rank error is the rows over this
_LIMB_BITS = 20
_LIMBS = 11


def exact_sum(c: Column) -> Column:
    """Sum that is the same double for any partitioning and any row order.

    The size of each value is cut into a whole part and eleven 20-bit limbs of its fraction, which
    are summed as integers under the value's sign. Resolution is 2**-220, about 6e-67, and 2**43
    rows fit. Nulls are left out; NaN, values of 2**62 and more, and an overflowing sum are errors.
    """
    x = c.cast("double")
    usable = x.isNull() | (F.abs(x) < float(1 << 62))
    refused = F.raise_error(F.concat(F.lit("cannot sum "), x.cast("string"))).cast("bigint")
    size = F.abs(x)
    sign = F.when(x < 0, -1).otherwise(1).cast("bigint")
    whole = F.when(usable, F.floor(size).cast("bigint")).otherwise(refused)
    total = F.lit(0.0)
    # Smallest limbs first: they are added up before the large ones would round them away.
    for limb in range(_LIMBS - 1, -1, -1):
        # Scaling by a power of two and the remainder of one are exact.
        rest = (size * F.lit(float(1 << (limb * _LIMB_BITS)))) % F.lit(1.0)
        part = F.floor(rest * F.lit(float(1 << _LIMB_BITS))).cast("bigint") * sign
        total = total + F.sum(part) / F.lit(float(1 << ((limb + 1) * _LIMB_BITS)))
    return total + F.sum(whole * sign).cast("double")


def exact_quantiles(df: DataFrame, column: str, quantiles: list[float]) -> list[float]:
    """Linearly interpolated quantiles, equal to sorting the whole column.

    `percentile` keeps every distinct value in one task. Here `df` is read twice. The first scan builds a
    mergeable quantile sketch, whose known error gives each wanted rank a bracket of values. The second
    counts the rows between the brackets and, by value, those inside, some thousandths of all, and writes
    the counts. Ranks are then found among these: a pass counts at most 1,024 equal-width bins per rank and
    narrows to the one that holds it, until that has a single value; no bin is collected.
    """
    v = F.col(column)
    values = df.where(v.isNotNull() & ~F.isnan(v)).select(v.cast("double").alias("v"))
    fractions, margin = [], 2.0 / _SKETCH
    for q in quantiles:
        fractions += [max(0.0, q - margin), min(1.0, q + margin)]
    sketch = F.percentile_approx("v", fractions, _SKETCH)
    first = values.agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), sketch.alias("brackets")
    ).first()
    if not first["n"]:
        raise ValueError(f"no values in {column}")
    if math.isinf(first["lo"]) or math.isinf(first["hi"]):
        raise ValueError(f"{column} holds an infinite value")
    places = [q * (first["n"] - 1) for q in quantiles]
    ranks = sorted({int(p) for p in places} | {min(int(p) + 1, first["n"] - 1) for p in places})
    ends = first["brackets"]
    # Few rows: a bracket of less than a row's share on either side takes all.
    if first["n"] * margin < 4:
        ends = [first["lo"], first["hi"]]
    brackets: list[list[float]] = []
    for lo, hi in sorted(zip(ends[::2], ends[1::2])):
        if brackets and lo <= brackets[-1][1]:
            brackets[-1][1] = max(brackets[-1][1], hi)
        else:
            brackets.append([lo, hi])
    # Odd pieces are brackets, even ones lie between them.
    piece = F.lit(2 * len(brackets))
    for number, (lo, hi) in reversed(list(enumerate(brackets))):
        piece = F.when(F.col("v") < lo, 2 * number).when(F.col("v") <= hi, 2 * number + 1).otherwise(piece)
    counted = values.withColumn("piece", piece)
    inside = F.when(F.col("piece") % 2 == 1, F.col("v")).alias("v")
    counted = materialize(counted.groupBy("piece", inside).agg(F.count(F.lit(1)).alias("n")), "quantiles")
    sizes = {r["piece"]: r["n"] for r in counted.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    values = counted.where(F.col("v").isNotNull()).select("v", "n")
    found: dict[int, float] = {}
    # rank -> (low, high, rows below low); ranks inside the same interval share a pass
    open_ranks = {}
    for r in ranks:
        below = 0
        for number, (lo, hi) in enumerate(brackets):
            below += sizes.get(2 * number, 0)
            held = sizes.get(2 * number + 1, 0)
            if below <= r < below + held:
                open_ranks[r] = (lo, hi, below)
            below += held
        if r not in open_ranks:
            raise ArithmeticError(f"rank {r} of {column} lies outside its bracket")
    while open_ranks:
        for r, (lo, hi, _) in list(open_ranks.items()):
            if lo == hi:
                found[r] = lo
                del open_ranks[r]
        intervals = sorted({(lo, hi) for lo, hi, _ in open_ranks.values()})
        if not intervals:
            break
        bins: dict[tuple[float, float], list] = {i: [] for i in intervals}
        tagged = None
        for number, (lo, hi) in enumerate(intervals):
            # Halves first: the width of the whole double range would overflow.
            share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
            bin_no = F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).cast("int")
            tag = F.struct(F.lit(number).alias("i"), bin_no.alias("b"))
            inside = F.col("v").between(lo, hi)
            tagged = F.when(inside, tag) if tagged is None else tagged.when(inside, tag)
        rows = (
            values.select("v", "n", tagged.alias("t"))
            .where("t is not null")
            .groupBy("t.i", "t.b")
            .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        for row in sorted(rows, key=lambda r: (r["i"], r["b"])):
            bins[intervals[row["i"]]].append(row)
        for r, (lo, hi, below) in list(open_ranks.items()):
            for row in bins[(lo, hi)]:
                if r < below + row["n"]:
                    open_ranks[r] = (row["lo"], row["hi"], below)
                    break
                below += row["n"]
    out = []
    for p in places:
        low, high = found[int(p)], found[min(int(p) + 1, first["n"] - 1)]
        out.append(low + (high - low) * (p - int(p)))
    return out
