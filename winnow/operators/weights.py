"""Sampling weights from per-sample entropies and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow import constants as K
from winnow.functions.exact import exact_quantiles, exact_sum
from winnow.operators.groups import with_group_stats
from winnow.session import materialize


def _with_one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row."""
    return df.crossJoin(F.broadcast(stats))


def _positive(lo: float, c: Column) -> Column:
    return F.when(c != 0, c).otherwise(F.lit(lo))


def normalised(raw: str, out: str, df: DataFrame, *, floor: float | None = None) -> DataFrame:
    """Divide a column by its total; a total that is not positive is replaced by `floor`, or gives
    the uniform weight when there is no floor."""
    stats = df.agg(exact_sum(F.col(raw)).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    rows = _with_one_row(df, stats)
    if floor is None:
        weight = F.when(F.col("_sum") > 0, F.col(raw) / F.col("_sum")).otherwise(
            F.lit(1.0) / F.col("_rows")
        )
    else:
        weight = F.col(raw) / F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.lit(floor))
    kept = [c for c in df.columns if c not in (raw, out)]
    return rows.select(*kept, weight.alias(out))


def _complete(df: DataFrame, *fields: str) -> DataFrame:
    """Fail on a sample without one of its entropies, which would otherwise pass as zero, or with an infinite one."""
    names = F.lit(f"sample without a value for {', '.join(fields)}")

    def checked(name: str) -> Column:
        c = F.col(name).cast("double")
        finite = F.coalesce(F.abs(c) < float("inf"), F.lit(False))
        return F.when(~finite, F.raise_error(names).cast("double")).otherwise(c)

    return df.withColumns({name: checked(name) for name in fields})


def ada_weights(df: DataFrame, alpha: float = 0.1, beta: float = 0.8, gamma: float = 0.1) -> DataFrame:
    """Weights from entropy level, entropy drop and entropy rise between two checkpoints.

    Adds `delta_entropy` and `sampling_weight`. The narrow input is written once, because the
    totals, the normaliser and the weights each need a pass over it.
    """
    h0, delta = F.col("entropy_0"), F.col("delta_entropy")
    rows = materialize(_complete(df, "entropy_0", "entropy_1"), "ada").withColumn(
        "delta_entropy", F.col("entropy_1") - F.col("entropy_0")
    )
    totals = rows.agg(
        exact_sum(h0).alias("_z1"),
        exact_sum(F.when(delta < 0, -delta).otherwise(0.0)).alias("_z2"),
        exact_sum(F.when(delta > 0, delta).otherwise(0.0)).alias("_z3"),
    ).select(*(_positive(K.ADA_EPS, F.col(z)).alias(z) for z in ("_z1", "_z2", "_z3")))
    level = alpha * (h0 / F.col("_z1"))
    drop = F.when(delta < 0, beta * (-delta / F.col("_z2"))).otherwise(0.0)
    rise = F.when(delta > 0, gamma * (delta / F.col("_z3"))).otherwise(0.0)
    raw = F.greatest(level + drop + rise, F.lit(0.0))
    scored = _with_one_row(rows, totals).select(*rows.columns, raw.alias("_raw"))
    return normalised("_raw", "sampling_weight", scored, floor=K.ADA_EPS)


def brown_weights(
    df: DataFrame,
    alpha: float = 1.0,
    beta: float = 1.0,
    gamma: float = 1.0,
    easy_quantile: float = 0.2,
    hard_quantile: float = 0.8,
    patience: int = 2,
    easy_patience: int = 2,
    lambda_time: float = 1.0,
    lambda_easy: float = 1.0,
) -> DataFrame:
    """Weights from difficulty, trend and how long a sample stayed hard or easy over three rounds.

    Adds `sampling_weight`. The input is written once, because thresholds, spread and weights each
    need a pass over it.
    """
    eps = K.BROWN_EPS
    rows = materialize(_complete(df, "entropy_0", "entropy_1", "entropy_2"), "brown")
    easy, hard = exact_quantiles(rows, "entropy_2", [easy_quantile, hard_quantile])

    improve = F.col("entropy_0") - F.col("entropy_2")
    mean = rows.agg((exact_sum(improve) / F.count(F.lit(1))).alias("_mean"))
    spread = _with_one_row(rows, mean).agg(
        F.sqrt(
            exact_sum((improve - F.col("_mean")) * (improve - F.col("_mean")))
            / F.count(F.lit(1))
        ).alias("_std")
    )

    def clip(c: Column, lo: float, hi: float) -> Column:
        return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))

    def rounds(test) -> Column:
        return sum(
            (F.when(test(F.col(f"entropy_{k}")), 1).otherwise(0) for k in range(3)), F.lit(0)
        )

    difficulty = clip((F.col("entropy_2") - easy) / (hard - easy + eps), 0.0, 1.0) + eps
    trend = clip(1.0 + 0.5 * (improve / (F.col("_std") + eps)), 0.1, 10.0)
    hard_over = F.greatest(F.lit(0), rounds(lambda e: e > hard) - patience)
    easy_over = F.greatest(F.lit(0), rounds(lambda e: e < easy) - easy_patience)
    raw = F.greatest(
        F.pow(difficulty, F.lit(alpha))
        * F.pow(trend, F.lit(beta))
        * F.pow(F.exp(-lambda_time * hard_over), F.lit(gamma))
        * F.exp(-lambda_easy * easy_over),
        F.lit(eps),
    )
    scored = _with_one_row(rows, spread).select(*df.columns, raw.alias("_raw"))
    return normalised("_raw", "sampling_weight", scored, floor=eps)


def sampling_weights(df: DataFrame, method: str, **params: float) -> DataFrame:
    """Weights by method name."""
    if method == "adaboost":
        return ada_weights(df, **params)
    if method == "brownboost":
        return brown_weights(df, **params)
    raise ValueError(f"unknown weighting method: {method}")


def batch_loss_weights(
    df: DataFrame,
    ce: str = "ce",
    *,
    batch: list[str],
    alpha: float = 2.0,
    w_min: float = 0.2,
    w_max: float = 5.0,
    scale_by_mean: bool = True,
    out: str = "weight",
) -> DataFrame:
    """Weights that grow with a sample's loss relative to its batch's mean loss, clipped."""
    rows, ratio = df, F.col(ce)
    if scale_by_mean:
        rows = with_group_stats(df, batch, {"_mean": F.avg(ce)})
        ratio = F.col(ce) / F.greatest(F.col("_mean"), F.lit(1e-8))
    weight = F.least(F.greatest(F.exp(alpha * ratio), F.lit(w_min)), F.lit(w_max))
    return rows.select(*df.columns, weight.alias(out))
