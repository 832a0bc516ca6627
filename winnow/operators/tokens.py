"""Operators on logged logits, one row per token: `(idx, pos, label, logits)`."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from winnow import constants as K
from winnow.functions import logits as L
from winnow.functions.exact import exact_sum
from winnow.session import shared_path


def is_answer(pos: Column, prompt_len: Column, max_tokens: int | None = None) -> Column:
    """Positions after the prompt, and before the cut when there is one."""
    after = pos >= prompt_len
    return after if max_tokens is None else after & (pos < max_tokens)


def masked_label(
    pos: Column, label: Column, prompt_len: Column, max_tokens: int | None = None
) -> Column:
    """Label of answer tokens, the ignored value elsewhere."""
    return F.when(is_answer(pos, prompt_len, max_tokens), label).otherwise(
        F.lit(K.IGNORED_LABEL)
    )


def sample_entropy(
    df: DataFrame,
    *,
    prompt_len: Column,
    idx: str = "idx",
    pos: str = "pos",
    logits: str = "logits",
    max_tokens: int | None = None,
    out: str = "entropy",
) -> DataFrame:
    """Mean entropy of the answer tokens of each sample, 0.0 when it has none.

    A map and a partial average: logits never cross a shuffle, and masked ones never reach Python.
    """
    answer = F.when(is_answer(F.col(pos), prompt_len, max_tokens), F.col(logits))
    tokens = df.select(idx, L.token_entropy(answer).alias("_h"))
    return tokens.groupBy(idx).agg(F.coalesce(F.avg("_h"), F.lit(0.0)).alias(out))


def sample_cross_entropy(
    df: DataFrame, *, idx: str = "idx", label: str = "label", logits: str = "logits", out: str = "ce"
) -> DataFrame:
    """Mean cross entropy over the labelled tokens of each sample; 0.0 when all are ignored."""
    valid = F.when(F.col(label) != K.IGNORED_LABEL, F.col(logits))
    tokens = df.select(idx, L.token_cross_entropy(valid, F.col(label)).alias("_ce"))
    return tokens.groupBy(idx).agg(
        (F.coalesce(F.sum("_ce"), F.lit(0.0)) / F.greatest(F.count("_ce"), F.lit(1))).alias(out)
    )


def weighted_loss(df: DataFrame, *, ce: str = "ce", weight: str = "weight") -> DataFrame:
    """One row: weighted mean loss with weights of at least 1e-8."""
    w = F.greatest(F.col(weight), F.lit(1e-8))
    return df.agg((exact_sum(w * F.col(ce)) / exact_sum(w)).alias("loss"))


def with_weighted_loss(
    df: DataFrame, *, ce: str = "ce", weight: str = "weight", out: str = "loss"
) -> DataFrame:
    """Per-sample loss times weight."""
    return df.withColumn(out, F.col(weight) * F.col(ce))


def bucketed(df: DataFrame, buckets: int, *, keys: tuple[str, ...] = ("idx", "pos")) -> DataFrame:
    """`df` written once in the shared folder, bucketed and sorted by token.

    Tables of as many buckets join by token without an exchange, however many of them are mixed and
    however often. Rows are dealt to their buckets first, so each bucket is one file.
    """
    spark = df.sparkSession
    name = f"winnow_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    writer = rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", shared_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def mix_logits(
    models: list[DataFrame],
    *,
    lam: float = 0.5,
    keys: tuple[str, ...] = ("idx", "pos"),
    logits: str = "logits",
) -> DataFrame:
    """Logits of several models mixed per token.

    The join moves whole logit rows unless the tables are `bucketed` alike, which needs no exchange. The
    token key is unique, so no group can be hot.
    """
    joined = models[0].withColumnRenamed(logits, "_l0")
    for number, model in enumerate(models[1:], 1):
        other = model.select(*keys, F.col(logits).alias(f"_l{number}"))
        joined = joined.join(other, list(keys))
    parts = [f"_l{n}" for n in range(len(models))]
    rest = [c for c in joined.columns if c not in parts]
    return joined.select(*rest, L.mix([F.col(p) for p in parts], lam).alias(logits))


def next_token_loss(
    df: DataFrame, *, idx: str = "idx", pos: str = "pos", label: str = "label", logits: str = "logits"
) -> DataFrame:
    """One row: mean cross entropy of each token's logits against the following label.

    The following label comes from a join on (idx, pos), which keeps a long sample spread; a window would
    put a sample in one task. Labels are moved to the tokens before them; logits lying in buckets stay.
    """
    following = df.where(F.col(label) != K.IGNORED_LABEL).select(
        idx, (F.col(pos) - 1).cast(df.schema[pos].dataType).alias(pos), F.col(label).alias("_next")
    )
    return _mean_loss(df.select(idx, pos, logits).join(following, [idx, pos]), logits)


def _mean_loss(tokens: DataFrame, logits: str) -> DataFrame:
    losses = tokens.select(L.token_cross_entropy(F.col(logits), F.col("_next")).alias("_ce"))
    return losses.agg(
        F.count("_ce").alias("tokens"), (exact_sum(F.col("_ce")) / F.count("_ce")).alias("loss")
    )


def with_margin(
    df: DataFrame, *, label: str = "label", logits: str = "logits", out: str = "margin"
) -> DataFrame:
    """Target logit minus the mean of the others, per token."""
    return df.withColumn(out, L.margin(F.col(logits), F.col(label)))
