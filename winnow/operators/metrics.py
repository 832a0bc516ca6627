"""Evaluation rows and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow.functions import text as X
from winnow.operators.groups import with_group_stats

_WORD_BITS = 62


def truncated(finish_reason: Column, output_tokens: Column, max_new_tokens: Column) -> Column:
    return (finish_reason == "length") | (output_tokens >= max_new_tokens)


def exploded(
    benchmark: DataFrame, generations: DataFrame, *, position: str = "position", candidates: str = "candidates"
) -> DataFrame:
    """One row per candidate, benchmark columns repeated, in sample order from zero.

    Both tables have a row per prompt, so neither is broadcast: the size of a compressed file promises
    less than its rows take in the driver's memory.
    """
    rows = generations.select(
        position, F.posexplode(candidates).alias("sample_index", "_candidate")
    )
    return benchmark.hint("merge").join(rows, position).select(
        *benchmark.columns, "sample_index", "_candidate.*"
    )


def with_latency(
    df: DataFrame,
    *,
    position: str = "position",
    logged: str = "batch_latency",
    batch_size: int = 128,
    out: str = "latency_s_per_prompt",
) -> DataFrame:
    """Latency of a row's batch divided by the prompts in it; batches are runs of positions.

    Apply it to the table of one row per position, before candidates are exploded, where there is one.
    """
    batched = df.withColumn("_batch", F.expr(f"{position} div {batch_size}"))
    prompts = F.count_if(F.col("sample_index") == 0) if "sample_index" in df.columns else F.count(F.lit(1))
    rows = with_group_stats(batched, ["_batch"], {"_slowest": F.max(logged), "_prompts": prompts})
    return rows.select(
        *df.columns, F.round(F.col("_slowest") / F.col("_prompts"), 6).alias(out)
    )


def detail(df: DataFrame, *, max_new_tokens: Column, text: str = "text") -> DataFrame:
    """Evaluation rows from graded candidates with their benchmark columns.

    `df` holds id, position, sample_index, question, answer, the candidate's fields and `verified`;
    `grader_error`, `prompt_tokens` and `latency_s_per_prompt` are null when not given.
    """

    def given(name: str, kind: str) -> Column:
        c = F.col(name) if name in df.columns else F.lit(None)
        return c.cast(kind).alias(name)

    tokens = F.size("token_ids")
    return df.select(
        "id",
        F.col("id").alias("orig_id"),
        "position",
        "sample_index",
        "question",
        F.col("answer").alias("ground_truth"),
        X.strip(F.col(text)).alias("response"),
        F.to_json("token_ids").alias("token_ids"),
        tokens.alias("output_tokens"),
        "finish_reason",
        "stop_reason",
        (F.col("finish_reason") == "stop").alias("normal_stop"),
        truncated(F.col("finish_reason"), tokens, max_new_tokens).alias("truncated"),
        "verified",
        F.coalesce(F.col("verified"), F.lit(False)).cast("int").alias("correct"),
        given("grader_error", "string"),
        given("prompt_tokens", "int"),
        given("latency_s_per_prompt", "double"),
    )


def incomplete_prompts(
    df: DataFrame, n_samples: int, *, keys: list[str] | None = None, sample: str = "sample_index"
) -> DataFrame:
    """Prompts whose sample indices are not exactly 0..n-1.

    Counts and bit masks, one 62-bit word per 62 samples: partial aggregates of fixed size, where a
    collected index list would grow with the group.
    """
    keys = keys or ["position"]
    facts, whole = _sample_facts(n_samples, sample)
    groups = df.groupBy(*keys).agg(*facts)
    return groups.where(~whole).select(
        *keys,
        F.col("_found").alias("n_found"),
        F.col("_first_index").alias("first_index"),
        F.col("_last_index").alias("last_index"),
    )


def _sample_facts(n_samples: int, sample: str) -> tuple[list[Column], Column]:
    """Aggregates over a prompt's sample indices, and the test on them for exactly 0..n-1."""
    index = F.col(sample)
    words = range(0, n_samples, _WORD_BITS)
    full = [(1 << min(_WORD_BITS, n_samples - w)) - 1 for w in words]
    bit = [
        F.coalesce(
            F.bit_or(
                F.when(
                    index.between(w, w + _WORD_BITS - 1),
                    F.call_function(
                        "shiftleft", F.lit(1).cast("bigint"), (index - w).cast("int")
                    ),
                )
            ),
            F.lit(0),
        ).alias(f"_w{w}")
        for w in words
    ]
    facts = [
        F.count(F.lit(1)).alias("_found"),
        F.min(sample).alias("_first_index"),
        F.max(sample).alias("_last_index"),
        *bit,
    ]
    whole = (F.col("_found") == n_samples) & (F.col("_first_index") == 0)
    for w, mask in zip(words, full):
        whole = whole & (F.col(f"_w{w}") == F.lit(mask).cast("bigint"))
    return facts, F.coalesce(whole, F.lit(False))


def wrong_candidate_counts(
    generations: DataFrame, n_samples: int, *, candidates: str = "candidates"
) -> DataFrame:
    """Prompts with another number of candidates than asked for."""
    return generations.where(F.coalesce(F.size(candidates), F.lit(-1)) != n_samples)


def summary(
    df: DataFrame, n_samples: int, *, by: list[str] | None = None, validate: bool = True
) -> DataFrame:
    """mean@n, pass@n, first-sample accuracy and counts; one row, or one per `by` group.

    pass@1 is given only for n = 1: the first of several samples is a diagnostic, not a pass@1 run.
    Truncation and grader-error metrics follow when their columns exist. With `validate`, a prompt
    whose sample indices are not exactly 0..n-1 fails the job, and so does an empty table unless
    there are groups: no rows, no groups. Both are checked in the same aggregation.
    """
    by = by or []
    right = F.coalesce(F.col("correct").cast("int"), F.lit(0))
    per_prompt = [
        F.max(right).alias("_passed"),
        F.min_by(right, F.col("sample_index")).alias("_first"),
        F.sum(right).alias("_right"),
        F.count(F.lit(1)).alias("_n"),
    ]
    extra = []
    total = F.sum("_n")
    if "truncated" in df.columns:
        per_prompt.append(F.count_if(F.col("truncated")).alias("_cut"))
        extra += [
            F.sum("_cut").alias("truncated_generations"),
            (F.sum("_cut") / total).alias("truncation_rate"),
        ]
    if "grader_error" in df.columns:
        per_prompt.append(F.count("grader_error").alias("_failed"))
        extra.append(F.sum("_failed").alias("grader_errors"))
    facts, whole = _sample_facts(n_samples, "sample_index") if validate else ([], F.lit(True))
    prompts = df.groupBy(*by, "position").agg(*per_prompt, *facts)
    if validate:
        # A filter, which column pruning cannot take away.
        text = F.concat(
            F.lit(f"sample indices must be 0..{n_samples - 1}: position "),
            F.coalesce(F.col("position").cast("string"), F.lit("null")),
        )
        prompts = prompts.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))
    n_prompts = F.count(F.lit(1))
    first = F.sum("_first") / n_prompts
    out = prompts.groupBy(*by).agg(
        n_prompts.alias("n_prompts"),
        total.alias("n_generations"),
        F.lit(n_samples).alias("n_samples"),
        F.sum("_right").alias("correct_generations"),
        F.sum("_first").alias("first_sample_correct"),
        first.alias("first_sample_accuracy"),
        F.sum("_passed").alias("passed_prompts"),
        (F.sum("_right") / total).alias("mean_at_n"),
        (first if n_samples == 1 else F.lit(None).cast("double")).alias("pass_at_1"),
        (F.sum("_passed") / n_prompts).alias("pass_at_n"),
        *extra,
    )
    if not validate or by:
        return out
    nothing = F.raise_error(F.lit("no rows to summarise")).cast("boolean")
    return out.where(F.when(F.col("n_prompts") > 0, F.lit(True)).otherwise(nothing))


def latest_version(
    listing: DataFrame, *, folder: str = "folder", name: str = "name", prefix: str = "checkpoint"
) -> DataFrame:
    """Per folder, the entry `prefix-<number>` with the highest number, compared as a number."""
    number = F.regexp_extract(name, rf"^{prefix}-(\d+)$", 1)
    rows = listing.withColumn("_number", X.nonempty(number).cast("decimal(38,0)")).where(
        "_number is not null"
    )
    return rows.groupBy(folder).agg(
        F.max_by(name, F.col("_number")).alias("latest"), F.count(F.lit(1)).alias("versions")
    )
