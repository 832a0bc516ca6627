"""Sinks. Spark's commit protocol makes each of them appear whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from winnow.operators.checks import ValidationError
from winnow.session import materialize

SAFE = "errorifexists"
REPLACE = "overwrite"


def write_mode(overwrite: bool) -> str:
    """Existing artefacts are kept unless replacement is asked for."""
    return REPLACE if overwrite else SAFE


def write_jsonl(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    df.write.mode(write_mode(overwrite)).option("ignoreNullFields", False).json(path)


def write_sorted_jsonl(
    df: DataFrame, path: str, *, by: str = "idx", overwrite: bool = False
) -> None:
    """JSON lines in the order of `by`: range-partitioned files, each sorted."""
    write_jsonl(df.orderBy(by), path, overwrite=overwrite)


def write_detail_csv(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Detail table as CSV with header and quoted line breaks; an empty table is an error.

    The rows are written once to the shared folder first, so that looking for one grades nothing twice.
    """
    rows = materialize(df, "detail")
    if rows.isEmpty():
        raise ValidationError("cannot write an empty result table")
    (
        rows.write.mode(write_mode(overwrite))
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .csv(path)
    )


def with_provenance(summary: DataFrame, **fields: object) -> DataFrame:
    """Add provenance values and the time of the run to a summary row; lists and dicts stay nested."""
    rows = summary
    for name, value in fields.items():
        text = F.lit(json.dumps(value))
        nested = isinstance(value, (dict, list))
        rows = rows.withColumn(name, F.from_json(text, F.schema_of_json(text)) if nested else F.lit(value))
    return rows.withColumn("timestamp_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def named_metrics(summary: DataFrame, n_samples: int) -> DataFrame:
    """Metric names that carry n, next to the older names of the same values."""
    mean, passed = F.col("mean_at_n"), F.col("pass_at_n")
    return summary.select(
        *(c for c in summary.columns if c not in ("mean_at_n", "pass_at_n")),
        mean.alias(f"mean_at_{n_samples}"),
        passed.alias("observed_pass_at_k"),
        mean.alias("mean_accuracy"),
        mean.alias("acc"),
        F.col("correct_generations").alias("correct"),
        F.col("n_generations").alias("total"),
        F.col("n_samples").alias("repeat"),
        passed.alias("pass_at_k"),
        F.col("passed_prompts").alias("pass_success"),
        F.col("n_prompts").alias("orig_total"),
        *([] if n_samples == 1 else [passed.alias(f"pass_at_{n_samples}")]),
    )


def write_summary(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """One-row summary as one JSON file."""
    df.coalesce(1).write.mode(write_mode(overwrite)).option("ignoreNullFields", False).json(path)


def preview(df: DataFrame, rows: int = 3) -> list[dict]:
    """First rows for display."""
    return [r.asDict(recursive=True) for r in df.limit(rows).collect()]
