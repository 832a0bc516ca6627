"""Benchmark tables: normalisation, counts, token budgets, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from winnow import constants as K
from winnow.functions import text as X
from winnow.functions.fields import first_present, is_json_object, json_object_field, with_question
from winnow.functions.stage import stage
from winnow.operators.checks import ValidationError, check
from winnow.session import materialize


def _nested_as_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the form JSON sources deliver them in."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *(
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def normalised(df: DataFrame, *, position: str = "position", protocol: str = "paper") -> DataFrame:
    """`id, position, question, answer, error`; `error` is null for a usable row.

    The prompt is the question under the strict protocol, or when a reward mapping exists; else the
    first present question field. The answer is the mapping's ground truth, else the first present
    answer field. No row is dropped.
    """
    rows = _nested_as_json(df)
    names = set(rows.columns)
    none = F.lit(None).cast("string")
    reward = F.col("reward_model").cast("string") if "reward_model" in names else none
    rows = stage(rows, _has_reward=is_json_object(reward))
    has_reward = F.col("_has_reward")
    asked = first_present(rows, K.QUESTION_FIELDS)
    if "prompt" in names:
        by_prompt = F.col("prompt").isNotNull()
        if protocol != "opd":
            by_prompt = by_prompt & has_reward
        asked = F.when(by_prompt, F.col("prompt")).otherwise(asked)
    truth = F.when(has_reward, json_object_field(reward, "ground_truth"))
    keys = [F.col(c).cast("string") for c in ("unique_id", "id") if c in names]

    staged = rows.select(
        F.coalesce(*keys, F.col(position).cast("string")).alias("id"),
        F.col(position).cast("bigint").alias("position"),
        asked.alias("_asked"),
        F.coalesce(truth, first_present(rows, K.ANSWER_FIELDS)).alias("_answer"),
    )
    staged = with_question(
        staged, "_asked", require_user_only=protocol == "opd", question="_text", error="_broken"
    )
    staged = stage(staged, _question=X.strip(F.col("_text")), _final=X.strip(F.col("_answer")))
    missing = F.concat_ws(
        ", ",
        F.when(F.col("_asked").isNull(), F.lit("question")),
        F.when(F.col("_answer").isNull(), F.lit("answer")),
    )
    error = (
        F.when(missing != "", F.concat(F.lit("lacks "), missing))
        .when(F.col("_broken").isNotNull(), F.col("_broken"))
        .when(F.col("_question") == "", F.lit("empty question"))
        .when(F.col("_final") == "", F.lit("empty answer"))
    )
    return staged.select(
        "id",
        "position",
        F.when(error.isNull(), F.col("_question")).alias("question"),
        F.when(error.isNull(), F.col("_final")).alias("answer"),
        error.alias("error"),
    )


def accepted(
    rows: DataFrame, *, dataset: str | None = None, validate_count: bool = False
) -> DataFrame:
    """Normalised rows after failing on any violation, on an empty table, or on a wrong count."""
    check(rows.where("error is not null"), "malformed benchmark rows")
    if rows.isEmpty():
        raise ValidationError("benchmark is empty")
    if validate_count and dataset:
        named = rows.select(F.lit(dataset).alias("dataset"))
        check(count_audit(named).where("not ok"), f"wrong row count of {dataset}")
    return rows.drop("error")


def expected_counts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.EXPECTED_ROWS.items()), "dataset string, expected bigint")


def count_audit(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows per benchmark against the expected count; unknown benchmarks pass."""
    counts = df.groupBy(X.canonical_name(F.col(dataset)).alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    audit = counts.join(F.broadcast(expected_counts(df.sparkSession)), "dataset", "left")
    return audit.withColumn(
        "ok", F.coalesce(F.col("n_rows") == F.col("expected"), F.lit(True))
    )


def token_limits(spark: SparkSession, protocol: str = "paper") -> DataFrame:
    """Token limits per benchmark; the row with the empty name is the default."""
    if protocol not in K.TOKEN_LIMITS:
        raise ValueError(f"unknown protocol: {protocol}")
    rows = [(name, *limits) for name, limits in K.TOKEN_LIMITS[protocol].items()]
    return spark.createDataFrame(
        rows, "dataset string, max_input_tokens int, max_new_tokens int, max_model_len int"
    )


def with_limits(df: DataFrame, dataset: str = "dataset", protocol: str = "paper") -> DataFrame:
    """Add the token limits of each row's benchmark. The lookup table has four rows."""
    limits = token_limits(df.sparkSession, protocol)
    names = [c for c in limits.columns if c != "dataset"]
    known = F.broadcast(limits.where("dataset <> ''").withColumnRenamed("dataset", "_name"))
    default = K.TOKEN_LIMITS[protocol][""]
    joined = df.withColumn("_canon", X.canonical_name(F.col(dataset))).join(
        known, F.col("_canon") == F.col("_name"), "left"
    )
    return joined.select(
        *df.columns, *(F.coalesce(F.col(n), F.lit(d)).alias(n) for n, d in zip(names, default))
    )


def token_count(token_ids: Column) -> Column:
    """Tokens of a tokenised prompt."""
    return F.size(token_ids)


def word_count(prompt: Column) -> Column:
    """White-space words, a stand-in where no token ids are logged."""
    return F.size(F.filter(F.split(prompt, r"\s+"), lambda w: w != ""))


def budget_violations(
    df: DataFrame,
    *,
    prompt: str = "prompt",
    tokens: str = "prompt_tokens",
    dataset: str = "dataset",
    protocol: str = "paper",
) -> DataFrame:
    """Rows whose prompt is over the input limit or, under the strict protocol, holds a system turn.

    `dataset` needs no limit columns; they are looked up.
    """
    over = F.col(tokens) > F.col("max_input_tokens")
    marked = F.lit(protocol == "opd") & F.contains(F.col(prompt), F.lit(K.SYSTEM_MARKER))
    return (
        with_limits(df, dataset, protocol)
        .withColumns({"over_limit": over, "system_turn": marked})
        .where("over_limit or system_turn")
    )


def check_budget(violations: DataFrame, position: str = "position", tokens: str = "prompt_tokens") -> None:
    """Fail on any violation, with the count and the first five."""
    first = violations.orderBy(position).limit(5).select(position, tokens).collect()
    if first:
        raise ValidationError(
            f"{violations.count()} prompts exceed their budget; first={[tuple(r) for r in first]}"
        )


# --- fingerprints ------------------------------------------------------------------------------


def pair_json(question: Column, answer: Column) -> Column:
    """A stripped (question, answer) pair as compact JSON."""
    return F.to_json(F.array(X.strip(question), X.strip(answer)))


BLOCK_ROWS = 4096


def semantic_digest(
    df: DataFrame,
    *,
    position: str = "position",
    question: str = "question",
    answer: str = "answer",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row, `n_rows` and `sha256`: a tree of SHA-256 digests over the ordered pairs.

    A leaf is the JSON array of the pairs of one block of positions; a node is the digests below it, one
    a line, again in blocks. A table of one block so has the digest of the plain JSON array, and a larger
    one needs no task to see more than a block. A repeated, null or negative position fails. An empty table has the
    digest of `[]`.
    """
    rows = df.select(F.col(position).cast("bigint").alias("at"), pair_json(F.col(question), F.col(answer)).alias("pair"))
    check(rows.where("at is null or at < 0"), "rows without a position from 0 on")
    rows = materialize(rows.select("at", "pair", F.expr(f"floor(at / {block_rows})").alias("block")), "digest-pairs")
    # More rows than a block has positions are found before any list is built.
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    check(sizes, "repeated positions")
    held = F.array_sort(F.collect_list(F.struct("at", "pair")))
    blocks = rows.groupBy("block").agg(held.alias("held"), F.count(F.lit(1)).alias("n"))
    places = F.transform("held", lambda r: r["at"])
    blocks = blocks.withColumn("held", F.when(F.size(F.array_distinct(places)) == F.col("n"), F.col("held")))
    text = F.concat(F.lit("["), F.array_join(F.transform("held", lambda r: r["pair"]), ","), F.lit("]"))
    nodes = materialize(blocks.select("block", "n", F.sha2(text.cast("binary"), 256).alias("sha256")), "digest-blocks")
    check(nodes.where("sha256 is null").select("block"), "blocks with repeated positions")
    while nodes.count() > 1:
        below = F.array_sort(F.collect_list(F.struct("block", "sha256")))
        joined = F.array_join(F.transform(below, lambda r: r["sha256"]), "\n")
        upper = nodes.groupBy(F.expr(f"floor(block / {block_rows})").alias("above"))
        upper = upper.agg(F.sum("n").alias("n"), F.sha2(joined.cast("binary"), 256).alias("sha256"))
        nodes = materialize(upper.withColumnRenamed("above", "block"), "digest-blocks")
    none = F.sha2(F.lit("[]").cast("binary"), 256)
    return nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.first("sha256"), none).alias("sha256"))


def semantic_sha256(df: DataFrame, **options: object) -> str:
    """The digest of `semantic_digest` alone."""
    return semantic_digest(df, **options).first()["sha256"]


def fingerprint(df: DataFrame, *, position: str, question: str, answer: str) -> DataFrame:
    """One row that changes with any pair and with the order, computed by partial aggregation.

    Each row hashes its position together with its pair; count, xor and sum of the hashes do not
    depend on how rows are distributed. Every value is led by its length, and a null is a dash, so
    that different rows never hash the same text.
    """

    def sized(c: Column) -> Column:
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    values = (F.col(position).cast("string"), X.strip(F.col(question)), X.strip(F.col(answer)))
    digest = F.md5(F.concat(*(sized(v) for v in values)).cast("binary"))
    high = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 16, 8), 16, 10).cast("bigint")
    return df.select(high.alias("high"), low.alias("low")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor("high").alias("hash_xor"),
        F.sum(F.col("low").cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"),
    )


def exported(
    df: DataFrame, *, question: str, answer: str, question_as: str = "question", order: str | None = None
) -> DataFrame:
    """Stripped question and answer of the rows that own both."""
    rows = df.where(F.col(question).isNotNull() & F.col(answer).isNotNull())
    return rows.select(
        *([order] if order else []),
        X.strip(F.col(question)).alias(question_as),
        X.strip(F.col(answer).cast("string")).alias("answer"),
    )
