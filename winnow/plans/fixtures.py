"""Inputs derived from the given tables, each as a DataFrame and as the SQL the checks use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from winnow.functions.stage import stage
from winnow.operators.ordering import SCAN_ORDER, with_scan_order
from winnow.session import spread

N_SAMPLES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for costly work per row, spread over the cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def md5_number(text: Column, digits: int) -> Column:
    """The first hex digits of an md5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


# --- generations: several graded answers per part ------------------------------------------------


def _response(h: Column) -> Column:
    wrong_by = F.when(h % 3 == 0, F.lit(0)).otherwise(1 + h % 5)
    boxed = F.concat(
        F.lit("\\boxed{"), (F.col("p_size") + wrong_by).cast("string"), F.lit("}")
    )
    return F.concat(
        F.lit("<think>"),
        F.col("p_name"),
        F.lit("</think> <answer>"),
        F.when(h % 10 == 0, F.lit("none")).otherwise(boxed),
        F.lit("</answer>"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`position, sample_index, question, answer, response, finish_reason, output_tokens`."""
    h = F.col("h")
    part = wide_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(N_SAMPLES - 1))).alias("sample_index"),
    )
    seed = F.concat_ws(":", F.lit("gen"), F.col("p_partkey"), F.col("sample_index"))
    return part.withColumn("h", md5_number(seed, 8)).select(
        F.col("p_partkey").alias("position"),
        "sample_index",
        F.col("p_name").alias("question"),
        F.col("p_size").cast("string").alias("answer"),
        _response(h).alias("response"),
        F.when(h % 7 == 0, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"),
        (100 + h % 4000).cast("int").alias("output_tokens"),
    )


GENERATIONS_SQL = r"""
generations AS (
  SELECT p_partkey AS position, s AS sample_index, p_name AS question,
         CAST(p_size AS VARCHAR) AS answer, h,
         '<think>' || p_name || '</think> <answer>' ||
         CASE WHEN h % 10 = 0 THEN 'none'
              ELSE '\boxed{' || CAST(p_size + CASE WHEN h % 3 = 0 THEN 0 ELSE 1 + h % 5 END AS VARCHAR) || '}'
         END || '</answer>' AS response,
         CASE WHEN h % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
         CAST(100 + h % 4000 AS INTEGER) AS output_tokens
  FROM (SELECT p.*, s, CAST('0x' || substr(md5('gen:' || p_partkey || ':' || s), 1, 8) AS BIGINT) AS h
        FROM part p, (SELECT CAST(unnest(range(8)) AS INTEGER) AS s))
)
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations as one candidate list per position; a position has eight at most."""
    ids = F.transform(
        F.sequence(F.lit(1), F.col("output_tokens") % 5 + 1), lambda i: i.cast("int")
    )
    candidate = F.struct(
        F.col("response").alias("text"),
        ids.alias("token_ids"),
        "finish_reason",
        F.when(F.col("finish_reason") == "stop", F.lit("151645")).alias("stop_reason"),
    )
    rows = generations(spark, sf_dir).select("position", "sample_index", candidate.alias("c"))
    # One column per sample index instead of a collected list.
    return rows.groupBy("position").agg(
        F.array(
            *(F.max(F.when(F.col("sample_index") == s, F.col("c"))) for s in range(N_SAMPLES))
        ).alias("candidates")
    )


# --- chat records --------------------------------------------------------------------------------


def raw_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat record per part, with every reason for a drop occurring."""
    h = F.col("h")
    seed = F.concat_ws(":", F.lit("gen"), F.col("p_partkey"), F.lit(0))
    rows = with_scan_order(table(spark, sf_dir, "part")).withColumn("h", md5_number(seed, 8))
    content = (
        F.when(h % 17 == 0, F.lit("  \n"))
        .when(h % 13 == 0, F.lit("KodCode"))
        .otherwise(_response(h))
    )
    reference = F.when(h % 11 != 0, F.col("p_size").cast("string"))
    none = F.lit(None).cast("string")

    def info(ref: Column) -> Column:
        return F.struct(
            F.col("p_type").alias("source"), ref.alias("reference_answer"), none.alias("answer_content")
        )

    user = F.struct(
        F.lit("user").alias("role"), F.col("p_name").alias("content"), info(reference).alias("info")
    )
    assistant = F.struct(
        F.lit("assistant").alias("role"), content.alias("content"), info(none).alias("info")
    )
    messages = F.when(h % 19 == 0, F.array(user)).otherwise(F.array(user, assistant))
    rows = rows.select(F.col("p_partkey").alias("key"), messages.alias("messages"), *SCAN_ORDER)
    return stage(rows, messages=F.col("messages"))


RAW_CHAT_SQL = r"""
raw_chat AS (
  SELECT position AS key, question,
         CASE WHEN h % 19 = 0 THEN 1 ELSE 2 END AS n_messages,
         CASE WHEN h % 17 = 0 THEN '' WHEN h % 13 = 0 THEN 'KodCode' ELSE response END AS content,
         CASE WHEN h % 11 <> 0 THEN answer END AS reference
  FROM generations WHERE sample_index = 0
), reasons AS (
  SELECT key, question, content, reference,
         CASE WHEN n_messages < 2 OR content = '' OR trim(question) = '' THEN 'structural'
              WHEN content = 'KodCode' THEN 'denied'
              WHEN content NOT LIKE '<think>%</think> <answer>%\boxed{%}%</answer>' THEN 'format'
              WHEN reference IS NULL THEN 'no_reference'
              WHEN regexp_extract(content, '\\boxed\{([^{}]*)\}', 1) <> reference THEN 'incorrect'
         END AS reason
  FROM raw_chat
)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def first_turns(rows: DataFrame) -> DataFrame:
    """First user and assistant text and the turn count per conversation, from flat turns.

    Partial aggregates: no conversation is collected, whatever its length.
    """

    def first(role: str) -> Column:
        here = F.col("role") == role
        return F.min_by(F.when(here, F.col("text")), F.when(here, F.col("turn")))

    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        first("user").alias("user_text"),
        first("assistant").alias("assistant_text"),
    )


def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records for training pairs, sources and fallback answers varied by key."""
    h = F.col("conv_id")
    rows = first_turns(turns(spark, sf_dir))
    source = F.when(h % 5 == 0, F.lit("codeio")).when(h % 5 == 1, F.lit("prime")).otherwise(F.lit("web"))
    none = F.lit(None).cast("string")

    def info(answer: Column) -> Column:
        return F.struct(source.alias("source"), none.alias("reference_answer"), answer.alias("answer_content"))

    user = F.struct(
        F.lit("user").alias("role"),
        F.col("user_text").alias("content"),
        info(F.when(h % 3 == 0, F.concat(F.lit(" u"), h.cast("string"))).otherwise("")).alias("info"),
    )
    assistant = F.struct(
        F.lit("assistant").alias("role"),
        F.col("assistant_text").alias("content"),
        info(F.when(h % 3 == 1, F.concat(F.lit("a"), h.cast("string"), F.lit("\n")))).alias("info"),
    )
    is_simple = h % 7 == 0
    return rows.select(
        F.col("conv_id").alias("key"),
        F.when(~is_simple, F.array(user, assistant)).alias("messages"),
        F.when(h % 2 == 0, F.concat(F.lit("x"), h.cast("string"))).alias("extracted_code"),
        F.when(is_simple, F.col("user_text")).alias("prompt"),
        F.when(is_simple, F.col("assistant_text")).alias("completion"),
    )


FIRST_TURNS_SQL = """
first_turns AS (
  SELECT conv_id, count(*) AS n_messages,
         arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text,
         arg_min(text, turn) FILTER (WHERE role = 'assistant') AS assistant_text
  FROM conversations GROUP BY conv_id
)
"""


# --- entropies -------------------------------------------------------------------------------------


def entropy_table(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """`idx, entropy_k` per order: an integer sum over a count, exact in any engine."""
    scale = {0: ("l_discount", 100), 1: ("l_tax", 100), 2: ("l_quantity", 1)}
    column, factor = scale[k]
    total = F.sum(F.round(F.col(column) * factor).cast("bigint"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("idx"))
        .agg((total / F.count(F.lit(1))).alias(f"entropy_{k}"))
    )


def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`idx, entropy_0, entropy_1, entropy_2` in one pass."""
    n = F.count(F.lit(1))

    def mean(column: str, factor: int) -> Column:
        return F.sum(F.round(F.col(column) * factor).cast("bigint")) / n

    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("idx"))
        .agg(
            mean("l_discount", 100).alias("entropy_0"),
            mean("l_tax", 100).alias("entropy_1"),
            mean("l_quantity", 1).alias("entropy_2"),
        )
    )


ENTROPIES_SQL = """
entropies AS (
  SELECT l_orderkey AS idx,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS entropy_0,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS entropy_1,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) / count(*) AS entropy_2
  FROM lineitem GROUP BY l_orderkey
)
"""


# --- logits ----------------------------------------------------------------------------------------

PROMPT_LEN = 2


def token_logits(spark: SparkSession, sf_dir: str, *, second: bool = False) -> DataFrame:
    """`idx, pos, label, logits`: eight tokens per sample, 64 logits each."""
    rows = table(spark, sf_dir, "embeddings")
    key = F.col("vec_id").bitwiseXOR(F.lit(1)) if second else F.col("vec_id")
    # The product is rounded to float here and in the SQL, so both start from the same logits.
    logits = F.transform("embedding", lambda x: (x * F.lit(20).cast("float")).cast("float"))
    return rows.select(
        F.floor(key / 8).cast("bigint").alias("idx"),
        (key % 8).cast("int").alias("pos"),
        "label",
        logits.alias("logits"),
    )


LOGITS_SQL = """
logits AS (
  SELECT vec_id // 8 AS idx, CAST(vec_id % 8 AS INTEGER) AS pos, label,
         [CAST(x * CAST(20 AS FLOAT) AS DOUBLE) for x in embedding] AS logits
  FROM embeddings
), logits_b AS (
  SELECT xor(vec_id, 1) // 8 AS idx, CAST(xor(vec_id, 1) % 8 AS INTEGER) AS pos,
         [CAST(x * CAST(20 AS FLOAT) AS DOUBLE) for x in embedding] AS logits
  FROM embeddings
), norms AS (
  SELECT idx, pos, label, logits, peak + ln(list_sum([exp(x - peak) for x in logits])) AS norm
  FROM (SELECT *, list_max(logits) AS peak FROM logits)
)
"""


# --- benchmark rows ------------------------------------------------------------------------------


def benchmark_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows under varied field names; `doc_id % 29` gives blank and missing values."""
    d = F.col("doc_id")
    text = (
        F.when(d % 29 == 1, F.lit("  "))
        .when(d % 29 == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n")))
    )
    answer = F.when(d % 29 != 3, F.col("n_chars"))
    message = F.struct(F.lit("user").alias("role"), F.concat(F.lit("p"), d.cast("string")).alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.lit("s").alias("content"))
    prompt = F.when(d % 31 == 0, F.to_json(F.array(message))).when(
        d % 31 == 1, F.to_json(F.array(system, message))
    ).when(d % 31 == 2, F.to_json(F.array(message, message)))
    reward = F.when(
        (d % 31 <= 2) | (d % 31 == 4), F.to_json(F.struct(F.concat(F.lit("g"), d).alias("ground_truth")))
    ).when(d % 31 == 5, F.lit("[1]"))
    return wide_table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select(
        d.alias("position"),
        F.when(d % 3 == 0, text).alias("question"),
        F.when(d % 3 == 1, text).alias("instruction"),
        F.when(d % 3 == 2, text).alias("problem"),
        F.when(d % 2 == 0, answer).alias("answer"),
        F.when(d % 2 == 1, answer).alias("ans"),
        prompt.alias("prompt"),
        reward.alias("reward_model"),
        F.when(d % 4 == 0, F.concat(F.lit("u"), d.cast("string"))).alias("unique_id"),
    )


# --- files -----------------------------------------------------------------------------------------


# A frame that readers skip, with one byte in it: the line feed that the text writer adds.
_SKIPPED = b"\x50\x2a\x4d\x18\x01\x00\x00\x00"
FRAME_ROWS = 500
WINDOWS = (21, 28)  # as powers of two, by turns


def write_zst_jsonl(df: DataFrame, path: str) -> None:
    """Write JSON lines as zstd frames of small and large windows, through Spark's text writer."""

    def frames(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, FRAME_ROWS):
                lines = batch.column(0).slice(at, FRAME_ROWS).to_pylist()
                log = WINDOWS[at // FRAME_ROWS % len(WINDOWS)]
                press = zstandard.ZstdCompressor(
                    compression_params=zstandard.ZstdCompressionParameters(window_log=log)
                ).compressobj()
                text = "".join(f"{line}\n" for line in lines).encode()
                out.append(press.compress(text) + press.flush() + _SKIPPED)
            yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})

    lines = df.select(F.to_json(F.struct("*")).alias("line"))
    lines.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string")).write.text(path)
