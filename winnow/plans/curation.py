"""Curation queries: text, messages, filters, the indexed result, training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow import constants as K
from winnow.functions import fields
from winnow.functions import text as X
from winnow.functions.messages import first_content
from winnow.operators import curate, pairs
from winnow.plans import fixtures as S
from winnow.plans.registry import query, with_ctes
from winnow.session import shared_path
from winnow.sources import jsonl, sinks

RAW = with_ctes(S.GENERATIONS_SQL, S.RAW_CHAT_SQL)
TURNS = with_ctes(S.FIRST_TURNS_SQL)
TEMPLATE = {"turn_prefix": "<|{role}|>\n", "turn_suffix": "<|end|>\n", "generation_prefix": "<|assistant|>\n"}
EOS = "<|eos|>"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(TURNS + "SELECT conv_id, n_messages, user_text, assistant_text FROM first_turns")
def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_turns(S.turns(spark, sf_dir))


@query(
    """
    SELECT position AS key, question AS user_text,
           CASE WHEN h % 19 = 0 THEN '' WHEN h % 17 = 0 THEN '  ' || chr(10)
                WHEN h % 13 = 0 THEN 'KodCode' ELSE response END AS assistant_text
    FROM generations WHERE sample_index = 0
    """.replace("SELECT", with_ctes(S.GENERATIONS_SQL) + "SELECT", 1)
)
def first_messages_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return S.raw_chat(spark, sf_dir).select(
        "key",
        first_content(m, "user", missing="").alias("user_text"),
        first_content(m, "assistant", missing="").alias("assistant_text"),
    )


@query("SELECT doc_id, text FROM documents")
def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped in blanks, tabs, no-break and ideographic spaces and separators."""
    pads = ["", " \n", "　\t", "  ", "\x1c\x1f", " \r\n"]
    pad = F.element_at(F.array(*(F.lit(p) for p in pads)), (F.col("doc_id") % len(pads) + 1).cast("int"))
    padded = F.concat(pad, F.col("text"), pad)
    return S.wide_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.strip(padded).alias("text"))


@query(
    """
    SELECT position, coalesce(
             CASE WHEN trim(question) <> '' THEN question END,
             CASE WHEN trim(instruction) <> '' THEN instruction END,
             CASE WHEN trim(problem) <> '' THEN problem END) AS question,
           CAST(coalesce(answer, ans) AS VARCHAR) AS answer
    FROM (SELECT doc_id AS position,
                 CASE WHEN doc_id % 3 = 0 THEN t END AS question,
                 CASE WHEN doc_id % 3 = 1 THEN t END AS instruction,
                 CASE WHEN doc_id % 3 = 2 THEN t END AS problem,
                 CASE WHEN doc_id % 2 = 0 THEN a END AS answer,
                 CASE WHEN doc_id % 2 = 1 THEN a END AS ans
          FROM (SELECT doc_id, CASE WHEN doc_id % 29 = 1 THEN '  ' WHEN doc_id % 29 = 2 THEN NULL
                                    ELSE ' ' || text || chr(10) END AS t,
                       CASE WHEN doc_id % 29 <> 3 THEN n_chars END AS a FROM documents))
    """
)
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.benchmark_raw(spark, sf_dir).drop("prompt")
    return rows.select(
        "position",
        fields.first_present(rows, K.QUESTION_FIELDS).alias("question"),
        fields.first_present(rows, K.ANSWER_FIELDS).alias("answer"),
    )


@query(
    """
    SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS k,
           event_id % 5 <> 0 AS is_object
    FROM events
    """
)
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth value is an array, which is no mapping."""
    value = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(
        F.col("props")
    )
    return S.table(spark, sf_dir, "events").select(
        "event_id",
        fields.json_object_field(value, "k").alias("k"),
        fields.is_json_object(value).alias("is_object"),
    )


# --- filters ---------------------------------------------------------------------------------------


@query(RAW + "SELECT key FROM reasons WHERE reason IS DISTINCT FROM 'structural'")
def filter_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.raw_chat(spark, sf_dir).where(curate.is_structural(F.col("messages"))).select("key")


@query(RAW + "SELECT key FROM raw_chat WHERE n_messages = 2 AND content <> 'KodCode'")
def filter_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = X.strip(first_content(F.col("messages"), "assistant"))
    return S.raw_chat(spark, sf_dir).where(~content.isin(*K.DENIED_CONTENT)).select("key")


@query(
    RAW
    + r"""SELECT key, CASE WHEN n_messages = 2 AND
                 content LIKE '<think>%</think> <answer>%\boxed{%}%</answer>' THEN 0.25
                 ELSE 0.0 END::DOUBLE AS score FROM raw_chat"""
)
def format_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = X.strip(first_content(F.col("messages"), "assistant"))
    return S.raw_chat(spark, sf_dir).select("key", X.format_score(content).alias("score"))


@query(RAW + "SELECT key, reference FROM raw_chat WHERE reference IS NOT NULL")
def filter_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.raw_chat(spark, sf_dir).select(
        "key", curate.reference_answer(F.col("messages")).alias("reference")
    )
    return rows.where("reference is not null")


@query(RAW + "SELECT key FROM reasons WHERE reason IS NULL")
def filter_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.kept(curate.with_drop_reason(S.raw_chat(spark, sf_dir))).select("key")


@query(RAW + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY 1")
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.drop_report(curate.with_drop_reason(S.raw_chat(spark, sf_dir)))


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curate.indexed(curate.kept(curate.with_drop_reason(S.raw_chat(spark, sf_dir))))
    m = F.col("messages")
    return rows.select(
        "idx",
        "key",
        first_content(m, "user").alias("question"),
        first_content(m, "assistant").alias("content"),
    )


_CURATED_SQL = (
    RAW
    + """SELECT row_number() OVER (ORDER BY key) - 1 AS idx, key, question, content
         FROM reasons WHERE reason IS NULL"""
)


@query(_CURATED_SQL)
def curated_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curated(spark, sf_dir)


@query(_CURATED_SQL)
def curated_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexed records as JSON lines, read back."""
    rows, path = _curated(spark, sf_dir), shared_path(spark, "curated")
    sinks.write_jsonl(rows, path)
    return jsonl.scan_jsonl_strict(spark, path, rows.schema)


@query(f"SELECT * FROM ({_CURATED_SQL}) WHERE idx < 1000")
def curated_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.head(_curated(spark, sf_dir), K.HEAD_ROWS)


# --- training pairs --------------------------------------------------------------------------------

_ROUTED = """
SELECT conv_id AS key, user_text, assistant_text,
       CASE WHEN conv_id % 7 <> 0 AND conv_id % 5 <= 1 THEN
            coalesce(CASE WHEN conv_id % 3 = 0 THEN 'u' || conv_id END,
                     CASE WHEN conv_id % 3 = 1 THEN 'a' || conv_id END,
                     CASE WHEN conv_id % 2 = 0 THEN 'x' || conv_id END)
            ELSE assistant_text END AS routed
FROM first_turns
"""


@query(TURNS + f"SELECT key, routed AS completion FROM ({_ROUTED}) WHERE key % 7 <> 0")
def completion_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.pair_records(spark, sf_dir).where("messages is not null")
    routed = pairs.routed_completion(F.col("messages"), F.col("extracted_code"))
    return rows.select("key", X.strip(routed).alias("completion"))


@query(
    TURNS
    + f"""SELECT key, '<|system|>' || chr(10) || {_sql_text(K.SYSTEM_PROMPT_TRAINING)} || '<|end|>'
                 || chr(10) || '<|user|>' || chr(10) || user_text || '<|end|>' || chr(10)
                 || '<|assistant|>' || chr(10) AS prompt,
                 routed || '<|eos|>' AS completion
          FROM ({_ROUTED}) WHERE user_text <> '' AND routed <> ''"""
)
def pairs_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = TEMPLATE if pairs.uses_template(f"{sf_dir}/conversations") else None
    return pairs.math_pairs(
        S.pair_records(spark, sf_dir), eos=EOS, template=template, keep=("key",)
    )


@query(
    TURNS
    + """SELECT conv_id AS key, user_text AS prompt, assistant_text || '<|eos|>' AS completion
         FROM first_turns WHERE user_text <> '' AND assistant_text <> ''"""
)
def pairs_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.code_pairs(S.pair_records(spark, sf_dir), eos=EOS, keep=("key",))


@query(
    f"""
    SELECT doc_id, 'system: ' || {_sql_text(K.SYSTEM_PROMPT)} || chr(10) || chr(10) || 'user: ' || text
             || chr(10) || chr(10) || 'assistant:' AS plain,
           '<|user|>' || chr(10) || text || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS chat
    FROM documents
    """
)
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wide_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        X.render_plain_prompt(F.col("text")).alias("plain"),
        X.render_chat_prompt(F.col("text"), None, **TEMPLATE, strict=True).alias("chat"),
    )


@query(
    f"""
    SELECT doc_id, '<|system|>' || chr(10) || {_sql_text(K.SYSTEM_PROMPT_BOXED)} || '<|end|>' || chr(10) || '<|user|>' || chr(10)
             || text || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS chat
    FROM documents
    """
)
def render_prompt_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt that asks for a boxed answer, in a chat template with a system turn."""
    prompt = X.render_chat_prompt(F.col("text"), K.SYSTEM_PROMPT_BOXED, **TEMPLATE)
    return S.table(spark, sf_dir, "documents").select("doc_id", prompt.alias("chat"))


@query(
    f"""
    SELECT p_partkey, {_sql_text(K.INSTRUCTION_HEAD)} || p_name || {_sql_text(K.INSTRUCTION_MIDDLE)}
                      || p_type AS text FROM part
    """
)
def render_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").select(
        "p_partkey", X.render_instruction(F.col("p_name"), F.col("p_type")).alias("text")
    )
