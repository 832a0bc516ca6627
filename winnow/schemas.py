"""Declared schemas; nothing is inferred, because optional fields may be absent from a file."""

from pyspark.sql import types as T

INFO = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("answer_content", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("info", INFO),
    ]
)

# Chat records and simple prompt/completion records share one schema; absent fields are null.
CHAT = T.StructType(
    [
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("extracted_code", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
    ]
)

# Polymorphic fields are read as text: the JSON source keeps nested JSON verbatim in a string.
BENCHMARK_RAW = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "question", "instruction", "problem", "input", "original_text", "prompt",
            "answer", "target", "label", "solution", "output", "ans",
            "reward_model", "unique_id", "id",
        )
    ]
)

CANDIDATE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("finish_reason", T.StringType()),
        T.StructField("stop_reason", T.StringType()),
    ]
)

GENERATIONS = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("candidates", T.ArrayType(CANDIDATE)),
    ]
)

TOKEN_LOGITS = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("logits", T.ArrayType(T.FloatType())),
    ]
)


def entropy_schema(*fields: str) -> T.StructType:
    """`idx` plus one double per entropy field."""
    return T.StructType(
        [T.StructField("idx", T.LongType()), *(T.StructField(f, T.DoubleType()) for f in fields)]
    )
