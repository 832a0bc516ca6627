"""Columns over optional and polymorphic fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from winnow.functions import text as X
from winnow.functions.stage import stage


def first_present(df: DataFrame, fields: Sequence[str]) -> Column:
    """First field holding a value, as text. Blank text counts as missing, zero does not."""
    types = {f.name: f.dataType for f in df.schema.fields}
    picks = []
    for name in fields:
        if name in types:
            c = F.col(name)
            usable = c.isNotNull()
            if isinstance(types[name], T.StringType):
                usable = ~X.is_blank(c)
            picks.append(F.when(usable, c.cast("string")))
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def _json_starts(c: Column, opener: str) -> Column:
    return F.ltrim(c).startswith(opener)


def json_object_field(c: Column, field: str) -> Column:
    """A field of a JSON object given as text; null when the text is not an object."""
    return F.when(_json_starts(c, "{"), F.get_json_object(c, f"$.{field}"))


def is_json_object(c: Column) -> Column:
    """Whether the text is a valid JSON object."""
    return _kind(c) == "OBJECT"


_MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)


def _kind(c: Column) -> Column:
    """Leading type name of a JSON text's root; empty when the text is not JSON."""
    schema = F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit(""))
    return F.regexp_extract(schema, "^[A-Z]+", 0)


def with_question(
    df: DataFrame,
    value: str,
    *,
    require_user_only: bool = False,
    question: str = "question",
    error: str = "error",
) -> DataFrame:
    """Add the question of a prompt and an error text, one of the two null.

    The prompt is plain text, one message, or a list of messages, the last two as JSON text. List
    items may be JSON text themselves. Exactly one user message must remain; a missing role means
    user, an explicit null does not. `require_user_only` refuses any other message.
    """
    prompt, kind = F.col(value), F.col("_kind")
    rows = stage(df, _kind=_kind(prompt))
    items = F.when(kind == "ARRAY", F.from_json(prompt, T.ArrayType(T.StringType()))).when(
        kind == "OBJECT", F.array(prompt)
    )
    rows = stage(rows, _items=items)
    content = "$.content"
    rows = stage(
        rows,
        _messages=F.transform("_items", lambda i: F.from_json(i, _MESSAGE)),
        _valid=F.forall(
            "_items",
            lambda i: F.coalesce(
                F.schema_of_variant(F.try_variant_get(F.try_parse_json(i), content, "variant"))
                == "STRING",
                F.lit(False),
            ),
        ),
    )

    def is_user(message: Column, place: Column) -> Column:
        keys = F.json_object_keys(F.get("_items", place))
        absent = F.when(~F.array_contains(keys, "role"), F.lit("user"))
        return F.coalesce(message["role"], absent) == "user"

    users = F.filter("_messages", is_user)
    rows = stage(rows, _users=users)
    n_users, structured = F.size("_users"), F.col("_items").isNotNull()
    problem = F.when(structured & ~F.col("_valid"), F.lit("invalid message"))
    if require_user_only:
        problem = problem.when(
            structured & ((F.size("_messages") != 1) | (n_users != 1)), F.lit("not one user message")
        )
    problem = problem.when(structured & (n_users != 1), F.lit("not exactly one user message"))
    rows = stage(rows, _problem=problem)
    asked = F.when(structured, F.try_element_at("_users", F.lit(1))["content"]).otherwise(prompt)
    return rows.select(
        *df.columns,
        F.when(F.col("_problem").isNull(), asked).alias(question),
        F.col("_problem").alias(error),
    )
