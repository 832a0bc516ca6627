"""Training pairs (prompt, completion) from chat or prompt/completion records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from winnow import constants as K
from winnow.functions import text as X
from winnow.functions.messages import first_message


def uses_template(path: str) -> bool:
    """Whether the records of a path still need a chat template."""
    return not any(name in path.lower() for name in K.UNTEMPLATED_DATASETS)


def routed_completion(
    messages: Column, extracted_code: Column, sources: tuple[str, ...] = K.CODE_SOURCES
) -> Column:
    """Completion by source: code sources take the structured answer, others the assistant text.

    The structured answer is the user's, else the assistant's, else the extracted code; empty text
    counts as absent.
    """
    user, assistant = first_message(messages, "user"), first_message(messages, "assistant")
    structured = F.coalesce(
        X.nonempty(user["info"]["answer_content"]),
        X.nonempty(assistant["info"]["answer_content"]),
        X.nonempty(extracted_code),
    )
    return F.when(user["info"]["source"].isin(*sources), structured).otherwise(
        assistant["content"]
    )


def training_pairs(
    df: DataFrame,
    *,
    eos: str,
    route_by_source: bool = True,
    template: dict[str, str] | None = None,
    system: str | None = K.SYSTEM_PROMPT_TRAINING,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """`prompt` and `completion` columns; records without a usable pair are left out.

    `df` follows `schemas.CHAT`: messages where present, else prompt and completion. `template`
    holds the parts for `render_chat_prompt`; without it the prompt is used as it is.
    """
    m = F.col("messages")
    user, assistant = first_message(m, "user"), first_message(m, "assistant")
    usable = (F.size(m) >= 2) & user.isNotNull() & assistant.isNotNull()
    answer = routed_completion(m, F.col("extracted_code")) if route_by_source else assistant["content"]
    is_chat = m.isNotNull()
    prompt = X.strip(F.when(is_chat, F.when(usable, user["content"])).otherwise(F.col("prompt")))
    completion = X.strip(F.when(is_chat, F.when(usable, answer)).otherwise(F.col("completion")))

    raw = df.select(*keep, prompt.alias("prompt"), completion.alias("completion"))
    raw = raw.where((F.col("prompt") != "") & (F.col("completion") != ""))
    rendered = F.col("prompt")
    if template is not None:
        rendered = X.render_chat_prompt(F.col("prompt"), system, **template)
    return raw.select(
        *keep,
        rendered.alias("prompt"),
        F.concat(F.col("completion"), F.lit(eos)).alias("completion"),
    )


def math_pairs(df: DataFrame, *, eos: str, template: dict[str, str] | None, **options) -> DataFrame:
    """Pairs with completion routing and the training system prompt."""
    return training_pairs(df, eos=eos, template=template, **options)


def code_pairs(
    df: DataFrame, *, eos: str, template: dict[str, str] | None = None, **options
) -> DataFrame:
    """Pairs without routing and without a system prompt."""
    return training_pairs(
        df, eos=eos, template=template, route_by_source=False, system=None, **options
    )
