"""Text columns: stripping, answer extraction, names and prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from winnow import constants as K


# What Python's str.strip removes: Unicode white space and the four information separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Strip Unicode white space at both ends; `trim` would only take blanks."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def nonempty(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.when(c != "", c)


def last(matches: Column) -> Column:
    """Last element of a match array, null when there is none."""
    return F.try_element_at(matches, F.lit(-1))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


# --- answers ---------------------------------------------------------------------------------


def answer_number(c: Column) -> Column:
    """Last number of the text with thousands commas removed; null when there is none."""
    found = all_matches(F.replace(c, F.lit(","), F.lit("")), K.NUMBER_PATTERN)
    return last(found).cast("double")


def answer_choice(c: Column) -> Column:
    """Choice letter: the last boxed letter, else the last "answer is (X)"; upper case."""
    boxed = all_matches(c, "(?iU)" + K.BOXED_LETTER_PATTERN, 1)
    stated = all_matches(c, "(?iU)" + K.STATED_LETTER_PATTERN, 1)
    return F.upper(F.coalesce(last(boxed), last(stated)))


def answer_boxed(c: Column) -> Column:
    """Last boxed value whose braces nest one level at most, stripped."""
    return strip(last(all_matches(c, K.BOXED_PATTERN, 1)))


def last_box(c: Column) -> Column:
    """Value of the box that closes last, with braces nested to any depth, stripped.

    One pass over the signs from the first box on. Boxes still open are kept on a stack, so one that
    never closes hides none inside it. An empty box counts for nothing; null when there is no box.
    """
    head = "\\boxed{"
    first = F.locate(head, c)
    tail = F.when(first > 0, F.substring(c, first, F.length(c)))
    tokens = all_matches(tail, r"\\boxed\{|[^{}\\]+|[{}\\]")
    kind = "struct<at:int,depth:int,open:array<struct<at:int,depth:int>>,first:int,end:int>"
    nothing = F.array().cast("array<struct<at:int,depth:int>>")

    def state(at, depth, opened, begin, end) -> Column:
        return F.struct(
            at.cast("int").alias("at"),
            depth.cast("int").alias("depth"),
            opened.alias("open"),
            begin.cast("int").alias("first"),
            end.cast("int").alias("end"),
        ).cast(kind)

    def step(s: Column, token: Column) -> Column:
        at, depth, opened = s["at"] + F.length(token), s["depth"], s["open"]
        box = F.struct(at.cast("int").alias("at"), (depth + 1).cast("int").alias("depth"))
        inner = F.try_element_at(opened, F.lit(-1))
        filled = s["at"] > inner["at"]
        closed = state(
            at,
            depth - 1,
            F.slice(opened, F.lit(1), F.greatest(F.size(opened) - 1, F.lit(0))),
            F.when(filled, inner["at"]).otherwise(s["first"]),
            F.when(filled, s["at"]).otherwise(s["end"]),
        )
        return (
            F.when(token == head, state(at, depth + 1, F.concat(opened, F.array(box)), s["first"], s["end"]))
            .when(token == "{", state(at, depth + 1, opened, s["first"], s["end"]))
            .when((token == "}") & (inner["depth"] == depth), closed)
            .when(token == "}", state(at, depth - 1, opened, s["first"], s["end"]))
            .otherwise(state(at, depth, opened, s["first"], s["end"]))
        )

    def value(s: Column) -> Column:
        return F.when(s["end"] > s["first"], F.substring(tail, s["first"] + 1, s["end"] - s["first"]))

    zero = F.lit(0)
    return strip(F.aggregate(tokens, state(zero, zero, nothing, zero, zero), step, value))


def answer_choices(c: Column) -> Column:
    """Choices "(A) x (B) y" as array<struct<letter, value>>.

    Letters stand in order of first appearance; a repeated letter keeps its last value.
    """
    pattern = "(?Ud)" + K.CHOICE_PATTERN
    letters, values = all_matches(c, pattern, 1), all_matches(c, pattern, 2)
    # Pairs in text order; the lambdas below run once per question and once per letter.
    pairs = F.arrays_zip(letters.alias("letter"), values.alias("value"))
    merged = F.aggregate(
        pairs,
        F.array().cast("array<struct<letter:string,value:string>>"),
        _replace_or_append,
    )
    return F.transform(
        merged,
        lambda m: F.struct(
            m["letter"].alias("letter"),
            F.regexp_replace(strip(m["value"]), r"\.+$", "").alias("value"),
        ),
    )


def _replace_or_append(found: Column, pair: Column) -> Column:
    """Pairs found so far with one more: in place of an earlier one of the same letter, or last."""
    known = F.exists(found, lambda f: f["letter"] == pair["letter"])
    replaced = F.transform(found, lambda f: F.when(f["letter"] == pair["letter"], pair).otherwise(f))
    return F.when(known, replaced).otherwise(F.concat(found, F.array(pair)))


def format_score(c: Column) -> Column:
    """0.25 when the whole text is a think block, then an answer block with a boxed value."""
    return F.when(c.rlike("(?sdU)" + K.FORMAT_PATTERN), F.lit(K.FORMAT_SCORE)).otherwise(F.lit(0.0))


# --- names -----------------------------------------------------------------------------------


def canonical_name(c: Column) -> Column:
    """Benchmark name: lower case, letters and digits only, aliases resolved."""
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    out = plain
    for alias, name in K.BENCHMARK_ALIASES.items():
        out = F.when(plain == alias, F.lit(name)).otherwise(out)
    return out


def name_from_path(c: Column) -> Column:
    """Canonical name of the parent folder, or of the file stem when there is no folder."""
    path = F.regexp_replace(c, r"^[a-z]+:/+", "/")
    folder = F.regexp_extract(path, r"([^/]+)/+[^/]+$", 1)
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return canonical_name(F.when(folder.isin("", ".", ".."), stem).otherwise(folder))


def safe_component(c: Column) -> Column:
    """Text usable as one path component, `model` when nothing remains."""
    clean = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(clean == "", F.lit("model")).otherwise(clean)


def grading_method(name: Column) -> Column:
    """Grading method of a benchmark name."""
    canon = canonical_name(name)
    return (
        F.when(canon.isin(*K.NUMBER_GRADED), F.lit("simple_number"))
        .when(canon.isin(*K.CHOICE_GRADED), F.lit("multiple_choice"))
        .otherwise(F.lit("latex"))
    )


# --- prompts ---------------------------------------------------------------------------------


def render_plain_prompt(question: Column, system: str | None = K.SYSTEM_PROMPT) -> Column:
    """Template-free prompt: `role: content` blocks, then an open assistant turn."""
    blocks = [] if system is None else [F.lit(f"system: {system}")]
    blocks.append(F.concat(F.lit("user: "), question))
    blocks.append(F.lit("assistant:"))
    return F.concat_ws("\n\n", *blocks)


def render_chat_prompt(
    question: Column,
    system: str | None = K.SYSTEM_PROMPT,
    *,
    turn_prefix: str | None = None,
    turn_suffix: str = "",
    generation_prefix: str = "",
    strict: bool = False,
) -> Column:
    """Prompt from template parts; `{role}` in `turn_prefix` names the speaker.

    Without a template the plain form is used; `strict` refuses that.
    """
    if turn_prefix is None:
        if strict:
            raise ValueError("a chat template is required, the plain form is refused")
        return render_plain_prompt(question, system)
    parts: list[Column] = []
    if system is not None:
        parts.append(F.lit(turn_prefix.format(role="system") + system + turn_suffix))
    parts += [F.lit(turn_prefix.format(role="user")), question]
    parts.append(F.lit(turn_suffix + generation_prefix))
    return F.concat(*parts)


def render_instruction(instruction: Column, output: Column) -> Column:
    """Instruction/response training text."""
    return F.concat(F.lit(K.INSTRUCTION_HEAD), instruction, F.lit(K.INSTRUCTION_MIDDLE), output)
