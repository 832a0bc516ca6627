"""Evaluation queries: answer extraction, grading, detail rows, metrics, audits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from winnow.functions import grading as G
from winnow.functions import text as X
from winnow.functions.fields import with_question
from winnow.operators import benchmarks, grade as grading, metrics
from winnow.plans import fixtures as S
from winnow.plans.registry import query, with_ctes
from winnow.session import shared_path
from winnow.sources import sinks

GEN = with_ctes(S.GENERATIONS_SQL)

# --- extraction --------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, CAST(list_last(regexp_extract_all(replace(text, ',', ''), '-?[0-9]+(?:\.[0-9]+)?'))
                            AS DOUBLE) AS number FROM documents"""
)
def answer_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wide_table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", X.answer_number(F.col("text")).alias("number")
    )


def _choice_text() -> Column:
    """Part names followed by an answer in one of several forms."""
    k = F.col("p_partkey")
    letter = F.substring(F.lit("ABCDE"), (k % 5 + 1).cast("int"), F.lit(1))
    name = F.col("p_name")
    return (
        F.when(k % 6 == 0, F.concat(name, F.lit(" \\boxed{A} then \\boxed{ "), F.lower(letter), F.lit(" }")))
        .when(k % 6 == 1, F.concat(name, F.lit(". The final answer is ("), letter, F.lit(").")))
        .when(k % 6 == 2, F.concat(F.lit("Answer: B or rather answer "), letter))
        .when(k % 6 == 3, F.concat(F.lit("the answer is (D), boxed \\boxed{"), letter, F.lit("}")))
        .when(k % 6 == 4, F.concat(F.lit("Compare A and B before deciding on "), name))
        .otherwise(F.concat(F.lit("answer is Apple, "), name))
    )


_CHOICE_SQL = """
choice AS (
  SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL
         ELSE substr('ABCDE', CAST(p_partkey % 5 + 1 AS INTEGER), 1) END AS letter FROM part
)
"""


@query(with_ctes(_CHOICE_SQL) + "SELECT p_partkey, letter FROM choice")
def answer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wide_table(spark, sf_dir, "part", "p_partkey", "p_name").select(
        "p_partkey", X.answer_choice(_choice_text()).alias("letter")
    )


def _choice_question() -> Column:
    """Five choices with values from size + 1 to size + 5; C is given twice."""
    parts = [F.col("p_name"), F.lit("? ")]
    for n, letter in enumerate("ABCDE", 1):
        parts.append(F.concat(F.lit(f"({letter}) "), (F.col("p_size") + n).cast("string"), F.lit(". ")))
    parts.append(F.concat(F.lit("(C)\n"), (F.col("p_size") + 33).cast("string")))
    return F.concat(*parts)


@query(
    """
    SELECT p_partkey, letter, CAST(p_size + add AS VARCHAR) AS value
    FROM part, (VALUES ('A', 1), ('B', 2), ('C', 33), ('D', 4), ('E', 5)) AS t(letter, add)
    """
)
def answer_choices_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "part").select(
        "p_partkey", F.explode(X.answer_choices(_choice_question())).alias("c")
    )
    return rows.select("p_partkey", "c.letter", "c.value")


_BOXED = r"nullif(regexp_extract(response, '\\boxed\{([^{}]*)\}', 1), '')"


@query(GEN + f"SELECT position, sample_index, {_BOXED} AS boxed FROM generations")
def answer_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.generations(spark, sf_dir).select(
        "position", "sample_index", X.answer_boxed(F.col("response")).alias("boxed")
    )


# --- verification ------------------------------------------------------------------------------------


@query(
    GEN
    + f"""SELECT position, sample_index,
                CASE WHEN number IS NULL THEN false WHEN position % 23 = 0 THEN NULL
                     ELSE number = answer END AS verified
         FROM (SELECT *, {_BOXED} AS number FROM generations)"""
)
def verify_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is no number in every 23rd position."""
    gold = F.when(F.col("position") % 23 == 0, F.lit("seven")).otherwise(F.col("answer"))
    return S.generations(spark, sf_dir).select(
        "position", "sample_index", G.verify_number(F.col("response"), gold).alias("verified")
    )


@query(
    with_ctes(_CHOICE_SQL)
    + "SELECT p_partkey, coalesce(letter = 'C', false) AS verified FROM choice"
)
def verify_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wide_table(spark, sf_dir, "part", "p_partkey", "p_name").select(
        "p_partkey", G.verify_letter(_choice_text(), F.lit(" c ")).alias("verified")
    )


@query(
    """
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN false WHEN 2 THEN false
             WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN NULL ELSE true END AS verified
    FROM part
    """
)
def verify_choice_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxed size + key % 7 against the choices, where the gold letter C means size + 33."""
    k = F.col("p_partkey") % 7
    add = F.when(k == 3, 33).otherwise(k)
    boxed = F.concat(F.lit("so \\boxed{"), (F.col("p_size") + add).cast("string"), F.lit("}"))
    rows = S.wide_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select(
        "p_partkey", boxed.alias("response"), _choice_question().alias("question"), F.lit("C").alias("gold")
    )
    graded = grading.with_choice_verdict(rows, "response", "question", "gold")
    return graded.select("p_partkey", "verified")


_VERDICT = f"CASE WHEN {_BOXED} IS NULL THEN false ELSE {_BOXED} = answer END"


@query(GEN + f"SELECT position, sample_index, {_VERDICT} AS verified FROM generations")
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grading.with_verdict(S.generations(spark, sf_dir))
    return rows.select("position", "sample_index", "verified")


@query(
    GEN
    + f"""SELECT position, sample_index,
               CASE position % 3 WHEN 0 THEN 'simple_number' WHEN 1 THEN 'multiple_choice'
                    ELSE 'latex' END AS method,
               CASE WHEN position % 3 = 1 THEN false ELSE {_VERDICT} END AS verified
         FROM generations"""
)
def grade_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("position") % 3
    name = F.when(p == 0, "GSM-8K").when(p == 1, "AQuA").otherwise("AIME 25")
    rows = S.generations(spark, sf_dir).withColumn("dataset", name)
    return grading.with_verdict_by_dataset(rows).select(
        "position", "sample_index", "method", "verified"
    )


def _digits_grader(response: str, answer: str) -> dict[str, bool]:
    """Stand-in for a caller's grader: compares the digits of the box, fails without one."""
    found = re.search(r"boxed\{(\d+)\}", response)
    if found is None:
        raise ValueError("no box")
    return {"acc": found.group(1) == answer}


@query(
    GEN
    + f"""SELECT position, sample_index, CASE WHEN {_BOXED} IS NOT NULL THEN {_BOXED} = answer END AS verified,
               CASE WHEN {_BOXED} IS NULL THEN 'ValueError:no box' END AS grader_error
         FROM generations"""
)
def grade_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grading.with_external_verdict(S.generations(spark, sf_dir), _digits_grader)
    return rows.select("position", "sample_index", "verified", "grader_error")


# Gold and response by part, the right answer spoiled in every third; `b` is the number that is spoiled.
_FORM_CASES: list[tuple[str, str, str | None]] = [
    ("{a}x+{b}", "{c}+{a}x", "{c} = {b}"),
    ("({a}, {b})", "\\left({a},{c}\\right)", "{c} = {b}"),
    ("\\{{{a},{b}\\}}", "\\{{{c},{a}\\}}", "{c} = {b}"),
    ("{b}000", "{c}e3", "{c} = {b}"),
    ("{a}\\sqrt{{{b}}}", "\\sqrt{{{d}}}", "{c} = {b}"),
    ("{b}\\%", "{c}/100", "CASE WHEN {c} = {b} THEN true END"),
    ("[{a},{b})", "[{a},{c})", "{c} = {b}"),
    ("\\frac{{x}}{{{b}}}+y", "y+x/{c}", "{c} = {b}"),
]


def _form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`position, question, answer, response`: one case by key, and two cases with a letter as gold."""
    k = F.col("p_partkey") % (len(_FORM_CASES) + 3)
    a, b = F.col("p_size"), F.col("p_partkey") % 50 + 1
    c = b + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)
    values = {"a": a, "b": b, "c": c, "d": a * a * c}

    def filled(pattern: str) -> Column:
        pieces = re.split(r"(\{[abcd]\})", pattern)
        return F.concat(
            *(
                values[p[1]].cast("string") if re.fullmatch(r"\{[abcd]\}", p) else F.lit(p.format())
                for p in pieces
                if p
            )
        )

    answer, response = F.lit("A"), filled("so \\boxed{{x+{c}}}")
    n = len(_FORM_CASES)
    answer = F.when(k == n + 1, F.lit("$c$")).when(k == n + 2, F.lit("7")).otherwise(F.lit("B"))
    stated = F.when(c == b, F.lit("the answer is (C)")).otherwise(F.lit("the answer is D"))
    response = F.when(k == n + 1, stated).when(k == n + 2, F.lit("it is $x$")).otherwise(response)
    for i, (gold, said, _) in enumerate(_FORM_CASES):
        answer = F.when(k == i, filled(gold)).otherwise(answer)
        response = F.when(k == i, F.concat(F.lit("so \\boxed{"), filled(said), F.lit("}"))).otherwise(response)
    question = filled("Which? (A) {a}x (B) {b}+x (C) 7")
    rows = S.wide_table(spark, sf_dir, "part", "p_partkey", "p_size")
    return rows.select(
        F.col("p_partkey").alias("position"), question.alias("question"), answer.alias("answer"), response.alias("response")
    )


def _forms_sql(open_: str) -> str:
    """`position, verified` with `open_` where the native level cannot decide."""
    spoiled = {"a": "p_size", "b": "(p_partkey % 50 + 1)", "c": "(p_partkey % 50 + 1 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)"}
    n = len(_FORM_CASES)
    cases = " ".join(f"WHEN {i} THEN coalesce({verdict.format(**spoiled)}, {open_})" for i, (_, _, verdict) in enumerate(_FORM_CASES))
    right = "{c} = {b}".format(**spoiled)
    cases += f" WHEN {n} THEN CASE WHEN {right} THEN true ELSE {open_} END WHEN {n + 1} THEN {right}"
    return f"SELECT p_partkey AS position, CASE p_partkey % {n + 3} {cases} END AS verified FROM part"


@query(_forms_sql("NULL::BOOLEAN"))
def grade_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite check on sums, tuples, sets, intervals, roots, percent and letters."""
    return grading.with_verdict(_form_rows(spark, sf_dir)).select("position", "verified")


@query(
    f"""
    SELECT *, CASE WHEN position % {len(_FORM_CASES) + 3} = {len(_FORM_CASES) + 2} THEN 'ValueError:no box' END AS grader_error
    FROM ({_forms_sql('false')})
    """
)
def grade_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows; those left open go to a caller's grader, which fails where nothing is boxed."""
    return grading.with_verdict(_form_rows(spark, sf_dir), grader=_digits_or_word_grader).select(
        "position", "verified", "grader_error"
    )


def _digits_or_word_grader(response: str, answer: str) -> bool:
    """Stand-in for a caller's grader: the box is the answer, letter by letter."""
    found = re.search(r"boxed\{(.*)\}", response)
    if found is None:
        raise ValueError("no box")
    return found.group(1) == answer


# --- detail and metrics --------------------------------------------------------------------------------

MAX_NEW_TOKENS = 4


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = S.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("position"),
        F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("question"),
        F.col("p_size").cast("string").alias("answer"),
    )
    seconds = (F.expr("position div 128") % 7 + 1).cast("double")
    timed = metrics.with_latency(benchmark.withColumn("batch_latency", seconds)).drop("batch_latency")
    graded = grading.with_verdict(metrics.exploded(timed, S.candidates(spark, sf_dir)), prediction="text")
    counted = graded.withColumn("prompt_tokens", benchmarks.word_count(F.col("question")))
    return metrics.detail(counted, max_new_tokens=F.lit(MAX_NEW_TOKENS))


_DETAIL_SQL = f"""
detail AS (
  SELECT 'u' || position AS id, 'u' || position AS orig_id, position, sample_index, question,
         answer AS ground_truth, response,
         '[' || array_to_string(range(1, output_tokens % 5 + 2), ',') || ']' AS token_ids,
         CAST(output_tokens % 5 + 1 AS INTEGER) AS output_tokens, finish_reason,
         CASE WHEN finish_reason = 'stop' THEN '151645' END AS stop_reason,
         finish_reason = 'stop' AS normal_stop,
         finish_reason = 'length' OR output_tokens % 5 + 1 >= {MAX_NEW_TOKENS} AS truncated,
         {_VERDICT} AS verified, CAST({_VERDICT} AS INTEGER) AS correct,
         CAST(NULL AS VARCHAR) AS grader_error,
         CAST(len(string_split(question, ' ')) AS INTEGER) AS prompt_tokens,
         round((position // 128 % 7 + 1)::DOUBLE
               / count(*) FILTER (WHERE sample_index = 0) OVER (PARTITION BY position // 128), 6)
           AS latency_s_per_prompt
  FROM generations
)
"""
DETAIL = with_ctes(S.GENERATIONS_SQL, _DETAIL_SQL)


@query(DETAIL + "SELECT * FROM detail")
def eval_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(spark, sf_dir)


_METRICS_SQL = """
SELECT {by} count(*) AS n_prompts, CAST(sum(n) AS BIGINT) AS n_generations, 8 AS n_samples,
       CAST(sum(c) AS BIGINT) AS correct_generations, CAST(sum(f) AS BIGINT) AS first_sample_correct,
       CAST(sum(f) AS DOUBLE) / count(*) AS first_sample_accuracy,
       CAST(sum(p) AS BIGINT) AS passed_prompts, CAST(sum(c) AS DOUBLE) / sum(n) AS mean_at_n,
       CAST(NULL AS DOUBLE) AS pass_at_1, CAST(sum(p) AS DOUBLE) / count(*) AS pass_at_n {more}
FROM (SELECT {by} position, count(*) AS n, sum(correct) AS c, max(correct) AS p,
             max(correct) FILTER (WHERE sample_index = 0) AS f {inner}
      FROM {source} GROUP BY {by} position) {group}
"""


@query(
    GEN
    + _METRICS_SQL.format(
        by="", more="", inner="", group="",
        source=f"(SELECT position, sample_index, CAST({_VERDICT} AS INTEGER) AS correct FROM generations)",
    )
)
def pass_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grading.with_verdict(S.generations(spark, sf_dir))
    graded = rows.select("position", "sample_index", F.col("verified").alias("correct"))
    return metrics.summary(graded, S.N_SAMPLES)


@query(
    DETAIL
    + _METRICS_SQL.format(
        by="dataset,",
        more=""", CAST(sum(t) AS BIGINT) AS truncated_generations,
                CAST(sum(t) AS DOUBLE) / sum(n) AS truncation_rate, CAST(sum(e) AS BIGINT) AS grader_errors""",
        inner=", count(*) FILTER (WHERE truncated) AS t, count(grader_error) AS e",
        source="""(SELECT *, CASE position % 3 WHEN 0 THEN 'aime2025' WHEN 1 THEN 'amc23'
                   ELSE 'math500' END AS dataset FROM detail)""",
        group="GROUP BY dataset",
    )
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row per benchmark, all benchmarks in one job."""
    p = F.col("position") % 3
    name = F.when(p == 0, "aime2025").when(p == 1, "amc23").otherwise("math500")
    rows = _detail(spark, sf_dir).withColumn("dataset", name)
    return metrics.summary(rows, S.N_SAMPLES, by=["dataset"])


@query("SELECT p_partkey AS position, CAST(CASE WHEN p_partkey % 37 = 0 THEN 7 END AS INTEGER) AS n_found "
       "FROM part WHERE p_partkey % 37 = 0 OR p_partkey % 41 = 0")  # fmt: skip
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a candidate lost, or with no list at all."""
    k, eight = F.col("position"), F.col("candidates")
    cut = F.when(k % 37 == 0, F.slice(eight, 1, 7)).when(k % 41 != 0, eight)
    rows = S.candidates(spark, sf_dir).select("position", cut.alias("candidates"))
    wrong = metrics.wrong_candidate_counts(rows, S.N_SAMPLES)
    return wrong.select("position", F.when(F.col("candidates").isNotNull(), F.size("candidates")).alias("n_found"))


@query(GEN + """SELECT position, sample_index, 'said "' || response || '",' || chr(10) || 'then stopped' AS response,
                       finish_reason = 'stop' AS normal_stop, CASE WHEN output_tokens % 3 > 0 THEN output_tokens END AS output_tokens
                FROM generations""")  # fmt: skip
def detail_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with quotes, commas, line breaks and nulls, written as CSV and read back."""
    rows = S.generations(spark, sf_dir).select(
        "position",
        "sample_index",
        F.concat(F.lit('said "'), "response", F.lit('",\nthen stopped')).alias("response"),
        (F.col("finish_reason") == "stop").alias("normal_stop"),
        F.when(F.col("output_tokens") % 3 > 0, F.col("output_tokens")).alias("output_tokens"),
    )
    path = shared_path(spark, "detail-csv")
    sinks.write_detail_csv(rows, path)
    reader = spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"')
    return reader.csv(path)


@query(
    GEN
    + _METRICS_SQL.format(
        by="", more=", 42 AS seed, 'paper' AS protocol", inner="", group="",
        source="(SELECT position, sample_index, CAST(finish_reason = 'stop' AS INTEGER) AS correct FROM generations)",
    )
)
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary with its provenance, written as JSON and read back without the time of the run."""
    stopped = (F.col("finish_reason") == "stop").cast("int").alias("correct")
    rows = S.generations(spark, sf_dir).select("position", "sample_index", stopped)
    out = sinks.with_provenance(metrics.summary(rows, S.N_SAMPLES), seed=42, protocol="paper")
    path = shared_path(spark, "summary")
    sinks.write_summary(out, path)
    return spark.read.schema(out.schema).json(path).drop("timestamp_utc")


@query(
    GEN
    + """, samples AS (
      SELECT position, sample_index FROM generations WHERE h % 97 <> 0
      UNION ALL SELECT position, 3 FROM generations WHERE sample_index = 3 AND position % 41 = 0
    )
    SELECT position, count(*) AS n_found, min(sample_index) AS first_index, max(sample_index) AS last_index
    FROM samples GROUP BY position
    HAVING list_sort(list(sample_index)) <> [0, 1, 2, 3, 4, 5, 6, 7]"""
)
def sample_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations with some samples lost and some repeated."""
    rows = S.generations(spark, sf_dir)
    seed = F.concat_ws(":", F.lit("gen"), F.col("position"), F.col("sample_index"))
    left = rows.where(S.md5_number(seed, 8) % 97 != 0).select("position", "sample_index")
    again = rows.where("sample_index = 3 and position % 41 = 0").select("position", "sample_index")
    return metrics.incomplete_prompts(left.unionByName(again), S.N_SAMPLES)


@query(
    """
    SELECT p_brand AS folder,
           arg_max('checkpoint-' || p_partkey, p_partkey) AS latest, count(*) AS versions
    FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1
    """
)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing with one folder per brand; every fifth entry is no checkpoint."""
    k = F.col("p_partkey")
    start = F.when(k % 5 == 0, F.lit("checkpoint-x")).otherwise(F.lit("checkpoint-"))
    listing = S.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("folder"), F.concat(start, k.cast("string")).alias("name")
    )
    return metrics.latest_version(listing)


# --- benchmark rows and audits -----------------------------------------------------------------------


@query(
    """
    SELECT doc_id AS position, CASE doc_id % 31 WHEN 0 THEN 'p' || doc_id WHEN 1 THEN 'p' || doc_id
             WHEN 2 THEN NULL ELSE text END AS question,
           CASE doc_id % 31 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 0 THEN 'p' || doc_id ELSE text END AS strict,
           CASE doc_id % 31 WHEN 2 THEN 'not exactly one user message' END AS error
    FROM documents
    """
)
def prompt_to_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts as message lists where there are some, else plain text."""
    rows = S.benchmark_raw(spark, sf_dir).select("position", "prompt")
    texts = S.wide_table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("position"), "text")
    value = F.coalesce("prompt", "text")
    rows = rows.join(texts, "position").select("position", value.alias("value"))
    loose = with_question(rows, "value")
    strict = with_question(
        loose, "value", require_user_only=True, question="strict", error="strict_error"
    )
    return strict.select("position", "question", "strict", "error")


@query(
    """
    SELECT CASE WHEN doc_id % 4 = 0 THEN 'u' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id,
           doc_id AS position, CASE WHEN error IS NULL THEN q END AS question,
           CASE WHEN error IS NULL THEN a END AS answer, error
    FROM (
      SELECT *, CASE WHEN q IS NULL AND a IS NULL AND NOT bad THEN 'lacks question, answer'
                     WHEN q IS NULL AND NOT bad THEN 'lacks question'
                     WHEN a IS NULL THEN 'lacks answer'
                     WHEN bad THEN 'not exactly one user message' END AS error
      FROM (
        SELECT doc_id, doc_id % 31 = 2 AS bad,
               CASE WHEN doc_id % 31 <= 1 THEN 'p' || doc_id WHEN doc_id % 31 = 2 THEN NULL
                    WHEN doc_id % 29 = 1 OR doc_id % 29 = 2 THEN NULL ELSE text END AS q,
               CASE WHEN doc_id % 31 <= 2 OR doc_id % 31 = 4 THEN 'g' || doc_id
                    WHEN doc_id % 29 <> 3 THEN CAST(n_chars AS VARCHAR) END AS a
        FROM documents))
    """
)
def normalize_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.normalised(S.benchmark_raw(spark, sf_dir))


@query(
    r"""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'aime2025' WHEN 1 THEN 'math500'
             WHEN 2 THEN 'amc23' ELSE regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '', 'g')
             END AS name,
           regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS folder,
           regexp_replace(p_brand || '_' || p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS component
    FROM part
    """
)
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, "AIME-25")
        .when(k == 1, "MATH 500 (test)")
        .when(k == 2, "amc")
        .otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    )
    path = F.concat(F.lit("file:///data/"), "p_brand", F.lit("/test.json"))
    component = F.concat(F.lit("/"), "p_brand", F.lit("?! "), "p_name", F.lit("__"))
    return S.table(spark, sf_dir, "part").select(
        "p_partkey",
        X.canonical_name(name).alias("name"),
        X.name_from_path(path).alias("folder"),
        X.safe_component(component).alias("component"),
    )


@query(
    """
    SELECT dataset, count(*) AS n_rows, any_value(expected) AS expected,
           coalesce(count(*) = any_value(expected), true) AS ok
    FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'aime2025' WHEN 1 THEN 'math500' ELSE 'other' END AS dataset,
                 CAST(CASE doc_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 500 END AS BIGINT) AS expected FROM documents)
    GROUP BY dataset
    """
)
def row_count_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 3
    name = F.when(d == 0, "AIME").when(d == 1, "math-500").otherwise("other")
    rows = S.table(spark, sf_dir, "documents").select(name.alias("dataset"))
    return benchmarks.count_audit(rows)


@query(
    r"""
    SELECT doc_id AS position, dataset, tokens AS prompt_tokens, lim AS max_input_tokens,
           tokens > lim AS over_limit, marked AS system_turn
    FROM (SELECT doc_id, doc_id % 37 = 0 AS marked,
                 CASE doc_id % 3 WHEN 0 THEN 'aime' WHEN 1 THEN 'math500' ELSE 'x' END AS dataset,
                 CASE doc_id % 3 WHEN 0 THEN 2048 ELSE 1024 END AS lim,
                 CAST(len(regexp_extract_all(text, '\S+')) + CASE WHEN doc_id % 37 = 0 THEN 3 ELSE 2 END
                      AS INTEGER) AS tokens FROM documents)
    WHERE tokens > lim OR marked
    """
)
def budget_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain prompts under the strict protocol; every 37th starts with a system marker."""
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, "aime").when(d % 3 == 1, "math500").otherwise("x")
    prompt = X.render_plain_prompt(F.col("text"), None)
    marked = F.when(d % 37 == 0, F.concat(F.lit("<|im_start|>system "), prompt)).otherwise(prompt)
    rows = S.wide_table(spark, sf_dir, "documents", "doc_id", "text").select(
        d.alias("position"), name.alias("dataset"), marked.alias("prompt")
    )
    counted = rows.withColumn("prompt_tokens", benchmarks.word_count(F.col("prompt")))
    return benchmarks.budget_violations(counted, protocol="opd").select(
        "position", "dataset", "prompt_tokens", "max_input_tokens", "over_limit", "system_turn"
    )
