import hashlib
import json

import pytest
from pyspark.sql import functions as F

from winnow.operators import benchmarks, metrics
from winnow.operators.checks import ValidationError
from winnow.sources import datasets


def write(tmp_path, payload, name="test.json"):
    path = tmp_path / name
    path.write_text(json.dumps(payload))
    return str(path)


def load(spark, path, **options):
    return [r.asDict() for r in datasets.load_benchmark(spark, path, **options).orderBy("position").collect()]


def test_zero_answer_and_aliases(spark, tmp_path):
    rows = load(spark, write(tmp_path, [{"original_text": "q", "ans": 0}]))
    assert rows == [{"id": "0", "position": 0, "question": "q", "answer": "0"}]


def test_prompt_and_reward_beat_alias(spark, tmp_path):
    payload = [{
        "question": "alias",
        "prompt": [{"role": "user", "content": "2+2?"}],
        "reward_model": {"ground_truth": "4"},
        "unique_id": "u1",
    }]
    for protocol in ("opd", "paper"):
        rows = load(spark, write(tmp_path, payload), protocol=protocol)
        assert (rows[0]["id"], rows[0]["question"], rows[0]["answer"]) == ("u1", "2+2?", "4")


def test_prompt_is_last_resort_without_reward(spark, tmp_path):
    payload = [{"question": "q", "prompt": "p", "answer": "1"}, {"question": " ", "prompt": "p", "answer": "1"}]
    assert [r["question"] for r in load(spark, write(tmp_path, payload))] == ["q", "p"]
    assert [r["question"] for r in load(spark, write(tmp_path, payload), protocol="opd")] == ["p", "p"]


@pytest.mark.parametrize(
    "row, protocol, message",
    [
        ({"prompt": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}],
          "reward_model": {"ground_truth": "4"}}, "opd", "not one user message"),
        ({"question": "missing answer"}, "paper", "lacks answer"),
        ({}, "paper", "lacks question, answer"),
        ({"question": "q", "answer": " "}, "paper", "lacks answer"),
        ({"question": "q", "reward_model": {"ground_truth": " "}}, "paper", "empty answer"),
        ({"question": json.dumps([{"role": "user"}]), "answer": 1}, "paper", "invalid message"),
        ({"question": json.dumps([{"role": "user", "content": 5}]), "answer": 1}, "paper", "invalid message"),
        ({"question": json.dumps([{"role": "user", "content": " "}]), "answer": 1}, "paper", "empty question"),
        ({"question": json.dumps([{"role": "assistant", "content": "a"}]), "answer": 1}, "paper",
         "not exactly one user message"),
    ],
)
def test_malformed_rows_fail(spark, tmp_path, row, protocol, message):
    with pytest.raises(ValidationError, match=message):
        load(spark, write(tmp_path, [row]), protocol=protocol)


def test_prompt_forms(spark, tmp_path):
    prompts = [
        "plain", "5", "[not json", json.dumps({"content": "one"}), json.dumps([{"content": "no role"}]),
        json.dumps(["{\"role\": \"user\", \"content\": \"inner\"}"]),
        json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]),
    ]
    rows = load(spark, write(tmp_path, [{"question": p, "answer": 1} for p in prompts]))
    assert [r["question"] for r in rows] == ["plain", "5", "[not json", "one", "no role", "inner", "u"]


def test_empty_and_wrong_count_fail(spark, tmp_path):
    with pytest.raises(ValidationError, match="empty"):
        load(spark, write(tmp_path, []))
    one = write(tmp_path, [{"question": "q", "answer": "1"}])
    with pytest.raises(ValidationError, match="wrong row count"):
        load(spark, one, dataset="aime2025", validate_count=True)
    thirty = write(tmp_path, [{"question": f"q{n}", "answer": n} for n in range(30)])
    assert len(load(spark, thirty, dataset="AIME", validate_count=True)) == 30


def test_limits(spark):
    df = spark.createDataFrame([("MATH-500",), ("aime",), ("amc23",), ("other",)], "dataset string")
    found = {
        protocol: {r["dataset"]: r["max_input_tokens"] + r["max_new_tokens"] * 0 for r in
                   benchmarks.with_limits(df, protocol=protocol).collect()}
        for protocol in ("paper", "opd")
    }
    assert found["paper"] == {"MATH-500": 4096, "aime": 4096, "amc23": 4096, "other": 4096}
    assert found["opd"] == {"MATH-500": 1024, "aime": 2048, "amc23": 2048, "other": 1024}
    row = benchmarks.with_limits(df).where("dataset = 'aime'").first()
    assert (row["max_new_tokens"], row["max_model_len"]) == (8192, 12288)
    with pytest.raises(ValueError):
        benchmarks.token_limits(spark, "none")


def test_budget_check(spark):
    df = spark.createDataFrame([(n, "aime", "p", 2040 + n) for n in range(20)],
                               "position int, dataset string, prompt string, prompt_tokens int")
    over = benchmarks.budget_violations(df, protocol="opd")
    with pytest.raises(ValidationError, match=r"11 prompts .*first=\[\(9, 2049\), \(10, 2050\)"):
        benchmarks.check_budget(over)
    benchmarks.check_budget(over.where("position < 0"))


def test_semantic_checksum_and_fingerprint(spark):
    pairs = [(n, f" q\u00e9\"{n}\n/", f"{n} ") for n in range(50)]
    df = spark.createDataFrame(pairs, "position int, question string, answer string")
    compact = json.dumps([[q.strip(), a.strip()] for _, q, a in pairs], ensure_ascii=False, separators=(",", ":"))
    assert benchmarks.semantic_sha256(df.repartition(4)) == hashlib.sha256(compact.encode()).hexdigest()
    for broken in (df.union(df.limit(1)), df.union(spark.createDataFrame([(None, "q", "a")], df.schema)), df.withColumn("position", F.col("position") - 1)):
        with pytest.raises(ValidationError, match="position"):
            benchmarks.semantic_sha256(broken)
    with pytest.raises(ValidationError, match="repeated"):
        benchmarks.semantic_sha256(spark.createDataFrame([(1, "q", "a")] * 9, df.schema), block_rows=4)
    assert benchmarks.semantic_digest(df.where("false")).first()[:] == (0, hashlib.sha256(b"[]").hexdigest())

    def tree(block):
        """Levels of digests, by position from 5 on."""
        level = {}
        for n, q, a in pairs:
            level.setdefault((n + 5) // block, []).append([q.strip(), a.strip()])
        level = {b: json.dumps(p, ensure_ascii=False, separators=(",", ":")) for b, p in level.items()}
        level = {b: hashlib.sha256(t.encode()).hexdigest() for b, t in level.items()}
        while len(level) > 1:
            upper = {}
            for b in sorted(level):
                upper.setdefault(b // block, []).append(level[b])
            level = {b: hashlib.sha256("\n".join(d).encode()).hexdigest() for b, d in upper.items()}
        return next(iter(level.values()))

    moved = df.withColumn("position", F.col("position") + 5)
    for block in (3, 7, 100):
        assert benchmarks.semantic_digest(moved.repartition(5), block_rows=block).first()[:] == (50, tree(block))

    def mark(rows):
        return benchmarks.fingerprint(rows, position="position", question="question", answer="answer").first()

    swapped = df.withColumn("position", F.when(F.col("position") < 2, 1 - F.col("position")).otherwise(F.col("position")))
    assert mark(df) == mark(df.repartition(7)) != mark(swapped)


def test_mean_and_pass_are_not_conflated(spark):
    rows = [(p, s, int((p, s) == (0, 7))) for p in range(2) for s in range(8)]
    df = spark.createDataFrame(rows, "position int, sample_index int, correct int")
    out = metrics.summary(df, 8, validate=True).first()
    assert (out["mean_at_n"], out["pass_at_n"]) == (1 / 16, 1 / 2)
    assert (out["first_sample_accuracy"], out["pass_at_1"]) == (0, None)
    single = metrics.summary(df.where("sample_index = 0"), 1).first()
    assert single["pass_at_1"] == 0.0


@pytest.mark.parametrize("n", [1, 8, 62, 63, 130])
def test_completeness(spark, n):
    good = [(0, s) for s in range(n)]
    bad = [(1, s) for s in range(1, n)] + [(2, s) for s in range(n + 1)] + [(3, s) for s in range(n)] + [(3, 0)]
    swapped = [(4, s) for s in range(n - 1)] + [(4, n)] + [(5, s) for s in range(n - 1)] + [(5, -1)]
    nulls = [(6, s) for s in range(n - 1)] + [(6, None)]
    df = spark.createDataFrame(good + bad + swapped + nulls, "position int, sample_index int")
    expected = {1, 2, 3, 4, 5, 6} if n > 1 else {2, 3, 4, 5, 6}
    assert {r["position"] for r in metrics.incomplete_prompts(df, n).collect()} == expected
    graded = df.withColumn("correct", F.lit(1))
    for part in (graded, graded.where("position = 2"), graded.where("position = 6 or position = 0")):
        if n > 1 or part is not graded:
            with pytest.raises(Exception, match="sample indices|no rows"):
                metrics.summary(part.where("position > 0"), n).select("n_prompts").collect()
    assert metrics.summary(graded.where("position = 0"), n).first()["pass_at_n"] == 1.0
    assert metrics.summary(graded, n, validate=False).first()["n_prompts"] == (7 if n > 1 else 6)


def test_empty_table_has_no_summary(spark):
    empty = spark.createDataFrame([], "position int, sample_index int, correct int")
    with pytest.raises(Exception, match="no rows"):
        metrics.summary(empty, 4).collect()
    with pytest.raises(Exception, match="no rows"):
        metrics.summary(empty, 4).select("pass_at_n").collect()


def test_fingerprint_tells_nulls_and_separators_apart(spark):
    cases = [("a", None), (None, "a"), ("", "a"), ("a", ""), (None, None), ("a\x1fb", "c"), ("a", "b\x1fc"), ("1:a", "b")]
    marks = set()
    for pair in cases:
        df = spark.createDataFrame([(0, *pair)], "position int, question string, answer string")
        marks.add(tuple(benchmarks.fingerprint(df, position="position", question="question", answer="answer").first()))
    assert len(marks) == len(cases)


def test_wrong_candidate_counts(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1]), (2, None)], "position int, candidates array<int>")
    assert {r["position"] for r in metrics.wrong_candidate_counts(df, 2).collect()} == {1, 2}


def test_latest_version_is_numeric(spark):
    names = ["checkpoint-9", "checkpoint-10", "checkpoint-100x", "final", "checkpoint-"]
    df = spark.createDataFrame([("m", n) for n in names], "folder string, name string")
    assert metrics.latest_version(df).collect()[0].asDict() == {"folder": "m", "latest": "checkpoint-10", "versions": 2}
