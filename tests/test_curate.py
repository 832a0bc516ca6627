import json

from pyspark.sql import functions as F

from winnow import schemas
from winnow.functions.messages import first_content
from winnow.operators import curate, pairs
from winnow.operators.ordering import with_scan_order

GOOD = "<think>t</think> <answer>\\boxed{4}</answer>"


def record(user, assistant, reference="4", source="web", **more):
    info = {"source": source}
    if reference is not None:
        info["reference_answer"] = reference
    messages = [{"role": "user", "content": user, "info": info}]
    if assistant is not None:
        messages.append({"role": "assistant", "content": assistant, "info": {}})
    return {"messages": messages, **more}


def frame(spark, records):
    lines = spark.createDataFrame(list(enumerate(map(json.dumps, records))), "n int, line string")
    return lines.select("n", F.from_json("line", schemas.CHAT).alias("r")).select("n", "r.*")


CASES = [
    (record("q", GOOD), None),
    (record("q", "  " + GOOD + "\n"), None),
    (record("q", None), "structural"),
    (record("  ", GOOD), "structural"),
    (record("q", "\u3000"), "structural"),
    ({"messages": []}, "structural"),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "structural"),
    (record("q", "KodCode"), "denied"),
    (record("q", "<answer>\\boxed{4}</answer>"), "format"),
    (record("q", GOOD, None), "no_reference"),
    (record("q", GOOD, ""), "no_reference"),
    (record("q", GOOD, "5"), "incorrect"),
    (record("q", GOOD, "x+1"), "undecided"),
]


def test_reasons_and_report(spark):
    rows = curate.with_drop_reason(frame(spark, [c for c, _ in CASES]))
    found = [r["reason"] for r in rows.orderBy("n").select("reason").collect()]
    assert found == [e for _, e in CASES]
    report = {r["reason"]: r["n"] for r in curate.drop_report(rows).collect()}
    assert report == {"kept": 2, "structural": 5, "denied": 1, "format": 1, "no_reference": 2, "incorrect": 1, "undecided": 1}


def test_denied_source_and_grader(spark):
    records = [record("q", GOOD, "x+1"), record("q", GOOD, "4", source="codeio")]
    df = frame(spark, records)
    source = F.col("messages")[0]["info"]["source"]
    rows = curate.with_drop_reason(df, denied_by=source, grader=lambda r, a: a == "x+1")
    assert [r["reason"] for r in rows.orderBy("n").collect()] == [None, "denied"]


def test_index_in_file_order(spark, tmp_path):
    """Names sort before lines, drops leave no gap, and no row is shuffled."""
    count = 0
    for name in ("b", "a", "c"):
        with open(tmp_path / f"{name}.jsonl", "w") as out:
            for line in range(200):
                keep = (line * 7 + count) % 3 != 0
                out.write(json.dumps(record(f"{name}{line:04d}", GOOD if keep else "x")) + "\n")
            count += 1
    scan = spark.read.schema(schemas.CHAT).json(str(tmp_path)).drop("idx")
    kept = curate.kept(curate.with_drop_reason(with_scan_order(scan)))
    rows = curate.indexed(kept).select("idx", first_content(F.col("messages"), "user").alias("q"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    found = rows.orderBy("idx").collect()
    assert [r["idx"] for r in found] == list(range(len(found)))
    assert [r["q"] for r in found] == sorted(r["q"] for r in found)
    assert curate.head(rows, 10).count() == 10


def test_index_after_shuffle_falls_back(spark, tmp_path):
    for name in ("b", "a"):
        with open(tmp_path / f"{name}.jsonl", "w") as out:
            out.writelines(json.dumps(record(f"{name}{n:04d}", GOOD)) + "\n" for n in range(300))
    scan = with_scan_order(spark.read.schema(schemas.CHAT).json(str(tmp_path)).drop("idx"))
    for moved in (scan.repartition(5), scan.orderBy(F.desc("_file"), F.desc("_row"))):
        rows = curate.indexed(moved).select("idx", first_content(F.col("messages"), "user").alias("q"))
        found = rows.orderBy("idx").collect()
        assert [r["idx"] for r in found] == list(range(600))
        assert [r["q"] for r in found] == sorted(r["q"] for r in found)


def test_index_of_rows_moved_within_their_split(spark, tmp_path):
    """Both ends of the split stay in place, what lies between is turned round."""
    with open(tmp_path / "a.jsonl", "w") as out:
        out.writelines(json.dumps(record(f"a{n:04d}", GOOD)) + "\n" for n in range(20))
    scan = with_scan_order(spark.read.schema(schemas.CHAT).json(str(tmp_path)).drop("idx"))
    user = first_content(F.col("messages"), "user")
    place = F.when(user == "a0000", -1).when(user == "a0019", 100).otherwise(20 - F.substring(user, 2, 4).cast("int"))
    rows = curate.indexed(scan.sortWithinPartitions(place)).select("idx", user.alias("q"))
    assert [(r["idx"], r["q"]) for r in rows.orderBy("idx").collect()] == [(n, f"a{n:04d}") for n in range(20)]


def test_pairs(spark):
    user_answer = {"source": "codeio", "answer_content": " u "}
    records = [
        record("q1", GOOD),
        {"prompt": " p ", "completion": "c\n"},
        {"prompt": "p", "completion": "  "},
        {"messages": [{"role": "user", "content": "q", "info": user_answer}, {"role": "assistant", "content": "a"}]},
        {"messages": [{"role": "user", "content": "q", "info": {"source": "prime", "answer_content": ""}},
                      {"role": "assistant", "content": "a", "info": {"answer_content": "as"}}]},
        record("q", "a", source="OpenCoder", extracted_code="code"),
        record("q", "a", source="OpenCoder"),
        record("q", None),
    ]
    df = frame(spark, records)
    math = pairs.math_pairs(df, eos="|", template=None, keep=("n",)).orderBy("n").collect()
    assert [tuple(r) for r in math] == [
        (0, "q1", GOOD + "|"), (1, "p", "c|"), (3, "q", "u|"), (4, "q", "as|"), (5, "q", "code|"),
    ]
    code = pairs.code_pairs(df, eos="|", keep=("n",)).orderBy("n").collect()
    assert [(r["n"], r["completion"]) for r in code] == [
        (0, GOOD + "|"), (1, "c|"), (3, "a|"), (4, "a|"), (5, "a|"), (6, "a|"),
    ]
    assert pairs.uses_template("/data/am.jsonl") and not pairs.uses_template("/data/GSM8K/x.jsonl")
