"""The splittable reader of JSON documents against json and the whole-file reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from winnow.sources.documents import scan_split_document
from winnow.sources.jsonl import scan_json_document

SCHEMA = "a bigint, s string, t struct<u:array<bigint>,v:map<string,string>>"
NASTY = ['}', '{"data":[', '\\', '\\"', '"', 'é}{', ',', ']', 'a\\\\"}', '', '[[', '\n}']


def rows_of(n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 12)))
    return [{"a": i, "s": text(), "t": {"u": list(range(i % 4)), "v": {"k" + text(): text()}}} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1"}
    old = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def found(df):
    rows = df.orderBy("_file", "_block", "_row").collect()
    return [json.loads(r[0]) for r in [(json.dumps(r.asDict(True), sort_keys=True),) for r in rows]]


def documents(rows, **style):
    return {
        "array": json.dumps(rows, **style),
        "wrapped": json.dumps({"m": {"data": [1, {"a": 5}]}, "data": rows, "n": [{"a": 7}]}, **style) + "\n",
        "one": json.dumps(rows[0] if rows else {}, **style),
        "blank": " [ ]\n ",
    }


@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_equals_json_and_the_whole_file_reader(spark, tmp_path, small_splits, style):
    rows = rows_of(60, 3)
    schema = spark.createDataFrame([], SCHEMA).schema
    for name, text in documents(rows, **style).items():
        path = tmp_path / f"{name}.json"
        path.write_text(text, encoding="utf-8")
        scan = scan_split_document(spark, str(path), schema, with_order=True)
        wanted = {"one": rows[:1], "blank": []}.get(name, rows)
        got = found(scan)
        assert [{k: r[k] for k in ("a", "s", "t")} for r in got] == wanted, name
        if name in ("array", "wrapped"):
            assert len({r["_block"] for r in got}) > 20
        plain = scan_json_document(spark, str(path), schema).select(F.to_json(F.struct("*")).alias("j"))
        assert sorted(r.j for r in plain.collect()) == sorted(
            r.j for r in scan.select(F.to_json(F.struct("a", "s", "t")).alias("j")).collect()
        )


def test_a_row_wider_than_many_splits(spark, tmp_path, small_splits):
    rows = [{"a": 1, "s": "x"}, {"a": 2, "s": "}" * 3000}, {"a": 3, "s": "y"}]
    (tmp_path / "wide.json").write_text(json.dumps(rows))
    schema = spark.createDataFrame([], "a bigint, s string").schema
    got = found(scan_split_document(spark, str(tmp_path), schema, with_order=True))
    assert [(r["a"], r["s"]) for r in got] == [(r["a"], r["s"]) for r in rows]


@pytest.mark.parametrize("text", ['[{"a":1},{"a":2', '[{"a":1}', '[{"a":1},5]', '[{"a":1},,{"a":2}]', '[{"a":1}]]', '"x"', '[{"a":"no"}]'])
def test_malformed_documents_fail(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    schema = spark.createDataFrame([], "a bigint").schema
    with pytest.raises(Exception):
        scan_split_document(spark, str(tmp_path / "bad.json"), schema).collect()
