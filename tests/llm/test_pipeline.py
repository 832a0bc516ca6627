"""Queries that SQL can express against DuckDB; the pipeline stage by stage on a small table."""

import corpus_pipeline
import pyarrow as pa
import pytest
from compare import connect, differences
from conftest import SMALL

from winnow.llm import toxicity
from winnow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL) is None


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from winnow.session import materialize

        docs = materialize(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns
        rows.append(docs.count())
    assert rows == sorted(rows, reverse=True) and 0 < rows[-1] < rows[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert 0 < last.count() and set(columns) <= set(last.columns)
    assert last.where("copy > 3").count() == 0


CLASHES = "doc_id bigint, text string, lang string, source string, terms string, _row int, size int, copy string"


def test_no_text_is_lost_where_ids_repeat_and_no_column_name_breaks_a_stage(spark):
    from winnow.llm import stages

    one, two, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [(5, one), (7, one), (5, two), (3, two), (5, other), (9, other + " tail"), (None, one), (4, None), (6, ""), (5, one)]
    docs = spark.createDataFrame([(*r, "en", "s", "t", 1, 2, "c") for r in rows], CLASHES)
    kept = [(r.doc_id, r.text) for r in stages.drop_near_copies(spark, docs, SMALL).collect()]
    assert sorted(kept, key=repr) == sorted([(5, one), (5, one), (3, two), (5, other), (None, one), (4, None), (6, "")], key=repr)
    mail = docs.union(spark.createDataFrame([(8, "write to a@b.org now", "en", "s", "t", 1, 2, "c")], CLASHES))
    clean = stages.sanitise(spark, mail, SMALL)
    assert clean.columns == docs.columns
    assert {r.text for r in clean.where("doc_id = 8").collect()} == {"write to [EMAIL] now"}
    mixed = stages.mix_sources(spark, docs, SMALL)
    assert {r.doc_id for r in mixed.collect()} <= {r[0] for r in rows} and mixed.where("copy > 3").count() == 0


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_texts_meet_copies_and_copy_counts_without_a_broadcast(spark, tmp_path):
    """What grows with the corpus takes one way at every size: no small table is collected in the driver."""
    from winnow.llm import stages

    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, "nine ten", "t")], "doc_id bigint, text string, source string")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    kept, mixed = stages.drop_near_copies(spark, docs, ""), stages.mix_sources(spark, docs, "")
    for rows in (kept, mixed):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert {r["doc_id"] for r in mixed.collect()} <= {1, 2, 3}


def test_toxicity_hands_no_rows_from_the_driver_to_python_workers(spark, monkeypatch):
    """Rows given as a list are read by workers of an environment of their own, which each executor keeps."""
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} words {i}") for i in range(40)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (docs["doc_id"] % 2).cast("int").alias("toxic"))

    def fail(*args, **more):
        raise AssertionError("a table was made of the driver's rows")

    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    model = toxicity.fit(docs, labels)
    low, high = toxicity.score_texts(model, ["good words 51", "bad words 51"])
    assert low < 0.5 < high


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "pii"])
def test_a_stage_hands_texts_to_python_in_batches_of_bounded_bytes(spark, tmp_path, name):
    spark.range(0, 6000, 1, 1).selectExpr("id doc_id", "repeat('word ', 800) text", "'s' source").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SMALL)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

        found = docs.repartition(1).mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r["rows"] for r in found) == 6000
    assert max(r["bytes"] for r in found) < 5 << 20
