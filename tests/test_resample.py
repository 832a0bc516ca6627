"""The weighted draw against a brute-force inverse CDF, also under skew."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import resample
from winnow.operators.ordering import dense_index
from winnow.session import materialize


def brute_draws(weights: dict[int, float], n_new: int, seed: int) -> list[int]:
    keys = sorted(weights)
    w = np.array([weights[k] for k in keys])
    total = math.fsum(w)
    q = np.ones(len(w), dtype=np.int64)
    if total > 0:
        q = np.where(w > 0, np.maximum(np.round(w / total * 2.0**60), 1), 0).astype(np.int64)
    edges = np.cumsum(q)
    out = []
    for k in range(n_new):
        u = int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16)
        at = u * int(edges[-1]) >> 60
        out.append(keys[int(np.searchsorted(edges, at, side="right"))])
    return out


def table(spark, weights):
    return spark.createDataFrame(list(weights.items()), "idx long, sampling_weight double").repartition(6)


RNG = np.random.default_rng(11)
CASES = {
    "even": {k: 1.0 for k in range(500)},
    "random": {int(k): float(v) for k, v in enumerate(RNG.gamma(0.3, 1, 700))},
    "one heavy": {k: (500.0 if k == 250 else 1.0) for k in range(501)},
    "many tiny": {**{k: 1e-11 for k in range(600)}, **{k: 1.0 for k in range(600, 640)}},
    "zeros": {k: float(k % 3 == 0) for k in range(400)},
    "far apart": {0: 1e13, 1: 1.0, 2: 1e-20, 3: 0.0, **{k: 3.0 for k in range(4, 300)}},
    "all tiny": {k: 1e-20 * (1 + k % 7) for k in range(300)},
    "all zero": {k: 0.0 for k in range(300)},
    "sparse keys": {int(k): 1.0 for k in RNG.choice(10**15, 300, replace=False)},
}


@pytest.mark.parametrize("group", [3, 1024])
@pytest.mark.parametrize("name", CASES)
def test_draws_equal_brute_force(spark, name, group):
    out = resample.weighted_draws(
        table(spark, CASES[name]), multiplier=1.5, seed=7, draws_per_group=group
    )
    rows = out.orderBy("draw").collect()
    n_new = int(len(CASES[name]) * 1.5)
    assert [r["draw"] for r in rows] == list(range(n_new))
    assert [r["idx"] for r in rows] == brute_draws(CASES[name], n_new, 7)


@pytest.mark.parametrize("shuffles", [1, 4, 8, 31])
def test_draws_do_not_depend_on_partitions(spark, partitions, shuffles):
    partitions(shuffles)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = resample.weighted_draws(table(spark, CASES["random"]), seed=42)
        assert [r["idx"] for r in out.orderBy("draw").collect()] == brute_draws(CASES["random"], 700, 42)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_gather(spark):
    weights = CASES["one heavy"]
    draws = resample.weighted_draws(table(spark, weights), multiplier=4.0)
    data = spark.createDataFrame([(k, f"text {k}") for k in weights], "idx long, text string")
    rows = resample.gather(data, draws)
    assert sorted((r["draw"], r["idx"]) for r in rows.collect()) == sorted(enumerate(brute_draws(weights, 2004, 42)))
    assert rows.where("text <> 'text ' || idx").count() == 0


def test_gather_splits_hot_rows(spark):
    """Half of the draws are of one row: adaptive execution deals them to several tasks."""
    split = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    drawn = F.when(F.col("id") % 2 == 0, F.lit(250)).otherwise(F.xxhash64("id") % 250 + 250)
    draws = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("draw"), drawn.cast("long").alias("idx"))
    data = spark.range(0, 501, 1, 4).selectExpr("id AS idx", "'text ' || id AS text")
    old = {key: spark.conf.get(key, None) for key in split}
    for key, value in split.items():
        spark.conf.set(key, value)
    try:
        rows = resample.gather(data, draws)
        found = rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert sorted((r["draw"], r["idx"]) for r in found) == sorted((r["draw"], r["idx"]) for r in draws.collect() if r["idx"] >= 0)
    assert all(r["text"] == f"text {r['idx']}" for r in found)
    assert "skew=true" in plan


def test_keys_repeated_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        twice = spark.createDataFrame([(1, 0.5), (7, 1.0), (7, 1.0), (9, 2.0)], "idx long, sampling_weight double")
        with pytest.raises(Exception, match="repeated idx: 7"):
            resample.weighted_draws(twice).collect()
        draws = resample.weighted_draws(table(spark, CASES["one heavy"]), multiplier=2.0)
        assert [r["idx"] for r in draws.orderBy("draw").collect()] == brute_draws(CASES["one heavy"], 1002, 42)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_resample_runs_few_jobs(spark):
    from winnow.plans.curriculum import _dataset, _weighted

    def jobs():
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))

    weighted = materialize(_weighted(spark, "/root/testdata/sf0.001"), "weighted")
    before = jobs()
    draws = resample.weighted_draws(weighted)
    resample.gather(_dataset(spark, "/root/testdata/sf0.001"), draws).collect()
    assert jobs() - before <= 15


def test_stats(spark):
    draws = spark.createDataFrame([(0, 5), (1, 5), (2, 5), (3, 7), (4, 8), (5, 8)], "draw long, idx long")
    size = spark.createDataFrame([(9,)], "original_rows long")
    row = resample.resample_stats(draws, size).withColumn(
        "steps", resample.optimiser_steps(F.col("new_rows"), epochs=7, processes=2, batch=1, accumulation=4)
    ).first()
    assert row.asDict() == {"original_rows": 9, "new_rows": 6, "unique_rows": 3, "repeated_rows": 2,
                            "duplicate_draws": 3, "steps": 5}


def test_join_weights(spark):
    data = spark.createDataFrame([(1,), (2,), (3,)], "idx long")
    w = spark.createDataFrame([(1, 0.5, 0), (1, 0.7, 1), (2, 0.1, 0)], "idx long, sampling_weight double, line int")
    rows = resample.join_weights(data, w, order=["line"]).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [(1, 0.7, False), (2, 0.1, False), (3, 0.0, True)]
    with pytest.raises(Exception, match="without idx"):
        resample.join_weights(spark.createDataFrame([(None,)], "idx long"), w, order=["line"]).collect()


def test_second_weight_of_a_key_fails(spark):
    data = spark.createDataFrame([(1,), (2,)], "idx long")
    twice = spark.createDataFrame([(1, 0.5), (1, 0.7), (None, 1.0), (None, 2.0)], "idx long, sampling_weight double")
    with pytest.raises(Exception, match="repeated idx: 1"):
        resample.join_weights(data, twice).collect()


def test_positive_weights_keep_a_part(spark):
    rows = [(0, 1e13), (1, 1.0), (2, 1e-20), (3, 0.0), (4, 1e-60)]
    df = spark.createDataFrame(rows, "idx int, sampling_weight double")
    q = {r["idx"]: r["q"] for r in resample.quantised(df).collect()}
    total = math.fsum(w for _, w in rows)
    assert q == {0: round(1e13 / total * 2**60), 1: round(1 / total * 2**60), 2: 1, 3: 0, 4: 1}
    small = df.where("idx in (2, 4)")
    assert {r["idx"]: r["q"] for r in resample.quantised(small).collect()} == {2: 2**60, 4: 1}


def test_bad_inputs(spark):
    twice = spark.createDataFrame([(1, 0.5), (1, 0.5)], "idx long, sampling_weight double")
    with pytest.raises(Exception, match="repeated idx"):
        resample.weighted_draws(twice).count()
    negative = spark.createDataFrame([(1, 0.5), (2, -0.1)], "idx long, sampling_weight double")
    with pytest.raises(Exception, match="negative weight"):
        resample.weighted_draws(negative)
    with pytest.raises(ValueError, match="leaves no draws"):
        resample.weighted_draws(table(spark, CASES["even"]), multiplier=0.001)


def test_dense_index_by_key(spark):
    keys = [int(k) for k in RNG.choice(10**12, 2000, replace=False)]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "key long, text string").repartition(9)
    rows = dense_index(df, "key", start=5).orderBy("key").collect()
    assert [r["idx"] for r in rows] == list(range(5, 2005))
    assert all(r["text"] == str(r["key"]) for r in rows)


def test_shuffle_and_shards(spark):
    df = spark.range(103).withColumnRenamed("id", "idx")
    first = resample.seeded_shuffle(df.repartition(3), seed=1).orderBy("shuffled").collect()
    again = resample.seeded_shuffle(df.repartition(7), seed=1).orderBy("shuffled").collect()
    other = resample.seeded_shuffle(df, seed=2).orderBy("shuffled").collect()
    assert [r["idx"] for r in first] == [r["idx"] for r in again] != [r["idx"] for r in other]
    assert sorted(r["idx"] for r in first) == list(range(103))
    runs = resample.with_shard(df, 10).orderBy("idx").collect()
    expected = [s for s in range(10) for _ in range(11 if s < 3 else 10)]
    assert [r["shard"] for r in runs] == expected
    few = resample.with_shard(df.where("idx < 3"), 8).orderBy("idx").collect()
    assert [r["shard"] for r in few] == [0, 1, 2]
    striped = resample.with_shard(df, 10, contiguous=False).orderBy("idx").collect()
    assert [r["shard"] for r in striped] == [n % 10 for n in range(103)]


def test_written_shards(spark, tmp_path):
    df = resample.with_shard(spark.range(20).withColumnRenamed("id", "idx"), 4)
    resample.write_shards(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "shard=3")).count() == 5


def test_sparse_position_has_no_shard(spark):
    from pyspark.errors import PySparkException

    from winnow.operators.resample import with_shard

    sparse = spark.createDataFrame([(0,), (1000,), (2000,)], "idx bigint")
    with pytest.raises(PySparkException, match="dense position"):
        with_shard(sparse, 2).collect()


def test_infinite_values_have_no_quantiles(spark):
    from winnow.functions.exact import exact_quantiles

    values = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    with pytest.raises(ValueError, match="infinite"):
        exact_quantiles(values, "v", [0.5])
