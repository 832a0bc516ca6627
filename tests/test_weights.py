"""Weights against numpy versions written from the formulas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnow.functions.exact import exact_quantiles, exact_sum
from winnow.operators import entropy, tokens, weights


def entropies(n=2000, seed=3):
    rng = np.random.default_rng(seed)
    e = np.round(rng.gamma(2.0, 0.5, (n, 3)), 6)
    return pd.DataFrame({"idx": np.arange(n), **{f"entropy_{k}": e[:, k] for k in range(3)}})


def by_idx(df):
    return df.orderBy("idx").toPandas()


def test_ada(spark):
    data = entropies()
    out = by_idx(weights.ada_weights(spark.createDataFrame(data), 0.2, 0.7, 0.1))
    h0, d = data.entropy_0.to_numpy(), (data.entropy_1 - data.entropy_0).to_numpy()
    p = 0.2 * h0 / h0.sum() + 0.7 * np.where(d < 0, -d, 0) / -d[d < 0].sum()
    p = p + 0.1 * np.where(d > 0, d, 0) / d[d > 0].sum()
    np.testing.assert_allclose(out.sampling_weight, p / p.sum(), rtol=1e-12)
    np.testing.assert_allclose(out.delta_entropy, d, rtol=1e-15)


def test_ada_degenerate(spark):
    flat = spark.createDataFrame([(n, 0.0, 0.0) for n in range(4)], "idx int, entropy_0 double, entropy_1 double")
    assert by_idx(weights.ada_weights(flat)).sampling_weight.tolist() == [0.0] * 4
    rising = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 1.0)], "idx int, entropy_0 double, entropy_1 double")
    out = by_idx(weights.ada_weights(rising, 0.5, 0.3, 0.2)).sampling_weight
    np.testing.assert_allclose(out, [0.45 / 0.7, 0.25 / 0.7])


@pytest.mark.parametrize("params", [{}, {"alpha": 0.1, "beta": 0.8, "gamma": 0.1, "patience": 1, "easy_patience": 0,
                                         "lambda_time": 2.0, "lambda_easy": 0.5, "easy_quantile": 0.3, "hard_quantile": 0.6}])
def test_brown(spark, params):
    data = entropies()
    out = by_idx(weights.brown_weights(spark.createDataFrame(data), **params))
    q = {"alpha": 1.0, "beta": 1.0, "gamma": 1.0, "easy_quantile": 0.2, "hard_quantile": 0.8, "patience": 2,
         "easy_patience": 2, "lambda_time": 1.0, "lambda_easy": 1.0, **params}
    e = data[["entropy_0", "entropy_1", "entropy_2"]].to_numpy()
    easy, hard = np.quantile(e[:, 2], [q["easy_quantile"], q["hard_quantile"]])
    difficulty = np.clip((e[:, 2] - easy) / (hard - easy + 1e-8), 0, 1) + 1e-8
    gain = e[:, 0] - e[:, 2]
    trend = np.clip(1 + 0.5 * gain / (gain.std() + 1e-8), 0.1, 10)
    late = np.maximum((e > hard).sum(axis=1) - q["patience"], 0)
    idle = np.maximum((e < easy).sum(axis=1) - q["easy_patience"], 0)
    raw = difficulty ** q["alpha"] * trend ** q["beta"]
    raw = raw * np.exp(-q["lambda_time"] * late) ** q["gamma"] * np.exp(-q["lambda_easy"] * idle)
    raw = np.maximum(raw, 1e-8)
    np.testing.assert_allclose(out.sampling_weight, raw / raw.sum(), rtol=1e-9)
    assert abs(out.sampling_weight.sum() - 1) < 1e-9


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_incomplete_samples_fail(spark, bad):
    rows = [(0, 1.0, 2.0, 1.0), (1, 1.0, bad, 1.0)]
    df = spark.createDataFrame(rows, "idx int, entropy_0 double, entropy_1 double, entropy_2 double")
    for weigh in (weights.ada_weights, weights.brown_weights):
        with pytest.raises(Exception, match="without a value"):
            weigh(df).collect()


def test_exact_sum(spark):
    rng = np.random.default_rng(9)
    values = [*rng.normal(0, 1, 500), *rng.normal(0, 1e6, 500), 1e-9, -0.25, 0.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    found = {df.repartition(n).agg(exact_sum(F.col("v"))).first()[0] for n in (1, 3, 9)}
    assert len(found) == 1
    np.testing.assert_allclose(found.pop(), math.fsum(values), rtol=1e-14)
    with pytest.raises(Exception, match="cannot sum"):
        df.agg(exact_sum(F.col("v") * float("nan"))).collect()


def test_exact_sum_of_far_apart_values(spark):
    def total(values):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        return df.repartition(3).agg(exact_sum(F.col("v"))).first()[0]

    assert total([1e-17] * 10) == pytest.approx(1e-16, rel=1e-14)
    assert total([-1e-17] * 10 + [1.0, -1.0]) == pytest.approx(-1e-16, rel=1e-14)
    assert total([1e13, 1e-20, -1e13]) == pytest.approx(1e-20, rel=1e-14)
    assert total([2.5, -0.5, -3.0]) == -1.0
    with pytest.raises(Exception, match="cannot sum"):
        total([1.0, 1e30])


def test_tiny_weights_are_not_uniform(spark):
    df = spark.createDataFrame([(0, 1e-18), (1, 3e-18)], "idx int, raw double")
    out = by_idx(weights.normalised("raw", "w", df))
    np.testing.assert_allclose(out.w, [0.25, 0.75], rtol=1e-12)


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="unknown"):
        weights.sampling_weights(spark.createDataFrame(entropies(5)), "other")


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [0.0] * 700 + [1.0] * 300,
        list(np.random.default_rng(0).normal(size=5000)),
        list(np.random.default_rng(1).pareto(0.3, 5000)),
        [1e-300, 1.0, 1e300, -1e300, 1e308, -1e308],
        [1.0 + k * 2**-52 for k in range(50)],
        [3.0] * 4000 + list(np.random.default_rng(2).normal(3, 1e-9, 2000)),
        # Enough rows for brackets that leave most of them out; ties at a bracket's edge.
        list(np.random.default_rng(3).normal(size=60_000)),
        [0.0, -0.0] * 9000 + list(np.round(np.random.default_rng(4).pareto(1, 30_000), 2)),
    ],
)
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    qs = [0.0, 0.2, 0.5, 0.8, 0.999, 1.0]
    found = exact_quantiles(df, "v", qs)
    ordered = np.sort(np.array(values))
    for q, got in zip(qs, found):
        place = q * (len(ordered) - 1)
        low, high = ordered[int(place)], ordered[min(int(place) + 1, len(ordered) - 1)]
        assert got == low + (high - low) * (place - int(place)) or low == high == got


def test_batch_weights_with_hot_batch(spark):
    rows = [(n, n % 3 if n % 2 else 9, float(n % 7) / 3) for n in range(3000)] + [(5000, None, 2.0), (5001, None, 1.0)]
    df = spark.createDataFrame(rows, "idx int, batch int, ce double")
    from winnow.operators.groups import with_group_stats

    out = with_group_stats(df, ["batch"], {"m": F.avg("ce"), "n": F.count("*")})
    got = by_idx(out)
    data = pd.DataFrame(rows, columns=["idx", "batch", "ce"]).sort_values("idx")
    expected = data.groupby("batch", dropna=False).ce.transform("mean")
    np.testing.assert_allclose(got.m, expected, rtol=1e-12)
    assert len(got) == len(rows)

    scaled = by_idx(weights.batch_loss_weights(df, batch=["batch"]))
    np.testing.assert_allclose(scaled.weight, np.clip(np.exp(2 * data.ce / np.maximum(expected, 1e-8)), 0.2, 5))
    plain = by_idx(weights.batch_loss_weights(df, batch=["batch"], scale_by_mean=False))
    np.testing.assert_allclose(plain.weight, np.clip(np.exp(2 * data.ce), 0.2, 5))


# --- entropy tables ----------------------------------------------------------------------------------


def test_merge(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "idx long, entropy_0 double")
    b = spark.createDataFrame([(2, 1.2), (3, 1.3)], "idx long, entropy_1 double")
    c = spark.createDataFrame([(2, 9.0)], "idx long, entropy_0 double")
    rows = {r["idx"]: (r["entropy_0"], r["entropy_1"]) for r in entropy.merge_entropies([a, b, c]).collect()}
    assert rows == {1: (0.1, None), 2: (9.0, 1.2), 3: (None, 1.3)}


def test_dedupe_and_pair(spark):
    df = spark.createDataFrame([(1, 0, 5, 0.1), (1, 1, 2, 0.2), (1, 1, 3, None), (2, 0, 0, 0.4)],
                               "idx int, file_no int, line_no int, e double")
    rows = sorted(map(tuple, entropy.dedupe_last(df, "idx", "file_no", "line_no").collect()))
    assert rows == [(1, 1, 3, None), (2, 0, 0, 0.4)]

    wide = spark.createDataFrame([(0, 0.0, 1.0, 2.0, 3.0)], "idx int, entropy_0 double, entropy_1 double, entropy_2 double, entropy_3 double")
    cases = [(wide, (0.0, 1.0)), (wide.drop("entropy_0"), (1.0, 2.0)), (wide.drop("entropy_0", "entropy_1"), (2.0, 3.0))]
    for df, expected in cases:
        row = entropy.entropy_pair(df).first()
        assert (row["entropy_0"], row["entropy_1"]) == expected
    with pytest.raises(ValueError):
        entropy.entropy_pair(wide.select("idx", "entropy_0", "entropy_2"))


# --- tokens ------------------------------------------------------------------------------------------


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def token_rows():
    rng = np.random.default_rng(5)
    return [(i, p, int(rng.integers(0, 40)), [float(np.float32(v)) for v in rng.normal(0, 5, 40)])
            for i in range(30) for p in range(10)]


SCHEMA = "idx long, pos int, label int, logits array<float>"


def test_sample_entropy(spark):
    rows = token_rows()
    prompt_len = F.when(F.col("idx") == 7, 10).otherwise(3)
    out = by_idx(tokens.sample_entropy(spark.createDataFrame(rows, SCHEMA), prompt_len=prompt_len, max_tokens=8))
    for i in range(30):
        h = [-(softmax(np.array(x)) * np.log(softmax(np.array(x)) + 1e-12)).sum()
             for j, p, _, x in rows if j == i and 3 <= p < 8]
        np.testing.assert_allclose(out.entropy[i], 0.0 if i == 7 else np.mean(h), rtol=1e-10)


def test_cross_entropy_and_loss(spark):
    rows = [(i, p, -100 if p < 4 or i == 2 else y, x) for i, p, y, x in token_rows()]
    ce = tokens.sample_cross_entropy(spark.createDataFrame(rows, SCHEMA))
    out = by_idx(ce)
    expected = []
    for i in range(30):
        losses = [-np.log(softmax(np.array(x))[y]) for j, _, y, x in rows if j == i and y >= 0]
        expected.append(np.mean(losses) if losses else 0.0)
    np.testing.assert_allclose(out.ce, expected, rtol=1e-10)

    weighted = ce.withColumn("weight", F.when(F.col("idx") == 0, 0.0).otherwise(F.col("idx").cast("double")))
    w = np.maximum(np.arange(30.0), 1e-8)
    loss = tokens.weighted_loss(weighted).first()["loss"]
    np.testing.assert_allclose(loss, (w * expected).sum() / w.sum(), rtol=1e-9)
    each = by_idx(tokens.with_weighted_loss(weighted)).loss
    np.testing.assert_allclose(each, np.arange(30.0) * expected, rtol=1e-10)


def test_mix_and_next_token_loss(spark):
    rows = token_rows()
    a = spark.createDataFrame([(i, p, -100 if p < 4 else y, x) for i, p, y, x in rows], SCHEMA)
    b = spark.createDataFrame([(i, p, x[::-1]) for i, p, _, x in rows], "idx long, pos int, logits array<float>")
    mixed = tokens.mix_logits([a, b], lam=0.25)
    lookup = {(r["idx"], r["pos"]): np.array(r["logits"]) for r in mixed.collect()}
    losses = []
    for i, p, y, x in rows:
        np.testing.assert_allclose(lookup[i, p], 0.75 * np.array(x) + 0.25 * np.array(x[::-1]), rtol=1e-12)
        if p >= 4:
            losses.append(-np.log(softmax(lookup[i, p - 1])[y]))
    out = tokens.next_token_loss(mixed).first()
    assert out["tokens"] == len(losses)
    np.testing.assert_allclose(out["loss"], np.mean(losses), rtol=1e-10)

    three = tokens.mix_logits([a, b, b], lam=0.9).where("idx = 0 and pos = 0").first()
    x = np.array(rows[0][3])
    np.testing.assert_allclose(three["logits"], (x + 2 * x[::-1]) / 3, rtol=1e-12)


def test_null_and_odd_logits(spark):
    from winnow.functions import logits as L

    rows = [(0, None, 0), (1, [], 0), (2, [1.0], 0), (3, [1.0, 2.0, 3.0], 2), (4, [1.0, 2.0], -100), (5, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "n int, x array<float>, y int").coalesce(1)
    out = df.select("n", L.token_entropy(F.col("x")).alias("h"), L.token_cross_entropy(F.col("x"), F.col("y")).alias("ce"),
                    L.margin(F.col("x"), F.col("y")).alias("m")).orderBy("n").collect()
    assert [r["h"] is None for r in out] == [True, True, False, False, False, False]
    assert [r["ce"] is None for r in out] == [True, True, False, False, True, True]
    assert out[3]["m"] == 1.5
    np.testing.assert_allclose(out[5]["h"], np.log(2), rtol=1e-10)
    pair = df.select("n", L.mix([F.col("x"), F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>")]).alias("v")).orderBy("n")
    assert [r["v"] for r in pair.collect()] == [None, None, None, None, [1.0, 1.5], [0.5, 0.5]]


def test_not_a_number_logits_stay_visible(spark):
    nan = float("nan")
    rows = [(0, 0, 1, [1.0, nan]), (1, 0, 1, [nan, nan]), (1, 1, 0, [1.0, 2.0]), (2, 0, -100, [nan, nan]), (2, 1, 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = by_idx(tokens.sample_entropy(df, prompt_len=F.lit(0))).entropy
    assert np.isnan(found).all()
    ce = by_idx(tokens.sample_cross_entropy(df)).ce
    assert np.isnan(ce[0]) and np.isnan(ce[1])
    np.testing.assert_allclose(ce[2], np.log(2))


@pytest.mark.parametrize("label", [2, -1, -7])
def test_label_outside_the_vocabulary_fails(spark, label):
    df = spark.createDataFrame([(0, 0, 0, [1.0, 2.0]), (0, 1, label, [1.0, 2.0])], SCHEMA)
    for run in (tokens.sample_cross_entropy, tokens.with_margin):
        with pytest.raises(Exception, match="outside a vocabulary"):
            run(df).collect()


def test_no_cut_by_default(spark):
    rows = [(0, p, 0, [0.0, 0.0]) for p in (8191, 8192, 20000)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select(tokens.masked_label(F.col("pos"), F.col("label"), F.lit(1)).alias("l")).collect()
    assert [r["l"] for r in labels] == [0, 0, 0]


def test_bucketed_logits_are_mixed_without_an_exchange(spark):
    """Three tables of one bucketing: nothing moves below the joins, and the result is that of plain tables."""
    rng = np.random.default_rng(3)
    tables = []
    for _ in range(3):
        rows = [(i, p, [float(x) for x in rng.standard_normal(6)]) for i in range(40) for p in range(5)]
        tables.append(spark.createDataFrame(rows, "idx bigint, pos int, logits array<double>"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = tokens.mix_logits([tokens.bucketed(t, 4) for t in tables])
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        plain = tokens.mix_logits(tables)
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        got, want = ({(r.idx, r.pos): r.logits for r in d.collect()} for d in (mixed, plain))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got.keys() == want.keys() and len(got) == 200
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)])
