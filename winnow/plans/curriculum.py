"""Curriculum queries: entropies, weights, the weighted draw, token operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow import schemas
from winnow.operators import entropy, resample, tokens, weights
from winnow.operators.ordering import SCAN_ORDER, dense_index, with_scan_order
from winnow.plans import fixtures as S
from winnow.plans.registry import query, with_ctes
from winnow.session import shared_path
from winnow.sources import jsonl, sinks

ENTROPIES = with_ctes(S.ENTROPIES_SQL)

# --- entropy tables --------------------------------------------------------------------------------


@query(
    ENTROPIES
    + """SELECT idx, CASE WHEN idx % 5 = 0 THEN entropy_2 ELSE entropy_0 END AS entropy_0,
                CASE WHEN idx % 3 <> 0 THEN entropy_1 END AS entropy_1 FROM entropies"""
)
def entropy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables: all of round 0, part of round 1, and a later correction of round 0."""
    later = S.entropy_table(spark, sf_dir, 2).where("idx % 5 = 0")
    return entropy.merge_entropies(
        [
            S.entropy_table(spark, sf_dir, 0),
            S.entropy_table(spark, sf_dir, 1).where("idx % 3 <> 0"),
            later.withColumnRenamed("entropy_2", "entropy_0"),
        ]
    ).select("idx", "entropy_0", "entropy_1")


@query(
    """
    SELECT user_id AS idx, event_id % 4 AS file_no, event_id AS line_no, value AS entropy
    FROM events QUALIFY row_number() OVER (
        PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) = 1
    """
)
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("idx"),
        (F.col("event_id") % 4).alias("file_no"),
        F.col("event_id").alias("line_no"),
        F.col("value").alias("entropy"),
    )
    return entropy.dedupe_last(rows, "idx", "file_no", "line_no")


@query(ENTROPIES + "SELECT idx, entropy_1 AS entropy_0, entropy_2 AS entropy_1 FROM entropies")
def entropy_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.entropies(spark, sf_dir).drop("entropy_0")
    return entropy.entropy_pair(rows).select("idx", "entropy_0", "entropy_1")


# --- weights -----------------------------------------------------------------------------------------

_ADA_SQL = """
totals AS (
  SELECT fsum(entropy_0) AS z1,
         fsum(CASE WHEN d < 0 THEN -d ELSE 0 END) AS z2,
         fsum(CASE WHEN d > 0 THEN d ELSE 0 END) AS z3
  FROM (SELECT entropy_0, entropy_1 - entropy_0 AS d FROM entropies)
), raw_ada AS (
  SELECT idx, d, greatest(0.1::DOUBLE * (entropy_0 / z1)
         + CASE WHEN d < 0 THEN 0.8::DOUBLE * (-d / z2) ELSE 0 END
         + CASE WHEN d > 0 THEN 0.1::DOUBLE * (d / z3) ELSE 0 END, 0) AS raw
  FROM (SELECT *, entropy_1 - entropy_0 AS d FROM entropies), totals
), ada AS (
  SELECT idx, d, raw / (SELECT fsum(raw) FROM raw_ada) AS w
  FROM raw_ada
)
"""
ADA = with_ctes(S.ENTROPIES_SQL, _ADA_SQL)


@query(ADA + "SELECT idx, round(d, 9) AS delta_entropy, CAST(round(w * 1e12) AS BIGINT) AS w FROM ada")
def weights_ada(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weights.ada_weights(S.entropies(spark, sf_dir))
    return rows.select(
        "idx",
        F.round("delta_entropy", 9).alias("delta_entropy"),
        F.round(F.col("sampling_weight") * 1e12).cast("bigint").alias("w"),
    )


@query(
    ENTROPIES
    + """, th AS (
      SELECT quantile_cont(entropy_2, 0.2) AS easy, quantile_cont(entropy_2, 0.8) AS hard,
             stddev_pop(entropy_0 - entropy_2) AS sd FROM entropies
    ), scored AS (
      SELECT idx, greatest(
          (least(greatest((entropy_2 - easy) / (hard - easy + 1e-8::DOUBLE), 0), 1) + 1e-8::DOUBLE)
          * least(greatest(1 + 0.5::DOUBLE * ((entropy_0 - entropy_2) / (sd + 1e-8::DOUBLE)), 0.1::DOUBLE), 10)
          * exp(-greatest(0, (entropy_0 > hard)::INT + (entropy_1 > hard)::INT + (entropy_2 > hard)::INT - 2))
          * exp(-greatest(0, (entropy_0 < easy)::INT + (entropy_1 < easy)::INT + (entropy_2 < easy)::INT - 2)),
          1e-8::DOUBLE) AS raw
      FROM entropies, th
    )
    SELECT idx, CAST(round(raw / (SELECT sum(raw) FROM scored) * 1e10) AS BIGINT) AS w FROM scored"""
)
def weights_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weights.sampling_weights(S.entropies(spark, sf_dir), "brownboost")
    return rows.select("idx", F.round(F.col("sampling_weight") * 1e10).cast("bigint").alias("w"))


@query(
    """
    SELECT l_orderkey AS idx, l_linenumber AS line, round(least(greatest(
             exp(2 * (l_quantity / greatest(avg(l_quantity) OVER (PARTITION BY l_suppkey), 1e-8))),
             0.2), 5), 9)::DOUBLE AS weight
    FROM lineitem
    """
)
def weights_batch_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("idx"),
        F.col("l_linenumber").alias("line"),
        "l_suppkey",
        F.col("l_quantity").alias("ce"),
    )
    out = weights.batch_loss_weights(rows, batch=["l_suppkey"])
    return out.select("idx", "line", F.round("weight", 9).alias("weight"))


# --- join and draw -----------------------------------------------------------------------------------


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"), "o_orderstatus", "o_totalprice"
    )


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ada = weights.sampling_weights(S.entropies(spark, sf_dir), "adaboost")
    table = ada.select("idx", "sampling_weight")
    return resample.join_weights(_dataset(spark, sf_dir).select("idx"), table)


_WEIGHTED_SQL = """
weighted AS (
  SELECT o_orderkey AS idx, coalesce(w, 0) AS w, ada.idx IS NULL AS missing
  FROM orders LEFT JOIN ada ON o_orderkey = ada.idx
), q AS (
  SELECT idx, missing, CAST(round(w / (SELECT fsum(w)
         FROM weighted) * 1152921504606846976.0::DOUBLE) AS BIGINT) AS q FROM weighted
)
"""
WEIGHTED = with_ctes(S.ENTROPIES_SQL, _ADA_SQL, _WEIGHTED_SQL)


@query(WEIGHTED + "SELECT idx, missing, q > 0 AS drawable, CAST(round(q / 1048576.0::DOUBLE) AS BIGINT) AS q FROM q")
def weight_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in units of 2**-40, where sums of doubles in another order agree."""
    rows = resample.quantised(_weighted(spark, sf_dir))
    units = F.round(F.col("q") / float(1 << 20)).cast("bigint")
    return rows.select("idx", "missing", (F.col("q") > 0).alias("drawable"), units.alias("q"))


@query("SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_orderkey % 29 = 0 GROUP BY o_custkey")
def rows_without_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose index is lost, by customer."""
    lost = F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderkey")).alias("idx")
    orders = S.table(spark, sf_dir, "orders").select("o_custkey", lost)
    return resample.rows_without_index(orders).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_rows"))


_DRAWS_SQL = """
spans AS (
  SELECT idx, q, sum(q) OVER (ORDER BY idx) - q AS lo FROM q WHERE q > 0
), probes AS (
  SELECT k AS draw, CAST(CAST('0x' || substr(md5('42:' || k), 1, 15) AS BIGINT)::HUGEINT
           * (SELECT sum(q) FROM q)::HUGEINT // 1152921504606846976 AS BIGINT) AS u
  FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS k)
), draws AS (
  SELECT draw, idx FROM probes ASOF JOIN spans ON u >= lo
)
"""
DRAWS = with_ctes(S.ENTROPIES_SQL, _ADA_SQL, _WEIGHTED_SQL, _DRAWS_SQL)


@query(
    DRAWS
    + """SELECT draw, idx, o_orderstatus, o_totalprice
         FROM draws JOIN orders ON idx = o_orderkey"""
)
def weighted_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = resample.weighted_draws(_weighted(spark, sf_dir), multiplier=1.0, seed=42)
    return resample.gather(_dataset(spark, sf_dir), draws)


@query(
    DRAWS
    + """SELECT (SELECT count(*) FROM orders) AS original_rows, CAST(sum(n) AS BIGINT) AS new_rows,
                count(*) AS unique_rows, count(*) FILTER (WHERE n > 1) AS repeated_rows,
                CAST(sum(n) - count(*) AS BIGINT) AS duplicate_draws,
                CAST(sum(n) * 3 // (4 * 1 * 32) AS BIGINT) AS steps
         FROM (SELECT idx, count(*) AS n FROM draws GROUP BY idx)"""
)
def resample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = resample.weighted_draws(_weighted(spark, sf_dir))
    size = _dataset(spark, sf_dir).agg(F.count(F.lit(1)).alias("original_rows"))
    steps = resample.optimiser_steps(
        F.col("new_rows"), epochs=3, processes=4, batch=1, accumulation=32
    )
    return resample.resample_stats(draws, size).withColumn("steps", steps)


@query(
    """
    SELECT o_orderkey AS idx, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1
           AS shuffled FROM orders
    """
)
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.seeded_shuffle(_dataset(spark, sf_dir).select("idx"))


@query(
    """
    SELECT o_orderkey AS idx, CAST(CASE WHEN o_orderkey < m * (s + 1) THEN o_orderkey // (s + 1)
             ELSE m + (o_orderkey - m * (s + 1)) // s END AS INTEGER) AS shard,
           CAST(o_orderkey % 16 AS INTEGER) AS stripe
    FROM orders, (SELECT count(*) // 16 AS s, count(*) % 16 AS m FROM orders)
    """
)
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of the order key, which is dense from zero: runs, and round robin."""
    runs = resample.with_shard(_dataset(spark, sf_dir).select("idx"), 16)
    return resample.with_shard(runs, 16, contiguous=False, out="stripe")


# --- tokens ------------------------------------------------------------------------------------------

LOGITS = with_ctes(S.LOGITS_SQL)
_ENTROPY_SQL = """
SELECT idx, round(coalesce(avg(h) FILTER (WHERE pos >= 2), 0), 9) AS entropy
FROM (SELECT idx, pos, -list_sum([exp(x - norm) * ln(exp(x - norm) + 1e-12::DOUBLE) for x in logits]) AS h
      FROM norms) GROUP BY idx
"""


@query(LOGITS + _ENTROPY_SQL)
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.sample_entropy(S.token_logits(spark, sf_dir), prompt_len=F.lit(S.PROMPT_LEN))
    return rows.select("idx", F.round("entropy", 9).alias("entropy"))


@query(LOGITS + f"SELECT idx, entropy AS entropy_0 FROM ({_ENTROPY_SQL})")
def entropy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy table as its sink stores it: in order of idx."""
    rows = tokens.sample_entropy(
        S.token_logits(spark, sf_dir), prompt_len=F.lit(S.PROMPT_LEN), out="entropy_0"
    )
    return rows.select("idx", F.round("entropy_0", 9).alias("entropy_0")).orderBy("idx")


@query(
    LOGITS
    + f"""SELECT idx, entropy AS entropy_0, row_number() OVER (ORDER BY idx) - 1 AS place
          FROM ({_ENTROPY_SQL})"""
)
def entropy_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in order of idx; read back and numbered by file and line."""
    path = shared_path(spark, "entropies")
    sinks.write_sorted_jsonl(entropy_table(spark, sf_dir), path)
    scan = jsonl.scan_jsonl_strict(spark, path, schemas.entropy_schema("entropy_0"))
    return dense_index(with_scan_order(scan), *SCAN_ORDER, out="place").drop(*SCAN_ORDER)


_CE_SQL = """
SELECT idx, coalesce(avg(norm - logits[label + 1]) FILTER (WHERE pos >= 2), 0) AS ce
FROM norms GROUP BY idx
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.token_logits(spark, sf_dir)
    return rows.withColumn(
        "label", tokens.masked_label(F.col("pos"), F.col("label"), F.lit(S.PROMPT_LEN))
    )


@query(LOGITS + f"SELECT idx, round(ce, 9) AS ce FROM ({_CE_SQL})")
def sample_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.sample_cross_entropy(_labelled(spark, sf_dir))
    return rows.select("idx", F.round("ce", 9).alias("ce"))


@query(
    LOGITS
    + f"""SELECT round(sum(ce * (idx % 3)::DOUBLE) / greatest(sum(greatest(idx % 3, 1e-8::DOUBLE)), 0), 6)
          AS loss FROM ({_CE_SQL})"""
)
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.sample_cross_entropy(_labelled(spark, sf_dir))
    weighted = rows.withColumn("weight", (F.col("idx") % 3).cast("double"))
    return tokens.weighted_loss(weighted).select(F.round("loss", 6).alias("loss"))


@query(
    LOGITS
    + """SELECT a.idx, a.pos, a.label, i - 1 AS v, round(0.7::DOUBLE * a.logits[i] + 0.3::DOUBLE * b.logits[i], 9) AS logit
         FROM logits a JOIN logits_b b USING (idx, pos), (SELECT unnest(range(1, 65)) AS i)"""
)
def logit_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = [S.token_logits(spark, sf_dir), S.token_logits(spark, sf_dir, second=True)]
    mixed = tokens.mix_logits([models[0], models[1].drop("label")], lam=0.3)
    return mixed.select(
        "idx", "pos", "label", F.posexplode("logits").alias("v", "x")
    ).select("idx", "pos", "label", F.col("v").cast("bigint").alias("v"), F.round("x", 9).alias("logit"))


BUCKETS = 8


@query(
    LOGITS
    + """SELECT a.idx, a.pos, a.label,
                round(list_sum([(a.logits[i] + b.logits[i] + c.logits[65 - i]) / 3 * i for i in range(1, 65)]), 6) AS logit_sum
         FROM logits a JOIN logits_b b USING (idx, pos) JOIN logits c USING (idx, pos)"""
)
def logit_mix_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of three models whose tables lie bucketed by token; each row's logits times their place."""
    first = S.token_logits(spark, sf_dir)
    second = S.token_logits(spark, sf_dir, second=True).drop("label")
    third = first.select("idx", "pos", F.reverse("logits").alias("logits"))
    mixed = tokens.mix_logits([tokens.bucketed(m, BUCKETS) for m in (first, second, third)])
    placed = F.transform("logits", lambda x, i: x * (i + 1))
    total = F.aggregate(placed, F.lit(0.0), lambda a, x: a + x)
    return mixed.select("idx", "pos", "label", F.round(total, 6).alias("logit_sum"))


@query(
    LOGITS
    + """, mixed AS (
      SELECT a.idx, a.pos, a.label, [(a.logits[i] + b.logits[i]) / 2 for i in range(1, 65)] AS logits
      FROM logits a JOIN logits_b b USING (idx, pos)
    ), shifted AS (
      SELECT *, lead(CASE WHEN pos >= 2 THEN label END) OVER (PARTITION BY idx ORDER BY pos) AS nxt,
             list_max(logits) AS peak FROM mixed
    )
    SELECT count(*) AS tokens, round(avg(peak + ln(list_sum([exp(x - peak) for x in logits])) - logits[nxt + 1]), 9) AS loss
    FROM shifted WHERE nxt IS NOT NULL"""
)
def mixed_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = S.token_logits(spark, sf_dir, second=True).drop("label")
    mixed = tokens.mix_logits([_labelled(spark, sf_dir), second])
    return tokens.next_token_loss(mixed).select("tokens", F.round("loss", 9).alias("loss"))


@query(
    LOGITS
    + """SELECT idx, pos, round(logits[label + 1] - (list_sum(logits) - logits[label + 1]) / 63, 9) AS margin
         FROM logits"""
)
def logit_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.with_margin(S.token_logits(spark, sf_dir))
    return rows.select("idx", "pos", F.round("margin", 9).alias("margin"))
