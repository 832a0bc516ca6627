"""Mixing sources to target weights by Pareto order sampling.

Sources, in code point order with null last, get shares of all words by their weights; a share stops
at `max_repeats` times the source's words and the excess goes to the others by weight. Inside a
source a document's expected number of copies follows its length band (powers of two words): each
band up expects `band_ratio` times the copies of the one below, capped at `max_repeats`, scaled so
that expected words equal the source's target. Whole copies are certain. The fraction that remains
is a document's inclusion probability: documents are ranked by random odds divided by inclusion odds
(Rosen's Pareto sampling) and taken in that order until the words that are still due are reached, to
within half a document.

Only narrow rows are kept: id, source, words, length band. The ranking never sorts a source: sums
over 4,096 slices of the rank key find the slice in which the words run out, and only the rows of
that slice are ordered. Random numbers are md5 of the seed and the id, so reruns agree.

Null and empty texts have no words, so nothing of them is taken. A null source is a source of its
own. Repeated rows are each a document; equal ranks are ordered by id, then words. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from winnow.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096
BAND_RATIO = 0.9
_CERTAIN = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(seed: int, id_col: Column) -> Column:
    """In (0, 1): 52 bits of md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def ranked_sources(words: DataFrame) -> DataFrame:
    """Add `place`: the dense place of each source in code point order, null last.

    Range partitions are numbered inside, and added up over one row per partition.
    """
    ordered = [F.col("source").isNull(), F.col("source")]
    cut = materialize(
        words.repartitionByRange(*ordered).withColumn("_part", F.spark_partition_id()), "mix-sources"
    )
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*ordered)) - 1
    return cut.withColumn("_inside", inside).join(offsets, "_part").select(
        *words.columns, (F.col("_offset") + F.col("_inside")).alias("place")
    )


def source_targets(sources: DataFrame, *, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """Add `target`: each source's share of all words, by raising one level until no share is cut anew.

    Each round is one sum over one row per source and sends two numbers to the driver.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    table = materialize(ranked_sources(sources).withColumn("weight", weight), "mix-targets")
    ceiling = F.col("source_size") * max_repeats
    level = 0.0
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while total:
        cut = F.col("weight") * level >= ceiling if level else F.lit(False)
        row = table.agg(
            F.sum(F.when(cut, ceiling).otherwise(0)).alias("cut"),
            F.sum(F.when(cut, 0.0).otherwise(F.col("weight"))).alias("rest"),
        ).first()
        if not row["rest"]:
            break
        raised = (total - row["cut"]) / row["rest"]
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * level, ceiling.cast("double"))
    return table.select("source", "source_size", target.alias("target"))


def expected_copies(bands: DataFrame, targets: DataFrame, *, max_repeats: int, band_ratio: float) -> DataFrame:
    """`copies` expected of a document, per source and band; at most about 40 bands in a source.

    Copies are min(max_repeats, k * band_ratio ** band). With bands in order, the factor k belongs to
    the first number of capped bands after which the next band stays below the cap.
    """
    pull = F.pow(F.lit(band_ratio), F.col("band"))
    rows = bands.join(targets, F.expr("source <=> _s")).withColumn("_pull", pull)
    order = Window.partitionBy("source").orderBy("band")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    below = order.rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("words").over(above), F.lit(0)) * max_repeats
    rest = F.sum(F.col("words") * F.col("_pull")).over(below)
    factor = F.when(rest > 0, (F.col("target") - capped) / rest)
    free = F.when(factor * F.col("_pull") <= max_repeats, factor)
    whole = Window.partitionBy("source")
    rows = rows.withColumn("_free", free).withColumn(
        "_k", F.min_by("_free", F.when(F.col("_free").isNotNull(), F.col("band"))).over(whole)
    )
    copies = F.least(F.coalesce(F.col("_k") * F.col("_pull"), F.lit(float(max_repeats))), F.lit(float(max_repeats)))
    near = F.abs(copies - F.round(copies)) < _CERTAIN
    copies = F.greatest(F.lit(0.0), F.when(near, F.round(copies)).otherwise(copies))
    return rows.select("source", "band", "words", "source_size", "target", copies.alias("copies"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_repeats: int = 3,
    band_ratio: float = BAND_RATIO,
    seed: int = 17,
    id_col: str = "doc_id",
) -> DataFrame:
    """Per document: id, size, source_size, target (of its source), copies, taken."""
    size = n_words(F.col("text"))
    narrow = materialize(
        docs.select(F.col(id_col).alias("_id"), "source", size.alias("size")).withColumn(
            "band", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
        ),
        "mix-sizes",
    )
    bands = materialize(narrow.groupBy("source", "band").agg(F.sum("size").alias("words")), "mix-bands")
    sources = bands.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights=weights, max_repeats=max_repeats)
    plan = materialize(
        expected_copies(
            bands, targets.withColumnRenamed("source", "_s"), max_repeats=max_repeats, band_ratio=band_ratio
        ),
        "mix-plan",
    )
    whole = F.floor("copies")
    odds = F.col("copies") - whole
    plan = plan.select(
        F.col("source").alias("_source"),
        F.col("band").alias("_band"),
        "words",
        "source_size",
        "target",
        whole.alias("whole"),
        odds.alias("chance"),
    )
    u = uniform(seed, F.col("_id"))
    key = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    slot = F.least(F.floor(key / (1 + key) * SLICES), F.lit(SLICES - 1)).cast("int")
    rows = narrow.join(plan, F.expr("source <=> _source and band = _band"))
    chosen = rows.withColumn("key", F.when((F.col("chance") > 0) & (F.col("size") > 0), key)).withColumn(
        "slot", F.when(F.col("key").isNotNull(), slot)
    )
    # Words still due after whole copies, per source; words per slice, per source.
    due = plan.groupBy("_source").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("due"))
    slots = chosen.where("slot is not null").groupBy("source", "slot").agg(F.sum("size").alias("slot_words"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    cuts = materialize(
        slots.withColumn("base", F.coalesce(F.sum("slot_words").over(before), F.lit(0)))
        .join(due, F.expr("source <=> _source"))
        .where("base < due and due < base + slot_words")
        .select(F.col("source").alias("_cut_source"), F.col("slot").alias("cut"), "base", "due"),
        "mix-cuts",
    )
    # Sources whose words run out after their last slice take every row that has a rank.
    placed = chosen.join(cuts, F.expr("source <=> _cut_source"), "left").join(
        due.select(F.col("_source").alias("_due_source"), F.col("due").alias("_due")), F.expr("source <=> _due_source")
    )
    edge = placed.where("slot = cut")
    inside = Window.partitionBy("source", "slot").orderBy("key", "_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("base") + running - F.col("size") / 2
    edge = edge.withColumn("extra", (middle <= F.col("due")).cast("int"))
    plain = F.when(F.col("slot").isNull(), 0).when(F.col("cut").isNull(), (F.col("_due") > 0).cast("int"))
    rest = placed.where("slot is null or cut is null or slot != cut").withColumn(
        "extra", plain.otherwise((F.col("slot") < F.col("cut")).cast("int"))
    )
    copies = (F.col("whole") + F.col("extra")).cast("bigint")
    return rest.unionByName(edge).select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixing(docs: DataFrame) -> DataFrame:
    return mix(docs)
