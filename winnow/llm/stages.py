"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and calls one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow.llm import decontaminate, mixing, neardup, pii, toxicity
from winnow.llm.common import materialize, table

SIMILARITY_PERCENT = 80
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in Arrow batches of a few MB, from now on in this session.

    A task holds a batch in the JVM's native memory and again in its Python worker, and over a long run
    neither gives that memory back. Rows are read after a stage has returned, so the setting stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    bound_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Equal rows all stay or all go; of rows that share an id and differ in text, each goes by its own group.
    """
    bound_batches(spark)
    rows = neardup.near_duplicates(docs, percent=SIMILARITY_PERCENT).where("not kept")
    gone = rows.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    gone = materialize(gone, "pipeline-copies")
    same = (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    # Copies grow with the corpus: never broadcast.
    return docs.hint("merge").join(gone, same, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Of rows that share an id, all go when one is contaminated.
    """
    rows = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = materialize(rows.where("n_hit > 0").select(F.col("doc_id").alias("_gone")).distinct(), "pipeline-leaks")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    bound_batches(spark)
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, numbered by `copy` from 1.

    Of rows that share an id, each is there as often as the copies of all of them allow: the copies
    are summed per id and size and dealt to its rows evenly, which is exact for equal rows. Columns of
    `docs` named `size` or `copy` give way to those of the mix.
    """
    plan = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "copies")
    plan = plan.groupBy("_id", "_size").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    plan = materialize(plan.where("_copies > 0"), "pipeline-mix")
    # The row as one struct: its column names cannot clash with the others.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_own"), mixing.n_words(F.col("text")).alias("_words"))
    # The plan has a row per document: never broadcast.
    rows = rows.hint("merge").join(plan, F.expr("_own <=> _id and _words = _size"))
    times = F.round(F.col("_copies") / F.col("_rows")).cast("int")
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("size", "copy")]
    rows = rows.where(times > 0).select(*kept, F.col("_words").alias("size"), F.sequence(F.lit(1), times).alias("copy"))
    return rows.withColumn("copy", F.explode("copy"))
