"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from winnow.session import materialize  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def buckets(spark: SparkSession) -> int:
    """Groups that packed rows are dealt to: follows the session's shuffle partitions."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_fields(schema: StructType, **kinds: str) -> StructType:
    """A copy of a schema with more fields; kinds by their DDL names."""
    more = [StructField(name, _parse_datatype_string(kind)) for name, kind in kinds.items()]
    return StructType([*schema.fields, *more])


def hash_bucket(remainder_of: int, c: Column) -> Column:
    """crc32 of an id's text, modulo a number: the fixed split into learned and held-out rows."""
    return F.crc32(c.cast("string").cast("binary")) % F.lit(remainder_of)


def held_out(remainder_of: int, remainder: int, c: Column) -> Column:
    """Whether an id is held out; a null id has no remainder, so it is not, nor is it learned from."""
    return F.coalesce(hash_bucket(remainder_of, c) == remainder, F.lit(False)).alias("held_out")


def bounded_ids(df: DataFrame, id_col: str, limit: int, by: Iterable[str] = ()) -> DataFrame:
    """At most `limit` distinct ids (of each value of `by`), lowest hash first: an even sample.

    Rank limits apply in each task before the shuffle, so no group is gathered whole.
    """
    by = list(by)
    ids = df.where(F.col(id_col).isNotNull()).select(id_col, *by).distinct()
    if not by:
        return ids.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(id_col), id_col))
    return ids.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch: what a task holds besides the batch follows the slice."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
