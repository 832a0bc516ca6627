"""Dataset files by suffix, several sources in order, entropy files, benchmark files."""

from __future__ import annotations

import warnings
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from winnow import schemas
from winnow.operators import benchmarks, entropy
from winnow.operators.ordering import SCAN_ORDER, dense_index, with_scan_order
from winnow.sources import jsonl


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_dataset(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    *,
    with_order: bool = False,
) -> DataFrame:
    """Rows of a .parquet, .pq, .jsonl or .json path; other suffixes are refused.

    A line or element that is not an object fails the read. `with_order` adds the scan-order columns.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    schema = schema or schemas.BENCHMARK_RAW
    if suffix == ".json":
        return jsonl.scan_json_document(spark, path, schema, with_order=with_order)
    if suffix in (".parquet", ".pq"):
        rows = scan_parquet(spark, path)
    elif suffix == ".jsonl":
        rows = jsonl.scan_jsonl_strict(spark, path, schema)
    else:
        raise ValueError(f"dataset must be .json, .jsonl, .parquet or .pq: {path}")
    return with_scan_order(rows) if with_order else rows


def union_sources(sources: list[DataFrame], *, number: str = "file_no") -> DataFrame:
    """All rows of several tables, absent columns null, with the source's number to keep order."""
    numbered = [s.withColumn(number, F.lit(n)) for n, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def read_entropy_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Merged entropies from JSON-lines files given as path -> field; missing files are skipped."""
    tables = []
    for path, field in paths.items():
        if not exists(spark, path):
            warnings.warn(f"entropy file not found, skipped: {path}", stacklevel=2)
            continue
        scan = with_scan_order(jsonl.scan_jsonl_strict(spark, path, schemas.entropy_schema(field)))
        # By file name, then line: the number of a row alone follows the packing of splits.
        tables.append(scan.withColumn("_line", F.struct(*SCAN_ORDER)).drop(*SCAN_ORDER))
    if not tables:
        raise FileNotFoundError(f"none of the entropy files exists: {list(paths)}")
    return entropy.merge_entropies(tables, line="_line")


def load_benchmark(
    spark: SparkSession,
    path: str,
    *,
    dataset: str | None = None,
    validate_count: bool = False,
    protocol: str = "paper",
) -> DataFrame:
    """`id, position, question, answer` of a benchmark file; malformed rows fail the load."""
    raw = read_dataset(spark, path, with_order=True)
    placed = dense_index(raw, *SCAN_ORDER, out="position").drop(*SCAN_ORDER)
    rows = benchmarks.normalised(placed, protocol=protocol)
    return benchmarks.accepted(rows, dataset=dataset, validate_count=validate_count)
