"""Bytes of files as a stream of lines, on any store that Spark reads, at any file size.

Spark's text reader delivers a file's bytes between line feeds unchanged, whatever they are. With the
pass-through codec registered for the files' suffix, Hadoop neither decompresses nor splits them, so one
task reads a file from start to end in order. Python sees a batch of lines at a time and never opens a
path. A file must have a line feed in every 2 GB.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_CODEC = "org.apache.hadoop.io.compress.PassthroughCodec"
# The second name is that of Hadoop's shaded client, which renames the setting with its packages.
_SUFFIX_OPTIONS = (
    "io.compress.passthrough.extension",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension",
)
DECODED = r"\.(gz|bz2|zst|lz4|snappy|deflate|br|lzo|lzo_deflate|zlib|passthrough)$"
BOM = b"\xef\xbb\xbf"


def list_files(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """`path, length` of the files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), "length")


def file_lines(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """`path, length, line` (binary) with every file's lines in order within one partition.

    A glob that ends in a plain suffix, as `*.zst`, is read without a shuffle. Under any other glob files
    may be split, and their lines are brought together by path and sorted.
    """
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob)
    suffix = re.fullmatch(r".*?(\.[^.*?\[\]{}\\]+)", glob)
    if suffix:
        reader = reader.option("io.compression.codecs", _CODEC)
        for name in _SUFFIX_OPTIONS:
            reader = reader.option(name, suffix[1])
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length")]
    line = F.col("value").cast("binary").alias("line")
    if suffix:
        return reader.text(path).select(*meta, line)
    place = [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")]
    lines = reader.text(path).select(*meta, line, *place)
    return lines.repartition("path").sortWithinPartitions("path", "_block", "_row").drop("_block", "_row")


def split_lines(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """`path, length, block, line` of files that Spark splits; a split's lines are in order in one task.

    Not for files with a suffix in DECODED: Hadoop would deliver their lines decompressed.
    """
    meta = {"path": "file_path", "length": "file_size", "block": "file_block_start"}
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    line = F.col("value").cast("binary").alias("line")
    return lines.select(*(F.col(f"_metadata.{m}").alias(name) for name, m in meta.items()), line)


def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(path, length, pieces) of every file of a partition of `file_lines`; pieces make up its bytes.

    Only the line feed at the end and a byte order mark at the start are not among the lines: the length
    tells whether they are there. A mark comes as the last piece, and the caller puts it first.
    """

    def runs() -> Iterator[tuple[tuple[str, int], bytes]]:
        for batch in batches:
            paths = batch.column(0)
            if not len(paths):
                continue
            codes = paths.dictionary_encode().indices.to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in itertools.pairwise(bounds):
                key = paths[lo].as_py(), batch.column(1)[lo].as_py()
                yield key, b"\n".join(batch.column(2).slice(lo, hi - lo).to_pylist())

    def pieces(length: int, lines: Iterator[tuple[object, bytes]]) -> Iterator[bytes]:
        seen = -1
        for _, part in lines:
            piece = part if seen < 0 else b"\n" + part
            seen = max(seen, 0) + len(piece)
            yield piece
        left = length - seen
        if left not in (0, 1, len(BOM), len(BOM) + 1):
            raise OSError(f"read {seen} of {length} bytes")
        if left % len(BOM) == 1:
            yield b"\n"
        if left >= len(BOM):
            yield BOM

    for (path, length), lines in itertools.groupby(runs(), lambda r: r[0]):
        yield path, length, pieces(length, lines)
