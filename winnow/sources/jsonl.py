"""JSON sources: JSON lines (strict and lenient), JSON documents, zstd-compressed JSON lines."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from winnow.operators.ordering import SCAN_ORDER, with_scan_order
from winnow.sources.raw import file_lines, files_of, list_files

MAX_WINDOW = 1 << 31  # the format's limit
BAD_LINE = "_bad_line"


def scan_jsonl_strict(
    spark: SparkSession, path: str | list[str], schema: T.StructType
) -> DataFrame:
    """JSON lines; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_jsonl_lenient(
    spark: SparkSession, path: str | list[str], schema: T.StructType, *, glob: str | None = None
) -> DataFrame:
    """JSON lines with the text of a bad line in `_bad_line`, null for a good one."""
    marked = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    reader = (
        spark.read.schema(marked)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def good_lines(df: DataFrame) -> DataFrame:
    return df.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def bad_lines(df: DataFrame) -> DataFrame:
    """Text of the bad lines, for a count or a warning.

    Spark refuses a scan of the marker alone, so the filter names a data column too.
    """
    field = next(c for c in df.columns if c != BAD_LINE)
    named = F.length(F.coalesce(F.to_json(F.struct(field)), F.lit(""))) >= 0
    return df.where(F.col(BAD_LINE).isNotNull() & named).select(BAD_LINE)


def scan_json_document(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    with_order: bool = False,
) -> DataFrame:
    """JSON documents holding a top-level array of rows, or an object with the rows under `data`.

    A document is one task, as JSON text cannot be split; large tables belong in JSON lines.
    `with_order` adds the scan-order columns.
    """
    if "data" in schema.fieldNames():
        raise ValueError("a row field named data cannot be told from the wrapper")
    whole = T.StructType([*schema.fields, T.StructField("data", T.ArrayType(schema))])
    scan = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path)
    docs = with_scan_order(scan)
    wrapped = F.col("data").isNotNull()
    rows = F.when(wrapped, F.col("data")).otherwise(F.array(F.struct(*schema.fieldNames())))
    # A wrapped document is one scan row, a top-level array one scan row per element.
    items = docs.select(*SCAN_ORDER, F.posexplode(rows).alias("_item", "_value"))
    if not with_order:
        return items.select("_value.*")
    place = (F.col("_row") + F.col("_item")).alias("_row")
    return items.select("_value.*", "_file", "_block", place)


# --- zstd --------------------------------------------------------------------------------------

_LINE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)
_LINES_PER_BATCH = 4096
_BATCH_BYTES = 32 << 20
_FEED_BYTES = 1 << 16


class _Source(io.RawIOBase):
    """Pieces of a file as a readable stream."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def read(self, size: int = _FEED_BYTES) -> bytes:
        while not len(self.held):
            piece = next(self.pieces, None)
            if piece is None:
                return b""
            self.held = memoryview(piece)
        out, self.held = self.held[:size], self.held[size:]
        return bytes(out)


def _stream_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that are not blank, with their number in the file, a bounded batch at a time."""
    import zstandard

    for path, _, pieces in files_of(batches):
        lines: list[str] = []
        numbers: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = {"path": [path] * len(lines), "line_no": pa.array(numbers, pa.int64())}
            return pa.RecordBatch.from_pydict(columns | {"line": pa.array(lines, pa.string())})

        reader = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).stream_reader(
            _Source(pieces), read_across_frames=True
        )
        for number, line in enumerate(io.BufferedReader(reader, 1 << 20)):
            if not line.strip():
                continue
            lines.append(line.decode("utf-8", "replace").rstrip("\n"))
            numbers.append(number)
            size += len(line)
            if len(lines) >= _LINES_PER_BATCH or size >= _BATCH_BYTES:
                yield flush()
                lines, numbers, size = [], [], 0
        if lines:
            yield flush()


def zst_lines(spark: SparkSession, path: str | list[str], glob: str = "*.zst") -> DataFrame:
    """`path, line_no, line` of zstd-compressed text files of any window size; no file is an error.

    Spark reads the compressed bytes, so any store it reads will do; the task that reads a file
    decompresses it as a stream. Such a file cannot be split: repartition before heavy work.
    """
    if list_files(spark, path, glob).isEmpty():
        raise FileNotFoundError(f"no {glob} files in {path}")
    return file_lines(spark, path, glob).mapInArrow(_stream_lines, _LINE)


def scan_zst_jsonl(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    glob: str = "*.jsonl.zst",
    with_order: bool = False,
) -> DataFrame:
    """zstd-compressed JSON lines, bad lines marked in `_bad_line`; no file is an error.

    `with_order` adds the scan-order columns, by path and line number.
    """
    lines = zst_lines(spark, path, glob)
    marked = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    rows = lines.select("path", "line_no", F.from_json("line", marked, options).alias("row"))
    if not with_order:
        return rows.select("row.*")
    order = (F.col("path"), F.lit(0).cast("bigint"), F.col("line_no"))
    return rows.select("row.*", *(c.alias(name) for c, name in zip(order, SCAN_ORDER)))
