"""SHA-256 of files and folders, and the comparison with pinned values.

SHA-256 follows a stream's bytes in order, but not in one task: what is longer than STEP bytes is read by
file splits, written as pieces, and followed step by step. A step's task takes up the state of the hash,
a hundred bytes, where the one before laid it down. Steps of one stream run one after the other, those of
different streams side by side.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from winnow.functions import midstate
from winnow.operators.checks import ValidationError, check
from winnow.session import materialize, shared_path
from winnow.sources.raw import BOM, DECODED, file_lines, files_of, list_files, split_lines

STEP = 128 * 2**20  # bytes of a stream that one task follows, but for a line that reaches beyond


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, length, pieces in files_of(batches):
        # A byte order mark is only known of at the end.
        plain, marked = hashlib.sha256(), hashlib.sha256(BOM)
        for piece in pieces:
            if piece is BOM:
                plain = marked
            else:
                plain.update(piece)
                marked.update(piece)
        yield pa.RecordBatch.from_pydict({"_path": [path], "sha256": [plain.hexdigest()]})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of splits, numbered: every line with a line feed behind it."""
    key, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, blocks = batch["path"].dictionary_encode().indices.to_numpy(), batch["block"].to_numpy()
        cuts = np.flatnonzero((np.diff(paths) != 0) | (np.diff(blocks) != 0)) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            here = batch["path"][lo].as_py(), int(blocks[lo])
            key, n = here, n + 1 if here == key else 0
            data = b"\n".join([*batch["line"].slice(lo, hi - lo).to_pylist(), b""])
            row = {"path": here[0], "length": batch["length"][lo].as_py(), "block": here[1], "n": n, "size": len(data), "data": data}
            yield pa.RecordBatch.from_pylist([row])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stream, state, seen, sha256) after the pieces of a step; `seen` counts those of the current file.

    A stream's first row holds the state, if there is one, at place -1. How far a file's length is from
    that of its lines tells whether it starts with a byte order mark and ends with a line feed.
    """

    def result() -> pa.RecordBatch:
        row = {"stream": stream, "state": hashed.state(), "seen": seen, "sha256": hashed.hexdigest()}
        return pa.RecordBatch.from_pylist([row])

    stream, hashed, seen = None, midstate.Sha256(), 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch[name][i].as_py() for name in batch.schema.names}
            if row["stream"] != stream:
                if stream is not None:
                    yield result()
                stream, hashed, seen = row["stream"], midstate.Sha256(), 0
            data = row["data"]
            if row["place"] < 0:
                hashed, seen = midstate.Sha256(data), row["total"]
                continue
            more = row["length"] - row["total"]
            if more not in (-1, 0, len(BOM) - 1, len(BOM)):
                raise OSError(f"read {row['total']} of {row['length']} bytes")
            if row["block"] == 0 and row["n"] == 0:
                seen = 0
                if more > 0:
                    hashed.update(BOM)
            seen += len(data)
            if seen == row["total"] and more in (-1, len(BOM) - 1):
                data = data[:-1]
            hashed.update(data)
    if stream is not None:
        yield result()


def _stream_hashes(files: DataFrame, lines: DataFrame, step: int) -> DataFrame:
    """`stream, sha256` of written `files` (stream, path, length, place of the first byte), in steps."""
    spark = files.sparkSession
    pieces = lines.mapInArrow(_pack, "path string, length bigint, block bigint, n bigint, size bigint, data binary")
    placed = pieces.join(files.select("stream", F.col("path").alias("_path"), "place"), F.col("path") == F.col("_path")).drop("_path")
    placed = placed.withColumn("step", F.floor((F.col("place") + F.col("block")) / step).cast("int"))
    path = shared_path(spark, "checksum-pieces")
    placed.write.partitionBy("step").parquet(path)
    pieces = spark.read.schema(placed.schema).parquet(path)
    totals = pieces.groupBy(F.col("path").alias("_path")).agg(F.sum("size").alias("total"))
    totals = materialize(totals, "checksum-totals")
    facts = files.agg(F.max(F.col("place") + F.col("length")).alias("end"), F.count_distinct("stream").alias("streams")).first()
    # As many partitions as streams at least, so that a task follows few of them.
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = [facts["streams"]] if facts["streams"] > shuffled else []
    states = None
    for s in range((facts["end"] or 0) // step + 1):
        rows = pieces.where(F.col("step") == s).join(totals, F.col("path") == F.col("_path"))
        rows = rows.select("stream", "place", "path", "block", "n", "length", "total", "data")
        if states is not None:
            none = F.lit(None)
            carried = states.select(
                "stream", F.lit(-1).cast("bigint").alias("place"), none.cast("string").alias("path"),
                none.cast("bigint").alias("block"), none.cast("bigint").alias("n"), none.cast("bigint").alias("length"),
                F.col("seen").alias("total"), F.col("state").alias("data"),
            )
            rows = rows.unionByName(carried)
        rows = rows.repartition(*dealt, "stream").sortWithinPartitions("stream", "place", "path", "block", "n")
        states = materialize(
            rows.mapInArrow(_follow, "stream string, state binary, seen bigint, sha256 string"), "checksum-states"
        )
    return states.select("stream", "sha256")


def _long(step: int) -> Column:
    """Files that are followed in steps; a codec would read those of its suffix."""
    return (F.col("length") > step) & ~F.col("path").rlike(DECODED)


def file_checksums(spark: SparkSession, path: str | list[str], *, glob: str = "*", step: int = STEP) -> DataFrame:
    """`path, length, sha256` of every file; one task follows up to `step` bytes of a file.

    Files that look compressed are followed by one task each, and so are all where OpenSSL offers no state
    (`midstate.available`). Spark's readers pass over files without bytes, so these have no row; a pin on
    one fails.
    """
    files = list_files(spark, path, glob)
    lines, kind = file_lines(spark, path, glob), "_path string, sha256 string"
    long = files.where(_long(step))
    if midstate.available() and not long.isEmpty():
        own = long.select(F.col("path").alias("stream"), "path", "length", F.lit(0).cast("bigint").alias("place"))
        split = split_lines(spark, path, glob).where(_long(step))
        steps = _stream_hashes(materialize(own, "checksum-files"), split, step)
        hashes = lines.where(~_long(step)).mapInArrow(_hash_files, kind).unionByName(steps.withColumnRenamed("stream", "_path"))
    else:
        hashes = lines.mapInArrow(_hash_files, kind)
    # Without a line, as it holds nothing but a byte order mark.
    bare = F.when(F.col("length") == len(BOM), hashlib.sha256(BOM).hexdigest())
    joined = files.join(hashes, F.col("path") == F.col("_path"), "left")
    return joined.select("path", "length", F.coalesce("sha256", bare).alias("sha256"))


def folder_checksums(spark: SparkSession, path: str, *, glob: str, step: int = STEP) -> DataFrame:
    """`folder, length, sha256` of the files of each folder as one stream, in order of their names.

    For text that many tasks have written: its digest is that of the single file it would make. The files
    must hold lines and have no suffix of a codec.
    """
    files = list_files(spark, path, glob).withColumn("stream", F.regexp_extract("path", "^(.*)/", 1))
    before = Window.partitionBy("stream").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("place", F.coalesce(F.sum("length").over(before), F.lit(0)))
    files = materialize(files, "checksum-files")
    hashes = _stream_hashes(files, split_lines(spark, path, glob), step).withColumnRenamed("stream", "folder")
    sizes = files.groupBy(F.col("stream").alias("_stream")).agg(F.sum("length").alias("length"))
    return sizes.join(hashes, F.col("_stream") == F.col("folder")).select("folder", "length", "sha256")


def checksum_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Pinned files (`name, expected`) that are absent or differ; names are the last path part."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    joined = expected.join(named, "name", "left")
    return joined.where(~F.coalesce(F.col("sha256") == F.lower("expected"), F.lit(False)))


def pin(files: DataFrame, expected: dict[str, str]) -> None:
    """Fail unless every named file has its pinned checksum."""
    if not expected:
        raise ValidationError("no pinned checksums given")
    table = files.sparkSession.createDataFrame(
        list(expected.items()), "name string, expected string"
    )
    check(checksum_mismatches(files, table).select("name", "expected", "sha256"), "checksum mismatch")
