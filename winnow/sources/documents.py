"""JSON documents of any size, each file split read by its own task.

Spark's text reader cuts a file after every closing brace, so a file of one endless line has splits as
well. Whether a split starts inside a string, and how many brackets are open there, follows from its
predecessors: every split is summed up by its quotes and by its brackets for both cases, and a running
sum over one row a split settles them in order. A second reading finds which parts of an object belong
to `data`; the last one cuts out the rows. A row that crosses splits comes as fragments, at most two a
split, which are put together by file.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from winnow.operators.ordering import SCAN_ORDER
from winnow.session import materialize

_CHUNK = 1 << 20
_SPLIT = ["_file", "_block"]
_QUOTE, _COMMA, _COLON, _OPEN, _CLOSE = b'",:[]'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1

_SUMS = "_file string, _block bigint, size bigint, pieces bigint, bytes bigint, quotes bigint, outside bigint, inside bigint, kind string"
_FLAGS = "_file string, _block bigint, flag boolean, found boolean"
_ROWS = "_file string, _block bigint, _row bigint, edge int, text string"


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").cast("binary").alias("piece"),
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, bytes]]:
    """(the split's columns, pieces, bytes): the pieces of a split, about _CHUNK bytes at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch["_file"].dictionary_encode().indices.to_numpy()
        block = batch["_block"].to_numpy()
        ends = np.flatnonzero((np.diff(codes) != 0) | (np.diff(block) != 0)) + 1
        names = [n for n in batch.schema.names if n != "piece"]
        for lo, hi in itertools.pairwise([0, *ends.tolist(), batch.num_rows]):
            split = tuple(batch[n][lo].as_py() for n in names)
            held, size = [], 0
            for piece in batch["piece"].slice(lo, hi - lo):
                held.append(piece.as_py())
                size += len(held[-1]) + 1
                if size >= _CHUNK:
                    yield split, len(held), b"}".join(held) + b"}"
                    held, size = [], 0
            if held:
                yield split, len(held), b"}".join(held) + b"}"


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[tuple, int, bytes]]]]:
    return itertools.groupby(_chunks(batches), lambda c: c[0])


class _Marks:
    """Bytes of a chunk, which of them are in strings, and the open brackets after each."""

    def __init__(self, raw: bytes, inside: int, depth: int) -> None:
        # No piece ends between a backslash and what it escapes.
        self.clean = raw.replace(b"\\\\", b"__").replace(b'\\"', b"__")
        self.at = np.frombuffer(self.clean, np.uint8)
        self.quotes = self.at == _QUOTE
        self.within = ((np.cumsum(self.quotes) + inside) & 1).astype(bool)
        self.step = np.where(self.within, 0, _STEP[self.at])
        self.depth = depth + np.cumsum(self.step, dtype=np.int64)
        self.end = (int(self.quotes.sum() + inside) & 1, int(self.depth[-1]))

    def places(self, sign: int, depth: int) -> np.ndarray:
        return np.flatnonzero((self.at == sign) & ~self.within & (self.depth == depth))

    def data(self) -> tuple[np.ndarray, np.ndarray]:
        """Colons of the outermost object, and whether each brings the array of `data`."""
        colons = self.places(_COLON, 1)
        found = np.zeros(len(colons), bool)
        for i, p in enumerate(colons.tolist()):
            q = self.clean.rfind(b'"', 0, p)
            if self.clean[max(0, q - 5) : q + 1] == b'"data"':
                found[i] = self.clean[p + 1 : p + 65].lstrip()[:1] == b"["
        return colons, found


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block, size), chunks in _splits(batches):
        pieces = n_bytes = quotes = outside = inside = 0
        kind = None
        for _, n, raw in chunks:
            marks = _Marks(raw, quotes & 1, 0)
            step = _STEP[marks.at]
            pieces, n_bytes, quotes = pieces + n, n_bytes + len(raw), quotes + int(marks.quotes.sum())
            outside, inside = outside + int(step[~marks.within].sum()), inside + int(step[marks.within].sum())
            kind = kind or raw.lstrip(b" \t\r\n")[:1].decode("latin-1") or None
        row = (file, block, size, pieces, n_bytes, quotes, outside, inside, kind)
        names = [f.split()[0] for f in _SUMS.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, row))], pa.schema([(n, pa.string() if n in ("_file", "kind") else pa.int64()) for n in names]))


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block, inside, depth, *_), chunks in _splits(batches):
        flag, found = None, False
        for _, _, raw in chunks:
            marks = _Marks(raw, inside, depth)
            (inside, depth), (colons, data) = marks.end, marks.data()
            if len(colons):
                flag, found = bool(data[-1]), found or bool(data.any())
        schema = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("flag", pa.bool_()), ("found", pa.bool_())])
        yield pa.RecordBatch.from_pylist([{"_file": file, "_block": block, "flag": flag, "found": found}], schema)


def _cut(fragments: bool):
    """Task function: the rows that lie within a split (edge 0), or the fragments of the others: rest of a
    split (1), a whole split (2), head of a split (3)."""

    def rows(split: tuple, chunks: Iterator[tuple[tuple, int, bytes]]) -> Iterator[tuple[int, bytes]]:
        _, block, inside, depth, level, data, pieces = split
        held: list[bytes] | None = None
        if level == 0 or (depth >= level and (level == 1 or data)):
            held = []
        own, after_open, seen = level == 0 and block == 0, False, 0
        for _, n, raw in chunks:
            seen += n
            marks, cursor = _Marks(raw, inside, depth), 0
            inside, depth = marks.end
            events = np.zeros(0, np.int64)
            if level:
                opens = marks.places(_OPEN, level)
                opens = opens[marks.step[opens] == 1]
                closes = marks.places(_CLOSE, level - 1)
                events = np.sort(np.concatenate([opens, marks.places(_COMMA, level), closes]))
            if level == 2:
                colons, found = marks.data()
                flags = np.concatenate([[bool(data)], found])
                events = events[flags[np.searchsorted(colons, events)]]
                data = bool(flags[-1])
            for p in events.tolist():
                sign = raw[p]
                if sign != _OPEN and held is not None:
                    held.append(raw[cursor:p])
                    text = b"".join(held)
                    if not (sign == _CLOSE and after_open and own and not text.strip()):
                        yield (0 if own else 3), text
                held, own, after_open, cursor = (None if sign == _CLOSE else []), True, sign == _OPEN, p + 1
            if held is not None:
                held.append(raw[cursor:])
        if seen != pieces:
            raise ValueError(f"split {split[:2]} came in parts: {seen} of {pieces} pieces")
        if held is not None:
            yield (1 if own else 2), b"".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split, chunks in _splits(batches):
            places, edges, texts, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                n = len(places)
                columns = [pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64())]
                columns += [pa.array(places, pa.int64()), pa.array(edges, pa.int32()), pa.array(texts, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=["_file", "_block", "_row", "edge", "text"])

            for place, (edge, text) in enumerate(rows(split, chunks)):
                if (edge > 0) != fragments:
                    continue
                places.append(place)
                edges.append(edge)
                texts.append(text.decode("utf-8", "replace"))
                size += len(text)
                if size >= _CHUNK:
                    yield flush()
                    places, edges, texts, size = [], [], [], 0
            if places:
                yield flush()

    return run


def _starts(sums: DataFrame) -> DataFrame:
    """Per split: whether it starts inside a string, open brackets there, the file's kind; bad files fail."""
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file")
    rows = sums.withColumn("start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("bigint"))
    rows = rows.withColumn("change", F.when(F.col("start") == 1, F.col("inside")).otherwise(F.col("outside")))
    # The reader does not tell whether the last piece had its brace; a byte order mark is not among the bytes.
    extra = F.when((F.sum("bytes").over(whole) - F.col("size")).isin(1, -2), 1).otherwise(0)
    sound = (F.sum("quotes").over(whole) % 2 == 0) & (F.sum("change").over(whole) == -F.col("extra"))
    kind = F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("_block"))).over(whole)
    rows = rows.withColumn("extra", extra).withColumn("top", kind)
    broken = F.raise_error(F.concat(F.lit("malformed JSON document: "), F.col("_file"))).cast("bigint")
    depth = F.coalesce(F.sum("change").over(before), F.lit(0))
    rows = rows.select(*_SPLIT, "start", depth.alias("depth"), sound.alias("sound"), "top", "extra", "pieces")
    depth = F.when(F.col("sound") & F.col("top").isin("[", "{"), F.col("depth")).otherwise(broken)
    # A file of blanks holds one piece that is no document.
    return rows.where("top is not null and not (top = '}' and extra = 1)").withColumn("depth", depth)


def _read(pieces: DataFrame, splits: DataFrame, *columns: str) -> DataFrame:
    """The pieces of the given splits in order, with columns of their split; no split is torn apart."""
    rows = pieces.select(*_SPLIT, "_at", "piece").join(splits.select(*_SPLIT, *columns), _SPLIT)
    return rows.sortWithinPartitions(*_SPLIT, "_at").select(*_SPLIT, *columns, "piece")


def _parsed(text: Column, schema: T.StructType) -> Column:
    value = F.from_json(text, schema, {"mode": "FAILFAST"})
    bad = F.raise_error(F.concat(F.lit("not a row: "), F.substring(text, 1, 100))).cast(schema)
    return F.when(text.rlike(r"^\s*\{"), value).otherwise(bad)


def scan_split_document(
    spark: SparkSession, path: str | list[str], schema: T.StructType, *, with_order: bool = False
) -> DataFrame:
    """Rows of JSON documents: a top-level array, the array under `data` of an object, or else the object.

    The same rows as `jsonl.scan_json_document`, but a file is read by as many tasks as it has splits, three or
    four times. One row at most is held at a time. `with_order` adds the scan-order columns. A
    document that ends early, an element that is no object, and a bad value fail the job.
    """
    if "data" in schema.fieldNames():
        raise ValueError("a row field named data cannot be told from the wrapper")
    pieces = _pieces(spark, path)
    sums = pieces.select(*_SPLIT, "size", "piece").mapInArrow(_sums, _SUMS)
    starts = materialize(_starts(materialize(sums, "json-sums")), "json-starts")
    flags = _read(pieces, starts.where("top = '{'"), "start", "depth").mapInArrow(_flags, _FLAGS)
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.max("found").over(Window.partitionBy("_file")), F.lit(False))
    level = F.when(F.col("top") == "[", 1).when(found, 2).otherwise(0)
    splits = starts.join(flags, _SPLIT, "left").select(
        *_SPLIT, "start", "depth", level.alias("level"), F.last("flag", True).over(before).alias("data"), "pieces", "extra"
    )
    splits = materialize(splits, "json-splits")
    rows = _read(pieces, splits, "start", "depth", "level", "data", "pieces")
    whole = rows.mapInArrow(_cut(False), _ROWS).select(*SCAN_ORDER, "text")
    parts = materialize(rows.mapInArrow(_cut(True), _ROWS), "json-fragments")
    nth = F.count_if(F.col("edge") == 1).over(Window.partitionBy("_file").orderBy("_block", "_row"))
    crossing = parts.withColumn("nth", nth).groupBy("_file", "nth").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_row", "text"))).alias("parts")
    )
    text = F.array_join(F.col("parts.text"), "")
    ends = splits.where("level = 0 and extra = 1").select("_file").distinct()
    crossing = crossing.join(ends.withColumn("brace", F.lit(1)), "_file", "left").select(
        "_file", F.col("parts")[0]["_block"].alias("_block"), F.col("parts")[0]["_row"].alias("_row"),
        text.alias("text"), "brace",
    )
    cut = F.when(F.col("brace") == 1, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    every = whole.unionByName(crossing.select(*SCAN_ORDER, cut.alias("text")))
    kept = list(SCAN_ORDER) if with_order else []
    return every.select(*kept, _parsed(F.col("text"), schema).alias("_value")).select("_value.*", *kept)
