"""Ranked lexical search: documents grouped by the mask of matched terms, masks in order of their bound.

Terms are runs of ASCII letters and digits and of every character beyond ASCII, A-Z in lower case. N
documents hold a term, L terms in all, n in one document; df documents hold a term, tf times in one.

    weight  w = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    length  m = 100 - 75 + ((75 n N) div L)
    impact    = w * ((1000000000 tf) div (1000 tf + 8 m))

A document's score is the sum of the impacts of an item's terms, repeats included, in 64-bit integers.

Each text is cut into terms once; what is kept of it is its length and the items' terms in it, written
to the shared folder, from which N, L and df are added up. A shard is a slice of that table. In it every
term has a bitset of its documents and its largest impact. For an item, the documents are split by its
terms, the ones that can add most first: a group's bitset, and-ed with a term's and with its complement,
gives two groups whose masks differ in that term. A mask's bound is the sum of the largest impacts of its
terms; of a group whose mask is not yet complete, that of its best mask. The group of the highest bound is
taken next, so complete masks come up by descending bound, and masks that cannot matter are never made.
Documents of a complete mask are scored, and so are those of a group of at most SMALL documents, which more
splits would not make cheaper. A shard is done with an item once no bound reaches the item's k-th best score
so far, which is carried from shard to shard of a task; equal bounds are still looked at, as a smaller id
wins a tie. So the result is exact. Each task hands on k rows an item, and a ranked limit keeps k.

Items are taken in blocks of about BLOCK_TERMS (item, term) pairs, which bounds the vocabulary that a task
holds; another block is another pass. A single item's terms are held whole.

Null and empty texts have no terms and are not counted in N. Rows of documents stand for themselves, also
those with equal ids. Ids that are null come last among equal scores. Benchmark rows that share an item_id
are one item with the terms of its different texts; a null item_id is an id like others. Items without
terms, or with none that occurs, have no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from winnow.llm.common import materialize, parts

K = 10
SMALL = 16
SHARD_DOCS = 4096
SHARD_POSTINGS = 1 << 20
BLOCK_TERMS = 200_000

_TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM_BYTES else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """UTF-8 of every term, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, term, times), times summed over the different texts of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            ids, found, times = [], [], []
            for item, text in zip(batch.column(0), batch.column(1)):
                for term, n in Counter(terms_of(text.as_py())).items():
                    ids.append(item)
                    found.append(term)
                    times.append(n)
            kinds = (batch.schema[0].type, pa.binary(), pa.int64())
            ids = [i.as_py() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, found, times), kinds)], names=["item_id", "term", "times"])

    rows = benchmark.select("item_id", "text").distinct()
    kind = rows.schema[0].dataType.simpleString()
    rows = rows.mapInArrow(run, f"item_id {kind}, term binary, times bigint")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with terms: doc_id, n, and the vocabulary's terms in it with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            n, terms, times, keep = [], [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                keep.append(bool(found))
                if found:
                    counted = Counter(found)
                    known = [(vocabulary[t], c) for t, c in counted.items() if t in vocabulary]
                    n.append(len(found))
                    terms.append([t for t, _ in known])
                    times.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(keep, pa.bool_())),
                    pa.array(n, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n", "terms", "times"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


class Shard:
    """Bitsets and largest impacts of the terms in some documents."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ids = batch.column(0).to_pylist()
        m = 25 + (75 * batch.column(1).to_numpy() * n_docs) // n_terms
        lists = batch.column(2)
        self.offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.term = lists.flatten().to_numpy()
        tf = batch.column(3).flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
        self.impact = weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        order = np.argsort(self.term, kind="stable")
        names, first = np.unique(self.term[order], return_index=True)
        self.top: dict[int, int] = {}
        self.bits: dict[int, int] = {}
        if len(names):
            for term, top, members in zip(
                names.tolist(), np.maximum.reduceat(self.impact[order], first).tolist(), np.split(owner[order], first[1:])
            ):
                if top > 0:
                    held = np.zeros(len(self.ids), np.uint8)
                    held[members] = 1
                    self.top[term] = top
                    self.bits[term] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")

    def _score(self, group: int, times: np.ndarray) -> tuple[list[int], list[int]]:
        raw = np.frombuffer(group.to_bytes(-(-len(self.ids) // 8), "little"), np.uint8)
        docs = np.flatnonzero(np.unpackbits(raw, bitorder="little"))
        sizes = self.offsets[docs + 1] - self.offsets[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.offsets[docs] - ends + sizes, sizes)
        total = np.add.reduceat(times[self.term[at]] * self.impact[at], ends - sizes)
        return docs.tolist(), total.tolist()

    def search(self, item: dict[int, int], times: np.ndarray, best: list[tuple], k: int) -> int:
        """Push into `best`, a heap of the k best so far, least first; the number of documents scored.

        `times` holds the item's repeats of every term of the vocabulary.
        """
        bound = sorted(((n * self.top[t], t) for t, n in item.items() if t in self.top), reverse=True)
        if not bound:
            return 0
        terms = [self.bits[t] for _, t in bound]
        most = [b for b, _ in bound]
        any_of = reduce(int.__or__, terms)
        groups, made, scored = [(-sum(most), 0, 0, any_of)], 0, 0
        while groups:
            low, _, j, group = heapq.heappop(groups)
            if len(best) == k and -low < best[0][0]:
                break
            if j == len(terms) or group.bit_count() <= SMALL:
                docs, totals = self._score(group, times)
                scored += len(docs)
                for doc, total in zip(docs, totals):
                    own = self.ids[doc]
                    entry = (total, own is not None, -own if own is not None else 0)
                    if total > 0 and len(best) < k:
                        heapq.heappush(best, entry)
                    elif total > 0 and entry > best[0]:
                        heapq.heapreplace(best, entry)
                continue
            inside = group & terms[j]
            outside = group ^ inside
            if inside:
                made += 1
                heapq.heappush(groups, (low, made, j + 1, inside))
            if outside and -low > most[j]:
                made += 1
                heapq.heappush(groups, (low + most[j], made, j + 1, outside))
        return scored


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most SHARD_DOCS documents, fewer where they hold many terms."""
    held, rows, terms = [], 0, 0
    for batch in (p for b in batches for p in parts(b)):
        held.append(batch)
        rows += batch.num_rows
        terms += len(batch.column(2).flatten())
        if rows + 256 > SHARD_DOCS or terms >= SHARD_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows, terms = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _block(docs: DataFrame, rows: list, kind: str, k: int) -> DataFrame | None:
    """(item number, doc_id, score): the best k of every task for the items of `rows`."""
    items: dict[object, dict[int, int]] = {}
    vocabulary: dict[bytes, int] = {}
    for r in rows:
        term = vocabulary.setdefault(bytes(r["term"]), len(vocabulary))
        items.setdefault(r["item_id"], {})[term] = r["times"]
    table = materialize(postings(docs, vocabulary), "lexical-postings")
    n_docs, n_terms = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weight = np.zeros(len(vocabulary), np.int64)
    for r in df:
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    asked = list(items.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        times = np.zeros(len(weight), np.int64)
        for batch in _shards(batches):
            shard = Shard(batch, weight, n_docs, n_terms)
            for item, found in zip(asked, best):
                own = list(item)
                times[own] = list(item.values())
                shard.search(item, times, found, k)
                times[own] = 0
        rows = [(i, -own if known else None, score) for i, found in enumerate(best) for score, known, own in found]
        columns = list(zip(*rows)) or [()] * 3
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item", "doc_id", "score"])

    found = table.mapInArrow(run, "item int, doc_id bigint, score bigint")
    names = docs.sparkSession.createDataFrame([(i, key) for i, key in enumerate(items)], f"_item int, item_id {kind}")
    return found.join(names, F.col("item") == F.col("_item")).select("item_id", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, *, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents with a score above 0 of every item."""
    asked = materialize(item_terms(benchmark), "lexical-items")
    blocks = max(1, -(-asked.count() // block_terms))
    kind, found = asked.schema["item_id"].dataType.simpleString(), []
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        part = _block(docs, rows, kind, k) if rows else None
        found += [] if part is None else [part]
    if not found:
        none = asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
        return none.where("false")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
