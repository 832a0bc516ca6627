"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its character n-grams (three to five characters, lower case, padded with a
blank at both ends), hashed to 2**18 buckets. A bucket's value is the log of its smoothed share among
toxic training texts over its share among the others; logistic regression is trained on the
presence of buckets times these values (Wang and Manning, 2012).

The classifier is fitted on at most `max_rows` labelled rows, taken in hash order of the id; the
ids are written, then broadcast, so the corpus is scanned without a shuffle. Scoring is a
map over whole texts, a few hundred rows of an Arrow batch at a time.

Null and empty texts have only the padding and get the score of the intercept. A text of any length
is scored in memory linear in its length. With no labelled row, or labels of one kind, the score is
the smoothed share of toxic labels for every text. Repeated rows get a row each. Labels that are
null, or both 0 and 1 for one id, count as no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from winnow.llm.common import bounded_ids, hash_bucket, held_out, materialize, parts, with_fields

BITS = 18
SIZES = (3, 4, 5)
MAX_ROWS = 8_000
PIECE = 1 << 16


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each bucket: regression weight times log-count ratio
    intercept: float


class Featuriser:
    """Distinct buckets of a text; the scratch array makes a text's duplicates cheap to drop.

    A text is read `PIECE` characters at a time, so only the text itself grows with its length.
    """

    def __init__(self) -> None:
        self.scratch = np.zeros(1 << BITS, np.int32)

    def _piece(self, codes: np.ndarray) -> np.ndarray:
        rolled, found = codes, []
        for size in range(2, SIZES[-1] + 1):
            if len(codes) < size:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) + codes[size - 1 :]
            if size in SIZES:
                mixed = (rolled ^ np.uint32(size * 0x1C6EF37)) * np.uint32(0x9E3779B1)
                found.append(mixed >> np.uint32(32 - BITS))
        if not found:
            return np.zeros(0, np.uint32)
        every = np.concatenate(found)
        places = np.arange(len(every), dtype=np.int32)
        self.scratch[every] = places
        return every[self.scratch[every] == places]

    def __call__(self, text: str | None) -> np.ndarray:
        padded = f" {(text or '').lower()} "
        overlap = SIZES[-1] - 1
        pieces = (
            self._piece(np.frombuffer(padded[at : at + PIECE + overlap].encode("utf-32-le", "surrogatepass"), np.uint32))
            for at in range(0, max(1, len(padded) - overlap), PIECE)
        )
        first = next(pieces)
        if len(padded) - overlap <= PIECE:
            return first
        seen = np.zeros(1 << BITS, bool)
        seen[first] = True
        for piece in pieces:
            seen[piece] = True
        return np.flatnonzero(seen).astype(np.uint32)


class Packed:
    """Buckets of many texts, two bytes each: a row is sorted, and `cuts` tell where the bits above change."""

    def __init__(self) -> None:
        self.low: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []

    def add(self, texts: list[str | None], features: Featuriser) -> None:
        steps = np.arange(0, (1 << BITS) + 1, 1 << 16)
        # Packed a few hundred texts at a time: many small arrays would stay in the worker's heap.
        for at in range(0, len(texts), 256):
            rows = [np.sort(features(t)) for t in texts[at : at + 256]]
            self.cuts += [np.diff(np.searchsorted(r, steps)) for r in rows]
            low = np.concatenate(rows).astype(np.uint16)
            self.low += np.split(low, np.cumsum([len(r) for r in rows])[:-1])

    def __len__(self) -> int:
        return len(self.low)

    def row(self, i: int) -> np.ndarray:
        return self.low[i] + np.repeat(np.arange(len(self.cuts[i]), dtype=np.int32) << 16, self.cuts[i])


def train(
    rows: Packed, labels: np.ndarray, *, epochs: int = 12, rate: float = 0.05, l2: float = 1e-5, seed: int = 0
) -> Model:
    """Log-count ratios, then logistic regression by Adam on mini-batches."""
    n = len(rows)
    share = (labels.sum() + 1.0) / (n + 2.0)
    flat = Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    if n == 0 or labels.min() == labels.max():
        return flat
    counts = np.ones((2, 1 << BITS))
    for i, label in enumerate(labels):
        counts[label][rows.row(i)] += 1
    shares = counts / (np.bincount(labels, minlength=2) + 2.0)[:, None]
    ratio = np.log(shares[1] / shares[0])
    w, m, v = (np.zeros(1 << BITS) for _ in range(3))
    b, bm, bv, step = flat.intercept, 0.0, 0.0, 0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(n), max(1, n // 128)):
            step += 1
            columns = np.concatenate([rows.row(i) for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows.low[i]) for i in part])
            value = ratio[columns]
            z = b + np.bincount(owner, w[columns] * value, minlength=len(part))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            grad = np.bincount(columns, error[owner] * value, minlength=1 << BITS) + l2 * w
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            bm += 0.1 * (error.sum() - bm)
            bv += 0.001 * (error.sum() ** 2 - bv)
            fix, scale = 1 - 0.9**step, 1 - 0.999**step
            w -= rate * (m / fix) / (np.sqrt(v / scale) + 1e-8)
            b -= rate * (bm / fix) / (np.sqrt(bv / scale) + 1e-8)
    return Model((w * ratio).astype(np.float32), float(b))


def score_texts(model: Model, texts: list[str | None], features: Featuriser | None = None) -> np.ndarray:
    features = features or Featuriser()
    z = np.array([float(model.weights[features(t)].sum(dtype=np.float64)) for t in texts])
    return 1 / (1 + np.exp(-np.clip(z + model.intercept, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most `max_rows` ids whose crc32 modulo 5 is not 0, in one task.

    Of texts that share an id the smallest counts, found by a partial aggregate.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & (hash_bucket(5, F.col(id_col)) != 0))
        .groupBy(id_col)
        .agg(F.min("toxic").alias("_low"), F.max("toxic").alias("_toxic"))
        .where("_low = _toxic")
        .select(id_col, "_toxic")
    )
    # Bounded by max_rows ids. A label without a document takes a place, which is harmless. Rows collected and
    # handed back as a list would be read by Python workers of their own, beside those of the maps.
    ids = materialize(bounded_ids(known, id_col, max_rows), "toxicity-ids")
    sample = docs.select(id_col, "text").join(
        F.broadcast(known.join(F.broadcast(ids), id_col, "left_semi")), id_col
    )
    rows = sample.groupBy(id_col).agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("_toxic").cast("int").alias("_toxic")
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, packed, marks = Featuriser(), Packed(), []
        for batch in batches:
            for part in parts(batch):
                packed.add(part["text"].to_pylist(), features)
                marks += part["_toxic"].to_pylist()
        if marks:
            model = train(packed, np.array(marks, np.int64))
            yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "intercept": [model.intercept]})

    one = rows.repartition(1).sortWithinPartitions(id_col)
    found = one.mapInArrow(learn, "weights binary, intercept double").collect()
    if not found:  # no row, hence no task
        return train(Packed(), np.zeros(0, np.int64))
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["intercept"])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id") -> DataFrame:
    """All columns of `docs` but the text, with `score` and `predicted` added."""
    keep = docs.drop("text", "score", "predicted")
    held = docs.select(*keep.columns, "text")
    width = len(keep.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featuriser()
        for batch in batches:
            for part in parts(batch):
                scores = score_texts(model, part.column(width).to_pylist(), features)
                columns = [*part.columns[:width], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:width], "score", "predicted"])

    schema = with_fields(keep.schema, score="double", predicted="int")
    return held.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not rejected, with the columns of `docs`; the text passes through."""
    model = fit(docs, labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featuriser()
        for batch in batches:
            for part in parts(batch):
                scores = score_texts(model, part.column(place).to_pylist(), features)
                yield part.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    rows = docs.select("doc_id", held_out(5, 0, F.col("doc_id")), "text")
    return score(rows, model)
