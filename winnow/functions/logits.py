"""Columns over the logits of one token.

A vocabulary-wide array is reduced by numpy on whole Arrow batches: Spark's own array lambdas are
evaluated element by element outside generated code, about seven times slower on 8,192 logits.
Null logits (masked tokens) give null and carry no data to Python. Not-a-number logits stay so in
the result. A null or ignored label gives null; any other label outside the vocabulary fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from winnow.constants import ENTROPY_EPS, IGNORED_LABEL

# Values widened to double at a time, so that memory does not follow the batch size.
_SLICE_VALUES = 1 << 21


def _slices(logits: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of non-empty rows as (row numbers, flat doubles, row lengths)."""
    offsets = logits.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    usable = lengths > 0
    if logits.null_count:
        usable &= logits.is_valid().to_numpy(zero_copy_only=False)
    flat = logits.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(usable)
    first = 0
    while first < len(rows):
        used = np.cumsum(lengths[rows[first:]])
        end = first + max(1, int(np.searchsorted(used, _SLICE_VALUES, side="right")))
        part = rows[first:end]
        start, stop = offsets[part[0]], offsets[part[-1] + 1]
        values = flat[start:stop].astype(np.float64)
        if stop - start != lengths[part].sum():
            values = np.concatenate([flat[offsets[r]:offsets[r + 1]] for r in part]).astype(float)
        yield part, values, lengths[part]
        first = end


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _softmax(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and the log of the normaliser of every row."""
    starts = _starts(lengths)
    peak = np.maximum.reduceat(values, starts)
    weights = np.exp(values - np.repeat(peak, lengths))
    total = np.add.reduceat(weights, starts)
    return weights / np.repeat(total, lengths), peak + np.log(total)


def _reduce(
    logits: pa.Array, row: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
) -> pa.Array:
    out = np.full(len(logits), np.nan)
    done = np.zeros(len(logits), dtype=bool)
    for rows, values, lengths in _slices(logits):
        out[rows] = row(rows, values, lengths)
        done[rows] = True
    # from_pandas is off: a NaN must not turn into a null, which an average would leave out.
    return pa.array(out, mask=~done, type=pa.float64(), from_pandas=False)


def _labels(labels: pa.Array) -> np.ndarray:
    return labels.cast(pa.int64()).fill_null(IGNORED_LABEL).to_numpy(zero_copy_only=False)


def _labelled(logits: pa.Array, labels: np.ndarray) -> pa.Array:
    """The logits of rows that have a label, null elsewhere."""
    return pc.if_else(pa.array(labels != IGNORED_LABEL), logits, pa.scalar(None, logits.type))


def _pick(values: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The value at each row's label."""
    outside = (labels < 0) | (labels >= lengths)
    if outside.any():
        row = int(np.flatnonzero(outside)[0])
        raise ValueError(f"label {labels[row]} is outside a vocabulary of {lengths[row]}")
    return values[_starts(lengths) + labels]


def token_entropy(logits: Column) -> Column:
    """Entropy of the softmax, with the small constant inside the logarithm."""

    @F.arrow_udf("double")
    def entropy(batch: pa.Array) -> pa.Array:
        def row(_, values, lengths):
            p, _norm = _softmax(values, lengths)
            return -np.add.reduceat(p * np.log(p + ENTROPY_EPS), _starts(lengths))

        return _reduce(batch, row)

    return entropy(logits)


def token_cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log probability of the label; labels count from zero."""

    @F.arrow_udf("double")
    def cross_entropy(batch: pa.Array, labels: pa.Array) -> pa.Array:
        wanted = _labels(labels)

        def row(rows, values, lengths):
            _, norm = _softmax(values, lengths)
            return norm - _pick(values, lengths, wanted[rows])

        return _reduce(_labelled(batch, wanted), row)

    return cross_entropy(logits, label)


def margin(logits: Column, label: Column) -> Column:
    """Target logit minus the mean of the other logits."""

    @F.arrow_udf("double")
    def target_margin(batch: pa.Array, labels: pa.Array) -> pa.Array:
        wanted = _labels(labels)

        def row(rows, values, lengths):
            target = _pick(values, lengths, wanted[rows])
            rest = np.add.reduceat(values, _starts(lengths)) - target
            return target - rest / np.maximum(lengths - 1, 1)

        return _reduce(_labelled(batch, wanted), row)

    return target_margin(logits, label)


def mix(parts: list[Column], lam: float = 0.5) -> Column:
    """(1 - lam) * first + lam * second for two models, the mean for any other number.

    Null where a model has no logits or the vocabularies differ in size.
    """
    shares = [1.0 - lam, lam] if len(parts) == 2 else [1.0 / len(parts)] * len(parts)

    @F.arrow_udf("array<double>")
    def mixed(*batches: pa.Array) -> pa.Array:
        lengths = [np.diff(b.offsets.to_numpy().astype(np.int64)) for b in batches]
        usable = np.ones(len(batches[0]), dtype=bool)
        for batch, length in zip(batches, lengths):
            usable &= batch.is_valid().to_numpy(zero_copy_only=False) & (length == lengths[0])
        keep = pa.array(usable)
        total = None
        for batch, share in zip(batches, shares):
            flat = batch.filter(keep).flatten().to_numpy(zero_copy_only=False)
            scaled = flat.astype(np.float64) * share
            total = scaled if total is None else total + scaled
        sizes = np.where(usable, lengths[0], 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(total), mask=pa.array(~usable)
        )

    return mixed(*parts)
