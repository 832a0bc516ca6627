"""Language identification: a bidirectional gated recurrent network over bytes, written in numpy.

A text's UTF-8 bytes are cut into windows of 64, which run side by side: state starts anew in each
window. In both directions a byte's gates come from a table of 256 rows plus the previous state;
gates and candidate use clipped linear activations, which cost a fraction of tanh. Every position
gets a probability for each language; a document's probabilities are the mean over its positions.
Training is backpropagation through time with Adam over at most `windows_per_text` random windows of
each of at most `per_language` documents of each language, taken in hash order of the id: these two
parameters bound the sample. Prediction reads whole texts.

Null text, empty text and text without a letter are `und` with score 0. A text of any length runs
in blocks of windows, so memory does not grow with it. With nothing to learn from, everything is
`und`. Repeated rows get a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from winnow.llm.common import bounded_ids, hash_bucket, held_out, with_fields

WINDOW = 64
HIDDEN = 8
BLOCK = 1024  # windows that run side by side
PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 6


@dataclass(frozen=True)
class Model:
    languages: list[str]
    params: dict[str, np.ndarray]


def start_params(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """table: what a byte adds to update gate, reset gate and candidate; u: what the state adds."""
    h = HIDDEN

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "table": draw(2, 3, 256, h, scale=0.4),
        "u": draw(2, 3, h, h, scale=0.4 / np.sqrt(h)),
        "out": draw(2, h, classes, scale=0.3),
        "bias": np.zeros(classes, np.float32),
    }


def run_states(params: dict[str, np.ndarray], x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States after each byte: (direction, time, window, hidden). x: bytes as (time, window).

    With a tape, what the backward pass needs is kept; without, buffers are used again.
    """
    steps, n = x.shape
    states = np.empty((2, steps, n, HIDDEN), np.float32)
    shape = (n, HIDDEN)
    z, r, c, back = (np.empty(shape, np.float32) for _ in range(4))
    for d, times in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        table, u = params["table"][d], params["u"][d]
        state = np.zeros(shape, np.float32)
        for t in times:
            if tape is not None:
                z, r, c, back = (np.empty(shape, np.float32) for _ in range(4))
            new = states[d, t]
            for i, gate in ((0, z), (1, r)):
                np.take(table[i], x[t], axis=0, out=gate, mode="clip")
                np.matmul(state, u[i], out=back)
                gate += back
                gate += 0.5
                np.clip(gate, 0, 1, out=gate)
            np.take(table[2], x[t], axis=0, out=c, mode="clip")
            np.matmul(state, u[2], out=back)
            np.multiply(back, r, out=new)
            c += new
            np.clip(c, -1, 1, out=c)
            np.subtract(c, state, out=new)
            new *= z
            new += state
            if tape is not None:
                tape.append((d, t, state, z, r, c, back))
            state = new
    return states


def position_probabilities(params: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    """(languages, time * window)"""
    out = params["out"]
    logits = out[0].T @ states[0].reshape(-1, HIDDEN).T
    logits += out[1].T @ states[1].reshape(-1, HIDDEN).T
    logits += params["bias"][:, None]
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def gradients(
    params: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray
) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the masked-in positions and its gradients, by backpropagation through time."""
    tape: list = []
    states = run_states(params, x, tape)
    steps, n = x.shape
    p = position_probabilities(params, states)
    weight = (mask / mask.sum()).reshape(-1)
    label, place = np.tile(y, steps), np.arange(steps * n)
    loss = float(-(np.log(p[label, place] + 1e-9) * weight).sum())
    delta = p
    delta[label, place] -= 1
    delta *= weight
    grads = {k: np.zeros_like(v) for k, v in params.items()}
    grads["bias"] = delta.sum(1)
    from_out = np.empty_like(states)
    for d in range(2):
        grads["out"][d] = (delta @ states[d].reshape(-1, HIDDEN)).T
        from_out[d] = (params["out"][d] @ delta).T.reshape(steps, n, HIDDEN)
    into = np.zeros((2, 3, steps, n, HIDDEN), np.float32)
    carry = [np.zeros((n, HIDDEN), np.float32) for _ in range(2)]
    for d, t, state, z, r, c, back in reversed(tape):
        u = params["u"][d]
        g = from_out[d, t] + carry[d]
        dc = g * z * ((c > -1) & (c < 1))
        dz = g * (c - state) * ((z > 0) & (z < 1))
        dr = dc * back * ((r > 0) & (r < 1))
        dback = dc * r
        into[d, 0, t], into[d, 1, t], into[d, 2, t] = dz, dr, dc
        carry[d] = g * (1 - z)
        for i, part in ((0, dz), (1, dr), (2, dback)):
            grads["u"][d, i] += state.T @ part
            carry[d] += part @ u[i].T
    flat = x.reshape(-1)
    for d in range(2):
        for i in range(3):
            rows = into[d, i].reshape(-1, HIDDEN)
            for j in range(HIDDEN):
                grads["table"][d, i, :, j] = np.bincount(flat, rows[:, j], minlength=256)
    return loss, grads


def windows_of(raw: bytes) -> np.ndarray:
    """Bytes as (windows, WINDOW), the last one filled up with zeros."""
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


def train(
    texts: list[str],
    langs: list[str],
    *,
    windows_per_text: int = WINDOWS_PER_TEXT,
    epochs: int = 12,
    batch: int = 512,
    rate: float = 0.02,
    seed: int = 0,
) -> Model:
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    xs, ys = [], []
    for text, lang in zip(texts, langs):
        parts = windows_of(text.encode("utf-8", "replace"))
        picked = parts if len(parts) <= windows_per_text else parts[rng.choice(len(parts), windows_per_text, False)]
        xs.append(picked)
        ys += [names.index(lang)] * len(picked)
    params = start_params(max(1, len(names)), rng)
    if not ys:
        return Model(names, params)
    x, y = np.concatenate(xs), np.array(ys)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            step += 1
            own = x[part].T
            _, grads = gradients(params, own, (own != 0).astype(np.float32), y[part])
            pace = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                params[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Model(names, {k: v.astype(np.float32) for k, v in params.items()})


_LETTER = regex.compile(r"\p{L}")


def position_labels(model: Model, text: str) -> list[str]:
    """The language of every byte of a text."""
    raw = text.encode("utf-8", "replace")
    if not raw or not model.languages:
        return []
    x = np.ascontiguousarray(windows_of(raw).T)
    p = position_probabilities(model.params, run_states(model.params, x))
    best = p.argmax(0).reshape(WINDOW, -1).T.reshape(-1)[: len(raw)]
    return [model.languages[i] for i in best]


def pooled(model: Model, texts: list[str | None]) -> np.ndarray:
    """Mean over positions of each text's probabilities; zeros where there is no letter."""
    out = np.zeros((len(texts), max(1, len(model.languages))))
    if not model.languages:
        return out
    pending: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not pending:
            return
        every = np.concatenate(pending)
        owner = np.repeat([o for o, _ in owners], [n for _, n in owners])
        for at in range(0, len(every), BLOCK):
            x = np.ascontiguousarray(every[at : at + BLOCK].T)
            p = position_probabilities(model.params, run_states(model.params, x))
            sums = (p.reshape(len(p), *x.shape) * (x != 0)).sum(1)
            np.add.at(out, owner[at : at + BLOCK], sums.T)
        pending.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        if text is None or not _LETTER.search(text):
            continue
        raw = text.encode("utf-8", "replace")
        parts = windows_of(raw)
        pending.append(parts)
        owners.append((i, len(parts)))
        held += len(parts)
        if held >= BLOCK:
            flush()
    flush()
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    per_language: int = PER_LANGUAGE,
    windows_per_text: int = WINDOWS_PER_TEXT,
) -> Model:
    """Fit on windows of at most `per_language` documents of each language, in one task."""
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(
        hash_bucket(4, F.col(id_col)) != 2
    )
    # One small list: per_language ids for each language name.
    ids = bounded_ids(known, id_col, per_language, ["lang"])
    ids = spark.createDataFrame(ids.collect(), ids.schema)
    sample = known.select(id_col, "lang", "text").join(F.broadcast(ids), [id_col, "lang"], "left_semi")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        every = pd.concat(parts).sort_values([id_col, "text"])
        model = train(every["text"].tolist(), every["lang"].tolist(), windows_per_text=windows_per_text)
        names = sorted(model.params)
        yield pd.DataFrame(
            {
                "languages": [model.languages],
                "values": [[model.params[k].tobytes() for k in names]],
                "shapes": [[list(model.params[k].shape) for k in names]],
                "names": [names],
            }
        )

    kind = "languages array<string>, values array<binary>, shapes array<array<bigint>>, names array<string>"
    found = sample.repartition(1).mapInPandas(learn, kind).collect()
    if not found:  # no row, hence no task
        return train([], [])
    row = found[0]
    params = {
        k: np.frombuffer(v, np.float32).reshape(s) for k, v, s in zip(row["names"], row["values"], row["shapes"])
    }
    return Model(list(row["languages"]), params)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` but the text, with `lang_pred` and `score` added."""
    keep = docs.drop("text", "lang_pred", "score")
    names = [*keep.columns, "lang_pred", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = pooled(model, batch["text"].tolist())
            out = batch.drop(columns=["text"])
            best = p.argmax(1)
            out["score"] = np.minimum(1.0, p[np.arange(len(p)), best])
            out["lang_pred"] = [
                model.languages[i] if s > 0 else "und" for i, s in zip(best, out["score"])
            ]
            yield out[names]

    schema = with_fields(keep.schema, lang_pred="string", score="double")
    return docs.select(*keep.columns, "text").mapInPandas(run, schema)


def langid(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    rows = docs.select("doc_id", held_out(4, 2, F.col("doc_id")), "text")
    return identify(rows, model)
