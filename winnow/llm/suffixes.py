"""Removal of byte passages that an earlier document already holds, by sparse suffix sorting.

Every string of `length` (50) bytes holds exactly one anchor: of the 31 strings of 20 bytes inside it,
the first with the smallest hash. Equal strings hold equal anchors at equal places, so strings need
comparing only where their anchors are equal.

1. Exact copies of a text (by SHA-256) of a smaller id are settled at once and take no further part.
2. Anchors: each task packs the 48-bit hashes of its documents' anchors by bucket; a bucket finds
   those that occur in two documents or more and reports them back to the documents.
3. Suffixes: for each such anchor, the suffix that starts there and the bytes before it that its
   strings need. A task sorts its suffixes of a bucket and sends them as one front-coded run: length
   of the prefix shared with the suffix before, and the rest. A bucket merges its runs with a loser
   tree that keeps the prefix known to be shared with the last suffix put out, so known prefixes are
   not compared again; equal suffixes meet, and anchors of one document fall away. Then the strings
   around the anchors that are left are matched and the smallest id that holds each is found.
   Anchors with more than `HOT` occurrences go another way, so that no bucket holds all of them: the
   documents' groups hash the strings around them and reduce them to the smallest id of each string;
   buckets of string hashes take the minimum of those and send it back to the groups that have a
   larger one, which then hash the strings again and compare.
4. Strings whose smallest id is below their document's mark its bytes.

Texts are dealt to as many groups as there are shuffle partitions, once; steps 3 and 4 read the same
exchange. Packed rows bound the number of shuffled rows; an anchor that very many documents share
costs the bucket of step 2 a few dozen bytes for each, and a hot string the bucket of its hash 16
bytes for each group of documents.

Null and empty texts have no bytes: nothing is removed. Texts below 50 bytes lose nothing. Repeated
rows (equal ids) do not count as earlier documents of each other. Rows with a null id are left as
they are and are no source for others. Long texts are read in chunks of 4 MiB that overlap. Matches
never cross documents. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import buckets, materialize
from winnow.llm.shingles import Powers, mix

LENGTH = 50
GRAM = 20
CHUNK = 1 << 22
PACK = 1 << 18  # anchors held before they are sent
STRINGS = 1 << 19  # strings matched at a time, besides those of one anchor, which are fewer
HOT = 1 << 14  # occurrences of an anchor from which its strings are dealt by their own hashes
GROUPS = 2  # per shuffle partition
_MASK = np.uint64((1 << 48) - 1)
_PRIME = 1_000_003
_POWERS = Powers()


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every `size` bytes in a row."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    _POWERS.need(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _POWERS.down[: n - size + 1])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: 48-bit hash, place, first and last start of the strings it stands for."""
    parts = []
    for at in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
        data = np.frombuffer(raw, np.uint8, min(len(raw) - at, CHUNK + LENGTH - 1), at) if len(raw) > at else None
        if data is None or len(data) < LENGTH:
            continue
        full = gram_hashes(data, GRAM)
        key = (full & ~np.uint64((1 << 24) - 1)) | np.arange(len(full), dtype=np.uint64)
        low = key
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        rest = LENGTH - GRAM + 1 - 16
        low = np.minimum(low[:-rest], low[rest:])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        spot = place[first]
        parts.append((mix(full[spot] + np.uint64(0x5851F42D)) & _MASK, spot + at, first + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(p) for p in zip(*parts))


def _pack48(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    low, high = np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint16, n, 4 * n)
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _texts(table) -> Iterator[tuple[int | None, int, bytes, bool]]:
    columns = [table[c] for c in ("id", "th", "text", "copy")]
    for i in range(table.num_rows):
        ident, th, text, copy = (c[i].as_py() for c in columns)
        yield ident, th, (text or "").encode("utf-8", "surrogatepass"), copy


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


ANCHOR_ROWS = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("times", pa.binary())])
SHARED_ROWS = pa.schema([("dealt", pa.int64()), ("ids", pa.binary()), ("hashes", pa.binary()), ("hot", pa.binary())])
RUN_ROWS = pa.schema(
    [("bucket", pa.int64()), ("prefix", pa.binary()), ("sizes", pa.binary()), ("tails", pa.binary()), ("of", pa.binary()), ("before", pa.binary()), ("befores", pa.binary()), ("ids", pa.binary()), ("ths", pa.binary()), ("starts", pa.binary()), ("names", pa.binary()), ("anchors", pa.binary()), ("origin", pa.int64())]
)
SPAN_ROWS = pa.schema([("dealt", pa.int64()), ("ids", pa.binary()), ("ths", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary()), ("names", pa.binary()), ("anchors", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if pa.types.is_int64(f.type) else 'binary'}" for f in schema)


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def anchor_rows(n: int):
    """Packed anchors of a task's documents: per bucket, ids, number of anchors of each, hashes."""

    def pack(ids: list, hashes: list, times: list) -> pa.Table:
        often = np.concatenate(times)
        every, owner = np.concatenate(hashes), np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
        own, out = np.array(ids, np.int64), []
        for b, rows in _by_bucket((every % np.uint64(n)).astype(np.int64), n):
            who, counts = np.unique(owner[rows], return_counts=True)
            out.append((b, own[who].tobytes(), counts.astype(np.uint32).tobytes(), _pack48(every[rows]), often[rows].tobytes()))
        return _rows(ANCHOR_ROWS, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, times, held = [], [], [], 0
        for batch in batches:
            for ident, _, raw, copy in _texts(batch):
                if ident is None or copy or len(raw) < LENGTH:
                    continue
                found, often = np.unique(anchors(raw)[0], return_counts=True)
                ids.append(ident)
                hashes.append(found)
                times.append(np.minimum(often, 65535).astype(np.uint16))
                held += len(found)
                if held >= PACK:
                    yield from pack(ids, hashes, times).to_batches()
                    ids, hashes, times, held = [], [], [], 0
        if ids:
            yield from pack(ids, hashes, times).to_batches()

    return run


def dealt_to(ids: np.ndarray, n: int) -> np.ndarray:
    """The group of an id; `dealt_column` gives the same."""
    return ids % _PRIME * 7919 % _PRIME % n


def dealt_column(n: int) -> Column:
    return F.expr(f"pmod(coalesce(id, 0L), {_PRIME}L) * 7919L % {_PRIME}L % {n}L")


def shared_rows(n: int, hot: int = HOT):
    """Of a bucket's anchors, those of two documents or more, packed for the documents' groups, and
    whether they occur more than `hot` times."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        owners, hashes, times = [], [], []
        for ids, counts, packed, often in zip(*(table[c].to_pylist() for c in ("ids", "counts", "hashes", "times"))):
            times.append(np.frombuffer(often, np.uint16))
            owners.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32)))
            hashes.append(_unpack48(packed))
        owner, every = np.concatenate(owners), np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        owner, every = owner[order], every[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(every)) + 1))
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        size = np.diff(np.concatenate((first, [len(every)])))
        many = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), first) > hot
        keep = np.repeat(several, size)
        many = np.repeat(many, size)[keep]
        owner, every = owner[keep], every[keep]
        out = []
        for d, rows in _by_bucket(dealt_to(owner, n), n) if len(owner) else ():
            out.append((d, owner[rows].tobytes(), _pack48(every[rows]), many[rows].tobytes()))
        return _rows(SHARED_ROWS, out)

    return run


def front_coded(suffixes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Sort suffixes (rows filled up with zeros). Returns order, number of the distinct suffix of each
    row in that order, and for the distinct ones: shared prefix with the one before, size, rest."""
    order = np.lexsort((sizes, np.ascontiguousarray(suffixes).view(f"S{suffixes.shape[1]}").reshape(-1)))
    rows, size = suffixes[order], sizes[order]
    same = rows[1:] == rows[:-1]
    prefix = np.where(same.all(1), rows.shape[1], same.argmin(1)) if len(rows) > 1 else np.zeros(0, np.int64)
    prefix = np.concatenate(([0], np.minimum(prefix, np.minimum(size[1:], size[:-1])))).astype(np.int64)
    new = np.concatenate(([True], (prefix[1:] < size[1:]) | (size[1:] != size[:-1])))
    number = np.cumsum(new) - 1
    rows, size, prefix = rows[new], size[new], prefix[new]
    place = np.arange(rows.shape[1])
    tails = rows[(place >= prefix[:, None]) & (place < size[:, None])].tobytes()
    return order, number, prefix, size, tails


def by_owner(owner: np.ndarray, every: np.ndarray, into: dict[int, list[np.ndarray]]) -> None:
    order = np.argsort(owner, kind="stable")
    owner, every = owner[order], every[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    for ident, part in zip(owner[first], np.split(every, first[1:])) if len(owner) else ():
        into.setdefault(int(ident), []).append(part)


def hot_strings(raw: bytes, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and starts of the strings around the anchors `hot` of a text, some anchors at a time."""
    every, _, first, last = anchors(raw)
    keep = np.isin(every, hot)
    first, last = first[keep], last[keep]
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(first), HOT):
        lo, count = first[at : at + HOT], last[at : at + HOT] - first[at : at + HOT] + 1
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        shift = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        around = np.concatenate([data[a : a + c + LENGTH - 1] for a, c in zip(lo.tolist(), count.tolist())])
        yield gram_hashes(around, LENGTH)[np.repeat(shift, count) + offset], np.repeat(lo, count) + offset


class Least:
    """Smallest id of each string hash, in sorted order; what comes is summed up in blocks."""

    def __init__(self) -> None:
        self.names, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, names: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((names, ids))
        self.held += len(names)
        if self.held >= max(STRINGS, len(self.names)):
            self.settle()

    def settle(self) -> None:
        names, ids = (np.concatenate(x) for x in zip((self.names, self.ids), *self.waiting))
        order = np.argsort(names, kind="stable")
        names, ids = names[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else order
        self.names, self.ids = names[first], np.minimum.reduceat(ids, first) if len(names) else ids
        self.waiting, self.held = [], 0


def run_rows(n: int):
    """Front-coded sorted runs of the suffixes at shared anchors of a group of documents, per bucket.

    From bucket n on: the strings around hot anchors with their smallest ids, and, for `origin` itself,
    the hot anchors of its documents.
    """

    def coded(parts: list[tuple]) -> list[tuple]:
        every, suffix, size, before, left, first, ids, ths = (np.concatenate(p) for p in zip(*parts))
        out = []
        for b, rows in _by_bucket((every % np.uint64(n)).astype(np.int64), n):
            order, number, prefix, sizes, tails = front_coded(suffix[rows], size[rows])
            rows = rows[order]
            short = np.arange(-(LENGTH - GRAM), 0) >= -before[rows][:, None]
            out.append(
                (
                    b,
                    prefix.astype(np.uint8).tobytes(),
                    sizes.astype(np.uint8).tobytes(),
                    tails,
                    number.astype(np.uint32).tobytes(),
                    before[rows].astype(np.uint8).tobytes(),
                    left[rows][short].tobytes(),
                    ids[rows].astype(np.int64).tobytes(),
                    ths[rows].astype(np.int64).tobytes(),
                    first[rows].astype(np.int64).tobytes(),
                    b"",
                    b"",
                    0,
                )
            )
        return out

    def run(key: tuple, texts: pa.Table, shared: pa.Table) -> pa.Table:
        want: dict[int, list[np.ndarray]] = {}
        hot: dict[int, list[np.ndarray]] = {}
        least = Least()
        for ids, packed, flags in zip(*(shared[c].to_pylist() for c in ("ids", "hashes", "hot"))):
            owner, every, many = np.frombuffer(ids, np.int64), _unpack48(packed), np.frombuffer(flags, bool)
            by_owner(owner[~many], every[~many], want)
            by_owner(owner[many], every[many], hot)
        parts, held, out = [], 0, []
        for ident, th, raw, copy in _texts(texts) if want or hot else ():
            if ident is None or copy:
                continue
            for names, _ in hot_strings(raw, np.concatenate(hot[ident])) if ident in hot else ():
                least.add(names, np.full(len(names), ident, np.int64))
            if ident not in want:
                continue
            every, spot, first, last = anchors(raw)
            keep = np.isin(every, np.concatenate(want[ident]))
            every, spot, first, last = every[keep], spot[keep], first[keep], last[keep]
            if not len(every):
                continue
            data = np.concatenate((np.zeros(LENGTH, np.uint8), np.frombuffer(raw, np.uint8), np.zeros(LENGTH, np.uint8)))
            around = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
            size = last + LENGTH - spot
            suffix = around[spot + LENGTH]
            suffix[np.arange(LENGTH) >= size[:, None]] = 0
            left = around[spot][:, -(LENGTH - GRAM) :]
            parts.append((every, suffix, size, spot - first, left, first, np.full(len(every), ident), np.full(len(every), th)))
            held += len(every)
            if held >= PACK:
                out += coded(parts)
                parts, held = [], 0
        if parts:
            out += coded(parts)
        least.settle()
        own, none = key[0].as_py(), (b"",) * 6
        for b, part in _by_bucket((least.names % np.uint64(n)).astype(np.int64), n):
            out.append((n + b, *none, least.ids[part].tobytes(), b"", b"", least.names[part].tobytes(), b"", own))
        if hot:
            owner = np.repeat(np.fromiter(hot, np.int64), [sum(map(len, p)) for p in hot.values()])
            every = _pack48(np.concatenate([x for p in hot.values() for x in p]))
            out.append((n + own, *none, owner.tobytes(), b"", b"", b"", every, own))
        return _rows(RUN_ROWS, out)

    return run


def decoded(prefix: bytes, sizes: bytes, tails: bytes) -> Iterator[tuple[int, bytes]]:
    """(shared prefix with the one before, suffix) of a front-coded run."""
    word, at = b"", 0
    for shared, size in zip(prefix, sizes):
        end = at + size - shared
        word = word[:shared] + tails[at:end]
        at = end
        yield shared, word


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merge sorted runs: (prefix shared with the suffix put out before, suffix, run).

    A loser tree. Every suffix in it carries the length of the prefix it shares with the last winner.
    Of two suffixes the one that shares more is the smaller, without looking at a byte; only where
    both share the same length are bytes compared, from there on, which also yields the loser's
    shared prefix with the winner.
    """
    k = len(runs)
    shared = [0] * k
    words: list[bytes | None] = [None] * k
    for i, run in enumerate(runs):
        first = next(run, None)
        if first is not None:
            words[i] = first[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's shared length becomes that with the winner."""
        x, y = words[a], words[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        at, end = shared[a], min(len(x), len(y))
        if x[at:end] == y[at:end]:
            at = end
        else:
            step = 16
            while x[at : at + step] == y[at : at + step]:
                at += step
            while x[at] == y[at]:
                at += 1
        less = x[at:] < y[at:] or (x[at:] == y[at:] and a < b)
        winner, loser = (a, b) if less else (b, a)
        shared[loser] = at
        return winner, loser

    losers = [-1] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    best = build(1) if k > 1 else 0
    known = 0
    while words[best] is not None:
        yield known, words[best], best
        following = next(runs[best], None)
        if following is None:
            words[best], shared[best] = None, 0
        else:
            shared[best], words[best] = following
        node, winner = (best + k) >> 1, best
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1
        best, known = winner, shared[winner]


def matched(
    rows: np.ndarray, sizes: np.ndarray, base: np.ndarray, every: np.ndarray, ids: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings around some anchors' occurrences, those a smaller id holds too, as spans:
    occurrence, start, end. Starts in a row of one occurrence become one span."""
    count = sizes[rows] - LENGTH + 1
    owner = np.repeat(rows, count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    lead = np.concatenate([every[base[i] : base[i] + sizes[i]] for i in rows])
    shift = np.cumsum(sizes[rows]) - sizes[rows]
    names = gram_hashes(lead, LENGTH)[np.repeat(shift, count) + offset]
    order = np.argsort(names, kind="stable")
    first = np.concatenate(([0], np.flatnonzero(np.diff(names[order])) + 1))
    smallest = np.minimum.reduceat(ids[owner][order], first)
    least = np.empty(len(names), np.int64)
    least[order] = np.repeat(smallest, np.diff(np.concatenate((first, [len(order)]))))
    hit = least < ids[owner]
    owner, place = owner[hit], (starts[owner] + offset)[hit]
    if not len(owner):
        return owner, place, place
    new = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(place) != 1)))
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:] - 1, [len(owner) - 1]))
    return owner[begin], place[begin], place[end] + LENGTH


def least_rows(rows: list[dict]) -> pa.Table:
    """Per group of documents: its strings of which another group has a smaller id, with that id; and
    its own hot anchors as they came."""
    out = [(r["origin"], r["ids"], b"", b"", b"", b"", r["anchors"]) for r in rows if r["anchors"]]
    least = Least()
    for r in rows:
        least.add(np.frombuffer(r["names"], np.uint64), np.frombuffer(r["ids"], np.int64)[: len(r["names"]) // 8])
    least.settle()
    for r in rows:
        names = np.frombuffer(r["names"], np.uint64)
        if len(names):
            found = least.ids[np.searchsorted(least.names, names)]
            lower = found < np.frombuffer(r["ids"], np.int64)
            if lower.any():
                out.append((r["origin"], found[lower].tobytes(), b"", b"", b"", names[lower].tobytes(), b""))
    return _rows(SPAN_ROWS, out)


def span_rows(n: int):
    """Merge a bucket's runs, match strings around anchors, and report bytes to remove per group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if key[0].as_py() >= n:
            return least_rows(rows)
        group = -1
        groups = [np.zeros(len(r["sizes"]), np.int64) for r in rows]
        at = [0] * len(rows)
        for shared, _, which in merged([decoded(r["prefix"], r["sizes"], r["tails"]) for r in rows]):
            if shared < GRAM:
                group += 1
            groups[which][at[which]] = group
            at[which] += 1
        own, ids, ths, starts, data, sizes = [], [], [], [], [], []
        for r, g in zip(rows, groups):
            of = np.frombuffer(r["of"], np.uint32)
            own.append(g[of])
            ids.append(np.frombuffer(r["ids"], np.int64))
            ths.append(np.frombuffer(r["ths"], np.int64))
            starts.append(np.frombuffer(r["starts"], np.int64))
            words = [w for _, w in decoded(r["prefix"], r["sizes"], r["tails"])]
            ends = np.concatenate(([0], np.cumsum(np.frombuffer(r["before"], np.uint8).astype(np.int64))))
            lefts = r["befores"]
            strings = [lefts[a:b] + words[i] for a, b, i in zip(ends[:-1].tolist(), ends[1:].tolist(), of.tolist())]
            data.append(b"".join(strings))
            sizes.append(np.fromiter(map(len, strings), np.int64, len(strings)))
        own, ids, ths, starts, sizes = (np.concatenate(x) for x in (own, ids, ths, starts, sizes))
        every = np.frombuffer(b"".join(data), np.uint8)
        low, high = np.full(group + 1, np.iinfo(np.int64).max), np.full(group + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, own, ids)
        np.maximum.at(high, own, ids)
        base = np.cumsum(sizes) - sizes
        # Anchors that only equal hashes, not equal bytes, brought together end here.
        several = np.flatnonzero((low < high)[own])
        several = several[np.argsort(own[several], kind="stable")]
        total = np.cumsum(sizes[several] - LENGTH + 1)
        owners, los, his = [], [], []
        at = 0
        while at < len(several):
            # As many whole anchors as fit; equal strings have equal anchors.
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STRINGS)))
            end = int(np.searchsorted(own[several], own[several[end - 1]], "right"))
            found = matched(several[at:end], sizes, base, every, ids, starts)
            for kept, part in zip((owners, los, his), found):
                kept.append(part)
            at = end
        if not owners:
            return _rows(SPAN_ROWS, [])
        owner, lo, hi = np.concatenate(owners), np.concatenate(los), np.concatenate(his)
        out = []
        for d, part in _by_bucket(dealt_to(ids[owner], n), n):
            w = owner[part]
            out.append((d, ids[w].tobytes(), ths[w].tobytes(), lo[part].tobytes(), hi[part].tobytes(), b"", b""))
        return _rows(SPAN_ROWS, out)

    return run


RESULT = pa.schema(
    [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
)


def result_rows(with_text: bool):
    def run(key: tuple, texts: pa.Table, spans: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        hot: dict[int, list[np.ndarray]] = {}
        least = Least()
        for row in spans.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            if row["anchors"]:
                by_owner(ids, _unpack48(row["anchors"]), hot)
                continue
            if row["names"]:
                least.add(np.frombuffer(row["names"], np.uint64), ids)
                continue
            columns = (np.frombuffer(row[c], np.int64).tolist() for c in ("ids", "ths", "starts", "ends"))
            for ident, th, lo, hi in zip(*columns):
                found.setdefault((ident, th), []).append((lo, hi))
        for ident, _, raw, copy in _texts(texts) if hot else ():
            for names, _ in hot_strings(raw, np.concatenate(hot[ident])) if ident in hot and not copy else ():
                least.add(names, np.full(len(names), ident, np.int64))
        least.settle()
        out = []
        for ident, th, raw, copy in _texts(texts):
            for names, places in hot_strings(raw, np.concatenate(hot[ident])) if ident in hot and not copy else ():
                place = np.sort(places[least.ids[np.searchsorted(least.names, names)] < ident])
                edge = np.flatnonzero(np.concatenate(([True], np.diff(place) != 1)))
                spans_of = zip(place[edge].tolist(), place[np.concatenate((edge[1:] - 1, [-1]))].tolist()) if len(place) else ()
                found.setdefault((ident, th), []).extend((a, b + LENGTH) for a, b in spans_of)
            cuts = [(0, len(raw))] if copy and len(raw) >= LENGTH else sorted(found.get((ident, th), ()))
            kept, removed, count, at = [], 0, 0, 0
            reach = -1
            for lo, hi in cuts:
                if lo > reach:
                    count += 1
                    kept.append(raw[at:lo])
                    removed += hi - lo
                    at = reach = hi
                elif hi > reach:
                    removed += hi - reach
                    at = reach = hi
            left = b"".join([*kept, raw[at:]])
            text = left.decode("utf-8", "ignore") if with_text else None
            out.append((ident, len(raw), removed, count, hashlib.sha256(left).hexdigest(), text))
        return _rows(RESULT, out)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and the text that is left if asked for.

    Results do not depend on `hot`, the occurrences of an anchor from which its strings are dealt.

    The text leaves out bytes of a sign that was cut apart; the hash is over all bytes that stay.
    """
    n = GROUPS * buckets(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), "text").withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)))
    narrow = materialize(
        rows.where("id is not null and text is not null").select("id", "th", F.sha2("text", 256).alias("sha")), "suffix-texts"
    )
    first = narrow.groupBy(F.col("sha").alias("_sha")).agg(F.min("id").alias("_first"))
    copies = narrow.join(first, (F.col("sha") == F.col("_sha")) & (F.col("id") > F.col("_first")))
    copies = materialize(
        copies.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.lit(True).alias("copy")).distinct(), "suffix-copies"
    )
    texts = rows.join(copies, F.expr("id = _id and th = _th"), "left").select(
        "id", "th", "text", F.coalesce("copy", F.lit(False)).alias("copy")
    )
    packed = texts.mapInArrow(anchor_rows(n), ddl(ANCHOR_ROWS))
    shared = packed.groupBy("bucket").applyInArrow(shared_rows(n, hot), ddl(SHARED_ROWS))
    dealt = texts.withColumn("dealt", dealt_column(n)).repartition(n, "dealt")
    runs = (
        dealt.groupBy("dealt")
        .cogroup(shared.repartition(n, "dealt").groupBy("dealt"))
        .applyInArrow(run_rows(n), ddl(RUN_ROWS))
    )
    spans = runs.groupBy("bucket").applyInArrow(span_rows(n), ddl(SPAN_ROWS))
    result = (
        dealt.groupBy("dealt")
        .cogroup(spans.repartition(n, "dealt").groupBy("dealt"))
        .applyInArrow(
            result_rows(with_text),
            "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string",
        )
    )
    return result.withColumnRenamed("id", id_col)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept_text")
