"""Prefix trie of conversations: vertical bitmaps per shard, merged by prefix.

Rows of a conversation are ordered by turn, null first; equal turns by a hash of role and text. A null
role or text counts as empty. Every conversation c is rebuilt: the first h turns of conversation
c - c % 20 (all if it has fewer, none if it is absent), then c's own turns after its first h, where h
is crc32 of c in decimal, modulo 4. Each distinct sequence of first turns is a node.

A shard holds whole conversations, a range of ids. In it, every (position, turn) that several
conversations share has a bitset of them. Depth first from the root, the posting of the first member's
next turn, intersected with the parent's bitset, is a child; its population count is its number of
members, and the members that end there are its end list. A path of one member is walked as it is.

A prefix is named across shards by two 64-bit sums of hashes of (position, turn), with its depth.
Shards' nodes are added up by that name. The shard with the smallest member owns a node and carries
its part of the sums over subtrees: all ancestors of a node occur in the shard that owns it, so each
shard sums over its own trie, and the shards' sums are added up. No step depends on the depth of the
trie, and a prefix that very many conversations share has one row per shard. End lists are hashed in
order of ids as a stream of the shards' pieces, so no list is held whole.

Only hashes and word counts leave the first scan. A task holds a shard's turns, some 50 bytes each: the
longest conversation bounds it from below. Rows with a null conv_id belong to no conversation and are
left out. Repeated rows are turns of their own. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from winnow.llm.common import materialize
from winnow.llm.shingles import mix

SHARE = 20  # conversations that may share their first turns
HEADS = 4  # h is below
SHARD_TURNS = 1 << 16
SHARD_CONVERSATIONS = 2048  # bits of a bitset
WORD = r"[^\x20\x09-\x0D]+"
KEY = ("depth", "k1", "k2")
_EMPTY = hashlib.sha256(b"").hexdigest()
_LOCAL = (
    "shard bigint, place bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv bigint, n bigint, "
    "words bigint, ends string"
)


def numbered(rows: DataFrame) -> DataFrame:
    """conv, pos (from 1), t1 and t2 (hashes of role and text), words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"),
        "turn",
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("turn"), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "t1", "t2")
    return turns.select("conv", F.row_number().over(order).cast("bigint").alias("pos"), "t1", "t2", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, pos, t1, t2, words of the rebuilt conversations; pos 0 stands for the root."""
    first = turns.where((F.col("pos") < HEADS) & (F.col("conv") % SHARE == 0))
    heads = first.groupBy(F.col("conv").alias("_base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("heads")
    )
    own = turns.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    own = own.join(heads, F.col("conv") - F.col("conv") % SHARE == F.col("_base"), "left")
    none = F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,words:bigint>>")
    taken = F.slice(F.coalesce("heads", none), F.lit(1), F.col("h").cast("int"))
    root = F.array(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("pos", "t1", "t2", "words")]))
    # The first row of a conversation brings the root and the shared turns along.
    shared = F.when(F.col("pos") == 1, F.concat(root, taken)).otherwise(none)
    place = (F.col("pos") - F.col("h") + F.size(taken)).cast("bigint").alias("pos")
    rest = F.when(F.col("pos") > F.col("h"), F.array(F.struct(place, "t1", "t2", "words"))).otherwise(none)
    return own.select("conv", F.explode(F.concat(shared, rest)).alias("t")).select("conv", "t.*")


class Shard:
    """The trie of some whole conversations, rows sorted by (conv, pos), in preorder."""

    def __init__(self, conv: np.ndarray, pos: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> None:
        self.conv, self.pos = conv, pos
        self.start = np.flatnonzero(pos == 0)
        self.length = np.diff(np.append(self.start, len(pos))) - 1
        _, self.code, self.times = np.unique(
            np.stack([pos, t1, t2], 1), axis=0, return_inverse=True, return_counts=True
        )
        self.code = self.code.reshape(-1)
        self.row: list[int] = []  # of the smallest member, at the node's depth
        self.n: list[int] = []
        self.parent: list[int] = []  # place of the parent
        self.ends: list[list[int] | None] = []  # members that end here, in order
        self._walk()

    def _postings(self) -> dict[int, int]:
        """(position, turn) to the bitset of its conversations, where there are several."""
        found: dict[int, int] = {}
        member = np.repeat(np.arange(len(self.start)), self.length + 1)
        shared = np.flatnonzero(self.times[self.code] > 1)
        for code, i in zip(self.code[shared].tolist(), member[shared].tolist()):
            found[code] = found.get(code, 0) | 1 << i
        return found

    def _walk(self) -> None:
        posting, start, length = self._postings(), self.start.tolist(), self.length.tolist()
        code = self.code.tolist()
        ended: dict[int, int] = {}
        for i, d in enumerate(length):
            ended[d] = ended.get(d, 0) | 1 << i
        stack = [((1 << len(start)) - 1, 0, -1)]
        while stack:
            members, depth, parent = stack.pop()
            low = (members & -members).bit_length() - 1
            n, place = members.bit_count(), len(self.row)
            if n == 1:
                for d in range(depth, length[low] + 1):
                    self._add(start[low] + d, 1, parent if d == depth else len(self.row) - 1)
                self.ends[-1] = [low]
                continue
            self._add(start[low] + depth, n, parent)
            here = members & ended.get(depth, 0)
            if here:
                self.ends[-1] = _bits(here)
            left, children = members ^ here, []
            while left:
                i = (left & -left).bit_length() - 1
                child = left & posting.get(code[start[i] + depth + 1], 1 << i)
                children.append((child, depth + 1, place))
                left ^= child
            stack += reversed(children)

    def _add(self, row: int, n: int, parent: int) -> None:
        self.row.append(row)
        self.n.append(n)
        self.parent.append(parent)
        self.ends.append(None)


def _bits(bitset: int) -> list[int]:
    raw = np.frombuffer(bitset.to_bytes(-(-bitset.bit_length() // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def _names(conv: np.ndarray, pos: np.ndarray, turn: np.ndarray, salt: int) -> np.ndarray:
    """Per row, the sum over the conversation's rows so far of a hash of (position, turn)."""
    with np.errstate(over="ignore"):
        each = mix(mix(turn.view(np.uint64) + np.uint64(salt)) + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        each[pos == 0] = 0
        total = np.cumsum(each, dtype=np.uint64)
        start = np.flatnonzero(pos == 0)
        return (total - np.repeat(total[start], np.diff(np.append(start, len(pos))))).view(np.int64)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a partition's shards."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    columns = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(5)]
    order = np.lexsort((columns[1], columns[0]))
    conv, pos, t1, t2, words = (c[order] for c in columns)
    k1, k2 = _names(conv, pos, t1, 0x51), _names(conv, pos, t2, 0xA7)
    start = np.append(np.flatnonzero(pos == 0), len(pos))
    for cut in range(0, len(start) - 1, SHARD_CONVERSATIONS):
        lo, hi = start[cut], start[min(cut + SHARD_CONVERSATIONS, len(start) - 1)]
        trie = Shard(conv[lo:hi], pos[lo:hi], t1[lo:hi], t2[lo:hi])
        row, parent = np.array(trie.row) + lo, np.array(trie.parent)
        above = row[np.maximum(parent, 0)]
        ids = conv[lo:hi][trie.start]
        ends = [None if e is None else ",".join(map(str, ids[e].tolist())) for e in trie.ends]
        shard = (TaskContext.get().partitionId() << 24) + cut // SHARD_CONVERSATIONS
        whole = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), shard, np.int64)),
                pa.array(np.arange(len(row))),
                *[pa.array(c) for c in (pos[row], k1[row], k2[row], k1[above], k2[above], conv[row])],
                pa.array(trie.n, pa.int64()),
                pa.array(words[row]),
                pa.array(ends, pa.string()),
            ],
            names=[f.split()[0] for f in _LOCAL.split(", ")],
        )
        for at in range(0, whole.num_rows, 8192):
            yield whole.slice(at, 8192)


def local_nodes(turns: DataFrame, shard_turns: int) -> DataFrame:
    """Every shard's nodes, in preorder by `place`; shards follow the order of conversation ids."""
    shards = max(1, -(-turns.count() // shard_turns))
    return turns.repartitionByRange(shards, "conv").mapInArrow(_local, _LOCAL)


def end_hashes(local: DataFrame) -> DataFrame:
    """Per node with ends: key and SHA-256 of the ids, as a stream of the shards' pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *own, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield _hashed(out)
            out = []
        if key is not None:
            yield _hashed([(*key, state.hexdigest())])

    pieces = local.where("ends is not null").select(*KEY, "shard", "ends")
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "shard").select(*KEY, "ends")
    return pieces.mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "ends_sha256"])


def _sums(table: pa.Table) -> pa.Table:
    """One shard's nodes with the sums over their subtrees in this shard, and the parent's conversation."""
    table = table.sort_by("place").combine_chunks()
    depth, saved, leaf, conv = (table[c].to_numpy() for c in ("depth", "saved", "leaf", "conv"))
    end, parent, path = np.zeros(len(depth), np.int64), np.full(len(depth), -1), []
    for i, d in enumerate(depth.tolist()):
        for done in path[d:]:
            end[done] = i
        del path[d:]
        if path:
            parent[i] = path[-1]
        path.append(i)
    end[path] = len(depth)
    sums = {}
    for name, values in (("saved", saved), ("leaves", leaf)):
        total = np.concatenate(([0], np.cumsum(values)))
        sums[name] = pa.array(total[end] - total[:-1])
    above = pa.array(conv[np.maximum(parent, 0)], mask=parent < 0)
    return pa.table({**{c: table[c] for c in KEY}, "parent": above, **sums})


def prefix_trie(rows: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize(rebuilt(materialize(numbered(rows), "trie-turns")), "trie-rebuilt")
    local = materialize(local_nodes(turns, shard_turns), "trie-local")
    nodes = local.groupBy(*KEY).agg(
        F.min("conv").alias("conv"),
        F.sum("n").alias("n_convs"),
        F.max("words").alias("words"),
        F.min(F.struct("shard", "place")).alias("owner"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    nodes = materialize(nodes, "trie-nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    nodes = nodes.join(below.agg(F.count(F.lit(1)).alias("n_children")), [*KEY], "left")
    nodes = materialize(nodes.drop("p1", "p2").na.fill(0, ["n_children"]), "trie-children")
    owned = F.struct("shard", "place") == F.col("owner")
    parts = local.select("shard", "place", *KEY).join(nodes.select(*KEY, "conv", "n_convs", "words", "n_children", "owner"), [*KEY])
    parts = parts.select(
        "shard",
        "place",
        *KEY,
        "conv",
        F.when(owned, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"),
        F.when(owned & (F.col("n_children") == 0), 1).otherwise(0).cast("bigint").alias("leaf"),
    )
    sums = parts.groupBy("shard").applyInArrow(
        _sums, "depth bigint, k1 bigint, k2 bigint, parent bigint, saved bigint, leaves bigint"
    )
    sums = sums.groupBy(*KEY).agg(
        F.min("parent").alias("parent_conv_id"), F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")
    )
    found = nodes.join(sums, [*KEY]).join(end_hashes(local), [*KEY], "left")
    return found.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
