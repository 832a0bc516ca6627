"""Approximate nearest neighbours: a vantage-point tree per shard.

Vectors are scaled to length one, where the largest cosine is the smallest Euclidean distance. Rows
are dealt to shards of about `SHARD_ROWS` by a hash of their id; a shard's tree splits rows at the
median distance from a vantage point until LEAF rows are left. A search descends on the query's side
first and then visits the other side unless the triangle inequality, with the best distance so far
divided by `factor`, rules it out: factor 1 is exact, larger ones prune more. What is found is scored
again on the original vectors in double precision, term by term in one order, so equal vectors get
equal scores and ties go to the smaller id.

Every query meets every shard, in tiles: some shards' rows and some blocks of queries meet in one task,
which builds each of its trees once and then reads its queries block by block. Rows are copied once a
bundle of blocks, queries once a group of shards, by one shuffle, never by a broadcast: nothing but counts
reaches the driver. A task holds the trees of its tile, `TREES` and some `TREE_BYTES` at most, and hands on
k rows a query, which a ranked limit cuts to k per query.

Of equal vectors only the k + 1 smallest ids enter the trees, as others can never be among the k nearest; a
limit applied in each task before the shuffle, so a vector that a third of all rows share makes no hot
group. Rows that share their vector's hash with no other row go without it, as nothing equals them; where
more than an eighth share theirs, all go through it.

Vectors that are null, empty, all zero, or hold a null or a value that is not finite take no part.
Vectors are compared with those of their own length only. With fewer candidates than k, all are
returned. Repeated ids of one vector count once. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from winnow.llm.common import materialize

LEAF = 64
SHARD_ROWS = 4096
BLOCK = 8192  # queries searched at once, fewer if vectors are long
TREES = 32
TREE_BYTES = 1 << 27
PAIRS = 512  # of a shard and a block, in a tile of a large table
K = 5
FACTOR = 1.2
_SLACK = 1e-9


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: int = -1  # place in the tree's points
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 0) -> None:
        self.ids, self.vectors = ids, vectors
        self.lengths = np.sqrt((vectors * vectors).sum(1))
        # Scaled by the largest part first, so that squares neither vanish nor overflow.
        top = np.abs(vectors).max(1, keepdims=True)
        unit = vectors / top
        unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
        points: list[int] = []
        self.root = self._build(unit, points, np.arange(len(ids)), np.random.default_rng(seed))
        self.points, self.rough = unit[points], unit.astype(np.float32)

    def _build(self, unit: np.ndarray, points: list[int], rows: np.ndarray, rng: np.random.Generator) -> Node:
        if len(rows) <= LEAF:
            return Node(rows=rows)
        point = int(rows[rng.integers(len(rows))])
        away = np.sqrt(np.maximum(0, 2 - 2 * unit[rows] @ unit[point]))
        radius = float(np.median(away))
        inside = away <= radius
        if inside.all():
            return Node(rows=rows)
        points.append(point)
        place = len(points) - 1
        inner, outer = (self._build(unit, points, rows[side], rng) for side in (inside, ~inside))
        return Node(None, place, radius, inner, outer)


class Search:
    """k nearest of a block of queries in one tree, by cosine."""

    def __init__(self, tree: Tree, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.ids, self.vectors, self.k, self.factor = tree, ids, vectors, k, factor
        top = np.abs(vectors).max(1, keepdims=True)
        unit = vectors / top
        unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
        self.away = np.sqrt(np.maximum(0, 2 - 2 * unit @ tree.points.T))
        # Leaves are sifted in single precision, with slack for all of its error, and scored in double.
        self.rough, self.slack = unit.astype(np.float32), (unit.shape[1] + 8) * 2.0**-23
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.own = np.isin(ids, tree.ids)
        self._visit(tree.root, np.arange(len(ids)))

    def _reach(self, queries: np.ndarray) -> np.ndarray:
        worst = self.scores[queries, -1]
        return np.where(np.isfinite(worst), np.sqrt(np.maximum(0, 2 - 2 * worst)), np.inf)

    def _visit(self, node: Node, queries: np.ndarray) -> None:
        if not len(queries):
            return
        if node.rows is not None:
            self._leaf(node.rows, queries)
            return
        gap = self.away[queries, node.point] - node.radius
        near = gap <= 0
        self._visit(node.inner, queries[near])
        self._visit(node.outer, queries[~near])
        allowed = np.abs(gap) <= self._reach(queries) / self.factor + _SLACK
        self._visit(node.outer, queries[near & allowed])
        self._visit(node.inner, queries[~near & allowed])

    def _leaf(self, rows: np.ndarray, queries: np.ndarray) -> None:
        tree, k = self.tree, self.k
        close = self.rough[queries] @ tree.rough[rows].T
        own = np.flatnonzero(self.own[queries])
        if len(own):
            q, r = np.nonzero(self.ids[queries[own]][:, None] == tree.ids[rows][None, :])
            close[own[q], r] = -np.inf
        least = self.scores[queries, -1]
        # Most leaves have nothing for most queries.
        some = close.max(1) >= least - self.slack
        queries, close, least = queries[some], close[some], least[some]
        if len(rows) > k:
            # Off by the error on either side: that of the k-th and that of the row compared with it.
            least = np.maximum(least, np.partition(close, len(rows) - k, 1)[:, len(rows) - k] - self.slack)
        q, r = np.nonzero(close >= (least - self.slack)[:, None])
        keep = np.isfinite(close[q, r])
        q, r = queries[q[keep]], rows[r[keep]]
        if not len(q):
            return
        score = cosine(self.vectors[q], tree.vectors[r])
        every_q = np.concatenate([q, np.repeat(queries, k)])
        every_s = np.concatenate([score, self.scores[queries].reshape(-1)])
        every_i = np.concatenate([tree.ids[r], self.found[queries].reshape(-1)])
        order = np.lexsort((every_i, -every_s, every_q))
        every_q, every_s, every_i = every_q[order], every_s[order], every_i[order]
        place = np.arange(len(every_q)) - np.searchsorted(every_q, every_q)
        best = place < k
        self.scores[every_q[best], place[best]] = every_s[best]
        self.found[every_q[best], place[best]] = every_i[best]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; sums run in the same order for every row."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _matrix(column: pa.Array) -> np.ndarray:
    # Adding zero makes the two zeros one.
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) + 0.0


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """Key, ids and vectors of rows that lie one after the other and agree in tile, kind, size and part."""
    at, ids, vectors = None, [], []
    for batch in batches:
        keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("tile", "kind", "size", "part")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), len(keys)]):
            if lo == hi:
                continue
            key = tuple(keys[lo].tolist())
            if key != at and ids:
                yield at, np.concatenate(ids), np.concatenate(vectors)
                ids, vectors = [], []
            at = key
            ids.append(batch["id"].slice(lo, hi - lo).to_numpy())
            vectors.append(_matrix(batch["vector"].slice(lo, hi - lo)))
    if ids:
        yield at, np.concatenate(ids), np.concatenate(vectors)


def _best(trees: list[Tree], ids: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k nearest of each query in any of the trees, each searched for itself."""
    scores, found = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
    for tree in trees:
        done = Search(tree, ids, vectors, k, factor)
        scores, found = np.concatenate([scores, done.scores], 1), np.concatenate([found, done.found], 1)
        order = np.lexsort((found, -scores), axis=1)[:, :k]
        scores, found = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
    return scores, found


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _first_ids(table: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(id, vector, size), of equal vectors those with the k + 1 smallest ids, and the number of rows."""

    def limited(df: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
        return materialize(df.distinct().withColumn("_place", place).where(F.col("_place") <= k + 1).drop("_place"), "vp-rows")

    coded = table.withColumn("code", F.xxhash64("vector"))
    codes = materialize(coded.groupBy("code", "size").agg(F.count(F.lit(1)).alias("n")), "vp-codes")
    total, shared = codes.agg(F.sum("n"), F.sum(F.when(F.col("n") > 1, F.col("n")))).first()
    if not shared:
        return table, total or 0
    if 8 * shared > total:
        kept = limited(table)
        return kept, kept.count()
    # Written by itself: the join goes by its own size.
    crowd = materialize(codes.where("n > 1").select(F.col("code").alias("_code"), F.col("size").alias("_size")), "vp-crowd")
    same = (F.col("code") == F.col("_code")) & (F.col("size") == F.col("_size"))
    kept = limited(coded.join(crowd, same, "left_semi").drop("code"))
    alone = coded.join(crowd, same, "left_anti").drop("code")
    return alone.unionByName(kept), total - shared + kept.count()


def _grid(rows: int, asked: int, shards: int, blocks: int, widest: int, shard_rows: int, cores: int) -> tuple[int, int]:
    """Groups of shards and bundles of blocks: enough tiles for the cores, with few copies of rows and queries."""
    tiles = min(shards * blocks, max(3 * cores, shards * blocks // PAIRS))
    bundles = min(blocks, max(1, round((tiles * asked / max(1, rows)) ** 0.5)))
    trees = max(1, min(TREES, TREE_BYTES // (16 * shard_rows * widest)))
    return min(shards, max(-(-tiles // bundles), -(-shards // trees))), bundles


def nearest(
    rows: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest rows of every row that meets `queries`."""
    own = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    # Floats travel as they are and are widened where they are used.
    kind = rows.select(vector_col).schema[0].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))
    vector = F.col(vector_col) if plain else F.transform(vector_col, lambda x: x.cast("double"))
    columns = [F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"), F.size(vector_col).alias("size")]
    kept, n_kept = _first_ids(own.select(*columns), k)
    asked = materialize(own.where(queries).select(*columns).distinct(), "vp-queries")
    n_asked, widest = asked.agg(F.count(F.lit(1)), F.max("size")).first()
    shards = max(1, -(-n_kept // shard_rows))
    blocks = max(1, -(-n_asked // min(BLOCK, max(1, TREE_BYTES // (16 * (widest or 1))))))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups, bundles = _grid(n_kept, n_asked, shards, blocks, widest or 1, shard_rows, cores)

    def dealt(df: DataFrame, kind: int, parts: int, salt: str, tiles: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts))
        df = df.select("id", "vector", "size", F.lit(kind).alias("kind"), part.alias("part"))
        return df.withColumn("tile", F.explode(F.expr(tiles).cast("array<int>")))

    trees = dealt(kept, 0, shards, "row", f"transform(sequence(0L, {bundles - 1}L), x -> part % {groups} * {bundles} + x)")
    questions = dealt(asked, 1, blocks, "query", f"transform(sequence(0L, {groups - 1}L), x -> x * {bundles} + part % {bundles})")
    met = trees.unionByName(questions).repartitionById(groups * bundles, "tile")
    met = met.sortWithinPartitions("tile", "kind", "size", "part", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, planted = None, {}
        for (tile, kind, size, _), ids, vectors in _runs(batches):
            if tile != at:
                at, planted = tile, {}
            if kind == 0:
                planted.setdefault(size, []).append(Tree(ids, vectors))
            elif size in planted:
                scores, found = _best(planted[size], ids, vectors, k, factor)
                real = np.isfinite(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, k).reshape(-1, k)[real]), pa.array(found[real]), pa.array(scores[real])],
                    names=["query_id", "id", "score"],
                )

    found = met.mapInArrow(search, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def neighbours(rows: DataFrame) -> DataFrame:
    return nearest(rows, F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")
