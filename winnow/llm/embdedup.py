"""Embedding near-duplicates: a navigable small-world graph per shard, every shard queried by every vector.

Vectors are compared by cosine in double precision. Equal vectors form a class, of which one goes on; its
links count with the size of the class. Classes are dealt to shards of about SHARD_ROWS by hash, and each
shard builds a graph (`winnow.llm.hnsw`) whose nodes are the centres of bundles: vectors within a cosine of
0.98 of their centre. Its audit sets the beam. Then each shard's vectors are sent to each shard's graph:

* every centre within reach of a query is looked for, reach being the threshold's angle and that of the
  centre's bundle; a query whose beam is full within the widest reach is searched again with a wider one;
* a bundle that the angles place wholly within the threshold is linked as one, a bundle wholly outside is
  left, and members of the others are compared one by one in double precision, in slices;
* a vector's own bundle is always met: any two of its members are linked, as twice its angle is below the
  threshold's.

A pair of shards hands on a count for each vector with links, and of the links themselves only as many as
keep their ends together, so neither a crowd of copies nor a crowd of near copies is ever written as pairs.
Counts are added up by class; components come from the links kept. Links are found by search, so a link
can be missed (recall is audited in each shard, and tested against brute force); none is below the
threshold.

Pairs of shards grow with the square of the table over the shard size, as the method asks every shard;
SHARD_ROWS trades that against a task's memory: for each vector of 64 parts some 2 KB.

Vectors that are null, empty, all zero, or hold a null or a value that is not finite are linked with
nothing, and only vectors of equal length are compared. Rows with a null id are left alone (no links, null
component, kept). Repeated equal rows count once, and each has its own row in the result. Rows with equal
ids and different vectors have links of their own and one component. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from winnow.llm.common import materialize
from winnow.llm.components import components
from winnow.llm.hnsw import BUNDLE, Graph
from winnow.llm.vptree import usable

THRESHOLD = 0.9
SHARD_ROWS = 1 << 14
SLICE = 1 << 17  # pairs compared at once
_SLACK = 1e-9
_GRAPH = (
    "size int, shard bigint, n int, nodes binary, weights binary, vectors binary, centre binary, row binary, "
    "least binary, links array<binary>, entry int, beam int"
)


def unit_rows(flat: np.ndarray, size: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, size)
    # By the largest part first, so that squares neither vanish nor overflow.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def reach(graph: Graph, threshold: float) -> np.ndarray:
    """Least cosine between a query and each centre at which its bundle may hold a link."""
    angle = np.arccos(threshold) + np.arccos(np.clip(graph.least, -1, 1))
    return np.cos(np.minimum(np.pi, angle)) - 1e-6


def _plant(threshold: float):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("node").combine_chunks()
        size = key[0].as_py()
        vectors = unit_rows(part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), size)
        # In an order that does not follow the ids.
        order = np.random.default_rng(7).permutation(len(vectors))
        graph = Graph(vectors[order])
        beam = graph.audited_beam(reach(graph, threshold))
        weights, nodes = (part[c].to_numpy()[order] for c in ("weight", "node"))
        packed = [nodes, weights, graph.vectors, graph.centre, graph.row[: graph.count], graph.least]
        row = [size, key[1].as_py(), len(nodes), *[p.tobytes() for p in packed]]
        row += [[layer[: graph.count].tobytes() for layer in graph.links], graph.entry, beam]
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.binary()), pa.int32(), pa.int32()]
        names = [f.split()[0] for f in _GRAPH.split(", ")]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return run


def unpacked(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    """A shard's graph, its nodes and their weights."""
    graph = Graph.__new__(Graph)
    graph.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["size"])
    graph.centre, graph.row = (np.frombuffer(row[c], np.int64) for c in ("centre", "row"))
    graph.least, graph.count, graph.entry = np.frombuffer(row["least"], np.float64), len(graph.row), row["entry"]
    graph.unit = graph.vectors[graph.row].astype(np.float32)
    graph.links = [np.frombuffer(raw, np.int32).reshape(graph.count, -1) for raw in row["links"]]
    return graph, *(np.frombuffer(row[c], np.int64) for c in ("nodes", "weights"))


class Forest:
    """Links that join what was not joined before."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))


def matched(
    graph: Graph, beam: int, nodes: np.ndarray, weights: np.ndarray, asked: np.ndarray, vectors: np.ndarray, threshold: float
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Per query the number of rows linked with it in this shard, and links that keep all ends together."""
    limit = np.arccos(threshold)
    order = np.argsort(nodes)
    place = order[np.searchsorted(nodes[order], asked).clip(0, len(nodes) - 1)]
    inside = nodes[place] == asked  # the shard is the query's own
    q, c = graph.within(vectors, reach(graph, threshold), beam)
    own = np.flatnonzero(inside)
    pairs = np.unique(np.concatenate([q * graph.count + c, own * graph.count + graph.centre[place[own]]]))
    q, c = np.divmod(pairs, graph.count)
    near = np.empty(len(q))
    for at in range(0, len(q), SLICE):
        near[at : at + SLICE] = np.einsum("nd,nd->n", vectors[q[at : at + SLICE]], graph.vectors[graph.row[c[at : at + SLICE]]])
    angle = np.arccos(np.clip(near, -1, 1))
    wide = np.arccos(np.clip(graph.least, -1, 1))[c]
    at_home = inside[q] & (graph.centre[place[q]] == c)
    # A bundle of one is its centre: the cosine itself decides.
    whole = at_home | np.where(wide > 0, angle + wide <= limit - _SLACK, near >= threshold)
    some = ~whole & (wide > 0) & (angle - wide <= limit + _SLACK)

    by_centre = np.argsort(graph.centre, kind="stable")
    first = np.searchsorted(graph.centre[by_centre], np.arange(graph.count + 1))
    total = np.bincount(graph.centre, weights, graph.count).astype(np.int64)
    linked = np.zeros(len(asked), np.int64)
    np.add.at(linked, q[whole], total[c[whole]])
    linked[own] -= weights[place[own]]
    forest = Forest()
    forest.add(asked[q[whole]], nodes[graph.row[c[whole]]])
    q, c = q[some], c[some]
    sizes = first[c + 1] - first[c]
    at = 0
    while at < len(q):
        # As many bundles as fit in a slice, one at least; a larger bundle is cut.
        to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, "right")) + at)
        who = np.repeat(np.arange(at, to), sizes[at:to])
        members = by_centre[np.concatenate([np.arange(first[x], first[x + 1]) for x in c[at:to]])]
        for lo in range(0, len(who), SLICE):
            w, m = who[lo : lo + SLICE], members[lo : lo + SLICE]
            hit = np.einsum("nd,nd->n", vectors[q[w]], graph.vectors[m]) >= threshold
            hit &= nodes[m] != asked[q[w]]
            w, m = w[hit], m[hit]
            np.add.at(linked, q[w], weights[m])
            one = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else w
            # Members of a bundle are linked with each other: one link to it is enough.
            forest.add(asked[q[w[one]]], nodes[m[one]])
        at = to
    return linked, forest.links


def links_and_components(classes: DataFrame, threshold: float, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) of classes (node, size, weight, vector) with links to others, and links (a, b)."""
    shards = max(1, -(-classes.count() // shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)))
    graphs = materialize(dealt.groupBy("size", "shard").applyInArrow(_plant(threshold), _GRAPH), "embed-graphs")
    asked = graphs.select(
        F.col("size").alias("_size"), F.col("nodes").alias("asked"), F.col("vectors").alias("queries"), F.col("shard").alias("_from")
    )
    asked = asked.withColumn("_to", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")))
    met = asked.join(graphs, (F.col("_size") == F.col("size")) & (F.col("_to") == F.col("shard")))
    met = met.drop("_size", "_from", "_to", "shard", "n").repartition(max(1, min(shards * shards, 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                graph, nodes, weights = unpacked(row)
                ids = np.frombuffer(row["asked"], np.int64)
                vectors = np.frombuffer(row["queries"], np.float64).reshape(-1, row["size"])
                linked, links = matched(graph, row["beam"], nodes, weights, ids, vectors, threshold)
                some = linked > 0
                a, b = (np.array([x[j] for x in links], np.int64) for j in (0, 1))
                none = np.zeros(some.sum(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[some], a])),
                        pa.array(np.concatenate([none, b]), mask=np.arange(len(none) + len(b)) < len(none)),
                        pa.array(np.concatenate([linked[some], np.zeros(len(b), np.int64)])),
                    ],
                    names=["a", "b", "n"],
                )

    found = materialize(met.mapInArrow(run, "a bigint, b bigint, n bigint"), "embed-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    return counts, found.where("b is not null").select("a", "b")


def near_duplicates(
    rows: DataFrame,
    *,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Per row: id, n_links, component_id (smallest id reachable), kept."""
    if np.arccos(threshold) < 2 * np.arccos(BUNDLE):
        raise ValueError("the threshold is too near one for bundles of 0.98")
    # Adding zero makes the two zeros one.
    vector = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))
    own = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("id"),
        F.when(F.col(id_col).isNotNull() & usable(F.col(vector_col)), vector).alias("vector"),
    )
    keys = (F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit("vector"), "vector").alias("k2"), F.size("vector").alias("size"))
    own = materialize(own.select("row", "id", *(F.when(F.col("vector").isNotNull(), k).alias(n) for k, n in zip(keys, ("k1", "k2", "size"))), "vector"), "embed-rows")
    named = own.where("vector is not null")
    classes = named.dropDuplicates(["id", "k1", "k2", "size"]).groupBy("k1", "k2", "size")
    classes = classes.agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "embed-classes")
    counts, links = links_and_components(classes.select("node", "size", "weight", "vector"), threshold, shard_rows)

    of = classes.select(*(F.col(c).alias(f"_{c}") for c in ("k1", "k2", "size")), "node", "weight")
    placed = named.select("row", "id", "k1", "k2", "size").join(of, F.expr("k1 = _k1 and k2 = _k2 and size = _size"))
    placed = materialize(placed.select("row", "id", "node", "weight"), "embed-placed")
    # An id with several vectors holds their classes together.
    ids = placed.groupBy(F.col("id").alias("_id")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
    several = placed.join(ids.where("low < high"), F.col("id") == F.col("_id")).select(F.col("low").alias("a"), F.col("node").alias("b"))
    links = materialize(links.union(several.where("a != b")).distinct(), "embed-edges")
    if links.isEmpty():
        component = classes.select("node", F.col("rep").alias("component"))
    else:
        labels = components(links).select(F.col("id").alias("_node"), F.col("component").alias("label"))
        labelled = classes.select("node", "rep").join(labels, F.col("node") == F.col("_node"), "left")
        labelled = labelled.select("node", "rep", F.coalesce("label", "node").alias("label"))
        least = labelled.groupBy(F.col("label").alias("_label")).agg(F.min("rep").alias("component"))
        component = labelled.join(least, F.col("label") == F.col("_label")).select("node", "component")
    per_node = component.join(counts, ["node"], "left").select(
        F.col("node").alias("_node"), "component", F.coalesce("links", F.lit(0)).alias("links")
    )
    per_node = materialize(per_node, "embed-nodes")
    per_row = placed.join(per_node, F.col("node") == F.col("_node")).select(
        F.col("row").alias("_row"), F.col("id").alias("_id"), "component", (F.col("links") + F.col("weight") - 1).alias("n")
    )
    # Rows of an id without a usable vector share its component as well.
    by_id = per_row.groupBy(F.col("_id").alias("_own")).agg(F.min("component").alias("shared"))
    result = own.select("row", "id").join(per_row.select("_row", "n"), F.col("row") == F.col("_row"), "left")
    result = result.join(by_id, F.col("id") == F.col("_own"), "left")
    component = F.coalesce("shared", "id")
    return result.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
