"""Near-duplicates: fast similarity sketching, banding, and exact verification of every link.

A text is its set of five-word shingles (lower-case A-Z, words between blanks); fewer words make one
shingle. The sketch has 128 places. In each round every shingle is thrown into one place, and a
place keeps the smallest value of the first round that reaches it; after 128 rounds a place that is
still empty takes the smallest value of all shingles, so every place gets filled (Dahlgaard, Knudsen
and Thorup, 2017). 32 bands of 4 places make texts candidates: at a Jaccard similarity of 0.85 a
pair is missed with a probability below 1e-10, at 0.8 below 1e-7.

Texts with equal sets form a class, and only a class's smallest id goes on. In each band bucket the
member that shares most buckets is the hub, and every other member is compared with it on full
shingle sets. Links found so are contracted to components. What a hub was compared with is its
group; two members of one bucket are always in the group of that bucket's hub. A group whose members
lie in more than one component is cut into blocks of bounded size, by distance from the hub, and
pairs of blocks are compared inside a task, except where all rows are in one component or where the
triangle inequality of the Jaccard distance rules a link out. So every candidate pair that could
join two components is compared or ruled out, a group of near copies costs one comparison per
member plus that of its outliers, and the pairs of a group are never written as rows.

Null, empty and blank texts have no shingles and are linked with nothing. Rows with equal ids and
different texts have components of their own; `text_hash` tells them apart. Rows with a null id are left
alone (null component, kept). Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import materialize
from winnow.llm.components import components
from winnow.llm.shingles import mix, shingle_sets

PLACES = 128
ROWS = 4
PERCENT = 85
CELLS = 8  # of distance from the hub
BLOCK_ROWS = 512
BLOCK_SHINGLES = 500_000
_EMPTY = np.uint64(2**64 - 1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, PLACES) values; a set without shingles keeps empty places."""
    out = np.full(len(sets) * PLACES, _EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for turn in range(2 * PLACES):
        if not len(x):
            break
        thrown = mix(x + np.uint64((turn + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
        place = (thrown & np.uint64(PLACES - 1)).astype(np.int64) if turn < PLACES else turn - PLACES
        # The round in the upper bits: later rounds never displace earlier ones.
        value = (thrown >> np.uint64(9)) | np.uint64(turn) << np.uint64(55)
        np.minimum.at(out, owner * PLACES + place, value)
        open_ = (out.reshape(-1, PLACES) == _EMPTY).any(1)[owner]
        x, owner = x[open_], owner[open_]
    return out.reshape(-1, PLACES)


def bands(sketch: np.ndarray) -> np.ndarray:
    """(texts, PLACES / ROWS) bucket keys."""
    parts = sketch.reshape(len(sketch), -1, ROWS)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(0xE7037ED1A0B428DB) + parts[:, :, i])
    return key


def sketch_table(docs: DataFrame, id_col: str) -> DataFrame:
    """Per row: id, th (hash of the text), n_shingles, two sums that name its set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = list(shingle_sets(part.column(2).to_pylist()))
                keys = bands(sketches(sets))
                with np.errstate(over="ignore"):
                    names = [
                        np.array([mix(s + np.uint64(k)).sum(dtype=np.uint64) for s in sets], np.uint64)
                        for k in (0x51, 0xA7)
                    ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array(n.view(np.int64)) for n in names],
                        pa.array([list(k) for k in keys.view(np.int64)], pa.list_(pa.int64())),
                    ],
                    names=["id", "th", "n", "name1", "name2", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("bigint"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "id bigint, th bigint, n bigint, name1 bigint, name2 bigint, bands array<bigint>")


def set_table(docs: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """`id, shingles`: the full sets of the documents that stand for `nodes` (node, _rep, _th).

    Texts meet the ids alone, which is the least that can be broadcast; what tells texts of one id apart
    meets the sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["own", "th", "shingles"]
                )

    ids = materialize(nodes.select(F.col("_rep").alias("own")).distinct(), "dedup-ids")
    rows = docs.select(F.col(id_col).cast("bigint").alias("own"), F.xxhash64("text").alias("th"), "text")
    rows = rows.join(ids, "own", "left_semi").mapInArrow(run, "own bigint, th bigint, shingles array<bigint>")
    rows = rows.dropDuplicates(["own", "th"]).join(nodes, F.expr("own = _rep and th = _th"))
    return rows.select(F.col("node").alias("id"), "shingles")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (`a`, `b`) with `both` and `either`: sizes of intersection and union of the full sets."""
    left, right = (sets.select(F.col("id").alias(f"_{e}"), F.col("shingles").alias(f"s{e}")) for e in "ab")
    rows = pairs.join(right, F.col("b") == F.col("_b")).join(left, F.col("a") == F.col("_a"))
    rows = rows.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return rows.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either"))


def similar(percent: int) -> Column:
    return F.col("both") * 100 >= F.col("either") * percent


def block_pairs(group: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (hub, id, block, component), and the pairs of blocks of a hub that can hold a link.

    Blocks are cells of distance from the hub, cut by a hash of the id until each holds about
    BLOCK_ROWS rows and BLOCK_SHINGLES shingles.
    """
    cell = F.concat_ws(":", F.col("near").cast("string"), F.floor(F.col("distance") * CELLS).cast("string"))
    rows = group.withColumn("cell", cell)
    cells = rows.groupBy(F.col("hub").alias("_hub"), F.col("cell").alias("_cell")).agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("_cuts")
    )
    cut = F.pmod(F.xxhash64("id"), F.col("_cuts"))
    rows = rows.join(cells, (F.col("hub") == F.col("_hub")) & (F.col("cell") == F.col("_cell")))
    rows = materialize(
        rows.select("hub", "id", "component", "distance", F.concat_ws(":", "cell", cut.cast("string")).alias("block")),
        "dedup-blocks",
    )
    blocks = rows.groupBy("hub", "block").agg(
        F.min("distance").alias("low"),
        F.max("distance").alias("high"),
        F.min("component").alias("first"),
        F.max("component").alias("last"),
    )
    one, two = (blocks.select([F.col(c).alias(f"{c}{i}") for c in blocks.columns]) for i in (1, 2))
    reach = 1 - percent / 100 + 1e-9
    apart = (F.col("low2") - F.col("high1") > reach) | (F.col("low1") - F.col("high2") > reach)
    joined = (F.col("first1") == F.col("last1")) & (F.col("first2") == F.col("last2")) & (F.col("first1") == F.col("first2"))
    met = one.join(two, (F.col("hub1") == F.col("hub2")) & (F.col("block1") <= F.col("block2")))
    return rows, met.where(~apart & ~joined).select(F.col("hub1").alias("hub"), "block1", "block2")


def links_in_blocks(rows: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (`a`, `b`) between different components of the rows of each pair of blocks."""
    sides = pairs.select("hub", "block1", "block2", F.explode(F.array_distinct(F.array("block1", "block2"))).alias("block"))
    held = rows.join(sides, ["hub", "block"]).select("hub", "block1", "block2", "block", "id", "component")
    held = held.join(sets, "id")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component = table["id"].to_numpy(), table["component"].to_numpy()
        lists = table["shingles"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), sizes)
        _, token, seen = np.unique(flat, return_inverse=True, return_counts=True)
        shared = seen[token] > 1
        names, token = np.unique(token[shared], return_inverse=True)
        owner = owner[shared]
        both = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        for at in range(0, len(names), 4096):
            lo, hi = np.searchsorted(token, (at, at + 4096))
            held_in = np.zeros((len(ids), 4096), np.float32)
            held_in[owner[lo:hi], token[lo:hi] - at] = 1
            both += held_in @ held_in.T
        either = sizes[:, None] + sizes[None, :] - both
        linked = (both * 100.0 >= either.astype(np.float64) * percent) & (component[:, None] != component[None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        found = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1))):
            x, y = find(int(component[i])), find(int(component[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((int(ids[i]), int(ids[j])))
        return pa.table(
            {"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())}
        )

    return held.groupBy("hub", "block1", "block2").applyInArrow(run, "a bigint, b bigint")


def labels_of(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Components of the ids in `members` (band, id, n, size of the bucket); null when none is linked."""
    score = members.groupBy(F.col("id").alias("_id")).agg(F.sum("bucket").alias("score"))
    scored = members.join(score, F.col("id") == F.col("_id")).select("band", "id", "n", "score")
    hubs = scored.groupBy(F.col("band").alias("_band")).agg(
        F.max_by("id", F.struct("score", -F.col("id"))).alias("hub")
    )
    stars = members.join(hubs, F.col("band") == F.col("_band")).where("id != hub")
    tested = materialize(
        compared(stars.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sets), "dedup-stars"
    )
    links = materialize(tested.where(similar(percent)).select("a", "b"), "dedup-links")
    labels = None if links.isEmpty() else components(links)
    sized = members.select(F.col("id").alias("_id"), "n").distinct()
    group = tested.join(sized, F.col("b") == F.col("_id")).select(
        F.col("a").alias("hub"),
        F.col("b").alias("id"),
        "n",
        (1 - F.col("both") / F.col("either")).alias("distance"),
        similar(percent).alias("near"),
    )
    if labels is None:
        group = group.withColumn("component", F.col("id"))
    else:
        own = labels.select(F.col("id").alias("_id"), "component")
        group = group.join(own, F.col("id") == F.col("_id"), "left").drop("_id")
        group = group.withColumn("component", F.coalesce("component", "id"))
    group = materialize(group, "dedup-group")
    open_ = group.groupBy(F.col("hub").alias("_hub")).agg(
        F.min("component").alias("_low"), F.max("component").alias("_high")
    )
    group = group.join(open_.where("_low < _high").select("_hub"), F.col("hub") == F.col("_hub"), "left_semi")
    rows, pairs = block_pairs(group, percent)
    more = materialize(links_in_blocks(rows, pairs, sets, percent), "dedup-more")
    return labels if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """Per row of `docs`: id, n_shingles, component_id (smallest id reachable), kept, text_hash."""
    rows = materialize(sketch_table(docs, id_col), "dedup-sketches")
    named = rows.where("n > 0 and id is not null")
    # A class has a node of its own, as texts may share an id.
    classes = named.groupBy("name1", "name2", "n").agg(F.min(F.struct("id", "th")).alias("first"))
    classes = classes.select("name1", "name2", "n", F.col("first.id").alias("rep"), F.col("first.th").alias("rep_th"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "dedup-classes")
    own = classes.select(*(F.col(c).alias(f"_{c}") for c in ("name1", "name2", "n", "rep", "rep_th")), "node")
    reps = named.join(own, F.expr("name1 = _name1 and name2 = _name2 and n = _n and id = _rep and th = _rep_th"))
    reps = reps.select("node", "n", "bands").dropDuplicates(["node"])
    spread = reps.select(F.col("node").alias("id"), "n", F.explode("bands").alias("band"))
    shared = spread.groupBy(F.col("band").alias("_band")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    members = materialize(
        spread.join(shared, F.col("band") == F.col("_band")).select(
            "band", "id", "n", F.col("_n").alias("bucket")
        ),
        "dedup-members",
    )
    held = members.select(F.col("id").alias("_member")).distinct()
    held = held.join(classes, F.col("_member") == F.col("node")).select("node", F.col("rep").alias("_rep"), F.col("rep_th").alias("_th"))
    sets = materialize(set_table(docs, materialize(held, "dedup-nodes"), id_col), "dedup-sets")
    labels = labels_of(members, sets, percent)
    if labels is None:
        classes = classes.withColumn("component", F.col("rep"))
    else:
        labels = labels.select(F.col("id").alias("_id"), F.col("component").alias("label"))
        labelled = classes.join(labels, F.col("node") == F.col("_id"), "left").drop("_id")
        labelled = labelled.withColumn("label", F.coalesce("label", "node"))
        least = labelled.groupBy(F.col("label").alias("_label")).agg(F.min("rep").alias("component"))
        classes = labelled.join(least, F.col("label") == F.col("_label")).drop("_label", "label")
        classes = materialize(classes, "dedup-components")
    result = rows.join(
        classes.select(*(F.col(c).alias(f"_{c}") for c in ("name1", "name2", "n")), "component"),
        F.expr("name1 = _name1 and name2 = _name2 and n = _n and id is not null"),
        "left",
    )
    component = F.coalesce("component", "id")
    return result.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        F.col("th").alias("text_hash"),
    )


def minhash_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
