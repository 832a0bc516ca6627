"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from winnow.llm import embdedup
from winnow.llm.hnsw import Graph

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, n int, id int, row int, size int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2, 3, 4) for i, v in rows], SCHEMA)


def noisy(rng, centre, cos):
    away = rng.standard_normal(len(centre))
    away -= centre * (away @ centre)
    away /= np.sqrt(away @ away)
    return centre * cos + away * np.sqrt(1 - cos * cos)


def unit(rng, n, dim=24):
    x = rng.standard_normal((n, dim))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(n=700):
    """Lone vectors, pairs, tight and loose crowds, chains, copies."""
    rng = np.random.default_rng(4)
    out = [v for v in unit(rng, n)]
    tight, loose, chain = unit(rng, 3)
    out += [noisy(rng, tight, 0.995) for _ in range(400)] + [noisy(rng, tight, 0.96) for _ in range(60)]
    out += [noisy(rng, loose, 0.95) for _ in range(150)]
    for v in out[:40]:
        out.append(noisy(rng, v, rng.choice([0.93, 0.899, 0.91])))
    for _ in range(12):
        chain = noisy(rng, chain, 0.92)
        out.append(chain)
    out += [out[3]] * 50 + [out[705]] * 30
    order = rng.permutation(len(out))
    return [(int(i), [float(x) for x in np.float32(out[j])]) for i, j in enumerate(order)]


def expected(rows, threshold=0.9):
    x = np.array([v for _, v in rows], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids = [i for i, _ in rows]
    near = x @ x.T >= threshold
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        p, q = find(ids[a]), find(ids[b])
        root[max(p, q)] = min(p, q)
    return sorted((i, int(k) - 1, find(i), find(i) == i) for i, k in zip(ids, near.sum(1)))


def found(spark, rows, **kw):
    df = embdedup.near_duplicates(table_of(spark, rows), **kw)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("shard_rows", [300, 1 << 14])
def test_links_and_components_equal_all_pairs(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(embdedup, "SLICE", 1000)
    rows = vectors()
    got, true = sorted(found(spark, rows, shard_rows=shard_rows)), expected(rows)
    assert all(g[1] <= t[1] for g, t in zip(got, true))
    assert sum(g[1] for g in got) >= 0.99 * sum(t[1] for t in true)
    assert sum(g == t for g, t in zip(got, true)) >= 0.99 * len(true)


def test_unusable_repeated_and_null(spark):
    rng = np.random.default_rng(1)
    a, b = ([float(x) for x in v] for v in unit(rng, 2, 8))
    near = [float(x) for x in noisy(rng, np.array(a), 0.95)]
    nan, inf = [float("nan"), *a[1:]], [float("inf"), *a[1:]]
    rows = [
        (1, None), (2, []), (3, [0.0] * 8), (4, nan), (5, inf), (6, [None, *a[1:]]), (7, a[:7]),
        (10, a), (11, [2 * x for x in a]), (12, a), (12, a), (13, near), (14, b), (15, [x * 1e-30 for x in b]), (16, [-x for x in a]),
        (None, a), (None, None), (20, b), (20, a), (20, None),
    ]
    got = found(spark, rows)
    lone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 16)]
    assert all(r in got for r in lone) and got.count((None, 0, None, True)) == 2
    # 10, 11, 12, 13 and 20 are alike, 14, 15 and 20 as well; 20 joins both; the two rows of 12 count once.
    assert sorted(r for r in got if r[0] in (10, 11, 12, 13, 14, 15)) == [
        (10, 4, 10, True), (11, 4, 10, False), (12, 4, 10, False), (12, 4, 10, False), (13, 4, 10, False),
        (14, 2, 10, False), (15, 2, 10, False),
    ]
    assert sorted(r for r in got if r[0] == 20) == [(20, 0, 10, False), (20, 2, 10, False), (20, 4, 10, False)]
    assert found(spark, []) == [] and sorted(found(spark, rows[:3])) == [(i, 0, i, True) for i in (1, 2, 3)]


def test_a_crowd_of_copies_is_counted_not_paired(spark):
    rng = np.random.default_rng(2)
    one, other = ([float(x) for x in v] for v in unit(rng, 2, 8))
    rows = [(i, one) for i in range(3000)] + [(5000, other)]
    assert sorted(found(spark, rows)) == [(i, 2999, 0, i == 0) for i in range(3000)] + [(5000, 0, 5000, True)]


def test_beam_of_a_graph_finds_planted_neighbours():
    rng = np.random.default_rng(5)
    x = unit(rng, 3000, 32)
    graph = Graph(x)
    assert graph.count == 3000 and len(graph.links) > 2 and graph.least.min() > 0.999
    beam = graph.audited_beam(np.full(graph.count, 0.9))
    q = np.array([noisy(rng, v, 0.905) for v in x[:500]])
    hit, centre = graph.within(q, np.full(graph.count, 0.9), beam)
    assert (graph.row[centre] == hit).sum() >= 495 and beam < 500
