"""Ranked lexical search against a plain loop, and its groups against all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from winnow.llm import lexical

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, n int, term string, score string, item int, rank int"
ITEMS = "item_id bigint, text string, term int, times string, doc_id int"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = 0
            for t, times in wanted.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, 1, "t", "s", 2, 3) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1, "x", 2) for r in items], ITEMS)
    df = lexical.search(d, i, **kw)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n=600):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(80)] + ["Ärger", "naïve", "X9", "É"])
    share = 1 / np.arange(1, len(words) + 1)
    docs = [(i, ", ".join(rng.choice(words, rng.integers(1, 120), p=share / share.sum()))) for i in range(n)]
    docs += [(5, "w70 w71 w71"), (5, "w70 w71 w71"), (5, "w1 w72"), (None, "w70 w71 w71"), (None, None), (900, ""), (901, "!?. \n")]
    docs += [(902, "w79 " * 50_000), (903, "W70-w71_w71"), (2**40, "w70 w71 w71")]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(25)]
    items += [(1, "W70 w71 W71"), (1, "W70 w71 W71"), (30, None), (31, "..."), (32, "unknown terms"), (None, "naïve w79 É"), (33, "w0 w0 w0")]
    return docs, items


@pytest.mark.parametrize("block_terms", [40, 200_000])
def test_search_equals_scoring_every_document(spark, monkeypatch, block_terms):
    docs, items = corpus()
    assert found(spark, docs, items, block_terms=block_terms) == expected(docs, items)


def test_small_shards_and_few_results(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 500)
    docs, items = corpus(300)
    assert found(spark, docs, items, k=3) == expected(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(5)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None)], items) == []


def test_bounds_leave_most_documents_unscored():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    terms = [sorted(rng.choice(200, 20, False).tolist()) for _ in range(4000)]
    lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, [[1] * 20] * 4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([40] * 4000), *lists], names=["doc_id", "n", "terms", "times"])
    shard = lexical.Shard(batch, np.arange(200, dtype=np.int64) + 1, 4000, 160_000)
    times, best = np.zeros(200, np.int64), []
    item = {t: 1 for t in range(0, 200, 20)}
    times[list(item)] = 1
    scored = shard.search(item, times, best, 10)
    held = sorted(((sum(shard.impact[a:b][times[shard.term[a:b]] > 0]), -d) for d, (a, b) in enumerate(zip(shard.offsets, shard.offsets[1:]))), reverse=True)
    assert sorted(((s, d) for s, _, d in best), reverse=True) == held[:10] and scored < 1000
