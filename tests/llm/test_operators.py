"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnow.llm import (
    components,
    decontaminate,
    langid,
    mixing,
    neardup,
    pii,
    shingles,
    suffixes,
    tokencount,
    toxicity,
    urls,
    vptree,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score string, id int, _id int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang[, source]]), with extra columns whose names clash."""
    full = [(*r, *("en", "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, 0, 7, "x", 1, 2) for r in full], DOCS)


WORDS = [f"w{i}x" for i in range(400)]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


LONG = prose(1, 3000)
BASE = prose(2, 300)
TEXTS = [
    (1, BASE),
    (2, BASE),
    (3, edited(BASE, [10, 150])),
    (4, edited(BASE, [10, 30, 50, 70, 90, 110, 130])),
    (5, BASE.upper()),
    (6, LONG),
    (7, LONG + " tail"),
    (8, None),
    (9, ""),
    (10, " \n\t "),
    (11, "one two"),
    (12, "one two"),
    (12, "one two"),
    (13, "One Two three four"),
    (None, BASE),
    (14, "naïve café ñandú " * 30),
    (15, "naïve café ñandú " * 30 + "z"),
]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_near_duplicates_equal_brute_force(spark):
    rows = neardup.near_duplicates(docs_of(spark, TEXTS)).drop("text_hash").collect()
    sets = [(d, shingle_set(t)) for d, t in TEXTS]
    best = {d: d for d, _ in sets if d is not None}
    for _ in sets:
        for a, x in sets:
            for b, y in sets:
                if None not in (a, b) and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    best[a] = best[b] = min(best[a], best[b])
    expected = sorted((d, len(s), best.get(d), d == best.get(d)) for d, s in sets if d is not None)
    assert sorted(tuple(r) for r in rows if r.doc_id is not None) == expected
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_large_near_copy_group_is_one_component_without_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = prose(9, 200)
    rows = [(i, edited(base, rng.choice(200, rng.integers(0, 9), False))) for i in range(700)]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(700):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert found == {i: find(i) for i in range(700)}


def test_sketch_places_agree_as_often_as_sets(spark):
    x = np.arange(1000, dtype=np.uint64)
    one, two = neardup.sketches([shingles.mix(x), shingles.mix(x + np.uint64(200))])
    assert abs((one == two).mean() - 800 / 1200) < 0.15
    assert (neardup.sketches([np.array([3], np.uint64)]) != 2**64 - 1).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 3)]
    rows = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in rows} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def windows(words, sizes):
    return {tuple(words[i : i + s]) for s in sizes for i in range(len(words) - s + 1)}


def test_decontamination_equals_brute_force(spark):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    passage = prose(20, 14)
    items = [(1, passage), (1, passage), (2, "short item"), (3, None), (4, ""), (5, prose(21, 10)), (6, "SHORT, item!")]
    docs = [
        (1, f"{prose(22, 40)} {passage} {prose(23, 30)}"),
        (2, f"x {passage.upper()} y {passage}"),
        (3, " ".join(passage.split()[:9])),
        (4, "a SHORT-item here, short item"),
        (5, None),
        (6, ""),
        (7, prose(21, 10)),
        (7, prose(21, 10)),
        (7, "other text of the same id"),
        (None, passage),
        (8, LONG),
    ]
    wanted = []
    spelt = {i: pattern.findall((t or "").translate(UPPER)) for i, t in items}
    for d, text in docs:
        words, hit, found = pattern.findall((text or "").translate(UPPER)), set(), set()
        for item, own in spelt.items():
            size = min(10, len(own))
            for w in windows(own, [size]) if own else ():
                for i in range(len(words) - size + 1):
                    if tuple(words[i : i + size]) == w:
                        hit.update(range(i, i + size))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        wanted.append((d, len(words), len(hit), len(found), digest, len(hit) > 0))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in decontaminate.decontamination(docs_of(spark, docs), table).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    none = decontaminate.decontamination(docs_of(spark, docs), table.where("false"))
    assert none.where("contaminated or n_items > 0").count() == 0


def test_suffix_dedup_equals_brute_force(spark):
    shared = prose(30, 25)
    rows = [
        *TEXTS,
        (20, f"{prose(31, 40)} {shared} {prose(32, 9)}"),
        (21, f"{prose(33, 10)} {shared}"),
        (22, "ab" * 400),
        (23, "ab" * 300),
        (24, shared[:49]),
        (25, shared[:50]),
    ]
    first, wanted = {}, []
    for d, text in sorted((r for r in rows if r[0] is not None)):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], d) < d:
                cover[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = len(re.findall(b"\1+", bytes(cover)))
        wanted.append((d, len(raw), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffixes.suffix_dedup(docs_of(spark, rows)).collect()]
    assert sorted(g for g in got if g[0] is not None) == sorted(wanted)
    assert [g[2] for g in got if g[0] is None] == [0]


def test_suffix_dedup_deals_strings_of_hot_anchors(spark):
    shared = prose(61, 60)
    rows = [(i, f"{prose(i + 2000, 12)} {shared[: 200 + i]} {prose(i + 2500, 9)}") for i in range(60)]
    rows += [(100, "one line of text, again. " * 60), (101, "one line of text, again. " * 40), (60, rows[3][1]), (7, prose(70, 30) + shared)]
    docs = docs_of(spark, [*TEXTS, *((d + 50, t) for d, t in rows)])
    whole = sorted(map(tuple, suffixes.remove_repeats(docs, hot=1 << 40).collect()), key=repr)
    for hot in (0, 3, 40):
        assert sorted(map(tuple, suffixes.remove_repeats(docs, hot=hot).collect()), key=repr) == whole
    # What a bucket of anchors gets of the passage that all share.
    texts = pa.table({"id": [d for d, _ in rows], "th": [0] * len(rows), "text": [t for _, t in rows], "copy": [False] * len(rows)})
    packed = pa.Table.from_batches(list(suffixes.anchor_rows(1)(iter(texts.to_batches()))))
    sizes = []
    for hot in (1 << 40, 8):
        told = suffixes.shared_rows(1, hot)((0,), packed)
        runs = suffixes.run_rows(1)((pa.scalar(0),), texts, told).to_pylist()
        sizes.append(sum(len(r["ids"]) // 8 for r in runs if r["bucket"] == 0))
    assert sizes[0] > 300 and sizes[1] < sizes[0] / 4


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(3)
    runs = []
    for _ in range(7):
        words = [bytes(rng.choice([97, 98], rng.integers(1, 12)).tolist()) for _ in range(rng.integers(0, 60))]
        rows = np.zeros((len(words), 50), np.uint8)
        for i, w in enumerate(words):
            rows[i, : len(w)] = np.frombuffer(w, np.uint8)
        runs.append((words, rows, np.array([len(w) for w in words], np.int64)))
    coded = []
    for words, rows, sizes in runs:
        if words:
            _, _, prefix, size, tails = suffixes.front_coded(rows, sizes)
            coded.append(list(suffixes.decoded(prefix.astype(np.uint8).tobytes(), size.astype(np.uint8).tobytes(), tails)))
    out = list(suffixes.merged([iter(c) for c in coded]))
    assert [w for _, w, _ in out] == sorted(w for c in coded for _, w in c)
    before = b""
    for shared, word, _ in out:
        real = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
        assert shared == (0 if before == b"" else real)
        before = word


def test_vp_tree_factor_one_is_exact_and_ties_go_to_small_ids(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((900, 16)).astype(np.float32)
    vectors[100:160] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0] * 3), (1200, [2.0] * 3), (1250, [])]
    table = spark.createDataFrame([(*r, 0, "q") for r in [*rows, *odd]], "vec_id bigint, embedding array<float>, label int, rank string")
    got = {}
    for r in vptree.nearest(table, F.col("vec_id") % 50 == 0, factor=1.0, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    x = vectors.astype(float)
    for q in range(0, 900, 50):
        score = vptree.cosine(x, np.repeat(x[q : q + 1], len(x), 0))
        score[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(900), -score))[:5].tolist()
    assert got[1150] == [1200] and got[1200] == [1150]
    assert set(got) == {*range(0, 900, 50), 1150, 1200}


def test_vp_tree_recall_at_the_production_factor_over_shards(spark):
    rng = np.random.default_rng(21)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, 2400)] + 0.6 * rng.standard_normal((2400, 32))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in vptree.nearest(table, F.col("vec_id") % 20 == 0, shard_rows=300).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    x, hits = x.astype(float), 0
    for q in range(0, 2400, 20):
        score = vptree.cosine(x, np.repeat(x[q : q + 1], len(x), 0))
        score[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(2400), -score))[:5].tolist()))
    print("recall", hits / 600)
    assert hits >= 0.95 * 600


def nearest_by_brute_force(x, q, ids=None, k=5):
    """Ids of the k nearest rows of row q; of `ids` when a row's id is not its place."""
    ids = np.arange(len(x)) if ids is None else ids
    score = vptree.cosine(x, np.repeat(x[q : q + 1], len(x), 0))
    score[ids == ids[q]] = -np.inf
    return ids[np.lexsort((ids, -score))[:k]].tolist()


def test_vp_tree_tiles_of_shards_and_blocks_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vptree, "BLOCK", 40)
    monkeypatch.setattr(vptree, "TREES", 2)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((900, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame([*rows, (1150, [1.0] * 3), (1200, [2.0] * 3)], "vec_id bigint, embedding array<float>")
    assert vptree._grid(902, 902, 10, 23, 16, 100, 8) == (5, 5)
    got = {}
    found = vptree.nearest(table, F.col("vec_id") >= 0, factor=1.0, shard_rows=100)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    x = vectors.astype(float)
    assert all(got[q] == nearest_by_brute_force(x, q) for q in range(900))
    assert got[1150] == [1200] and got[1200] == [1150] and len(got) == 902
    # The copies of the queries for all shards grow with the square of the table.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_vp_tree_copies_among_few_and_among_many_rows(spark):
    rng = np.random.default_rng(6)
    # 30 of 600 rows share a vector, then 400 do; some rows come twice, and the two zeros are equal.
    for n in (30, 400):
        x = rng.standard_normal((600, 8))
        x[:n] = x[0]
        x[:n, 3] = np.where(np.arange(n) % 2, 0.0, -0.0)
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        rows += rows[:3] + rows[-3:]
        for kind in ("float", "double"):
            table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
            exact = x.astype(np.float32).astype(float) if kind == "float" else x
            got = {}
            found = vptree.nearest(table, F.col("vec_id") % 7 == 0, factor=1.0, shard_rows=100)
            for r in found.orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            assert got == {q: nearest_by_brute_force(exact, q) for q in range(0, 600, 7)}
        kept, count = vptree._first_ids(table.selectExpr("vec_id as id", "embedding as vector", "size(embedding) as size"), 5)
        assert kept.distinct().count() == 600 - n + 6
        assert count == kept.count() == 600 - n + 6


def test_langid_learns_labels_positions_and_leaves_letterless_text(spark):
    kinds = {"aa": "bababa daba", "bb": "xyz zyxx qz"}
    rows = [(i, " ".join([kinds[k]] * (1 + i % 9)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    more = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "aa"), (903, "bababa", None), (903, "bababa", None)]
    docs = docs_of(spark, [*rows, *more])
    found = langid.langid(docs).collect()
    assert len(found) == 125
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == k for i, _, k in rows)
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found)
    model = langid.fit(docs)
    labels = langid.position_labels(model, "bababa daba " * 20 + "xyz zyxx qz " * 20)
    assert Counter(labels[:200])["aa"] > 180 and Counter(labels[-200:])["bb"] > 180
    assert langid.identify(docs.where("false"), model).count() == 0


def test_gru_gradients_match_differences():
    rng = np.random.default_rng(1)
    params = langid.start_params(3, rng)
    x, y = rng.integers(1, 40, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    mask = np.ones(x.shape, np.float32)
    _, grads = langid.gradients(params, x, mask, y)
    for name in params:
        flat = np.abs(grads[name]).reshape(-1)
        place = np.unravel_index(int(flat.argmax()), params[name].shape)
        losses = []
        for step in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in params.items()}
            moved[name][place] += step
            losses.append(langid.gradients(moved, x, mask, y)[0])
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(float(grads[name][place]), rel=0.1, abs=1e-3)


def test_toxicity_learns_and_scores_every_text(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, prose(1000 + i, 20) + (" You IDIOT " if bad else " friend ") + prose(i, 5)))
        labels.append((i, 1, int(bad)))
    labels += [(1000, 1, None), (1001, 1, 7), (0, 1, 1)]
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, LONG)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, rows)
    found = toxicity.toxicity(docs, table).collect()
    assert len(found) == len(rows)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in found if r.doc_id < 300)
    assert toxicity.keep_clean(docs, table).schema == docs.schema
    assert toxicity.keep_clean(docs, table).where("doc_id < 300 and doc_id % 3 != 0").count() == 200
    assert toxicity.keep_clean(docs, table).where("doc_id < 300 and doc_id % 3 = 0").count() == 0
    flat = toxicity.toxicity(docs, table.where("false")).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]
    assert toxicity.toxicity(docs.where("false"), table).count() == 0


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = []
    for source, n in (("a", 400), ("b", 300), ("c", 20), (None, 150)):
        rows += [(len(rows) + i, "w " * int(rng.integers(1, 90)), "en", source) for i in range(n)]
    rows += [(5000, None, "en", "a"), (5001, "", "en", "empty"), (5002, "w", "en", "a"), (5002, "w", "en", "a")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = Counter()
    for d, t, _, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * level >= 3 * size[s]}
        if not over:
            break
        capped |= over
    source_of = {d: s for d, _, _, s in rows}
    taken = Counter()
    for r in got:
        s = source_of[r.doc_id]
        target = 3 * size[s] if s in capped else weight[s] * level
        assert (r.source_size, r.target) == (size[s], pytest.approx(target)) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        target = 3 * size[s] if s in capped else weight[s] * level
        assert abs(taken[s] - target) <= 45
    assert mixing.mix(docs_of(spark, rows).where("false")).count() == 0


def brute_pieces(word, vocabulary):
    count = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return 1
        count, at = count + 1, end
    return count


def test_automaton_counts_greedy_pieces(spark):
    rng = np.random.default_rng(2)
    for _ in range(30):
        vocabulary = {"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(rng.integers(1, 25))}
        automaton = tokencount.Automaton(vocabulary)
        for _ in range(60):
            word = "".join(rng.choice(list("abcd"), rng.integers(0, 14), p=[0.32, 0.32, 0.32, 0.04]))
            assert automaton.count(word) == brute_pieces(word, vocabulary), (word, vocabulary)
    marked = tokencount.Automaton(["un", "##aff", "##able", "a", "##ff"], continuation="##")
    assert [marked.count(w) for w in ("unaffable", "unaffx", "aff", "un")] == [3, 1, 2, 1]
    docs = docs_of(spark, [(1, None), (2, ""), (3, "Hello, naïve World 42!"), (3, "Hello, naïve World 42!"), (4, LONG)])
    rows = {r.doc_id: r for r in tokencount.count_tokens(docs).collect()}
    assert (rows[1].n_tokens, rows[2].n_tokens, rows[3].n_words) == (0, 0, 7)
    assert rows[4].n_tokens >= 3000


def test_end_mark_is_one_sign_with_the_last(spark):
    def brute(word, vocabulary):
        count = at = 0
        while at < len(word):
            rest = word[at:] + "</w>"
            # A token with the mark closes a word; its signs match none inside.
            inside = (e for e in range(len(word) - 1, at, -1) if word[at:e] in vocabulary and not word[at:e].endswith("</w>"))
            end = len(word) if rest in vocabulary else next(inside, None)
            if end is None:
                return 1
            count, at = count + 1, end
        return count

    rng = np.random.default_rng(12)
    for _ in range(60):
        vocabulary = {"".join(rng.choice(list("ab</w>"), rng.integers(1, 6))) for _ in range(rng.integers(1, 25))}
        vocabulary = {v for v in vocabulary if not v.endswith("</w>")} | {*"</w>"} | {"</w>"}
        vocabulary |= {v + "</w>" for v in rng.choice(sorted(vocabulary), 12)}
        automaton = tokencount.Automaton(vocabulary, end="</w>")
        for _ in range(60):
            word = "".join(rng.choice(list("ab</w>"), rng.integers(1, 12)))
            assert automaton.count(tokencount.closed(word, "</w>")) == brute(word, vocabulary), (word, vocabulary)
    tokens = tokencount.read_tokens(tokencount.VOCABULARY)
    counting = tokencount.Counting(tokens, tokencount.WORD, tokencount.END)
    assert [counting.of_word(w) for w in ("für", "thre", "the")] == [3, 2, 1]
    known = set(tokens)
    alphabet = tokencount.byte_alphabet()
    for word in {w.lower() for w in re.findall(r"\w+", LONG + " für thre naïve größe überall entreprise ñandú")}:
        if word.isalpha():
            assert counting.of_word(word) == brute("".join(alphabet[b] for b in word.encode()), known), word


def test_urls(spark):
    given = [
        (1, "http://www.Example.com/en/1"),
        (2, "https://m.example.com/en/"),
        (3, "http://example.com/de/x?q=://y"),
        (4, "http://a.net/fr/9#x"),
        (5, "http://a.net"),
        (6, "http://free-bets.example.org/x"),
        (7, "http://freebets.example.org/x"),
        (8, "http://spam.example.org/"),
        (9, None),
        (10, ""),
        (11, "no scheme casino"),
        (12, "http://notexample.com/en/"),
        (13, "http://free.example.org/FREE"),
        (13, "http://free.example.org/FREE"),
    ]
    rows = urls.url_filter(spark.createDataFrame([(*g, "h", 1) for g in given], "page_id int, url string, html string, host int"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows.collect()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("m.example.com", "/en/", "example.com/en/", "block"),
        3: ("example.com", "/de/x", "com/", "allow"),
        4: ("a.net", "/fr/9", "net/fr/", "block"),
        5: ("a.net", "", None, "allow"),
        6: ("free-bets.example.org", "/x", None, "block"),
        7: ("freebets.example.org", "/x", None, "allow"),
        8: ("spam.example.org", "/", None, "block"),
        9: ("", "", None, "allow"),
        10: ("", "", None, "allow"),
        11: ("", "", None, "block"),
        12: ("notexample.com", "/en/", "com/", "allow"),
        13: ("free.example.org", "/FREE", None, "allow"),
    }


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m[0])]


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(6)
    signs = list("a.@-+1234 5(é_4")
    for _ in range(4000):
        text = "".join(rng.choice(signs, rng.integers(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    card = "4088 4956 9889 7153"
    text = f"ümlaut a.b@c.d_e@f.g 999.1.1.1 1.2.3.4.5 {card} +1 (988) 555-2485"
    assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("a" * 200_000 + " b@c" + "1" * 200_000) == []


def test_pii_adds_disclosing_terms_and_sanitises(spark):
    rows = [(i, f"{prose(i, 30)} write {prose(i + 500, 1)} Smithers at m.burns@plant.example.com {prose(i + 900, 20)}") for i in range(8)]
    rows += [(100 + i, prose(i + 40, 60) + " write at") for i in range(200)]
    rows += [(400, None), (401, ""), (402, "Call +1 (988) 555-2485 now"), (402, "Call +1 (988) 555-2485 now"), (403, "Smithers sleeps")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in pii.pii(docs).collect()}
    assert got[400].spans == "" and got[400].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[402].n_phone, got[402].spans) == (1, "phone:5:22")
    text = dict(rows)[0]
    at = text.index("Smithers")
    assert f"term:{at}:{at + 8}" in got[0].spans and got[0].spans.startswith("email:") and got[0].n_email == 1
    assert got[403].spans == ""
    clean = pii.sanitised(docs)
    assert clean.schema == docs.schema and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "burns" not in texts[0] and "[EMAIL]" in texts[0] and "Smithers" not in texts[0]
    assert texts[100] == dict(rows)[100] and texts[400] is None and texts[402] == "Call [PHONE] now"
    assert pii.pii(docs.where("false")).count() == 0


def plain_terms(rows):
    """Term spans by doc_id, from counts of every (entity, word) pair."""
    words = [{w.translate(UPPER) for w in pii._WORDS.findall(t)} for _, t in rows]
    spans = [pii.base_spans(t) for _, t in rows]
    names = [{pii.entity(k, t[a:b]) for k, a, b in s} for (_, t), s in zip(rows, spans)]
    free = [{w for w, _, _ in pii.outside(t, s)} for (_, t), s in zip(rows, spans)]
    df, de = Counter(w for x in words for w in x), Counter(e for x in names for e in x)
    both = Counter((e, w) for x, y in zip(names, free) for e in x for w in y)
    texts = {t: (x, y) for (_, t), x, y in zip(rows, names, free)}
    support = Counter((e, w) for x, y in texts.values() for e in x for w in y)
    n, score = len(rows), {}
    for (e, w), k in both.items():
        share, square = k / df[w], pii.CONFIDENCE**2
        trials = support[e, w] / share
        spread = np.sqrt(share * (1 - share) / trials + square / (4 * trials**2))
        low = (share + square / (2 * trials) - pii.CONFIDENCE * spread) / (1 + square / trials)
        score[e, w] = np.log(n * low / de[e]) / np.log(n / de[e])
    wanted = {}
    for (d, t), s, own in zip(rows, spans, names):
        found = [(a, b) for w, a, b in pii.outside(t, s) if max([score.get((e, w), 0) for e in own] or [0]) >= pii.GENERALISE]
        wanted[d] = [f"term:{a}:{b}" for a, b in found]
    return wanted


def test_pii_judges_every_word_of_texts_with_an_entity(spark):
    far = prose(3, 12)
    holds = [(i, f"Bo {prose(i, 40)} Zorba {far} {prose(i + 50, 30)} z.k@far.example.org {prose(i + 80, 9)} Zorba {far} ox{i}") for i in range(5)]
    other = [(20 + i, prose(i + 300, 60)) for i in range(200)]
    # A third of the rows with one entity, in different texts, whose words stand in other rows too.
    hot = [(300 + i, f"{prose(i + 700, 12)} Quill {prose(i + 1200, 9)} hot@far.example.org") for i in range(100)]
    rows = [*holds, (5, holds[0][1]), *other, *hot, (900, "Zorba and Bo dance"), (901, "Bo at other@far.example.org")]
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.pii(docs_of(spark, rows)).collect()}
    assert got == plain_terms(rows) and got[5] == got[0] and not got[900]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(spark, rows)).select("doc_id", "text").collect()}
    # Far from the address, at both places, two characters long; a word of one text is no evidence.
    assert all("Zorba" not in clean[i] and not clean[i].startswith("Bo ") for i in range(6)) and "ox3" in clean[3]
    assert "Quill" not in clean[350] and clean[900] == "Zorba and Bo dance"


def test_pii_judges_entities_of_one_and_two_texts(spark):
    huge = "q" * 300
    one = (1, f"{prose(1, 5)} Ozymandias {huge} {prose(2, 5)} king@sand.example.org or +1 (988) 555-2485")
    two = [(2 + i, f"{prose(9 + i, 4)} Kublai {prose(19 + i, 4)} khan@xanadu.example.org both@far.example.org") for i in range(2)]
    copies = [(10 + i, "Alph runs to alph@sea.example.org") for i in range(40)]
    rows = [one, *two, *copies, *((100 + i, prose(i + 60, 25)) for i in range(1500))]
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.pii(docs_of(spark, rows)).collect()}
    assert got == plain_terms(rows)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs_of(spark, rows)).select("doc_id", "text").collect()}
    assert "[NAME] [WORD]" in clean[1] and huge not in clean[1] and not any("Kublai" in clean[i] for i in (2, 3))
    # Copies of one text count as one, and what many rows hold has little left to disclose.
    assert all(clean[10 + i] == "Alph runs to [EMAIL]" for i in range(40))


def test_rows_without_an_id_are_not_held_out(spark):
    docs = spark.createDataFrame(
        [(i, prose(i, 20), "en") for i in range(12)] + [(None, prose(99, 20), "en")], "doc_id long, text string, lang string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    for rows, remainder in ((langid.langid(docs), (4, 2)), (toxicity.toxicity(docs, labels), (5, 0))):
        found = {r.doc_id: r.held_out for r in rows.collect()}
        assert len(found) == 13 and found.pop(None) is False
        assert all(out == (crc32(str(i).encode()) % remainder[0] == remainder[1]) for i, out in found.items())


def test_empty_tables(spark):
    none = docs_of(spark, TEXTS).where("false")
    assert neardup.minhash_dedup(none).count() == 0
    assert suffixes.suffix_dedup(none).count() == 0
    assert decontaminate.decontamination(none, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert tokencount.token_counts(none).count() == 0
    assert vptree.neighbours(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert langid.langid(none).count() == 0


def test_toxicity_features_of_long_texts_and_packed_rows():
    features = toxicity.Featuriser()
    words = " ".join(f"w{i}é" for i in range(40_000))
    for text in (words, words[: toxicity.PIECE - 2], words[: toxicity.PIECE + 2], words[: toxicity.PIECE + 3], "ab", "", None):
        whole = features._piece(np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), np.uint32))
        assert np.array_equal(np.sort(features(text)), np.sort(whole))
    packed = toxicity.Packed()
    packed.add([words, "", "a few words"], features)
    assert [packed.row(i).tolist() for i in range(3)] == [sorted(features(t).tolist()) for t in (words, "", "a few words")]
