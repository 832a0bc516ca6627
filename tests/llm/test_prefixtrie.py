"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from winnow.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string, conv int, words string, shard int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1, "y", 2) for r in rows], SCHEMA)


def expected(rows):
    """Rows without equal turns in a conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def sums(p):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums(c) for c in children[p]]
        return (len(members[p]) - 1) * words + sum(b[0] for b in below), sum(b[1] for b in below) + (not below)

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        saved, leaves = sums(p)
        above = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), above, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **kw):
    df = prefixtrie.prefix_trie(table_of(spark, rows), **kw)
    assert df.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations():
    rows = []
    for c in range(130):
        kind = c % 7
        rows += [(c, t, "user" if t % 2 else "assistant", f"text {t} " * (1 + (t * kind) % 3)) for t in range(c % 6)]
        rows.append((c, 90, None, None if c % 2 else ""))
    rows += [(200, None, "system", "first"), (200, 0, "user", "second"), (207, 3, "user", " \t\n"), (219, 1, "a", "b")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (10**15, 0, "user", "x" * 100_000)]
    rows += [(-3, 0, "user", "below zero")]
    return rows


@pytest.mark.parametrize("shard_turns", [20, 1 << 16])
def test_trie_equals_a_dictionary_of_prefixes(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefixtrie, "SHARD_CONVERSATIONS", 9)
    rows = [r for r in conversations() if r[0] != -3]
    assert found(spark, rows, shard_turns=shard_turns) == expected(rows)


def test_a_conversation_that_many_ids_hold_and_a_deep_one(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 6000, 20) for t in range(3)]
    rows += [(6001, t, "user", f"deep {t}") for t in range(3000)]
    got = found(spark, rows, shard_turns=500)
    by = {(r[0], r[1]): r for r in got}
    ends = ",".join(str(c) for c in range(0, 6000, 20))
    assert by[0, 3][3:5] == (300, 0) and by[0, 3][7] == hashlib.sha256(ends.encode()).hexdigest()
    assert by[0, 0][3:7] == (301, 2, 2, 3 * 299 * 2) and by[6001, 3000 - (zlib.crc32(b"6001") % 4)][5] == 1


def test_equal_turns_have_a_defined_order_and_no_rows_no_nodes(spark):
    tied = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (20, 5, None, None), (-3, 0, "user", "x")]
    assert found(spark, tied) == found(spark, tied[::-1])
    assert len([r for r in found(spark, tied) if r[1] == 0]) == 1
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


def test_a_conversation_without_turns_left_ends_at_the_root(spark):
    short = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1][:1]
    rows = [(c, 0, "user", "only") for c in short]
    assert found(spark, rows) == expected(rows) and found(spark, rows)[0][1:6] == (0, None, 1, 0, 1)
