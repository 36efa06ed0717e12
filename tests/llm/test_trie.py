"""Prefix trie: nodes against brute force, long shared conversations, odd rows, the contract's rebuilt conversations."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkaudit.llm import trie as T
from sparkaudit.llm.queries import op11_prefix_trie

TURNS = "conv_id long, turn long, role string, text string, node int, place int"


def key(turn):
    """Order of turns: number, null first, then the turn's id."""
    number, role, text = turn
    raw = f"{len(role.encode())}:{role}{text}".encode()
    return (number is not None, number or 0, hashlib.sha256(raw).digest()[:12] + len(text.encode()).to_bytes(4, "big"))


def ordered(rows):
    """conv -> turns (role, text) in order."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            out[conv].append((turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns, key=key)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(head, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        above = members[p[:-1]][0] if p else None
        out.add((m[0], len(p), above, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(df):
    rows = [tuple(r[c] for c in NAMES) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(n=120, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(rng.integers(1, 14)):
            rows.append((c * 3, t, ["user", None, "bot"][rng.integers(3)], ["a", "bé", "", None][rng.integers(4)], 1, 2))
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_against_brute_force(spark, width):
    rows = made()
    # Long conversations that share most of their turns, one that goes on alone, and equal ones.
    rows += [(c, t, "u", f"t{t}" if t < 70 else f"{c}-{t}", 1, 2) for c in (1000, 1001, 1003) for t in range(75)]
    rows += [(c, t, "u", "same", 1, 2) for c in range(20000, 20040) for t in range(3)]
    placed = T.numbered(spark.createDataFrame(rows, TURNS))
    totals = placed.groupBy("conv").count().withColumnRenamed("count", "total")
    assert nodes(T.prefix_trie(placed, totals, width)) == brute(ordered(rows))


def test_odd_rows_and_rebuilt_conversations(spark):
    rows = made(60, 2) + [
        (None, 1, "u", "x", 1, 2), (7, None, "u", "first", 1, 2), (7, 0, "u", "x", 1, 2), (7, 0, "u", "x", 1, 2), (7, 0, "b", "x", 1, 2),
        (-3, 5, None, None, 1, 2), (2**63 - 1, 0, "u", "é" * 100000, 1, 2), (2**60 + 1, 0, "u", "x", 1, 2), (4, 9, "1", ":a", 1, 2), (9, 9, "1:", "a", 1, 2),
    ]
    got = nodes(T.prefix_trie(*T.grafted(T.numbered(spark.createDataFrame(rows, TURNS)))))
    want = rebuilt(ordered(rows))
    assert any(not turns for turns in want.values())
    assert got == brute(want)


def test_hot_conversation_is_cut_by_ranges(spark, many_segments):
    rows = [(5, t, "u", f"t{t % 7}", 1, 2) for t in range(400)] + [(6, t, "u", f"t{t % 7}", 1, 2) for t in range(390)]
    placed = T.numbered(spark.createDataFrame(rows, TURNS))
    totals = placed.groupBy("conv").count().withColumnRenamed("count", "total")
    assert nodes(T.prefix_trie(placed, totals)) == brute(ordered(rows))


def test_empty(spark):
    placed = T.numbered(spark.createDataFrame([], TURNS))
    assert T.prefix_trie(*T.grafted(placed)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(op11_prefix_trie(spark, d)) == brute(rebuilt(ordered(rows)))
