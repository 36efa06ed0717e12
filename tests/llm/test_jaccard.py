"""N-gram Jaccard join: components against brute force, hot groups, odd rows; components of links."""

import itertools
import random

import numpy as np

from sparkaudit.llm import jaccard as J
from sparkaudit.llm.components import components
from sparkaudit.llm.queries import op4_jaccard_join


def grams(text, n=4):
    words = (text or "").encode().lower().split()
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, percent=85):
    sets = {key: grams(text) for key, text in rows}
    parent = {key: key for key in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for key, own in sets.items():
        for g in own:
            where.setdefault(g, []).append(key)
    pairs = {p for keys in where.values() for p in itertools.combinations(sorted(keys), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {key: (len(sets[key]), top(key)) for key in sets}


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_components(docs, **how).collect()}


def varied(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 160))]
        if group % 3 == 0:
            base += passage
        rows += [(len(rows) + i * 7919 % 13 + 1000 * group, varied(rng, base, rng.randrange(0, 4))) for i in range(12)]
    rows = list({k: (k, t) for k, t in rows}.values())
    rows += [(90001, None), (90002, ""), (90003, " \t\n"), (90004, "one two"), (90005, "ONE  two"), (90006, "one two three four"), (90007, "a b c d " * 4000)]
    assert found(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    # Two edits each: about half of the pairs are linked.
    rows = [(i, varied(rng, base, 1 + i % 2)) for i in range(500)] + [(i, " ".join(base)) for i in range(500, 700)]
    assert found(spark, rows) == brute(rows)


def test_products_of_blocks_alone(spark, monkeypatch):
    """Without leaders every link comes from the products; a member brings few of its lists, a folded sketch."""
    monkeypatch.setattr(J, "LEADERS", ())
    monkeypatch.setattr(J, "LEAST_FIRSTS", 1)
    monkeypatch.setattr(J, "SKETCH", 1024)
    monkeypatch.setattr(J, "TILE", 16)
    rng = random.Random(14)
    base, long = [f"w{rng.randrange(5000)}" for _ in range(60)], [f"w{rng.randrange(9000)}" for _ in range(3000)]
    rows = [(i, varied(rng, base, 1 + i % 3)) for i in range(80)] + [(i, varied(rng, long, 40 * (i % 3))) for i in range(100, 112)]
    rows += [(200 + i, varied(rng, base[:30] + long[:90], i % 4)) for i in range(20)]
    assert found(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, 1), (None, text, 2), (7, text, 3), (7, text, 3), (9, text.upper(), 4), (8, None, 5)], "doc_id long, text string, n long")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in J.similar_components(docs).collect())
    assert got[:2] == [(-1, 37, None)] * 2 and got[2:] == [(7, 37, 7), (7, 37, 7), (8, 0, 8), (9, 37, 7)]


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 700), replace=False)) for _ in range(2))
        most = J.overlap_at_most(len(a), J.set_bits(a), len(b), J.set_bits(b))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))


def test_bitmaps_tell_sets_below_the_bound_apart():
    """Of pairs that share 0.8 of 400 n-grams nearly none may go on to be compared at 0.85."""
    rng = np.random.default_rng(2)
    passed = 0
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 444, dtype=np.uint64)
        a, b = np.unique(pool[:400]), np.unique(np.concatenate([pool[:356], pool[400:]]))
        most = J.overlap_at_most(len(a), J.set_bits(a), len(b), J.set_bits(b))
        passed += 100 * most >= 85 * (len(a) + len(b) - most)
    assert passed <= 10


def test_products_take_bitmaps_of_all_sizes():
    """The stacked bitmaps give every pair the bound that the two bitmaps have."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: 2 * k], k, replace=False)) for k in rng.integers(20, 1400, 60).tolist()]
    bits, n = [J.set_bits(s) for s in sets], np.array([len(s) for s in sets])
    size = np.unique([len(b) for b in bits], return_inverse=True)[1]
    assert len(set(size.tolist())) > 1
    rows, stacked = np.arange(len(sets)), J._stacked(bits)
    for percent in (20, 50):
        for row in rows.tolist():
            most = [J.overlap_at_most(n[row], bits[row], n[r], bits[r]) for r in rows.tolist()]
            want = [r for r, m in enumerate(most) if 100 * m >= percent * (n[row] + n[r] - m)]
            assert sorted(J._possible(row, rows, n, n, size, stacked, percent).tolist()) == want


def test_components(spark):
    rng = random.Random(13)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {x: x for link in links for x in link}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: c for x, c in parent.items() if any(x in link and link[0] != link[1] for link in links)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_jaccard_join(spark, d).collect()}
    assert got == brute(rows)
