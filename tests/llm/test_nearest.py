"""Nearest neighbours against brute force: ties, repeated vectors, odd vectors, small blocks."""

import math

import numpy as np
import pytest

import oracle
from sparkaudit.llm import nearest as N
from sparkaudit.llm import queries as Q


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, asked, k):
    rows = [(i, tuple(v)) for i, v in {(i, tuple(v)) for i, v in rows if i is not None and usable(v)}]
    queries = {}
    for i, v in asked:
        if i is not None and usable(v):
            queries[i] = min(queries.get(i, tuple(v)), tuple(v))
    out = []
    for i, v in queries.items():
        near = sorted(
            (math.sqrt(float(np.cumsum(np.square(np.array(w) - np.array(v)))[-1])), j)
            for j, w in rows if j != i and len(w) == len(v)
        )[:k]
        out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(N.CANDIDATE_BLOCK, N.QUERY_BLOCK), (40, 3)])
def test_against_brute_force(spark, blocks):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 2.0]) for i in range(300, 400)]  # one vector of many ids
    rows += [(i, np.round(rng.normal(size=6)).tolist()) for i in range(400, 460)]  # ties
    rows += [(5, [9.0] * 6), (5, [9.0] * 6), (6, [9.0] * 6), (None, [1.0] * 6), (500, None), (501, [0.0] * 6), (502, []),
             (503, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (504, [float("nan")] * 6), (505, [float("inf")] + [1.0] * 5),
             (506, [1.0, 2.0]), (507, [1.0, 3.0]), (508, [1e200] * 6), (509, [-1e200] * 6), (510, [1e-200] * 6)]
    schema = "vec_id long, embedding array<double>, label int, across int"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    ids = [0, 3, 5, 300, 350, 410, 500, 501, 504, 506, 508, 510]
    got = N.nearest(df, df.filter(df.vec_id.isin(ids)), 10, candidate_block=blocks[0], query_block=blocks[1])
    want = brute(rows, [r for r in rows if r[0] in ids], 10)
    assert sorted(map(tuple, got.collect())) == want


def test_few_candidates_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5])], schema)
    assert sorted(map(tuple, N.nearest(df, df).collect())) == [(1, 1, 2, 0.5), (2, 1, 1, 0.5)]
    none = spark.createDataFrame([], schema)
    assert N.nearest(none, none).count() == 0 and N.nearest(df, none).count() == 0 and N.nearest(none, df).count() == 0


def test_thinning_keeps_smallest_ids():
    m = np.array([[1.0, 2.0]] * 30 + [[0.0, 1.0]] * 2)
    ids = np.arange(32)[::-1].copy()
    kept = N.thinned(ids, m, 3)
    assert sorted(ids[kept].tolist()) == [0, 1, 2, 3, 4, 5]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    assert oracle.difference(spark, oracle.connect(d), Q.op10_nearest, Q.NEAREST_SQL, d) == ""
