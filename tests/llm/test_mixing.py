"""Mixing: targets, totals near them, determinism, odd rows, expected shares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkaudit.llm import mixing as M
from sparkaudit.llm.queries import op9_mixing


def targets(sizes, weights=M.WEIGHTS, most=M.MOST):
    """Targets by raising all sources together; sizes in order, null last."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = (total - sum(out[i] for i in range(len(sizes)) if i not in open_)) / sum(weight[i] for i in open_)
        over = {i for i in open_ if weight[i] * share > most * sizes[i]}
        for i in over or open_:
            out[i] = most * sizes[i] if over else weight[i] * share
        if not over:
            break
        open_ -= over
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _d int, _s int")


def made(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "B", "é", None, "z"]
    rows = []
    for i in range(n):
        source = "a" if rng.random() < 0.4 else names[rng.integers(len(names))]
        words = int(rng.pareto(1.2) * 10) % 600
        rows.append((i, "w " * words, source, 1, 2))
    return rows


@pytest.mark.parametrize("fan", [64, M.FAN])
def test_totals_and_copies(spark, monkeypatch, fan):
    monkeypatch.setattr(M, "FAN", fan)
    rows = made() + [(90000, None, "a", 1, 2), (90001, "", None, 1, 2), (None, "x y", "tiny", 1, 2)]
    out = M.with_copies(docs_of(spark, rows)).select("doc_id", "source", f"{M.MIX}.*").collect()
    assert len(out) == len(rows)
    order = sorted({r["source"] for r in out if r["source"] is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s, *_ in rows if s == name) for name in order]
    for name, size, target in zip(order, sizes, targets(sizes)):
        own = [r for r in out if r["source"] == name]
        assert {r["source_size"] for r in own} == {size}
        assert all(abs(r["target"] - target) < 1e-6 for r in own)
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - target) <= max(r["size"] for r in own)
    for r in out:
        share = r["target"] / r["source_size"] if r["source_size"] else 0.0
        assert int(share) <= r["copies"] <= min(3, int(share) + 1)
    again = M.with_copies(docs_of(spark, rows).repartition(7)).select("doc_id", f"{M.MIX}.copies").collect()
    assert {(r["doc_id"], r["copies"]) for r in out} == {(r["doc_id"], r["copies"]) for r in again}


def test_rounding_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    mass, share = rng.integers(1, 200, 60).astype(float), rng.random(60)
    seen = np.zeros(60)
    for i in range(4000):
        out, at = M.rounded(mass, share, np.random.default_rng(i))
        assert abs((out * mass).sum() - (share * mass).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for j, x in enumerate(out) if j != at)
        seen += out
    assert np.abs(seen / 4000 - share).max() < 0.04


def test_repeated_rows_and_documents(spark):
    rows = [(1, "a b c", "s", 1, 2)] * 3 + [(i, "a b", "t", 1, 2) for i in range(10, 40)]
    docs = docs_of(spark, rows)
    copies = M.with_copies(docs).filter("doc_id = 1").select(f"{M.MIX}.copies").distinct().count()
    assert copies == 1
    out = M.mixed_documents(docs.withColumn("_mix", F.lit(0)))
    assert out.columns == [*docs.columns, "_mix"]
    taken = M.with_copies(docs).agg(F.sum(F.col(f"{M.MIX}.copies"))).first()[0]
    assert out.count() == taken


def test_empty_and_wordless(spark):
    assert M.with_copies(docs_of(spark, [])).count() == 0
    out = M.with_copies(docs_of(spark, [(1, None, None, 1, 2), (2, " ", "a", 1, 2)])).select(f"{M.MIX}.*").collect()
    assert [(r["size"], r["copies"], r["target"]) for r in out] == [(0, 0, 0.0)] * 2


def test_query(spark):
    d = "/root/testdata/sf0.001"
    out = op9_mixing(spark, d).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r["doc_id"] for r in out} == set(docs) and len(out) == len(docs)
    for r in out:
        assert r["size"] == len((docs[r["doc_id"]]["text"] or "").encode().split())
        assert r["taken"] <= 3 * r["size"]


def test_null_and_long_ids_keep_every_row(spark):
    ids = [None, 2**60 + 1, 2**60 + 2, 2**60 + 3, -(2**63), 2**63 - 1]
    rows = [(i, "w " * (3 + n % 5), s, 1, 2) for n, i in enumerate(ids) for s in ("a", "b", None)]
    out = M.with_copies(docs_of(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["source"])) for r in out) == sorted(str((r[0], r[2])) for r in rows)
