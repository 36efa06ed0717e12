"""The corpus pipeline: its stages on hand-made documents, and the chain on the smallest tables."""

import random

import corpus_pipeline as P
import sparkaudit.llm.common as C
import pytest
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice("klmnop") + str(rng.randrange(9)) for _ in range(n))


def test_order_of_stages():
    assert [name for name, _ in P.STAGES] == ["language_id", "near_copies", "decontamination", "secret_scan", "mix"]


def test_language_id(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = docs_of(spark, [(9001, None, "en", "s", 0), (9002, "... 123", "de", "s", 7), (9003, "", None, None, None)])
    out = P.language_id(spark, docs.unionByName(odd), D)
    assert out.columns == COLUMNS
    kept = {r["doc_id"] for r in out.collect()}
    assert not kept & {9001, 9002, 9003} and len(kept) >= 0.99 * docs.count()


def test_near_copies(spark):
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [(7, base), (3, base + " more"), (12, base), (5, words(rng, 80)), (6, None), (8, ""), (None, base), (20, words(rng, 80))]
    out = P.near_copies(spark, docs_of(spark, [(i, t, "en", "s", 1) for i, t in rows]), D)
    assert out.columns == COLUMNS
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 5, 6, 8, 20]


def test_near_copies_by_rows(spark):
    rng = random.Random(6)
    base, other, alone, none = (words(rng, 100) for _ in range(4))
    rows = [
        (3, base, "en", "a", 1), (3, base, "en", "b", 1), (3, base, "en", "a", 1), (9, base + " more", "en", "a", 1),
        (5, other, "en", "a", 1), (7, other + " more", "en", "a", 1), (7, alone, "en", "a", 1),
        (None, none, "en", "a", 1), (None, none, "en", "a", 1), (None, none + " more", "en", "b", 1), (None, None, "en", "a", 1),
    ]
    out = P.near_copies(spark, docs_of(spark, rows), D).collect()
    assert sorted((r["doc_id"] or 0 for r in out)) == [0, 0, 3, 5, 7]
    assert {r["text"] for r in out if r["doc_id"] == 7} == {alone}
    assert sum(r["doc_id"] is None and r["text"] is not None for r in out) == 1


def test_near_copies_at_the_bound(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles of five words
    more = lambda n: " ".join(base + [f"m{i}" for i in range(n)])
    long = [f"v{i}" for i in range(1000)]

    def edited(n):
        return " ".join(f"e{i}" if i % 43 == 20 and i // 43 < n else w for i, w in enumerate(long))

    # 100/120, 100/125 and 886/1106 go; 100/126 and 881/1111 stay.
    rows = {1: more(0), 2: more(20), 11: " ".join(long), 12: edited(22)}
    edges = [{1: more(0), 2: more(25)}, {1: more(0), 2: more(26)}, {1: " ".join(long), 2: edited(23)}]
    kept = []
    for texts in [rows, *edges]:
        docs = docs_of(spark, [(i, t, "en", "s", 1) for i, t in texts.items()])
        kept.append(sorted(r["doc_id"] for r in P.near_copies(spark, docs, D).collect()))
    assert kept == [[1, 11], [1], [1, 2], [1, 2]]


def test_decontamination(spark):
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    rng = random.Random(5)
    rows = [(1, words(rng, 50)), (2, words(rng, 30) + " " + item + " " + words(rng, 30)), (3, None)]
    out = P.decontamination(spark, docs_of(spark, [(i, t, "en", "s", 1) for i, t in rows]), D)
    assert out.columns == COLUMNS and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_secret_scan(spark):
    rows = [(1, "token=abcdefgh12 rest", "en", "s", 21), (2, "clean", "en", "s", 5), (3, None, "en", "s", None)]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.secret_scan(spark, docs_of(spark, rows), D).collect()}
    assert out == {1: ("[SECRET] rest", 13), 2: ("clean", 5), 3: (None, None)}


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "ab"[i % 3 == 0], 1) for i in range(300)]
    out = P.mix(spark, docs_of(spark, rows), D)
    assert out.columns == COLUMNS
    size = {s: sum(1 + i % 9 for i, _, _, source, _ in rows if source == s) for s in "ab"}
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    total = sum(size.values())
    assert abs(taken["a"] - total / 3) <= 9 and abs(taken["b"] - total * 2 / 3) <= 9


@pytest.mark.parametrize("stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_empty_documents(spark, stage):
    out = stage[1](spark, docs_of(spark, []), D)
    assert out.count() == 0 and out.columns == COLUMNS


def test_chain_is_its_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, D)
    assert sorted(map(str, P.run(spark, D).collect())) == sorted(map(str, docs.collect()))


def test_near_copies_move_only_judged_rows(spark, monkeypatch):
    rng = random.Random(9)
    texts = [words(rng, 40) for _ in range(30)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts[:6])]
    rows += [rows[0], rows[7], (None, texts[8], "en", "s", 1), (None, "alone " + texts[9], "en", None, None), (40, None, "en", "s", 1)]
    gone = [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts[:6])] + [rows[0], rows[7], (None, texts[8], "en", "s", 1)]
    gone.append((None, "alone " + texts[9], "en", None, None))
    want = sorted(map(str, rows))
    for row in gone:
        want.remove(str(row))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = []
        for keys in (C.SENT_KEYS, 0):
            monkeypatch.setattr(C, "SENT_KEYS", keys)
            out = P.near_copies(spark, docs_of(spark, rows), D)
            assert sorted(str(tuple(r)) for r in out.collect()) == want
            plan = out._jdf.queryExecution().executedPlan().toString()
            moved.append("PythonUDF" in plan or "ArrowEvalPython" in plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert moved == [True, False]


def test_among(spark, monkeypatch):
    rows = spark.range(-5, 20).select(F.when(F.col("id") != 3, F.col("id")).alias("k"))
    pick = lambda keys, **how: sorted((r["k"] is None, r["k"]) for r in C.among(rows, F.col("k"), keys, **how).collect())
    some = spark.createDataFrame([(-5,), (7,), (None,), (0,), (7,), (99,)], "k long")
    assert [k for _, k in pick(some)] == [-5, 0, 7]
    assert len(pick(some, inside=False)) == 22 and pick(some.limit(0)) == [] and len(pick(some.limit(0), inside=False)) == 25
    monkeypatch.setattr(C, "SENT_KEYS", 2)
    assert C.among(rows, F.col("k"), some) is None
