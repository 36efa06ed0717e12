"""Language identification: held-out accuracy, texts in strips, odd rows, rejection."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkaudit.llm import language as L
from sparkaudit.llm.queries import op7_language

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    return L.trained(docs.filter(~L.in_part(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang"))


def test_held_out_accuracy(spark):
    out = op7_language(spark, D).collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang").collect()}
    assert {r["doc_id"] for r in out} == set(docs) and len(out) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.97
    assert all(0.0 <= r["score"] <= 1.0 for r in out)
    assert sum(r["rejected"] for r in out) <= 0.005 * len(out)


def test_odd_texts(spark, model):
    rows = [(1, None, 3), (2, "", 3), (3, "123 !? \n", 3), (4, "É", 3), (5, "the and of " * 200_000, 3), (6, "漢字 かな", 3), (1, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang int")
    out = L.identified(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "language"]
    got = {r["doc_id"]: r["language"] for r in out.collect()}
    assert all((got[i]["lang"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True) for i in (1, 2, 3))
    assert got[4]["lang"] in model.languages and got[5]["lang"] == "en" and got[6]["lang"] in model.languages


def test_strips_sum_to_the_whole(monkeypatch, model):
    text = "Einige Wörter, les mots d'été; some words " * 60
    whole, n = L.summed(text, model.scores)
    monkeypatch.setattr(L, "STRIP", 50)
    parts, m = L.summed(text, model.scores)
    assert n == m and np.allclose(whole, parts)


def test_subwords_stay_in_words():
    one = np.concatenate([L.buckets(L.codes(w)) for w in ("ab", "été", "x")])
    assert sorted(one.tolist()) == sorted(L.buckets(L.codes("AB, été--x!")).tolist())
    assert len(L.buckets(L.codes("123"))) == 0


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = L.trained(docs)
    assert model.languages == ()
    assert {r["language"]["lang"] for r in L.identified(docs, model).collect()} == {"und"}
    assert L.identified(docs.limit(0), model).count() == 0


def test_calibration_rejects_below_the_bound():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 4000)
    z = rng.normal(size=(4000, 3))
    strong = np.arange(4000) < 3000
    z[np.arange(4000), y] += np.where(strong, 12.0, 0.0)
    temperature, least = L.calibrated(z, y)
    p = L.softmax(z / temperature)
    kept = p.max(axis=1) >= least
    assert (p[kept].argmax(axis=1) == y[kept]).mean() >= L.PRECISION and kept[strong].mean() > 0.95 and kept.mean() < 1


def test_wrong_labels_reject_little():
    rng = np.random.default_rng(3)
    for share in (0.05, 0.06, 0.1, 0.2):
        true = rng.integers(0, 4, 2000)
        z = rng.normal(size=(2000, 4))
        z[np.arange(2000), true] += 9.0
        y = np.where(rng.random(2000) < share, (true + 1) % 4, true)
        temperature, least = L.calibrated(z, y)
        assert (L.softmax(z / temperature).max(axis=1) < least).mean() <= 0.02


def test_wrong_and_junk_labels(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang").filter(F.col("text").rlike("[a-z]{2}"))
    monkeypatch.setattr(L, "SAMPLE", 500)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    junk = F.when((F.col("lang") == "en") & (h == 3), "zz").otherwise(F.col("lang"))
    wrong = F.when(h == 4, F.when(F.col("lang") == "de", "fr").otherwise("de")).otherwise(F.col("lang"))
    for label in (junk, wrong):
        model = L.trained(docs.withColumn("label", label), label="label")
        out = L.identified(docs, model).select("lang", "language").collect()
        assert np.mean([r["language"]["rejected"] for r in out]) <= 0.03
        assert np.mean([r["language"]["lang"] == r["lang"] for r in out]) > 0.95
    model = L.trained(docs.withColumn("label", junk), label="label")
    english = [r["language"] for r in L.identified(docs.filter("lang = 'en'"), model).collect()]
    assert np.median([r["score"] for r in english if r["lang"] == "en"]) > 0.75
