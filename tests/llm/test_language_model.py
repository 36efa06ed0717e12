"""Language-model scoring: exact base scores, the filter's counts, probabilities and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from sparkaudit.llm import language_model as L
from sparkaudit.llm.hashing import word_hashes
from sparkaudit.llm.queries import op2_language_model

import pyarrow as pa


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def base(docs, training):
    counts = Counter(t for text in training for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for key, text in docs:
        own = tokens(text)
        score = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        out[key] = (len(own), sum(counts[t] > 0 for t in own), total, score)
    return out


def test_levels_bracket_counts():
    for count in [1, 2, 3, 4, 5, 9, 10, 100, 12345, 10**9]:
        level = int(np.searchsorted(L.LEAST_COUNT, count, side="right"))
        assert L.LEAST_COUNT[level - 1] <= count < L.LEAST_COUNT[level]
        assert count / L.GROWTH <= L.READ[level] <= count * L.GROWTH


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def made(n, seed=4):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))) for i in range(n)]


def test_filter_counts(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 500)
    rows = made(150) + [(999, "a b " * 900), (1000, None), (1001, "")]
    for order in (1, 2, 3):
        model = L.trained(docs_of(spark, rows), order=order)
        for n in range(1, order + 1):
            true: Counter = Counter()
            for words in word_hashes(pa.array([t for _, t in rows])):
                true.update(L.gram_keys(L.sequence(words, order)[order - n :], n).tolist())
            keys = np.array(list(true), dtype=np.uint64)
            got, want = model.filter.counts(keys), np.array([true[k] for k in keys.tolist()])
            assert (got >= want / L.GROWTH).all()  # never too low
            assert (got <= want * L.GROWTH).mean() > 0.97
        absent = np.random.default_rng(0).integers(0, 1 << 48, 20000, dtype=np.uint64)
        assert (model.filter.counts(absent) > 0).mean() < 0.03


def test_base_is_exact_either_way(spark, monkeypatch):
    rows = made(80) + [(500, None), (501, ""), (502, "w1 " * 5000), (None, "W1 w2"), (503, "never seen at all")]
    training = [r for r in rows if r[0] != 503]
    want = base(rows, [t for _, t in training])
    results = []
    for bound in (L.BROADCAST_WORDS, 0):
        monkeypatch.setattr(L, "BROADCAST_WORDS", bound)
        model = L.trained(docs_of(spark, training))
        assert (model.hashes is None) == (bound == 0)
        got = {r["doc_id"]: r["lm"] for r in L.scored(docs_of(spark, rows), model).collect()}
        for key, (n, known, total, score) in want.items():
            assert (got[key]["n_tokens"], got[key]["n_known"], model.tokens) == (n, known, total)
            assert math.isclose(got[key]["base_score"], score, rel_tol=1e-9)
        results.append({k: round(v["score"], 9) for k, v in got.items()})
    assert results[0] == results[1]


def test_segments_that_stay_apart_score_alike(spark, monkeypatch):
    rows = made(80) + [(500, None), (501, ""), (502, "w1 " * 5000), (None, "W1 w2"), (503, "never seen at all"), (504, "W1 w2")]
    training = [r for r in rows if r[0] != 503]
    monkeypatch.setattr(L, "CHARS_PER_GROUP", 4000)
    want = None
    for most, words in ((L.FILTER_BYTES, L.BROADCAST_WORDS), (64, L.BROADCAST_WORDS), (64, 0)):
        monkeypatch.setattr(L, "FILTER_BYTES", most)
        monkeypatch.setattr(L, "BROADCAST_WORDS", words)
        model = L.trained(docs_of(spark, training))
        out = L.scored(docs_of(spark, rows), model)
        assert out.columns == ["doc_id", "text", "lm"]
        got = sorted((r["doc_id"] or -1, *(round(x, 9) for x in r["lm"])) for r in out.collect())
        want = want or got
        assert got == want and len(got) == len(rows)
        # Every item has its bits, in one filter or in segments.
        assert (model.filter is None) == (most == 64)
        assert model.segments.selectExpr("sum(bits)").first()[0] > 64 * 8


def test_strips_do_not_change_scores(spark, monkeypatch):
    rows = made(40) + [(77, "x y z " * 700)]
    model = L.trained(docs_of(spark, rows), order=3)
    texts = list(word_hashes(pa.array([t for _, t in rows])))
    for words in texts:
        whole = L.sequence(words, 3)
        p = L.probabilities(whole, 3, model.filter, model.tokens, model.distinct)
        parts = [
            L.probabilities(whole[at : at + 52], 3, model.filter, model.tokens, model.distinct)
            for at in range(0, len(whole) - 2, 50)
        ]
        assert np.allclose(p, np.concatenate(parts)) and (p > 0).all() and (p <= 1).all()


def test_known_sequences_score_better(spark):
    rng = random.Random(8)
    sentence = " ".join(f"v{rng.randrange(5000)}" for _ in range(60))
    rows = made(60) + [(i + 200, sentence) for i in range(5)]
    model = L.trained(docs_of(spark, rows))
    shuffled = sentence.split()
    rng.shuffle(shuffled)
    got = {r["doc_id"]: r["lm"] for r in L.scored(docs_of(spark, [(1, sentence), (2, " ".join(shuffled))]), model).collect()}
    assert got[1]["score"] > got[2]["score"] + 30 and abs(got[1]["base_score"] - got[2]["base_score"]) < 1e-6


def test_no_training_texts_and_extra_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = L.trained(none)
    rows = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, n_tokens int, _h int")
    got = L.scored(rows, model).first()
    assert got["lm"]["base_score"] == 0.0 and got["lm"]["score"] == 0.0 and got["n_tokens"] == 5
    assert L.scored(none, model).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    out = lambda key: zlib.crc32(str(key).encode()) % 7 == 2
    want = base(docs, [t for k, t in docs if not out(k)])
    got = {r["doc_id"]: r for r in op2_language_model(spark, d).collect()}
    assert set(got) == set(want)
    for key, (n, known, total, score) in want.items():
        r = got[key]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(key), n, known, total)
        assert math.isclose(r["base_score"], score, rel_tol=1e-9)
