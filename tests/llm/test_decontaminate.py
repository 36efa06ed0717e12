"""Benchmark decontamination: planted passages, changed words, shared phrases, odd rows, brute force."""

import random
import re

from sparkaudit.llm import decontaminate as D
from sparkaudit.llm.queries import op6_decontamination


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best(doc, item, diagonal):
    score = now = 0
    for i, word in enumerate(item):
        if 0 <= i + diagonal < len(doc):
            now = max(0, now + (1 if doc[i + diagonal] == word else -1))
            score = max(score, now)
    return score


def windows(words):
    for i, mask in enumerate(D.MASKS):
        for at in range(len(words) - len(mask) + 1):
            yield (i, *[words[at + o] for o, bit in enumerate(mask) if bit == "1"]), at


def brute(docs, items):
    found = {}
    for key, text in docs:
        doc = tokens(text)
        seen = {}
        for seed, at in windows(doc):
            seen.setdefault(seed, []).append(at)
        for item_id, item_text in items:
            item = tokens(item_text)
            enough = max(D.LEAST, min(D.ENOUGH, -(-len(item) // 2)))
            diagonals = {at - place for seed, place in windows(item) for at in seen.get(seed, [])}
            score = max((best(doc, item, d) for d in diagonals), default=0)
            if score >= enough:
                found[key, item_id] = score
    return found


def test_planted_and_clean(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(14, 60)))) for i in range(30)] + [(97, None), (98, ""), (99, "too short")]
    docs = []
    for i in range(120):
        body, passage = words(rng.randrange(5, 300)), items[i % 30][1].split()
        if i < 60:  # whole passages with every eighth word changed at most
            for at in range(rng.randrange(8), len(passage), 8):
                passage[at] = "changed"
            body[3:3] = passage
        elif i < 80:
            body[2:2] = passage[:6]
        docs.append((i, " ".join(body).capitalize() + "."))
    docs += [(None, items[0][1]), (200, None), (201, ""), (202, " ".join(words(20000) + items[3][1].upper().split()))]
    got = D.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
    assert found == brute(docs, items) and len(got) == len(found)
    assert {k for k, _ in found} == {None, 202, *range(60)}
    kept = D.without_leaks(
        spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, _hash int, item_id int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60, 120), 200, 201]
    assert kept.columns == ["doc_id", "text", "_hash", "item_id"]


def test_masks_fit_every_pattern_that_scores():
    # All patterns that no mask fits, by their last seven places: the best score that one can end with.
    masks = [int(mask, 2) for mask in D.MASKS]
    best = {0: 0}
    for _ in range(3000):
        new = dict(best)
        for state, score in best.items():
            for same in (0, 1):
                window = state << 1 | same
                if not any(window & mask == mask for mask in masks):
                    new[window & 127] = max(new.get(window & 127, 0), score + (1 if same else -1), 0)
        if new == best:
            break
        best = new
        assert max(best.values()) < D.LEAST
    else:
        raise AssertionError("scores keep growing")


def test_regular_changes_and_items_by_text(spark):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(1, " ".join(words(60))), (None, " ".join(words(30))), (2, " ".join(words(12))), (2, " ".join(words(90)))]
    docs = []
    for period in (3, 4, 5, 6):
        for at in range(period):
            passage = items[0][1].split()
            passage[at::period] = ["changed"] * len(passage[at::period])
            docs.append((len(docs), " ".join(words(20) + passage + words(20))))
    whole = len(docs)
    docs += [(100 + i, " ".join([*words(5), items[i][1]])) for i in (1, 2, 3)] + [(200, items[3][1].split(" ", 70)[-1])]
    got = D.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = sorted((r["doc_id"], r["item_id"] or 0) for r in got)
    assert found == [*((i, 1) for i in range(whole)), (101, 0), (102, 2), (103, 2), (200, 2)]


def test_shuffled_ways_agree(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(40)) for _ in range(20))) for i in range(5)]
    docs = [(i % 7, f"lead in {items[i % 5][1]} tail") for i in range(20)] + [(i % 7, f"lead in {items[i % 5][1]} tail") for i in range(5)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, D.leaks(a, b).collect()))
    monkeypatch.setattr(D, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(D, "BROADCAST_HITS", 0)
    assert sorted(map(tuple, D.leaks(a, b).collect())) == want and len(want) == 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, none).count() == 0 and D.without_leaks(docs, none).count() == 1
    assert D.leaks(docs.limit(0), none).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = op6_decontamination(spark, d).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == brute(docs, items)
