"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the bag of all character n-grams of its words (letters only, lower-cased,
with a mark at either end of a word), each hashed into ``BUCKETS`` rows of an
embedding table; the mean of the rows goes through a linear layer and a softmax.
Table and layer are trained together by stochastic gradient descent in numpy, on the
driver, from a bounded sample of labelled rows: at most ``SAMPLE`` rows in all, as many
of each language, and ``LANGUAGES`` languages (those with most labelled rows).  A row
comes as at most ``BUCKETS`` shares, counted on the executors over its whole text, plus
``PIECES`` short runs of its words, so that short texts are learned too.  A part
of the sample is kept out of the descent; on it a temperature is fitted.  As the sample has as
many of each language, the labels' true counts are put back into the offset.  The lowest
confidence that still gives ``PRECISION`` on the whole texts kept out, each weighted by what it
stands for, becomes the bound below which a prediction is rejected, unless those rejected
would be right more often than not (labels may be wrong): then it is lowered until they are not.

Prediction reads whole texts.  The layer is linear, so table and layer are folded into
one score per bucket and language (its size is fixed, ``BUCKETS`` x languages, which
makes it safe to ship with the tasks); a text is scored in strips of bounded length.

Defined results: null texts and texts without a letter are ``und`` with score 0 and
rejected; the other columns, the label among them, are no inputs of a prediction; rows
whose label is null or not among the learned ones teach nothing; without a single
labelled row everything is ``und``.  Repeated rows get equal results; ties between
languages go to the smaller name.
"""

from __future__ import annotations

import dataclasses
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, DIMS, SIZES = 1 << 15, 16, (2, 3, 4)
#: Bounds of the labelled sample: rows, languages, short pieces a row, words a piece at most.
SAMPLE, LANGUAGES, PIECES, PIECE_WORDS = 2000, 200, 6, 16
EPOCHS, RATE, BATCH, SEED = 6, 12.0, 32, 7
PRECISION = 0.95
#: Wrong predictions beyond the right ones, in examples of the largest weight, that show rejected ones to be mostly wrong.
CLEARLY = 3
STRIP = 1 << 18
UNKNOWN = "und"


@dataclasses.dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # BUCKETS x languages: the embedding table times the linear layer
    offset: np.ndarray
    temperature: float
    least: float  # confidence below which a prediction is rejected


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    known = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            known[c] = True
    return known


def codes(text: str) -> np.ndarray:
    """Lower-cased code points; everything but letters is 0, with a 0 at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.concatenate(([0], np.where(_letters()[raw], raw, 0), [0])).astype(np.uint32)


def buckets(c: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams that lie in one word; a word's marks count as its first and last character."""
    letter = c > 0
    found = []
    rolling = np.zeros(len(c), dtype=np.uint32)
    inner = np.ones(len(c), dtype=bool)  # all characters but the first and the last are letters
    for n in range(1, max(SIZES) + 1):  # grown by one character at a time
        m = len(c) - n + 1
        if m <= 0:
            break
        rolling = rolling[:m] * np.uint32(0x01000193) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        if n >= 3:
            inner = inner[:m] & letter[n - 2 : n - 2 + m]
        if n not in SIZES:
            continue
        first, last = letter[:m], letter[n - 1 :]
        whole = inner[:m] & (first | last)
        h = rolling[whole] + np.uint32(n)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        found.append(h >> np.uint32(32 - (BUCKETS.bit_length() - 1)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def strips(c: np.ndarray):
    """Pieces of bounded length that start and end at a word's end; a longer word is cut."""
    at = 0
    while at < len(c) - 1:
        end = min(at + STRIP, len(c) - 1)
        if end < len(c) - 1:
            blanks = np.flatnonzero(c[at + 1 : end + 1] == 0)
            end = at + 1 + int(blanks[-1]) if len(blanks) else end
        yield c[at : end + 1]
        at = end


def summed(text: str, scores: np.ndarray) -> tuple[np.ndarray, int]:
    total, n = np.zeros(scores.shape[1]), 0
    for strip in strips(codes(text)):
        ids = buckets(strip)
        total += np.bincount(ids, minlength=BUCKETS) @ scores
        n += len(ids)
    return total, n


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counted(text: str) -> tuple[bytes, bytes]:
    """Buckets (uint16) and their shares (float32) of a whole text."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for strip in strips(codes(text)):
        counts += np.bincount(buckets(strip), minlength=BUCKETS)
    ids = np.flatnonzero(counts)
    return ids.astype(np.uint16).tobytes(), (counts[ids] / max(1, counts.sum())).astype(np.float32).tobytes()


def examples(text: str, seed: int) -> list[dict]:
    """The whole text and some short runs of its words, as shares of buckets."""
    words = text.split()
    rng = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF)
    pieces = [text]
    for _ in range(PIECES if words else 0):
        at, n = rng.integers(len(words)), rng.integers(1, PIECE_WORDS + 1)
        pieces.append(" ".join(words[at : at + n]))
    return [{"ids": ids, "shares": shares} for ids, shares in map(counted, pieces) if ids]


EXAMPLES = "array<struct<ids: binary, shares: binary>>"


def example_rows(text: str, seed: str) -> Column:
    kind = pa.list_(pa.struct([("ids", pa.binary()), ("shares", pa.binary())]))

    @F.arrow_udf(EXAMPLES)
    def made(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        return pa.array([examples(t.as_py() or "", s.as_py()) for t, s in zip(texts, seeds)], type=kind)

    return made(text, seed)


def sampled(labelled: DataFrame, text: str, label: str, key: str) -> tuple[list, dict[str, int]]:
    """At most SAMPLE rows, as many of each of at most LANGUAGES languages, as examples; all rows of each language."""
    place = F.xxhash64(F.col(key), F.col(text))
    known = labelled.select(F.col(label).alias("label"), F.col(text).alias("text"), place.alias("place")).filter(
        F.col("label").isNotNull() & F.col("text").isNotNull()
    )
    kept = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()
    if not kept:
        return [], {}
    each = max(1, SAMPLE // len(kept))
    # Only hashes low enough to be among a label's first are ranked: some eight times as many as are taken.
    bound = [min((1 << 63) - 1, int(-(2.0**63) + 2.0**64 * min(1.0, (8 * each + 64) / r["count"]))) for r in kept]
    bounds = F.create_map(*[F.lit(x) for r, b in zip(kept, bound) for x in (r["label"], b)])
    known = known.filter(F.col("label").isin([r["label"] for r in kept]))
    # The hashes are ranked without the texts; the few chosen ones, SAMPLE at most, then fetch theirs.
    chosen = (
        known.select("label", "place")
        .filter(F.col("place") <= F.element_at(bounds, F.col("label")))
        .distinct()
        .withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("place")))
        .filter(F.col("n") <= each)
        .drop("n")
    )
    texts = known.join(F.broadcast(chosen), ["label", "place"]).groupBy("label", "place").agg(F.min("text").alias("text"))
    rows = texts.select("label", "place", example_rows("text", "place").alias("examples"))
    return sorted(rows.collect(), key=lambda r: (r["label"], r["place"])), {r["label"]: r["count"] for r in kept}


def descended(data: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table, layer and offset after stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0.0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    layer, offset = np.zeros((DIMS, classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    layer += rng.normal(0.0, 0.1, layer.shape).astype(np.float32)
    steps = EPOCHS * -(-len(data) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            batch = [data[i] for i in order[at : at + BATCH]]
            sizes = [len(ids) for ids, _, _ in batch]
            ids = np.concatenate([ids for ids, _, _ in batch])
            shares = np.concatenate([s for _, s, _ in batch])[:, None]
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            mean = np.add.reduceat(table[ids] * shares, starts, axis=0)
            wrong = softmax(mean @ layer + offset)
            wrong[np.arange(len(batch)), [y for _, _, y in batch]] -= 1.0
            wrong = (wrong / len(batch)).astype(np.float32)
            back = wrong @ layer.T
            layer -= rate * (mean.T @ wrong)
            offset -= rate * wrong.sum(axis=0)
            np.subtract.at(table, ids, rate * np.repeat(back, sizes, axis=0) * shares)
    return table, layer, offset


def fitted_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss."""
    grid = np.geomspace(0.05, 20.0, 61)
    losses = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-300).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def bound(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The lowest confidence that keeps PRECISION, or a lower one that rejects only what is mostly wrong."""
    confidence, right = p.max(axis=1), (p.argmax(axis=1) == y) * weight
    order = np.argsort(-confidence, kind="stable")
    hits, all_ = np.cumsum(right[order]), np.cumsum(weight[order])
    good = np.flatnonzero(hits / all_ >= PRECISION)
    # What comes after a place, the last one aside, where nothing is left to reject.
    wrong = all_ - hits
    excess = (wrong[-1] - wrong[:-1]) - (hits[-1] - hits[:-1])
    mostly_wrong = np.append(excess > CLEARLY * weight.max(), True)
    place = np.flatnonzero(mostly_wrong & (np.arange(len(y)) >= (good[-1] if len(good) else 0)))[0]
    # All of the sample passes: nothing that looks like a language at all is rejected.
    return 0.0 if place == len(y) - 1 else float(confidence[order[place]])


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature and rejection bound of examples that count alike."""
    if not len(y):
        return 1.0, 0.0
    temperature = fitted_temperature(z, y)
    return temperature, bound(softmax(z / temperature), y, np.ones(len(y)))


def trained(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    rows, counts = sampled(labelled, text, label, key)
    languages = tuple(sorted({r["label"] for r in rows}))
    place = {name: i for i, name in enumerate(languages)}
    learn, check, whole = [], [], []
    for r in rows:
        part = check if r["place"] % 5 == 0 else learn
        for i, e in enumerate(r["examples"]):
            if part is check and i == 0:  # a text comes before its pieces
                whole.append(len(check))
            ids, shares = np.frombuffer(e["ids"], np.uint16), np.frombuffer(e["shares"], np.float32)
            part.append((ids.astype(np.int64), shares, place[r["label"]]))
    if not learn or not languages:
        return Model((), np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0), 1.0, 1.0)
    table, layer, offset = descended(learn, len(languages))
    scores = table @ layer
    took = np.bincount([place[r["label"]] for r in rows], minlength=len(languages))
    # What a taken row stands for, by language; the descent saw all languages as frequent as in the sample.
    stands = np.array([counts[name] for name in languages]) / took
    prior = np.log(stands / stands.max())
    temperature, least = 1.0, 0.0
    if check:
        z, y = np.array([scores[ids].T @ shares + offset for ids, shares, _ in check]), np.array([y for _, _, y in check])
        temperature = fitted_temperature(z, y)
        y = y[whole]
        weight = stands[y] * (took / np.maximum(1, np.bincount(y, minlength=len(languages))))[y]
        least = bound(softmax(z[whole] / temperature + prior), y, weight)
    offset = offset.astype(np.float64) + temperature * prior
    return Model(languages, scores.astype(np.float64), offset, temperature, least)


PREDICTED = "struct<lang: string, score: double, rejected: boolean>"


def predictor(model: Model):
    """Column function: language, calibrated confidence, and whether it is rejected, of a text column."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf(PREDICTED)
    def predict(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            total, n = summed(t.as_py() or "", model.scores)
            if not n or not model.languages:
                out.append({"lang": UNKNOWN, "score": 0.0, "rejected": True})
                continue
            p = softmax((total / n + model.offset) / model.temperature)
            best = int(p.argmax())
            score = float(p[best])
            out.append({"lang": model.languages[best], "score": score, "rejected": score < model.least})
        return pa.array(out, type=kind)

    return predict


def identified(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """The rows of ``docs`` with one more column: a struct of lang, score and rejected."""
    predict = predictor(model)
    return docs.withColumn(name, predict(F.col(text)))


def in_part(key: Column, of: int, part: int) -> Column:
    """Whether crc32 of the key's text falls in a part; a null key is in none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of == part, F.lit(False))
