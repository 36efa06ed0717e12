"""Language-model scoring from a log-frequency Bloom filter.

The filter holds quantised n-gram counts: count levels grow by ``GROWTH``, and an n-gram of
level q is inserted as q items, (n-gram, 1) to (n-gram, q).  Its count is read back by asking
for one level after the other until one is missing.  Probabilities are interpolated from
the longest history down, each with ``WEIGHT`` pseudo-counts of the shorter one, and end at
the add-one estimate of single words.

Counts cover all training texts and are exact.  Tasks send sorted, packed hashes with
counts, by range of hashes; each range is merged in one task, which also sets the bits of
its own segment of the filter.  So no count table passes the driver, only the finished
bits.  Every item gets ``FILTER_BITS``, however many there are.  A filter of at most ``FILTER_BYTES``
is broadcast.  A larger one stays in its segments, and the questions go to them: texts are
put in groups, each group sends its distinct n-grams by range, each range answers from its
own segment, and the answers return to the group.  Both ways give the same scores.

The exact counts that the base score asks for are another matter: they are broadcast when
there are at most ``BROADCAST_WORDS`` distinct words, and joined by word beyond.

Defined results: null and empty texts are one end token; tokens are runs free of the six
ASCII blanks, A-Z lower-cased, then one end; without training texts every probability is
1.  Texts are read whole, in strips of bounded length.  Repeated rows count and are
scored each; extra columns are kept.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import fits, free_name, landed
from sparkaudit.llm.hashing import mixed, word_hashes

ORDER, WEIGHT, GROWTH = 2, 100.0, 1.25
FILTER_BITS, FILTER_BYTES = 10, 256 << 20
PROBES = 5
BROADCAST_WORDS = 8_000_000
#: n-grams that a task holds before it sends them on; tokens that are scored at once; texts for each range.
HELD, STRIP, DOCS_PER_RANGE = 1_500_000, 1 << 18, 1 << 14
#: Characters for each range, where texts are long, and for each group of texts that asks segments together.
CHARS_PER_RANGE, CHARS_PER_GROUP = 1 << 27, 1 << 23
LEAST_RANGES = 32
KEY_BITS = 48

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
WORDS, GRAMS = 1, 2


def levels(growth: float = GROWTH) -> np.ndarray:
    """The least count of each level, from level 1."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * growth)))
    return np.array(out, dtype=np.int64)


LEAST_COUNT = levels()
#: What a level says of the count: the middle of its range, by ratio.
READ = np.concatenate(([0.0], np.sqrt(LEAST_COUNT[:-1] * (LEAST_COUNT[1:] - 1.0))))


def gram_keys(tokens: np.ndarray, order: int) -> np.ndarray:
    """48-bit keys of the runs of ``order`` tokens that end at each token, from the ``order - 1``-th on."""
    m = len(tokens) - order + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = tokens[:m] + np.uint64(order)
    for k in range(1, order):
        h = mixed(h) + tokens[k : k + m]
    return mixed(h) >> np.uint64(64 - KEY_BITS)


def sequence(words: np.ndarray, order: int) -> np.ndarray:
    """Start marks for the first history, the words, and the end."""
    return np.concatenate((np.full(order - 1, START), words, [END]))


# --- counting -------------------------------------------------------------------------

PACKED = "kind int, part int, keys binary, counts binary"
PACKED_KIND = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _pack(values: np.ndarray) -> bytes:
    """Eight planes of bytes, which leaves the high ones to compression."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _ranged(kind: int, keys: np.ndarray, bits: int, parts: int) -> pa.RecordBatch:
    keys, counts = np.unique(keys, return_counts=True)
    place = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(place, np.arange(parts + 1))
    rows = []
    for i in range(parts):
        a, b = cuts[i], cuts[i + 1]
        if a < b:
            steps = np.diff(keys[a:b], prepend=np.uint64(0))
            rows.append({"kind": kind, "part": i, "keys": _pack(steps), "counts": _pack(counts[a:b])})
    return pa.RecordBatch.from_pylist(rows, PACKED_KIND)


def packed_counts(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """Counts of words (64-bit keys) and of n-grams of all orders (48-bit keys), packed by range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            yield _ranged(WORDS, np.concatenate([h[order - 1 :] for _, h in held]), 64, parts)
            # One order after the other, so that a task holds the keys of one.
            for n in range(1, order + 1):
                # Runs that end at a word or the end; a text's opening adds the start marks as a history.
                keys = [gram_keys(h[max(0, order - 1 - n) if opening else order - n :], n) for opening, h in held]
                yield _ranged(GRAMS, np.concatenate(keys), KEY_BITS, parts)

        for batch in batches:
            for words in word_hashes(batch.column(0)):
                tokens = sequence(words, order)
                for at in range(0, len(words) + 1, HELD):  # a long text in parts that overlap by a history
                    held.append((at == 0, tokens[at : at + HELD + order - 1]))
                    size += len(held[-1][1])
                    if size >= HELD:
                        yield from sent()
                        held, size = [], 0
        if held:
            yield from sent()

    return texts.mapInArrow(run, PACKED)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(_unpack(b), dtype=np.uint64) for b in table.column("keys").to_pylist()])
    counts = np.concatenate([_unpack(b) for b in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


# --- the filter -----------------------------------------------------------------------


def _places(keys: np.ndarray, level: np.ndarray | int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit of an item in its segment, for one probe."""
    seed = keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2654435761) * np.asarray(level, dtype=np.uint64)
    h = mixed(seed + np.uint64(0xD1B54A32D192ED03 * (probe + 1) % (1 << 64)))
    return ((h >> np.uint64(32)) * np.asarray(bits, dtype=np.uint64)) >> np.uint64(32)


def segment(keys: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes]:
    """Items, bits and the bitmap of one range of keys."""
    level = np.searchsorted(LEAST_COUNT, counts, side="right")
    items = int(level.sum())
    bits = min(-(-items * FILTER_BITS // 64) * 64, (1 << 32) - 64)
    field = np.zeros(bits, dtype=bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        own = keys[level >= q]
        for probe in range(PROBES):
            field[_places(own, q, probe, bits).astype(np.int64)] = True
    return items, bits, np.packbits(field, bitorder="little").tobytes()


@dataclasses.dataclass(frozen=True)
class Filter:
    data: np.ndarray
    begin: np.ndarray  # first bit of each range's segment
    bits: np.ndarray
    wrong: float  # expected share of absent items that are answered

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Count levels of keys as the filter has them, 0 if absent."""
        part = (((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(len(self.bits))) >> np.uint64(32)).astype(np.int64)
        level = np.zeros(len(keys), dtype=np.int64)
        alive = np.flatnonzero(self.bits[part] > 0)
        q = 0
        while len(alive) and q + 1 < len(READ):
            q += 1
            for probe in range(PROBES):
                at = self.begin[part[alive]] + _places(keys[alive], q, probe, self.bits[part[alive]]).astype(np.int64)
                alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            level[alive] = q
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys as the filter has them, 0 if absent."""
        return READ[self.levels(keys)]


@dataclasses.dataclass(frozen=True)
class Answers:
    """What segments answered for some keys, which are sorted."""

    keys: np.ndarray
    level: np.ndarray

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return READ[self.level[np.searchsorted(self.keys, keys)]]


def built(packed: DataFrame, parts: int) -> tuple[Filter | None, DataFrame, DataFrame]:
    """The filter, if it can be broadcast; its segments; and the exact words, arrays of hashes and counts by range."""

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        kind, part = key[0].as_py(), key[1].as_py()
        keys, counts = _merged(table)
        items, bits, data = segment(keys, counts) if kind == GRAMS else (0, 0, None)
        words = kind == WORDS
        return pa.table(
            {
                "kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()),
                "items": pa.array([items], pa.int64()), "bits": pa.array([bits], pa.int64()), "data": pa.array([data], pa.binary()),
                "hashes": pa.array([keys.view(np.int64) if words else None], pa.list_(pa.int64())),
                "counts": pa.array([counts if words else None], pa.list_(pa.int64())),
            }
        )

    schema = "kind int, part int, items long, bits long, data binary, hashes array<long>, counts array<long>"
    every = landed(packed.groupBy("kind", "part").applyInArrow(merged, schema))
    grams = every.filter(F.col("kind") == GRAMS)
    bits, wrong, total = np.zeros(parts, dtype=np.int64), 0.0, 0
    for r in grams.select("part", "items", "bits").collect():
        bits[r["part"]] = r["bits"]
        wrong += r["items"] * (1 - math.exp(-PROBES * r["items"] / r["bits"])) ** PROBES
        total += r["items"]
    segments = grams.select("part", "bits", "data")
    words = every.filter(F.col("kind") == WORDS).select("part", "hashes", "counts")
    if int(bits.sum()) // 8 > FILTER_BYTES:
        return None, segments, words
    begin = np.concatenate(([0], np.cumsum(bits)[:-1]))
    # One segment after the other, into its place: the driver holds the filter once.
    joined = np.zeros(int(bits.sum()) // 8, dtype=np.uint8)
    for r in grams.select("part", "data").toLocalIterator():
        at = int(begin[r["part"]]) // 8
        joined[at : at + len(r["data"])] = np.frombuffer(r["data"], dtype=np.uint8)
    return Filter(joined, begin, bits, wrong / max(1, total)), segments, words


# --- scoring --------------------------------------------------------------------------


@dataclasses.dataclass(frozen=True)
class Model:
    order: int
    filter: Filter | None  # none where it is too large for a broadcast
    segments: DataFrame
    parts: int
    words: DataFrame  # exact counts, arrays by range
    distinct: int
    tokens: int
    hashes: np.ndarray | None  # the words themselves, sorted, where they are few enough
    counts: np.ndarray | None


def _binary(name: str) -> Column:
    """An array of longs as bytes, eight each, the high one first: no list of Python numbers on the driver."""
    digits = F.array_join(F.transform(name, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.unhex(digits).alias(name)


def trained(docs: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    texts = docs.select(F.col(text))
    rows, chars = texts.agg(F.count(F.lit(1)), F.sum(F.length(F.col(text)).cast("long"))).first()
    parts = max(LEAST_RANGES, -(-rows // DOCS_PER_RANGE), -(-(chars or 0) // CHARS_PER_RANGE))
    found, segments, words = built(packed_counts(texts, order, parts), parts)
    distinct, tokens = words.agg(
        F.sum(F.size("hashes")), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c))
    ).first()
    hashes = counts = None
    if (distinct or 0) <= BROADCAST_WORDS:
        hashes, counts = np.zeros(distinct or 0, dtype=np.uint64), np.zeros(distinct or 0, dtype=np.int64)
        at = 0
        # Ranges in order are the words in order.
        for r in words.orderBy("part").select(_binary("hashes"), _binary("counts")).toLocalIterator():
            own = np.frombuffer(r["hashes"], dtype=">u8")
            hashes[at : at + len(own)] = own
            counts[at : at + len(own)] = np.frombuffer(r["counts"], dtype=">u8")
            at += len(own)
        if not len(counts) or counts.max() < 1 << 32:
            counts = counts.astype(np.uint32)
    return Model(order, found, segments, parts, words, distinct or 0, tokens or 0, hashes, counts)


def _unique(f, keys: np.ndarray) -> np.ndarray:
    """A function of keys, asked once for each distinct one."""
    some, back = np.unique(keys, return_inverse=True)
    return f(some)[back]


def probabilities(tokens: np.ndarray, order: int, f: Filter | Answers, total: int, distinct: int) -> np.ndarray:
    """Model probability of each token after the first ``order - 1``, which are history."""
    p = (_unique(f.counts, gram_keys(tokens[order - 1 :], 1)) + 1.0) / (total + distinct + 1.0)
    for n in range(2, order + 1):
        seen = _unique(f.counts, gram_keys(tokens[order - n :], n))
        history = _unique(f.counts, gram_keys(tokens[order - n : -1], n - 1))
        # Both are read back as the middle of a level, so a run may seem to be more frequent than its history.
        p = (seen + WEIGHT * p) / (np.maximum(history, seen) + WEIGHT)
    return np.minimum(p, 1.0)


def _by_text(groups: list[np.ndarray], order: int):
    """(text, tokens with their histories) in strips of bounded length."""
    for i, words in enumerate(groups):
        tokens = sequence(words, order)
        for at in range(0, len(tokens) - order + 1, STRIP):
            yield i, tokens[at : at + STRIP + order - 1]


SCORES = "struct<n_tokens: long, n_known: long, base_score: double, score: double>"
SCORES_KIND = pa.struct(
    [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def flusher(order: int, total: int, distinct: int, exact: bool):
    """Function of some texts' words, something that has counts of n-grams, and the exact words: their scores."""

    def flush(groups: list[np.ndarray], f: Filter | Answers, hashes: np.ndarray | None, counts: np.ndarray | None) -> list[dict]:
        n = len(groups)
        score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
        strip: list[tuple[int, np.ndarray]] = []
        size = 0

        def work() -> None:
            # Texts meet at start marks, so no history reaches into the text before.
            tokens = np.concatenate([t for _, t in strip])
            owner = np.repeat([i for i, _ in strip], [len(t) for _, t in strip])
            own = np.concatenate([np.arange(len(t)) >= order - 1 for _, t in strip])[order - 1 :]
            who = owner[order - 1 :][own]
            p = probabilities(tokens, order, f, total, distinct)[own]
            score[:] += np.bincount(who, np.log10(p), n)
            if exact:
                now = tokens[order - 1 :][own]

                def count(some: np.ndarray) -> np.ndarray:
                    if not len(hashes):
                        return np.zeros(len(some), dtype=np.int64)
                    at = np.minimum(np.searchsorted(hashes, some), len(hashes) - 1)
                    return np.where(hashes[at] == some, counts[at].astype(np.int64), 0)

                c = _unique(count, now)
                base[:] += np.bincount(who, np.log10((c + 1.0) / (total + distinct + 1.0)), n)
                known[:] += np.bincount(who, c > 0, n).astype(np.int64)

        for i, tokens in _by_text(groups, order):
            strip.append((i, tokens))
            size += len(tokens)
            if size >= STRIP:
                work()
                strip, size = [], 0
        if strip:
            work()
        return [
            {"n_tokens": len(g) + 1, "n_known": int(known[i]), "base_score": float(base[i]), "score": float(score[i])}
            for i, g in enumerate(groups)
        ]

    return flush


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", name: str = "lm") -> DataFrame:
    """The rows of ``docs`` with one more column: a struct of n_tokens, n_known, base_score and score (log10)."""
    exact = model.hashes is not None
    flush = flusher(model.order, model.tokens, model.distinct, exact)
    shared = docs.sparkSession.sparkContext.broadcast((model.filter, model.hashes, model.counts))
    if model.filter is None:
        rows = with_asked_segments(docs, model, flush, shared, text, name)
        return rows if exact else with_joined_base(rows, model, doc_id, text, name)

    @F.arrow_udf(SCORES)
    def judge(texts: pa.Array) -> pa.Array:
        out, groups, size = [], [], 0
        for words in word_hashes(texts):
            groups.append(words)
            size += len(words)
            if size >= STRIP:
                out += flush(groups, *shared.value)
                groups, size = [], 0
        return pa.array(out + flush(groups, *shared.value), SCORES_KIND)

    rows = docs.withColumn(name, judge(F.col(text)))
    return rows if exact else with_joined_base(rows, model, doc_id, text, name)


def with_asked_segments(docs: DataFrame, model: Model, flush, shared, text: str, name: str) -> DataFrame:
    """The scores from a filter that stays in its segments: n-grams go to their range, answers to their texts."""
    order, parts = model.order, model.parts
    h = free_name(docs.columns, "_h")
    once = docs.select(F.xxhash64(text).alias("_h"), F.col(text).alias("_t")).groupBy("_h").agg(F.first("_t").alias("_t"))
    once = landed(once)
    chars = once.agg(F.sum(F.length("_t").cast("long"))).first()[0] or 0
    once = once.withColumn("_g", F.pmod("_h", F.lit(max(1, -(-chars // CHARS_PER_GROUP)))))

    def ask(table: pa.Table) -> pa.Table:
        # Made distinct on the way, so that the keys held are bounded.
        keys = np.zeros(0, dtype=np.uint64)
        held: list[np.ndarray] = []
        size = 0
        for words in word_hashes(table.column("_t").combine_chunks()):
            tokens = sequence(words, order)
            for n in range(1, order + 1):
                held.append(gram_keys(tokens, n))
                size += len(held[-1])
            if size >= HELD:
                keys, held, size = np.unique(np.concatenate([keys, *held])), [], 0
        keys = np.unique(np.concatenate([keys, *held]))
        batch = _ranged(GRAMS, keys, KEY_BITS, parts)
        group = pa.array([table.column("_g")[0].as_py()] * batch.num_rows, pa.int64())
        return pa.table({"_g": group, "part": batch.column("part"), "keys": batch.column("keys")})

    def answer(asked: pa.Table, segments: pa.Table) -> pa.Table:
        levels = []
        if asked.num_rows:
            bits, data = np.zeros(parts, dtype=np.int64), np.zeros(0, dtype=np.uint8)
            if segments.num_rows:
                bits[segments.column("part")[0].as_py()] = segments.column("bits")[0].as_py()
                data = np.frombuffer(segments.column("data")[0].as_buffer(), dtype=np.uint8)
            own = Filter(data, np.zeros(parts, dtype=np.int64), bits, 0.0)
            for packed in asked.column("keys"):
                found = own.levels(np.cumsum(_unpack(packed.as_py()), dtype=np.uint64))
                levels.append(zlib.compress(found.astype(np.uint8).tobytes(), 1))
        return asked.append_column("levels", pa.array(levels, pa.binary()))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")  # ranges in order are the keys in order
        keys = [np.cumsum(_unpack(k.as_py()), dtype=np.uint64) for k in answers.column("keys")]
        levels = [np.frombuffer(zlib.decompress(k.as_py()), np.uint8) for k in answers.column("levels")]
        known = Answers(np.concatenate(keys), np.concatenate(levels))
        _, hashes, counts = shared.value
        out, groups, size = [], [], 0
        for words in word_hashes(texts.column("_t").combine_chunks()):
            groups.append(words)
            size += len(words)
            if size >= STRIP:
                out += flush(groups, known, hashes, counts)
                groups, size = [], 0
        out += flush(groups, known, hashes, counts) if groups else []
        return pa.table({"_h": texts.column("_h"), "_s": pa.array(out, SCORES_KIND)})

    asked = once.groupBy("_g").applyInArrow(ask, "_g long, part int, keys binary")
    answers = landed(
        asked.groupBy("part").cogroup(model.segments.groupBy("part")).applyInArrow(answer, "_g long, part int, keys binary, levels binary")
    )
    scores = once.groupBy("_g").cogroup(answers.groupBy("_g")).applyInArrow(score, f"_h long, _s {SCORES}")
    scores = landed(scores.select(F.col("_h").alias(h), F.col("_s").alias(name)))
    return docs.join(scores, F.xxhash64(F.col(text)) == F.col(h), "left").drop(h)


def with_joined_base(rows: DataFrame, model: Model, doc_id: str, text: str, name: str) -> DataFrame:
    """Base scores and known tokens by a join on words, for more distinct words than can be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("_d", pa.int64()), ("_h", pa.int64()), ("_w", pa.int64()), ("_n", pa.int64())]
        for batch in batches:
            for d, h, words in zip(batch.column(0), batch.column(1), word_hashes(batch.column(2))):
                some, n = np.unique(sequence(words, 1), return_counts=True)
                columns = [[d.as_py()] * len(some), [h.as_py()] * len(some), some.view(np.int64), n]
                yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], schema=pa.schema(kinds))

    d, h, found_ = (free_name(rows.columns, c) for c in ("_d", "_h", "_found"))
    key = [F.col(doc_id).cast("long").alias("_d"), F.xxhash64(F.col(text)).alias("_h")]
    once = rows.select(*key, F.col(text).alias("_t")).groupBy("_d", "_h").agg(F.first("_t").alias("_t"))
    counts = model.words.select(F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select(
        F.col("x.hashes").alias("_w"), F.col("x.counts").alias("_c")
    )
    c = F.coalesce("_c", F.lit(0))
    found = (
        once.mapInArrow(run, "_d long, _h long, _w long, _n long")
        .join(counts, "_w", "left")
        .groupBy(F.col("_d").alias(d), F.col("_h").alias(h))
        .agg(
            F.struct(
                F.sum(F.col("_n") * F.log10((c + 1.0) / F.lit(model.tokens + model.distinct + 1.0))).alias("base"),
                F.sum(F.when(c > 0, F.col("_n")).otherwise(0)).alias("known"),
            ).alias(found_)
        )
    )
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text)) == F.col(h))
    facts = F.struct(
        F.col(name)["n_tokens"].alias("n_tokens"), F.col(found_)["known"].alias("n_known"),
        F.col(found_)["base"].alias("base_score"), F.col(name)["score"].alias("score"),
    )
    return rows.join(found, same, "left").withColumn(name, facts).drop(d, h, found_)
