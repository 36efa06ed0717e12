"""Exact n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are distinct n-gram sets (documents of one set are one
row), columns are n-grams.  The columns of a row are put in one global order, rare
n-grams first.  Two sets that are similar enough must share a column among the first
``size - ceil(t * size) + 1`` of each, so the product is taken in two column blocks: the
posting lists of those first columns give the candidate pairs, sizes bound what a pair
can reach and discard it, and for the rest the overlap count over all columns decides.

The result asked for is the components of the links, so a pair whose two ends are
known to be connected needs no product.  That is what keeps large groups of near
copies from their square: in each of some rounds every posting list names
leaders (``LEADERS``), all its members meet these alone, and links found join components.
Afterwards only pairs of *different* components on a posting list are left; all of them
are taken, in products of blocks of ``TILE`` members, so no link between different texts is
lost.

The order needs to know which n-grams are common.  Counts of all n-grams of all
documents are made exact on 32-bit hashes: tasks send sorted, packed runs per range of
hashes and each range is merged in one task (their number follows the number of documents).  Counts
of common n-grams, ``COMMON`` of them at most by a rising bound, and a bitmap of fixed
size of those that occur at all twice go to the tasks.  They choose the order, leave out columns
that a single document has, and tell how many of a set's n-grams any partner can have,
which bounds overlaps once more.  Wherever they are coarse the result stays the same.

Defined results: a text of fewer words than n is its whole sequence as one n-gram;
texts without words, null ones included, have no n-grams and are linked with nothing;
rows with a null id are linked with nothing and have no component; rows that repeat an
id are placed each by its own text, and two texts whose least id is the same count as
linked.  Texts are read whole.  Extra columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import among, landed
from sparkaudit.llm.components import components
from sparkaudit.llm.hashing import shingles, word_hashes

N, PERCENT = 4, 85
#: Leaders that a posting list names, round by round.
LEADERS = (1, 4)
#: Common n-grams occur in so many documents at least; so many of them are sent to tasks at most.
COMMON_FROM, COMMON = 16, 2_000_000
#: Bits of the bitmap of n-grams that occur twice, a power of two.
BITMAP = 1 << 28
#: N-grams that a task holds before it sends them on.
HELD = 2_000_000
#: Documents for each range of hashes that one task merges.
DOCS_PER_RANGE = 1 << 14
#: Members of a posting list in one block of a product.
TILE = 1024
#: What a member of a list brings to a product at most: its least first columns, and bits of its bitmap.
LEAST_FIRSTS, SKETCH = 24, 4096

FACTS = "doc_id long, n long, high long, low long, bits binary, part int, packed binary"
KIND = pa.schema(
    [
        *((c, pa.int64()) for c in ("doc_id", "n", "high", "low")),
        ("bits", pa.binary()), ("part", pa.int32()), ("packed", pa.binary()),
    ]
)


def _signature(grams: np.ndarray) -> tuple[int, int]:
    high, low = np.frombuffer(blake2b(grams.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(high), int(low)


def set_bits(grams: np.ndarray) -> bytes:
    """A bitmap by the n-grams' lowest bits, a power of two: 16 bits for each n-gram up to ``SKETCH``, two at least beyond."""
    size = max(min(SKETCH, 1 << int(16 * len(grams) - 1).bit_length()), 1 << int(2 * len(grams) - 1).bit_length(), 1024)
    bits = np.zeros(size, dtype=bool)
    bits[(grams & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_at_most(n_a: int, a: bytes, n_b: int, b: bytes) -> int:
    """Upper bound of two sets' overlap: a bit that one has alone stands for an n-gram that it has alone."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):  # fold the longer one
        if len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def _packed(sorted_hashes: np.ndarray) -> bytes:
    steps = np.diff(sorted_hashes, prepend=np.uint32(0)).astype(np.uint32)
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    steps = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def facts(docs: DataFrame, doc_id: str, text: str, n: int, parts: int) -> DataFrame:
    """Per document its number of n-grams and signature; in rows of their own, packed n-gram hashes by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            part = (every.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            runs = [(i, _packed(every[cuts[i] : cuts[i + 1]])) for i in range(parts) if cuts[i] < cuts[i + 1]]
            none = [None] * len(runs)
            columns = [none, none, none, none, none, [r[0] for r in runs], [r[1] for r in runs]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, KIND)], schema=KIND)

        for batch in batches:
            sizes, highs, lows, bits = [], [], [], []
            for words in word_hashes(batch.column(1)):
                grams = shingles(words, n)
                high, low = _signature(grams) if len(grams) else (None, None)
                sizes.append(len(grams))
                highs.append(high)
                lows.append(low)
                bits.append(set_bits(grams) if len(grams) else None)
                if len(grams):
                    held.append((grams >> np.uint64(32)).astype(np.uint32))
                    size += len(grams)
                if size >= HELD:
                    yield sent()
                    held, size = [], 0
            none = [None] * len(sizes)
            columns = [batch.column(0), sizes, highs, lows, bits, none, none]
            yield pa.record_batch(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, KIND)], schema=KIND
            )
        if held:
            yield sent()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, FACTS)


def common_grams(packed: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of common n-grams (sorted), their counts, and the bitmap of those that occur at least twice."""
    bits_each = -(-BITMAP // parts)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        every = np.concatenate([_unpacked(b) for b in table.column("packed").to_pylist()])
        hashes, counts = np.unique(every, return_counts=True)
        twice = hashes[counts > 1].astype(np.uint64)
        bits = np.zeros(bits_each + 8, dtype=bool)
        bits[((twice * np.uint64(BITMAP)) >> np.uint64(32)).astype(np.int64) - int(key[0].as_py()) * BITMAP // parts] = True
        often = counts >= COMMON_FROM
        return pa.table(
            {
                "part": pa.array([key[0].as_py()], pa.int32()),
                "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary()),
                "hashes": pa.array([hashes[often].tolist()], pa.list_(pa.int64())),
                "counts": pa.array([counts[often].tolist()], pa.list_(pa.int64())),
            }
        )

    schema = "part int, bits binary, hashes array<long>, counts array<long>"
    found = landed(packed.groupBy("part").applyInArrow(merged, schema))
    each = found.select(F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select("x.hashes", "x.counts")
    levels = each.groupBy(F.floor(F.log2("counts")).cast("int").alias("level")).count().collect()
    bound, total = COMMON_FROM, 0
    for level in sorted((r["level"] for r in levels), reverse=True):
        total += next(r["count"] for r in levels if r["level"] == level)
        if total > COMMON:
            bound = 1 << (level + 1)
            break
    kept = each.filter(F.col("counts") >= bound).toArrow()
    order = np.argsort(kept["hashes"].to_numpy())
    bitmap = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in found.select("part", "bits").toLocalIterator():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8))
        at = np.flatnonzero(bits) + r["part"] * BITMAP // parts
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return kept["hashes"].to_numpy()[order].astype(np.uint32), kept["counts"].to_numpy()[order], bitmap


def first_columns(grams: np.ndarray, percent: int, hashes: np.ndarray, counts: np.ndarray, bitmap: np.ndarray) -> tuple:
    """The n-grams by which a set must be found, and how many of its n-grams other documents may have.

    None at all when too many of its n-grams are its own for any partner.
    """
    h = (grams >> np.uint64(32)).astype(np.uint32)
    bit = ((h.astype(np.uint64) * np.uint64(BITMAP)) >> np.uint64(32)).astype(np.int64)
    shared = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
    common = int(shared.sum())
    if 100 * common < percent * len(grams):
        return grams[:0], common
    count = np.zeros(len(grams), dtype=np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        count = np.where(hashes[at] == h, counts[at], 0)
    least = -(-percent * len(grams) // 100)
    first = np.lexsort((grams, count))[: len(grams) - least + 1]
    return grams[first[shared[first] > 0]], common


POSTS = "gram long, doc_id long, n long, common long, high long, low long"
POST_KIND = pa.schema([(c, pa.int64()) for c in ("gram", "doc_id", "n", "common", "high", "low")])


def postings(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """(gram, node, n, common) of each distinct set's first columns; the node is the least id that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, each = batch.column(0).to_pylist(), [], []
            for key, words in zip(ids, word_hashes(batch.column(1))):
                grams = shingles(words, n)
                if key is None or not len(grams):
                    continue
                columns, common_ = first_columns(grams, percent, *shared.value)
                if len(columns):
                    out.append(columns)
                    each.append((len(columns), key, len(grams), common_, *_signature(grams)))
            if not out:
                continue
            facts_ = np.repeat(np.array([e[1:] for e in each], dtype=np.int64), [e[0] for e in each], axis=0)
            columns = [np.concatenate(out).view(np.int64), *facts_.T]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], schema=POST_KIND)

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, POSTS)
    # Rows of one signature agree in n and common.
    sets = rows.groupBy("gram", "high", "low").agg(
        F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("common").alias("common")
    )
    return sets.select("gram", "node", "n", "common")


def of_nodes(rows: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """The rows whose key is one of the nodes: what is wide goes no further than it must."""
    found = among(rows, F.col(key), nodes)
    return rows.join(nodes.select(F.col("node").alias(key)), key, "left_semi") if found is None else found


def sets_of(docs: DataFrame, doc_id: str, text: str, n: int, nodes: DataFrame) -> DataFrame:
    """(node, grams) of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                grams = [shingles(w, n).view(np.int64) for w in word_hashes(part.column(1))]
                yield pa.record_batch([part.column(0), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"])

    return of_nodes(docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text)), "node", nodes).mapInArrow(run, "node long, grams array<long>")


def sizes_allow(n_a: Column, common_a: Column, n_b: Column, common_b: Column, percent: int) -> Column:
    """No more than what others may have of either set can overlap."""
    most = F.least(common_a, common_b)
    return 100 * most >= percent * (n_a + n_b - most)


def bounded_pairs(pairs: DataFrame, known_facts: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sizes and bitmaps leave possible."""

    @F.arrow_udf("boolean")
    def possible(n_a: pa.Array, a: pa.Array, n_b: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for n, x, m, y in zip(n_a.to_pylist(), a.to_pylist(), n_b.to_pylist(), b.to_pylist()):
            most = overlap_at_most(n, x, m, y)
            out.append(100 * most >= percent * (n + m - most))
        return pa.array(out, pa.bool_())

    pairs = landed(pairs)
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    rows = of_nodes(known_facts.filter(F.col("n") > 0), "doc_id", landed(ends))
    one = rows.select(F.col("doc_id").alias("u"), F.col("n").alias("n_a"), F.col("bits").alias("a"))
    two = rows.select(F.col("doc_id").alias("v"), F.col("n").alias("n_b"), F.col("bits").alias("b"))
    return pairs.join(one, "u").join(two, "v").filter(possible("n_a", "a", "n_b", "b")).select("u", "v").distinct()


def products(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose overlap over all columns is large enough."""
    one = sets.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    overlap = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - overlap
    return pairs.join(one, "u").join(two, "v").filter(100 * overlap >= percent * union).select("u", "v").distinct()


def _with_component(posts: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return posts.withColumn("component", F.col("node"))
    return posts.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def leader_pairs(posts: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every member of a posting list that spans components, with some leaders of the list from other components."""
    who = F.struct("node", "n", "common", "component")
    leaders = F.array(*[F.min_by(who, F.xxhash64("node", F.lit(10 * turn + i))) for i in range(LEADERS[turn])])
    lists = (
        posts.groupBy("gram")
        .agg(leaders.alias("leaders"), F.min("component").alias("_least"), F.max("component").alias("_most"))
        .filter(F.col("_least") < F.col("_most"))
        .select("gram", "leaders")
    )
    met = posts.join(lists, "gram").withColumn("leader", F.explode("leaders"))
    apart = (F.col("leader.component") != F.col("component")) & (F.col("leader.node") != F.col("node"))
    possible = sizes_allow(F.col("leader.n"), F.col("leader.common"), F.col("n"), F.col("common"), percent)
    return met.filter(apart & possible).select(*_pair("node", "leader.node")).distinct()


def _stacked(bitmaps: list[bytes]) -> list[np.ndarray]:
    """For each size of bitmaps one matrix, longer ones folded to it; rows of shorter ones stay empty, nobody asks for them."""
    rows = [np.frombuffer(b, np.uint64) for b in bitmaps]
    out = []
    for size in sorted({len(x) for x in rows}):
        matrix = np.zeros((len(rows), size), dtype=np.uint64)
        for at, x in enumerate(rows):
            if len(x) >= size:
                matrix[at] = np.bitwise_or.reduce(x.reshape(-1, size))
        out.append(matrix)
    return out


def _possible(
    row: int, rows: np.ndarray, n: np.ndarray, common: np.ndarray, size: np.ndarray, bits: list[np.ndarray], percent: int
) -> np.ndarray:
    """Which of some rows a row may be similar to, by counts and bitmaps; ``size``: places of their bitmaps' sizes."""
    most = np.minimum(common[rows], common[row])
    rows = rows[100 * most >= percent * (n[rows] + n[row] - most)]
    found = []
    for at in np.unique(np.minimum(size[rows], size[row])).tolist():
        some = rows[np.minimum(size[rows], size[row]) == at]
        x, y = bits[at][row], bits[at][some]
        lacks = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
        adds = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[row] - lacks, n[some] - adds)
        found.append(some[100 * most >= percent * (n[some] + n[row] - most)])
    return np.concatenate(found) if found else rows[:0]


def sketches(rows: DataFrame) -> DataFrame:
    """(node, bits): bitmaps folded to ``SKETCH`` bits at most."""

    @F.arrow_udf("binary")
    def folded(bits: pa.Array) -> pa.Array:
        out = []
        for b in bits.to_pylist():
            x = np.frombuffer(b, np.uint64)
            while 64 * len(x) > SKETCH:
                x = x[: len(x) // 2] | x[len(x) // 2 :]
            out.append(x.tobytes())
        return pa.array(out, pa.binary())

    return rows.filter(F.col("n") > 0).select(F.col("doc_id").alias("node"), folded("bits").alias("bits"))


def remaining_pairs(posts: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of a posting list that lie in different components and that counts and sketches allow.

    A list that spans components is cut into blocks of about ``TILE`` members, and each pair of
    blocks is one task's product.  Lists go by 32 bits of their n-gram; lists that share them are one list
    of more pairs.  A member brings a sketch and the least ``LEAST_FIRSTS`` of its lists, so that what is sent
    grows with the texts, not with their squares.  A pair leaves the least list that it shares; another one
    passes it over where the members' least lists show that, so some pairs leave more than once, none never.
    """
    posts = posts.withColumn("gram", F.shiftright("gram", 32).cast("int"))
    lists = (
        posts.groupBy("gram")
        .agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("_n"))
        .filter("_a < _b")
        .select("gram", F.ceil(F.col("_n") / TILE).cast("int").alias("blocks"))
    )
    members = landed(posts.join(lists, "gram"))
    firsts = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("gram")), 1, LEAST_FIRSTS).alias("firsts"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (
        members.join(firsts, "node")
        .join(sketches(of_nodes(rows, "doc_id", landed(firsts.select("node")))), "node")
        .withColumns({"block": block, "other": other})
        .select(
            "gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            "block", "node", "n", "common", "component", "firsts", "bits",
        )
    )

    def product(key: tuple, table: pa.Table) -> pa.Table:
        gram, i, j = (k.as_py() for k in key)
        node, n, common, component, side = (
            table.column(c).to_numpy() for c in ("node", "n", "common", "component", "block")
        )
        bits = table.column("bits").to_pylist()
        size = np.unique([len(b) for b in bits], return_inverse=True)[1]
        bitmaps = _stacked(bits)
        shared = [frozenset(f) for f in table.column("firsts").to_pylist()]
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        pairs = []
        for row in left.tolist():
            rest = right[component[right] != component[row]]
            if i == j:
                rest = rest[node[rest] > node[row]]
            for at in _possible(row, rest, n, common, size, bitmaps, percent).tolist():
                if min(shared[row] & shared[at], default=gram) >= gram:
                    pairs.append((max(node[row], node[at]), min(node[row], node[at])))
        u, v = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"u": pa.array(np.ascontiguousarray(u)), "v": pa.array(np.ascontiguousarray(v))})

    return placed.groupBy("gram", "i", "j").applyInArrow(product, "u long, v long").distinct()


def similar_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id it reaches by links)."""
    parts = max(32, -(-docs.count() // DOCS_PER_RANGE))
    known_facts = landed(facts(docs, doc_id, text, n, parts))
    packed = known_facts.filter(F.col("part").isNotNull()).select("part", "packed")
    shared = docs.sparkSession.sparkContext.broadcast(common_grams(packed, parts))
    posts = landed(postings(docs, doc_id, text, n, percent, shared))
    shared.destroy()
    alone = posts.groupBy("gram").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    posts = landed(posts.join(alone.select("gram"), "gram", "left_semi"))
    rows = known_facts.filter(F.col("part").isNull())

    found = None
    for turn in range(len(LEADERS) + 1):
        spread = _with_component(posts, found)
        if turn:
            spread = landed(spread)
        met = leader_pairs(spread, turn, percent) if turn < len(LEADERS) else remaining_pairs(spread, rows, percent)
        pairs = landed(bounded_pairs(met, rows, percent))
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        sets = landed(sets_of(docs, doc_id, text, n, landed(ends)))
        new = landed(products(pairs, sets, percent))
        if found is not None:
            if new.isEmpty():
                continue
            # What is known so far are stars already.
            new = new.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
        found = landed(components(new))

    rows = rows.select("doc_id", "n", "high", "low")
    same = (
        rows.filter(F.col("high").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("high", "low")
        .agg(F.min("doc_id").alias("node"))
        .join(found, "node", "left")
        .select("high", "low", F.coalesce("component", "node").alias("component"))
    )
    placed = rows.join(same, ["high", "low"], "left")
    out = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), out.alias("component_id"))
