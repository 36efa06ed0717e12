"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

Tokenizer A (byte-level BPE) gets a space and the text, tokenizer B (pieces) the text, to
which it adds the space itself.  After both have encoded the whole text, the joined bytes
of the tokens are compared with the text's; only then are ends of A and B places in the same bytes.

Ends that A and B share before white space cut a document into windows: these are the parts of
``tokenizing``, which both tokenizers encode each for itself.  What a window aligns to is the same wherever it
stands: groups (between neighbouring shared ends) and links (tokens whose byte ranges overlap).  A worker remembers
the windows it has seen, ``MEMO`` at most, so only distinct ones are encoded and aligned.  Texts with a window whose
tokens do not give back its bytes, or in which white space may mean something else, are one window each.

Counts of linked id pairs over all documents are a grouped sum of each document's distinct
pairs.  Documents are scored against them by look-ups in a broadcast table while there are
at most ``BROADCAST_PAIRS`` pairs (16 bytes each), and by a join on the pair beyond, with equal results.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes, have
zeros and an empty digest; repeated rows are documents of their own and count as such; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import fits, landed
from sparkaudit.llm.tokenizing import Slots, chunks, parts_of, ranges, text_array

#: Windows a worker remembers.
MEMO = 400_000
#: Pieces whose ids of A it remembers.
PARTS = 400_000
#: Rows of the table of pair counts that may be broadcast.
BROADCAST_PAIRS = 3_000_000
#: Texts are handed to the piece tokenizer in sections of about so many characters.
SECTION = 1 << 17
A_BITS = 32
#: Links remembered for each window that may be: windows can be long.
LINKS_EACH = 16
#: A space after something else and before something.
SPACE = re.compile("(?<=[^ ▁]) (?=.)", re.DOTALL)

_aligners: dict = {}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the windows seen so far."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        from sparkaudit.llm.tokenizing import byte_level

        self.a = byte_level(a_path, special_as_text=True, memo=PARTS)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * self.a.vocab
        letters = byte_letters()
        for token, i in self.a.tokenizer.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # Sections may be cut before spaces only if no piece goes on from something else to a space.
        self.in_sections = not any("▁" in p[1:] and p.strip("▁") for p in pieces)
        # A line end is a piece of its own, so B goes on behind it as after nothing.
        self.in_lines = not any("\n" in p and p != "\n" for p in pieces)
        self.a_size, self.b_size = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.memo: dict[str, int] = {}
        # Of each window: links as packed pairs, groups as text, and its counts of ids of A, of B, and of groups (0: no window).
        self.links = Slots(np.int64)
        self.counts = Slots(np.int64)
        self.texts: list[str] = []

    def forget(self) -> None:
        self.memo.clear()
        self.links.clear()
        self.counts.clear()
        self.texts.clear()

    def b_ids(self, texts: list[str]) -> list[np.ndarray]:
        """B's ids; long texts in sections that end before a space, which B adds again."""
        sections, owner = [], []
        for i, text in enumerate(texts):
            for part in sections_of(text) if self.in_sections else [text]:
                sections.append(part)
                owner.append(i)
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in zip(owner, self.b.encode(sections, num_threads=1)):
            out[i] += ids
        return [np.array(ids, dtype=np.int64) for ids in out]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Verified ids of A and B for each text; empty ones where the bytes differ."""
        spaced = [f" {t}" if t else "" for t in texts]
        none = np.empty(0, dtype=np.int64)
        out = []
        for text, a, b in zip(spaced, self.a.encode(spaced), self.b_ids(texts)):
            a = np.frombuffer(a, "<u4").astype(np.int64)
            whole = text.encode()
            same = joined(self.a_bytes, a) == whole and joined(self.b_bytes, b) == whole
            out.append((a, b) if same else (none, none))
        return out

    def windows(self, a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> tuple:
        """Groups as text, links, how many of them, and how many groups of each window; ids of all windows joined."""
        # Both sides of a window have as many bytes, so one after the other they stay side by side.
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # Between neighbouring ends one token of A and one of B cover all bytes: that is a link.
        ends = np.union1d(a_end, b_end)
        i, j = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        shared = np.flatnonzero(a_end[i] == b_end[j])
        names = self.names
        a_names, b_names = [names[x] for x in a.tolist()], [names[x] for x in b.tolist()]
        texts, x, y = [], 0, 0
        for k, m in zip((i[shared] + 1).tolist(), (j[shared] + 1).tolist()):
            texts.append(f"{a_names[x]}|{b_names[y]}" if k - x == 1 == m - y else ",".join(a_names[x:k]) + "|" + ",".join(b_names[y:m]))
            x, y = k, m
        last = np.searchsorted(ends, a_end[np.cumsum(a_sizes) - 1])
        group_ends = np.searchsorted(shared, last) + 1
        said, at = [], 0
        for end in group_ends.tolist():
            said.append(";".join(texts[at:end]))
            at = end
        return said, a[i] << A_BITS | b[j], np.diff(last + 1, prepend=0), np.diff(group_ends, prepend=0)

    def learn(self, parts: list[str]) -> None:
        """Encode and align windows not seen before; one whose tokens do not give back its bytes has no groups."""
        a, a_sizes = self.a.part_ids(parts)
        a = a.astype(np.int64)
        # B adds a space: in place of the one that a window begins with, or to be dropped before a line end.
        found = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        found = [ids if p[0] == " " else ids[1:] for p, ids in zip(parts, found)]
        b_sizes = np.fromiter(map(len, found), np.int64, len(found))
        b = np.array([x for ids in found for x in ids], dtype=np.int64)
        raw = "".join(parts).encode()
        byte_ends = np.cumsum([len(p.encode()) for p in parts])
        ends = [np.append(0, np.cumsum(size[ids]))[np.cumsum(n)] for size, ids, n in ((self.a_size, a, a_sizes), (self.b_size, b, b_sizes))]
        if joined(self.a_bytes, a) == raw == joined(self.b_bytes, b) and all((e == byte_ends).all() for e in ends):
            good = np.ones(len(parts), dtype=bool)
        else:
            a_each, b_each = (np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((a, a_sizes), (b, b_sizes)))
            good = np.array([
                joined(self.a_bytes, x) == p.encode() == joined(self.b_bytes, y) for p, x, y in zip(parts, a_each, b_each)
            ])
            a, b = a[np.repeat(good, a_sizes)], b[np.repeat(good, b_sizes)]
        sizes, counts = np.zeros(len(parts), dtype=np.int64), np.zeros((len(parts), 3), dtype=np.int64)
        said, links = [], np.empty(0, dtype=np.int64)
        if good.any():
            said, links, sizes[good], counts[good, 2] = self.windows(a, a_sizes[good], b, b_sizes[good])
            counts[good, 0], counts[good, 1] = a_sizes[good], b_sizes[good]
        each = iter(said)
        self.texts += [next(each) if ok else "" for ok in good.tolist()]
        self.links.add(links, sizes)
        self.counts.add(counts.ravel(), np.full(len(parts), 3))
        self.memo.update(zip(parts, range(len(self.memo), len(self.memo) + len(parts))))

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts are one window."""
        if not self.in_sections:
            return np.ones(len(texts), dtype=bool)
        found = self.a.whole(texts)
        for mark in ["▁"] + ["\n"] * (not self.in_lines):
            found = found | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        return found

    def aligned_whole(self, text: str) -> tuple:
        a, b = self.tokens([text])[0]
        if not len(a):
            return 0, 0, 0, 0, "", a, a
        said, links, n_links, n_groups = self.windows(a, np.array([len(a)]), b, np.array([len(b)]))
        pairs, times = np.unique(links, return_counts=True)
        return len(a), len(b), int(n_groups[0]), int(n_links[0]), said[0], pairs, times

    def aligned(self, texts: list[str] | pa.Array) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups as text, distinct pairs, their occurrences) of each text."""
        texts = text_array(texts)
        for chunk in chunks(texts):
            yield from self._chunk(chunk)

    def _chunk(self, texts: pa.Array) -> Iterator[tuple]:
        filled = pc.not_equal(texts, "")
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        spaced = pc.if_else(filled, pc.binary_join_element_wise(space, texts, none), texts)
        whole = self.whole(texts)
        codes, distinct, ends = parts_of(pc.if_else(pa.array(whole), none, spaced))
        if len(self.memo) > MEMO or self.links.used > LINKS_EACH * MEMO:
            self.forget()
        new = [p for p in distinct if p not in self.memo]
        if new:
            self.learn(new)
        windows = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))[codes]
        # Counts of a text: differences of running totals where it ends.
        totals = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        table = self.counts.values[: self.counts.used].reshape(-1, 3)
        n_a, n_b, n_groups = (totals(table[windows, k]) for k in range(3))
        whole |= totals(table[windows, 2] == 0) > 0
        links, sizes = self.links.get(windows)
        n_links = totals(sizes)
        # Pairs by text, as one number each.
        n_ids = len(self.names)
        owner = np.repeat(np.arange(len(texts)), n_links)
        keys = np.sort((owner * n_ids + (links >> A_BITS)) * n_ids + (links & ((1 << A_BITS) - 1)))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
        times, keys = np.diff(np.append(first, len(keys))), keys[first]
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * (n_ids * n_ids)).tolist()
        pairs = (keys // n_ids % n_ids) << A_BITS | keys % n_ids
        numbers, said = windows.tolist(), self.texts
        for i, (start, end) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            if whole[i]:
                yield self.aligned_whole(texts[i].as_py())
                continue
            own = slice(cuts[i], cuts[i + 1])
            groups = ";".join([said[w] for w in numbers[start:end]])
            yield int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i]), groups, pairs[own], times[own]


def joined(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def sections_of(text: str) -> list[str]:
    """Parts of about ``SECTION`` characters whose joint by single spaces is the text; each starts with what follows a space."""
    out, at = [], 0
    while len(text) - at > SECTION:
        inner = SPACE.search(text, at + SECTION)
        if not inner:
            break
        out.append(text[at : inner.start()])
        at = inner.start() + 1
    return [*out, text[at:]]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner for two tokenizer files; made once."""
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(a_path, b_path)
    return _aligners[key]


COLUMNS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<int>"
)


def as_array(column: pa.Array | tuple, kind: pa.DataType) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    if column and pa.types.is_list(kind):
        ends = np.cumsum([0, *map(len, column)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(column), kind.value_type))
    return pa.array(list(column), kind)


def alignments(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """One row per document: ``COLUMNS`` (and the groups themselves where asked for); ``pairs`` are id of A << 32 | id of B."""
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for n_a, n_b, n_groups, n_links, said, pairs, times in both.aligned(batch.column(1)):
                digest = hashlib.sha256(said.encode()).hexdigest() if n_a else ""
                rows.append((row, n_a, n_b, n_groups, n_links, digest, pairs, times.astype(np.int32), *([said] if groups else [])))
                row += 1
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 1 + groups)
            columns.insert(1, batch.column(0))
            types = kinds + [pa.string()] * groups
            arrays = [as_array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names + ["groups"] * groups)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, COLUMNS + (", groups string" if groups else ""))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each linked pair, and whether no other pair of its A id has more."""
    counts = landed(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.shiftrightunsigned("pair", A_BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(found: DataFrame) -> DataFrame:
    """Alignments with n_best (links whose pair is the best of its A id) and count_sum (of all links), instead of the pairs."""
    counts = landed(pair_counts(found))
    if fits(counts, BROADCAST_PAIRS):
        return scored_by_lookup(found, counts)
    return scored_by_join(found, counts)


def scored_by_lookup(found: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.toArrow()
    pair = table["pair"].to_numpy()
    order = np.argsort(pair)
    # The sign tells the best ones.
    n = np.where(table["best"].to_numpy(), -table["n"].to_numpy(), table["n"].to_numpy())[order]
    shared = found.sparkSession.sparkContext.broadcast((pair[order], n))
    kept = [c for c in found.columns if c not in ("row", "pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted = shared.value
        for batch in batches:
            pairs, times = batch["pairs"], batch["times"]
            links = times.flatten().to_numpy().astype(np.int64)
            value = counted[np.searchsorted(known, pairs.flatten().to_numpy())] if len(links) else links
            ends = np.append(0, np.cumsum(pairs.value_lengths().to_numpy()))
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
            sums = [pa.array(total(links * (value < 0)), pa.int64()), pa.array(total(links * np.abs(value)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *sums], [*kept, "n_best", "count_sum"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in kept]
    return found.mapInArrow(run, ", ".join([*fields, "n_best long", "count_sum long"]))


def scored_by_join(found: DataFrame, counts: DataFrame) -> DataFrame:
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    sums = (
        each.join(counts, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    )
    none = F.lit(0).cast("long")
    out = found.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(F.col(c), none) for c in ("n_best", "count_sum")})


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """Each document's digest of its alignment, scored against all documents."""
    return scored(landed(alignments(docs, a_path, b_path, doc_id, text, groups)))
