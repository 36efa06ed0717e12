"""Token-id files: documents' ids in a compressed binary format, in ascending order of document.

A file holds the ids of its documents, one after the other, each closed by an end id, cut
into blocks of ``BLOCK`` ids whatever the documents' lengths.  Every block is compressed by
itself (``range_coder``: order-0 to order-2 id predictions mixed adaptively), its model starts
anew, and it carries a CRC-32 of its bytes and one of its ids.  All integers are little-endian:

    file    magic, vocab u32, blocks..., index, index length u64, blocks u64, index CRC-32 u32, magic
    block   ids u32, lanes u32, words u32, CRC-32 of ids u32, CRC-32 of what follows u32, words of each lane u16, words u32
    index   documents u64, then for all documents: 1 if it has a key u8, keys i64, ids u64

So a damaged block is found before its ids are used, and costs no other block.

Documents are dealt to files by ranges of (key, hash of the text, row), so that a key
that very many rows share spreads over files; a file takes about ``FILE_BYTES`` of text.
A task writes under a name of its own and renames the whole file, so one run
again leaves no halves.  Which ids a document starts after follows from the files' totals, a
running total by range over one row per file.

Defined results: a null or empty text has the end id only; documents of equal key stand in the order of
their texts' hash, repeated rows each for itself; null keys come first; an empty table
gives an empty folder and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.llm import range_coder
from sparkaudit.llm.common import landed
from sparkaudit.operators.ordering import running_total

MAGIC = b"TIDS0001"
BLOCK = 1 << 20
FILE_BYTES = 32 << 20
#: Ids in one Arrow batch of documents read.
BATCH_IDS = 1 << 20

HEAD = struct.Struct("<8sI")
BLOCK_HEAD = struct.Struct("<5I")
FOOT = struct.Struct("<QQI8s")


def packed_block(ids: np.ndarray, vocab: int) -> bytes:
    words, lengths = range_coder.encoded(ids, vocab)
    body = lengths.astype("<u2").tobytes() + words.astype("<u4").tobytes()
    return BLOCK_HEAD.pack(len(ids), len(lengths), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def unpacked_block(data: memoryview, at: int, vocab: int) -> tuple[np.ndarray, int]:
    """Ids of the block at a place, and the place after it."""
    n, lanes, words, ids_crc, crc = BLOCK_HEAD.unpack_from(data, at)
    at += BLOCK_HEAD.size
    end = at + 2 * lanes + 4 * words
    if end > len(data) or zlib.crc32(data[at:end]) != crc:
        raise ValueError("a block of token ids is damaged")
    lengths = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
    ids = range_coder.decoded(np.frombuffer(data, "<u4", words, at + 2 * lanes), lengths, n, vocab).astype("<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("a block of token ids does not decode to what was written")
    return ids, end


class FileWriter:
    """Writes one file from documents as they come; holds one block and the index."""

    def __init__(self, out, vocab: int):
        self.out, self.vocab = out, vocab
        self.waiting, self.waiting_ids, self.blocks = [], 0, 0
        self.keys, self.known, self.sizes = [], [], []
        out.write(HEAD.pack(MAGIC, vocab))

    def add(self, key: int | None, ids: bytes) -> None:
        self.known.append(key is not None)
        self.keys.append(key or 0)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.waiting_ids += len(ids) // 4
        if self.waiting_ids >= BLOCK:
            self.flush(BLOCK)

    def flush(self, least: int) -> None:
        """Write what waits in blocks; a rest of fewer than ``least`` ids waits on."""
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        at = 0
        while len(ids) - at >= max(least, 1):
            self.out.write(packed_block(ids[at : at + BLOCK], self.vocab))
            self.blocks += 1
            at = min(at + BLOCK, len(ids))
        self.waiting, self.waiting_ids = [ids[at:].tobytes()], len(ids) - at

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file."""
        self.flush(1)
        index = struct.pack("<Q", len(self.keys)) + bytes(self.known)
        index += np.array(self.keys, dtype="<i8").tobytes() + np.array(self.sizes, dtype="<u8").tobytes()
        self.out.write(index + FOOT.pack(len(index), self.blocks, zlib.crc32(index), MAGIC))
        return len(self.keys), sum(self.sizes)


def parse_file(data: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Keys and id counts of a file's documents, and its blocks of ids, each decoded when asked for."""
    view = memoryview(data)
    magic, vocab = HEAD.unpack_from(view, 0)
    length, blocks, crc, again = FOOT.unpack_from(view, len(data) - FOOT.size)
    start = len(data) - FOOT.size - length
    if magic != MAGIC or again != MAGIC or zlib.crc32(view[start : start + length]) != crc:
        raise ValueError("not a whole file of token ids")
    n = struct.unpack_from("<Q", view, start)[0]
    known = np.frombuffer(view, "u1", n, start + 8)
    keys = np.frombuffer(view, "<i8", n, start + 8 + n).tolist()
    sizes = np.frombuffer(view, "<u8", n, start + 8 + 9 * n).astype(np.int64)

    def ids() -> Iterator[np.ndarray]:
        at = HEAD.size
        for _ in range(blocks):
            block, at = unpacked_block(view, at, vocab)
            yield block

    return [k if flag else None for k, flag in zip(keys, known)], sizes, ids()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents; one row per file: (file, documents, ids)."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    narrow = docs.select(F.col(doc_id).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    files = max(1, -(-size // FILE_BYTES))
    order = ["key", "_hash", "_row"]
    dealt = narrow.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(files, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkaudit.llm.tokenizing import byte_level

        encoder, end = byte_level(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.tids"
        own = f"{base}/_{name}.{uuid.uuid4().hex}"
        writer = None
        with store.open_output_stream(own) as out:
            writer = FileWriter(out, max(encoder.vocab, end_id + 1))
            for batch in batches:
                for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                    writer.add(key, ids + end)
            documents, ids = writer.close()
        if documents:
            store.move(own, f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "documents": documents, "ids": ids}])
        else:
            store.delete_file(own)

    return landed(dealt.mapInArrow(run, "file string, documents long, ids long"))


def read_token_files(spark: SparkSession, folder: str, written: DataFrame, ids: bool = True) -> DataFrame:
    """Documents of a folder's files: (doc_id, start, n_tokens, ids_crc32) and, where asked for, their ids.

    ``written`` is what ``write_token_files`` gave.  ``start`` counts the ids of all documents before.
    """
    schema = pa.schema([
        ("file", pa.string()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
        *([("ids", pa.list_(pa.int32()))] if ids else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from documents_of(path.rsplit("/", 1)[-1], content.as_buffer())

    def documents_of(file: str, data) -> Iterator[pa.RecordBatch]:
        keys, sizes, blocks = parse_file(data)
        rows, held, inside = [], 0, 0
        block, at = np.empty(0, dtype="<u4"), 0
        for key, size in zip(keys, sizes.tolist()):
            crc, left, parts = 0, size, []
            while left:
                if at == len(block):
                    block, at = next(blocks), 0
                part = block[at : at + left]
                at, left = at + len(part), left - len(part)
                crc = zlib.crc32(part.tobytes(), crc)
                if ids:
                    parts.append(part)
            rows.append((file, key, inside, size, crc, *([np.concatenate(parts).astype(np.int32)] if ids else [])))
            inside += size
            held += size if ids else 64
            if held > BATCH_IDS:
                yield to_batch(rows)
                rows, held = [], 0
        if at != len(block) or next(blocks, None) is not None:
            raise ValueError("a file's ids are not those of its documents")
        yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    columns = "file string, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tids").load(folder).select("path", "content")
    starts = running_total(written, "ids", ["file"], [], "first").select("file", "first")
    read = found.mapInArrow(run, columns).join(starts, "file")
    return read.select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []), "file"
    )
