"""Substring deduplication by hashing lines, cut further at sentence ends.

Each text is cut into units: its lines, and in a line its sentences, because passages
that documents share are often set inside a line, where whole lines differ.  A unit is
normalised (lower case, runs of blanks as one, no punctuation at its ends) and hashed
to 128 bits.  Digests are grouped globally, the earliest occurrence by (document,
offset) is kept, and all later ones are removed, with their offsets in the original
text and the place of the kept one.

Only (digest, document, offset) is shuffled, in partial minima first, so a line that
stands in a third of all documents is one row per task.  Digests that occur once end
there; the others go back to the units by a broadcast when there are at most
``BROADCAST_DIGESTS`` of them, else by a join whose large partitions adaptive execution
can split.  Units are cut anew for that second pass rather than stored.

Defined results: null and empty texts have no units; units of fewer than ``least``
words are left alone; offsets count code points, end exclusive; a null document id
ranks last; rows that repeat a document id tie, and occurrences that tie for the
earliest place are all kept.  Texts are read whole.  Other columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import fits, free_name, landed

LEAST = 6
BROADCAST_DIGESTS = 50_000
CUT = re.compile(r"\n|(?<=[.!?])[ \t\r]+")
EDGE = " \t\r\f\v.,;:!?\"'()[]-"

UNITS = "doc_id long, start int, end int, high long, low long"
KIND = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]
)


def units_of(text: str, least: int = LEAST) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit of enough words."""
    at = 0
    for start, end in [*(m.span() for m in CUT.finditer(text)), (len(text), len(text))]:
        unit = text[at:start]
        words = unit.lower().split()
        if len(words) >= least:
            words[0], words[-1] = words[0].lstrip(EDGE), words[-1].rstrip(EDGE)
            yield at, start, blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        at = end


def units(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, starts, ends, digests = [], [], [], []
                part = batch.slice(at, 256)
                for key, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for start, end, digest in units_of(t or "", least):
                        ids.append(key)
                        starts.append(start)
                        ends.append(end)
                        digests.append(digest)
                halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                columns = [ids, starts, ends, halves[:, 0], halves[:, 1]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, KIND)], schema=KIND)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, UNITS)


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The units to remove: doc_id, start, end, kept_doc_id, kept_start."""
    found = units(docs, doc_id, text, least)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    first = landed(
        found.groupBy("high", "low")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("high", "low", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))
    )
    if fits(first, BROADCAST_DIGESTS):
        first = F.broadcast(first)
    kept = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start"))
    return (
        found.join(first, ["high", "low"]).filter(~kept).select("doc_id", "start", "end", "kept_doc_id", "kept_start")
    )


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, removed: str = "removed"
) -> DataFrame:
    """The documents without their repeated units; the new column ``removed`` lists the spans that went."""
    key, spans = free_name(docs.columns, "_key"), free_name(docs.columns, removed)
    gone = (
        repeated_units(docs, doc_id, text, least)
        .groupBy(F.col("doc_id").alias(key))
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(spans))
    )

    @F.arrow_udf("string")
    def rest(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(texts.to_pylist(), cuts.to_pylist()):
            at, kept = 0, []
            for span in c or []:
                kept.append(t[at : span["start"]])
                at = span["end"]
            out.append(None if t is None else "".join(kept) + t[at:])
        return pa.array(out, pa.string())

    joined = docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col(key)), "left").drop(key)
    return joined.withColumn(text, rest(F.col(text), F.col(spans)))
