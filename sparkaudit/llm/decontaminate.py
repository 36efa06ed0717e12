"""Benchmark decontamination by spaced seeds.

A seed is a mask over a short window of tokens; positions where the mask is 0 are
ignored, so a substituted word there does not break the match.  Every window of the
benchmark and of the documents is hashed under each mask, hashes are joined, and each
hit names a diagonal (place in the document less place in the item).  Around a hit the
whole item is laid along its diagonal over the document: a token that agrees adds one, one
that differs takes one off, and the best-scoring stretch decides.  A stretch must reach
``ENOUGH`` or half of a shorter item, at least ``LEAST``, so short phrases that texts share by
chance or custom stay, and a passage with some words changed is found.

Only DataFrame and SQL functions are used.  Windows are made by a generator inside whole-stage
code; they meet the seeds by a broadcast up to ``BROADCAST_SEEDS`` seeds, else by a
shuffled join of (hash, document, place) rows.  Hits become distinct (document, item,
diagonal) before anything else moves, and only documents with a hit get their tokens
a second time.

Defined results: tokens are runs of letters and digits, lower-cased; null and empty texts
or items have none; an item of fewer than ``LEAST`` tokens is never found; document rows and
items are told apart by id and text, so rows that repeat both are judged alike and null
ids are judged by their own text.  Texts are read
whole.  Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import fits, free_name, landed

# The masks.  Five tokens count in each.  Whatever the length of a stretch and whichever of its tokens
# differ, one of them fits if the stretch scores ``LEAST`` (a test goes through all patterns).
MASKS = (
    "1101011", "11100101", "1011011", "10011011", "10011101", "1001111", "10101011", "1011101", "101111", "11100011",
    "1110011", "111011", "111101", "11111",
)
ENOUGH, LEAST = 10, 8
BROADCAST_SEEDS, BROADCAST_HITS = 500_000, 500_000


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def seeds(rows: DataFrame, tokens: str, place: str, seed: str) -> DataFrame:
    """A row per window and mask, with the window's place and hash; ``tokens`` is used up."""
    n, at = F.size(tokens), F.col(place)
    kept = [c for c in rows.columns if c != tokens]
    shortest = min(map(len, MASKS))
    # Each token is hashed once; windows hash these numbers.
    rows = rows.filter(n >= shortest).withColumn(tokens, F.transform(tokens, lambda t: F.xxhash64(t)))
    windows = rows.withColumn(place, F.explode(F.sequence(F.lit(0), n - shortest)))
    hashes = [
        F.when(
            at + len(mask) <= n,
            F.xxhash64(F.lit(i), *[F.get(F.col(tokens), at + o) for o, bit in enumerate(mask) if bit == "1"]),
        )
        for i, mask in enumerate(MASKS)
    ]
    return windows.select(*kept, place, F.explode(F.array(*hashes)).alias(seed)).filter(F.col(seed).isNotNull())


def _stretch(doc: Column, item: Column, diagonal: Column) -> Column:
    """The best stretch of an item laid over a document: score, start and end in document tokens."""
    skip = F.greatest(F.lit(0), -diagonal)
    first = F.greatest(F.lit(0), diagonal)
    n = F.least(F.size(item) - skip, F.size(doc) - first)
    agree = F.zip_with(F.slice(doc, first + 1, n), F.slice(item, skip + 1, n), lambda a, b: a == b)
    zero = F.lit(0)
    start = F.struct(
        zero.alias("at"), zero.alias("from_"), zero.alias("now"), zero.alias("best"), zero.alias("start"), zero.alias("end")
    )

    def step(s: Column, same: Column) -> Column:
        now = F.greatest(F.lit(0), s["now"] + F.when(same, 1).otherwise(-1))
        begin = F.when(now == 0, s["at"] + 1).otherwise(s["from_"])
        better = now > s["best"]
        return F.struct(
            (s["at"] + 1).alias("at"), begin.alias("from_"), now.alias("now"),
            F.when(better, now).otherwise(s["best"]).alias("best"),
            F.when(better, begin).otherwise(s["start"]).alias("start"),
            F.when(better, s["at"] + 1).otherwise(s["end"]).alias("end"),
        )

    return F.aggregate(
        agree, start, step,
        lambda s: F.struct(s["best"].alias("score"), (first + s["start"]).alias("start"), (first + s["end"]).alias("end")),
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Verified overlaps, the best of each document and item: doc_id, text_hash, item_id, score, start, end."""
    items = benchmark.select(
        F.col(item_id).alias("item_id"), F.xxhash64(F.col(item_text)).alias("item_hash"), tokens_of(F.col(item_text)).alias("item")
    )
    asked = seeds(items, "item", "_ip", "_seed").distinct()
    if fits(asked, BROADCAST_SEEDS):
        asked = F.broadcast(asked)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = narrow.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens_of(F.col("text")).alias("_doc"))
    hits = landed(
        seeds(keyed, "_doc", "_p", "_seed")
        .join(asked, "_seed")
        .select("doc_id", "text_hash", "item_id", "item_hash", (F.col("_p") - F.col("_ip")).alias("diagonal"))
        .distinct()
    )
    found = F.broadcast(hits) if fits(hits, BROADCAST_HITS) else hits
    same = (F.col("doc_id").eqNullSafe(F.col("_d"))) & (F.xxhash64("text") == F.col("text_hash"))
    laid = narrow.join(found.withColumnRenamed("doc_id", "_d"), same)
    enough = F.greatest(F.lit(LEAST), F.least(F.lit(ENOUGH), F.ceil(F.size("item") / 2).cast("int")))
    items = items.withColumnsRenamed({"item_id": "_i", "item_hash": "_ih"})
    own = F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("item_hash") == F.col("_ih"))
    return (
        laid.select("doc_id", "text_hash", "item_id", "item_hash", "diagonal", tokens_of(F.col("text")).alias("_doc"))
        .join(F.broadcast(items) if fits(items, BROADCAST_SEEDS) else items, own)
        .withColumn("best", _stretch(F.col("_doc"), F.col("item"), F.col("diagonal")))
        .filter(F.col("best.score") >= enough)
        .groupBy("doc_id", "text_hash", "item_id", "item_hash")
        .agg(F.max_by("best", F.struct("best.score", -F.col("best.start"))).alias("best"))
        .select("doc_id", "text_hash", "item_id", "best.score", "best.start", "best.end")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """The documents that hold no benchmark passage; the columns of ``docs``."""
    h, d = free_name(docs.columns, "_hash"), free_name(docs.columns, "_leaked")
    gone = leaks(docs, benchmark, doc_id, text, **columns).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    gone = landed(gone)
    if fits(gone, BROADCAST_HITS):
        gone = F.broadcast(gone)
    same = F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text)) == F.col(h))
    return docs.join(gone, same, "left_anti")
