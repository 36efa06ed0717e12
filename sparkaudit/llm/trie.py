"""The trie of all conversation prefixes, by Spark SQL ROLLUP over positional turn columns.

The turns of a conversation stand side by side in blocks of ``WIDTH`` columns, each
holding the turn's id: 12 bytes of a SHA-256 over role and text, then the text's length
in bytes.  ``GROUP BY block, ROLLUP(t1, ..., tWIDTH)`` with ``grouping_id()`` gives every prefix
that ends inside a block in one pass.  A long conversation goes on in further blocks;
the rows of a block are kept apart by the node at which the block before it ended, so all
blocks of all lengths are rolled up together, without a loop over depths.

A node is known by its ``path``: the sum of a 96-bit hash of (place, turn id) over its
turns.  Sums need no order of work, so the path of a block's first column is a running
total over the blocks before it, cut by ranges where one conversation has very many.

Totals over subtrees are a second ROLLUP over the nodes themselves.  What lies in deeper
blocks reaches a block's last column beforehand by doubling: each round joins every block to
the one twice as far above it, so a conversation of n turns takes log2(n / WIDTH) rounds.

Digests of the conversations that end at a node: ids of one node are first joined in pieces of
at most ``PIECE`` (by the id's high bits), then hashed piece by piece in a sorted
stream; memory does not grow with the node, though one digest is a sequence by definition.

Defined results: turns go by turn number, null first, equal numbers by the turn's id;
repeated rows are turns of their own; a null role or text is empty; rows whose
conversation is null belong to none; a conversation without turns is a member of the
root; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import landed
from sparkaudit.operators.ordering import ranked, running_total

WIDTH = 8
#: Ids of one piece share all but so many low bits.
PIECE_BITS = 12
PATH = "decimal(38,0)"


def turn_id(role: Column, text: Column) -> Column:
    """12 bytes that tell (role, text) from any other, and 4 with the text's length in bytes."""
    size = F.octet_length(text)
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.substring(F.sha2(whole, 256), 1, 24)), F.unhex(F.lpad(F.hex(size), 8, "0")))


def bytes_of(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 13, 4)), 16, 10).cast("long")


def hash_of(place: Column, turn: Column) -> Column:
    """96 bits of (place, turn) as a number: what a turn adds to the path of its node."""
    digest = F.sha2(F.concat(F.encode(place.cast("string"), "UTF-8"), turn), 256)
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(15,0)")
    return (part(1) * F.lit(1 << 48).cast("decimal(15,0)") + part(13)).cast(PATH)


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, turn id): the turns of each conversation, places from 0."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = landed(
        turns.filter(F.col(conv).isNotNull()).select(
            F.col(conv).cast("long").alias("conv"), F.col(turn).alias("number"), turn_id(empty(role), empty(text)).alias("turn")
        )
    )
    placed = ranked(known, ["number", "turn"], ["conv"], "place")
    return landed(placed.select("conv", (F.col("place") - 1).cast("long").alias("place"), "turn"))


def grafted(placed: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's turns: (conv, place, turn), and (conv, total) with those left turnless.

    Conversation c takes the first h turns of c - c % ``every`` and then its own after its
    first h; h = crc32(c) % ``most``.
    """
    sizes = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv").cast("string")) % most
    own = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % every).alias("head"), h.alias("h"))
    heads = sizes.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    taken = F.least("h", F.coalesce("head_n", F.lit(0)))
    plan = landed(
        own.join(heads, "head", "left").select(
            "conv", "head", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total")
        )
    )
    rest = placed.join(plan, "conv").filter("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn")
    first = placed.filter(F.col("place") < most - 1).withColumnRenamed("conv", "head")
    begun = first.join(plan, "head").filter("place < taken").select("conv", "place", "turn")
    return begun.unionByName(rest), plan.select("conv", "total")


def blocks_of(placed: DataFrame, totals: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block: conv, total, block, path (of the node before it), inside (of its own turns), t1, ..."""
    marks = totals.select("conv", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn"))
    at = F.col("place") % width
    rows = placed.withColumn("hash", hash_of(F.col("place"), F.col("turn"))).unionByName(marks.withColumn("hash", F.lit(0).cast(PATH)))
    columns = [F.max(F.when(at == i, F.col("turn"))).alias(f"t{i + 1}") for i in range(width)]
    wide = landed(
        rows.groupBy("conv", F.floor(F.col("place") / width).alias("block"))
        .agg(F.sum("hash").cast(PATH).alias("inside"), *columns)
        .join(totals, "conv")
    )
    before = running_total(wide, "inside", ["block"], ["conv"], "path")
    return landed(before.withColumn("path", F.col("path").cast(PATH)))


def rolled(rows: DataFrame, width: int, values: str) -> DataFrame:
    """Rows grouped by every prefix of a block's columns: block, path, t1, ..., depth inside the block (``level``), values."""
    columns = ", ".join(f"t{i + 1}" for i in range(width))
    level = f"{width} - bit_count(grouping_id())"
    sql = f"SELECT block, path, {columns}, {level} AS level, {values} FROM {{rows}} GROUP BY block, path, ROLLUP({columns})"
    out = rows.sparkSession.sql(sql, rows=rows)
    turn = F.get(F.array(*[F.col(f"t{i + 1}") for i in range(width)]), F.col("level") - 1)
    # Shorter conversations have no turn at the deeper columns; a block's empty prefix is the node before it.
    return out.withColumn("turn", turn).filter(F.col("turn").isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0)))


def with_below(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes at the last column get what the blocks below them hold: added leaves and saved, and their children (``below``)."""
    last = nodes.filter(F.col("level") == width)
    deep = nodes.filter("block > 0")
    deepest = nodes.agg(F.max("block")).first()[0] or 0
    if deepest:
        ends = last.select(F.col("node").alias("path"), F.col("path").alias("up"))
        sums = deep.groupBy("path").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count_if(F.col("level") == 1).alias("below")
        )
        found = landed(sums.join(ends, "path"))
        reach = 1
        # A block's sums cover all blocks nearer than ``reach`` below it; ``up`` is the block that far above.
        while reach < deepest:
            added = found.groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            above = found.select(F.col("path").alias("up"), F.col("up").alias("farther"))
            found = landed(
                found.join(added, "path", "left").join(above, "up", "left").select(
                    "path", F.col("farther").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                    (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), "below",
                )
            )
            reach *= 2
        found = found.select(F.col("path").alias("node"), F.col("leaves").alias("l"), F.col("saved").alias("s"), F.col("below").alias("b"))
        zero = F.lit(0).cast("long")
        last = last.join(found, "node", "left").select(
            *[c for c in nodes.columns if c not in ("leaves", "saved", "below")],
            (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved"),
            F.coalesce("b", zero).alias("below"),
        )
    return nodes.filter(F.col("level") < width).unionByName(last)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, n_ends, ends_sha256) of the conversations (node, conv) that end at each node, ids ascending."""
    pieces = ends.groupBy("node", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids")
    )
    dealt = pieces.withColumn("node", F.col("node").cast("string")).repartition("node").sortWithinPartitions("node", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, n = None, None, 0
        for batch in batches:
            done = []
            for name, ids, count in zip(*(batch.column(c).to_pylist() for c in ("node", "ids", "n"))):
                if name != node:
                    if node is not None:
                        done.append((node, n, digest.hexdigest()))
                    node, digest, n = name, hashlib.sha256(ids.encode()), count
                else:
                    digest.update(b"," + ids.encode())
                    n += count
            yield to_batch(done)
        yield to_batch([] if node is None else [(node, n, digest.hexdigest())])

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        names, counts, digests = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["node", "n_ends", "ends_sha256"]
        )

    hashed = dealt.select("node", "ids", "n").mapInArrow(run, "node string, n_ends long, ends_sha256 string")
    return hashed.withColumn("node", F.col("node").cast(PATH))


def prefix_trie(placed: DataFrame, totals: DataFrame, width: int = WIDTH) -> DataFrame:
    """All nodes of the trie over turns (conv, place, turn) and conversations (conv, total turns).

    One row per node: node and parent (paths; the root's parent is null), depth, conv_id
    (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (bytes that shared turns save below the node, itself included), n_ends and ends_sha256.
    """
    wide = blocks_of(placed, totals, width)
    counted = rolled(wide, width, "count(*) AS n_convs, min(conv) AS conv_id, max(total) AS deepest")
    depth = F.col("block") * width + F.col("level")
    last = F.when(F.col("turn").isNull(), F.lit(0)).otherwise(bytes_of(F.col("turn")))
    hashes = [F.coalesce(hash_of(F.col("block") * width + i, F.col(f"t{i + 1}")), F.lit(0).cast(PATH)) for i in range(width)]
    node = F.col("path")
    for h in hashes:
        node = (node + h).cast(PATH)
    nodes = landed(
        counted.select(
            "block", "path", *[f"t{i + 1}" for i in range(width)], "level", node.alias("node"), "conv_id", "n_convs",
            (F.col("deepest") == depth).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * last).alias("saved"),
            F.lit(0).cast("long").alias("below"),
        )
    )
    levels = ", ".join(f"count_if(level = {i + 1}) AS c{i + 1}" for i in range(width))
    sums = rolled(
        with_below(nodes, width), width,
        "min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens, "
        f"max(CASE WHEN level = {width} THEN below ELSE 0 END) AS below, {levels}",
    )
    children = F.when(F.col("level") == width, F.col("below")).otherwise(F.get(F.array(*[F.col(f"c{i + 1}") for i in range(width)]), F.col("level")))
    parent = F.when(depth > 0, (node - F.coalesce(hash_of(depth - 1, F.col("turn")), F.lit(0).cast(PATH))).cast(PATH))
    full = landed(
        sums.select(
            node.alias("node"), parent.alias("parent"), depth.cast("long").alias("depth"), "conv_id", "n_convs",
            children.cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        )
    )
    # The block in which a conversation ends is the one that its last turn stands in.
    at = F.greatest(F.lit(0), F.floor((F.col("total") - 1) / width))
    ends = end_digests(wide.filter(F.col("block") == at).select((F.col("path") + F.col("inside")).cast(PATH).alias("node"), "conv"))
    above = full.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        full.join(ends, "node", "left").join(above, "parent", "left")
        .withColumn("n_ends", F.coalesce("n_ends", F.lit(0).cast("long")))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
        .select(
            "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends",
            "ends_sha256",
        )
    )
