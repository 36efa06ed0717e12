"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same real number of copies: its source's target
over its source's size.  The whole part is taken at once.  The fractions are rounded
by pairs: a pair transfers word mass at random, without changing the pair's expected
or total mass, until one of the two is integral; the other meets the next document.
So a chunk of documents ends with at most one document still fractional.  Those
residuals go up a reduction tree, ``FAN`` chunks to one, until each source has a
single residual, which a last draw decides.  The words a source takes thus miss its
target by less than the one document decided last, however sizes are spread.

A source of any share of the rows is cut into chunks by a hash of the document, and a
chunk holds about ``FAN`` narrow rows.  Levels are written to the shared folder, so a
lost executor costs one level at most.  Draws are seeded by level, source and chunk,
and a chunk is sorted first: reruns agree.  Only sums over the table of sources reach
the driver; sources are ranked by range, not in one task.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating, and share
all words; a target stops at ``most`` times its source's size, and the excess is
shared again by weight among the others until none is above.

Defined results: null or empty texts have size 0 and take nothing; rows that repeat
doc_id, source and size are one item of their joint mass and get equal copies; a null
doc_id is a value like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import WORD, free_name, landed
from sparkaudit.operators.ordering import ranked

WEIGHTS = (1, 2, 3)
MOST = 3
FAN = 4096
SEED = 20240607
MIX = "_mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, items) with place (from 0) and target words; one row per source."""
    placed = ranked(
        sizes.withColumn("_none", F.col("source").isNull()), ["_none", "source"], name="_rank"
    ).drop("_none")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = landed(
        placed.select(
            "source", "source_size", "items", (F.col("_rank") - 1).alias("place"),
            F.get(cycle, ((F.col("_rank") - 1) % len(weights)).cast("int")).alias("weight"),
            (F.col("source_size") * F.lit(float(most))).alias("ceiling"),
        )
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # Raise the share of one unit of weight until the sources at their ceiling are the ones it passes.
    share, capped = -1.0, F.lit(False)
    while True:
        weight, rest = table.agg(
            F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, F.col("ceiling")))
        ).first()
        new = (total - (rest or 0.0)) / weight if weight else math.inf
        if new <= share or not weight:
            break
        share, capped = new, F.col("weight") * F.lit(new) > F.col("ceiling")
    target = F.when(capped, F.col("ceiling")).otherwise(F.col("weight") * F.lit(share if share > 0 else 0.0))
    return table.withColumn("target", target)


def rounded(mass: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Shares made 0 or 1 by pairwise transfers of mass; at most one place, the second result, stays between."""
    out, open_at, draws = share.tolist(), -1, rng.random(len(share)).tolist()
    masses = mass.tolist()
    for j, q in enumerate(out):
        if q <= 0.0 or q >= 1.0:
            continue
        if open_at < 0:
            open_at = j
            continue
        a, b, p = masses[open_at], masses[j], out[open_at]
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        if draws[j] * (up + down) < down:  # mass moves to the open one
            full, empty = up == a * (1 - p), up == b * q
            p, q = (1.0 if full else p + up / a), (0.0 if empty else q - up / b)
        else:
            empty, full = down == a * p, down == b * (1 - q)
            p, q = (0.0 if empty else p - down / a), (1.0 if full else q + down / b)
        out[open_at], out[j] = p, q
        if 0.0 < q < 1.0:
            open_at = j
        elif not 0.0 < p < 1.0:
            open_at = -1
    return np.array(out), open_at


def pivotal(items: DataFrame, levels: int, seed: int = SEED) -> list[DataFrame]:
    """Decided rows of each level.  items: place, chunk, mass (over 0), share in [0, 1) and any other columns."""
    schema = items.schema
    # Heaviest first: like meets like, and what stays open in the end is light.
    order = ["mass", *[c for c in items.columns if c not in ("place", "chunk", "share", "mass")]]
    rising = [False] + [True] * (len(order) - 1)

    def level(depth: int, last: bool):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            # Arrow's own types: a null beside long ids must not turn them into doubles.
            frame = rows.select(order).to_pandas(types_mapper=pd.ArrowDtype)
            rows = rows.take(pa.array(frame.sort_values(order, ascending=rising, na_position="first").index.to_numpy()))
            place, chunk = (k.as_py() for k in key)
            rng = np.random.default_rng([seed, depth, place, chunk])
            share, at = rounded(rows["mass"].to_numpy().astype(float), rows["share"].to_numpy().astype(float), rng)
            if last and at >= 0:
                share[at] = float(rng.random() < share[at])
            chunks = np.full(len(share), chunk // FAN, dtype=np.int64)
            new = {"share": pa.array(share), "chunk": pa.array(chunks)}
            return pa.table({c: new.get(c, rows[c]) for c in rows.column_names})

        return run

    done = []
    for depth in range(levels):
        out = landed(items.groupBy("place", "chunk").applyInArrow(level(depth, depth == levels - 1), schema))
        done.append(out.filter(F.col("share").isin(0.0, 1.0)))
        items = out.filter(~F.col("share").isin(0.0, 1.0))
    return done


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """One row per item: doc_id, source, size, rows (of this item), source_size, target, copies (of each row)."""
    items = landed(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    targets = landed(
        source_targets(
            items.groupBy("source").agg(
                F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("items")
            ),
            weights,
            most,
        )
    )
    most_items = targets.agg(F.max("items")).first()[0] or 1
    levels = 1
    while math.ceil(most_items / FAN ** levels) > 1:
        levels += 1
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias("_s"), "place", "source_size", "target", "items")
    full = (
        items.join(t, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", copies)
        .withColumn("whole", F.floor("copies").cast("long"))
        .select(
            "doc_id", "source", "size", "rows", "place", "source_size", "target", "whole",
            (F.col("size") * F.col("rows")).alias("mass"),
            (F.col("copies") - F.col("whole")).alias("share"),
            F.pmod(
                F.xxhash64("doc_id", "size", F.lit(seed)), F.ceil(F.col("items") / F.lit(FAN)).cast("long")
            ).alias("chunk"),
        )
    )
    none = full.filter((F.col("mass") == 0) | (F.col("share") == 0)).withColumn("share", F.lit(0.0))
    some = full.filter((F.col("mass") > 0) & (F.col("share") > 0))
    out = none
    for part in pivotal(some, levels, seed):
        out = out.unionByName(part)
    return out.select(
        "doc_id", "source", "size", "rows", "source_size", "target",
        (F.col("whole") + F.col("share").cast("long")).alias("copies"),
    )


def with_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", name: str = MIX, **how
) -> DataFrame:
    """The rows of ``docs`` with one more column: a struct of size, source_size, target and copies."""
    items = mixed(docs, doc_id, text, source, **how)
    d, s, n = (free_name(docs.columns, c) for c in ("_d", "_s", "_n"))
    facts = items.select(
        F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n),
        F.struct("size", "source_size", "target", "copies").alias(name),
    )
    same = F.col(doc_id).eqNullSafe(F.col(d)) & F.col(source).eqNullSafe(F.col(s))
    joined = docs.join(facts, same & (n_words(F.col(text)) == F.col(n)), "left").drop(d, s, n)
    # Every row has its item; one without would be a row lost, so it ends the job.
    return joined.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.lit("a row without its item of the mix"))))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it."""
    mix = free_name(docs.columns, MIX)
    return (
        with_copies(docs, name=mix, **how)
        .filter(F.col(mix)["copies"] > 0)
        .withColumn(mix, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mix)["copies"])))
        .drop(mix)
    )
