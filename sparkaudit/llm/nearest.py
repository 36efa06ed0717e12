"""Exact nearest neighbours by a block matrix join.

Vectors are quantised to int8 with one scale each.  Candidates and queries are dealt
into blocks of bounded size, every (query block, candidate block) pair is one tile,
and a tile is one task's work: the int8 product gives each distance with an error
bound from the norms of what quantisation lost; pairs whose lower bound lies above
the k-th smallest upper bound are dropped, the rest is computed anew in double
precision from the original vectors, and heaps keep the k best of each query.  The
tiles' lists, at most k per query and tile, then meet in one grouped merge.

Blocks reach their tiles by an equi-join on the tile: a vector is repeated once per
block of the other side, which for a stated query set is the least a block product
can move.  The number of blocks follows the row counts; a tile never holds more than
about ``CANDIDATE_BLOCK`` + ``QUERY_BLOCK`` vectors, whatever the data.

Identical candidate vectors of a tile are thinned to the k + 1 of smallest id before
the product; no more of them can be in any list of k (one may be the query's own), so
the results stay exact when one vector fills a third of the table.

Defined results: vectors that are null, all zero, or hold null or non-finite parts
take no part as query or candidate, nor do rows without an id; vectors of another
length than the query's are no candidates of it; ties go to the smaller id; the
query's own row is no candidate, nor is any other row of its id; repeated rows (one
id, one vector) count once, rows of one id with different vectors are candidates each,
and a query id that stands on several rows is answered for the first of its vectors in
array order.  Empty tables give no rows.  Other columns are not used.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 16_384
#: Rows of the product that are held at once inside a tile.
STRIP = 128

FOUND = "query_id long, vec_id long, score double"


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector), without rows that take no part; every row once."""
    v = F.col("_v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("_v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull())
        .filter(~bad & F.exists(v, lambda x: x != 0))
        .select("vec_id", v.alias("vector"))
        .distinct()
    )


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 parts, scale, norm of the rounded vector, and norm of what rounding lost, of each row."""
    scale = np.abs(m).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # the smallest subnormals divided by 127
    parts = np.rint(m / scale[:, None])
    rounded = parts * scale[:, None]
    return parts.astype(np.int8), scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(m - rounded, axis=1)


def thinned(ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 smallest ids of each distinct vector."""
    order = np.lexsort((ids, *m.T[::-1]))
    same = np.concatenate(([False], (m[order][1:] == m[order][:-1]).all(axis=1)))
    starts = np.flatnonzero(~same)
    within = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[within <= k])


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """The k nearest candidates of each query of one tile: (query id, candidate id, distance)."""
    keep = thinned(c_ids, c, k)
    c_ids, c = c_ids[keep], c[keep]
    unit = max(np.abs(c).max(), np.abs(q).max())  # so that no square overflows
    in_units = c / unit
    c8, c_scale, c_norm, c_lost = quantised(in_units)
    c_sq = np.einsum("ij,ij->i", in_units, in_units)
    # Sums of int8 products up to this many parts are exact in single precision.
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    c8 = c8.astype(exact)
    for at in range(0, len(q), STRIP):
        ids, strip = q_ids[at : at + STRIP], q[at : at + STRIP]
        q8, q_scale, q_norm, q_lost = quantised(strip / unit)
        q_sq = np.square(strip / unit).sum(axis=1)
        product = (q8.astype(exact) @ c8.T).astype(np.float64) * q_scale[:, None] * c_scale
        slack = q_lost[:, None] * (c_norm + c_lost) + q_norm[:, None] * c_lost
        total = q_sq[:, None] + c_sq
        middle = total - 2.0 * product
        # Rounding of the sums above stays far below this share of the squared norms.
        slack = 2.0 * slack + 1e-12 * total
        low, high = middle - slack, middle + slack
        own = ids[:, None] == c_ids
        low[own] = high[own] = np.inf
        last = min(k, high.shape[1]) - 1
        bound = np.partition(high, last, axis=1)[:, last]
        for row in range(len(ids)):
            near = np.flatnonzero((low[row] <= bound[row]) & ~own[row])
            # Summed from the first part to the last, as a plain loop would.
            exact_distance = np.sqrt(np.cumsum(np.square(c[near] - strip[row]), axis=1)[:, -1])
            best = heapq.nsmallest(k, zip(exact_distance.tolist(), c_ids[near].tolist()))
            for distance, candidate in best:
                yield int(ids[row]), candidate, distance


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest rows of every query: query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    candidates = usable(rows, vec_id, vector)
    asked = (
        usable(queries, vec_id, vector)
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )
    n_candidates, n_asked = rows.count(), queries.count()
    across = max(1, -(-n_candidates // candidate_block))
    down = max(1, -(-n_asked // query_block))

    def block(count: int):
        return F.pmod(F.xxhash64("vec_id", "vector"), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    row = ["vec_id", "vector", F.size("vector").alias("dims")]
    left = candidates.select(*row, block(across).alias("across"), every(down).alias("down"))
    right = asked.select(*row, block(down).alias("down"), every(across).alias("across"))

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q_all, c_all = (np.stack(x["vector"]).astype(np.float64) for x in (q, c))
        found = tile(q["vec_id"].to_numpy(), q_all, c["vec_id"].to_numpy(), c_all, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    tile_key = ["across", "down", "dims"]
    found = left.groupBy(*tile_key).cogroup(right.groupBy(*tile_key)).applyInPandas(run, FOUND)

    # Each map task keeps its k best of a query before the shuffle (a group limit), and one task k after it.
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
