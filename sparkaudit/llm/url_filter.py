"""URL filters by host-suffix and path-prefix expressions.

Each address (host, path) is expanded into one expression per shape (number of
host labels, length of path prefix) that any rule has.  Expressions meet the
rules by an equi-join on the first 32 bits of their SHA-256; the full digests
then confirm, and the longest rule wins.

Only DataFrame functions are used.  Addresses are made distinct before they are
expanded, so a host, an address or the null url may hold any share of the rows;
the verdicts return to the rows by a join whose large partitions adaptive
execution can split.  Rules are broadcast up to ``BROADCAST_RULES`` of them and
shuffled beyond that.

Defined results: a null url, or one without ``://``, has an empty host and path
and gets the default verdict; empty rule tables give the default everywhere;
rules with a null part or an empty host never fit; of two rules with one host and
path, block wins; of two fitting rules of one length, the longer host wins.
Repeated rows are judged each.  Other columns are kept; where one is named like
an output column, the output replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import fits, free_name, lower_ascii

BROADCAST_RULES = 200_000
PREFIX_HEX = 8
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
OUTPUTS = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_index(rules: DataFrame) -> DataFrame:
    """One row per rule (host, path): its text, shape, digest and verdict."""
    host, path = F.col("host"), F.col("path")
    return (
        rules.select(lower_ascii(host).alias("host"), "path", "verdict")
        .filter(F.col("host").isNotNull() & (host != "") & path.isNotNull() & F.col("verdict").isNotNull())
        .groupBy("host", "path")
        .agg(F.max(F.col("verdict") == "block").alias("_blocks"))
        .select(
            F.concat(host, path).alias("rule"),
            F.when(F.col("_blocks"), "block").otherwise("allow").alias("verdict"),
            F.struct(_labels(host).alias("labels"), F.length(path).alias("chars")).alias("_shape"),
            _digest(host, path).alias("_full"),
        )
        .withColumn("_short", F.substring("_full", 1, PREFIX_HEX))
    )


def expanded(addresses: DataFrame, index: DataFrame) -> DataFrame:
    """A row per address and expression, for the shapes that rules have."""
    # Shapes are bounded by the syntax of urls, not by the number of rules or rows.
    shapes = index.agg(F.collect_set("_shape")).scalar()
    host, path = F.col("host"), F.col("path")
    possible = F.filter(
        F.col("_shapes"), lambda s: (s["labels"] <= _labels(host)) & (s["chars"] <= F.length(path))
    )
    suffix = F.expr("substring_index(host, '.', -_shape.labels)")
    prefix = F.expr("substring(path, 1, _shape.chars)")
    return (
        addresses.withColumn("_shapes", shapes)
        .select("host", "path", F.explode(possible).alias("_shape"))
        .withColumn("_full", _digest(suffix, prefix))
        .select("host", "path", "_full", F.substring("_full", 1, PREFIX_HEX).alias("_short"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, the longest fitting rule (else null) and the verdict."""
    index = rule_index(rules)
    table = index.select("rule", "verdict", F.col("_full").alias("_rule_full"), "_short")
    if fits(index, BROADCAST_RULES):
        table = F.broadcast(table)
    host, path, whole, chosen = (free_name(pages.columns, c) for c in ("_host", "_path", "_address", "_best"))
    placed = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    addresses = placed.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct()
    best = (
        expanded(addresses, index)
        .join(table, "_short")
        .filter(F.col("_full") == F.col("_rule_full"))
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct("rule", "verdict"),
                F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)), "rule"),
            ).alias(chosen)
        )
        # Joined by the whole address rather than by its two parts: both sides are dealt anew for the
        # join, and such a join's large partitions can be split.
        .select(F.concat("host", "path").alias(whole), chosen)
    )
    kept = [c for c in pages.columns if c.lower() not in OUTPUTS]
    return (
        placed.withColumn(whole, F.concat(host, path))
        .join(best, whole, "left")
        .select(
            *kept,
            F.col(host).alias("host"),
            F.col(path).alias("path"),
            F.col(chosen)["rule"].alias("rule"),
            F.coalesce(F.col(chosen)["verdict"], F.lit(default)).alias("verdict"),
        )
    )
