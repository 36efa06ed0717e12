"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Language identification drops texts that it rejects, the n-gram Jaccard join keeps one
document of each group of near copies, benchmark decontamination drops documents that hold
benchmark passages, secrets are replaced by a mark, and the mix repeats or leaves out documents so that
each source comes near its target.  One row of each group of near copies stays, that with the smallest id; of
rows that repeat the id, also those equal in every column, one.  Rows are known by their texts: an id on two
texts is two documents.  Rows without id are compared like all others and rank last: one of
them stays only in a group where no row has an id.  Texts without words are copies of nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.llm.common import among, bounded_batches, delete_unread, free_name, landed, landing_scope
from sparkaudit.llm.decontaminate import without_leaks
from sparkaudit.llm.jaccard import similar_components
from sparkaudit.llm.language import identified, trained
from sparkaudit.llm.mixing import mixed_documents
from sparkaudit.llm.secrets import redacted

#: What the near-copy stage takes for a near copy: words in a shingle and per cent of shingles shared.
COPY_WORDS, COPY_PERCENT = 5, 80

#: No SQL can express a trained classifier or a seeded mix: the stages are tested against brute force.
ORACLE_SQL = None


FIRST = "language_id"

#: Folders that the stage before this one landed for itself.
_before: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def frees_the_last(stage: Stage) -> Stage:
    """A stage that first deletes what the stage before landed for itself: that one's result has been written.

    Nothing is deleted for a stage whose ``docs`` still read it, nor for the first of a chain.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage.__name__ != FIRST:
            delete_unread(spark, _before, docs)
        with landing_scope() as folders:
            out = stage(spark, docs, sf_dir)
        _before[:] = folders
        return out

    return run_stage


@frees_the_last
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with enough confidence; null, empty and letterless texts go."""
    bounded_batches(spark)
    name = free_name(docs.columns, "_language")
    model = trained(docs.select("doc_id", "text", "lang"))
    return identified(docs, model, name=name).filter(~F.col(f"{name}.rejected")).drop(name)


@frees_the_last
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least by id (null last), then by hashes of its text and of the whole row."""
    bounded_batches(spark)
    # Texts are the nodes, by their hash, so that one id on two texts links nothing and rows without id have nodes.
    texts = docs.select(F.xxhash64("text").alias("node"), "text")
    found = similar_components(texts, "node", n=COPY_WORDS, percent=COPY_PERCENT).filter(F.col("n_shingles") > 0)
    groups = found.groupBy(F.col("doc_id").alias("_text")).agg(F.min("component_id").alias("_group"))
    row = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.xxhash64(*docs.columns).alias("_row")]
    placed = landed(docs.select(*row).join(groups, "_text"))
    keys = ["_id", "_text", "_row"]
    # Rows with an id come first; a group without any keeps one all the same.
    first = F.struct(F.col("_id").isNull().alias("_none"), *keys)
    least = placed.groupBy("_group").agg(F.min(first).alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    judged = placed.join(least, "_group").select(*keys, first.eqNullSafe(F.col("_least")).alias("_kept"))
    # Of rows that are equal in every column one stays.
    judged = landed(judged.groupBy(*keys, "_kept").agg(F.count(F.lit(1)).alias("_n")).filter("not _kept or _n > 1"))
    taken = docs.columns
    own = [free_name(taken, k) for k in keys]
    judged = judged.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], "_kept")
    ids = (F.col("doc_id"), F.xxhash64("text"), F.xxhash64(*taken))
    same = ids[0].eqNullSafe(F.col(own[0])) & (ids[1] == F.col(own[1])) & (ids[2] == F.col(own[2]))
    # Rows that nothing was judged about are told by a hash and stay where they are; the joins move the others alone.
    hashes = landed(judged.select(F.xxhash64(*own).alias("key")).distinct())
    met = among(docs, F.xxhash64(*ids), hashes)
    clear = [] if met is None else [among(docs, F.xxhash64(*ids), hashes, inside=False)]
    met = docs if met is None else met
    rest = met.join(judged.drop("_kept"), same, "left_anti")
    kept = met.join(judged.filter("_kept").drop("_kept"), same, "left_semi").distinct()
    return functools.reduce(DataFrame.unionByName, [*clear, rest, kept])


@frees_the_last
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark passage."""
    bounded_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


@frees_the_last
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows the text."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@frees_the_last
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
