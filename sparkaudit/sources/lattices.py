"""Sources of the lattice analysis: token matrices, token pools, word lists, run manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.functions.text import BLANKS
from sparkaudit.operators.ordering import ranked
from sparkaudit.sources.lines import numbered_lines, offsets_in_file

TOKEN_LENGTH = 5
COLUMNS = 16
MANIFEST = (
    "timestamp bigint, seed bigint, matrix_fp string, entropy double, depth double, "
    "actions array<struct<file:string,transform:string,message:string>>"
)


def tokens_of(text: Column, length: int | None = TOKEN_LENGTH) -> Column:
    """Blank-separated tokens, only those of the given length."""
    return F.filter(F.split(text, BLANKS), lambda t: F.length(t) == length if length else t != "")


def lattice_cells(tokens: DataFrame, by: str, idx: str, cols: int = COLUMNS) -> DataFrame:
    """Token positions to (by, r, c, token); tokens after the last whole row are dropped.

    A lattice of fewer tokens than one row still has its one short row.
    """
    sizes = tokens.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.greatest(F.lit(1), F.floor(F.col("_n") / cols))
    return tokens.join(sizes, by).filter(F.col(idx) < rows * cols).select(
        by, F.floor(F.col(idx) / cols).cast("int").alias("r"), (F.col(idx) % cols).cast("int").alias("c"), "token"
    )


def text_lattices(
    df: DataFrame, by: str, text: str, length: int | None = TOKEN_LENGTH, cols: int = COLUMNS
) -> DataFrame:
    """One lattice per text row, as :func:`lattice_cells` but cut inside the row: no shuffle."""
    held = df.select(F.col(by), F.inline(F.array(F.struct(tokens_of(F.col(text), length).alias("_t")))))
    rows = F.greatest(F.lit(1), F.floor(F.size("_t") / cols))
    kept = F.slice("_t", F.lit(1), (rows * cols).cast("int"))
    return held.select(by, F.posexplode(kept).alias("idx", "token")).select(
        by, F.floor(F.col("idx") / cols).cast("int").alias("r"), (F.col("idx") % cols).cast("int").alias("c"), "token"
    )


def text_lattice_runs(
    df: DataFrame, by: str, text: str, length: int | None = TOKEN_LENGTH, cols: int = COLUMNS, along: str = "r"
) -> DataFrame:
    """The cells of :func:`text_lattices` in runs, a row (``along`` "r") or a column ("c") of a text each: (by, along, tokens)."""
    held = df.select(F.col(by), F.inline(F.array(F.struct(tokens_of(F.col(text), length).alias("_t")))))
    rows = F.greatest(F.lit(1), F.floor(F.size("_t") / cols)).cast("int")
    kept = F.slice("_t", F.lit(1), rows * cols)
    sized = held.select(by, F.inline(F.array(F.struct(kept.alias("_k"), rows.alias("_rows"))))).filter(F.size("_k") > 0)
    if along == "r":
        runs = F.transform(F.sequence(F.lit(0), F.col("_rows") - 1), lambda i: F.slice("_k", i * cols + 1, cols))
    else:
        last = F.least(F.lit(cols), F.size("_k")) - 1
        # A text of fewer tokens than one row has one token a column.
        places = lambda i: F.sequence(i, i + (F.col("_rows") - 1) * cols, F.lit(cols))
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(places(i), lambda at: F.get("_k", at)))
    return sized.select(by, F.posexplode(runs).alias(along, "tokens"))


def _file_tokens(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path).withColumn("_tokens", tokens_of(F.col("value")))
    placed = offsets_in_file(lines, {"offset": F.size("_tokens")})
    return placed.select("file", "offset", F.posexplode("_tokens").alias("_pos", "token")).select(
        F.col("file").alias("lattice_id"), (F.col("offset") + F.col("_pos")).alias("idx"), "token"
    )


def read_lattices(spark: SparkSession, path: str, cols: int = COLUMNS) -> DataFrame:
    """Matrix files to (lattice_id, r, c, token)."""
    return lattice_cells(_file_tokens(spark, path), "lattice_id", "idx", cols)


def read_token_pool(spark: SparkSession, path: str) -> DataFrame:
    """All tokens of all files, repeats kept, with a dense index from 0."""
    return token_pool(_file_tokens(spark, path), ["lattice_id", "idx"])


def token_pool(tokens: DataFrame, order: list[str]) -> DataFrame:
    numbered = ranked(tokens, order, name="_rank")
    return numbered.select((F.col("_rank") - 1).alias("pool_index"), "token")


def synthetic_token(index: Column) -> Column:
    """The five-letter string at a place in lexicographic order."""
    digits = [F.floor(index / 26**k) % 26 for k in reversed(range(TOKEN_LENGTH))]
    return F.concat(*[F.chr(d + ord("a")) for d in digits])


def synthetic_pool(spark: SparkSession, size: int = 2048) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("pool_index"), synthetic_token(F.col("id")).alias("token"))


def words_of(lines: DataFrame, value: str = "value") -> DataFrame:
    word = F.lower(F.regexp_replace(F.col(value), f"^{BLANKS}|{BLANKS}$", ""))
    return lines.select(word.alias("word")).filter(F.col("word").rlike(r"^\p{L}{5}$"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return words_of(spark.read.text(path))


def explode_actions(manifests: DataFrame) -> DataFrame:
    """One row per action; a run without actions keeps one row."""
    return manifests.select(
        *[c for c in manifests.columns if c != "actions"], F.posexplode_outer("actions").alias("action_no", "_a")
    ).select("*", "_a.file", "_a.transform", "_a.message").drop("_a")


def read_run_manifests(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Manifests of one document a file, over any number of lines; or of one a line, as ``write_manifests`` writes them."""
    return spark.read.schema(MANIFEST).option("multiLine", one_per_file).json(path)
