"""Lattice, entropy and sampling queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.operators import lattice as L
from sparkaudit.operators import sampling as P
from sparkaudit.operators.ordering import spread
from sparkaudit.plans.lattice import WEIGHTS, analyse, with_seed
from sparkaudit.queries import table
from sparkaudit.sources.lattices import lattice_cells, text_lattice_runs, text_lattices, token_pool, tokens_of, words_of


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def doc_tokens(spark: SparkSession, d: str, length: int | None = None) -> DataFrame:
    """Every token of every document with its place."""
    return documents(spark, d).select(
        F.col("doc_id").alias("lattice_id"), F.posexplode(tokens_of(F.col("text"), length)).alias("idx", "token")
    )


def doc_cells(spark: SparkSession, d: str, length: int | None = None) -> DataFrame:
    docs = documents(spark, d).withColumnRenamed("doc_id", "lattice_id")
    return text_lattices(docs, "lattice_id", "text", length)


def doc_runs(spark: SparkSession, d: str, along: str) -> DataFrame:
    docs = documents(spark, d).withColumnRenamed("doc_id", "lattice_id")
    return text_lattice_runs(docs, "lattice_id", "text", None, along=along)


def _tokens_sql(where: str) -> str:
    return f"""SELECT lattice_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS idx FROM (
      SELECT doc_id AS lattice_id,
             list_filter(string_split_regex(text, '[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'),
                         lambda t: {where}) AS toks FROM documents)"""


CELLS_SQL = """
  tok AS ({tokens}),
  cell AS (SELECT lattice_id, idx // 16 AS r, idx % 16 AS c, token
           FROM (SELECT *, count(*) OVER (PARTITION BY lattice_id) AS n FROM tok)
           WHERE idx < greatest(1, n // 16) * 16)
"""
ALL_CELLS = "WITH " + CELLS_SQL.format(tokens=_tokens_sql("t <> ''"))
FIVE_CELLS = "WITH " + CELLS_SQL.format(tokens=_tokens_sql("length(t) = 5"))


def _entropy_sql(keys: str, source: str = "cell") -> str:
    return f"""SELECT {keys}, sum(k)::BIGINT AS n, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS entropy
      FROM (SELECT {keys}, token, count(*) AS k FROM {source} GROUP BY ALL) GROUP BY {keys}"""


def _rounded(df: DataFrame, name: str = "entropy") -> DataFrame:
    """Six digits; adding zero turns a negative zero round."""
    return df.withColumn(name, F.round(name, 6) + F.lit(0.0))


def lattices(spark, d):
    """Cut from the long token table, as the tokens of many files are."""
    return lattice_cells(doc_tokens(spark, d, 5), "lattice_id", "idx")


def frequencies(spark, d):
    return L.token_frequencies(doc_tokens(spark, d))


def entropy_row(spark, d):
    return _rounded(L.row_entropy(doc_cells(spark, d)))


def entropy_column(spark, d):
    return _rounded(L.column_entropy(doc_runs(spark, d, "c")))


def entropy_all(spark, d):
    return _rounded(L.shannon_entropy(doc_tokens(spark, d), ["lattice_id"]))


def entropy_whole(spark, d):
    return _rounded(L.shannon_entropy(doc_tokens(spark, d)))


def bands(spark, d):
    return _rounded(L.spectral_bands(L.row_entropy(doc_cells(spark, d))), "mean_entropy")


def dominant(spark, d):
    rounded = _rounded(L.spectral_bands(L.row_entropy(doc_cells(spark, d))), "mean_entropy")
    return L.dominant_band(rounded)


def analysis(spark, d):
    return analyse(doc_cells(spark, d)).select("lattice_id", "n", F.round("entropy", 6).alias("entropy"), F.round("depth", 6).alias("depth"))


def delta(spark, d):
    """Every document against itself with each vowel-led token replaced."""
    rows = doc_runs(spark, d, "r")
    other = rows.withColumn("tokens", F.transform("tokens", lambda t: F.regexp_replace(t, "^[aeiou].*$", "xxxxx")))
    return L.lattice_delta(rows, other)


def diagonal(spark, d):
    return L.diagonal(doc_cells(spark, d), 16, 3)


def set_cells(spark, d):
    cells = doc_cells(spark, d, 5)
    updates = L.diagonal(cells, 16).withColumn("token", F.reverse("token"))
    return L.validated_set(cells, updates)


def fingerprints(spark, d):
    return with_seed(L.fingerprint(doc_cells(spark, d, 5)), "mutator")


def tree_fingerprints(spark, d):
    return L.tree_fingerprint(doc_cells(spark, d, 5), levels=3, fan_in=32)


TREE_SQL = f"""{FIVE_CELLS},
  n0 AS (SELECT lattice_id, r AS i, sha256(string_agg(token, ' ' ORDER BY c)) AS h FROM cell GROUP BY ALL),
  n1 AS (SELECT lattice_id, i // 32 AS j, sha256(string_agg(h, '' ORDER BY i)) AS h FROM n0 GROUP BY ALL),
  n2 AS (SELECT lattice_id, j // 32 AS k, sha256(string_agg(h, '' ORDER BY j)) AS h FROM n1 GROUP BY ALL)
  SELECT lattice_id, sha256(string_agg(h, '' ORDER BY k)) AS fingerprint FROM n2 GROUP BY ALL"""


def row_texts(spark, d):
    """The lines that a lattice is written as."""
    return L.row_texts(doc_cells(spark, d, 5))


def pool(spark, d):
    return token_pool(doc_tokens(spark, d, 5), ["lattice_id", "idx"])


def words(spark, d):
    lines = documents(spark, d).select(F.explode(F.split("text", "[ \n]")).alias("value"))
    return words_of(lines).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _draw_sql(seed: int, *key: str) -> str:
    parts = ", ".join(f"({k})::VARCHAR" for k in key)
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15))::BIGINT"


def sample(spark, d):
    return P.sample_n(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 11, 500)


def weighted(spark, d):
    return P.weighted_assign(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], WEIGHTS, 5)


def generated(spark, d):
    """One synthetic 16-token row per order."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("lattice_id"))
    return P.generate_for(orders, 1, 16, seed=3).select(F.col("lattice_id").alias("o_orderkey"), "c", "token")


GENERATED_SQL = f"""
  SELECT o_orderkey, c::INT AS c, chr((97 + i // 456976 % 26)::INT) || chr((97 + i // 17576 % 26)::INT) || chr((97 + i // 676 % 26)::INT)
         || chr((97 + i // 26 % 26)::INT) || chr((97 + i % 26)::INT) AS token
  FROM (SELECT o_orderkey, c, {_draw_sql(3, 'o_orderkey', '0', 'c')} % 2048 AS i
        FROM orders, range(0, 16) t(c))
"""


def mutated(spark, d):
    cells = doc_cells(spark, d, 5)
    source = token_pool(doc_tokens(spark, d, 5), ["lattice_id", "idx"])
    return P.mutate_cells(cells, 3, 21, source)[1]


def mutated_cells(spark, d):
    """The lattices after the change, all cells."""
    source = token_pool(doc_tokens(spark, d, 5), ["lattice_id", "idx"])
    return P.mutate_cells(doc_cells(spark, d, 5), 3, 21, source)[0]


MUTATED_SQL = f"""{FIVE_CELLS},
  pool AS (SELECT row_number() OVER (ORDER BY lattice_id, idx) - 1 AS i, token FROM tok),
  placed AS (SELECT *, row_number() OVER (PARTITION BY lattice_id ORDER BY {_draw_sql(21, 'lattice_id', 'r', 'c')}, r, c) AS place
             FROM cell)
  SELECT lattice_id, r, c, p.token AS old, pool.token AS new
  FROM placed p JOIN pool ON pool.i = {_draw_sql(22, 'lattice_id', 'r', 'c')} % (SELECT count(*) FROM tok)
  WHERE place <= 3"""


def targets(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("path"))
    return P.distinct_targets([pages, pages.filter("path like 'https%'")], ["en", "de"])


QUERIES = {
    "q_lattices": (lattices, f"{FIVE_CELLS} SELECT lattice_id, r, c, token FROM cell"),
    "q_token_frequencies": (frequencies, f"""WITH tok AS ({_tokens_sql("t <> ''")})
      SELECT token, count(*) AS n FROM tok GROUP BY token"""),
    "q_entropy_row": (entropy_row, f"""{ALL_CELLS}, e AS ({_entropy_sql('lattice_id, r')})
      SELECT lattice_id, r, n, round(entropy, 6) + 0.0::DOUBLE AS entropy FROM e"""),
    "q_entropy_col": (entropy_column, f"""{ALL_CELLS}, e AS ({_entropy_sql('lattice_id, c')})
      SELECT lattice_id, c, n, round(entropy, 6) + 0.0::DOUBLE AS entropy FROM e"""),
    "q_entropy_all": (entropy_all, f"""WITH tok AS ({_tokens_sql("t <> ''")}), e AS ({_entropy_sql('lattice_id', 'tok')})
      SELECT lattice_id, n, round(entropy, 6) + 0.0::DOUBLE AS entropy FROM e"""),
    "q_entropy_whole": (entropy_whole, f"""WITH tok AS ({_tokens_sql("t <> ''")})
      SELECT sum(k)::BIGINT AS n, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS entropy
      FROM (SELECT token, count(*) AS k FROM tok GROUP BY token)"""),
    "q_bands": (bands, None),
    "q_dominant": (dominant, None),
    "q_lattice_analysis": (analysis, f"""{ALL_CELLS}, e AS ({_entropy_sql('lattice_id')})
      SELECT lattice_id, n, round(entropy, 6) AS entropy,
             round(1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, (entropy - 0.18::DOUBLE) / (0.97::DOUBLE - 0.18::DOUBLE))), 6) AS depth
      FROM e"""),
    "q_lattice_delta": (delta, f"""{ALL_CELLS}
      SELECT lattice_id, count(*) FILTER (WHERE regexp_matches(token, '^[aeiou]') AND token <> 'xxxxx') AS delta
      FROM cell GROUP BY lattice_id"""),
    "q_diagonal": (diagonal, f"{ALL_CELLS} SELECT * FROM cell WHERE c = (r + 3) % 16"),
    "q_set_cells": (set_cells, f"""{FIVE_CELLS}
      SELECT lattice_id, r, c, CASE WHEN c = r % 16 THEN reverse(token) ELSE token END AS token FROM cell"""),
    "q_fingerprint": (fingerprints, None),
    "q_tree_fingerprint": (tree_fingerprints, TREE_SQL),
    "q_row_texts": (row_texts, f"""{FIVE_CELLS}
      SELECT lattice_id, r, string_agg(token, ' ' ORDER BY c) AS text FROM cell GROUP BY ALL"""),
    "q_token_pool": (pool, f"""WITH tok AS ({_tokens_sql("length(t) = 5")})
      SELECT row_number() OVER (ORDER BY lattice_id, idx) - 1 AS pool_index, token FROM tok"""),
    "q_word_list": (words, """
      SELECT word, count(*) AS n FROM (
        SELECT lower(trim(w, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS word FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS w FROM documents))
      WHERE regexp_full_match(word, '\\p{L}{5}') GROUP BY word"""),
    "q_sample": (sample, f"""SELECT o_orderkey, o_custkey FROM orders
      ORDER BY {_draw_sql(11, 'o_orderkey')}, o_orderkey LIMIT 500"""),
    "q_weighted": (weighted, f"""
      SELECT o_orderkey, CASE WHEN u < 0.35 THEN 'annotate' WHEN u < 0.65 THEN 'patch' WHEN u < 0.85 THEN 'refactor'
                              ELSE 'rebalance' END AS label
      FROM (SELECT o_orderkey, {_draw_sql(5, 'o_orderkey')} / 1152921504606846976.0::DOUBLE AS u FROM orders)"""),
    "q_generated": (generated, GENERATED_SQL),
    "q_mutate": (mutated, MUTATED_SQL),
    "q_mutated_cells": (mutated_cells, f"""
      SELECT c.lattice_id, c.r, c.c, coalesce(m.new, c.token) AS token
      FROM ({FIVE_CELLS} SELECT * FROM cell) c LEFT JOIN ({MUTATED_SQL}) m USING (lattice_id, r, c)"""),
    "q_targets": (targets, """
      SELECT DISTINCT url AS path FROM pages WHERE string_split(url, '/')[-1] NOT IN ('en', 'de')"""),
}

_BANDS_SQL = f"""{ALL_CELLS}, e AS ({_entropy_sql('lattice_id, r')}),
  s AS (SELECT lattice_id, greatest(1, (max(r) + 1) // 8) AS size FROM e GROUP BY 1),
  m AS (SELECT lattice_id, r // size AS band, avg(entropy) AS mean FROM e JOIN s USING (lattice_id) GROUP BY ALL),
  b AS (SELECT s.lattice_id, t.band::INT AS band, round(coalesce(mean, 0), 6) + 0.0::DOUBLE AS mean_entropy
        FROM s CROSS JOIN range(0, 8) t(band) LEFT JOIN m ON m.lattice_id = s.lattice_id AND m.band = t.band)"""
QUERIES["q_bands"] = (bands, f"{_BANDS_SQL} SELECT * FROM b")
QUERIES["q_dominant"] = (dominant, f"""{_BANDS_SQL}
  SELECT lattice_id, arg_max(band, (mean_entropy, -band)) AS band FROM b GROUP BY lattice_id""")
