"""One query per training-data operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.llm.common import bounded_batches, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules that the url query judges by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_url_filter(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, d, "pages").select("page_id", "url"), rules).drop("url")


URL_SQL = r"""WITH u AS (
    SELECT page_id, coalesce(url, '') AS url FROM pages),
  a AS (
    SELECT page_id,
           translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
  r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
  m AS (
    SELECT a.page_id, a.host, a.path, r.rhost || r.rpath AS rule, r.v,
           row_number() OVER (PARTITION BY a.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
    FROM a LEFT JOIN r ON (a.host = r.rhost OR a.host LIKE '%.' || r.rhost) AND starts_with(a.path, r.rpath))
  SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1"""


def op2_language_model(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.language import in_part
    from sparkaudit.llm.language_model import scored, trained

    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = in_part(F.col("doc_id"), 7, 2)
    model = trained(docs.filter(~held_out))
    lm = F.col("lm")
    return scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), lm["n_tokens"].alias("n_tokens"), lm["n_known"].alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), lm["base_score"].alias("base_score"), lm["score"].alias("score"),
    )


def op3_warc(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.archive import converted, read_warc

    folder = shared_folder(spark)
    converted(table(spark, d, "pages"), folder, "page_id", "url", "html")
    read = read_warc(spark, folder, payloads=False)
    # Rows that repeat a page share a record id: one of them is enough to tell the key.
    kept = read.filter(F.col("record_type") == "response").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("key").alias("to"))
    return read.join(kept, "refers_to", "left").select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("to").alias("refers_to"),
        "record_id", "url", "date",
    )


def op4_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.jaccard import similar_components

    return similar_components(table(spark, d, "documents").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.substring import repeated_units

    return repeated_units(table(spark, d, "documents").select("doc_id", "text"))


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.decontaminate import leaks

    docs = table(spark, d, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, d, "benchmark")).drop("text_hash")


def op7_language(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.language import identified, in_part, trained

    docs = table(spark, d, "documents")
    held_out = in_part(F.col("doc_id"), 4, 2)
    model = trained(docs.filter(~held_out).select("doc_id", "text", "lang"))
    found = F.col("language")
    return identified(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), found["lang"].alias("lang_pred"), found["score"].alias("score"),
        found["rejected"].alias("rejected"),
    )


def op8_secrets(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.secrets import KINDS, of_kind, scanned, span_text

    found = F.col("secrets")
    base = F.filter(found, lambda s: s["kind"] < 3)
    counts = [F.size(of_kind(found, k)).cast("long").alias(f"n_{k}") for k in KINDS]
    docs = table(spark, d, "documents").select("doc_id", "text")
    return scanned(docs).select(
        "doc_id", *counts[:3], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(found).alias("spans"), counts[3],
    )


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.mixing import MIX, with_copies

    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    mix = F.col(MIX)
    return with_copies(docs).select(
        "doc_id", mix["size"].alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"),
        (mix["copies"] * mix["size"]).alias("taken"), "source", mix["copies"].alias("copies"),
    )


def op10_nearest(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.nearest import nearest

    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


NEAREST_SQL = """WITH v AS (
    SELECT DISTINCT vec_id, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  p AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           sqrt(list_reduce(list_transform(list_zip(q.embedding::DOUBLE[], c.embedding::DOUBLE[]),
                lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.embedding) = len(q.embedding)
    WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    from sparkaudit.llm.trie import grafted, numbered, prefix_trie

    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(*grafted(numbered(turns))).drop("node", "parent", "n_ends")


TRIE_SQL = """WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
  c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS head,
           xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                 lambda x: list_prepend(ascii(x)::BIGINT, [-1::BIGINT for i in range(8)])))),
               lambda a, v: CASE WHEN v >= 0 THEN xor(a, v)
                                 ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) END),
             4294967295::BIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
  b AS (
    SELECT c.conv_id, 0 AS part, t.r, t.role, t.text FROM c JOIN t ON t.conv_id = c.head AND t.r <= c.h
    UNION ALL SELECT c.conv_id, 1, t.r, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.r > c.h),
  p AS (
    SELECT c.conv_id, list({'role': b.role, 'text': b.text} ORDER BY b.part, b.r) FILTER (b.part IS NOT NULL) AS turns
    FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
  q AS (SELECT conv_id, coalesce(len(turns), 0) AS n, coalesce(turns, []) AS turns FROM p),
  e AS (
    SELECT conv_id, n, unnest(range(n + 1)) AS depth, turns FROM q),
  m AS (
    SELECT conv_id, n, depth, min(conv_id) OVER (PARTITION BY depth, turns[1:depth]) AS node,
           CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].text)) ELSE 0 END AS bytes FROM e),
  g AS (
    SELECT node, depth, count(*) AS n_convs, max(n) AS deepest, any_value(bytes) AS bytes,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM m GROUP BY node, depth),
  l AS (
    SELECT g.*, a.node AS anc, a.depth AS anc_depth
    FROM g JOIN m a ON a.conv_id = g.node AND a.depth <= g.depth),
  s AS (
    SELECT anc, anc_depth, count_if(depth = anc_depth + 1) AS n_children, count_if(deepest = depth) AS n_leaves,
           sum((n_convs - 1) * bytes) AS saved_tokens
    FROM l GROUP BY anc, anc_depth)
  SELECT g.node AS conv_id, g.depth, p.node AS parent_conv_id, g.n_convs, s.n_children, s.n_leaves,
         s.saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
  FROM g JOIN s ON s.anc = g.node AND s.anc_depth = g.depth
  LEFT JOIN m p ON p.conv_id = g.node AND p.depth = g.depth - 1"""


def op12_token_files(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from sparkaudit.llm.token_files import read_token_files, write_token_files

    folder = shared_folder(spark)
    written = write_token_files(table(spark, d, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder, written, ids=False)


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from sparkaudit.llm.alignment import aligned_documents

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    docs = table(spark, d, "documents").select("doc_id", "text")
    return aligned_documents(docs, *paths)


QUERIES = {
    "op1_url_filter": (op1_url_filter, URL_SQL),
    "op2_language_model": (op2_language_model, None),
    "op3_warc": (op3_warc, None),
    "op4_jaccard_join": (op4_jaccard_join, None),
    "op5_substring_dedup": (op5_substring_dedup, None),
    "op6_decontamination": (op6_decontamination, None),
    "op7_language": (op7_language, None),
    "op8_secrets": (op8_secrets, None),
    "op9_mixing": (op9_mixing, None),
    "op10_nearest": (op10_nearest, NEAREST_SQL),
    "op11_prefix_trie": (op11_prefix_trie, TRIE_SQL),
    "op12_token_files": (op12_token_files, None),
    "op13_alignment": (op13_alignment, None),
}
