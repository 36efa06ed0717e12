"""Secret scans: base spans against Python's regular expressions, the battery on random and natural strings."""

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from sparkaudit.llm import secrets as S
from sparkaudit.llm.queries import op8_secrets

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
PATTERNS = [
    ("assign", ASSIGN, lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def brute(text):
    found = []
    for place, (kind, pattern, good) in enumerate(PATTERNS):
        found += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text or "") if good(m)]
    return sorted(found)


def joined(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)


def test_base_spans(spark):
    rng = random.Random(3)
    bits = ["password", "TOKEN", "api_key", "apikey", "Secret", "=", ": ", '"', "'", " ", "é", "𝒳", "AKIA", "\n", "ab12cd34", "ABCDEFGH1234", "ſecret", "0f" * 16]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "token=secret=abcdefgh12", "token: secret: abcdefghij", "token: password: abcdefghij", "x" * 200_000 + " passwd = 'abcdefgh'"]
    texts += ["AKIA" + "A" * 12, "AKIA" + "A" * 11, "AKIAAKIA" * 5, "a" * 31, "a" * 32 + "G"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = S.scanned(rows.withColumn("_base", F.lit(1)).withColumn("secrets_", F.lit(2))).select("doc_id", S.span_text(F.filter("secrets", lambda s: s["kind"] < 3)).alias("s"))
    got = {r["doc_id"]: r["s"] for r in out.collect()}
    assert got == {i: joined(brute(t)) for i, t in enumerate(texts)}


def test_battery_tells_random_from_natural(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name, symbols in S.SYMBOLS.items():
        for n in (24, 32, 40, 64):
            for _ in range(100):
                rows.append((name, True, "".join(symbols[i] for i in rng.integers(0, len(symbols), n))))
    rows += [("base36", False, "version" * 4 + "1"), ("base64", False, "ReleaseNotesOfTheYear2024" * 2), ("hex", False, "a1" * 20), ("base36", False, "1234567890" * 3 + "a")]
    df = spark.createDataFrame(rows, "encoding string, random boolean, s string")
    df = df.withColumn("p", S.random_p(F.col("s"), F.col("encoding")))
    shares = df.filter("random").groupBy("encoding").agg(F.avg((F.col("p") > 0.01).cast("int")).alias("share")).collect()
    assert all(r["share"] > 0.94 for r in shares), shares
    assert df.filter("not random").agg(F.max("p")).first()[0] < 0.01


def test_added_spans_and_redaction(spark):
    rng = random.Random(9)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(30)]
    rows = [(i, f"see {k} here é", 7) for i, k in enumerate(keys)] + [(100 + i, "path " + "abz1" * 12, 7) for i in range(60)]
    rows += [(200, "password=hunter2hunter2 and more", 7), (201, None, 7), (202, "", 7), (203, "nothing at all", 7), (None, "token: abcdefgh", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _secrets int")
    found = {r["doc_id"]: r["secrets"] for r in S.scanned(docs).collect()}
    assert sum(len(found[i]) == 1 and (found[i][0]["start"], found[i][0]["end"]) == (4, 44) for i in range(30)) >= 28
    assert all(not found[100 + i] for i in range(60))
    out = {r["doc_id"]: r["text"] for r in S.redacted(docs).collect()}
    assert S.redacted(docs).columns == docs.columns
    assert out[200] == "[SECRET] and more" and out[None] == "[SECRET]"
    assert out[201] is None and out[202] == "" and out[203] == "nothing at all"
    assert sum(out[i] == "see [SECRET] here é" for i in range(30)) >= 28


def test_overlapping_spans_are_one_mark(spark):
    text = "token=" + "AKIA" + "B" * 20 + " " + "0a" * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert S.redacted(docs).first()["text"] == "[SECRET] [SECRET]"


def test_empty_table(spark):
    assert S.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op8_secrets(spark, d).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = brute(t)
        counts = tuple(sum(s[3] == k for s in base) for k in ("assign", "access", "hex"))
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == counts
        assert got[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(spans) >= set(joined(base).split(",") if base else [])
