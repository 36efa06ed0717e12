"""Alignment of two tokenizers: every digest column against brute force over all token pairs."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from sparkaudit.llm import alignment as A
from sparkaudit.llm.queries import op13_alignment

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
DOCS = "doc_id long, text string, row int, n_a int, pairs int"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def tokens_of(tokenizers, text):
    """(ids, bytes) of A and B, or nothing."""
    a, b = tokenizers
    if not text:
        return None
    # The byte-level decoder gives a token's letters back as bytes; each token alone need not be UTF-8.
    letters = A.byte_letters()
    a_ids = a.encode(f" {text}", add_special_tokens=False).ids
    a_tok = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_tok = []
    for i in b_ids:
        p = b.id_to_piece(i)
        b_tok.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    want = f" {text}".encode()
    return (a_ids, a_tok, b_ids, b_tok) if b"".join(a_tok) == want == b"".join(b_tok) else None


def brute(tokenizers, rows):
    per, held = [], Counter()
    for key, text, *_ in rows:
        found = tokens_of(tokenizers, text)
        if not found:
            per.append((key, 0, 0, 0, [], ""))
            continue
        a_ids, a_tok, b_ids, b_tok = found
        a_span, b_span = spans(a_tok), spans(b_tok)
        links = [(x, y) for x, (s, e) in zip(a_ids, a_span) for y, (u, v) in zip(b_ids, b_span) if s < v and u < e]
        ends = sorted({e for _, e in a_span} & {e for _, e in b_span})
        groups, low = [], 0
        for end in ends:
            inside = lambda ids, sp: ",".join(str(i) for i, (s, e) in zip(ids, sp) if low <= s and e <= end)  # noqa: E731, B023
            groups.append(f"{inside(a_ids, a_span)}|{inside(b_ids, b_span)}")
            low = end
        held.update(set(links))
        per.append((key, len(a_ids), len(b_ids), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted(
        ((k, na, nb, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for k, na, nb, g, links, sha in per),
        key=str,
    )


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


ROWS = [
    (1, "The quick brown fox, über die Straße; qu'il n'y a pas.", 1, 1, 1), (2, None, 1, 1, 1), (3, "", 1, 1, 1), (4, " ", 1, 1, 1),
    (5, "  two  spaces   and\n\nlines\t end  ", 1, 1, 1), (6, "<|endoftext|> <s> </s> <0x41> <unk>", 1, 1, 1), (7, "piece ▁ mark", 1, 1, 1),
    (8, "日本語 emoji 👩‍👩‍👧 ﬁ Ａ", 1, 1, 1), (None, "no key here", 1, 1, 1), (1, "the same the same the same", 1, 1, 1),
    (1, "the same the same the same", 1, 1, 1), (9, "x" * 300, 1, 1, 1), (10, "a\x00b\x1c c", 1, 1, 1), (2**62, "aaaa bbbb! 12345 678", 1, 1, 1),
]


@pytest.mark.parametrize("limit", [0, A.BROADCAST_PAIRS])
def test_against_brute_force(spark, tokenizers, monkeypatch, limit):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", limit)
    got = rows_of(A.aligned_documents(spark.createDataFrame(ROWS, DOCS).repartition(3), *PATHS))
    assert got == brute(tokenizers, ROWS)


def test_windows_and_sections_change_nothing(tokenizers, monkeypatch):
    texts = [t or "" for _, t, *_ in ROWS] + ["word  and   " * 50, "no_spaces" * 40, "end " * 30]
    whole = [(n_a, n_b, g, n, said, p.tolist(), c.tolist()) for n_a, n_b, g, n, said, p, c in A.Aligner(*PATHS).aligned(texts)]
    monkeypatch.setattr(A, "SECTION", 7)
    monkeypatch.setattr(A, "MEMO", 3)
    both = A.Aligner(*PATHS)
    assert both.in_sections
    again = [(n_a, n_b, g, n, said, p.tolist(), c.tolist()) for n_a, n_b, g, n, said, p, c in both.aligned(texts)]
    assert again == whole
    for text, ids in zip(texts, both.b_ids(texts)):
        assert ids.tolist() == tokenizers[1].encode(text)


def test_groups_are_returned(spark):
    out = A.aligned_documents(spark.createDataFrame(ROWS[:1], DOCS), *PATHS, groups=True).collect()[0]
    assert hashlib.sha256(out["groups"].encode()).hexdigest() == out["groups_sha256"]
    assert out["groups"].count(";") + 1 == out["n_groups"]


def test_very_long_text(spark):
    rows = [(1, "long wörd, " * 60000, 1, 1, 1), (2, "long", 1, 1, 1)]
    got = {r["doc_id"]: r for r in A.aligned_documents(spark.createDataFrame(rows, DOCS), *PATHS).collect()}
    assert got[1]["n_links"] >= got[1]["n_groups"] > 60000 and got[1]["count_sum"] > got[1]["n_links"] >= got[1]["n_best"]


def test_empty(spark):
    assert A.aligned_documents(spark.createDataFrame([], DOCS), *PATHS).count() == 0


def test_query(spark, tokenizers):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(A.aligned_documents(docs, *PATHS)) == brute(tokenizers, rows)
    out = op13_alignment(spark, d)
    assert set(NAMES) <= set(out.columns) and out.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_windows_are_encoded_once():
    """Both tokenizers see a window the first time alone, wherever it stands."""
    both = A.Aligner(*PATHS)
    asked = []

    class Counted:
        def encode(self, texts, **how):
            asked.extend(texts)
            return inner.encode(texts, **how)

    inner, both.b = both.b, Counted()
    first = [t[:4] for t in both.aligned(["über den Fluss\nund zurück.", "den Wald"])]
    assert sorted(asked) == sorted(["über", "den", "Fluss", "\nund", "zurück.", "Wald"])
    asked.clear()
    again = [t[:4] for t in both.aligned(["den Wald", "über den Fluss\nund zurück.", "Fluss über\nund"])]
    assert not asked and again[:2] == first[::-1]
