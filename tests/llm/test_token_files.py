"""Token files: exact round trips of the coder and the files, ids of whole texts, order, damage, odd rows."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkaudit.llm import range_coder as R
from sparkaudit.llm import token_files as T
from sparkaudit.llm.queries import op12_token_files
from sparkaudit.llm.tokenizing import ByteLevelEncoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, key int, file string"


@pytest.fixture(scope="module")
def encoder():
    return ByteLevelEncoder(BPE, False)


def whole(encoder, texts):
    return [f.ids for f in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70000), st.integers(0, 2000), st.integers(0, 10**6), st.sampled_from(["flat", "few", "repeat"]))
def test_coder_round_trip(vocab, n, seed, kind):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, vocab, n)
    if kind == "few":
        ids = np.minimum(rng.geometric(0.4, n), vocab) - 1
    elif kind == "repeat":
        ids = np.resize(ids[: max(1, n // 9)], n) if n else ids
    words, lengths = R.encoded(ids, vocab)
    assert len(words) == lengths.sum() and (lengths < 1 << 16).all()
    assert (R.decoded(words, lengths, n, vocab) == ids).all()


def test_coder_learns():
    rng = np.random.default_rng(1)
    ids = np.tile(rng.integers(0, 50000, 700), 300)
    words, _ = R.encoded(ids, 50257)
    assert len(words) * 32 < 2 * len(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'seréÀ,.;:!?-×1 \n\t\r\x0b\x1c\x85\xa0᠎　’")), max_size=40))
def test_parts_give_the_ids_of_the_whole(encoder, text):
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode([text])] == whole(encoder, [text])


def test_special_tokens(encoder):
    text = "a <|endoftext|> b"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole(encoder, [text])[0]
    assert 50256 in whole(encoder, [text])[0]
    plain = ByteLevelEncoder(BPE, True)
    ids = np.frombuffer(plain.encode([text])[0], "<u4").tolist()
    assert 50256 not in ids and plain.tokenizer.decode(ids) == text


def expected(encoder, rows):
    """Rows by key (null first); start, number and CRC of ids."""
    out, start = [], 0
    for key, text in rows:
        ids = np.array([*whole(encoder, [text or ""])[0], 0], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("size", [200, 32 << 20])
def test_files(spark, scratch, encoder, monkeypatch, size):
    monkeypatch.setattr(T, "FILE_BYTES", size)
    monkeypatch.setattr(T, "BLOCK", 1000)
    rows = [(i * 7 - 50, f"word{i} " * (i % 40), 1, "f") for i in range(60)] + [
        (2**60, None, 1, "f"), (2**60 + 1, "", 1, "f"), (-(2**63), "x", 1, "f"), (5000, "long é " * 30000, 1, "f"), (None, "no key", 1, "f"),
    ]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    written = T.write_token_files(docs, f"{scratch}/t", BPE)
    assert (written.count() > 1) == (size == 200)
    got = sorted((tuple(r) for r in T.read_token_files(spark, f"{scratch}/t", written).drop("file").collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[:4] for r in got] == expected(encoder, [r[:2] for r in order])
    for (_, _, _, _, ids), row in zip(got, order):
        assert encoder.tokenizer.decode(ids[:-1]) == (row[1] or "") and ids[-1] == 0


def test_a_hot_key_spreads_over_files(spark, scratch, encoder, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 500)
    rows = [(7, "same words here", 1, "f")] * 200 + [(1, "a", 1, "f"), (9, "b", 1, "f")]
    written = T.write_token_files(spark.createDataFrame(rows, DOCS).repartition(4), f"{scratch}/t", BPE)
    assert written.count() > 4
    got = sorted((tuple(r) for r in T.read_token_files(spark, f"{scratch}/t", written, ids=False).drop("file").collect()), key=lambda r: r[1])
    assert got == expected(encoder, sorted(r[:2] for r in rows))


def test_damage_is_found(spark, scratch):
    written = T.write_token_files(spark.createDataFrame([(1, "some text " * 50, 1, "f")], DOCS), f"{scratch}/t", BPE)
    name = next(f for f in os.listdir(f"{scratch}/t") if f.endswith(".tids"))
    data = open(f"{scratch}/t/{name}", "rb").read()
    keys, sizes, blocks = T.parse_file(data)
    assert keys == [1] and sizes.tolist() == [len(next(blocks))]
    for at in (len(T.MAGIC) + 40, len(data) - 40):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(T.parse_file(bytes(bad))[2])
    assert written.collect()[0]["ids"] == sizes.sum()


def test_empty(spark, scratch):
    written = T.write_token_files(spark.createDataFrame([], DOCS), f"{scratch}/t", BPE)
    assert written.count() == 0 and T.read_token_files(spark, f"{scratch}/t", written).count() == 0


def test_query(spark, encoder):
    d = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    got = op12_token_files(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(encoder, rows)


def test_words_of_latin_letters_skip_the_pattern(encoder, monkeypatch):
    """Such words, at starts of texts and lines too and with marks behind, go to the model at once, with the same ids."""
    text = "Čas\nWörter, straße. DÉJÀ vu:\nàé ÿªº µm. a\nB c. ***\nEnde.) (nicht) don't naïve\"] x's x2, ab###\n#ab '' '"
    own = ByteLevelEncoder(BPE, False)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == whole(encoder, [text])[0]
    own, sent = ByteLevelEncoder(BPE, False), []
    asked = own._ids
    monkeypatch.setattr(own, "_ids", lambda texts: sent.extend(texts) or asked(texts))
    text = "Wörter straße, DÉJÀ vu:\nàé ÿ, naïve\nwords"
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == whole(encoder, [text])[0]
    assert not [t for t in sent if any(c.isalpha() for c in t)]


def test_runs_of_white_space_are_parts_too(encoder):
    """Texts with runs, tabs and line ends are cut as well, and each distinct part is encoded once."""
    texts = ["a1  b2\tc3 \n\n d4", " \n\tx9\r\n y", "a1  b2\tc3 \n\n d4 \t", "e f g　", "h  i", "", "\n", "  "]
    own = ByteLevelEncoder(BPE, False)
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == whole(encoder, texts)
    assert {"a1", "  b2\tc3", " \n\n d4"} <= set(own.memo) and not [p for p in own.memo if "h" in p]
    asked = []
    learn = own.part_ids
    own.part_ids = lambda parts: asked.extend(parts) or learn(parts)
    own.encode(texts)
    assert not asked
