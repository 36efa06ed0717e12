"""Substring deduplication against brute force; offsets, ranks and odd rows."""

from sparkaudit.llm import substring as S
from sparkaudit.llm.queries import op5_substring_dedup

LINE = "one line that stands in many documents, with a tail"
ROWS = [
    (3, f"{LINE}\nshort line\nA sentence of its own that nobody else has. {LINE.upper()}!"),
    (1, f"lead in words. {LINE}. And then some more words follow here"),
    (2, f"glued to {LINE}\n\n  {LINE}  \nshort line"),
    (5, None), (6, ""), (7, "\n\n . ! \n"), (8, "é𝒳 " * 3 + "tail words here. " + LINE),
    (None, LINE), (9, "word " * 50_000 + "\n" + LINE), (1, "same id but another text with enough words"),
]


def brute(rows, least=S.LEAST):
    found = {}
    for key, text in rows:
        for start, end, digest in S.units_of(text or "", least):
            found.setdefault(digest, []).append(((key is None, key or 0, start), key, start, end))
    gone = []
    for places in found.values():
        first = min(p[0] for p in places)
        kept = next(p for p in places if p[0] == first)
        gone += [(key, start, end, kept[1], kept[2]) for rank, key, start, end in places if rank != first]
    return sorted(gone, key=str)


def test_units_and_normal_form():
    text = "One two three four five six. Seven!\n  ONE  two three four five SIX\nfew words"
    units = list(S.units_of(text))
    assert [text[a:b].strip() for a, b, _ in units] == ["One two three four five six.", "ONE  two three four five SIX"]
    assert units[0][2] == units[1][2]


def test_against_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = brute(ROWS)
    assert want and all(text_of(w) for w in want)
    for bound in (S.BROADCAST_DIGESTS, 0):
        monkeypatch.setattr(S, "BROADCAST_DIGESTS", bound)
        assert sorted((tuple(r) for r in S.repeated_units(docs).collect()), key=str) == want


def text_of(gone):
    texts = {k: t for k, t in ROWS[:-1]}
    return LINE.split(",")[0] in texts[gone[0]][gone[1] : gone[2]].lower()


def test_rest_of_texts(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, removed int, _key int")
    out = S.without_repeats(docs)
    assert out.columns == ["doc_id", "text", "removed", "_key", "removed_"]
    rest = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] != 1}
    assert rest[2] == f"glued to {LINE}\n\n\nshort line" and rest[None] == "" and rest[5] is None
    assert rest[3] == "\nshort line\nA sentence of its own that nobody else has. "
    assert rest[8] == "é𝒳 " * 3 + "tail words here. "
    assert {r["text"] for r in out.collect() if r["doc_id"] == 1} == {r[1] for r in ROWS if r[0] == 1}


def test_repeated_rows_tie(spark):
    docs = spark.createDataFrame([(4, LINE), (4, LINE)], "doc_id long, text string")
    assert S.repeated_units(docs).count() == 0


def test_empty_table(spark):
    assert S.repeated_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op5_substring_dedup(spark, d).collect()), key=str) == brute(rows)
