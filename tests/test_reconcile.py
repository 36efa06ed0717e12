from pyspark.sql import functions as F
import json

from sparkaudit.operators import reconcile as R
from sparkaudit.operators.pages import contiguous_pages
from sparkaudit.plans.reconcile import Reconciled, reconcile_both, reconcile_one
from sparkaudit.sinks import reconcile as sinks
from sparkaudit.sources import shows as S

LOCAL = "show_name string, season int, episode int, path string"
REMOTE = "show_name string, ordinal bigint, season int, episode int, name string, airdate string"
EPISODES = "series_id bigint, ordinal bigint, season int, episode int, name string, airdate string"
HITS = "show_name string, rank bigint, id bigint, title string, status string"
AS_OF = "2020-06-01"


def keys(df):
    return sorted((r["season"], r["episode"]) for r in df.collect())


def test_two_way_difference(spark):
    local = spark.createDataFrame(
        [("s", 1, 1, "a"), ("s", 1, 0, "b"), ("s", 1, 9, "c"), ("s", 1, 9, "d"), ("s", 1, 4, "e")], LOCAL)
    remote = spark.createDataFrame(
        [("s", 1, 1, 1, "x", "2020-01-01"), ("s", 2, 1, 2, "y", "2020-01-01"), ("s", 3, 1, 2, "y2", "2020-01-01"),
         ("s", 4, 1, 3, "z", "2021-01-01"), ("s", 5, 1, 4, "w", ""), ("s", 6, 1, 5, "v", "")], REMOTE)
    missing, extra = R.missing_from_local(remote, local, AS_OF), R.extra_in_local(local, remote)
    assert keys(missing) == [(1, 2), (1, 2)] and keys(extra) == [(1, 9), (1, 9)]
    assert keys(R.missing_from_local(remote, local, AS_OF, only_aired=False)) == [(1, 2), (1, 2), (1, 3), (1, 5)]
    assert {r["name"] for r in R.attach_names(missing, remote).collect()} == {"y2"}
    score = R.match_scores(local, remote, AS_OF).first()
    assert (score["known"], score["matched"], score["n_remote"], score["score"]) == (4, 1, 6, 0.25)


def test_scan_library(spark):
    names = ["/tv/A/Season 1/a.S01E01-E02.mkv", "/tv/A/Season 2/nothing.mp4", "/tv/.B/Season 1/S01E01.mkv",
             "/tv/C/misc/S01E01.mkv", "/tv/D/Extras 2/._S01E01.mkv", "/tv/D/Extras 2/x.divx", "/tv/A/loose.mkv",
             "/tv/A/S3/S02E05.mkv", "/tv/A/S3/S02E05.srt", "/tv/A/S3/deep/S02E06.mkv"]
    got = S.scan_show_library(spark.createDataFrame([(n,) for n in names], "path string"), "/tv/")
    assert sorted((r["show_name"], r["season"], r["episode"]) for r in got.collect()) == [
        ("A", 1, 1), ("A", 1, 2), ("A", 2, 0), ("A", 2, 5), ("D", 2, 0)]


def test_catalog_readers(spark):
    flat = json.dumps([{"season": 1, "number": 1, "name": "n", "airdate": "2020-01-01"}, {"season": 1, "number": 2, "type": "special"},
                       {"season": 1, "number": 3, "type": None}, {"season": 0, "number": 4}, {"season": 1, "number": None},
                       {"season": 1, "number": 5, "type": "regular", "airdate": None}])
    rows = S.read_catalog_flat(spark.createDataFrame([(7, flat)], "series_id bigint, payload string")).collect()
    assert [(r["episode"], r["airdate"]) for r in rows] == [(1, "2020-01-01"), (5, "")]

    def page(number, follows):
        return json.dumps({"data": {"episodes": [{"seasonNumber": 1, "number": number, "name": None}, {"seasonNumber": 0, "number": 1}]},
                           "links": {"next": follows}})

    pages = [(1, 0, page(1, "x")), (1, 1, page(2, None)), (1, 2, page(3, None)), (2, 0, page(1, "x")), (2, 1, None),
             (2, 2, page(3, "x")), (3, 1, page(1, "x")), (4, 0, "{bad")]
    rows = S.read_catalog_paged(spark.createDataFrame(pages, "series_id bigint, page int, payload string")).collect()
    assert sorted((r["series_id"], r["episode"], r["name"]) for r in rows) == [(1, 1, ""), (1, 2, ""), (2, 1, "")]


def test_search_readers(spark):
    a = json.dumps([{"show": {"id": 1, "name": "x", "status": "Ended"}}, {"show": {"id": 2}}])
    b = json.dumps({"data": [{"tvdb_id": "", "id": "9", "translations": {"eng": "E"}, "status": {"name": "Ended"}}, {"id": "3"}]})
    schema = "show_name string, payload string"
    assert [r["rank"] for r in S.read_search_flat(spark.createDataFrame([("s", a), ("t", None)], schema)).collect()] == [1, 2]
    rows = S.read_search_paged(spark.createDataFrame([("s", b), ("t", '{"data":[]}'), ("u", None)], schema)).collect()
    assert [(r["id"], r["title"], r["status"]) for r in rows] == [(9, "E", "Ended")]


def test_contiguous_pages(spark):
    pages = spark.createDataFrame([(1, p, True, p != 3) for p in (0, 1, 2, 3, 4)] + [(2, p, True, True) for p in (0, 1, 3)],
                                  "g int, page int, ok boolean, more boolean")
    assert sorted((r["g"], r["page"]) for r in contiguous_pages(pages, ["g"], "page", "ok", "more").collect()) == [
        (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]


def test_candidate_choice(spark):
    hits = spark.createDataFrame(
        [("a", 1, 1, "dev", "In Development"), ("a", 2, 2, "far", None), ("a", 3, 3, "near", "x"), ("a", 4, 4, "near too", "x"),
         ("b", 1, 2, "only", "x"), ("c", 1, 2, "first", "x"), ("c", 2, 3, "second", "x"),
         ("d", 1, 90, "u1", "x"), ("d", 2, 91, "u2", "x"), ("e", 1, 5, "dev", "In Development")]
        + [("f", i, 2, f"h{i}", "x") for i in range(1, 6)] + [("f", 6, 3, "sixth", "x")], HITS)
    aired = spark.createDataFrame([(2, 100), (3, 11), (4, 9)], "series_id bigint, aired bigint")
    counts = spark.createDataFrame([(s, 10) for s in "abdf"] + [("c", 0)], "show_name string, local_count bigint")
    got = {r["show_name"]: r["title"] for r in R.pick_candidate(hits, aired, counts).collect()}
    assert got == {"a": "near", "b": "only", "c": "first", "d": "u1", "f": "h1"}


def both(spark):
    local = spark.createDataFrame(
        [("tie", 1, 1, "p"), ("a wins", 1, 1, "p"), ("a wins", 1, 2, "q"), ("none", 1, 1, "p"), ("B only", 2, 7, "r"), ("B only", 2, 7, "s")], LOCAL)
    eps_a = spark.createDataFrame(
        [(1, 1, 1, 1, "a1", "2020-01-01"), (2, 1, 1, 1, "a1", "2020-01-01"), (2, 2, 1, 2, "a2", "2020-01-02"), (2, 3, 3, 1, "a3", "2020-01-02")], EPISODES)
    eps_b = spark.createDataFrame(
        [(11, 1, 1, 1, "b1", "2020-01-01"), (12, 1, 1, 1, "b1", "2020-01-01"), (13, 1, 1, 1, "b1", "2020-01-01"), (13, 2, 2, 5, "b2", "2020-01-01")], EPISODES)
    hits_a = spark.createDataFrame([("tie", 1, 1, "Tie", None), ("a wins", 1, 2, "A", "Ended")], HITS)
    hits_b = spark.createDataFrame([("tie", 1, 11, "TieB", "Ended"), ("a wins", 1, 12, "A", "x"), ("B only", 1, 13, "B only", None)], HITS)
    return local, hits_a, eps_a, hits_b, eps_b


def test_reconcile_both_and_sinks(spark, scratch):
    result = reconcile_both(*both(spark), AS_OF)
    got = {r["show_name"]: r for r in result.reports.collect()}
    assert {k: r["source_used"] for k, r in got.items()} == {"tie": "thetvdb", "a wins": "tvmaze", "none": "both", "B only": "thetvdb"}
    assert got["tie"]["ok"] and not got["a wins"]["ok"] and not got["none"]["ok"]
    assert (got["B only"]["missing_count"], got["B only"]["extra_count"]) == (2, 2)
    assert got["none"]["lookup_error"] == "No match found on TVmaze or TheTVDB" and got["none"]["extra_count"] == 0
    totals = R.reconcile_totals(result.reports).first()
    assert (totals["shows"], totals["ok"], totals["issues"], totals["local"], totals["missing"]) == (4, 1, 3, 6, 3)
    sinks.write_reconcile_csv(result.reports, f"{scratch}/csv")
    sinks.write_reconcile_json(result, f"{scratch}/json")
    sinks.write_reconcile_text(result, f"{scratch}/text")
    rows = spark.read.option("header", True).csv(f"{scratch}/csv").collect()
    assert [r["show_name"] for r in rows] == ["a wins", "B only", "none", "tie"] and len(rows[0]) == 10
    doc = {r["show_name"]: r for r in spark.read.json(f"{scratch}/json").collect()}
    assert len(doc["B only"]["extra"]) == 2 and len(doc["tie"]["missing"]) == 0
    lines = [r[0] for r in spark.read.text(f"{scratch}/text").collect()]
    assert "TV Library Report — 4 shows scanned" in lines
    assert "    ✗ Season 03 entirely missing (1 episode)" in lines and "    ✗ Missing S02: S02E05" in lines
    assert "    ? Extra (not in THETVDB): S02E07, S02E07" in lines and "    ✓ All aired episodes present" in lines
    parts = sinks.reconcile_json_rows(result, per_part=1).filter("show_name = 'B only'").collect()
    assert sorted(len(r["missing"]) + len(r["extra"]) for r in parts) == [2, 2]
    result.unpersist()


def test_single_catalog_errors(spark):
    local, hits_a, eps_a, hits_b, eps_b = both(spark)
    got = {r["show_name"]: r["lookup_error"] for r in reconcile_one(local, hits_a, eps_a, AS_OF, "tvmaze").reports.collect()}
    assert got == {"tie": None, "a wins": None, "none": "No TVmaze match found", "B only": "No TVmaze match found"}
    empty = eps_b.filter("series_id = 12")
    got = {r["show_name"]: r["lookup_error"] for r in reconcile_one(local, hits_b, empty, AS_OF, "thetvdb").reports.collect()}
    assert got["tie"] == "No episodes found on TheTVDB" and got["none"] == "No TheTVDB match found" and got["a wins"] is None


def test_missing_by_season_blocks(spark):
    missing = spark.createDataFrame([("s", 1, 1, e, "", "") for e in (999, 1000, 1000, 1)] + [("s", 1, 2, 1, "", "")], REMOTE)
    local = spark.createDataFrame([("s", 1, 5, "p"), ("s", 2, 0, "q")], LOCAL)
    rows = {(r["season"], r["block"]): r for r in R.missing_by_season(missing, local).collect()}
    assert rows[1, 0]["n_missing"] == 4 and len(rows[1, 0]["labels"]) == 2 and rows[1, 1]["labels"][0]["copies"] == 2
    assert rows[2, 0]["entirely_missing"] and not rows[1, 0]["entirely_missing"]
    files = spark.createDataFrame([("s", 1, e, f"p{e % 8}") for e in range(1, 17)], LOCAL)
    row = R.season_file_list(files).first()
    assert (row["episodes"], row["distinct_paths"], len(row["paths"]), row["more"]) == (16, 8, 6, 2)


def test_empty_catalog_counts_zero(spark):
    payloads = spark.createDataFrame(
        [(1, "[" + ",".join('{"season":1,"number":%d,"name":"n","airdate":"2000-01-01"}' % (i + 1) for i in range(100)) + "]"),
         (2, "[]"), (3, None), (4, "{bad")], "series_id bigint, payload string")
    from sparkaudit.sources import shows as S

    aired = R.aired_count(S.read_catalog_flat(payloads), "2020-01-01", landed=S.landed_catalogs(payloads))
    assert {r["series_id"]: r["aired"] for r in aired.collect()} == {1: 100, 2: 0}
    hits = spark.createDataFrame([("s", 1, 1, "one", "Running"), ("s", 2, 2, "two", "Running"), ("s", 3, 3, "three", "Running")],
                                 "show_name string, rank bigint, id bigint, title string, status string")
    counts = spark.createDataFrame([("s", 10)], "show_name string, local_count bigint")
    assert R.pick_candidate(hits, aired, counts).first()["id"] == 2


def test_labels_are_not_capped(spark):
    row = spark.range(1).select(R.repeated(F.lit("x"), F.lit(101)).alias("r")).first()
    assert row["r"] == ["x"] * 101


def test_lists_in_one_row_equal_lists_of_rows(spark):
    result = reconcile_both(*both(spark), AS_OF)
    short, rest = result.in_rows()
    lists = {r["show_name"]: r for r in short.collect()}
    assert set(lists) == {"tie", "a wins", "B only"} and rest.missing.count() == 0 and rest.extra.count() == 0
    assert [tuple(x) for x in lists["a wins"]["missing"]] == [(3, 1, "a3", "2020-01-02")]
    assert [tuple(x) for x in lists["B only"]["extra"]] == [(2, 7, "r"), (2, 7, "s")]
    short, rest = result.in_rows(0, 0)
    assert short.count() == 0 and (rest.missing.count(), rest.extra.count()) == (3, 2)
    result.unpersist()


def test_counts_do_not_repeat_a_series_for_each_show(spark):
    local = spark.createDataFrame([("s", 1, 1, "p"), ("s", 1, 1, "q"), ("s", None, 2, "p"), ("s", 1, 0, "u"), (None, 1, 1, "p")], LOCAL)
    eps = spark.createDataFrame(
        [(1, 1, 1, 1, "a", "2020-01-01"), (1, 2, 1, 1, "b", "2020-01-01"), (1, 3, None, 2, "c", "2020-01-01"), (1, 4, 9, 9, "d", "2020-01-01"),
         (1, 5, 1, 7, "e", "")], EPISODES)
    candidates = spark.createDataFrame([("s", 1), ("s", 1), (None, 1)], "show_name string, series_id bigint")
    stats = R.show_stats(local, {"r": candidates}, {"r": R.listed_keys(eps, AS_OF)})
    got = {r["show_name"]: (r["local_episodes"], r["known"], r["matched_r"], r["n_r"], r["missing_r"], r["extra_r"]) for r in stats.collect()}
    assert got == {"s": (4, 3, 3, 10, 2, 0), None: (1, 1, 1, 5, 2, 0)}


def test_pages_are_parsed_once(spark):
    page = '{"data":{"episodes":[{"seasonNumber":1,"number":2,"name":"n","aired":"2020-01-01"}]},"links":{"next":"1"}}'
    pages = spark.createDataFrame([(1, 0, page), (1, 1, page), (1, 3, page), (2, 1, page)], "series_id bigint, page int, payload string")
    out = S.read_catalog_paged(pages)
    assert "from_json" not in out._jdf.queryExecution().toString()
    assert sorted((r["series_id"], r["ordinal"] >> 32) for r in out.collect()) == [(1, 0), (1, 1)]


def odd_shows(spark):
    local = spark.createDataFrame(
        [("s", 2, 3, "p"), ("s", 1, 1, "q"), ("s", 1, 9, "r"), ("s", 1, 9, "r2"), ("s", 1, 0, "u"), ("s", None, 2, "v"), ("S", 1, 1, "p"),
         ("t", 1, 0, "u"), ("none", 1, 1, "p")], LOCAL)
    eps = spark.createDataFrame(
        [(1, 1, 2, 3, "a", "2020-01-01"), (1, 2, 2, 1, "b", "2020-01-01"), (1, 3, 2, 1, "c", "2020-01-01"), (1, 4, 10, 7, "d", "2020-01-01"),
         (1, 5, 2, 8, "e", ""), (1, 6, 1, 1, "f", "2020-01-01"), (2, 1, 1, 1, "g", "2020-01-01")], EPISODES)
    hits = spark.createDataFrame([("s", 1, 1, "s", "Ended"), ("S", 1, 2, "Other", None), ("t", 1, 1, "t", "")], HITS)
    return reconcile_one(local, hits, eps, AS_OF)


ODD_TEXT = [
    "TV Library Report — 4 shows scanned", "─" * 60, "  ✓ Complete:  1", "  ✗ Issues:    3", "",
    "► none", "    ⚠ No TVmaze match found", "",
    "► S  [TVMAZE: Other]  (Unknown)", "    Local: 1 episodes  |  TVMAZE (aired): 1 episodes", "    ✓ All aired episodes present", "",
    "► s  (Ended)", "    Local: 6 episodes  |  TVMAZE (aired): 6 episodes", "    ✗ Missing S02: S02E01, S02E01",
    "    ✗ Season 10 entirely missing (1 episode)", "    ? Extra (not in TVMAZE): S01E09, S01E09", "",
    "► t", "    Local: 1 episodes  |  TVMAZE (aired): 6 episodes", "    ✗ Season 01 entirely missing (1 episode)",
    "    ✗ Season 02 entirely missing (3 episodes)", "    ✗ Season 10 entirely missing (1 episode)", "",
]


def test_text_is_made_once_and_whole(spark, monkeypatch):
    result = odd_shows(spark)
    lines = sinks.reconcile_text_lines(result)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "Join" not in plan and "array_contains" not in plan
    assert [r[0] for r in lines.collect()] == ODD_TEXT
    issues = [r[0] for r in sinks.reconcile_text_lines(result, missing_only=True).collect()]
    assert issues == ODD_TEXT[:8] + ODD_TEXT[12:]
    whole = Reconciled.labels_in_rows
    monkeypatch.setattr(Reconciled, "labels_in_rows", lambda self: whole(self, 0, 0))
    assert [r[0] for r in sinks.reconcile_text_lines(result).collect()] == ODD_TEXT
    result.unpersist()


def test_lists_are_not_worked_out_for_each_entry(spark):
    result = odd_shows(spark)
    short, _ = result.in_rows()
    plan = short.filter(F.size("missing") > 0).select("missing", "extra")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" in plan and "array_contains(transform" not in plan
    result.unpersist()
