"""Episode reconcile queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.functions import episodes as E
from sparkaudit.operators import reconcile as R
from sparkaudit.operators.ordering import spread
from sparkaudit.operators.pages import contiguous_pages
from sparkaudit.plans.reconcile import Reconciled, reconcile_both, reconcile_one
from sparkaudit.queries import table
from sparkaudit.sinks.reconcile import reconcile_csv_rows, reconcile_json_rows, reconcile_text_lines
from sparkaudit.sources import shows as S

AS_OF = "1999-01-01"


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- lines as episodes of forty shows ---------------------------------------


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"
    )


def landed(df: DataFrame) -> DataFrame:
    """Payload rows, dealt to all cores before they are written and parsed as text."""
    return spread(df)


def remote_rows(spark: SparkSession, d: str) -> DataFrame:
    airdate = F.date_format("l_shipdate", "yyyy-MM-dd")
    return lines(spark, d).select(
        text("Show ", F.col("l_suppkey") % 40).alias("show_name"),
        F.col("l_orderkey").alias("ordinal"),
        F.col("l_linenumber").alias("season"),
        (F.col("l_partkey") % 290 + 1).cast("int").alias("episode"),
        text("P", F.col("l_partkey")).alias("name"),
        F.when(F.col("l_quantity") == 50, "").otherwise(airdate).alias("airdate"),
    )


def local_rows(spark: SparkSession, d: str) -> DataFrame:
    show = text("Show ", F.col("l_suppkey") % 40)
    return lines(spark, d).filter("l_returnflag <> 'R'").select(
        show.alias("show_name"),
        F.col("l_linenumber").alias("season"),
        F.when(F.col("l_quantity") == 49, 0).otherwise(F.col("l_partkey") % 290 + 1).cast("int").alias("episode"),
        text("/tv/", show, "/Season ", F.col("l_linenumber"), "/", F.col("l_orderkey"), ".mkv").alias("path"),
    )


REMOTE_SQL = """
  SELECT 'Show ' || (l_suppkey % 40) AS show_name, l_orderkey AS ordinal, l_linenumber AS season,
         (l_partkey % 290 + 1)::INT AS episode, 'P' || l_partkey AS name,
         CASE WHEN l_quantity = 50 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS airdate FROM lineitem
"""
LOCAL_SQL = """
  SELECT 'Show ' || (l_suppkey % 40) AS show_name, l_linenumber AS season,
         CASE WHEN l_quantity = 49 THEN 0 ELSE (l_partkey % 290 + 1)::INT END AS episode,
         '/tv/Show ' || (l_suppkey % 40) || '/Season ' || l_linenumber || '/' || l_orderkey || '.mkv' AS path
  FROM lineitem WHERE l_returnflag <> 'R'
"""
WITH_SQL = f"WITH remote AS ({REMOTE_SQL}), local AS ({LOCAL_SQL})"
AIRED_SQL = f"airdate <> '' AND airdate <= '{AS_OF}'"
SAME_SQL = "{0}.show_name = {1}.show_name AND {0}.season = {1}.season AND {0}.episode = {1}.episode"

MISSING_SQL = f"""SELECT r.* FROM remote r WHERE {AIRED_SQL} AND NOT EXISTS (
  SELECT 1 FROM local l WHERE l.episode <> 0 AND {SAME_SQL.format('l', 'r')})"""
EXTRA_SQL = f"""SELECT l.* FROM local l WHERE l.episode <> 0 AND NOT EXISTS (
  SELECT 1 FROM remote r WHERE {SAME_SQL.format('l', 'r')})"""


def missing(spark, d):
    return R.missing_from_local(remote_rows(spark, d), local_rows(spark, d), AS_OF)


def sparse_remote(spark, d):
    """A catalog without the even orders, so that local files beyond it exist."""
    return remote_rows(spark, d).filter(F.col("ordinal") % 2 == 1)


def extra(spark, d):
    return R.extra_in_local(local_rows(spark, d), sparse_remote(spark, d))


def named_gaps(spark, d):
    gaps = missing(spark, d).select(*R.KEYS)
    return R.attach_names(gaps, remote_rows(spark, d))


def match_score(spark, d):
    scores = R.match_scores(local_rows(spark, d), sparse_remote(spark, d), AS_OF)
    return scores.withColumn("score", F.round("score", 9))


MATCH_SQL = f"""
  SELECT l.show_name, count(*) FILTER (WHERE l.episode <> 0) AS known,
         count(*) FILTER (WHERE l.episode <> 0 AND k.show_name IS NOT NULL) AS matched,
         any_value(n.n) AS n_remote,
         round(coalesce(count(*) FILTER (WHERE l.episode <> 0 AND k.show_name IS NOT NULL)
               / nullif(count(*) FILTER (WHERE l.episode <> 0), 0)::DOUBLE, 0), 9) AS score
  FROM local l
  LEFT JOIN (SELECT DISTINCT show_name, season, episode FROM remote WHERE ordinal % 2 = 1 AND {AIRED_SQL}) k
    ON {SAME_SQL.format('k', 'l')}
  JOIN (SELECT show_name, count(*) AS n FROM remote WHERE ordinal % 2 = 1 GROUP BY 1) n ON n.show_name = l.show_name
  GROUP BY l.show_name
"""


def matched_rows(spark, d):
    return R.match_local_remote(local_rows(spark, d), sparse_remote(spark, d), AS_OF)


def choose_catalog(spark, d):
    """Catalog a lists the odd orders, catalog b the orders that divide by three, not for every show."""
    local, remote = local_rows(spark, d), remote_rows(spark, d)
    a = remote.filter((F.col("ordinal") % 2 == 1) & ~F.col("show_name").endswith("7"))
    b = remote.filter((F.col("ordinal") % 3 == 0) & ~F.col("show_name").endswith("5") & (F.col("show_name") != "Show 7"))
    chosen = R.choose_catalog(R.match_scores(local, a, AS_OF), R.match_scores(local, b, AS_OF))
    return chosen.select("show_name", "n_a", "n_b", "chosen")


def _score_sql(where: str) -> str:
    return f"""SELECT l.show_name, coalesce(count(*) FILTER (WHERE l.episode <> 0 AND k.show_name IS NOT NULL)
                 / nullif(count(*) FILTER (WHERE l.episode <> 0), 0)::DOUBLE, 0) AS score,
               coalesce(any_value(n.n), 0) AS n
        FROM local l LEFT JOIN (SELECT DISTINCT show_name, season, episode FROM remote WHERE {where} AND {AIRED_SQL}) k
          ON {SAME_SQL.format('k', 'l')}
        LEFT JOIN (SELECT show_name, count(*) AS n FROM remote WHERE {where} GROUP BY 1) n ON n.show_name = l.show_name
        GROUP BY l.show_name"""


CHOOSE_SQL = f"""{WITH_SQL},
  a AS ({_score_sql("ordinal % 2 = 1 AND NOT show_name LIKE '%7'")}),
  b AS ({_score_sql("ordinal % 3 = 0 AND NOT show_name LIKE '%5' AND show_name <> 'Show 7'")})
  SELECT show_name, a.n AS n_a, b.n AS n_b,
         CASE WHEN b.score >= a.score AND b.n > 0 THEN 'b' WHEN a.n > 0 THEN 'a' END AS chosen
  FROM a JOIN b USING (show_name)"""


def missing_by_season(spark, d):
    """Shows whose name ends in 3 keep no local file of season 2."""
    local = local_rows(spark, d).filter(~(F.col("show_name").endswith("3") & (F.col("season") == 2)))
    gaps = R.missing_from_local(remote_rows(spark, d), local, AS_OF)
    seasons = R.missing_by_season(gaps, local)
    return seasons.select("show_name", "season", "n_missing", "entirely_missing", R.label_list(F.col("labels")).alias("labels"))


MISSING_BY_SEASON_SQL = f"""{WITH_SQL},
  kept AS (SELECT * FROM local WHERE NOT (show_name LIKE '%3' AND season = 2)),
  gaps AS (SELECT r.* FROM remote r WHERE {AIRED_SQL} AND NOT EXISTS (
             SELECT 1 FROM kept l WHERE l.episode <> 0 AND {SAME_SQL.format('l', 'r')}))
  SELECT show_name, season, count(*) AS n_missing,
         NOT EXISTS (SELECT 1 FROM kept l WHERE l.episode <> 0 AND l.show_name = g.show_name AND l.season = g.season)
           AS entirely_missing,
         string_agg(printf('S%02dE%02d', season, episode), ', ' ORDER BY episode) AS labels
  FROM gaps g GROUP BY show_name, season"""


def season_sets(spark, d):
    return R.season_sets(local_rows(spark, d), parsed_only=True)


def season_files(spark, d):
    listed = R.season_file_list(local_rows(spark, d))
    return listed.withColumn("paths", F.array_join("paths", "|"))


SEASON_FILES_SQL = f"""{WITH_SQL},
  p AS (SELECT show_name, season, path, count(*) AS n FROM local WHERE episode <> 0 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY show_name, season ORDER BY path) AS i FROM p)
  SELECT show_name, season, sum(n)::BIGINT AS episodes, count(*) AS distinct_paths,
         string_agg(path, '|' ORDER BY path) FILTER (WHERE i <= 6) AS paths, greatest(count(*) - 6, 0) AS more
  FROM r GROUP BY show_name, season"""


def local_counts(spark, d):
    return R.local_episode_count(local_rows(spark, d))


def aired_counts(spark, d):
    return R.aired_count(remote_rows(spark, d), AS_OF, ["show_name"])


# ---- names and hierarchies ---------------------------------------------------

SHAPES = 9


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """File names in every known shape, one per line item."""
    s, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    more = q + F.col("l_linenumber")
    forms = [
        text("show.S", s, "E", q, ".mkv"),
        text("show.s0", s, "e", q, "-E", more, ".mkv"),
        text("show S", s, "E", q, "E", more, ".1080p.mkv"),
        text("show ", s, "x", q, ".avi"),
        text("show.", s, F.lpad(q.cast("string"), 2, "0"), ".mp4"),
        text("show.S00E", q, ".720p.mkv"),
        text("S", s + 96, "E", q, ".", s, "x0", q, ".mkv"),
        text("S0", s, "E", more, "-e", q, ".ts"),
        text("extra clip ", F.col("l_orderkey"), ".mkv"),
    ]
    kind = (F.col("l_orderkey") % SHAPES + 1).cast("int")
    return landed(lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", s, F.element_at(F.array(*forms), kind).alias("name"))


FILE_NAMES_SQL = """
  SELECT l_orderkey, l_linenumber, CASE l_orderkey % 9
    WHEN 0 THEN 'show.S' || s || 'E' || q || '.mkv'
    WHEN 1 THEN 'show.s0' || s || 'e' || q || '-E' || (q + s) || '.mkv'
    WHEN 2 THEN 'show S' || s || 'E' || q || 'E' || (q + s) || '.1080p.mkv'
    WHEN 3 THEN 'show ' || s || 'x' || q || '.avi'
    WHEN 4 THEN 'show.' || s || printf('%02d', q) || '.mp4'
    WHEN 5 THEN 'show.S00E' || q || '.720p.mkv'
    WHEN 6 THEN 'S' || (s + 96) || 'E' || q || '.' || s || 'x0' || q || '.mkv'
    WHEN 7 THEN 'S0' || s || 'E' || (q + s) || '-e' || q || '.ts'
    ELSE 'extra clip ' || l_orderkey || '.mkv' END AS name
  FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS s, l_quantity::INT AS q FROM lineitem)
"""


def _first_match_sql(pattern: str) -> str:
    return f"regexp_extract_all(stem, '{pattern}', 1)[1]", f"regexp_extract_all(stem, '{pattern}', 2)[1]"


def _parse_sql(names: str, keep: str) -> str:
    """First match of each pattern; the next pattern only when that match is out of bounds."""
    single = "(?i)s(\\d+)e(\\d+)", "(\\d+)[xX](\\d+)", "(?:^|\\D)(\\d)(\\d{2})(?:\\D|$)"
    cols = ", ".join(
        f"try_cast({g} AS INT) AS {n}{i}"
        for i, p in enumerate(single)
        for n, g in zip("se", _first_match_sql(p))
    )
    multi = "(?i)s(\\d+)e(\\d+)[-–]?e(\\d+)"
    rng = ", ".join(f"try_cast(regexp_extract(stem, '{multi}', {i + 1}) AS INT) AS m{i}" for i in range(3))
    ok = "coalesce({0} > 0 AND {0} < 100 AND {1} > 0 AND {1} < 300, false)"
    return f"""
      SELECT {keep}, CASE
        WHEN coalesce(m0 > 0 AND m0 < 100 AND m1 > 0 AND m1 < 300 AND m2 > 0 AND m2 < 300 AND m2 >= m1, false)
          THEN [{{'s': m0, 'e': e}} FOR e IN range(m1, m2 + 1)]
        WHEN {ok.format('s0', 'e0')} THEN [{{'s': s0, 'e': e0::BIGINT}}]
        WHEN {ok.format('s1', 'e1')} THEN [{{'s': s1, 'e': e1::BIGINT}}]
        WHEN {ok.format('s2', 'e2')} THEN [{{'s': s2, 'e': e2::BIGINT}}]
        ELSE [] END AS found
      FROM (SELECT *, {cols}, {rng} FROM (SELECT *, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM ({names})))
    """


def parse_names(spark, d):
    names = file_names(spark, d)
    label = F.transform(E.episodes_of(F.col("name")), lambda x: E.season_ep_label(x.season, x.episode))
    return names.select(
        "l_orderkey", "l_linenumber", "name", F.array_join(label, ",").alias("episodes"),
        E.episode_of(F.col("name"))["episode"].alias("first_episode"),
    )


PARSE_NAMES_SQL = f"""
  SELECT l_orderkey, l_linenumber, name,
         coalesce(array_to_string([printf('S%02dE%02d', x.s, x.e) FOR x IN found], ','), '') AS episodes,
         found[1].e AS first_episode
  FROM ({_parse_sql(FILE_NAMES_SQL, 'l_orderkey, l_linenumber, name')})
"""

FOLDERS = ["Season 1", "season_02", "S03", "s.4", "Extras 5", "6", " 7 ", "Specials", "misc"]


def scan_library(spark, d):
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.col("l_orderkey") % 10 % 9 + 1).cast("int"))
    show = text(F.when(F.col("l_orderkey") % 50 == 0, ".").otherwise(""), "Show ", F.col("l_orderkey") % 40)
    mark = F.when(F.col("l_orderkey") % 31 == 0, "._").otherwise("")
    files = file_names(spark, d).select(text("/tv/", show, "/", folder, "/", mark, F.col("name")).alias("path"))
    return S.scan_show_library(files, "/tv")


SCAN_SQL = f"""
  WITH f AS (SELECT *, {FOLDERS}[l_orderkey % 10 % 9 + 1] AS folder,
               CASE WHEN l_orderkey % 50 = 0 THEN '.' ELSE '' END || 'Show ' || (l_orderkey % 40) AS show_name
             FROM ({_parse_sql(FILE_NAMES_SQL, 'l_orderkey, l_linenumber, name')})
             WHERE l_orderkey % 31 <> 0),
  s AS (SELECT *, CASE WHEN folder IN ('Season 1') THEN 1 WHEN folder = 'season_02' THEN 2 WHEN folder = 'S03' THEN 3
                       WHEN folder = 's.4' THEN 4 WHEN folder = 'Extras 5' THEN 5 WHEN folder = '6' THEN 6
                       WHEN folder = ' 7 ' THEN 7 END AS dir_season FROM f)
  SELECT show_name, x.s::INT AS season, x.e::INT AS episode, '/tv/' || show_name || '/' || folder || '/' || name AS path
  FROM (SELECT *, unnest(CASE WHEN len(found) > 0 THEN found ELSE [{{'s': dir_season, 'e': 0::BIGINT}}] END) AS x
        FROM s WHERE dir_season IS NOT NULL AND NOT starts_with(show_name, '.'))
"""


# ---- landed payloads ---------------------------------------------------------


def flat_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Catalog A: documents of one episode each, keyed by part; some are specials or carry a null type."""
    li = landed(lines(spark, d).drop("l_suppkey", "l_returnflag"))
    kind = F.when(F.col("l_quantity") < 25, "").when(F.col("l_quantity") < 45, ',"type":"regular"')
    kind = kind.when(F.col("l_quantity") < 48, ',"type":"special"').otherwise(',"type":null')
    airdate = F.when(F.col("l_linenumber") == 6, "null").otherwise(
        F.date_format("l_shipdate", '"yyyy-MM-dd"'.replace('"', "'\"'"))
    )
    doc = text(
        '[{"season":', F.col("l_linenumber") - 1, ',"number":', F.col("l_quantity").cast("int"), ',"name":"P',
        F.col("l_orderkey"), '","airdate":', airdate, kind, "}]",
    )
    return li.select(F.col("l_partkey").alias("series_id"), doc.alias("payload"))


FLAT_SQL = """
  SELECT l_partkey AS series_id, l_linenumber - 1 AS season, l_quantity::INT AS episode, 'P' || l_orderkey AS name,
         CASE WHEN l_linenumber = 6 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS airdate
  FROM lineitem WHERE l_quantity < 45 AND l_linenumber > 1
"""


def catalog_flat(spark, d):
    return S.read_catalog_flat(flat_payloads(spark, d)).drop("ordinal")


def paged_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Catalog B: page documents keyed by part; a chain ends where (part + page) % 5 = 4."""
    page = F.col("l_linenumber") - 1
    end = (F.col("l_partkey") + page) % 5 == 4
    doc = text(
        '{"data":{"episodes":[{"seasonNumber":', F.when(F.col("l_quantity") == 1, 0).otherwise(F.col("l_linenumber")),
        ',"number":', F.col("l_quantity").cast("int"), ',"name":"B', F.col("l_orderkey"), '","aired":"',
        F.date_format("l_shipdate", "yyyy-MM-dd"), '"}]},"links":{"next":', F.when(end, "null").otherwise('"more"'), "}}",
    )
    lost = (F.col("l_partkey") % 11 == 3) & (page == 2)
    return landed(lines(spark, d).drop("l_suppkey", "l_returnflag")).select(
        F.col("l_partkey").alias("series_id"), page.alias("page"), F.when(~lost, doc).alias("payload")
    )


PAGED_SQL = """
  SELECT l.l_partkey AS series_id, l_linenumber AS season, l_quantity::INT AS episode, 'B' || l_orderkey AS name,
         strftime(l_shipdate, '%Y-%m-%d') AS airdate
  FROM lineitem l JOIN (
    SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY page) - 1 = page AS dense,
           coalesce(bool_and((l_partkey + page) % 5 <> 4) OVER (PARTITION BY l_partkey ORDER BY page
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached
    FROM (SELECT DISTINCT l_partkey, l_linenumber - 1 AS page FROM lineitem
          WHERE NOT (l_partkey % 11 = 3 AND l_linenumber = 3))) p
  ON p.l_partkey = l.l_partkey AND page = l_linenumber - 1
  WHERE dense AND reached AND l_quantity <> 1
"""


def catalog_paged(spark, d):
    return S.read_catalog_paged(paged_payloads(spark, d)).drop("ordinal")


def pages_prefix(spark, d):
    """Chains of line numbers per order; gaps and lines of quantity 1 break a chain."""
    li = lines(spark, d).select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("page"), F.lit(True).alias("ok"),
        (F.col("l_quantity") > 5).alias("more"),
    )
    return contiguous_pages(li, ["l_orderkey"], "page", "ok", "more").select("l_orderkey", "page", "more")


PAGES_SQL = """
  WITH p AS (SELECT l_orderkey, l_linenumber - 1 AS page, bool_and(l_quantity > 5) AS more FROM lineitem GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY page) - 1 = page AS dense,
               coalesce(bool_and(more) OVER (PARTITION BY l_orderkey ORDER BY page
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached FROM p)
  SELECT l.l_orderkey, page, l.l_quantity > 5 AS more
  FROM w JOIN lineitem l ON l.l_orderkey = w.l_orderkey AND l.l_linenumber - 1 = page WHERE dense AND reached
"""


def search_flat(spark: SparkSession, d: str) -> DataFrame:
    """Catalog A hits, up to seven per order, landed as one document each."""
    o = landed(table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    count = (F.col("o_custkey") % 8).cast("int")

    def hit(i):
        kind = (F.col("o_orderkey") + i) % 6
        status = F.when(kind == 0, "In Development").when(kind > 1, "Running")
        series = (F.col("o_orderkey") * 7 + i * 131) % 2000
        return F.struct(F.struct(series.alias("id"), text("P", series).alias("name"), status.alias("status")).alias("show"))

    hits = F.transform(F.slice(F.array(*[F.lit(i) for i in range(7)]), 1, count), hit)
    found = o.select(text("order ", F.col("o_orderkey")).alias("show_name"), F.to_json(hits).alias("payload"))
    return S.read_search_flat(found)


def search_paged(spark: SparkSession, d: str) -> DataFrame:
    """Catalog B hits: no document, an empty list, or two hits of which the first counts."""
    o = landed(table(spark, d, "orders").select("o_orderkey", "o_custkey"))
    series = (F.col("o_orderkey") * 11 + 5) % 2000
    status = F.when(F.col("o_custkey") % 2 == 0, '{"name":"Ended"}').otherwise('"Continuing"')
    tv_id = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(text('"tvdb_id":"', series, '",'))
    name = F.when(F.col("o_orderkey") % 7 == 0, '"translations":{"eng":"Eng"}').otherwise(text('"name":"B', series, '"'))
    doc = text('{"data":[{', tv_id, '"id":"', series, '",', name, ',"status":', status, '},{"id":"1"}]}')
    payload = F.when(F.col("o_orderkey") % 13 == 0, '{"data":[]}').when(F.col("o_orderkey") % 17 != 0, doc)
    return S.read_search_paged(o.select(text("order ", F.col("o_orderkey")).alias("show_name"), payload.alias("payload")))


SEARCH_FLAT_SQL = """
  SELECT 'order ' || o_orderkey AS show_name, i + 1 AS rank, (o_orderkey * 7 + i * 131) % 2000 AS id,
         'P' || ((o_orderkey * 7 + i * 131) % 2000) AS title,
         CASE WHEN (o_orderkey + i) % 6 = 0 THEN 'In Development' WHEN (o_orderkey + i) % 6 > 1 THEN 'Running' END AS status
  FROM (SELECT o_orderkey, unnest(range(0, o_custkey % 8)) AS i FROM orders)
"""
SEARCH_PAGED_SQL = f"""
  SELECT 'order ' || o_orderkey AS show_name, 1::BIGINT AS rank, (o_orderkey * 11 + 5) % 2000 AS id,
         CASE WHEN o_orderkey % 7 = 0 THEN 'Eng' ELSE 'B' || ((o_orderkey * 11 + 5) % 2000) END AS title,
         CASE WHEN o_custkey % 2 = 0 THEN 'Ended' ELSE 'Continuing' END AS status
  FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0
"""


# ---- orders as shows, both catalogs ------------------------------------------


def order_local(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter("l_returnflag <> 'R'").select(
        text("order ", F.col("l_orderkey")).alias("show_name"),
        F.col("l_linenumber").alias("season"),
        F.when(F.col("l_quantity") == 49, 0).otherwise(F.col("l_quantity")).cast("int").alias("episode"),
        text("/tv/order ", F.col("l_orderkey"), "/S", F.col("l_linenumber"), "/", F.col("l_partkey"), ".mkv").alias("path"),
    )


def pick_candidate(spark, d):
    aired = R.aired_count(S.read_catalogs(flat_payloads(spark, d)), AS_OF)
    return R.pick_candidate(search_flat(spark, d), aired, R.local_episode_count(order_local(spark, d)))


BOTH_WITH_SQL = f"""WITH
  local AS (SELECT 'order ' || l_orderkey AS show_name, l_linenumber AS season,
                   CASE WHEN l_quantity = 49 THEN 0 ELSE l_quantity::INT END AS episode,
                   '/tv/order ' || l_orderkey || '/S' || l_linenumber || '/' || l_partkey || '.mkv' AS path
            FROM lineitem WHERE l_returnflag <> 'R'),
  flat AS ({FLAT_SQL}), paged AS ({PAGED_SQL}), hits_a AS ({SEARCH_FLAT_SQL}), hits_b AS ({SEARCH_PAGED_SQL}),
  aired AS (SELECT series_id, count(*) FILTER (WHERE {AIRED_SQL}) AS aired
            FROM (SELECT DISTINCT l_partkey AS series_id FROM lineitem) LEFT JOIN flat USING (series_id) GROUP BY 1),
  counts AS (SELECT show_name, count(*) FILTER (WHERE episode <> 0) AS local_count FROM local GROUP BY 1),
  placed AS (SELECT *, row_number() OVER (PARTITION BY show_name ORDER BY rank) AS place
             FROM hits_a WHERE coalesce(status, '') <> 'In Development'),
  first_a AS (
    SELECT show_name, rank, id, title, status FROM (
      SELECT p.*, row_number() OVER (PARTITION BY show_name ORDER BY
               CASE WHEN coalesce(local_count, 0) > 0 THEN coalesce(abs(aired - local_count), 4611686018427387904) ELSE 0 END,
               place) AS best
      FROM placed p LEFT JOIN aired ON series_id = id LEFT JOIN counts USING (show_name) WHERE place <= 5)
    WHERE best = 1)
"""

SHOW_SQL = f"""
  remote_a AS (SELECT c.show_name, f.season, f.episode, f.name, f.airdate FROM flat f JOIN first_a c ON c.id = f.series_id),
  remote_b AS (SELECT c.show_name, f.season, f.episode, f.name, f.airdate FROM paged f JOIN hits_b c ON c.id = f.series_id),
  score AS (
    SELECT l.show_name, count(*) AS local_episodes,
           coalesce(count(*) FILTER (WHERE l.episode <> 0 AND a.episode IS NOT NULL)
                    / nullif(count(*) FILTER (WHERE l.episode <> 0), 0)::DOUBLE, 0) AS sa,
           coalesce(count(*) FILTER (WHERE l.episode <> 0 AND b.episode IS NOT NULL)
                    / nullif(count(*) FILTER (WHERE l.episode <> 0), 0)::DOUBLE, 0) AS sb
    FROM local l
    LEFT JOIN (SELECT DISTINCT show_name, season, episode FROM remote_a WHERE {AIRED_SQL}) a ON {SAME_SQL.format('a', 'l')}
    LEFT JOIN (SELECT DISTINCT show_name, season, episode FROM remote_b WHERE {AIRED_SQL}) b ON {SAME_SQL.format('b', 'l')}
    GROUP BY l.show_name),
  sized AS (
    SELECT s.*, coalesce(na.n, 0) AS n_a, coalesce(nb.n, 0) AS n_b,
           CASE WHEN sb >= sa AND coalesce(nb.n, 0) > 0 THEN 'b' WHEN coalesce(na.n, 0) > 0 THEN 'a' END AS chosen
    FROM score s LEFT JOIN (SELECT show_name, count(*) AS n FROM remote_a GROUP BY 1) na USING (show_name)
                 LEFT JOIN (SELECT show_name, count(*) AS n FROM remote_b GROUP BY 1) nb USING (show_name)),
  remote AS (SELECT r.* FROM remote_a r JOIN sized s USING (show_name) WHERE chosen = 'a'
             UNION ALL SELECT r.* FROM remote_b r JOIN sized s USING (show_name) WHERE chosen = 'b'),
  lacking AS (SELECT r.* FROM remote r WHERE {AIRED_SQL} AND NOT EXISTS (
                SELECT 1 FROM local l WHERE l.episode <> 0 AND {SAME_SQL.format('l', 'r')})),
  beyond AS (SELECT l.* FROM local l JOIN sized USING (show_name) WHERE chosen IS NOT NULL AND l.episode <> 0
             AND NOT EXISTS (SELECT 1 FROM remote r WHERE {SAME_SQL.format('l', 'r')})),
  reports AS (
    SELECT s.show_name,
           CASE chosen WHEN 'b' THEN b.title WHEN 'a' THEN a.title END AS matched_title,
           CASE WHEN chosen IS NOT NULL THEN a.id END AS tvmaze_id,
           CASE chosen WHEN 'b' THEN b.status WHEN 'a' THEN coalesce(a.status, 'Unknown') END AS status,
           CASE chosen WHEN 'b' THEN 'thetvdb' WHEN 'a' THEN 'tvmaze' ELSE 'both' END AS source_used,
           local_episodes, CASE chosen WHEN 'b' THEN n_b WHEN 'a' THEN n_a ELSE 0 END AS remote_episodes,
           CASE WHEN chosen IS NULL THEN 'No match found on TVmaze or TheTVDB' END AS lookup_error,
           coalesce(m.n, 0) AS missing_count, coalesce(e.n, 0) AS extra_count,
           chosen IS NOT NULL AND coalesce(m.n, 0) = 0 AS ok
    FROM sized s LEFT JOIN first_a a USING (show_name) LEFT JOIN hits_b b USING (show_name)
    LEFT JOIN (SELECT show_name, count(*) AS n FROM lacking GROUP BY 1) m USING (show_name)
    LEFT JOIN (SELECT show_name, count(*) AS n FROM beyond GROUP BY 1) e USING (show_name))
"""


def both_result(spark: SparkSession, d: str) -> Reconciled:
    return reconcile_both(
        order_local(spark, d),
        search_flat(spark, d), S.read_catalogs(flat_payloads(spark, d)),
        search_paged(spark, d), S.read_catalog_paged(paged_payloads(spark, d)),
        AS_OF,
    )


def reconcile(spark, d):
    return both_result(spark, d).reports


def reconcile_totals(spark, d):
    return R.reconcile_totals(both_result(spark, d).reports)


def reconcile_csv(spark, d):
    return reconcile_csv_rows(R.only_issues(both_result(spark, d).reports))


def reconcile_single(spark, d):
    """Each catalog alone, with its own two error rows."""
    local = order_local(spark, d)
    flat = flat_payloads(spark, d)
    a = reconcile_one(local, search_flat(spark, d), S.read_catalogs(flat), AS_OF, "tvmaze")
    b = reconcile_one(local, search_paged(spark, d), S.read_catalog_paged(paged_payloads(spark, d)), AS_OF, "thetvdb")
    return a.reports.unionByName(b.reports)


def _single_sql(hits: str, remote: str, source: str, label: str, title: str, status: str, maze: str) -> str:
    return f"""
      SELECT c.show_name, {title} AS matched_title, {maze} AS tvmaze_id, {status} AS status, '{source}' AS source_used,
             c.n AS local_episodes, coalesce(r.n, 0) AS remote_episodes,
             CASE WHEN h.show_name IS NULL THEN 'No {label} match found'
                  WHEN r.n IS NULL THEN 'No episodes found on {label}' END AS lookup_error,
             coalesce(m.n, 0) AS missing_count, coalesce(e.n, 0) AS extra_count,
             r.n IS NOT NULL AND coalesce(m.n, 0) = 0 AS ok
      FROM (SELECT show_name, count(*) AS n FROM local GROUP BY 1) c
      LEFT JOIN {hits} h USING (show_name)
      LEFT JOIN (SELECT show_name, count(*) AS n FROM {remote} GROUP BY 1) r USING (show_name)
      LEFT JOIN (SELECT show_name, count(*) AS n FROM {remote} r WHERE {AIRED_SQL} AND NOT EXISTS (
          SELECT 1 FROM local l WHERE l.episode <> 0 AND {SAME_SQL.format('l', 'r')}) GROUP BY 1) m USING (show_name)
      LEFT JOIN (SELECT show_name, count(*) AS n FROM local l WHERE l.episode <> 0 AND NOT EXISTS (
          SELECT 1 FROM {remote} r WHERE {SAME_SQL.format('l', 'r')})
          AND l.show_name IN (SELECT show_name FROM {remote}) GROUP BY 1) e USING (show_name)"""


SINGLE_SQL = (
    f"{BOTH_WITH_SQL}, {SHOW_SQL}"
    + _single_sql("first_a", "remote_a", "tvmaze", "TVmaze", "h.title",
                  "CASE WHEN h.show_name IS NOT NULL AND r.n IS NOT NULL THEN coalesce(h.status, 'Unknown') ELSE h.status END", "h.id")
    + " UNION ALL "
    + _single_sql("hits_b", "remote_b", "thetvdb", "TheTVDB", "h.title", "CASE WHEN r.n IS NOT NULL THEN h.status END", "NULL::BIGINT")
)


def reconcile_json(spark, d):
    rows = reconcile_json_rows(both_result(spark, d))
    entry = lambda x: E.season_ep_label(x.season, x.episode)
    return rows.select(
        "show_name", "part", "ok", "local_episode_count", "remote_episode_count",
        F.array_join(F.array_sort(F.transform("missing", lambda x: F.concat(entry(x), x["name"], x["airdate"]))), ",").alias("missing"),
        F.array_join(F.array_sort(F.transform("extra", lambda x: F.concat(entry(x), x["path"]))), ",").alias("extra"),
    )


JSON_SQL = f"""{BOTH_WITH_SQL}, {SHOW_SQL}
  SELECT show_name, 0::BIGINT AS part, ok, local_episodes AS local_episode_count, remote_episodes AS remote_episode_count,
         coalesce(m.t, '') AS missing, coalesce(e.t, '') AS extra
  FROM reports
  LEFT JOIN (SELECT show_name, string_agg(t, ',' ORDER BY t) AS t FROM (
      SELECT show_name, printf('S%02dE%02d', season, episode) || name || airdate AS t FROM lacking) GROUP BY 1) m USING (show_name)
  LEFT JOIN (SELECT show_name, string_agg(t, ',' ORDER BY t) AS t FROM (
      SELECT show_name, printf('S%02dE%02d', season, episode) || path AS t FROM beyond) GROUP BY 1) e USING (show_name)
"""


def reconcile_text(spark, d):
    return reconcile_text_lines(both_result(spark, d))


TEXT_SQL = f"""{BOTH_WITH_SQL}, {SHOW_SQL}
  SELECT unnest(['TV Library Report — ' || count(*) || ' shows scanned', repeat('─', 60),
                 '  ✓ Complete:  ' || count(*) FILTER (WHERE ok), '  ✗ Issues:    ' || count(*) FILTER (WHERE NOT ok), ''])
         AS value FROM reports
  UNION ALL
  SELECT unnest([
    '► ' || show_name || CASE WHEN matched_title IS NOT NULL THEN '  [' || upper(source_used) || ': ' || matched_title || ']' ELSE '' END
         || CASE WHEN status <> '' THEN '  (' || status || ')' ELSE '' END,
    CASE WHEN lookup_error IS NOT NULL THEN '    ⚠ ' || lookup_error
         ELSE '    Local: ' || local_episodes || ' episodes  |  ' || upper(source_used) || ' (aired): ' || remote_episodes || ' episodes' END,
    '']) FROM reports
  UNION ALL
  SELECT '    ✓ All aired episodes present' FROM reports WHERE lookup_error IS NULL AND missing_count = 0 AND extra_count = 0
  UNION ALL
  SELECT CASE WHEN whole THEN '    ✗ Season ' || printf('%02d', season) || ' entirely missing (' || n || ' episode'
                              || CASE WHEN n <> 1 THEN 's' ELSE '' END || ')'
              ELSE '    ✗ Missing S' || printf('%02d', season) || ': ' || labels END
  FROM (SELECT season, count(*) AS n, string_agg(printf('S%02dE%02d', season, episode), ', ' ORDER BY episode) AS labels,
               NOT EXISTS (SELECT 1 FROM local l WHERE l.episode <> 0 AND l.show_name = g.show_name AND l.season = g.season) AS whole
        FROM lacking g GROUP BY show_name, season)
  UNION ALL
  SELECT '    ? Extra (not in ' || upper(source_used) || '): ' || labels
  FROM (SELECT show_name, string_agg(printf('S%02dE%02d', season, episode), ', ' ORDER BY season, episode) AS labels
        FROM beyond GROUP BY 1) JOIN reports USING (show_name)
"""

QUERIES = {
    "q_missing": (missing, f"{WITH_SQL} {MISSING_SQL}"),
    "q_extra": (extra, f"""WITH remote AS (SELECT * FROM ({REMOTE_SQL}) WHERE ordinal % 2 = 1),
      local AS ({LOCAL_SQL}) {EXTRA_SQL}"""),
    "q_named_gaps": (named_gaps, f"""{WITH_SQL}, gaps AS ({MISSING_SQL}),
      last AS (SELECT show_name, season, episode, arg_max(name, (ordinal, name, airdate)) AS name,
                      arg_max(airdate, (ordinal, name, airdate)) AS airdate FROM remote GROUP BY ALL)
      SELECT show_name, season, episode, last.name, last.airdate
      FROM gaps JOIN last USING (show_name, season, episode)"""),
    "q_match_score": (match_score, f"{WITH_SQL} {MATCH_SQL}"),
    "q_matched_rows": (matched_rows, f"""{WITH_SQL} SELECT * FROM local l WHERE episode <> 0 AND EXISTS (
      SELECT 1 FROM remote r WHERE ordinal % 2 = 1 AND {AIRED_SQL} AND {SAME_SQL.format('l', 'r')})"""),
    "q_choose_catalog": (choose_catalog, CHOOSE_SQL),
    "q_missing_by_season": (missing_by_season, MISSING_BY_SEASON_SQL),
    "q_season_sets": (season_sets, f"{WITH_SQL} SELECT DISTINCT show_name, season FROM local WHERE episode <> 0"),
    "q_season_files": (season_files, SEASON_FILES_SQL),
    "q_local_counts": (local_counts, f"""{WITH_SQL}
      SELECT show_name, count(*) FILTER (WHERE episode <> 0) AS local_count FROM local GROUP BY 1"""),
    "q_aired_counts": (aired_counts, f"""{WITH_SQL}
      SELECT show_name, count(*) FILTER (WHERE {AIRED_SQL}) AS aired FROM remote GROUP BY 1"""),
    "q_parse_names": (parse_names, PARSE_NAMES_SQL),
    "q_scan_library": (scan_library, SCAN_SQL),
    "q_catalog_flat": (catalog_flat, FLAT_SQL),
    "q_catalog_paged": (catalog_paged, PAGED_SQL),
    "q_pages_prefix": (pages_prefix, PAGES_SQL),
    "q_search_flat": (search_flat, SEARCH_FLAT_SQL),
    "q_search_paged": (search_paged, SEARCH_PAGED_SQL),
    "q_pick_candidate": (pick_candidate, f"{BOTH_WITH_SQL} SELECT * FROM first_a"),
    "q_reconcile": (reconcile, f"{BOTH_WITH_SQL}, {SHOW_SQL} SELECT * FROM reports"),
    "q_reconcile_single": (reconcile_single, SINGLE_SQL),
    "q_reconcile_totals": (reconcile_totals, f"""{BOTH_WITH_SQL}, {SHOW_SQL}
      SELECT count(*) AS shows, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS issues,
             sum(local_episodes)::BIGINT AS local, sum(missing_count)::BIGINT AS missing FROM reports"""),
    "q_reconcile_csv": (reconcile_csv, f"""{BOTH_WITH_SQL}, {SHOW_SQL}
      SELECT show_name, coalesce(matched_title, '') AS matched_title,
             coalesce(CASE WHEN tvmaze_id <> 0 THEN tvmaze_id::VARCHAR END, '') AS tvmaze_id,
             coalesce(status, '') AS status, source_used, local_episodes, remote_episodes, missing_count,
             CASE WHEN ok THEN 'True' ELSE 'False' END AS ok, coalesce(lookup_error, '') AS error
      FROM reports WHERE NOT ok"""),
    "q_reconcile_json": (reconcile_json, JSON_SQL),
    "q_reconcile_text": (reconcile_text, TEXT_SQL),
}
