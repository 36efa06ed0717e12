"""Sources of the episode reconcile: file hierarchies, landed catalog payloads, landed search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions.episodes import EPISODE_EXTENSIONS, PAIRS, episodes_of, season_of, status_text
from sparkaudit.functions.media import has_extension
from sparkaudit.landing import landed
from sparkaudit.operators.pages import contiguous_pages

FLAT_EPISODE = "struct<season:int,number:int,name:string,airdate:string,type:string>"
PAGE = (
    "struct<data:struct<episodes:array<struct<seasonNumber:int,number:int,name:string,aired:string>>>,"
    "links:struct<next:string>>"
)
FLAT_HITS = "array<struct<show:struct<id:bigint,name:string,status:string>>>"
PAGED_HITS = (
    "struct<data:array<struct<tvdb_id:string,id:string,name:string,"
    "translations:struct<eng:string>,status:string>>>"
)


def scan_show_library(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """``root/show/season/file`` paths to (show_name, season, episode, path), one row per episode.

    Episode 0 marks a file whose name gives no number; only then is the folder's season used.
    """
    prefix = root.rstrip("/") + "/"
    parts = F.split(F.substring(F.col(path), len(prefix) + 1, 1 << 30), "/")
    placed = (
        files.filter(F.col(path).startswith(prefix))
        .select(F.col(path).alias("path"), parts.alias("_parts"))
        .filter(F.size("_parts") == 3)
        .select("path", *[F.element_at("_parts", i + 1).alias(n) for i, n in enumerate(("show_name", "_dir", "_file"))])
    )
    kept = placed.filter(
        ~F.col("show_name").startswith(".")
        & ~F.col("_file").startswith("._")
        & has_extension(F.col("_file"), EPISODE_EXTENSIONS)
    ).withColumn("_season", season_of(F.col("_dir"))).filter(F.col("_season").isNotNull())
    found = episodes_of(F.col("_file"))
    unparsed = F.array(F.struct(F.col("_season").alias("season"), F.lit(0).alias("episode"))).cast(PAIRS)
    return (
        kept.withColumn("_found", found)
        .select(
            "show_name", "path",
            F.inline(F.when(F.size("_found") > 0, F.col("_found")).otherwise(unparsed)),
        )
        .select("show_name", "season", "episode", "path")
    )


def read_catalog_flat(payloads: DataFrame, by: str = "series_id", payload: str = "payload") -> DataFrame:
    """Landed one-document catalogs to (series_id, ordinal, season, episode, name, airdate).

    A missing type counts as regular, any other value (an explicit null too) does not.
    """
    return read_catalogs(payloads, by, payload).filter("ordinal IS NOT NULL")


def read_catalogs(payloads: DataFrame, by: str = "series_id", payload: str = "payload") -> DataFrame:
    """As ``read_catalog_flat``, with one more row for each landed list: its ordinal and all fields are null.

    A payload is parsed once for both, its episodes and whether it landed at all.
    """
    parsed = payloads.select(F.col(by).alias("series_id"), F.from_json(F.col(payload), "array<string>").alias("_list"))
    marked = F.concat(F.array(F.lit(None).cast("string")), F.col("_list"))
    raw = parsed.select("series_id", F.posexplode(marked).alias("_at", "_raw")).withColumn("e", F.from_json("_raw", FLAT_EPISODE))
    has_type = F.array_contains(F.json_object_keys("_raw"), "type")
    regular = F.when(F.col("e.type").isNull(), ~has_type).otherwise(F.col("e.type") == "regular")
    mark = F.col("_at") == 0
    kept = raw.filter(mark | (regular & (F.col("e.season") != 0) & (F.col("e.number") != 0)))
    text = lambda c: F.when(~mark, F.coalesce(c, F.lit("")))
    return kept.select(
        "series_id", F.when(~mark, F.col("_at").cast("bigint") - 1).alias("ordinal"),
        F.col("e.season").alias("season"), F.col("e.number").alias("episode"),
        text("e.name").alias("name"), text("e.airdate").alias("airdate"),
    )


def landed_catalogs(payloads: DataFrame, by: str = "series_id", payload: str = "payload") -> DataFrame:
    """The series whose one-document catalog landed as a list, an empty one or one of specials too."""
    return payloads.filter(F.from_json(F.col(payload), "array<string>").isNotNull()).select(F.col(by).alias("series_id")).distinct()


def read_catalog_paged(
    pages: DataFrame, by: str = "series_id", page: str = "page", payload: str = "payload"
) -> DataFrame:
    """Landed catalog pages to episode rows, walking pages 0, 1, … while each names a next one."""
    parsed = pages.select(
        F.col(by).alias("series_id"),
        F.col(page).cast("bigint").alias("page"),
        F.inline(F.array(F.struct(F.from_json(F.col(payload), PAGE).alias("p")))),
        F.col(payload).isNotNull().alias("_landed"),
    )
    has_next = F.coalesce(~F.col("p.links.next").isin("", "0", "false"), F.lit(False))
    # The chains and the episodes read the pages: they are parsed once.
    judged = landed(parsed.select("*", (F.col("_landed") & F.col("p").isNotNull()).alias("_ok"), has_next.alias("_next")))
    read = contiguous_pages(judged, ["series_id"], "page", "_ok", "_next")
    episodes = read.select("series_id", "page", F.posexplode("p.data.episodes").alias("_pos", "e"))
    return episodes.filter((F.col("e.seasonNumber") != 0) & (F.col("e.number") != 0)).select(
        "series_id", (F.col("page") * F.lit(1 << 32) + F.col("_pos")).alias("ordinal"),
        F.col("e.seasonNumber").alias("season"), F.col("e.number").alias("episode"),
        F.coalesce("e.name", F.lit("")).alias("name"), F.coalesce("e.aired", F.lit("")).alias("airdate"),
    )


def read_search_flat(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Landed catalog-A hits, all of them: (show_name, rank, id, title, status)."""
    hits = payloads.select(
        "show_name", F.posexplode(F.from_json(F.col(payload), FLAT_HITS)).alias("_pos", "h")
    )
    return hits.select(
        "show_name", (F.col("_pos") + 1).cast("bigint").alias("rank"), F.col("h.show.id").alias("id"),
        F.col("h.show.name").alias("title"), F.col("h.show.status").alias("status"),
    )


def read_search_paged(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Landed catalog-B hits, the first of each show only."""
    first = F.try_element_at(F.from_json(F.col(payload), PAGED_HITS)["data"], F.lit(1))
    hits = payloads.select("show_name", F.inline(F.array(F.struct(first.alias("h"))))).filter(F.col("h").isNotNull())
    series = F.coalesce(F.nullif("h.tvdb_id", F.lit("")), F.col("h.id")).try_cast("bigint")
    return hits.select(
        "show_name", F.lit(1).cast("bigint").alias("rank"), series.alias("id"),
        F.coalesce(F.nullif("h.name", F.lit("")), F.col("h.translations.eng"), F.col("show_name")).alias("title"),
        status_text(F.col("h.status")).alias("status"),
    )
