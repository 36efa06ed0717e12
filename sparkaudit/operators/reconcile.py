"""Episode reconcile operators: two-way differences, match scores, catalog choice, per-season reports.

Local rows: show_name, season, episode (0 = unparsed), path.
Remote rows: show_name, ordinal, season, episode, name, airdate.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkaudit.functions.episodes import is_aired, season_ep_label

SHOW = "show_name"
KEYS = [SHOW, "season", "episode"]
CANDIDATES_COUNTED = 5
LABELS_PER_BLOCK = 1000
PATHS_LISTED = 6


def parsed(local: DataFrame) -> DataFrame:
    return local.filter(F.col("episode") != 0)


def _distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def missing_from_local(
    remote: DataFrame, local: DataFrame, as_of: str | Column, keys: Sequence[str] = KEYS, only_aired: bool = True
) -> DataFrame:
    """Aired remote rows without a local file; repeated remote rows stay repeated."""
    aired = remote.filter(is_aired(F.col("airdate"), as_of, only_aired))
    return aired.join(_distinct_keys(parsed(local), keys), list(keys), "left_anti")


def extra_in_local(local: DataFrame, remote: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Parsed local rows the catalog does not list at all, aired or not; repeated files stay repeated."""
    return parsed(local).join(_distinct_keys(remote, keys), list(keys), "left_anti")


def local_episode_count(local: DataFrame, by: Sequence[str] = (SHOW,)) -> DataFrame:
    """Parsed entries per show, not distinct."""
    return local.groupBy(*by).agg(F.count_if(F.col("episode") != 0).alias("local_count"))


def aired_count(
    remote: DataFrame, as_of: str | Column, by: Sequence[str] = ("series_id",), landed: DataFrame | None = None
) -> DataFrame:
    """Aired episodes per series.  ``landed`` names the series whose catalog was fetched: those without a row have 0.

    So do series that ``remote`` has in a row without an episode only.
    """
    by = list(by)
    rows = remote.select(*by, F.coalesce(is_aired(F.col("airdate"), as_of), F.lit(False)).alias("_aired"))
    if landed is not None:
        rows = rows.unionByName(landed.select(*by, F.lit(False).alias("_aired")))
    return rows.groupBy(*by).agg(F.count_if("_aired").alias("aired"))


def match_scores(
    local: DataFrame, remote: DataFrame, as_of: str | Column, show: str = SHOW
) -> DataFrame:
    """Per show of the local table: known, matched, n_remote and score = matched / known.

    Local and remote rows are counted together per (show, season, episode), so the match
    needs no join: one shuffle of partly summed rows, then a small one per show.
    """
    keys = [show, "season", "episode"]
    aired = is_aired(F.col("airdate"), as_of)
    both = local.select(*keys, F.lit(1).alias("_file"), F.lit(0).alias("_hit")).unionByName(
        remote.select(*keys, F.lit(0).alias("_file"), aired.cast("int").alias("_hit"))
    )
    per_key = both.groupBy(*keys).agg(
        F.sum("_file").alias("_files"),
        F.count_if(F.col("_file") == 0).alias("_listed"),
        F.max("_hit").alias("_hit"),
    )
    known = F.when(F.col("episode") != 0, F.col("_files")).otherwise(0)
    per_show = per_key.groupBy(show).agg(
        F.sum("_files").alias("_files"),
        F.sum(known).alias("known"),
        F.sum(known * F.col("_hit")).alias("matched"),
        F.sum("_listed").alias("n_remote"),
    )
    score = score_of(F.col("matched"), F.col("known"))
    return per_show.filter(F.col("_files") > 0).select(show, "known", "matched", "n_remote", score.alias("score"))


def listed_keys(catalog: DataFrame, as_of: str | Column) -> DataFrame:
    """How often each series lists an episode, and in how many aired rows: (series_id, season, episode, listed, aired)."""
    aired = F.count_if(is_aired(F.col("airdate"), as_of))
    return catalog.groupBy("series_id", "season", "episode").agg(F.count(F.lit(1)).alias("listed"), aired.alias("aired"))


def show_stats(
    local: DataFrame, candidates: dict[str, DataFrame], listed: dict[str, DataFrame], show: str = SHOW
) -> DataFrame:
    """All that reports count, per show of the local table, for any number of catalogs.

    ``candidates``: per catalog (show, series_id); ``listed``: per catalog what ``listed_keys`` gives.
    local_episodes, known (parsed files), keys (their distinct episodes); and for each catalog x: matched_x (parsed files
    that an aired row lists), n_x (rows), missing_x (aired rows without a file, repeats counted) and extra_x (parsed files
    that no row lists).  Sums of a whole series meet a show once; only the show's own episodes are looked up one by one,
    so the rows of a series are not repeated for each show that chose it.
    """
    keys = [show, "season", "episode"]
    label = lambda x, df: df.withColumn("_x", F.lit(x))
    picks = union(label(x, c.select(F.col(show).alias("_show"), "series_id")) for x, c in candidates.items())
    lists = union(
        label(x, df.select("series_id", F.col("season").alias("_season"), F.col("episode").alias("_episode"), "listed", "aired"))
        for x, df in listed.items()
    )
    per_show = local.groupBy(show).agg(F.count(F.lit(1)).alias("local_episodes"), F.count_if(F.col("episode") != 0).alias("known"))
    own = parsed(local).groupBy(*keys).agg(F.count(F.lit(1)).alias("_files"))
    met = (
        own.join(picks, F.col(show).eqNullSafe(F.col("_show")))
        .join(lists, ["_x", "series_id"])
        .filter(F.col("season").eqNullSafe(F.col("_season")) & (F.col("episode") == F.col("_episode")))
    )
    per_key = met.groupBy(*keys, "_files", "_x").agg(F.sum("listed").alias("listed"), F.sum("aired").alias("aired"))
    sizes = lists.groupBy("_x", "series_id").agg(F.sum("listed").alias("listed"), F.sum("aired").alias("aired"))
    of = lambda x, value, where=True: F.sum(F.when((F.col("_x") == x) & where, value).otherwise(0))
    files, aired, rows = F.col("_files"), F.col("aired"), F.col("listed")
    found = per_key.groupBy(F.col(show).alias("_met")).agg(*[
        c for x in candidates
        for c in (of(x, files, aired > 0).alias(f"_m_{x}"), of(x, aired).alias(f"_f_{x}"), of(x, files).alias(f"_l_{x}"))
    ])
    whole = picks.join(sizes, ["_x", "series_id"]).groupBy(F.col("_show").alias("_whole")).agg(*[
        c for x in candidates for c in (of(x, rows).alias(f"_n_{x}"), of(x, aired).alias(f"_a_{x}"))
    ])
    distinct = own.groupBy(F.col(show).alias("_own")).agg(F.count(F.lit(1)).alias("_keys"))
    joined = per_show
    for other, name in ((distinct, "_own"), (found, "_met"), (whole, "_whole")):
        joined = joined.join(other, F.col(show).eqNullSafe(F.col(name)), "left")
    count = lambda name: F.coalesce(name, F.lit(0))
    counts = [
        c for x in candidates
        for c in (
            count(f"_m_{x}").alias(f"matched_{x}"), count(f"_n_{x}").alias(f"n_{x}"),
            (count(f"_a_{x}") - count(f"_f_{x}")).alias(f"missing_{x}"), (F.col("known") - count(f"_l_{x}")).alias(f"extra_{x}"),
        )
    ]
    return joined.select(show, "local_episodes", "known", count("_keys").alias("keys"), *counts)


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def score_of(matched: Column, known: Column) -> Column:
    return F.coalesce(F.try_divide(matched, known), F.lit(0.0))


def match_local_remote(
    local: DataFrame, remote: DataFrame, as_of: str | Column, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Parsed local rows that an aired remote row lists."""
    aired = remote.filter(is_aired(F.col("airdate"), as_of))
    return parsed(local).join(_distinct_keys(aired, keys), list(keys), "left_semi")


def attach_names(rows: DataFrame, remote: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join of the remote name and airdate; the last listed of repeated keys wins."""
    keys = list(keys)
    last = remote.groupBy(*keys).agg(F.max_by(F.struct("name", "airdate"), F.struct("ordinal", "name", "airdate")).alias("_r"))
    return rows.drop("name", "airdate").join(last, keys, "left").select(
        *[c for c in rows.columns if c not in ("name", "airdate")], "_r.name", "_r.airdate"
    )


def choose_catalog(scores_a: DataFrame, scores_b: DataFrame, key: str = SHOW) -> DataFrame:
    """Per show ``chosen``: b when it scores at least as well and lists episodes, else a, else null."""
    a = scores_a.select(key, F.col("score").alias("score_a"), F.col("n_remote").alias("n_a"))
    b = scores_b.select(key, F.col("score").alias("score_b"), F.col("n_remote").alias("n_b"))
    zero = {"score_a": 0.0, "n_a": 0, "score_b": 0.0, "n_b": 0}
    chosen = F.when((F.col("score_b") >= F.col("score_a")) & (F.col("n_b") > 0), "b").when(F.col("n_a") > 0, "a")
    return a.join(b, key, "full_outer").fillna(zero).withColumn("chosen", chosen)


def pick_candidate(hits: DataFrame, aired: DataFrame, local_counts: DataFrame, show: str = SHOW) -> DataFrame:
    """One hit per show: the nearest aired count among the first five, earliest on ties.

    ``hits``: show, rank, id, title, status; ``aired``: series_id, aired; ``local_counts``: show, local_count.
    A show without parsed local episodes takes its first hit, as does one whose counts are all unknown.
    A series that landed without episodes counts 0; only one that never landed is unknown.
    """
    return nearest_candidate(first_candidates(hits, show), aired, local_counts, show)


def first_candidates(hits: DataFrame, show: str = SHOW) -> DataFrame:
    """The first five hits of each show that are not in development, with their ``_place``.

    The five-row limit per show is pushed below the shuffle as a group limit.
    """
    live = hits.filter(F.coalesce("status", F.lit("")) != "In Development")
    return live.withColumn("_place", F.row_number().over(W.partitionBy(show).orderBy("rank"))).filter(
        F.col("_place") <= CANDIDATES_COUNTED
    )


def nearest_candidate(first: DataFrame, aired: DataFrame, local_counts: DataFrame, show: str = SHOW) -> DataFrame:
    """Of the hits that ``first_candidates`` keeps, the one ``pick_candidate`` names."""
    compared = first.join(aired.withColumnRenamed("series_id", "id"), "id", "left").join(local_counts, show, "left")
    known = F.coalesce("local_count", F.lit(0))
    distance = F.when(known > 0, F.coalesce(F.abs(F.col("aired") - known), F.lit(1 << 62))).otherwise(0)
    fields = [c for c in first.columns if c not in (show, "_place")]
    return (
        compared.groupBy(show)
        .agg(F.min_by(F.struct(*fields), F.struct(distance, F.col("_place"))).alias("_c"))
        .select(show, "_c.*")
    )


def season_sets(local: DataFrame, parsed_only: bool = False) -> DataFrame:
    """Distinct (show, season), with or without the seasons of unparsed files."""
    return (parsed(local) if parsed_only else local).select(SHOW, "season").distinct()


def repeated(label: Column, copies: Column) -> Column:
    """A label once per copy, however many there are."""
    return F.array_repeat(label, copies.cast("int"))


def missing_by_season(missing: DataFrame, local: DataFrame) -> DataFrame:
    """Per (show, season): n_missing, entirely_missing, and the labels in episode order.

    Labels come in blocks of a thousand episode numbers, each label once with its
    number of copies, so no group grows with the table; a usual season is block 0 only.
    """
    per_episode = missing.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"))
    block = F.floor(F.col("episode") / LABELS_PER_BLOCK).alias("block")
    entry = F.struct(
        "episode", season_ep_label(F.col("season"), F.col("episode")).alias("label"), "copies"
    )
    blocks = per_episode.groupBy(SHOW, "season", block).agg(
        F.sum("copies").alias("_n"), F.array_sort(F.collect_list(entry)).alias("labels")
    )
    season = W.partitionBy(SHOW, "season")
    counted = (
        blocks.withColumn("n_missing", F.sum("_n").over(season))
        .withColumn("first_block", F.col("block") == F.min("block").over(season))
        .drop("_n")
    )
    present = season_sets(local, parsed_only=True).withColumn("_present", F.lit(True))
    return counted.join(present, [SHOW, "season"], "left").select(
        SHOW, "season", "block", "first_block", "n_missing", F.col("_present").isNull().alias("entirely_missing"), "labels"
    )


def label_list(labels: Column) -> Column:
    return F.array_join(F.flatten(F.transform(labels, lambda e: repeated(e.label, e.copies))), ", ")


def season_file_list(local: DataFrame, listed: int = PATHS_LISTED) -> DataFrame:
    """Per (show, season): episode rows, distinct paths, the first few paths and how many more there are."""
    files = parsed(local).groupBy(SHOW, "season", "path").agg(F.count(F.lit(1)).alias("_n"))
    sizes = files.groupBy(SHOW, "season").agg(
        F.sum("_n").alias("episodes"), F.count(F.lit(1)).alias("distinct_paths")
    )
    place = F.row_number().over(W.partitionBy(SHOW, "season").orderBy("path"))
    first = files.withColumn("_place", place).filter(F.col("_place") <= listed)
    paths = first.groupBy(SHOW, "season").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return sizes.join(paths, [SHOW, "season"]).withColumn(
        "more", F.greatest(F.col("distinct_paths") - listed, F.lit(0))
    )


def reconcile_totals(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count(F.lit(1)).alias("shows"),
        F.count_if("ok").alias("ok"),
        F.count_if(~F.col("ok")).alias("issues"),
        F.coalesce(F.sum("local_episodes"), F.lit(0)).alias("local"),
        F.coalesce(F.sum("missing_count"), F.lit(0)).alias("missing"),
    )


def only_issues(reports: DataFrame) -> DataFrame:
    return reports.filter(~F.col("ok"))


def show_order(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.lower(SHOW), SHOW)
