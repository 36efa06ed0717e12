"""The whole reconcile as one plan over all shows, keyed by show name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.functions.episodes import is_aired, report_ok, season_ep_label
from sparkaudit.functions.text import bind
from sparkaudit.landing import forget_landed, landed
from sparkaudit.operators import reconcile as R

# Catalog names and report texts.
CATALOG_A, CATALOG_B, BOTH = "tvmaze", "thetvdb", "both"
NO_MATCH = {
    CATALOG_A: "No TVmaze match found",
    CATALOG_B: "No TheTVDB match found",
    BOTH: "No match found on TVmaze or TheTVDB",
}
NO_EPISODES = {CATALOG_A: "No episodes found on TVmaze", CATALOG_B: "No episodes found on TheTVDB"}

SHOW = R.SHOW


#: A show of at most so many parsed files and listed rows is compared in one row; others by joins of rows.
FILES_IN_ROW, LISTED_IN_ROW = 1_000, 10_000


def _key(entry: Column | None = None) -> Column:
    """What files and listed rows are compared by; null without a season, as that equals none."""
    season, episode = (F.col(c) if entry is None else entry[c] for c in ("season", "episode"))
    return F.when(season.isNotNull(), F.struct(season.alias("season"), episode.alias("episode")))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """These columns too, worked out once a row: as plain columns they would be merged into list functions, once for each entry."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _has(values: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(values, value), F.lit(False))


@dataclass(frozen=True)
class Reconciled:
    """Reports (one row per show) and the long tables behind them.

    ``chosen`` has (show, series_id, source) of the catalog a report goes by, ``series`` the episodes of those
    series with their source, ``usable`` the shows whose files are compared at all.
    """

    reports: DataFrame
    missing: DataFrame
    extra: DataFrame
    remote: DataFrame
    local: DataFrame
    chosen: DataFrame
    series: DataFrame
    usable: DataFrame
    as_of: str
    folders: list[str] = field(default_factory=list)

    def in_rows(self, files_in_row: int = FILES_IN_ROW, listed_in_row: int = LISTED_IN_ROW) -> tuple[DataFrame, Reconciled]:
        """Shows of usual size compared in one row each, and the rest as tables of rows.

        First their reports with ``missing`` and ``extra``: lists of (season, episode, name, airdate) in catalog order and
        of (season, episode, path) in path order, and ``seasons`` that have files.  The rows of a series are read beside each
        such show and never shuffled for it.  Larger shows, those of several hits or reports and those whose series has a season
        without number or episodes of several blocks of labels are in the second alone, which has the other reports.
        """
        entry = F.struct("ordinal", "season", "episode", "name", "airdate", is_aired(F.col("airdate"), self.as_of).alias("aired"))
        met, rest = self._beside(
            F.array_sort(F.collect_list(F.struct("path", "season", "episode"))),
            lambda series: series.groupBy("source", "series_id").agg(
                F.array_sort(F.collect_list(entry)).alias("_listed"), F.collect_set(_key()).alias("_theirs")
            ),
            files_in_row, listed_in_row,
        )
        met = _once(met, _own=F.transform("_files", _key))
        lacking = F.filter("_listed", lambda x: x.aired & ~_has("_own", _key(x)))
        beyond = F.filter("_files", lambda x: ~_has("_theirs", _key(x)))
        return met.select(
            *self.reports.columns, F.array_distinct(F.transform("_files", lambda x: x.season)).alias("seasons"),
            F.transform(lacking, lambda x: F.struct(*[x[c].alias(c) for c in ("season", "episode", "name", "airdate")])).alias("missing"),
            F.transform(beyond, lambda x: F.struct(*[x[c].alias(c) for c in ("season", "episode", "path")])).alias("extra"),
        ), rest

    def labels_in_rows(self, files_in_row: int = FILES_IN_ROW, listed_in_row: int = LISTED_IN_ROW) -> tuple[DataFrame, Reconciled]:
        """The same split, with what a text names only: ``gaps`` and ``extra`` in place of the lists.

        ``gaps`` are (season, entirely, n, labels) in season order, their labels joined in episode order; ``extra`` is
        (season, episode) in that order.  The labels of a series are made once; they are looked through only for
        seasons that a show has listed files of.
        """
        label = season_ep_label(F.col("season"), F.col("episode"))
        listed = F.when(is_aired(F.col("airdate"), self.as_of), F.struct("episode", label.alias("label")))

        def joined(episodes: Column) -> Column:
            return F.array_join(F.transform(episodes, lambda e: e.label), ", ")

        def by_season(series: DataFrame) -> DataFrame:
            seasons = series.groupBy("source", "series_id", "season").agg(
                F.sort_array(F.collect_list(listed)).alias("episodes"), F.collect_set(_key()).alias("_keys")
            )
            whole = seasons.withColumns({"n": F.size("episodes"), "labels": joined(F.col("episodes"))})
            return whole.groupBy("source", "series_id").agg(
                F.sort_array(F.collect_list(F.struct("season", "episodes", "n", "labels"))).alias("_seasons"),
                F.flatten(F.collect_list("_keys")).alias("_theirs"),
            )

        met, rest = self._beside(F.sort_array(F.collect_list(F.struct("season", "episode"))), by_season, files_in_row, listed_in_row)
        place = lambda x: F.struct(x.season.alias("season"), x.episode.alias("episode"), _has("_theirs", _key(x)).alias("listed"))
        met = _once(
            met, _placed=F.transform("_files", place), _held=F.array_distinct(F.transform("_files", lambda x: x.season))
        )

        def gap(x: Column) -> Column:
            def lacking(n: Column, labels: Column) -> Column:
                return F.struct(x.season.alias("season"), (~_has("_held", x.season)).alias("entirely"), n.alias("n"), labels.alias("labels"))

            def beside(own: Column) -> Column:
                left = F.filter(x.episodes, lambda e: ~F.array_contains(own, e.episode))
                some = bind(left, lambda episodes: lacking(F.size(episodes), joined(episodes)))
                return F.when(F.size(own) == 0, lacking(x.n, x.labels)).otherwise(some)

            listed_files = F.filter("_placed", lambda f: f.listed & (f.season == x.season))
            return bind(F.transform(listed_files, lambda f: f.episode), beside)

        return met.select(
            *self.reports.columns, F.filter(F.transform("_seasons", gap), lambda g: g.n > 0).alias("gaps"),
            F.filter("_placed", lambda f: ~f.listed).alias("extra"),
        ), rest

    def _beside(
        self, listed_files: Column, lists: Callable[[DataFrame], DataFrame], files_in_row: int, listed_in_row: int
    ) -> tuple[DataFrame, Reconciled]:
        """Reports of the shows that fit one row, with the lists of their files and of their series; and all other shows.

        ``_files`` is what ``listed_files`` gives, or empty; ``lists`` gives the columns of a series, ``_theirs`` among them: its keys.
        """
        block = F.floor(F.col("episode") / R.LABELS_PER_BLOCK)
        size = self.series.groupBy("source", "series_id").agg(
            F.count(F.lit(1)).alias("_n"), F.bool_and(F.col("season").isNotNull()).alias("_placed"),
            (F.min(block) == F.max(block)).alias("_one_block"),
        )
        small = size.filter((F.col("_n") <= listed_in_row) & F.col("_placed") & F.col("_one_block")).select("source", "series_id")
        # Only shows of so many files, parsed or not, are counted.
        many = self.reports.filter(F.col("local_episodes") > files_in_row).select(SHOW).distinct()
        known = R.parsed(self.local).join(many, SHOW, "left_semi").groupBy(SHOW).agg(F.count(F.lit(1)).alias("_known"))
        large = known.filter(F.col("_known") > files_in_row)
        usable = F.bool_and(F.col("lookup_error").isNull()).alias("_usable")
        alone = self.reports.groupBy(SHOW).agg(F.count(F.lit(1)).alias("_rows"), usable).filter("_rows = 1 AND _usable").select(SHOW)
        single = (
            self.chosen.groupBy(SHOW)
            .agg(F.count(F.lit(1)).alias("_hits"), F.first("series_id").alias("series_id"), F.first("source").alias("source"))
            .filter("_hits = 1").drop("_hits").join(small, ["source", "series_id"], "left_semi")
            .join(alone, SHOW, "left_semi").join(large, SHOW, "left_anti")
        )
        single = landed(single, self.folders)
        listed = landed(lists(self.series.join(small, ["source", "series_id"], "left_semi")), self.folders)
        done = single.select(SHOW)
        files = R.parsed(self.local).join(done, SHOW, "left_semi").groupBy(SHOW).agg(listed_files.alias("_files"))
        met = self.reports.join(single, SHOW).join(files, SHOW, "left").join(listed, ["source", "series_id"])
        met = met.withColumn("_files", F.coalesce("_files", F.array().cast(files.schema["_files"].dataType)))
        chosen = landed(self.chosen.join(done, SHOW, "left_anti"), self.folders)
        remote = _rows_of(chosen, self.series)
        local = self.local.join(chosen.select(SHOW).distinct(), SHOW, "left_semi")
        reports = self.reports.join(done, SHOW, "left_anti")
        return met, replace(_reconciled_rows(self, remote, local, chosen), reports=reports)

    def landed_reports(self) -> Reconciled:
        """The same with its reports landed, for those who read them several times."""
        reports = landed(self.reports, self.folders)
        return replace(self, reports=reports, usable=_usable(reports))

    def unpersist(self) -> None:
        """Delete the tables landed for the report; none of its results can be read then."""
        forget_landed(self.folders)


def _remote_of(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes of each show's chosen series."""
    chosen = candidates.select(SHOW, F.col("id").alias("series_id"))
    return episodes.join(chosen, "series_id").select(SHOW, "ordinal", "season", "episode", "name", "airdate")


def _episodes(catalog: DataFrame) -> DataFrame:
    """A catalog without the marks of its landed lists."""
    return catalog.filter("episode IS NOT NULL")


def _first_hits(
    hits: DataFrame, catalog: DataFrame, local: DataFrame, as_of: str, landed_series: DataFrame | None, folders: list[str]
) -> DataFrame:
    """The counts are landed for the series that hits name only: a small table is then known to be one before it is joined."""
    first = landed(R.first_candidates(hits), folders)
    named = first.select(F.col("id").alias("series_id")).distinct()
    aired = landed(R.aired_count(catalog, as_of, landed=landed_series).join(named, "series_id", "left_semi"), folders)
    return R.nearest_candidate(first, aired, R.local_episode_count(local))


def _of_series(candidates: DataFrame) -> DataFrame:
    return candidates.select(SHOW, F.col("id").alias("series_id"))


def _chosen_only(episodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The episodes of series that some show chose."""
    return episodes.join(_of_series(candidates).select("series_id").distinct(), "series_id", "left_semi")


def _stats(
    local: DataFrame, candidates: dict[str, DataFrame], catalogs: dict[str, DataFrame], as_of: str, folders: list[str]
) -> DataFrame:
    listed = {x: landed(R.listed_keys(c, as_of), folders) for x, c in catalogs.items()}
    return R.show_stats(local, {x: _of_series(c) for x, c in candidates.items()}, listed)


def reconcile_one(
    local: DataFrame, hits: DataFrame, episodes: DataFrame, as_of: str, source: str = CATALOG_A,
    landed_series: DataFrame | None = None,
) -> Reconciled:
    """One catalog.  ``hits`` and ``episodes`` are what the sources of that catalog return.

    Series whose catalog landed empty are known by a row without an episode (``read_catalogs``) or by ``landed_series``.
    """
    folders: list[str] = []
    local, catalog = landed(local, folders), landed(episodes, folders)
    if source == CATALOG_A:
        candidates = landed(_first_hits(hits, catalog, local, as_of, landed_series, folders), folders)
    else:
        candidates = landed(hits.filter(F.col("rank") == 1), folders)
    episodes_chosen = landed(_chosen_only(_episodes(catalog), candidates), folders)
    remote = _remote_of(candidates, episodes_chosen)
    stats = _stats(local, {"r": candidates}, {"r": episodes_chosen}, as_of, folders)
    found = stats.join(candidates.select(SHOW, "id", "title", "status", F.lit(True).alias("_hit")), SHOW, "left")
    no_hit, empty = F.col("_hit").isNull(), F.col("n_r") == 0
    error = F.when(no_hit, NO_MATCH[source]).when(empty, NO_EPISODES[source])
    if source == CATALOG_A:
        title = F.when(empty, F.col("title")).otherwise(F.coalesce("title", SHOW))
        status = F.when(empty, F.col("status")).otherwise(F.coalesce("status", F.lit("Unknown")))
        maze = F.col("id")
    else:
        title, status = F.coalesce("title", SHOW), F.when(~empty, F.col("status"))
        maze = F.lit(None).cast("bigint")
    reports = found.select(
        SHOW,
        F.when(~no_hit, title).alias("matched_title"),
        F.when(~no_hit, maze).alias("tvmaze_id"),
        F.when(~no_hit, status).alias("status"),
        F.lit(source).alias("source_used"),
        "local_episodes", F.col("n_r").alias("remote_episodes"), error.alias("lookup_error"),
        F.col("missing_r").alias("missing_count"), F.when(error.isNull(), F.col("extra_r")).otherwise(0).alias("extra_count"),
    )
    chosen = _of_series(candidates).withColumn("source", F.lit("r"))
    return _reconciled(reports, local, remote, as_of, folders, chosen, episodes_chosen.withColumn("source", F.lit("r")))


def reconcile_both(
    local: DataFrame,
    hits_a: DataFrame,
    episodes_a: DataFrame,
    hits_b: DataFrame,
    episodes_b: DataFrame,
    as_of: str,
    landed_a: DataFrame | None = None,
) -> Reconciled:
    """Both catalogs, the better match per show; a tie goes to catalog B when it lists episodes.

    Scores, missing and extra counts come from sums of each series and from the episodes a show has files of, so
    the reports never repeat the episodes of a series for the shows that chose it.
    """
    folders: list[str] = []
    local, catalog_a, catalog_b = (landed(t, folders) for t in (local, episodes_a, episodes_b))
    first_a = landed(_first_hits(hits_a, catalog_a, local, as_of, landed_a, folders), folders)
    first_b = landed(hits_b.filter(F.col("rank") == 1), folders)
    candidates = {"a": first_a, "b": first_b}
    catalogs = {
        x: landed(_chosen_only(_episodes(c), candidates[x]), folders) for x, c in (("a", catalog_a), ("b", catalog_b))
    }
    stats = _stats(local, candidates, catalogs, as_of, folders)
    score = {x: R.score_of(F.col(f"matched_{x}"), F.col("known")) for x in candidates}
    better_b = (score["b"] >= score["a"]) & (F.col("n_b") > 0)
    stats = landed(stats.withColumn("chosen", F.when(better_b, "b").when(F.col("n_a") > 0, "a")), folders)
    series = R.union(c.withColumn("source", F.lit(x)) for x, c in catalogs.items())
    chosen = R.union(
        _of_series(c).withColumn("source", F.lit(x)).join(stats.filter(F.col("chosen") == x).select(SHOW), SHOW, "left_semi")
        for x, c in candidates.items()
    )
    remote = _rows_of(chosen, series)
    a = first_a.select(SHOW, F.col("id").alias("_id"), F.col("title").alias("_ta"), F.col("status").alias("_sa"))
    b = first_b.select(SHOW, F.col("title").alias("_tb"), F.col("status").alias("_sb"))
    found = stats.join(a, SHOW, "left").join(b, SHOW, "left")
    is_a, is_b = F.col("chosen") == "a", F.col("chosen") == "b"
    of_chosen = lambda name: F.when(is_b, F.col(f"{name}_b")).when(is_a, F.col(f"{name}_a")).otherwise(0)
    reports = found.select(
        SHOW,
        F.when(is_b, F.coalesce("_tb", SHOW)).when(is_a, F.coalesce("_ta", SHOW)).alias("matched_title"),
        F.when(is_a | is_b, F.col("_id")).alias("tvmaze_id"),
        F.when(is_b, F.col("_sb")).when(is_a, F.coalesce("_sa", F.lit("Unknown"))).alias("status"),
        F.when(is_b, CATALOG_B).when(is_a, CATALOG_A).otherwise(BOTH).alias("source_used"),
        "local_episodes", of_chosen("n").alias("remote_episodes"),
        F.when(F.col("chosen").isNull(), NO_MATCH[BOTH]).alias("lookup_error"),
        of_chosen("missing").alias("missing_count"), of_chosen("extra").alias("extra_count"),
    )
    return _reconciled(reports, local, remote, as_of, folders, chosen, series)


def _rows_of(chosen: DataFrame, series: DataFrame) -> DataFrame:
    """Episodes of each show's chosen series, from any of the sources."""
    return series.join(chosen, ["source", "series_id"]).select(SHOW, "ordinal", "season", "episode", "name", "airdate")


def _usable(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("lookup_error").isNull()).select(SHOW)


def _reconciled(
    reports: DataFrame, local: DataFrame, remote: DataFrame, as_of: str, folders: list[str], chosen: DataFrame, series: DataFrame
) -> Reconciled:
    """Reports with their outcome, and the two-way difference in rows; shows with a lookup error have no remote rows and no extras."""
    missing = R.missing_from_local(remote, local, as_of)
    usable = _usable(reports)
    extra = R.extra_in_local(local, remote).join(usable, SHOW, "left_semi")
    judged = reports.withColumn("ok", report_ok(F.col("missing_count"), F.col("lookup_error")))
    return Reconciled(judged, missing, extra, remote, local, chosen, series, usable, as_of, folders)


def _reconciled_rows(whole: Reconciled, remote: DataFrame, local: DataFrame, chosen: DataFrame) -> Reconciled:
    """The same comparison of some of the shows."""
    extra = R.extra_in_local(local, remote).join(whole.usable, SHOW, "left_semi")
    missing = R.missing_from_local(remote, local, whole.as_of)
    return replace(whole, missing=missing, extra=extra, remote=remote, local=local, chosen=chosen)
