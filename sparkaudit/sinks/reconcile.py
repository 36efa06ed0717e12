"""Reconcile report sinks: CSV, JSON and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.sinks.audit import CSV
from sparkaudit.functions.episodes import season_ep_label
from sparkaudit.functions.text import bind, two_digits
from sparkaudit.landing import landed
from sparkaudit.operators import reconcile as R
from sparkaudit.operators.ordering import ranked
from sparkaudit.plans.reconcile import FILES_IN_ROW, LISTED_IN_ROW, Reconciled

SHOW = R.SHOW
ENTRIES_PER_PART = 10_000


def reconcile_csv_rows(reports: DataFrame) -> DataFrame:
    """Ten text columns in show order; every show, whether ok or not."""
    blank = F.lit("")
    maze = F.when(F.col("tvmaze_id") != 0, F.col("tvmaze_id").cast("string"))
    return R.show_order(reports).select(
        SHOW, F.coalesce("matched_title", blank).alias("matched_title"),
        F.coalesce(maze, blank).alias("tvmaze_id"), F.coalesce("status", blank).alias("status"), "source_used",
        "local_episodes", "remote_episodes", "missing_count",
        F.when(F.col("ok"), "True").otherwise("False").alias("ok"),
        F.coalesce("lookup_error", blank).alias("error"),
    )


def write_reconcile_csv(reports: DataFrame, path: str) -> None:
    rows = reconcile_csv_rows(reports)
    rows.write.mode("overwrite").options(**CSV).csv(path)


def reconcile_json_rows(result: Reconciled, per_part: int = ENTRIES_PER_PART) -> DataFrame:
    """One nested row per show.

    A show with more than ``per_part`` entries in a list continues in further rows
    (``part`` 1, 2, …), so no list grows with the table.  Shows whose lists fit one row by their
    sizes are compared there; the others are numbered and cut into parts.
    """
    result = result.landed_reports()
    short, rest = result.in_rows(min(FILES_IN_ROW, per_part), min(LISTED_IN_ROW, per_part))

    def in_parts(df: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
        numbered = ranked(df, order, [SHOW], "_rank")
        part = F.floor((F.col("_rank") - 1) / per_part).alias("part")
        entry = F.struct("_rank", F.struct(*fields).alias("e"))
        listed = numbered.groupBy(SHOW, part).agg(F.array_sort(F.collect_list(entry)).alias(name))
        return listed.withColumn(name, F.transform(name, lambda x: x.e))

    remote_fields = ["season", "episode", "name", "airdate"]
    missing = in_parts(rest.missing, ["ordinal", *remote_fields], remote_fields, "missing")
    extra = in_parts(rest.extra, ["path", "season", "episode"], ["season", "episode", "path"], "extra")
    parts = missing.join(extra, [SHOW, "part"], "full_outer")
    joined = rest.reports.join(parts, SHOW, "left").unionByName(
        short.drop("seasons").withColumn("part", F.lit(0).cast("bigint"))
    )
    return joined.select(
        SHOW, F.coalesce("part", F.lit(0)).alias("part"), "matched_title", "tvmaze_id", "status", "source_used",
        F.col("local_episodes").alias("local_episode_count"),
        F.col("remote_episodes").alias("remote_episode_count"), "ok", "lookup_error",
        F.coalesce("missing", F.array().cast(missing.schema["missing"].dataType)).alias("missing"),
        F.coalesce("extra", F.array().cast(extra.schema["extra"].dataType)).alias("extra"),
    )


def write_reconcile_json(result: Reconciled, path: str) -> None:
    reconcile_json_rows(result).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def reconcile_text_lines(result: Reconciled, missing_only: bool = False) -> DataFrame:
    """Report lines in order: totals, then per show its heading, gaps by season and extras.

    A show compared in one row has all its lines in one row, others a row for each line.
    """
    result = result.landed_reports()
    totals = R.reconcile_totals(result.reports).select(
        F.lit(0).alias("group"),
        F.array(
            F.concat(F.lit("TV Library Report — "), F.col("shows"), F.lit(" shows scanned")),
            F.lit("─" * 60),
            F.concat(F.lit("  ✓ Complete:  "), F.col("ok")),
            F.concat(F.lit("  ✗ Issues:    "), F.col("issues")),
            F.lit(""),
        ).alias("lines"),
    )
    label = F.upper("source_used")
    retitled = F.col("matched_title").isNotNull() & ~F.col("matched_title").isin("") & (
        F.col("matched_title") != F.col(SHOW)
    )
    title = F.concat(
        F.lit("► "), F.col(SHOW),
        F.when(retitled, F.concat(F.lit("  ["), label, F.lit(": "), F.col("matched_title"), F.lit("]"))).otherwise(""),
        F.when(F.col("status") != "", F.concat(F.lit("  ("), F.col("status"), F.lit(")"))).otherwise(""),
    )
    error = F.concat(F.lit("    ⚠ "), F.col("lookup_error"))
    counts = F.concat(
        F.lit("    Local: "), F.col("local_episodes"), F.lit(" episodes  |  "), label,
        F.lit(" (aired): "), F.col("remote_episodes"), F.lit(" episodes"),
    )
    complete = (F.col("missing_count") == 0) & (F.col("extra_count") == 0)
    all_present = F.when(F.col("lookup_error").isNull() & complete, "    ✓ All aired episodes present")
    head = [title, F.coalesce(error, counts), all_present]

    def gap_text(season: Column, n: Column, entirely: Column, labels: Column) -> Column:
        number, many = two_digits(season), F.when(n != 1, "s").otherwise("")
        whole = F.concat(F.lit("    ✗ Season "), number, F.lit(" entirely missing ("), n, F.lit(" episode"), many, F.lit(")"))
        return F.when(entirely, whole).otherwise(F.concat(F.lit("    ✗ Missing S"), number, F.lit(": "), labels))

    def extra_text(source: Column, labels: Column) -> Column:
        return F.concat(F.lit("    ? Extra (not in "), source, F.lit("): "), labels)

    def joined(beyond: Column) -> Column:
        labels = F.transform(beyond, lambda x: season_ep_label(x.season, x.episode))
        return F.when(F.size(beyond) > 0, extra_text(label, F.array_join(labels, ", ")))

    short, rest = result.labels_in_rows()
    reported = rest.reports
    if missing_only:
        short, reported = R.only_issues(short), R.only_issues(reported)
    gaps_in_row = F.transform("gaps", lambda g: gap_text(g.season, g.n, g.entirely, g.labels))
    in_row = F.concat(F.array(*head), gaps_in_row, F.array(bind(F.col("extra"), joined), F.lit("")))
    shows = short.select(F.lit(1).alias("group"), SHOW, F.array_compact(in_row).alias("lines"))
    heads = reported.select(
        F.lit(1).alias("group"), SHOW,
        F.inline(F.array(*[
            F.struct(F.lit(step).alias("step"), value.alias("value")) for step, value in zip((0, 1, 2, 5), [*head, F.lit("")])
        ])),
    ).filter(F.col("value").isNotNull())
    gaps = R.missing_by_season(rest.missing, rest.local)
    gap_lines = gaps.filter(~F.col("entirely_missing") | F.col("first_block")).select(
        F.lit(1).alias("group"), SHOW, F.lit(3).alias("step"), "season", "block",
        gap_text(F.col("season"), F.col("n_missing"), F.col("entirely_missing"), R.label_list(F.col("labels"))).alias("value"),
    )
    # At most 99 seasons of 299 parsed episodes: the labels of one show are bounded.
    beyond = rest.extra.groupBy(*R.KEYS).agg(F.count(F.lit(1)).alias("copies"))
    entry = F.struct("season", "episode", season_ep_label(F.col("season"), F.col("episode")).alias("label"), "copies")
    extra_lines = (
        beyond.groupBy(SHOW)
        .agg(F.array_sort(F.collect_list(entry)).alias("labels"))
        .join(rest.reports.select(SHOW, label.alias("source")), SHOW)
        .select(F.lit(1).alias("group"), SHOW, F.lit(4).alias("step"), extra_text(F.col("source"), R.label_list(F.col("labels"))).alias("value"))
    )
    if missing_only:
        extra_lines = extra_lines.join(reported.select(SHOW), SHOW, "left_semi")
    single = heads.unionByName(gap_lines, allowMissingColumns=True).unionByName(extra_lines, allowMissingColumns=True)
    lines = single.withColumn("lines", F.array("value")).drop("value")
    for other in (shows, totals):
        lines = lines.unionByName(other, allowMissingColumns=True)
    # The sort reads its input twice, once to sample it: the lines are made before, once.
    ready = landed(lines, result.folders)
    ordered = ready.orderBy("group", F.lower(SHOW), SHOW, "step", "season", "block")
    return ordered.select(F.explode("lines").alias("value"))


def write_reconcile_text(result: Reconciled, path: str, missing_only: bool = False) -> None:
    reconcile_text_lines(result, missing_only).write.mode("overwrite").text(path)
