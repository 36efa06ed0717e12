"""Column functions of the episode reconcile: name parsing, airing, report fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkaudit.functions.text import bind, season_ep_label

# File name extensions of episode files.
EPISODE_EXTENSIONS = ["mkv", "mp4", "avi", "m4v", "mov", "wmv", "mpg", "mpeg", "ts", "m2ts", "vob", "divx"]

# The name patterns, tried in this order.
SEASON_DIR = r"(?i)(?:season[\s._-]*(\d+)|s[\s._-]?(\d+))"
EPISODE_RANGE = r"(?i)s(\d+)e(\d+)[-–]?e(\d+)"
EPISODE_SINGLE = [r"(?i)s(\d+)e(\d+)", r"(\d+)[xX](\d+)", r"(?<!\d)(\d)(\d{2})(?!\d)"]

MOST_NUMBER = (1 << 31) - 1

PAIRS = "array<struct<season:int,episode:int>>"


def _number(digits: Column) -> Column:
    """Digits to int, 0 for none, null beyond an int; no cast here can fail, as failing casts are costly per row."""
    plain = F.ltrim(digits, F.lit("0"))
    whole = F.concat(F.lit("0"), F.substring(plain, 1, 18)).cast("bigint")
    return F.when((F.length(plain) <= 10) & (whole <= MOST_NUMBER), whole.cast("int"))


def _group(text: Column, pattern: str, index: int) -> Column:
    """Number in a group of the first match, 0 without a match."""
    return _number(F.regexp_extract(text, pattern, index))


def season_of(folder: Column) -> Column:
    """Season number of a folder name, null when it names none."""
    named = _number(F.concat(F.regexp_extract(folder, SEASON_DIR, 1), F.regexp_extract(folder, SEASON_DIR, 2)))
    bare = F.trim(folder)
    return F.when(folder.rlike(SEASON_DIR), named).when(bare.rlike(r"^\d+$"), _number(bare))


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading or closing dot starts none."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def _in_bounds(season: Column, episode: Column) -> Column:
    return (season > 0) & (season < 100) & (episode > 0) & (episode < 300)


def episodes_of(name: Column) -> Column:
    """Array of (season, episode) a file name covers; empty when no pattern gives a number in bounds.

    Only the first match of each pattern is looked at; the next pattern is tried
    when its numbers are out of bounds.
    """
    return bind(stem(name), _episodes_of_stem)


def _episodes_of_stem(text: Column) -> Column:
    season, first, last = (_group(text, EPISODE_RANGE, i) for i in (1, 2, 3))
    ranged = _in_bounds(season, first) & _in_bounds(season, last) & (last >= first)
    found = F.when(
        ranged,
        F.transform(
            F.sequence(F.when(ranged, first), F.when(ranged, last)),
            lambda e: F.struct(season.alias("season"), e.alias("episode")),
        ),
    )
    for pattern in EPISODE_SINGLE:
        s, e = _group(text, pattern, 1), _group(text, pattern, 2)
        found = found.when(_in_bounds(s, e), F.array(F.struct(s.alias("season"), e.alias("episode"))))
    return found.otherwise(F.array().cast(PAIRS)).cast(PAIRS)


def episode_of(name: Column) -> Column:
    """First (season, episode) of a file name, or null."""
    return F.try_element_at(episodes_of(name), F.lit(1))


def is_aired(airdate: Column, as_of: str | Column, only_aired: bool = True) -> Column:
    """ISO date text compare; an empty date has not aired."""
    if not only_aired:
        return F.lit(True)
    limit = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.coalesce((airdate != "") & (airdate <= limit), F.lit(False))


def status_text(status_json: Column) -> Column:
    """Status given as JSON text, either a string or an object with a name."""
    as_object = F.get_json_object(status_json, "$.name")
    is_object = F.ltrim(status_json).startswith("{")
    plain = F.regexp_replace(status_json, '^"|"$', "")
    return F.coalesce(F.when(is_object, as_object).otherwise(plain), F.lit("Unknown"))


def report_ok(missing_count: Column, lookup_error: Column) -> Column:
    """Extras do not make a show an issue."""
    return (missing_count == 0) & (F.coalesce(lookup_error, F.lit("")) == "")


def name_matches(name: Column, text: str) -> Column:
    return F.contains(F.lower(name), F.lit(text.lower()))


__all__ = [
    "episode_of", "episodes_of", "is_aired", "name_matches", "report_ok", "season_ep_label", "season_of", "status_text", "stem",
]
