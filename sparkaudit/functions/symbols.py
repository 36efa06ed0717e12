"""Characters and words to symbol codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol group of each character; any other character is group 0.
CHARACTER_GROUPS = {
    "a": 1, "e": 2, "i": 3, "y": 3, "o": 4, "u": 4, "w": 4, "m": 5, "b": 5, "p": 5,
    "f": 6, "v": 6, "t": 8, "d": 8, "n": 8, "l": 8,
}
LETTERS = "".join(CHARACTER_GROUPS)
CODES = "".join(str(code) for code in CHARACTER_GROUPS.values())


def symbol_of(char: Column) -> Column:
    """Group of one character, 0 when it has none."""
    lowered = F.lower(char)
    known = (F.length(lowered) == 1) & F.contains(F.lit(LETTERS), lowered)
    return F.when(known, F.translate(lowered, LETTERS, CODES).cast("int")).otherwise(0)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([a-zA-Z']+)"), 1)


def symbols_of(word: Column) -> Column:
    """Codes of a word: a run of vowels counts as its first one, characters of group 0 are left out."""
    runs = F.regexp_replace(F.lower(word), "([aeiou])[aeiou]*", "$1")
    codes = F.translate(F.regexp_replace(runs, f"[^{LETTERS}]+", ""), LETTERS, CODES)
    return F.when(codes == "", F.array().cast("array<string>")).otherwise(F.split(codes, ""))
