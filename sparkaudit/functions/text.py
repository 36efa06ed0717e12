"""Number and text formatting that matches C-style rounding, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Values fixed by the data formats read: the characters a blank-separated token ends at.
BLANKS = "[\\t\\n\\u000b\\f\\r\\u001c-\\u001f \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def to_double(text: Column, default: float | None = 0.0) -> Column:
    """Text to double; anything that is not a number gives ``default``."""
    parsed = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places (at most 4), rounded from the exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal text half up, which differs where
    that text ends in a half, such as 2.25 or 1.005.  Close to a half the value is
    therefore moved to the right side before it is formatted; on the half itself the
    exact error of the scaled value decides (the value is split at float precision,
    so both partial products are exact).
    """
    x = value.cast("double")
    scale = float(10**digits)
    product = x * scale
    past_half = F.pmod(product, F.lit(1.0)) - 0.5
    high = x.cast("float").cast("double")
    error = (high * scale - product) + (x - high) * scale
    # An odd whole part breaks an exact tie upwards: what is added is far below any error.
    tie_up = error + (F.pmod(product, F.lit(2.0)) - 1.0) * 1e-300 > 0
    step = F.when((past_half > 0) | ((past_half == 0) & tie_up), 0.25).otherwise(-0.25)
    moved = (product - past_half + step) / scale
    return F.format_string(f"%.{digits}f", F.when(F.abs(past_half) < 0.001, moved).otherwise(x))


def two_digits(value: Column) -> Column:
    """Zero padded to two places, never cut."""
    text = value.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def pad_left(text: Column, width: int) -> Column:
    """Right-justify; unlike ``lpad`` a longer text is kept whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def pad_right(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def truncate_text(text: Column, width: int) -> Column:
    """Cut to ``width`` characters, the last being an ellipsis; width 0 turns it off."""
    if width == 0:
        return text
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def fmt_size(size_bytes: Column) -> Column:
    size = size_bytes.cast("double")
    return (
        F.when(size >= 1024.0**3, F.concat(fixed(size / 1024.0**3, 2), F.lit(" GB")))
        .when(size >= 1024.0**2, F.concat(fixed(size / 1024.0**2, 1), F.lit(" MB")))
        .otherwise(F.concat(fixed(size / 1024.0, 0), F.lit(" KB")))
    )


def fmt_bitrate(bps: Column) -> Column:
    return (
        F.when(bps <= 0, "N/A")
        .when(bps >= 1e6, F.concat(fixed(bps / 1e6, 1), F.lit(" Mbps")))
        .when(bps >= 1e3, F.concat(fixed(bps / 1e3, 0), F.lit(" Kbps")))
        .otherwise(F.concat(fixed(bps, 0), F.lit(" bps")))
    )


def fmt_efficiency(value: Column) -> Column:
    return F.when(value == float("inf"), "N/A").otherwise(fixed(value, 4))


def fmt_codec_factor(factor: Column) -> Column:
    return F.concat(fixed(factor, 1), F.lit("x"))


def fmt_vmaf(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(fixed(value, 2))


def duration_hms(seconds: Column) -> Column:
    """H:MM:SS, fractions of a second dropped."""
    whole = F.floor(seconds)
    return F.when(seconds <= 0, "unknown").otherwise(
        F.concat_ws(
            ":",
            F.floor(whole / 3600).cast("string"),
            two_digits(F.floor(whole % 3600 / 60)),
            two_digits(whole % 60),
        )
    )


def season_ep_label(season: Column, episode: Column) -> Column:
    return F.concat(F.lit("S"), two_digits(season), F.lit("E"), two_digits(episode))
