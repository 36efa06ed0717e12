"""Column functions for blending, scaling, point weights and seeded draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entropy range mapped to depth.
ENTROPY_FLOOR = 0.18
ENTROPY_CEILING = 0.97


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def normalise_clamped(value: Column, low: float, high: float) -> Column:
    span = high - low
    return clamp((value - low) / span) if span > 0 else F.lit(0.0)


def depth_of(entropy: Column, low: float = ENTROPY_FLOOR, high: float = ENTROPY_CEILING) -> Column:
    return F.lit(1.0) - normalise_clamped(entropy, low, high)


def smoothstep(t: Column) -> Column:
    c = clamp(t)
    return c * c * (F.lit(3.0) - F.lit(2.0) * c)


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f


def gaussian_weight(point: Sequence[Column], center: Sequence[Column | float], radius: Column | float) -> Column:
    squared = sum(((p - c) * (p - c) for p, c in zip(point, center)), F.lit(0.0))
    return F.exp(-squared / (radius * radius))


def rotate_y(x: Column, y: Column, z: Column, degrees: float) -> tuple[Column, Column, Column]:
    angle = F.radians(F.lit(float(degrees)))
    c, s = F.cos(angle), F.sin(angle)
    return c * x + s * z, y, -s * x + c * z


def draw_integer(seed: int, *key: Column) -> Column:
    """Uniform integer in [0, 2^60) that depends only on the seed and the key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_unit(seed: int, *key: Column) -> Column:
    return draw_integer(seed, *key) / F.lit(float(1 << 60))
