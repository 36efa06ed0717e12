"""Point set and mesh operators: rotation, centring, voxel centroids, vertex normals, regions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkaudit.functions import numeric as N
from sparkaudit.operators.ordering import attach_group, order_statistics

XYZ = ("x", "y", "z")
FRONT_SHARE = 0.70
FRONT_AT_LEAST = 20
MESH = ("mesh_id",)


class Anchor(NamedTuple):
    name: str
    center: tuple[float, float, float]
    radius: float


class Region(NamedTuple):
    """Points whose summed weights around ``centers`` exceed ``threshold``."""

    label: int
    centers: tuple[tuple[float, float, float], ...]
    radius: float
    threshold: float


# Regions in order of priority (4 mouth, 3 lip, 1 eye, 2 brow; 0 is everything else).
REGIONS = [
    Region(4, ((0.00, -0.15, 0.64),), 0.07, 0.40),
    Region(3, ((0.00, -0.08, 0.70), (0.00, -0.22, 0.68)), 0.10, 0.40),
    Region(1, ((0.23, 0.22, 0.63), (-0.23, 0.22, 0.63)), 0.09, 0.35),
    Region(2, ((0.25, 0.40, 0.55), (-0.25, 0.40, 0.55)), 0.10, 0.35),
]

# Anchors of the shape weights.
ANCHORS = [
    Anchor("upper_lip", (0.00, -0.08, 0.68), 0.12),
    Anchor("lower_lip", (0.00, -0.22, 0.66), 0.13),
    Anchor("jaw", (0.00, -0.55, 0.32), 0.34),
    Anchor("corner_r", (0.13, -0.175, 0.63), 0.11),
    Anchor("corner_l", (-0.13, -0.175, 0.63), 0.11),
    Anchor("brow_r", (0.25, 0.40, 0.53), 0.14),
    Anchor("brow_l", (-0.25, 0.40, 0.53), 0.14),
    Anchor("eye_r", (0.23, 0.22, 0.61), 0.11),
    Anchor("eye_l", (-0.23, 0.22, 0.61), 0.11),
    Anchor("cheek_r", (0.38, -0.04, 0.53), 0.19),
    Anchor("cheek_l", (-0.38, -0.04, 0.53), 0.19),
]


def _point(coords: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in coords]


def anchor_weights(points: DataFrame, anchors: Sequence[Anchor] = ANCHORS, coords: Sequence[str] = XYZ) -> DataFrame:
    """One weight column per anchor.  The anchors are parameters, so this is a projection, not a join."""
    here = _point(coords)
    return points.withColumns({f"w_{a.name}": N.gaussian_weight(here, a.center, a.radius) for a in anchors})


def region_label(
    points: DataFrame, regions: Sequence[Region] = REGIONS, coords: Sequence[str] = XYZ, name: str = "region"
) -> DataFrame:
    """First region, in priority order, whose summed weight passes its threshold; else 0."""
    here = _point(coords)
    label = None
    for region in regions:
        weight = sum((N.gaussian_weight(here, c, region.radius) for c in region.centers), F.lit(0.0))
        hit = weight > region.threshold
        label = F.when(hit, region.label) if label is None else label.when(hit, region.label)
    return points.withColumn(name, label.otherwise(0))


def rotate_y(points: DataFrame, degrees: float, coords: Sequence[str] = XYZ) -> DataFrame:
    turned = N.rotate_y(*_point(coords), degrees)
    return points.withColumns(dict(zip(coords, turned)))


def vertex_normals(
    vertices: DataFrame, normals: DataFrame, faces: DataFrame, by: Sequence[str] = MESH
) -> DataFrame:
    """Unit sum of the corner normals of each vertex; zero where there is none.

    Equal (vertex, normal) corners are counted before the join, so a normal that most
    corners share is looked up once per vertex.
    """
    by = list(by)
    corners = faces.select(
        *by, F.inline(F.array(*[F.struct(F.col(f"v{i}").alias("vid"), F.col(f"n{i}").alias("nid")) for i in range(3)]))
    )
    counted = corners.groupBy(*by, "vid", "nid").agg(F.count(F.lit(1)).alias("_k"))
    summed = counted.join(normals, [*by, "nid"]).groupBy(*by, "vid").agg(
        *[F.sum(F.col("_k") * F.col(c)).alias(f"_{c}") for c in XYZ]
    )
    unit = _unit([F.coalesce(f"_{c}", F.lit(0.0)) for c in XYZ])
    joined = vertices.select(*by, "vid").join(summed, [*by, "vid"], "left")
    return joined.select(*by, "vid", *[u.alias(f"n{c}") for u, c in zip(unit, XYZ)])


def _unit(vector: Sequence[Column]) -> list[Column]:
    length = F.sqrt(sum((v * v for v in vector), F.lit(0.0)))
    return [v / F.when(length > 0, length).otherwise(1.0) for v in vector]


def with_voxel(
    points: DataFrame, grid: int = 10, by: Sequence[str] = (), coords: Sequence[str] = XYZ
) -> DataFrame:
    """Add ``cell``, the flat id of the point's cell in a grid over the bounds of its group."""
    by = list(by)
    bounds = points.groupBy(*by).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in coords], *[F.max(c).alias(f"_hi_{c}") for c in coords]
    )
    placed = attach_group(points, bounds, by)
    cell = F.lit(0)
    for c in coords:
        step = (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / grid
        along = F.floor((F.col(c) - F.col(f"_lo_{c}")) / F.when(step > 0, step).otherwise(1.0))
        cell = cell * grid + F.greatest(F.lit(0), F.least(along, F.lit(grid - 1)))
    return placed.withColumn("cell", cell.cast("int")).drop(*bounds.columns[len(by):])


def voxel_centroids(
    points: DataFrame,
    grid: int = 10,
    by: Sequence[str] = (),
    coords: Sequence[str] = XYZ,
    normals: Sequence[str] = (),
) -> DataFrame:
    """One row per occupied cell: new_id (dense, in cell order), cell, n, mean point and unit mean normal.

    A group has at most grid ** 3 cells, which bounds the numbering window.
    """
    by = list(by)
    cells = with_voxel(points, grid, by, coords).groupBy(*by, "cell").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in coords], *[F.sum(c).alias(c) for c in normals]
    )
    number = F.row_number().over(W.partitionBy(*by).orderBy("cell")) - 1
    unit = _unit([F.col(c) for c in normals]) if normals else []
    return cells.select(
        *by, number.alias("new_id"), "cell", "n", *coords, *[u.alias(c) for u, c in zip(unit, normals)]
    )


def remap_faces(faces: DataFrame, vertex_ids: DataFrame, by: Sequence[str] = MESH, new_id: str = "new_id") -> DataFrame:
    """Corner ids replaced through (by, vid, new_id); triangles with two equal corners are dropped.

    One join over stacked corners, then three rows per face are put together again.
    """
    by = list(by)
    corners = faces.select(*by, "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid"))
    mapped = corners.join(vertex_ids.select(*by, "vid", F.col(new_id).alias("_id")), [*by, "vid"])
    v = [F.max(F.when(F.col("corner") == i, F.col("_id"))).alias(f"v{i}") for i in range(3)]
    whole = mapped.groupBy(*by, "fid").agg(*v)
    distinct = (F.col("v0") != F.col("v1")) & (F.col("v1") != F.col("v2")) & (F.col("v0") != F.col("v2"))
    return whole.filter(distinct)


def centre_of(
    points: DataFrame, key: Sequence[str], by: Sequence[str] = (), coords: Sequence[str] = XYZ, exact: bool = True
) -> DataFrame:
    """Per group: centre (cx, cy, cz) and scale.

    The centre is the mean, but x is the median over the front points (z at or above its
    70th percentile) when there are more than twenty.  The scale is the largest distance from
    the centre along one axis, taken from the bounds.  ``exact=False`` uses sketches.
    """
    by = list(by)
    x, _, z = coords
    kept = points.select(*by, *key, *coords)

    def quantile(df: DataFrame, column: str, share: float, name: str) -> DataFrame:
        if exact:
            return order_statistics(df, column, list(key), share, by, name)
        return df.groupBy(*by).agg(F.percentile_approx(column, F.lit(share), F.lit(10_000)).alias(name))

    front = attach_group(kept, quantile(kept, z, FRONT_SHARE, "_z"), by).filter(F.col(z) >= F.col("_z")).drop("_z")
    sizes = front.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    stats = kept.groupBy(*by).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in coords],
        *[F.min(c).alias(f"_lo_{c}") for c in coords], *[F.max(c).alias(f"_hi_{c}") for c in coords],
    )
    joined = attach_group(attach_group(stats, quantile(front, x, 0.5, "_median"), by), sizes, by)
    middle = F.when(F.col("_n") > FRONT_AT_LEAST, F.col("_median")).otherwise(F.col(f"_mean_{x}"))
    centre = [middle, *[F.col(f"_mean_{c}") for c in coords[1:]]]
    reach = [d for c, m in zip(coords, centre) for d in (F.col(f"_hi_{c}") - m, m - F.col(f"_lo_{c}"))]
    return joined.select(*by, *[m.alias(f"c{c}") for m, c in zip(centre, coords)], F.greatest(*reach).alias("scale"))


def centre_and_scale(
    points: DataFrame, key: Sequence[str], by: Sequence[str] = (), coords: Sequence[str] = XYZ, exact: bool = True
) -> DataFrame:
    """Points moved to their group's centre and divided by its scale."""
    placed = attach_group(points, centre_of(points, key, by, coords, exact), list(by))
    moved = {c: (F.col(c) - F.col(f"c{c}")) / F.col("scale") for c in coords}
    return placed.withColumns(moved).drop(*[f"c{c}" for c in coords], "scale")
