"""Mesh text to three tables: vertices, normals, triangles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.functions.text import BLANKS
from sparkaudit.landing import landed
from sparkaudit.sources.lines import numbered_lines, offsets_in_file


class Mesh(NamedTuple):
    """vertices (mesh_id, vid, x, y, z); normals (mesh_id, nid, x, y, z); faces (mesh_id, fid, v0..v2, n0..n2)."""

    vertices: DataFrame
    normals: DataFrame
    faces: DataFrame


def mesh_tables(lines: DataFrame) -> Mesh:
    """Lines (file, block, line, value) to mesh tables; ids are 0-based, polygons become fans.

    A corner without a normal index refers to normal 0.  The records, split and numbered, are landed
    once; the three tables are read from there.
    """
    value = F.col("value")
    kind = F.when(value.startswith("v "), "v").when(value.startswith("vn "), "vn").when(value.startswith("f "), "f")
    records = lines.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    parts = records.withColumn("_p", F.filter(F.split("value", BLANKS), lambda t: t != ""))
    triangles = F.greatest(F.size("_p") - 3, F.lit(0))
    is_kind = {k: F.col("kind") == k for k in ("v", "vn", "f")}
    numbered = offsets_in_file(
        parts,
        {
            "vid": is_kind["v"].cast("int"),
            "nid": is_kind["vn"].cast("int"),
            "fid": F.when(is_kind["f"], triangles).otherwise(0),
        },
    )
    placed = landed(numbered.select(F.col("file").alias("mesh_id"), "kind", "vid", "nid", "fid", "_p"))

    def xyz(kind: str, key: str) -> DataFrame:
        numbers = [F.element_at("_p", i + 2).cast("double").alias(c) for i, c in enumerate("xyz")]
        return placed.filter(is_kind[kind]).select("mesh_id", key, *numbers)

    pieces = F.transform(F.slice("_p", F.lit(2), F.size("_p")), lambda t: F.split(t, "/"))
    normal = lambda t: F.nullif(F.try_element_at(t, F.lit(3)), F.lit(""))
    corners = F.transform(
        pieces,
        lambda t: F.struct(
            (F.element_at(t, 1).cast("bigint") - 1).alias("v"),
            F.coalesce(normal(t).cast("bigint") - 1, F.lit(0).cast("bigint")).alias("n"),
        ),
    )
    polygons = placed.filter(is_kind["f"] & (F.size("_p") >= 4)).select("mesh_id", "fid", corners.alias("_c"))
    fans = polygons.select(
        "mesh_id", "fid", "_c", F.posexplode(F.sequence(F.lit(2), F.size("_c") - 1)).alias("_pos", "_i")
    )
    at = [F.element_at("_c", 1), F.element_at("_c", F.col("_i")), F.element_at("_c", F.col("_i") + 1)]
    faces = fans.select(
        "mesh_id", (F.col("fid") + F.col("_pos")).alias("fid"),
        *[c["v"].alias(f"v{i}") for i, c in enumerate(at)], *[c["n"].alias(f"n{i}") for i, c in enumerate(at)],
    )
    return Mesh(xyz("v", "vid"), xyz("vn", "nid"), faces)


def read_meshes(spark: SparkSession, path: str) -> Mesh:
    return mesh_tables(numbered_lines(spark, path))
