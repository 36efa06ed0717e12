"""Point set and mesh queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.operators import points as G
from sparkaudit.queries import table
from sparkaudit.sources.meshes import mesh_tables


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.element_at(e, i + 1).cast("double").alias(c) for i, c in enumerate(G.XYZ)]
    )


POINTS_SQL = """SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z
  FROM embeddings"""


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


def voxels(spark, d):
    return rounded(G.voxel_centroids(vectors(spark, d), 10, ["label"]), *G.XYZ)


def voxels_whole(spark, d):
    flat = vectors(spark, d).withColumn("z", F.lit(2.5)).withColumn("nx", F.col("x")).withColumn("ny", F.col("y"))
    return rounded(G.voxel_centroids(flat, 4, normals=["nx", "ny"]), *G.XYZ, "nx", "ny")


def _cell_sql(grid: int, coords: str, by: str) -> str:
    parts, factor = [], {"x": grid * grid, "y": grid, "z": 1}
    for c in coords:
        lo, hi = f"min({c}) OVER ({by})", f"max({c}) OVER ({by})"
        step = f"(({hi} - {lo}) / {grid}.0::DOUBLE)"
        parts.append(
            f"greatest(0, least(floor(({c} - {lo}) / CASE WHEN {step} > 0 THEN {step} ELSE 1 END), {grid - 1})) * {factor[c]}"
        )
    return "(" + " + ".join(parts) + ")::INT"


VOXELS_SQL = f"""
  SELECT label, (row_number() OVER (PARTITION BY label ORDER BY cell) - 1)::INT AS new_id, cell, count(*) AS n,
         {_r('avg(x)', 'x')}, {_r('avg(y)', 'y')}, {_r('avg(z)', 'z')}
  FROM (SELECT *, {_cell_sql(10, 'xyz', 'PARTITION BY label')} AS cell FROM ({POINTS_SQL})) GROUP BY label, cell"""

VOXELS_WHOLE_SQL = f"""
  SELECT (row_number() OVER (ORDER BY cell) - 1)::INT AS new_id, cell, n, {_r('x', 'x')}, {_r('y', 'y')}, {_r('z', 'z')},
         {_r('sx / CASE WHEN l > 0 THEN l ELSE 1 END', 'nx')}, {_r('sy / CASE WHEN l > 0 THEN l ELSE 1 END', 'ny')}
  FROM (SELECT cell, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, sum(x) AS sx, sum(y) AS sy,
               sqrt(sum(x) * sum(x) + sum(y) * sum(y)) AS l
        FROM (SELECT *, {_cell_sql(4, 'xyz', '')} AS cell FROM (SELECT vec_id, x, y, 2.5::DOUBLE AS z FROM ({POINTS_SQL})))
        GROUP BY cell)"""


def centre_scale(spark, d):
    return rounded(G.centre_and_scale(vectors(spark, d), ["vec_id"], ["label"]), *G.XYZ)


def centre_whole(spark, d):
    return rounded(G.centre_of(vectors(spark, d), ["vec_id"]), "cx", "cy", "cz", "scale")


def _centre_sql(by: str, on: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
  q AS (SELECT {key}quantile_cont(z, 0.7) AS z70 FROM p {group}),
  f AS (SELECT {key}quantile_cont(x, 0.5) AS med, count(*) AS n FROM p {on.format('q')} WHERE z >= z70 {group}),
  m AS (SELECT {key}avg(x) AS mx, avg(y) AS cy, avg(z) AS cz, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy,
               min(z) AS lz, max(z) AS hz FROM p {group}),
  c AS (SELECT *, greatest(hx - cx, cx - lx, hy - cy, cy - ly, hz - cz, cz - lz) AS scale
        FROM (SELECT m.*, CASE WHEN n > 20 THEN med ELSE mx END AS cx FROM m {on.format('f')}))"""


CENTRE_SCALE_SQL = f"""WITH p AS ({POINTS_SQL}), {_centre_sql('label', 'JOIN {0} USING (label)')}
  SELECT vec_id, label, {_r('(x - cx) / scale', 'x')}, {_r('(y - cy) / scale', 'y')}, {_r('(z - cz) / scale', 'z')}
  FROM p JOIN c USING (label)"""
CENTRE_WHOLE_SQL = f"""WITH p AS ({POINTS_SQL}), {_centre_sql('', 'CROSS JOIN {0}')}
  SELECT {_r('cx', 'cx')}, {_r('cy', 'cy')}, {_r('cz', 'cz')}, {_r('scale', 'scale')} FROM c"""


def stretched(spark: SparkSession, d: str) -> DataFrame:
    """Points spread over the area where the regions lie."""
    return vectors(spark, d).select(
        "vec_id", (F.col("x") * 2).alias("x"), (F.col("y") * 2).alias("y"), (F.col("z") + 0.6).alias("z")
    )


STRETCHED_SQL = f"SELECT vec_id, x * 2 AS x, y * 2 AS y, z + 0.6::DOUBLE AS z FROM ({POINTS_SQL})"


def _gauss_sql(center, radius: float) -> str:
    squares = " + ".join(f"({c} - ({v}::DOUBLE)) * ({c} - ({v}::DOUBLE))" for c, v in zip("xyz", center))
    return f"exp(-({squares}) / ({radius}::DOUBLE * {radius}::DOUBLE))"


def regions(spark, d):
    return G.region_label(stretched(spark, d)).select("vec_id", "region")


REGIONS_SQL = (
    "SELECT vec_id, CASE "
    + " ".join(
        f"WHEN {' + '.join(_gauss_sql(c, r.radius) for c in r.centers)} > {r.threshold} THEN {r.label}" for r in G.REGIONS
    )
    + f" ELSE 0 END AS region FROM ({STRETCHED_SQL})"
)


def anchors(spark, d):
    weighted = G.anchor_weights(stretched(spark, d)).drop(*G.XYZ)
    return rounded(weighted, *[c for c in weighted.columns if c != "vec_id"])


ANCHORS_SQL = "SELECT vec_id, " + ", ".join(
    _r(_gauss_sql(a.center, a.radius), f"w_{a.name}") for a in G.ANCHORS
) + f" FROM ({STRETCHED_SQL})"


def rotate(spark, d):
    return rounded(G.rotate_y(vectors(spark, d), 35.0), *G.XYZ)


ROTATE_SQL = f"""SELECT vec_id, label, {_r('cos(a) * x + sin(a) * z', 'x')}, {_r('y', 'y')}, {_r('cos(a) * z - sin(a) * x', 'z')}
  FROM (SELECT *, radians(35.0::DOUBLE) AS a FROM ({POINTS_SQL}))"""


# ---- meshes: one per customer, orders as text records ------------------------


def mesh_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a record of its customer's mesh: a vertex, a normal, or a polygon of three to five corners."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    price = F.col("o_totalprice")

    def corner(i: int):
        v = ((k * (i + 3) + i) % 3 + 1).cast("string")
        return F.when((k + i) % 5 == 0, v).otherwise(F.concat_ws("/", v, F.lit(""), ((k + i) % 2 + 1).cast("string")))

    corners = F.slice(F.array(*[corner(i) for i in range(5)]), 1, (k % 3 + 3).cast("int"))
    numbers = F.concat_ws(" ", (price % 7).cast("string"), (price % 11).cast("string"), (k % 13).cast("string"))
    value = (
        F.when(k % 4 == 0, F.concat(F.lit("v "), numbers))
        .when(k % 4 == 1, F.concat(F.lit("vn "), numbers))
        .when(k % 4 == 2, F.concat(F.lit("f "), F.array_join(corners, " ")))
        .otherwise("# note")
    )
    return table(spark, d, "orders").select(
        c.alias("file"), F.floor(k / 1000).alias("block"), k.alias("line"), value.alias("value")
    )


MESH_SQL = """
  rec AS (SELECT o_custkey AS mesh_id, o_orderkey AS k, o_totalprice % 7 AS x, o_totalprice % 11 AS y, (o_orderkey % 13)::DOUBLE AS z
          FROM orders),
  v AS (SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY k) - 1 AS vid, x, y, z FROM rec WHERE k % 4 = 0),
  vn AS (SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY k) - 1 AS nid, x, y, z FROM rec WHERE k % 4 = 1),
  poly AS (SELECT mesh_id, k, i, (k * (i + 3) + i) % 3 AS v, CASE WHEN (k + i) % 5 = 0 THEN 0 ELSE (k + i) % 2 END AS n
           FROM rec, range(0, 5) t(i) WHERE k % 4 = 2 AND i < k % 3 + 3),
  f AS (SELECT a.mesh_id, row_number() OVER (PARTITION BY a.mesh_id ORDER BY a.k, b.i) - 1 AS fid,
               a.v AS v0, b.v AS v1, c.v AS v2, a.n AS n0, b.n AS n1, c.n AS n2
        FROM poly a JOIN poly b ON a.k = b.k AND a.i = 0 AND b.i > 0 JOIN poly c ON c.k = b.k AND c.i = b.i + 1)
"""


def mesh_vertices(spark, d):
    return mesh_tables(mesh_lines(spark, d)).vertices


def mesh_faces(spark, d):
    return mesh_tables(mesh_lines(spark, d)).faces


def normals(spark, d):
    mesh = mesh_tables(mesh_lines(spark, d))
    return rounded(G.vertex_normals(mesh.vertices, mesh.normals, mesh.faces), "nx", "ny", "nz")


NORMALS_SQL = f"""WITH {MESH_SQL},
  c AS (SELECT mesh_id, v0 AS vid, n0 AS nid FROM f UNION ALL SELECT mesh_id, v1, n1 FROM f UNION ALL SELECT mesh_id, v2, n2 FROM f),
  s AS (SELECT c.mesh_id, vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM c JOIN vn USING (mesh_id, nid) GROUP BY ALL),
  u AS (SELECT v.mesh_id, v.vid, coalesce(s.x, 0) AS x, coalesce(s.y, 0) AS y, coalesce(s.z, 0) AS z FROM v LEFT JOIN s USING (mesh_id, vid)),
  l AS (SELECT *, CASE WHEN x <> 0 OR y <> 0 OR z <> 0 THEN sqrt(x * x + y * y + z * z) ELSE 1 END AS len FROM u)
  SELECT mesh_id, vid, {_r('x / len', 'nx')}, {_r('y / len', 'ny')}, {_r('z / len', 'nz')} FROM l"""


def remap(spark, d):
    mesh = mesh_tables(mesh_lines(spark, d))
    cells = G.with_voxel(mesh.vertices, 2, ["mesh_id"])
    return G.remap_faces(mesh.faces, cells, new_id="cell")


REMAP_SQL = f"""WITH {MESH_SQL}, c AS (SELECT mesh_id, vid, {_cell_sql(2, 'xyz', 'PARTITION BY mesh_id')} AS cell FROM v),
  g AS (SELECT f.mesh_id, fid, a.cell AS v0, b.cell AS v1, d.cell AS v2 FROM f
        LEFT JOIN c a ON a.mesh_id = f.mesh_id AND a.vid = v0 LEFT JOIN c b ON b.mesh_id = f.mesh_id AND b.vid = v1
        LEFT JOIN c d ON d.mesh_id = f.mesh_id AND d.vid = v2)
  SELECT * FROM g WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2"""

QUERIES = {
    "q_voxels": (voxels, VOXELS_SQL),
    "q_voxels_whole": (voxels_whole, VOXELS_WHOLE_SQL),
    "q_centre_scale": (centre_scale, CENTRE_SCALE_SQL),
    "q_centre_whole": (centre_whole, CENTRE_WHOLE_SQL),
    "q_regions": (regions, REGIONS_SQL),
    "q_anchor_weights": (anchors, ANCHORS_SQL),
    "q_rotate": (rotate, ROTATE_SQL),
    "q_mesh_vertices": (mesh_vertices, f"WITH {MESH_SQL} SELECT * FROM v"),
    "q_mesh_faces": (mesh_faces, f"WITH {MESH_SQL} SELECT * FROM f"),
    "q_normals": (normals, NORMALS_SQL),
    "q_remap": (remap, REMAP_SQL),
}
