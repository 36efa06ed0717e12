import math
import random

from sparkaudit.operators import points as G
from sparkaudit.sources.meshes import read_meshes

OBJ = """# box
v 0 0 0
v 1 0 0
v 1 1 0
v 0 1 2
vn 0 0 1
vn 0 1 0
f 1//1 2//1 3//2 4//2
f 1/5 2/5/ 3
f 1 2
"""


def test_mesh_text(spark, scratch):
    for name in ("a.obj", "b.obj"):
        open(f"{scratch}/{name}", "w").write(OBJ)
    mesh = read_meshes(spark, scratch)
    assert mesh.vertices.count() == 8 and mesh.normals.count() == 4
    faces = mesh.faces.filter("mesh_id like '%a.obj'").orderBy("fid").collect()
    assert [tuple(r)[1:] for r in faces] == [(0, 0, 1, 2, 0, 0, 1), (1, 0, 2, 3, 0, 1, 1), (2, 0, 1, 2, 0, 0, 0)]
    normals = {r["vid"]: (r["nx"], r["ny"], r["nz"]) for r in G.vertex_normals(*mesh).filter("mesh_id like '%a.obj'").collect()}
    assert normals[0] == (0.0, 0.0, 1.0) and normals[3] == (0.0, 1.0, 0.0)
    assert [round(v, 9) for v in normals[2]] == [0.0, round(2 / math.sqrt(5), 9), round(1 / math.sqrt(5), 9)]
    none = G.vertex_normals(mesh.vertices, mesh.normals.filter("nid > 9"), mesh.faces).collect()
    assert len(none) == 8 and all((r["nx"], r["ny"], r["nz"]) == (0.0, 0.0, 0.0) for r in none)


def test_voxels_and_faces(spark):
    pts = spark.createDataFrame([("m", i, float(i % 4), float(i // 4), 7.0) for i in range(16)],
                                "mesh_id string, vid int, x double, y double, z double")
    cells = G.voxel_centroids(pts, 2, ["mesh_id"]).orderBy("new_id").collect()
    assert [(r["new_id"], r["cell"], r["n"]) for r in cells] == [(0, 0, 4), (1, 2, 4), (2, 4, 4), (3, 6, 4)]
    assert (cells[0]["x"], cells[0]["y"], cells[0]["z"]) == (0.5, 0.5, 7.0)
    faces = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 0, 2, 8), ("m", 2, 0, 3, 15)], "mesh_id string, fid int, v0 int, v1 int, v2 int")
    kept = G.remap_faces(faces, G.with_voxel(pts, 2, ["mesh_id"]), new_id="cell").orderBy("fid").collect()
    assert [tuple(r) for r in kept] == [("m", 1, 0, 4, 2), ("m", 2, 0, 4, 6)]


def test_centre_and_scale(spark, many_segments):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(200)]
    pts = spark.createDataFrame(rows, "vid int, x double, y double, z double")
    centre = G.centre_of(pts, ["vid"]).first()
    zs = sorted(r[3] for r in rows)
    h = 199 * 0.7
    z70 = zs[int(h)] + (zs[int(h) + 1] - zs[int(h)]) * (h - int(h))
    front = sorted(r[1] for r in rows if r[3] >= z70)
    median = (front[(len(front) - 1) // 2] + front[len(front) // 2]) / 2
    assert abs(centre["cx"] - median) < 1e-9 and abs(centre["cy"] - sum(r[2] for r in rows) / 200) < 1e-9
    few = G.centre_of(pts.filter("vid < 30"), ["vid"]).first()
    assert abs(few["cx"] - sum(r[1] for r in rows[:30]) / 30) < 1e-9
    scaled = G.centre_and_scale(pts, ["vid"]).collect()
    assert abs(max(max(abs(r["x"]), abs(r["y"]), abs(r["z"])) for r in scaled) - 1.0) < 1e-9


def test_regions_and_rotation(spark):
    pts = spark.createDataFrame([(0.0, -0.15, 0.64), (0.0, -0.08, 0.70), (0.23, 0.22, 0.63), (0.25, 0.40, 0.55), (9.0, 9.0, 9.0)],
                                "x double, y double, z double")
    assert [r["region"] for r in G.region_label(pts).collect()] == [4, 3, 1, 2, 0]
    weights = G.anchor_weights(pts).first()
    assert abs(weights["w_jaw"] - math.exp(-(0.4**2 + 0.32**2) / 0.34**2)) < 1e-9 and len(weights) == 14
    turned = G.rotate_y(pts, 90.0).first()
    assert abs(turned["x"] - 0.64) < 1e-12 and abs(turned["z"]) < 1e-12
