"""Mesh files of polygons, scenes of several, round trips."""

import numpy as np
import pytest

from pointloom.sources import meshes


def vertices_of(df):
    return [tuple(r) for r in df.orderBy("vid").select("vid", "x", "y", "z").collect()]


def faces_of(df):
    return [tuple(r) for r in df.orderBy("fid").select("a", "b", "c").collect()]


OBJ = "# cube corner\nmtllib x\nv 0 0 0\nv 1 0 0 0.5\nv 1 1 0  # note\nvn 0 0 1\nf 1//1 2//1 3//1\nv 0 1 0\ng side\nf 1/1 2/2 3/3 4/4\nf -4 -2 -1\nf 1 2\n"
WANT = [(0, 1, 2), (0, 1, 2), (0, 2, 3), (0, 2, 3)]


def test_obj_polygons_and_relative_corners(spark, tmp_path):
    (tmp_path / "a.obj").write_text(OBJ)
    v, f = meshes.read_obj(spark, f"file://{tmp_path}/a.obj")
    assert vertices_of(v) == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0)] and faces_of(f) == WANT
    (tmp_path / "b.obj").write_text("v 9 9 9\nv 8 9 9\nv 9 8 9\nf 1 2 3\n")
    v, f = meshes.read_obj(spark, f"file://{tmp_path}")
    assert vertices_of(v)[4] == (4, 9, 9, 9) and faces_of(f) == [*WANT, (4, 5, 6)]


def test_obj_cut_at_lines(spark, tmp_path):
    """A file of many splits gives what it gives whole."""
    rng = np.random.default_rng(0)
    lines = []
    for i in range(900):
        lines.append("v " + " ".join(f"{x:.6f}" for x in rng.normal(size=3)))
        if i > 3 and i % 3 == 0:
            lines.append(f"f {i} {i - 1} {i - 2} {i - 3}" if i % 2 else "f -1 -2 -3")
    (tmp_path / "a.obj").write_text("\n".join(lines) + "\n")
    whole = meshes.read_obj(spark, f"file://{tmp_path}/a.obj")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        cut = meshes.read_obj(spark, f"file://{tmp_path}/a.obj")
        assert spark.read.text(f"file://{tmp_path}/a.obj").rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert vertices_of(cut[0]) == vertices_of(whole[0]) and faces_of(cut[1]) == faces_of(whole[1])
    assert [f"v {x:.6f} {y:.6f} {z:.6f}" for _, x, y, z in vertices_of(cut[0])] == [x for x in lines if x[0] == "v"]


def test_obj_round_trip(spark, tmp_path):
    (tmp_path / "a.obj").write_text(OBJ)
    v, f = meshes.read_obj(spark, f"file://{tmp_path}/a.obj")
    meshes.write_obj(v, f, f"file://{tmp_path}/out")
    v2, f2 = meshes.read_obj(spark, f"file://{tmp_path}/out", one=True)
    assert vertices_of(v2) == vertices_of(v) and faces_of(f2) == WANT
    assert [round(r.area, 6) for r in meshes.areas(v2, f2).orderBy("fid").collect()] == [0.5] * 4


def ply_file(vertices, faces):
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    return head.encode() + np.array(vertices, "<f4").tobytes() + b"".join(bytes([len(f)]) + np.array(f, "<i4").tobytes() for f in faces)


def test_ply_scene_of_two_meshes(spark, tmp_path):
    square = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    (tmp_path / "a.ply").write_bytes(ply_file(square, [(0, 1, 2, 3)]))
    (tmp_path / "b.ply").write_bytes(ply_file(square[:3], [(2, 1, 0)]))
    v, f = meshes.read_ply(spark, f"file://{tmp_path}", 24)
    assert len(vertices_of(v)) == 7 and vertices_of(v)[4] == (4, 0, 0, 0) and faces_of(f) == [(0, 1, 2), (0, 2, 3), (6, 5, 4)]
    (tmp_path / "c.ply").write_bytes(ply_file(square[:3], [(0, 1, 3)]))  # no such corner in its own file
    with pytest.raises(ValueError, match="a corner"):
        meshes.read_ply(spark, f"file://{tmp_path}")


def test_empty_meshes_are_errors(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 1 2 3\n")
    with pytest.raises(ValueError, match="1 vertices and 0 triangles"):
        meshes.read_obj(spark, f"file://{tmp_path}/a.obj")
    (tmp_path / "a.ply").write_bytes(ply_file([], []))
    with pytest.raises(ValueError, match="0 vertices"):
        meshes.read_ply(spark, f"file://{tmp_path}/a.ply")
    (tmp_path / "b.obj").write_text("v 1 2 3\nf 1 2 9\n")
    with pytest.raises(ValueError, match="a corner"):
        meshes.read_obj(spark, f"file://{tmp_path}/b.obj")
