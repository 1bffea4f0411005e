import json
import struct

import numpy as np
import pytest

from boreal.sources import scan3d


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    n = 5000
    return {"x": rng.uniform(0, 50, n), "y": rng.uniform(0, 40, n), "z": rng.uniform(0, 9, n), "classification": rng.integers(1, 15, n), "intensity": rng.integers(0, 60000, n), "return_number": np.ones(n, int), "number_of_returns": np.full(n, 2), **{c: rng.integers(0, 65000, n) for c in ("red", "green", "blue", "nir")}}


def test_las_round_trip(spark, tmp_path, cloud, monkeypatch):
    monkeypatch.setattr(scan3d, "RECORDS", 1500)
    path = tmp_path / "a.las"
    path.write_bytes(scan3d.las_bytes(cloud, "LOCAL_CS[x]"))
    h = scan3d.las_header(str(path))
    assert (h["version"], h["point_format"], h["points"]) == ("1.4", 8, 5000) and scan3d.is_local_crs(h["wkt"])
    got = scan3d.read_points(spark, str(path)).orderBy("ordinal").toPandas()
    for c in "xyz":
        assert np.abs(got[c] - cloud[c]).max() < 1e-3
    for c in ("classification", "nir", "red", "number_of_returns", "intensity"):
        assert (got[c] == cloud[c]).all()
    assert scan3d.read_points(spark, str(path), 1000).count() == 1000
    made = scan3d.write_las(scan3d.read_points(spark, str(path)).repartition(3), f"file://{tmp_path}/out").collect()
    assert sum(r.points for r in made) == 5000 and scan3d.read_points(spark, str(tmp_path / "out")).count() == 5000
    assert scan3d.crop(scan3d.read_points(spark, str(path)), 0, 0, 25, 40).count() == (cloud["x"].round(3) < 25).sum()


def test_other_formats(spark, tmp_path, cloud):
    x, y, z = (cloud[c][:600] for c in "xyz")
    (tmp_path / "a.xyz").write_text("X Y Z I\n" + "\n".join(f"{a} {b} {c} {-5}" for a, b, c in zip(x, y, z)))
    (tmp_path / "b.csv").write_text("\n".join(f"{a},{b},{c},1,2,3" for a, b, c in zip(x, y, z)))
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 600\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + "\n".join(f"{a} {b} {c}" for a, b, c in zip(x, y, z)) + "\n")
    (tmp_path / "d.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 600\nproperty double x\nproperty double y\nproperty double z\nend_header\n" + np.stack([x, y, z], 1).astype(">f8").tobytes())
    quad = [(0, 0, 0), (10, 0, 0), (10, 10, 0), (0, 10, 5)]
    (tmp_path / "e.obj").write_text("".join("v %f %f %f\n" % q for q in quad) + "f 1 2 3 4\nf -4 -3 -2\n")
    tri = np.array([quad[0], quad[1], quad[2]], "<f4")
    (tmp_path / "f.stl").write_bytes(b"\0" * 80 + struct.pack("<I", 1) + b"\0" * 12 + tri.tobytes() + b"\0\0")
    doc = {"scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "translation": [0, 100, 0]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}], "bufferViews": [{"buffer": 0, "byteLength": 36}], "buffers": [{"byteLength": 36}]}
    j = json.dumps(doc).encode()
    j += b" " * (-len(j) % 4)
    (tmp_path / "g.glb").write_bytes(struct.pack("<4sII", b"glTF", 2, 28 + len(j) + 36) + struct.pack("<I4s", len(j), b"JSON") + j + struct.pack("<I4s", 36, b"BIN\0") + tri.tobytes())
    read = lambda f: scan3d.read_points(spark, str(tmp_path / f)).toPandas()
    for f in ("a.xyz", "b.csv", "c.ply", "d.ply"):
        got = read(f)
        assert len(got) == 600 and abs(got["z"].max() - z.max()) < 1e-4 and (got["classification"] == 1).all()
    assert read("a.xyz")["intensity"].iat[0] == (2048 - 5) * 16 and read("b.csv")["red"].iat[0] == 256
    mesh = read("e.obj")
    assert len(mesh) > 1000 and mesh["x"].between(0, 10).all()
    assert len(read("f.stl")) > 1000 and read("g.glb")["z"].between(100, 110).all()
    with pytest.raises(Exception, match="LAS"):
        (tmp_path / "h.laz").write_bytes(b"")
        read("h.laz")
    assert scan3d.up_axis(x, y / 100, z * 10) == "y" and scan3d.up_axis(x, y, z) == "z"
