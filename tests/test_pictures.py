"""Heads of hand-made picture files, and pixels on a site's grid against a plain lookup."""

import math
import struct

from pyspark.sql import functions as F

from boreal.functions import geo
from boreal.sources import pictures as P


def ifd(entries, at, order):
    """A tag directory whose long values follow it; entries: (tag, type, packed values, count)."""
    head, tail, after = struct.pack(order + "H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, data, count in entries:
        head += struct.pack(order + "HHI", tag, kind, count) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", after + len(tail)))
        tail += data if len(data) > 4 else b""
    return head + struct.pack(order + "I", 0) + tail


def camera_block(order="<"):
    ratio = lambda *v: b"".join(struct.pack(order + "II", round(x * 1000), 1000) for x in v)
    gps_at, sub_at = 300, 600
    base = ifd([(271, 2, b"ACME\0", 5), (272, 2, b"F1\0", 3), (34665, 4, struct.pack(order + "I", sub_at), 1), (34853, 4, struct.pack(order + "I", gps_at), 1)], 8, order)
    gps = ifd([(1, 2, b"N\0", 2), (2, 5, ratio(62, 30, 36), 3), (3, 2, b"W\0", 2), (4, 5, ratio(27, 15, 0), 3), (5, 1, b"\1", 1), (6, 5, ratio(3.5), 1)], gps_at, order)
    sub = ifd([(37386, 5, ratio(12.3), 1), (41989, 3, struct.pack(order + "H", 24), 1)], sub_at, order)
    block = bytearray(900)
    for at, part in ((0, ({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8))), (8, base), (gps_at, gps), (sub_at, sub)):
        block[at : at + len(part)] = part
    return bytes(block)


def jpeg(order="<", xmp=b""):
    seg = lambda mark, data: b"\xff" + bytes([mark]) + struct.pack(">H", len(data) + 2) + data
    return b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + camera_block(order)) + (seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp) if xmp else b"") + seg(0xC0, struct.pack(">BHH", 8, 3000, 4000) + b"\3" * 10) + seg(0xDA, b"\0" * 10) + b"\x11" * 500_000


XMP = b'<x:xmpmeta><rdf drone-dji:RelativeAltitude="+80.5" drone-dji:GpsLatitude="1.0"/><drone-dji:GimbalPitchDegree>-90.0</drone-dji:GimbalPitchDegree></x:xmpmeta>'


def tiff():
    scale, tie = struct.pack("<3d", 0.5, 0.5, 0), struct.pack("<6d", 10, 20, 0, 500_000.0, 7_000_000.0, 0)
    return b"II" + struct.pack("<HI", 42, 8) + ifd([(256, 3, struct.pack("<H", 640), 1), (257, 3, struct.pack("<H", 480), 1), (33550, 12, scale, 3), (33922, 12, tie, 6)], 8, "<")


def test_heads_of_files(spark, tmp_path):
    files = {"a.jpg": jpeg("<", XMP), "b.jpg": jpeg(">"), "c.tif": tiff(), "d.jpg": b"\xff\xd8\xff", "e.png": b"\x89PNG junk", "f.jpg": b"\xff", "g.jpg": jpeg()[:120]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in P.picture_meta(spark, str(tmp_path)).collect()}
    assert set(got) == set(files)
    for name in ("a.jpg", "b.jpg"):
        r = got[name]
        assert (r.make, r.model, r.width, r.height, r.focal35_mm) == ("ACME", "F1", 4000, 3000, 24) and abs(r.focal_mm - 12.3) < 1e-9
        assert abs(r.lat - (62 + 30 / 60 + 36 / 3600)) < 1e-9 and abs(r.lon + 27.25) < 1e-9 and r.gps_alt == -3.5
    assert (got["a.jpg"].rel_alt, got["a.jpg"].pitch, got["b.jpg"].rel_alt) == (80.5, -90.0, None)
    assert (got["c.tif"].width, got["c.tif"].tie_x, got["c.tif"].tie_y, got["c.tif"].pixel_m) == (640, 500_000 - 5, 7_000_000 + 10, 0.5)
    assert all(got[n].lat is None and got[n].width is None for n in ("d.jpg", "e.png", "f.jpg"))
    gsd = P.picture_meta(spark, str(tmp_path)).select("path", P.ground_sample_m(*map(F.col, ("rel_alt", "focal_mm", "focal35_mm", "width"))).alias("m")).collect()
    assert {r.path.rsplit("/", 1)[1]: r.m for r in gsd}["a.jpg"] == 80.5 * 36 / 24 / 4000 and sum(r.m is not None for r in gsd) == 1


def test_world_files_and_grid(spark, tmp_path):
    """Two pictures, one by its world file, one by its tags, over a site: every cell has the pixel that a plain lookup finds."""
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"\x89PNG")
    (tmp_path / "img" / "c.tif").write_bytes(tiff())
    (tmp_path / "img" / "x.png").write_bytes(b"\x89PNG")
    (tmp_path / "world").mkdir()
    (tmp_path / "world" / "a.pgw").write_text("2.0\n0\n0\n-2.0\n500001.0\n7000099.0\n")
    (tmp_path / "world" / "x.pgw").write_text("2.0\n0.1\n0\n-2.0\n1\n1\n")  # turned: not read
    meta = P.picture_meta(spark, str(tmp_path / "img"))
    world = P.world_files(spark, str(tmp_path / "world")).withColumn("stem", F.regexp_replace("stem", "/world/", "/img/"))
    places = {r.path.rsplit("/", 1)[1]: r for r in P.georeferenced(meta, world).collect()}
    assert set(places) == {"a.png", "c.tif"} and (places["a.png"].west, places["a.png"].north, places["a.png"].pixel_m) == (500_000.0, 7_000_100.0, 2.0)
    table = spark.createDataFrame([(n, float(r.west), float(r.north), float(r.pixel_m)) for n, r in places.items()], "name string, west double, north double, pixel_m double")
    sizes = {"a.png": (30, 40), "c.tif": (50, 60)}
    pixels = spark.createDataFrame([(n, r, c, 1000 * r + c) for n, (h, w) in sizes.items() for r in range(h) for c in range(w)], "name string, row int, col int, v int")
    cells = spark.createDataFrame([(y, x) for y in range(40) for x in range(40)], "iy int, ix int")
    x0, y0, res = 499_990.0, 6_999_990.0, 3.0
    got = {(r.name, r.iy, r.ix): r.v for r in P.on_grid(cells, table, pixels, "name", x0, y0, res).collect()}
    want = {}
    for n, p in places.items():
        for y in range(40):
            for x in range(40):
                r, c = math.floor((p.north - (y0 + (y + 0.5) * res)) / p.pixel_m), math.floor((x0 + (x + 0.5) * res - p.west) / p.pixel_m)
                if 0 <= r < sizes[n][0] and 0 <= c < sizes[n][1]:
                    want[n, y, x] = 1000 * r + c
    assert got == want and {n for n, _, _ in want} == set(sizes)


def test_mosaic_of_tiles(spark):
    """Cells near a tile border take the pixel that their longitude and latitude fall in; outside all tiles there is none."""
    cells = spark.createDataFrame([(y, x) for y in range(6) for x in range(6)], "iy int, ix int")
    lat, lon = geo.tm35fin_inverse(F.lit(500_000.0) + (F.col("ix") + 0.5) * 40, F.lit(6_900_000.0) + (F.col("iy") + 0.5) * 40)
    at = {(r.iy, r.ix): (r.lat, r.lon) for r in cells.select("iy", "ix", lat.alias("lat"), lon.alias("lon")).collect()}
    n = 2**14 * 256
    place = {k: (math.floor((lo + 180) / 360 * n), math.floor((1 - math.asinh(math.tan(math.radians(la))) / math.pi) / 2 * n)) for k, (la, lo) in at.items()}
    known = {p: i for i, p in enumerate(sorted(set(place.values()))) if i % 5}
    tiles = spark.createDataFrame([(*p, v) for p, v in known.items()], "px long, py long, v int")
    got = {(r.iy, r.ix): r.v for r in P.mosaic(cells, tiles, 14, 500_000.0, 6_900_000.0, 40.0).collect()}
    assert got == {k: known.get(p) for k, p in place.items()} and None in got.values()
