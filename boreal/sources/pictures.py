"""What pictures say of themselves: position, lens and attitude from the heads of files, world files and raster tags, and their pixels on a site's grid.

Files are read by Spark's binaryFile and text sources from any store; a task sees the first `HEAD` bytes of a file, never its image. Decoding images is the landing job's work; pixels come as a table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.functions import geo

HEAD = 400_000
META = "path string, width int, height int, make string, model string, focal_mm double, focal35_mm double, lat double, lon double, gps_alt double, rel_alt double, pitch double, yaw double, tie_x double, tie_y double, pixel_m double"
# Tag numbers of the public formats.
WIDTH, HEIGHT, MAKE, MODEL, EXIF, GPS, FOCAL, FOCAL35, PIXEL_SCALE, TIE_POINT = 256, 257, 271, 272, 34665, 34853, 37386, 41989, 33550, 33922
LAT_REF, LAT, LON_REF, LON, ALT_REF, ALT = 1, 2, 3, 4, 5, 6
#: Size and struct letter of a value by its type number.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
XMP = {"RelativeAltitude": "rel_alt", "GimbalPitchDegree": "pitch", "GimbalYawDegree": "yaw", "GpsLatitude": "lat", "GpsLongitude": "lon", "GpsLongtitude": "lon"}


def directory(data: bytes, at: int, order: str) -> dict[int, tuple]:
    """The values of one tag directory; entries that point beyond the bytes at hand are left out."""
    out: dict[int, tuple] = {}
    if at + 2 > len(data):
        return out
    (n,) = struct.unpack_from(order + "H", data, at)
    for k in range(n):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind not in KINDS:
            continue
        size, letter = KINDS[kind]
        place = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if place + size * count > len(data):
            continue
        if letter == "s":
            out[tag] = (data[place : place + count].split(b"\0")[0].decode("latin-1").strip(),)
        else:
            v = struct.unpack_from(order + letter * count, data, place)
            out[tag] = tuple(a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)) if len(letter) == 2 else v
    return out


def tags(data: bytes) -> dict[str, object]:
    """Fields of META from the bytes of a tagged image file (or of the block that a camera puts in its pictures)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}
    base = directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
    sub = directory(data, base[EXIF][0], order) if EXIF in base else {}
    gps = directory(data, base[GPS][0], order) if GPS in base else {}
    one = lambda d, tag: d[tag][0] if d.get(tag) else None

    def angle(tag: int, ref: int, negative: str) -> float | None:
        v = gps.get(tag)
        if not v or len(v) < 3:
            return None
        a = v[0] + v[1] / 60 + v[2] / 3600
        return -a if str(one(gps, ref) or "").upper().startswith(negative) else a

    out = {"make": one(base, MAKE), "model": one(base, MODEL), "focal_mm": one(sub, FOCAL) or one(base, FOCAL), "focal35_mm": one(sub, FOCAL35) or one(base, FOCAL35), "lat": angle(LAT, LAT_REF, "S"), "lon": angle(LON, LON_REF, "W"), "gps_alt": one(gps, ALT)}
    if one(gps, ALT_REF) == 1 and out["gps_alt"] is not None:
        out["gps_alt"] = -out["gps_alt"]  # below the sea
    out |= {"width": one(base, WIDTH), "height": one(base, HEIGHT)}
    if len(base.get(TIE_POINT, ())) >= 6 and base.get(PIXEL_SCALE):
        scale = base[PIXEL_SCALE][0]
        tie = base[TIE_POINT]
        out |= {"tie_x": tie[3] - tie[0] * scale, "tie_y": tie[4] + tie[1] * scale, "pixel_m": scale}
    return {k: v for k, v in out.items() if v is not None}


def head_fields(data: bytes) -> dict[str, object]:
    """Fields of META from the first bytes of a picture: a walk over the segments of a JPEG, or the directories of a TIFF. Bytes of anything else, or cut off, give what they hold."""
    found = tags(data)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                found |= tags(data[at + 10 : at + 2 + size])
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(data):
                found["height"], found["width"] = struct.unpack_from(">HH", data, at + 5)
            if mark == 0xDA:
                break
            at += 2 + size
    begin = data.find(b"<x:xmpmeta")
    if begin >= 0:
        text = data[begin : data.find(b"</x:xmpmeta>", begin) % (len(data) + 1)].decode("utf-8", "replace")
        for key, name in XMP.items():
            m = re.search(rf'drone-dji:{key}(?:\s*=\s*"|>)([-+0-9.eE]+)["<]', text)
            if m and (name not in found or name not in ("lat", "lon")):
                found[name] = float(m.group(1))
    return found


def picture_meta(spark: SparkSession, path: str) -> DataFrame:
    """A row of META for each file of the folder that has a byte; null where a file does not say."""
    names = [c.split()[0] for c in META.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for n, c in zip(names, META.split(", "), strict=True)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [{"path": p, **head_fields(h or b"")} for p, h in zip(batch.column("path").to_pylist(), batch.column("head").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{n: float(r[n]) if schema.field(n).type == pa.float64() and r.get(n) is not None else r.get(n) for n in names} for r in rows], schema)

    return spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEAD).alias("head")).mapInArrow(run, META)


def ground_sample_m(rel_alt: Column, focal_mm: Column, focal35_mm: Column, width: Column) -> Column:
    """Metres a pixel of a picture straight down: height * 36 mm / focal length for 35 mm film / width; small drone sensors have 4.8 times their focal length, and 24 mm where nothing is known. Null without a height above ground."""
    lens = F.coalesce(F.when(focal35_mm > 0, focal35_mm), F.when(focal_mm > 0, focal_mm * 4.8), F.lit(24.0))
    return F.when(rel_alt > 0, rel_alt * 36.0 / lens / width)


def stem(path: Column) -> Column:
    """The path without its last suffix."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def world_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, west, north, pixel_m) of the world files under a path: the outer corner of the first pixel, as the file has the centre of it. Turned pictures are not read."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.try_cast("double")).alias("v"))
    v = lambda k: F.element_at("v", k)
    good = text.filter((F.size("v") >= 6) & (v(2) == 0) & (v(3) == 0) & (v(1) > 0))
    return good.select(stem(F.col("p")).alias("stem"), (v(5) - v(1) / 2).alias("west"), F.when(v(4) < 0, v(6) - v(4) / 2).otherwise(v(6)).alias("north"), v(1).alias("pixel_m"))


def georeferenced(meta: DataFrame, world: DataFrame) -> DataFrame:
    """(path, west, north, pixel_m): from the picture's world file, or its raster tags; pictures with neither are left out."""
    m = meta.withColumn("stem", stem(F.col("path"))).join(world.select("stem", "west", "north", F.col("pixel_m").alias("w_pixel")), "stem", "left")
    out = m.select("path", F.coalesce("west", "tie_x").alias("west"), F.coalesce("north", "tie_y").alias("north"), F.coalesce("w_pixel", "pixel_m").alias("pixel_m"))
    return out.filter("west IS NOT NULL AND north IS NOT NULL AND pixel_m > 0")


def on_grid(cells: DataFrame, places: DataFrame, pixels: DataFrame, key: str, x0: float, y0: float, res: float) -> DataFrame:
    """Cells (iy, ix) of a site with the values of the nearest pixel of each picture that covers them: (key, iy, ix, values). places: key, west, north, pixel_m; pixels: key, row (from the north), col, values. A cell and a picture meet on squares of the picture's own size in cells, so that pictures far away cost nothing."""
    size = 256.0
    x, y = x0 + (F.col("ix") + 0.5) * res, y0 + (F.col("iy") + 0.5) * res
    extent = pixels.groupBy(key).agg((F.max("col") + 1).alias("cols"), (F.max("row") + 1).alias("rows"))
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    p = places.join(extent, key).withColumn("qx", F.explode(span(F.col("west"), F.col("west") + F.col("cols") * F.col("pixel_m")))).withColumn("qy", F.explode(span(F.col("north") - F.col("rows") * F.col("pixel_m"), F.col("north"))))
    c = cells.select("iy", "ix", x.alias("x"), y.alias("y")).withColumns({"qx": F.floor(F.col("x") / size), "qy": F.floor(F.col("y") / size)})
    at = c.join(p, ["qx", "qy"]).select(key, "iy", "ix", F.floor((F.col("north") - F.col("y")) / F.col("pixel_m")).cast("int").alias("row"), F.floor((F.col("x") - F.col("west")) / F.col("pixel_m")).cast("int").alias("col"))
    return at.join(pixels, [key, "row", "col"]).drop("row", "col")


def mosaic(cells: DataFrame, tile_pixels: DataFrame, zoom: int, east0: float, north0: float, res: float, size: int = 256) -> DataFrame:
    """Cells (iy, ix) of a site in TM35FIN with the values of map tiles' nearest pixels: (iy, ix, values). tile_pixels: px, py (on the map's grid of pixels at the zoom, from the north), values; null outside all tiles."""
    lat, lon = geo.tm35fin_inverse(F.lit(east0) + (F.col("ix") + 0.5) * res, F.lit(north0) + (F.col("iy") + 0.5) * res)
    fx, fy = geo.tile_xy(F.col("lat"), F.col("lon"), zoom)
    c = cells.select("iy", "ix", lat.alias("lat"), lon.alias("lon")).select("iy", "ix", F.floor(fx * size).alias("px"), F.floor(fy * size).alias("py"))
    return c.join(tile_pixels.withColumns({"px": F.col("px").cast("long"), "py": F.col("py").cast("long")}), ["px", "py"], "left").drop("px", "py")
