"""Writers: work orders, GeoJSON, binary point clouds, layer pictures, batch reports."""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for numbers that JSON has not."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def work_order(ranked: DataFrame, path: str) -> None:
    """Ranked rows as one CSV with a header, in order of rank."""
    ranked.orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def feature(properties: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """A GeoJSON point feature as JSON text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def write_geojson(df: DataFrame, properties: list[str], path: str) -> None:
    """One feature a line, in as many files as there are partitions: GeoJSON text sequences, which readers take in parallel."""
    df.select(feature(properties).alias("value")).write.mode("overwrite").text(path)


def sampled_points(points: DataFrame, n_rows: int, most: int = 600_000) -> DataFrame:
    """At most `most` points, the same each time, by a hash of their place."""
    return points if n_rows <= most else points.orderBy(F.xxhash64("x", "y", "z"), "x", "y", "z").limit(most)


def point_cloud_bytes(points: DataFrame, columns: list[str]) -> bytes:
    """Length, JSON head, float32 x y z, then a byte a point for each column. For a bounded sample (sampled_points)."""
    p = points.select("x", "y", "z", *columns).toPandas()
    head = json.dumps({"n": len(p), "columns": columns}).encode()
    return struct.pack("<I", len(head)) + head + p[["x", "y", "z"]].to_numpy("<f4").tobytes() + b"".join(np.clip(p[c].to_numpy(), 0, 255).astype(np.uint8).tobytes() for c in columns)


def scaled_byte(c: Column, lo: float, hi: float) -> Column:
    return F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - lo) / (hi - lo)))).cast("int")


def fire_byte(arrival: Column, minutes: float = 240.0) -> Column:
    """1..255 by the time fire arrives; 0: it does not."""
    return F.when(arrival.isNull(), 0).otherwise(F.greatest(F.lit(1), F.round(255 * (1 - F.least(arrival / minutes, F.lit(1.0)))).cast("int")))


def hillshade(slope_deg: Column, aspect_deg: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    z, s, a = F.radians(F.lit(90 - altitude)), F.radians(slope_deg), F.radians(F.lit(azimuth) - aspect_deg)
    return F.greatest(F.lit(0.0), F.cos(z) * F.cos(s) + F.sin(z) * F.sin(s) * F.cos(a))


def ramp(value: Column, lo: float, hi: float, colours: list[tuple[int, int, int]]) -> list[Column]:
    """Red, green, blue of a value on a scale of evenly spaced colours."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo))) * (len(colours) - 1)
    k = F.least(F.floor(t), F.lit(len(colours) - 2)).cast("int")
    channel = lambda i: F.array(*[F.lit(float(c[i])) for c in colours])
    return [F.round(F.get(channel(i), k) + (t - k) * (F.get(channel(i), k + 1) - F.get(channel(i), k))).cast("int") for i in range(3)]


def png(rgb: np.ndarray) -> bytes:
    """An RGB picture (rows north to south) as PNG."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def layer_png(cells: DataFrame, value: str, nx: int, ny: int, lo: float, hi: float, colours: list[tuple[int, int, int]]) -> bytes:
    """A layer of one site (nx * ny cells) as a picture; cells run south to north, pictures north to south."""
    p = cells.select("iy", "ix", *[c.alias(n) for n, c in zip("rgb", ramp(F.col(value), lo, hi, colours), strict=True)]).toPandas()
    out = np.zeros((ny, nx, 3), np.uint8)
    out[ny - 1 - p["iy"], p["ix"]] = p[["r", "g", "b"]].fillna(0).to_numpy()
    return png(out)


UPLOADS = {".las": b"LASF", ".laz": b"LASF", ".ply": b"ply", ".glb": b"glTF", ".jpg": b"\xff\xd8", ".png": b"\x89PNG"}


def upload_fault(name: str, head: bytes, size: int, most: int = 4 << 30) -> str | None:
    """Why a landed file is refused, or None: its name, its size, or that it does not start as its kind does."""
    suffix = "." + name.rsplit(".", 1)[-1].lower()
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,120}", name) or name.startswith("."):
        return "name"
    if not 0 < size <= most:
        return "size"
    return "kind" if suffix in UPLOADS and not head.startswith(UPLOADS[suffix]) else None
