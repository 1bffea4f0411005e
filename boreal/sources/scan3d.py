"""3D scans as a Spark data source: spark.read.format("scan3d").load(path).

LAS files (1.2-1.4) are read by record ranges, one task each; PLY, OBJ, STL, GLB and text files are read whole, one task a file.
Rows: x, y, z, classification, return_number, number_of_returns, intensity, red, green, blue, nir (null where the format lacks them), src, ordinal.
Compressed LAZ and E57 need libraries that are not part of this package and raise an error that says so.
"""

from __future__ import annotations

import glob
import json
import math
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "x double, y double, z double, classification int, return_number int, number_of_returns int, intensity int, red int, green int, blue int, nir int, src string, ordinal long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.float64()] * 3 + [pa.int32()] * 8 + [pa.string(), pa.int64()]
SUFFIXES = (".las", ".laz", ".ply", ".obj", ".glb", ".gltf", ".stl", ".xyz", ".txt", ".csv", ".pts", ".e57")
RECORDS = 500_000
# Byte offset of red in point formats that have colours, and of near infrared, fixed values.
RED_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
NIR_AT = {8: 36, 10: 36}


def local_path(path: str) -> str:
    return path.removeprefix("file://")


def las_header(path: str) -> dict:
    """version, point_format, points, bounds, scale, offset, record length, start of the records, wkt."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        h = f.read(375)
        if h[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        minor, header_size, start, n_vlr, fmt, length, n = h[25], *struct.unpack_from("<HIIBHI", h, 94)
        fmt &= 0x3F
        if minor >= 4 and header_size >= 375:
            n = struct.unpack_from("<Q", h, 247)[0] or n
        numbers = struct.unpack_from("<12d", h, 131)
        f.seek(header_size)
        wkt = ""
        for _ in range(n_vlr):
            v = f.read(54)
            user, record, more = v[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", v, 18)
            body = f.read(more)
            if user == b"LASF_Projection" and record == 2112:
                wkt = body.rstrip(b"\0").decode("utf-8", "replace")
    xmax, xmin, ymax, ymin, zmax, zmin = numbers[6:]
    return {"version": f"1.{minor}", "point_format": fmt, "points_in_file": n, "points": min(n, (size - start) // length), "bounds": [xmin, ymin, zmin, xmax, ymax, zmax], "scale": numbers[:3], "offset": numbers[3:6], "length": length, "start": start, "wkt": wkt}


def is_local_crs(wkt: str) -> bool:
    return bool(re.search("LOCAL_CS|ENGCRS|NO GEODETIC", wkt.upper()))


def las_records(path: str, h: dict, first: int, n: int) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r", h["start"] + first * h["length"], (n, h["length"]))
    at = lambda o, kind: np.ascontiguousarray(raw[:, o : o + np.dtype(kind).itemsize]).view(kind)[:, 0]
    out = {c: at(4 * k, "<i4") * h["scale"][k] + h["offset"][k] for k, c in enumerate("xyz")}
    out["intensity"] = at(12, "<u2")
    returns = raw[:, 14]
    if h["point_format"] <= 5:
        out |= {"return_number": returns & 7, "number_of_returns": returns >> 3 & 7, "classification": raw[:, 15] & 31}
    else:
        out |= {"return_number": returns & 15, "number_of_returns": returns >> 4, "classification": raw[:, 16]}
    if (o := RED_AT.get(h["point_format"])) is not None:
        out |= {c: at(o + 2 * k, "<u2") for k, c in enumerate(("red", "green", "blue"))}
    if (o := NIR_AT.get(h["point_format"])) is not None:
        out["nir"] = at(o, "<u2")
    return out


def fan(faces: list[list[int]]) -> np.ndarray:
    """Polygons as triangles about their first corner."""
    return np.array([(f[0], f[k], f[k + 1]) for f in faces for k in range(1, len(f) - 1)], np.int64).reshape(-1, 3)


def read_ply(path: str) -> tuple[dict, np.ndarray | None]:
    with open(path, "rb") as f:
        data = f.read()
    end = data.index(b"end_header") + len(b"end_header")
    end += 2 if data[end : end + 2] == b"\r\n" else 1
    kinds = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
    form, elements = "ascii", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], None if w[1] == "list" else kinds[w[1]], (kinds[w[2]], kinds[w[3]]) if w[1] == "list" else None))
    order, at, vertex, faces = ">" if "big" in form else "<", end, {}, None
    lines = data[end:].decode("ascii", "replace").split("\n") if form == "ascii" else []
    row = 0
    for name, n, props in elements:
        lists = any(p[2] for p in props)
        if form == "ascii":
            part, row = [r.split() for r in lines[row : row + n]], row + n
            if name == "vertex":
                vertex = {p[0]: np.array([float(r[k]) for r in part]) for k, p in enumerate(props)}
            elif name == "face":
                faces = fan([[int(v) for v in r[1 : 1 + int(r[0])]] for r in part])
        elif not lists:
            kind = np.dtype([(p[0], order + p[1]) for p in props])
            rows = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
            if name == "vertex":
                vertex = {p[0]: rows[p[0]].astype(float) for p in props}
        else:
            found = []
            for _ in range(n):
                for _, kind, many in props:
                    if many:
                        count = int(np.frombuffer(data, order + many[0], 1, at)[0])
                        at += np.dtype(many[0]).itemsize
                        found.append(np.frombuffer(data, order + many[1], count, at).tolist())
                        at += count * np.dtype(many[1]).itemsize
                    else:
                        at += np.dtype(kind).itemsize
            faces = fan(found) if name == "face" else faces
    for c, names in {"red": ("red", "r", "diffuse_red"), "green": ("green", "g", "diffuse_green"), "blue": ("blue", "b", "diffuse_blue"), "intensity": ("intensity", "scalar_Intensity", "scalar_intensity")}.items():
        if hit := next((k for k in names if k in vertex), None):
            vertex[c] = vertex[hit]
    if "intensity" in vertex and len(vertex["intensity"]) and vertex["intensity"].max() <= 1:
        vertex["intensity"] = vertex["intensity"] * 65535
    return {k: vertex[k] for k in COLUMNS if k in vertex}, faces


def read_obj(path: str) -> tuple[dict, np.ndarray | None]:
    v, faces = [], []
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            w = line.split()
            if w[:1] == ["v"]:
                v.append([float(x) for x in w[1:7]])
            elif w[:1] == ["f"]:
                index = [int(x.split("/")[0]) for x in w[1:]]
                faces.append([k - 1 if k > 0 else len(v) + k for k in index])
    width = min(map(len, v)) if v else 3
    a = np.array([r[:width] for r in v]).reshape(-1, width)
    names = ["x", "y", "z", *(["red", "green", "blue"] if width >= 6 else [])]
    return {c: a[:, k] for k, c in enumerate(names)}, fan(faces) if faces else None


def read_stl(path: str) -> tuple[dict, np.ndarray | None]:
    with open(path, "rb") as f:
        data = f.read()
    n = struct.unpack_from("<I", data, 80)[0] if len(data) >= 84 else -1
    if len(data) == 84 + 50 * n:
        rows = np.frombuffer(data, np.dtype([("normal", "<3f4"), ("corners", "<9f4"), ("attr", "<u2")]), n, 84)
        p = rows["corners"].reshape(-1, 3).astype(float)
    else:
        p = np.array(re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data), dtype="S32").astype(float).reshape(-1, 3)
    return {c: p[:, k] for k, c in enumerate("xyz")}, np.arange(len(p)).reshape(-1, 3)


def node_matrix(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r * np.array(node.get("scale", (1, 1, 1))), node.get("translation", (0, 0, 0))
    return m


def read_glb(path: str) -> tuple[dict, np.ndarray | None]:
    """Triangles of all nodes in scene space; always with y up."""
    with open(path, "rb") as f:
        data = f.read()
    if data[:4] == b"glTF":
        at, chunks = 12, {}
        while at + 8 <= len(data):
            n, kind = struct.unpack_from("<I4s", data, at)
            chunks[kind], at = data[at + 8 : at + 8 + n], at + 8 + n
        doc, buffers = json.loads(chunks[b"JSON"]), [chunks.get(b"BIN\0", b"")]
    else:
        doc, buffers = json.loads(data), []
        for b in doc.get("buffers", []):
            with open(os.path.join(os.path.dirname(path), b["uri"]), "rb") as f:
                buffers.append(f.read())
    kinds, widths = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}, {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}

    def accessor(k: int) -> np.ndarray:
        a = doc["accessors"][k]
        view, kind, width = doc["bufferViews"][a["bufferView"]], np.dtype(kinds[a["componentType"]]), widths[a["type"]]
        start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
        stride = view.get("byteStride") or kind.itemsize * width
        out = np.lib.stride_tricks.as_strided(np.frombuffer(buffers[view["buffer"]], kind, offset=start, count=(len(buffers[view["buffer"]]) - start) // kind.itemsize), (a["count"], width), (stride, kind.itemsize)).astype(float)
        return out / np.iinfo(kind).max if a.get("normalized") else out

    points, colours, faces, total = [], [], [], 0
    todo = [(k, np.eye(4)) for k in doc["scenes"][doc.get("scene", 0)]["nodes"]] if "scenes" in doc else [(k, np.eye(4)) for k in range(len(doc.get("nodes", [])))]
    while todo:
        k, above = todo.pop()
        node = doc["nodes"][k]
        m = above @ node_matrix(node)
        todo += [(c, m) for c in node.get("children", [])]
        for part in doc["meshes"][node["mesh"]]["primitives"] if "mesh" in node else []:
            if part.get("mode", 4) != 4:
                continue
            p = accessor(part["attributes"]["POSITION"])
            index = accessor(part["indices"]).astype(np.int64)[:, 0] if "indices" in part else np.arange(len(p))
            points.append(p @ m[:3, :3].T + m[:3, 3])
            colours.append(accessor(part["attributes"]["COLOR_0"])[:, :3] if "COLOR_0" in part["attributes"] else np.full((len(p), 3), np.nan))
            faces.append(index.reshape(-1, 3) + total)
            total += len(p)
    p, c = np.concatenate(points) if points else np.empty((0, 3)), np.concatenate(colours) if colours else np.empty((0, 3))
    out = {n: p[:, k] for k, n in enumerate("xyz")}
    if len(c) and not np.isnan(c).any():
        out |= {n: c[:, k] for k, n in enumerate(("red", "green", "blue"))}
    return out, np.concatenate(faces) if faces else None


def read_text(path: str) -> tuple[dict, None]:
    rows = []
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            try:
                rows.append([float(v) for v in re.split(r"[,;\s]+", line.strip()) if v])
            except ValueError:
                continue  # a header
    rows = [r for r in rows if len(r) >= 3]
    width = min(map(len, rows)) if rows else 3
    a = np.array([r[:width] for r in rows]).reshape(-1, width)
    names = ["x", "y", "z"] + (["intensity", "red", "green", "blue"] if width >= 7 else ["red", "green", "blue"] if width == 6 else ["intensity"] if width >= 4 else [])
    out = {c: a[:, k] for k, c in enumerate(names)}
    if "intensity" in out and len(rows) and out["intensity"].min() < 0:
        out["intensity"] = (out["intensity"] + 2048) * 16
    return out, None


def sample_mesh(p: dict, faces: np.ndarray, most: int, seed: int = 1) -> dict:
    """Points on the triangles, as many per area; at least as many as vertices, 25 a square metre, `most` at most."""
    v = np.stack([p[c] for c in "xyz"], 1)
    a, b, c = (v[faces[:, k]] for k in range(3))
    area = np.linalg.norm(np.cross(b - a, c - a), axis=1) / 2
    n = int(min(most, max(len(v), area.sum() * 25)))
    rng = np.random.default_rng(seed)
    t = rng.choice(len(faces), n, p=area / area.sum())
    r, s = np.sqrt(rng.random(n))[:, None], rng.random(n)[:, None]
    mix = lambda k: (1 - r[:, 0]) * k[faces[t, 0]] + r[:, 0] * (1 - s[:, 0]) * k[faces[t, 1]] + r[:, 0] * s[:, 0] * k[faces[t, 2]]
    return {name: mix(k) for name, k in p.items()}


def up_axis(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> str:
    """y if the scan is flat along y and deep along z, by the spans of its inner 98 %."""
    if len(x) < 10:
        return "z"
    rx, ry, rz = (np.percentile(a, 99) - np.percentile(a, 1) for a in (x, y, z))
    return "y" if ry < 0.35 * min(rx, rz) and rz > 3 * ry else "z"


def normalised(p: dict, y_up: bool) -> dict:
    """z up, finite rows only, class and returns 1 where absent, colours in 16 bits."""
    if y_up:
        p = p | {"y": -p["z"], "z": p["y"]}
    fine = np.isfinite(p["x"]) & np.isfinite(p["y"]) & np.isfinite(p["z"])
    p = {k: v[fine] for k, v in p.items()}
    n = len(p["x"])
    for c in ("classification", "return_number", "number_of_returns"):
        p.setdefault(c, np.ones(n))
    if "red" in p and n:
        top = max(p[c].max() for c in ("red", "green", "blue"))
        scale = 255 * 256 if top <= 1 else 256 if top <= 255.5 else 1
        p |= {c: np.minimum(p[c] * scale, 65535) for c in ("red", "green", "blue")}
    return p


READERS = {".ply": read_ply, ".obj": read_obj, ".stl": read_stl, ".glb": read_glb, ".gltf": read_glb, ".xyz": read_text, ".txt": read_text, ".csv": read_text, ".pts": read_text}


class Part(InputPartition):
    def __init__(self, path: str, first: int, n: int, stride: int):
        self.path, self.first, self.n, self.stride = path, first, n, stride


class ScanReader(DataSourceReader):
    def __init__(self, options: dict):
        path = local_path(options["path"])
        self.most = int(options.get("max_points", 10**9))
        self.files = sorted(f for f in glob.glob(os.path.join(path, "*")) if f.lower().endswith(SUFFIXES)) if os.path.isdir(path) else [path]

    def partitions(self) -> list[Part]:
        parts = []
        for f in self.files:
            suffix = os.path.splitext(f)[1].lower()
            if suffix in (".laz", ".e57"):
                raise ValueError(f"{suffix} needs a reader that is not part of this package; convert {f} to LAS")
            if suffix not in SUFFIXES:
                raise ValueError(f"unknown kind of scan: {f}")
            if suffix == ".las":
                n = las_header(f)["points"]
                stride = max(1, math.ceil(n / self.most))
                parts += [Part(f, k, min(RECORDS, n - k), stride) for k in range(0, n, RECORDS)]
            else:
                parts.append(Part(f, 0, -1, 1))
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        suffix = os.path.splitext(part.path)[1].lower()
        if suffix == ".las":
            p = las_records(part.path, las_header(part.path), part.first, part.n)
            ordinal = part.first + np.arange(part.n)
        else:
            p, faces = READERS[suffix](part.path)
            y_up = suffix in (".glb", ".gltf") or (len(p["x"]) > 0 and up_axis(p["x"], p["y"], p["z"]) == "y")
            if faces is not None and len(faces):
                p = sample_mesh(p, faces, self.most)
            p = normalised(p, y_up)
            ordinal = np.arange(len(p["x"]))
            part.stride = max(1, math.ceil(len(ordinal) / self.most))
        keep = ordinal % part.stride == 0
        n = int(keep.sum())
        arrays = [pa.array(p[c][keep].astype(float) if c in "xyz" else p[c][keep].astype(np.int32), t) if c in p else pa.array([part.path] * n, t) if c == "src" else pa.array(ordinal[keep], t) if c == "ordinal" else pa.nulls(n, t) for c, t in zip(COLUMNS, TYPES, strict=True)]
        for s in range(0, n, 65_536):
            yield pa.RecordBatch.from_arrays([a.slice(s, 65_536) for a in arrays], COLUMNS)


class Scan3D(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan3d"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScanReader:
        return ScanReader(self.options)


def read_points(spark: SparkSession, path: str, max_points: int | None = None) -> DataFrame:
    """The scan at a path, or all scans in a folder, as one DataFrame."""
    spark.dataSource.register(Scan3D)
    r = spark.read.format("scan3d")
    return (r.option("max_points", max_points) if max_points else r).load(path)


def common_columns(scans: list[DataFrame]) -> DataFrame:
    """Union of scans on the columns that every one has values for."""
    empty = [{c for c, n in s.agg(*[F.count(c).alias(c) for c in s.columns]).first().asDict().items() if n == 0} for s in scans]
    keep = [c for c in scans[0].columns if all(c in s.columns and c not in e for s, e in zip(scans, empty, strict=True))]
    out = scans[0].select(*keep)
    for s in scans[1:]:
        out = out.unionByName(s.select(*keep))
    return out


def crop(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Half-open window."""
    return points.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def guess_crs(points: DataFrame) -> str | None:
    """tm35fin if the median point lies within its Finnish extent."""
    r = points.agg(F.median("x").alias("x"), F.median("y").alias("y")).first()
    return "tm35fin" if r.x is not None and 40_000 <= r.x <= 800_000 and 6.6e6 <= r.y <= 7.8e6 else None


def las_bytes(p: dict[str, np.ndarray], wkt: str = "") -> bytes:
    """A LAS 1.4 file of point format 8, at millimetre scale."""
    n, scale = len(p["x"]), 0.001
    offset = [math.floor(p[c].min()) if n else 0 for c in "xyz"]
    rows = np.zeros(n, np.dtype([("xyz", "<i4", 3), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("cls", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8"), ("rgbn", "<u2", 4)]))
    for k, c in enumerate("xyz"):
        rows["xyz"][:, k] = np.rint((p[c] - offset[k]) / scale)
    zero = np.zeros(n, np.int64)
    rows["intensity"], rows["cls"] = p.get("intensity", zero), p.get("classification", zero + 1)
    rows["returns"] = p.get("return_number", zero + 1) | p.get("number_of_returns", zero + 1) << 4
    for k, c in enumerate(("red", "green", "blue", "nir")):
        rows["rgbn"][:, k] = p.get(c, zero)
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt) + 1, b"WKT") + wkt.encode() + b"\0" if wkt else b""
    h = bytearray(375)
    h[:4] = b"LASF"
    struct.pack_into("<H", h, 6, 16)
    struct.pack_into("<BB", h, 24, 1, 4)
    struct.pack_into("<HIIBHI", h, 94, 375, 375 + len(vlr), 1 if wkt else 0, 8, rows.itemsize, 0)
    lo_hi = [f(p[c]) if n else 0.0 for c in "xyz" for f in (np.max, np.min)]
    struct.pack_into("<12d", h, 131, scale, scale, scale, *offset, *lo_hi)
    struct.pack_into("<Q", h, 247, n)
    return bytes(h) + vlr + rows.tobytes()


def write_las(points: DataFrame, folder: str) -> DataFrame:
    """A LAS file per partition in a folder that all executors reach; returns (file, points) of those written."""
    import uuid

    columns = [c for c in COLUMNS if c in points.columns and c not in ("src", "ordinal")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        batches = list(it)
        if not batches or not sum(b.num_rows for b in batches):
            return
        t = pa.Table.from_batches(batches)
        p = {c: t.column(c).to_numpy().astype(float if c in "xyz" else np.int64) for c in columns if t.column(c).null_count == 0}
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex[:12]}.las"
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(las_bytes(p))
        yield pa.RecordBatch.from_pydict({"file": [name], "points": pa.array([t.num_rows], pa.int64())})

    return points.select(*columns).mapInArrow(run, "file string, points long")
