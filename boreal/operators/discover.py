"""Infrastructure that maps lack: tracks, wires and buildings from scans, roads and corridors from images."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreal.operators import grid
from boreal.operators.graph import dijkstra
from boreal.operators.kernels import EIGHT, label, shifted
from boreal.operators.spatial import unmapped
from boreal.plans.rounds import Rounds


def neighbour_edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges between adjacent cells of a mask, as cell numbers in row order."""
    cell = np.arange(mask.size).reshape(mask.shape)
    src, dst = [], []
    for dy, dx in EIGHT:
        there = shifted(np.where(mask, cell, -1), dy, dx, -1)
        both = mask & (there >= 0)
        src.append(cell[both])
        dst.append(there[both])
    return np.concatenate(src), np.concatenate(dst)


def longest_path(mask: np.ndarray) -> list[tuple[int, int]]:
    """The longest shortest path of a thin region, by two relaxations over its edge table: from any cell to the farthest, and from there."""
    if not mask.any():
        return []
    src, dst = neighbour_edges(mask)
    end = int(np.flatnonzero(mask)[0])
    for _ in range(2):
        dist, before = dijkstra(src, dst, np.ones(len(src)), {end: 0.0})
        end = max(dist, key=lambda n: (dist[n], -n))
    path = []
    while end != -1:
        path.append(divmod(end, mask.shape[1]))
        end = before[end]
    return path


#: For each of the 256 rings of neighbours the number of branches that leave a cell: runs of set bits around the ring.
BRANCHES = np.array([(ring ^ ((ring << 1 | ring >> 7) & 255)).bit_count() // 2 for ring in range(256)])
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def branches(skeleton: np.ndarray) -> np.ndarray:
    """How many branches leave each cell of a skeleton; 0 elsewhere."""
    code = sum(shifted(skeleton, dy, dx, False).astype(np.int64) << k for k, (dy, dx) in enumerate(RING))
    return np.where(skeleton, BRANCHES[code], 0)


def junctions(skeleton: np.ndarray) -> np.ndarray:
    """Skeleton cells where three branches or more meet."""
    return branches(skeleton) >= 3


def pruned(skeleton: np.ndarray, least: int) -> np.ndarray:
    """A skeleton without spurs: pieces between an end and a junction of fewer than `least` cells. Pieces are what is left between junctions and the cells around them."""
    meet = junctions(skeleton)
    knots = meet.copy()
    for dy, dx in RING:
        knots |= shifted(meet, dy, dx, False)
    pieces, n = label(skeleton & ~knots, EIGHT)
    near_knot = np.zeros(skeleton.shape, bool)
    for dy, dx in RING:
        near_knot |= shifted(skeleton & knots, dy, dx, False)
    size = np.bincount(pieces.ravel(), minlength=n + 1)
    held = np.bincount(pieces[near_knot], minlength=n + 1) > 0
    ends = np.bincount(pieces[branches(skeleton) == 1], minlength=n + 1) > 0
    spur = held & ends & (size + 1 < least)  # the junction's own neighbour belongs to the spur
    spur[0] = False
    return skeleton & ~spur[pieces]


def find_tracks(cells: DataFrame, res: float, known: DataFrame, tile: int = 400, least_m: float = 50.0, power: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Unmapped tracks in forest from cells (by, iy, ix, chm, forest, rough, slope, ground_share): open strips of 1 to 6.5 m half width, thinned, each part's longest path, whole across tiles: (by, track, seq, x, y, width, side, straight, confidence). Vertices nearer than 9 m to a known road vertex (x, y) divide a path, as do those
    within 12 m of a power line's vertices (power: x, y); each stretch between is judged on its own, by its length, its straightness and the forest on both sides."""
    from boreal.operators import network

    keys = [*by, "iy", "ix"]
    c = cells.withColumn("open", (F.col("chm") < 1.5) & (F.col("forest") > 0.35) & (F.col("rough") < 0.25) & (F.col("slope") < 15) & (F.col("ground_share") > 0.3))
    rounds = Rounds(cells.sparkSession, "tracks")
    thin = rounds.keep(network.skeleton(c, "open", res, tile, by=by).filter(F.col("half").between(1.0, 6.5)), "thin")
    path = network.longest_lines(network.without_spurs(thin, 3, by), by).join(thin, keys)
    path = path.select(*by, "line", "seq", "iy", "ix", "half", ((F.col("ix") + 0.5) * res).alias("x"), ((F.col("iy") + 0.5) * res).alias("y"))
    v = path.withColumn("v", F.struct("line", "seq"))
    left = unmapped(v, "v", known, 9.0)
    left = rounds.keep((unmapped(left, "v", power, 12.0) if power is not None else left).drop("v"), "left")
    w = Window.partitionBy(*by, "line").orderBy("seq")
    left = left.withColumn("part", F.sum(F.when(F.col("seq") - F.lag("seq").over(w) > 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = left.withColumn("track", F.concat_ws("/", *[F.col(f"line.{k}").cast("string") for k in keys], F.col("part").cast("string"))).drop("line", "part")
    key = [*by, "track"]
    width = left.groupBy(*key).agg((F.median("half") * 2).alias("width"))
    soft = network.smooth_line(left.select(*key, "seq", "x", "y"), key, 9)
    length = network.straightness(left, key).select(*key, F.col("run").alias("length"))
    judged = width.join(length, key).join(network.straightness(soft, key).select(*key, "straight"), key).join(network.side_contrast(soft, key, width, cells, res, by), key)
    judged = judged.filter((F.col("length") >= least_m) & (F.col("straight") >= 0.55) & (F.col("side") >= 0.55))
    judged = judged.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.col("side") + 0.5 * F.least(F.col("straight") / 0.8, F.lit(1.0)))))
    return soft.join(judged, key)


def wire_candidates(points: DataFrame, res: float = 2.0) -> DataFrame:
    """Cells with one to six high returns and an empty band below: where wires may hang. points: x, y, hag."""
    hag = F.col("hag")
    c = points.groupBy(F.floor(F.col("y") / res).alias("iy"), F.floor(F.col("x") / res).alias("ix")).agg(F.count_if((hag >= 6) & (hag <= 30)).alias("high"), F.count_if((hag > 1.5) & (hag < 5)).alias("band"), F.avg(F.when((hag >= 6) & (hag <= 30), F.col("x"))).alias("x"), F.avg(F.when((hag >= 6) & (hag <= 30), F.col("y"))).alias("y"), F.avg(F.when((hag >= 6) & (hag <= 30), hag)).alias("h"))
    return c.filter((F.col("high").between(1, 6)) & (F.col("band") == 0))


def fit_lines(points: DataFrame, by: str, lines: int = 6, draws: int = 400, near: float = 1.8, least: int = 80, seed: int = 1) -> DataFrame:
    """Up to `lines` straight lines per group of points (x, y, h) by seeded random draws of two points: (by, line, x0, y0, ux, uy, n, length, occupancy). A line takes its points with it; it needs 80 m and seven of ten 5 m bins occupied."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        rng, xy, h, out = np.random.default_rng(seed), p[["x", "y"]].to_numpy(), p["h"].to_numpy(), []
        for k in range(lines):
            best = None
            if len(xy) < least:
                break
            for _ in range(draws):
                a, b = rng.choice(len(xy), 2, replace=False)
                d = xy[b] - xy[a]
                if (size := np.hypot(*d)) < 20:
                    continue
                u = d / size
                v = xy - xy[a]
                t = v @ u
                on = (np.abs(v[:, 0] * u[1] - v[:, 1] * u[0]) < near) & (np.abs(h - np.median(h[[a, b]])) < 2.5 + np.abs(h[a] - h[b]))
                if best is None or on.sum() > best[0].sum():
                    best = (on, t, xy[a], u)
            if best is None or best[0].sum() < least:
                break
            on, t, o, u = best
            s = np.sort(t[on])
            cut = np.flatnonzero(np.diff(s) > 40)
            runs = np.split(s, cut + 1)
            s = max(runs, key=len)
            length = s[-1] - s[0]
            occupancy = len(np.unique(s // 5)) / max(1, math.ceil(length / 5))
            if length >= 80 and occupancy >= 0.7 and len(s) / length >= 0.5:
                a = o + s[0] * u
                out.append((p[by].iat[0], k, *a, *u, int(on.sum()), float(length), float(occupancy)))
            xy, h = xy[~on], h[~on]
        return pd.DataFrame(out, columns=[by, "line", "x0", "y0", "ux", "uy", "n", "length", "occupancy"])

    return points.groupBy(by).applyInPandas(run, f"{by} {dict(points.dtypes)[by]}, line int, x0 double, y0 double, ux double, uy double, n long, length double, occupancy double")


def find_buildings(cells: DataFrame, res: float, nx: int) -> DataFrame:
    """Buildings from cells (iy, ix, chm, residual, ground_share): tall, smooth, opaque regions of 20 to 800 m2 that fill their box: (building, x, y, area, r)."""
    from boreal.operators.graph import label_cells

    m = cells.withColumn("roof", F.col("chm").between(2.5, 15) & (F.col("residual") < 0.35) & (F.col("ground_share") < 0.04)).select("iy", "ix", "roof")
    roofs = label_cells(grid.opened(m, "roof").filter("roof"), nx)
    b = roofs.groupBy("label").agg((F.count(F.lit(1)) * res * res).alias("area"), F.avg("ix").alias("cx"), F.avg("iy").alias("cy"), (F.max("ix") - F.min("ix") + 1).alias("w"), (F.max("iy") - F.min("iy") + 1).alias("h"))
    fill, aspect = F.col("area") / (F.col("w") * F.col("h") * res * res), F.greatest("w", "h") / F.least("w", "h")
    return b.filter(F.col("area").between(20, 800) & (fill >= 0.45) & (aspect <= 4)).select(F.col("label").alias("building"), ((F.col("cx") + 0.5) * res).alias("x"), ((F.col("cy") + 0.5) * res).alias("y"), "area", F.sqrt(F.col("area") / math.pi).alias("r"))


def road_confidence(side: Column, straight: Column, width_cv: Column) -> Column:
    return 0.45 * side + 0.25 * straight + 0.3 * (1 - F.least(width_cv / 0.6, F.lit(1.0)))


def road_segments(segments: DataFrame) -> DataFrame:
    """Segments (length, corridor, side, straight, width_cv, kind) as a road network: class, width and confidence of those that pass the gates."""
    s = segments.withColumn("width", F.greatest(F.lit(3.0), F.least(F.lit(8.0), F.col("corridor") - 5.5)))
    s = s.withColumns({"cls": F.when((F.col("corridor") >= 11.5) & (F.col("length") >= 60), "main").otherwise("forest"), "confidence": road_confidence(F.col("side"), F.col("straight"), F.col("width_cv"))})
    return s.filter((F.col("confidence") >= 0.6) & (F.col("side") >= 0.5) & (F.col("corridor") >= 5.5))


def close_gaps(ends: DataFrame, reach: float = 40.0, cone_deg: float = 25.0) -> DataFrame:
    """Links between road ends (end_id, road, x, y, ux, uy: outward direction) that point at each other within the reach: (a, b, d)."""
    from boreal.operators.spatial import near_pairs

    p = near_pairs(ends, ends, reach).filter((F.col("end_id") < F.col("r_end_id")) & (F.col("road") != F.col("r_road")) & (F.col("d") > 0))
    toward = ((F.col("r_x") - F.col("x")) * F.col("ux") + (F.col("r_y") - F.col("y")) * F.col("uy")) / F.col("d")
    back = ((F.col("x") - F.col("r_x")) * F.col("r_ux") + (F.col("y") - F.col("r_y")) * F.col("r_uy")) / F.col("d")
    cos = math.cos(math.radians(cone_deg))
    return p.filter((toward >= cos) & (back >= cos)).select(F.col("end_id").alias("a"), F.col("r_end_id").alias("b"), "d")


def fused(lidar: DataFrame, image: DataFrame, key: str, r: float, share: float) -> DataFrame:
    """LiDAR features with `evidence`: `lidar+image` where more than `share` of their vertices lie within r of an image feature's."""
    from boreal.operators.spatial import near_pairs

    hit = near_pairs(lidar, image.select("x", "y"), r).select(key, "seq").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("hits"))
    n = lidar.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(hit, key, "left")
    return n.select(key, F.when(F.coalesce("hits", F.lit(0)) / F.col("n") > share, "lidar+image").otherwise("lidar").alias("evidence"))


def pixel_class(red: Column, green: Column, blue: Column) -> Column:
    """sky, water, green, yellow, brown, grey or dark, by hue, saturation and value."""
    from boreal.operators.text import hsv

    h, s, v = hsv(red, green, blue)
    return (
        F.when(v < 0.18, "dark").when((v > 0.7) & ((s < 0.12) | h.between(0.5, 0.7)), "sky").when(h.between(0.5, 0.7) & (s > 0.2), "water").when(h.between(0.2, 0.45) & (s > 0.15), "green").when(h.between(0.11, 0.2) & (s > 0.2), "yellow").when((h < 0.11) & (s > 0.2), "brown").otherwise("grey")
    )


def ground_photo(pixels: DataFrame, height: int) -> DataFrame:
    """Shares of green, yellow and brown canopy in the upper 70 % of a picture taken from the ground, and of dry fuel in the lower 30 %."""
    k = pixels.withColumn("k", pixel_class(F.col("red"), F.col("green"), F.col("blue")))
    up = F.col("r") < 0.7 * height
    share = lambda where, *names: F.coalesce(F.try_divide(F.count_if(where & F.col("k").isin(*names)), F.count_if(where & ~F.col("k").isin("sky"))), F.lit(0.0))
    return k.groupBy("photo").agg(share(up, "green").alias("green"), share(up, "yellow").alias("yellow"), share(up, "brown", "grey").alias("brown"), share(~up, "yellow", "brown").alias("dry_fuel"))


def photo_view(has_world_file: Column, pitch: Column, sky_top: Column) -> Column:
    """above or ground."""
    return F.when(has_world_file | (pitch < -60), "above").when(pitch > -45, "ground").otherwise(F.when(sky_top > 0.12, "ground").otherwise("above"))


def aerial_health(dead_share: Column, yellow_share: Column) -> Column:
    return F.when(dead_share > 0.45, "dead").when(yellow_share + 0.5 * dead_share > 0.3, "stressed").otherwise("healthy")


def auto_depot(roads: DataFrame, nx: int, ny: int) -> DataFrame:
    """The cell (iy, ix) of the weightiest road component (main cells weigh 3) that lies nearest the edge; ties to the least cell. roads: iy, ix, main, label."""
    w = roads.groupBy("label").agg(F.sum(F.when(F.col("main"), 3).otherwise(1)).alias("weight"))
    best = w.orderBy(F.desc("weight"), "label").limit(1)
    edge = F.least(F.col("iy"), F.col("ix"), ny - 1 - F.col("iy"), nx - 1 - F.col("ix"))
    return roads.join(F.broadcast(best), "label").orderBy(edge, "iy", "ix").limit(1).select("iy", "ix")


def united(mapped: DataFrame, discovered: DataFrame) -> DataFrame:
    """Mapped and discovered features in one table, with a flag; columns that only one side has are null on the other."""
    return mapped.withColumn("discovered", F.lit(False)).unionByName(discovered.withColumn("discovered", F.lit(True)), allowMissingColumns=True)
