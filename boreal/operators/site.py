"""A site from points to decisions: analysis cells, exposure to wind, the weather scenario, fire spread, key figures.

Everything that weather does not touch is computed once; a scenario is a projection over it with one row of conditions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.functions import forest as fo
from boreal.operators import fire, graph, grid
from boreal.operators.spatial import near_pairs, nearest_segment


def label_wires(points: DataFrame, segments: DataFrame, near: float = 2.5, known: int = 200) -> DataFrame:
    """points with class 14 for unclassified or vegetation returns within `near` of a line and 4 to 40 m above the median ground; unchanged if over `known` wire points are there already."""
    n = points.agg(F.count_if(F.col("cls") == 14).alias("n_wire"), F.median(F.when(F.col("cls") == 2, F.col("z"))).alias("ground"))
    box = segments.agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by_")).alias("y0"), F.max(F.greatest("ay", "by_")).alias("y1"))
    p = points.withColumn("pid", F.xxhash64("x", "y", "z", "cls")).crossJoin(F.broadcast(n.crossJoin(box)))  # one row
    high = F.col("z") - F.col("ground")
    maybe = p.filter((F.col("n_wire") <= known) & ~F.col("cls").isin(2, 9) & (high > 4) & (high < 40) & F.col("x").between(F.col("x0") - near, F.col("x1") + near) & F.col("y").between(F.col("y0") - near, F.col("y1") + near))
    hit = nearest_segment(maybe, "pid", segments, near).select("pid", F.lit(True).alias("hit")).dropDuplicates(["pid"])
    return p.join(hit, "pid", "left").withColumn("cls", F.when(F.coalesce("hit", F.lit(False)), 14).otherwise(F.col("cls"))).select(*points.columns)


def fill_crowns(cells: DataFrame, value: str = "chm", rounds: int = 2) -> DataFrame:
    """Empty cells with three or more finite neighbours of eight take their greatest value, twice."""
    for _ in range(rounds):
        seen = grid.stencil(cells, grid.square(1), {"top": F.max(value), "n": F.count(value)})
        cells = cells.join(seen, ["iy", "ix"]).withColumn(value, F.coalesce(value, F.when(F.col("n") >= 3, F.col("top")))).drop("top", "n")
    return cells


def water_mask(cells: DataFrame, r: int = 5) -> DataFrame:
    """Water: class 9 share over 0.004, or hardly any returns, in the box around, under a low canopy; closed, then opened. cells: iy, ix, water_share, full (1 where there are returns), chm."""
    seen = cells
    for c in ("water_share", "full", "chm"):
        seen = seen.drop(c).join(grid.box_mean(cells.select("iy", "ix", c).na.fill(0.0, [c]), c, r), ["iy", "ix"])
    m = seen.withColumn("water", ((F.col("water_share") > 0.004) | (F.col("full") < 0.15)) & (F.col("chm") < 1)).select("iy", "ix", "water")
    return grid.opened(grid.closed(m, "water", 6), "water", 4)


def analysis_cells(canopy: DataFrame, trees: DataFrame, masks: DataFrame, f: int = 10, res: float = 5.0) -> DataFrame:
    """5 m stack: cover, mean height, shares of species by crown area, dead share, stems per ha, and flags from shares of finer masks. canopy: iy, ix, chm (fine); masks: iy, ix, road_main, road_forest, building, water as 0/1 (fine)."""
    coarse = lambda c: F.floor(F.col(c) / f).cast("int").alias(c)
    c = canopy.groupBy(coarse("iy"), coarse("ix")).agg(F.avg(F.when(F.col("chm") > 2, 1.0).otherwise(0.0)).alias("cover"), F.coalesce(F.avg(F.when(F.col("chm") > 2, F.col("chm"))), F.lit(0.0)).alias("mean_h"))
    share = lambda k: (F.sum(F.when(k, F.col("crown_area")).otherwise(0.0)) / F.greatest(F.sum("crown_area"), F.lit(1e-6)))
    t = trees.groupBy(F.floor(F.col("y") / res).cast("int").alias("iy"), F.floor(F.col("x") / res).cast("int").alias("ix")).agg(*[share(F.col("species") == k).alias(n) for k, n in enumerate(fo.SPECIES)], share(F.col("health") == 2).alias("dead"), (F.count(F.lit(1)) * (10_000 / res / res)).alias("stems_ha"))
    m = masks.groupBy(coarse("iy"), coarse("ix")).agg((F.avg("road_main") > 0.35).alias("road_main"), (F.avg("road_forest") > 0.2).alias("road_forest"), (F.avg("building") > 0.3).alias("building"), (F.avg("water") > 0.5).alias("water"))
    out = c.join(t, ["iy", "ix"], "left").join(m, ["iy", "ix"], "left").na.fill(0.0).na.fill(False)
    out = out.withColumn("conifer", F.col("pine") + F.col("spruce"))
    return out.withColumn("fuel", fire.fuel_type())


def exposure_features(trees: DataFrame, canopy: DataFrame, res: float, wind_from: float) -> DataFrame:
    """edge: how near upwind an opening lies (6 to 26 m), emergent: how far a tree stands out of the mean canopy of 20 m. canopy: iy, ix, chm."""
    tall = canopy.agg((0.5 * F.percentile(F.when(F.col("chm") > 2, F.col("chm")), 0.75)).alias("cut"))
    c = canopy.crossJoin(F.broadcast(tall)).withColumn("tall", F.when(F.col("chm") > F.col("cut"), 1.0).otherwise(0.0))  # one row
    share = grid.box_mean(c.select("iy", "ix", "tall"), "tall", max(1, round(5 / res)))
    mean = grid.box_mean(canopy.select("iy", "ix", "chm"), "chm", max(1, round(10 / res)))
    a = math.radians(90 - wind_from)
    steps = F.array(*[F.lit(float(d)) for d in range(6, 27, 4)])
    t = trees.withColumn("d", F.explode(steps))
    at = lambda v: F.floor(v / res).cast("int")
    t = t.withColumns({"ix": at(F.col("x") + F.col("d") * math.cos(a)), "iy": at(F.col("y") + F.col("d") * math.sin(a))}).join(share, ["iy", "ix"], "left")
    edge = t.groupBy("tree_id").agg(F.max(F.when(F.col("tall") < 0.3, 1 - (F.col("d") - 6) / 30).otherwise(0.0)).alias("edge"))
    own = trees.withColumns({"ix": at(F.col("x")), "iy": at(F.col("y"))}).join(mean, ["iy", "ix"], "left").drop("iy", "ix")
    own = own.withColumn("emergent", fo.clip((F.col("h") - F.coalesce("chm", F.lit(0.0))) / F.greatest(F.col("h"), F.lit(1.0)), 0, 1)).drop("chm")
    return own.drop("edge").join(edge, "tree_id")


def scenario_trees(trees: DataFrame, cells: DataFrame, gust: float, wet: float, frozen: bool, dry: float, res: float = 5.0) -> DataFrame:
    """trees with what depends on the weather: p_fail now and in the design storm (25 m/s, wet 0.9, unfrozen), the risk to fell by, hazard by fire. cells: iy, ix, hfi, grass."""
    args = [*map(F.col, ("h", "hd", "species", "edge", "emergent", "peat", "health"))]
    t = trees.withColumns({"p_fail_now": fo.failure_probability(F.lit(float(gust)), *args, wet, frozen), "p_fail_design": fo.failure_probability(F.lit(25.0), *args, 0.9, False)})
    t = t.withColumn("risk_design", F.col("p_fail_design") * (F.col("w_power") + F.col("w_bld") + 0.5 * F.col("w_road") * fo.size_factor(F.col("h"))))
    at = lambda c: F.floor(F.col(c) / res).cast("int")
    t = t.withColumns({"iy": at("y"), "ix": at("x")}).join(cells.select("iy", "ix", "hfi", "grass"), ["iy", "ix"], "left").na.fill(0.0, ["hfi", "grass"])
    return fire.tree_hazard(t, dry).drop("iy", "ix")


def fire_arrival(cells: DataFrame, nx: int, res: float, wind: float, wind_from: float, start: list[tuple[int, int]], minutes: float = 240.0) -> DataFrame:
    """(iy, ix, arrival) of the cells that a fire from the start cells reaches in time. cells: iy, ix, ros, z."""
    spark = cells.sparkSession
    seeds = spark.range(1).select(F.explode(F.array(*[F.lit(y * nx + x).cast("long") for y, x in start])).alias("node"), F.lit(0.0).alias("dist"))
    d = graph.relax(fire.spread_edges(cells, nx, res, wind, wind_from), seeds, minutes)
    return d.select(F.floor(F.col("node") / nx).cast("int").alias("iy"), (F.col("node") % nx).cast("int").alias("ix"), F.col("dist").alias("arrival"))


def burned_area(arrival: DataFrame, res: float, hours: tuple[float, ...] = (0.5, 1, 2, 4)) -> DataFrame:
    """Hectares burned after each time."""
    t = arrival.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(h)) for h in hours])).alias("hours"))
    a = arrival.groupBy(F.ceil(F.col("arrival")).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(F.broadcast(t), F.col("minute") <= F.col("hours") * 60).groupBy("hours").agg((F.sum("n") * (res * res / 10_000)).alias("ha"))  # four times, a row a minute


def fire_impacts(arrival: DataFrame, assets: DataFrame, res: float) -> DataFrame:
    """Earliest arrival within r of each asset (asset_id, x, y, r), null if it is not reached; soonest first."""
    from boreal.operators.spatial import bucket

    span = lambda c: F.sequence(bucket(F.col(c) - F.col("r"), res), bucket(F.col(c) + F.col("r"), res))
    near = assets.withColumn("ix", F.explode(span("x"))).withColumn("iy", F.explode(span("y"))).join(arrival, ["iy", "ix"])
    dx, dy = (F.col("ix") + 0.5) * res - F.col("x"), (F.col("iy") + 0.5) * res - F.col("y")
    hit = near.filter(dx * dx + dy * dy <= F.col("r") * F.col("r")).groupBy("asset_id").agg(F.min("arrival").alias("minutes"))
    return assets.join(hit, "asset_id", "left").orderBy(F.asc_nulls_last("minutes"), "asset_id")


def fire_barrier(arrival: DataFrame, until: float, cells: DataFrame) -> DataFrame:
    """Cells that a route must not enter: those that burn by `until`, and two cells around."""
    m = cells.select("iy", "ix").join(arrival, ["iy", "ix"], "left").select("iy", "ix", F.coalesce(F.col("arrival") <= until, F.lit(False)).alias("barrier"))
    return grid.dilate(m, "barrier", grid.square(2)).filter("barrier").select("iy", "ix")


def snap(points: DataFrame, cells: DataFrame, res: float, reach: float) -> DataFrame:
    """Each point's nearest passable cell within the reach: (point_id, iy, ix); ties in row order."""
    c = cells.filter("v > 0").select(((F.col("ix") + 0.5) * res).alias("x"), ((F.col("iy") + 0.5) * res).alias("y"), "iy", "ix")
    p = near_pairs(points.select("point_id", "x", "y"), c, reach)
    return p.groupBy("point_id").agg(F.min(F.struct("d", "r_iy", "r_ix")).alias("m")).select("point_id", F.col("m.r_iy").alias("iy"), F.col("m.r_ix").alias("ix"))


def drive_then_walk(drive: DataFrame, foot_edges: DataFrame) -> DataFrame:
    """Response minutes everywhere: driven on roads, walked from any road cell that is reached. drive: node, dist."""
    return graph.relax(foot_edges, drive.select("node", "dist"))


def summary(trees: DataFrame) -> DataFrame:
    """One row of key figures."""
    reach = (F.col("w_power") + F.col("w_bld") + F.col("w_road")) > 0
    return trees.agg(
        F.count(F.lit(1)).alias("trees"), F.count_if(F.col("health") == 2).alias("dead"), F.count_if(F.col("health") == 1).alias("stressed"), F.count_if(F.col("w_power") > 0).alias("reach_line"), F.count_if(reach).alias("reach_any"),
        F.avg("h").alias("mean_h"), F.percentile("h", 0.95).alias("h_p95"), F.sum("p_fail").alias("expected_falls"), (1 - F.exp(F.sum(F.log1p(-F.least(F.col("p_fail") * F.col("w_power"), F.lit(0.999999)))))).alias("p_outage"),
    )


def from_scans(spark: SparkSession, path: str, res: float = 0.5, max_points: int | None = None) -> DataFrame:
    """Canopy cells of a scan: points, cells, terrain filled and smoothed, heights with pits filled; site coordinates start at the scan's corner."""
    from boreal.sources.scan3d import read_points

    p = read_points(spark, path, max_points)
    lo = p.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    p = p.select((F.col("x") - lo.x0).alias("x"), (F.col("y") - lo.y0).alias("y"), "z", F.col("classification").alias("cls"))
    n = lambda a, b: max(1, math.ceil((b - a) / res))
    c = grid.surfaces(p, res, n(lo.x0, lo.x1), n(lo.y0, lo.y1))
    nx, ny = n(lo.x0, lo.x1), n(lo.y0, lo.y1)
    c = grid.full_grid(spark, nx, ny).join(c, ["iy", "ix"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "water_share": F.coalesce("water_share", F.lit(0.0))})
    dtm = grid.gaussian(grid.nearest_fill(c.select("iy", "ix", "dtm"), "dtm"), "dtm", 0.7)
    surface = grid.nearest_fill(grid.canopy_height(c.drop("dtm").join(dtm, ["iy", "ix"])), "chm")  # cells without a return take their neighbour's height
    return grid.fill_pits(surface)


def pixels_of(tiles: DataFrame, size: int = 256) -> DataFrame:
    """Landed tiles (zoom, tile_x, tile_y, values: an array of size * size, row by row) as pixels on the map's grid: px, py, value; -1..1 from 0..255, null where alpha is 0."""
    return tiles.select("tile_x", "tile_y", F.posexplode("values").alias("k", "v")).select((F.col("tile_x") * size + F.col("k") % size).alias("px"), (F.col("tile_y") * size + F.floor(F.col("k") / size)).alias("py"), F.when(F.col("v") >= 0, F.col("v") / 255 * 2 - 1).alias("value"))


def ndvi_band(share: Column) -> Column:
    return F.when(share > 0.55, "forest").when(share > 0.3, "sparse").otherwise("open")
