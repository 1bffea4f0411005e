"""Terrain and canopy of many scans in one plan: each site's ground selector and resolution follow from one aggregate over its points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreal.operators import grid
from boreal.operators.kernels import ground_filter
from boreal.plans.rounds import Rounds

GROUND, BUILDING, WATER, WIRE, NOISE = 2, 6, 9, 14, (7, 18)
#: A producer's ground class is taken where more than this share of the points has it.
CLASSED_SHARE = 0.02
#: Canopy returns a square metre, where there are any, under which the canopy is built of cells of 1 m.
SPARSE = 2.5


def with_ground(points: DataFrame, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """points (by, x, y, z, cls) with `ground`: by class where the site's producer has told ground, else by the surface under the lowest returns."""
    share = points.groupBy(*by).agg(F.avg(F.when(F.col("cls") == GROUND, 1.0).otherwise(0.0)).alias("told")).withColumn("told", F.col("told") > CLASSED_SHARE)
    p = points.join(share, list(by))
    told = p.filter("told").drop("told").withColumn("ground", F.col("cls").isin(GROUND, WATER))
    return told.unionByName(ground_filter(p.filter("NOT told").drop("told"), by=by))


def filled_gaps(cells: DataFrame, value: str, by: tuple[str, ...], times: int = 2) -> DataFrame:
    """Empty cells with three neighbours or more that have a value take the greatest of them, `times` over. cells: a full grid."""
    for _ in range(times):
        near = grid.stencil(cells.select(*by, "iy", "ix", value), grid.square(1), {"top": F.max(value), "k": F.count(value)}, by)
        cells = cells.join(near, [*by, "iy", "ix"]).withColumn(value, F.when(F.col(value).isNull() & (F.col("k") >= 3), F.col("top")).otherwise(F.col(value))).drop("top", "k")
    return cells


def site_surfaces(points: DataFrame, res: float = 0.5, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """(by, iy, ix, n, ground_n, dtm, chm, sparse) for every cell of each site's grid, which starts at its least x and y. points: by, x, y, z, cls.

    Terrain is the mean of ground returns, taken from the nearest cell where a cell has none, and blurred. Canopy is the highest return of vegetation; sites with under 2.5 such returns a square metre get theirs from cells of 1 m, repeated and blurred. Cells without any are open."""
    keys = [*by, "iy", "ix"]
    rounds = Rounds(points.sparkSession, "surfaces")
    extent = points.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    n = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / res).cast("int"))
    extent = extent.withColumns({"nx": n("x0", "x1"), "ny": n("y0", "y1")})
    p = points.join(extent.select(*by, "x0", "y0", "nx", "ny"), list(by)).withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")})
    p = with_ground(p.select(*by, "x", "y", "z", "cls", "nx", "ny"), by)
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.col(most) - 1, F.floor(F.col(c) / res).cast("int")))
    ground = F.col("ground")
    canopy = ~ground & ~F.col("cls").isin(BUILDING, WIRE, WATER, *NOISE)
    seen = p.groupBy(*by, at("y", "ny").alias("iy"), at("x", "nx").alias("ix")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ground).alias("ground_n"), F.avg(F.when(ground, F.col("z"))).alias("dtm"), F.max(F.when(canopy, F.col("z"))).alias("dsm"), F.count_if(canopy).alias("canopy_n"))
    whole = extent.select(*by, "nx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("iy")).select(*by, "iy", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("ix"))
    cells = rounds.keep(whole.join(seen, keys, "left").na.fill(0, ["n", "ground_n", "canopy_n"]), "cells")
    f = max(1, round(1.0 / res))
    block = lambda c: F.floor(F.col(c) / f).cast("int")
    # per square metre of blocks that have any: a cell of half a metre with one return would count as four
    blocks = cells.groupBy(*by, block("iy").alias("iy"), block("ix").alias("ix")).agg(F.sum("canopy_n").alias("k")).filter("k > 0")
    sparse = extent.select(*by).join(blocks.groupBy(*by).agg((F.avg("k") / (f * res) ** 2).alias("density")), list(by), "left").select(*by, ((F.coalesce("density", F.lit(0.0)) < SPARSE) & F.lit(res < 1)).alias("sparse"))
    dtm = rounds.keep(grid.gaussian(grid.nearest_fill(cells.select(*keys, "dtm"), "dtm", by), "dtm", 0.7, by), "dtm")
    dsm = cells.select(*keys, "dsm").join(sparse, list(by))
    dense = filled_gaps(dsm.filter("NOT sparse").select(*keys, "dsm"), "dsm", by)
    thin = dsm.filter("sparse")
    metre = filled_gaps(thin.groupBy(*by, block("iy").alias("iy"), block("ix").alias("ix")).agg(F.max("dsm").alias("dsm")), "dsm", by)
    up = thin.select(*keys).withColumns({"by_": block("iy"), "bx_": block("ix")}).join(metre.withColumnsRenamed({"iy": "by_", "ix": "bx_"}), [*by, "by_", "bx_"]).select(*keys, "dsm")
    soft = grid.gaussian(up.filter("dsm IS NOT NULL"), "dsm", 0.6, by)
    up = filled_gaps(up.select(*keys).join(soft, keys, "left"), "dsm", by)
    surface = rounds.keep(dense.union(up.select(*keys, "dsm")), "dsm")
    c = cells.select(*keys, "n", "ground_n").join(dtm, keys).join(surface, keys).join(sparse, list(by))
    c = c.withColumn("chm", F.when(F.col("dsm").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(45.0), F.col("dsm") - F.col("dtm")))))
    return grid.fill_pits(c.select(*keys, "n", "ground_n", "dtm", "chm", "sparse"), "chm", by=by)
