"""Rasters as long tables (iy, ix, value): cell keys, block reduction, stencils and masks.

A site's or a tile's cells share a key column set `by`; stencils never look beyond it, so give tiles a halo first (halo()).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_index(x: Column, x0: float, res: float, n: int) -> Column:
    """Cell of a coordinate, truncated and clamped to the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), ((x - x0) / res).cast("int")))


def cell_centre(i: Column, x0: float, res: float) -> Column:
    return x0 + (i + 0.5) * res


def flat_id(iy: Column, ix: Column, nx: int) -> Column:
    return iy.cast("long") * nx + ix


def full_grid(spark, nx: int, ny: int) -> DataFrame:
    return spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))


def coarsen(cells: DataFrame, f: int, nx: int, ny: int, *aggs: Column) -> DataFrame:
    """f x f block reduction; a ragged edge is dropped."""
    rows = cells.filter((F.col("iy") < ny // f * f) & (F.col("ix") < nx // f * f))
    return rows.groupBy(F.floor(F.col("iy") / f).cast("int").alias("iy"), F.floor(F.col("ix") / f).cast("int").alias("ix")).agg(*aggs)


def upsample(cells: DataFrame, f: int) -> DataFrame:
    """Each cell as f x f cells of its value."""
    rest = [c for c in cells.columns if c not in ("iy", "ix")]
    rows = cells.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(f - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(f - 1))))
    return rows.select((F.col("iy") * f + F.col("dy")).alias("iy"), (F.col("ix") * f + F.col("dx")).alias("ix"), *rest)


def lookup(points: DataFrame, cells: DataFrame, x0: float, y0: float, res: float, nx: int, ny: int) -> DataFrame:
    """points with the columns of the cell that each falls in."""
    return points.withColumns({"ix": cell_index(F.col("x"), x0, res, nx), "iy": cell_index(F.col("y"), y0, res, ny)}).join(cells, ["iy", "ix"], "left")


def stencil(cells: DataFrame, offsets: list[tuple[int, int]], agg: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates over each existing cell's neighbours at the offsets: a neighbour sends its values to the cells that look at it."""
    if (0, 0) not in offsets:
        raise ValueError("a stencil holds its own cell")
    arms = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    sent = cells.withColumn("o", F.explode(arms)).withColumns({"iy": F.col("iy") - F.col("o.dy"), "ix": F.col("ix") - F.col("o.dx"), "own": (F.col("o.dy") == 0) & (F.col("o.dx") == 0)}).drop("o")
    keys = [*by, "iy", "ix"]
    # a cell exists if it sent to itself: no join back, so that chains of stencils stay as long as they are
    return sent.groupBy(*keys).agg(*[c.alias(k) for k, c in agg.items()], F.bool_or("own").alias("own")).filter("own").drop("own")


def square(r: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1)]


def disc(r: float) -> list[tuple[int, int]]:
    n = int(r)
    return [(y, x) for y in range(-n, n + 1) for x in range(-n, n + 1) if x * x + y * y <= r * r]


CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]


def box_mean(cells: DataFrame, value: str, r: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over (2r+1)^2 cells that exist, as two passes of 2r+1."""
    one = stencil(cells, [(0, d) for d in range(-r, r + 1)], {"s": F.sum(value), "n": F.count(value)}, by)
    return stencil(one, [(d, 0) for d in range(-r, r + 1)], {value: F.sum("s") / F.sum("n")}, by)


def gaussian(cells: DataFrame, value: str, sigma: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian blur, truncated at four sigma and normalised over the cells that exist, as two passes."""
    r = math.ceil(4 * sigma)
    weights = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)}

    def pass_(df: DataFrame, horizontal: bool) -> DataFrame:
        arms = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in weights.items()])
        sent = df.withColumn("o", F.explode(arms))
        axis = "ix" if horizontal else "iy"
        keys = [*by, "iy", "ix"]
        sent = sent.withColumn(axis, F.col(axis) + F.col("o.d"))
        return sent.groupBy(*keys).agg((F.sum(F.col(value) * F.col("o.w")) / F.sum("o.w")).alias(value), F.bool_or(F.col("o.d") == 0).alias("own")).filter("own").drop("own")

    return pass_(pass_(cells.select(*by, "iy", "ix", value), True), False)


def median3(cells: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    return stencil(cells, square(1), {value: F.median(value)}, by)


def fill_pits(cells: DataFrame, value: str = "chm", depth: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells that lie more than `depth` below their 3 x 3 median take it."""
    keys = [*by, "iy", "ix"]
    med = stencil(cells, square(1), {"med": F.median(value)}, by)
    return cells.join(med, keys).withColumn(value, F.when(F.col(value) < F.col("med") - depth, F.col("med")).otherwise(F.col(value))).drop("med")


def gradient_slope(cells: DataFrame, value: str, res: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Slope in degrees: central differences, one-sided where a neighbour is missing."""
    keys = [*by, "iy", "ix"]
    at = lambda dy, dx: F.max(F.when((F.col("oy") == dy) & (F.col("ox") == dx), F.col(value)))
    arms = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in CROSS])
    sent = cells.select(*keys, value, F.explode(arms).alias("o")).select(*by, (F.col("iy") - F.col("o.dy")).alias("iy"), (F.col("ix") - F.col("o.dx")).alias("ix"), F.col("o.dy").alias("oy"), F.col("o.dx").alias("ox"), value)
    seen = sent.groupBy(*keys).agg(at(0, 0).alias("c"), at(0, 1).alias("e"), at(0, -1).alias("w"), at(1, 0).alias("n"), at(-1, 0).alias("s")).filter("c IS NOT NULL")

    def diff(hi: str, lo: str) -> Column:
        steps = F.when(F.col(hi).isNotNull(), 1).otherwise(0) + F.when(F.col(lo).isNotNull(), 1).otherwise(0)
        return F.when(steps > 0, (F.coalesce(hi, "c") - F.coalesce(lo, "c")) / (steps * res)).otherwise(0.0)

    return seen.select(*keys, F.degrees(F.atan(F.hypot(diff("e", "w"), diff("n", "s")))).alias("slope_deg"))


def dilate(cells: DataFrame, mask: str, offsets=CROSS, by: tuple[str, ...] = ()) -> DataFrame:
    return stencil(cells, offsets, {mask: F.bool_or(mask)}, by)


def erode(cells: DataFrame, mask: str, offsets=CROSS, by: tuple[str, ...] = ()) -> DataFrame:
    """A cell beyond the grid counts as not set."""
    return stencil(cells, offsets, {mask: F.bool_and(mask) & (F.count(F.lit(1)) == len(offsets))}, by)


def opened(cells: DataFrame, mask: str, n: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    for f in (erode, dilate):
        for _ in range(n):
            cells = f(cells, mask, by=by)
    return cells


def closed(cells: DataFrame, mask: str, n: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    for f in (dilate, erode):
        for _ in range(n):
            cells = f(cells, mask, by=by)
    return cells


def local_maxima(cells: DataFrame, value: str = "chm", least: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells of at least `least` that are the greatest of their window: of 1, 2 or 3 cells around for heights below 8, below 18 and above."""
    keys = [*by, "iy", "ix"]
    rings = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(max(abs(dy), abs(dx))).alias("r")) for dy, dx in square(3)])
    sent = cells.select(*keys, value, F.explode(rings).alias("o")).select(*by, (F.col("iy") - F.col("o.dy")).alias("iy"), (F.col("ix") - F.col("o.dx")).alias("ix"), F.col("o.r").alias("r"), value)
    top = lambda r: F.max(F.when(F.col("r") <= r, F.col(value)))
    seen = sent.groupBy(*keys).agg(F.max(F.when(F.col("r") == 0, F.col(value))).alias(value), top(1).alias("m1"), top(2).alias("m2"), top(3).alias("m3"))
    window = F.when(F.col(value) < 8, F.col("m1")).when(F.col(value) < 18, F.col("m2")).otherwise(F.col("m3"))
    return seen.filter((F.col(value) >= least) & (F.col(value) >= window - 1e-6)).select(*keys, value)


def halo(cells: DataFrame, tile: int, width: int) -> DataFrame:
    """Cells dealt to tiles of tile x tile (per site, where they have one) with `width` more on each side: tile_y, tile_x, core (whether the cell is the tile's own)."""
    span = lambda c: F.sequence(F.floor((F.col(c) - width) / tile), F.floor((F.col(c) + width) / tile))
    rows = cells.withColumn("tile_y", F.explode(span("iy"))).withColumn("tile_x", F.explode(span("ix")))
    return rows.withColumn("core", (F.floor(F.col("iy") / tile) == F.col("tile_y")) & (F.floor(F.col("ix") / tile) == F.col("tile_x")))


def surfaces(points: DataFrame, res: float, nx: int, ny: int) -> DataFrame:
    """Per cell: n, ground mean (classes 2 and 9), highest canopy return (without classes 6, 14, 9, 7, 18), shares of water and canopy."""
    p = points.withColumns({"ix": cell_index(F.col("x"), 0.0, res, nx), "iy": cell_index(F.col("y"), 0.0, res, ny)})
    ground, noise = F.col("cls").isin(2, 9), F.col("cls").isin(6, 14, 9, 7, 18)
    return p.groupBy("iy", "ix").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(ground, F.col("z"))).alias("dtm"), F.max(F.when(~noise, F.col("z"))).alias("dsm"), F.min("z").alias("z_min"), F.avg(F.when(F.col("cls") == 9, 1.0).otherwise(0.0)).alias("water_share")
    )


def canopy_height(cells: DataFrame) -> DataFrame:
    """chm = dsm - dtm, cut to 0..45; null where either is missing."""
    return cells.withColumn("chm", F.greatest(F.lit(0.0), F.least(F.lit(45.0), F.col("dsm") - F.col("dtm"))).cast("double")).withColumn("chm", F.when(F.col("dsm").isNull() | F.col("dtm").isNull(), None).otherwise(F.col("chm")))


def nearest_cells(cells: DataFrame, mask: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each cell's nearest cell of the mask, at any distance: (by, iy, ix, qy, qx, d2: squared distance in cells); of equally near ones the first in row order. No row where the mask is empty. Each row's columns go to the nearest mask cell of the row; then the cells of a column, one column a task, are read off the lower envelope of the rows' parabolas."""
    import numpy as np
    import pandas as pd

    names = [*by, "iy", "ix", "qy", "qx", "d2"]

    def envelope(c: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(m):
            return pd.DataFrame({k: [] for k in names})
        m = m.sort_values("iy")
        best, begin = [], []  # the rows on the envelope, and the first cell of which each is the nearest
        for y, x, g in zip(m["iy"].tolist(), m["at"].tolist(), m["g"].tolist(), strict=True):
            at = None
            while best:
                v, _, h = best[-1]
                at = (y * y - v * v + g - h) // (2 * (y - v)) + 1
                if at > begin[-1]:
                    break
                best.pop()
                begin.pop()
                at = None
            best.append((y, x, g))
            begin.append(-math.inf if at is None else at)
        q = c["iy"].to_numpy(np.int64)
        y, x, g = np.array(best, np.int64)[np.searchsorted(np.array(begin), q, side="right") - 1].T
        return pd.DataFrame({**{k: c[k] for k in by}, "iy": q, "ix": c["ix"], "qy": y, "qx": x, "d2": (q - y) ** 2 + g}, index=c.index)

    kind = dict(cells.dtypes)
    w = Window.partitionBy(*by, "iy").orderBy("ix")
    ends = cells.groupBy(*by).agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    lo = F.coalesce(F.floor((F.lag("ix").over(w) + F.col("ix")) / 2) + 1, F.col("x0").cast("long"))
    hi = F.coalesce(F.floor((F.col("ix") + F.lead("ix").over(w)) / 2), F.col("x1").cast("long"))
    rows = cells.filter(F.col(mask)).select(*by, "iy", "ix").distinct()
    rows = rows.join(ends, list(by)) if by else rows.crossJoin(F.broadcast(ends))  # one row
    rows = rows.select(*by, "iy", F.col("ix").cast("long").alias("at"), F.sequence(lo, hi).alias("c"))
    rows = rows.select(*by, F.col("iy").cast("long").alias("iy"), "at", F.explode("c").alias("ix")).withColumn("g", (F.col("ix") - F.col("at")) * (F.col("ix") - F.col("at")))
    keyed = cells.select(*[F.col(c).alias(c) for c in by], "iy", F.col("ix").cast("long").alias("ix")).distinct()
    schema = ", ".join([*(f"{k} {kind[k]}" for k in by), "iy long", "ix long", "qy long", "qx long", "d2 long"])
    near = keyed.groupBy(*by, "ix").cogroup(rows.groupBy(*by, "ix")).applyInPandas(envelope, schema)
    return near.withColumns({"iy": F.col("iy").cast(kind["iy"]), "ix": F.col("ix").cast(kind["ix"])})


def nearest_fill(cells: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Missing values from the nearest cell that has one, however far; of equally near ones the first in row order. Only where no cell has one are they left null."""
    keys = [*by, "iy", "ix"]
    near = nearest_cells(cells.select(*keys, F.col(value).isNotNull().alias("has")), "has", by).drop("d2")
    donors = cells.filter(F.col(value).isNotNull()).select(*by, F.col("iy").alias("qy"), F.col("ix").alias("qx"), F.col(value).alias("fill"))
    holes = cells.filter(F.col(value).isNull()).select(*keys).join(near, keys).join(donors, [*by, "qy", "qx"]).select(*keys, "fill")
    return cells.join(holes, keys, "left").withColumn(value, F.coalesce(value, "fill")).drop("fill")


def distance_to(cells: DataFrame, mask: str, res: float, beyond: float = 1000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """cells with the exact distance to the nearest cell of the mask; `beyond` only if the mask is empty."""
    keys = [*by, "iy", "ix"]
    near = nearest_cells(cells, mask, by).select(*keys, "d2")
    return cells.join(near, keys, "left").select(*cells.columns, F.coalesce(F.sqrt(F.col("d2").cast("double")) * res, F.lit(beyond)).alias("distance"))


def canopy_change(pre: DataFrame, post: DataFrame, pixel_m: float) -> DataFrame:
    """Forest, loss and gain between two NDVI tables (iy, ix, ndvi), in hectares, with the mean change."""
    d = pre.withColumnRenamed("ndvi", "pre").join(post.withColumnRenamed("ndvi", "post"), ["iy", "ix"]).withColumn("d", F.col("post") - F.col("pre"))
    forest = F.col("pre") > 0.55
    ha = lambda c: F.count_if(c) * (pixel_m * pixel_m / 10_000)
    return d.agg(ha(forest).alias("forest_ha"), ha(forest & (F.col("d") < -0.15)).alias("loss_ha"), ha((F.col("pre") < 0.4) & (F.col("d") > 0.15)).alias("gain_ha"), F.avg("d").alias("mean_change"))


def run_lengths(cells: DataFrame, mask: str, by: list[str], order: str) -> DataFrame:
    """Runs of rows where the mask holds: first and last position, and how many."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.col(order) - F.row_number().over(w)
    return cells.filter(F.col(mask)).withColumn("island", island).groupBy(*by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def colour_scale(cells: DataFrame, value: str, low: float = 0.02, high: float = 0.98, accuracy: int = 10_000) -> DataFrame:
    """One row: the ends of a colour scale, as percentiles by a sketch that merges across tasks."""
    return cells.agg(F.percentile_approx(value, low, accuracy).alias("low"), F.percentile_approx(value, high, accuracy).alias("high"))
