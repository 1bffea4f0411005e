"""Rasters of linear assets: lines burnt into cells with the piece that each cell belongs to, and what trees reach of them.

Lines are vertices (key, seq, x, y); key begins with the columns of the site, `by`. Every join and group keeps the site.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreal.operators.spatial import bucket

#: Slack, in metres, at the border between two pieces, so that a vertex on it belongs to both however its distance was summed.
ON_BORDER = 1e-6
ROAD_PIECE_M, SPAN_M, SPAN_HALF_M = 25.0, 60.0, 1.8


def dense_line(vertices: DataFrame, key: list[str], step: float = 1.0) -> DataFrame:
    """(key, at, x, y): points along each line, at most `step` apart within each of its edges, both ends included; at: metres from its first vertex."""
    w = Window.partitionBy(*key).orderBy("seq")
    e = vertices.select(*key, "seq", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"))
    e = e.withColumn("len", F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)))
    e = e.withColumn("upto", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    n = F.greatest(F.lit(1), F.ceil(F.col("len") / step - 1e-9).cast("int"))
    e = e.withColumn("n", n).withColumn("k", F.explode(F.when(F.col("px").isNull(), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.col("n")))))  # an edge's first point is the last of the edge before
    t = F.col("k") / F.col("n")
    at = lambda p, c: F.when(F.col(p).isNull(), F.col(c)).otherwise(F.col(p) + t * (F.col(c) - F.col(p)))
    return e.select(*key, (F.col("upto") + t * F.col("len")).alias("at"), at("px", "x").alias("x"), at("py", "y").alias("y"))


def line_pieces(dense: DataFrame, key: list[str], length: float) -> DataFrame:
    """dense_line() with piece, counted from 0: equal pieces of each line, near `length` long. A point on a border is in both."""
    whole = F.max("at").over(Window.partitionBy(*key))
    rows = dense.withColumn("whole", whole).withColumn("n", F.greatest(F.lit(1), F.round(F.col("whole") / length).cast("int"))).withColumn("one", F.greatest(F.col("whole") / F.col("n"), F.lit(1e-9)))
    first = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.ceil((F.col("at") - ON_BORDER) / F.col("one")).cast("int") - 1))
    last = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor((F.col("at") + ON_BORDER) / F.col("one")).cast("int")))
    return rows.withColumn("piece", F.explode(F.sequence(first, last))).drop("whole", "n", "one")


def burnt(pieces: DataFrame, key: list[str], half: DataFrame | float, by: tuple[str, ...] = (), res: float = 1.0) -> DataFrame:
    """(by, iy, ix, the rest of key, piece): the cells within `half` metres of the cells that a line passes, by the centres of both; of several pieces the first in the order of key and piece has the cell. half: one for all, or a column of a table (key, half)."""
    cells = pieces.select(*key, "piece", bucket(F.col("y"), res).cast("int").alias("cy"), bucket(F.col("x"), res).cast("int").alias("cx")).distinct()
    cells = cells.withColumn("half", F.lit(float(half))) if isinstance(half, (int, float)) else cells.join(half.select(*key, "half"), key)
    r = F.ceil(F.col("half") / res).cast("int")
    reach = cells.withColumn("r", r).withColumn("dy", F.explode(F.sequence(-F.col("r"), F.col("r")))).withColumn("dx", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    reach = reach.filter((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) * res * res <= F.col("half") * F.col("half"))
    rest = [k for k in key if k not in by]
    won = reach.groupBy(*by, (F.col("cy") + F.col("dy")).alias("iy"), (F.col("cx") + F.col("dx")).alias("ix")).agg(F.min(F.struct(*rest, "piece")).alias("m"))
    return won.select(*by, "iy", "ix", "m.*")


def reach_of(kind: Column, h: Column, conductor_h: float) -> Column:
    """How far a falling tree of height h touches: a conductor at its height, anything else on the ground."""
    return F.when(kind == "power", F.sqrt(F.greatest(h * h - conductor_h * conductor_h, F.lit(0.0)))).otherwise(h)


def strikes(trees: DataFrame, raster: DataFrame, conductor_h: float = 9.0, bearings: int = 36, by: tuple[str, ...] = (), res: float = 1.0) -> DataFrame:
    """The first cell of each kind that each tree meets in each direction within its reach: (by, tree_id, direction, kind, step, line, piece). trees: by, tree_id, x, y, h; raster: by, iy, ix, kind, line, piece. Trees with nothing in the squares around them are left out before rays are cast."""
    coarse = 32.0
    square = lambda c: F.floor(F.col(c) * res / coarse)
    near = raster.select(*by, square("iy").alias("qy"), square("ix").alias("qx")).distinct()
    around = lambda c: F.sequence(F.floor((F.col(c) - F.col("h")) / coarse), F.floor((F.col(c) + F.col("h")) / coarse))
    box = trees.select(*by, "tree_id", "h", "y", F.explode(around("x")).alias("qx")).withColumn("qy", F.explode(around("y")))
    close = trees.join(box.join(near, [*by, "qy", "qx"]).select(*by, "tree_id").distinct(), [*by, "tree_id"], "left_semi")
    rays = close.select(*by, "tree_id", "x", "y", "h", F.explode(F.sequence(F.lit(0), F.lit(bearings - 1))).alias("direction")).withColumn("step", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("h") / res).cast("int")))))
    a = F.radians(F.col("direction") * (360.0 / bearings))
    cell = lambda c, f: F.floor(F.round((F.col(c) + F.col("step") * res * f(a)) / res, 9)).cast("int")
    rays = rays.select(*by, "tree_id", "h", "direction", "step", cell("y", F.sin).alias("iy"), cell("x", F.cos).alias("ix"))
    hit = rays.join(raster, [*by, "iy", "ix"]).filter(F.col("step") * res <= reach_of(F.col("kind"), F.col("h"), conductor_h))
    return hit.groupBy(*by, "tree_id", "direction", "kind").agg(F.min(F.struct("step", "line", "piece")).alias("m")).select(*by, "tree_id", "direction", "kind", "m.*")


def piece_risk(hits: DataFrame, trees: DataFrame, wind_from_deg: float, kappa: float, bearings: int = 36, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, kind, line, piece, p): the chance that some tree strikes a piece. A tree falls by p_fail, in a direction that concentrates (kappa) downwind; on roads small trees count less. hits: strikes(); trees: by, tree_id, h, p_fail."""
    down = math.radians(90 - (wind_from_deg + 180))
    density = [math.exp(kappa * math.cos(2 * math.pi * k / bearings - down)) for k in range(bearings)]
    share = F.element_at(F.array(*[F.lit(d / sum(density)) for d in density]), F.col("direction") + 1)
    w = hits.groupBy(*by, "tree_id", "kind", "line", "piece").agg(F.sum(share).alias("w")).join(trees.select(*by, "tree_id", "h", "p_fail"), [*by, "tree_id"])
    size = F.when(F.col("kind") == "road", F.greatest(F.lit(0.1), F.least(F.lit(1.0), (F.col("h") - 8.0) / 10.0))).otherwise(1.0)
    p = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), F.col("p_fail") * F.col("w") * size))
    return w.groupBy(*by, "kind", "line", "piece").agg((1 - F.exp(F.sum(F.log1p(-p)))).alias("p"))
