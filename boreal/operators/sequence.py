"""Ordered-sequence operators: ranks, runs, polylines, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(top: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """A bounded list (a top-k) with its rank; give the order a unique last key."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank: a take-ordered, not a sort of everything."""
    return ranked(df.orderBy(*order).limit(k), order)


def steps(points: DataFrame, by: str, order: str) -> DataFrame:
    """Length of each step of a polyline and the length up to each vertex."""
    w = Window.partitionBy(by).orderBy(order)
    rows = points.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    return rows.withColumn("upto", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def pieces(points: DataFrame, by: str, order: str, length: float) -> DataFrame:
    """Polylines in pieces of equal length, near `length` each: (by, piece, vertices, mid point). A vertex on a boundary belongs to both pieces."""
    v = steps(points, by, order)
    whole = F.max("upto").over(Window.partitionBy(by))
    v = v.withColumn("n", F.greatest(F.lit(1), F.round(whole / length).cast("int"))).withColumn("len", whole / F.col("n"))
    at = F.col("upto") / F.col("len")
    first = F.floor(at).cast("int")
    on = F.when((at == first) & (first > 0), F.array(first - 1, first)).otherwise(F.array(first))
    v = v.withColumn("piece", F.explode(F.filter(on, lambda k: k < F.col("n"))))
    return v.groupBy(by, "piece").agg(F.count(F.lit(1)).alias("vertices"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def longest_run(rows: DataFrame, by: str, order: str, gap: float) -> DataFrame:
    """The longest run of rows without a gap above `gap`: (by, first, last, n); of equally long ones the first."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.sum(F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("island", island).groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy(by).agg(F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("island"))).alias("m")).select(by, "m.*")


def smoothed(rows: DataFrame, by: str, order: str, value: str, k: int) -> DataFrame:
    """Moving average of k rows; beyond the ends the end value is repeated."""
    w = Window.partitionBy(by).orderBy(order)
    h = k // 2
    n, i = F.count(F.lit(1)).over(Window.partitionBy(by)), F.row_number().over(w)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(value).over(w.rowsBetween(0, Window.unboundedFollowing))
    inside = F.sum(value).over(w.rowsBetween(-h, h))
    return rows.withColumn("smooth", (inside + F.greatest(F.lit(0), h + 1 - i) * first + F.greatest(F.lit(0), i + h - n) * last) / (2 * h + 1))


def entries(path: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """How often a path enters a flagged band."""
    w = Window.partitionBy(by).orderBy(order)
    return path.withColumn("in", F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).groupBy(by).agg(F.count_if("in").alias("entries"))


def chaikin(points: DataFrame, by: str, order: str) -> DataFrame:
    """One round of corner cutting: two points on each step, the ends kept."""
    w = Window.partitionBy(by).orderBy(order)
    n = points.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "i": F.row_number().over(w), "last": F.count(F.lit(1)).over(Window.partitionBy(by))})
    at = lambda t: F.struct((F.col("x") + t * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("ny") - F.col("y"))).alias("y"))
    own = F.struct("x", "y")
    out = F.when(F.col("nx").isNull(), F.array(own)).when(F.col("i") == 1, F.array(own, at(0.25), at(0.75))).otherwise(F.array(at(0.25), at(0.75)))
    return n.select(by, "i", F.posexplode(out)).select(by, (3 * F.col("i") + F.col("pos")).alias("seq"), "col.x", "col.y")


def simplified(points: DataFrame, by: str, order: str, tolerance: float) -> DataFrame:
    """Douglas-Peucker simplification, a polyline at a time: (by, order, x, y)."""
    import numpy as np
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        xy = p[["x", "y"]].to_numpy()
        keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, v = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
            size = np.hypot(*d)
            far = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / size if size > 0 else np.hypot(v[:, 0], v[:, 1])
            k = int(far.argmax())
            if far[k] > tolerance:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return p.iloc[sorted(keep)][[by, order, "x", "y"]]

    kinds = dict(points.dtypes)
    return points.select(by, order, "x", "y").groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, x double, y double")


def thinned(points: DataFrame, by: str, order: str, n: int = 2) -> DataFrame:
    """Every n-th vertex and the last."""
    w = Window.partitionBy(by)
    i = F.row_number().over(w.orderBy(order)) - 1
    return points.withColumns({"i": i, "k": F.count(F.lit(1)).over(w)}).filter((F.col("i") % n == 0) | (F.col("i") == F.col("k") - 1)).drop("i", "k")


def strided(rows: DataFrame, ordinal: str, n_rows: int, most: int) -> DataFrame:
    """Every ceil(n / most)-th record by its ordinal: at most `most`, the same ones each time."""
    return rows.filter(F.col(ordinal) % max(1, -(-n_rows // most)) == 0)


def expanding_median(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Median of the rows so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = F.array_sort(F.collect_list(value).over(w))
    k = F.size(s)
    return rows.withColumn("median", (F.element_at(s, F.floor((k + 1) / 2).cast("int")) + F.element_at(s, (F.floor(k / 2) + 1).cast("int"))) / 2)
