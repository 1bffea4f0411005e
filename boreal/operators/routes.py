"""Routes that change from walking to driving and back, on a layered graph: a node is a mode and a cell.

Layers are 0 (on foot, before the vehicle), 1 (in the vehicle) and 2 (on foot, after it). A step within a layer costs what its mode takes; a step from a layer to the next costs a change of mode, where the vehicle can stand. Shortest paths over the whole graph choose where to change.
A cell is any column that identifies it (a number, or a struct with its site); sites do not touch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreal.operators import graph
from boreal.plans.rounds import Rounds

WALK_OUT, DRIVE, WALK_IN = 0, 1, 2


def node(layer: Column | int, cell: Column) -> Column:
    layer = F.lit(layer) if isinstance(layer, int) else layer
    return F.struct(layer.cast("int").alias("layer"), cell.alias("cell"))


def layered(drive: DataFrame, foot: DataFrame, stops: DataFrame, change_min: float = 0.0) -> DataFrame:
    """Edges (src, dst, w) over (layer, cell) from those of the vehicle and of walkers (src, dst, w minutes: cells) and the cells (cell) where one may change between them."""
    step = lambda e, layer: e.select(node(layer, F.col("src")).alias("src"), node(layer, F.col("dst")).alias("dst"), "w")
    change = lambda a: stops.select(node(a, F.col("cell")).alias("src"), node(a + 1, F.col("cell")).alias("dst"), F.lit(float(change_min)).alias("w"))
    return step(foot, WALK_OUT).union(step(drive, DRIVE)).union(step(foot, WALK_IN)).union(change(WALK_OUT)).union(change(DRIVE))


def response(drive: DataFrame, foot: DataFrame, stops: DataFrame, depots: DataFrame, change_min: float = 1e-6, site: str | None = None) -> DataFrame:
    """(site, cell, minutes) for each cell that a crew reaches: driven from the depots (site, cell, minutes: head start) to a stop, walked from there. Where a site's depots reach no stop by vehicle, the crew walks in from the depots."""
    key = [site] if site else []
    edges = layered(drive, foot, stops, change_min).filter("src.layer > 0")
    seeds = depots.select(*key, node(DRIVE, F.col("cell")).alias("node"), F.col("minutes").alias("dist"))
    driven = stops.select(node(DRIVE, F.col("cell")).alias("node"))
    first = graph.relax(edges, seeds, per=tuple(key))
    served = first.join(driven, "node", "left_semi").select(*key, F.lit(True).alias("served")).distinct()
    walkers = depots.join(served, key, "left_anti") if key else depots.join(served, F.lit(True), "left_anti")
    second = graph.relax(edges, walkers.select(*key, node(WALK_IN, F.col("cell")).alias("node"), F.col("minutes").alias("dist")), per=tuple(key))
    return first.union(second).filter(F.col("node.layer") == WALK_IN).groupBy(*key, F.col("node.cell").alias("cell")).agg(F.min("dist").alias("minutes"))


def shortest(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of n nodes from the starts, infinite where there is no way, and the node before each, of equals the least, -1 where its way begins: graph.relax() over arrays. src ascends."""
    first = np.searchsorted(src, np.arange(n + 1))
    dist = np.full(n, np.inf)
    dist[starts] = 0.0
    fresh = np.unique(starts)
    while len(fresh):
        size = first[fresh + 1] - first[fresh]
        e = np.repeat(first[fresh] - np.cumsum(size) + size, size) + np.arange(size.sum())
        far = dist[src[e]] + w[e]
        near = far < dist[dst[e]]
        to = dst[e][near]
        np.minimum.at(dist, to, far[near])
        fresh = np.unique(to)
    start = np.zeros(n, bool)
    start[starts] = True
    on = np.isfinite(dist[src]) & (dist[src] + w == dist[dst]) & ~start[dst]
    before = np.full(n, n)
    np.minimum.at(before, dst[on], src[on])
    return dist, np.where(before == n, -1, before)


def _ways_by_site(drive: DataFrame, foot: DataFrame, stops: DataFrame, requests: DataFrame, change_min: float, site: str) -> DataFrame:
    """(route, seq, layer, cell, dist) of each request's way; a site's edges reach its task once, those of walkers for both of their layers."""
    import pandas as pd

    def search(e: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(e) and len(asked):
            cells = np.unique(np.concatenate([e["src"], e["dst"], asked["start"], asked["end"]]))
            n = len(cells)
            at = lambda c: np.searchsorted(cells, c)
            kind, a, b, w = e["kind"].to_numpy(), at(e["src"].to_numpy()), at(e["dst"].to_numpy()), e["w"].to_numpy()
            f, d, c = kind == WALK_OUT, kind == DRIVE, kind == WALK_IN
            src, dst = np.concatenate([a[f], a[d] + n, a[f] + 2 * n, a[c], a[c] + n]), np.concatenate([b[f], b[d] + n, b[f] + 2 * n, a[c] + n, a[c] + 2 * n])
            w, order = np.concatenate([w[f], w[d], w[f], w[c], w[c]]), np.argsort(src, kind="stable")
            src, dst, w = src[order], dst[order], w[order]
            for route, r in asked.groupby("route"):
                dist, before = shortest(src, dst, w, 3 * n, at(r["start"].to_numpy()) + n * r["from_layer"].to_numpy())
                for end in np.unique(at(r["end"].to_numpy()) + n * r["to_layer"].to_numpy()).tolist():
                    way, k = [], end if np.isfinite(dist[end]) else -1
                    while k >= 0:
                        way.append(k)
                        k = int(before[k])
                    rows += [(route, seq, k // n, cells[k % n], dist[k]) for seq, k in enumerate(reversed(way))]
        return pd.DataFrame(rows, columns=["route", "seq", "layer", "cell", "dist"])

    step = lambda df, kind, w: df.select(F.col(site).alias("site"), F.lit(kind).alias("kind"), "src", "dst", w.alias("w"))
    change = stops.select(site, F.col("cell").alias("src"), F.col("cell").alias("dst"))
    edges = step(foot, WALK_OUT, F.col("w")).union(step(drive, DRIVE, F.col("w"))).union(step(change, WALK_IN, F.lit(float(change_min))))
    asked = requests.filter("start IS NOT NULL AND end IS NOT NULL").select(F.col(site).alias("site"), "route", "start", "end", F.when(F.col("start_on_road"), DRIVE).otherwise(WALK_OUT).alias("from_layer"), F.when(F.col("end_on_road"), DRIVE).otherwise(WALK_IN).alias("to_layer"))
    types = dict(requests.dtypes)
    return edges.groupBy("site").cogroup(asked.groupBy("site")).applyInPandas(search, f"route {types['route']}, seq long, layer int, cell {types['start']}, dist double")


def routes(drive: DataFrame, foot: DataFrame, stops: DataFrame, requests: DataFrame, cells: DataFrame, change_min: float = 0.0, site: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The fastest way for each request (route, start, end: cells; start_on_road, end_on_road: whether it begins and ends in the vehicle), all searched together: over one graph in rounds, or, where drive, foot, stops and requests have a column `site`, each site's graph in one task, with the same ways. Cells are numbers then.

    Returns a row per route that has a way (route, minutes, drive_minutes, walk_minutes, drive_cells, walk_cells, road_share, clearings) and the ways (route, seq, layer, cell). cells: cell, road (boolean), blocked (whether a fallen tree lies there). road_share is that of the driven cells; a clearing is a step from a free cell to a blocked one in the vehicle."""
    if site:
        way = Rounds(drive.sparkSession, "ways").keep(_ways_by_site(drive, foot, stops, requests, change_min, site), "ways")
    else:
        edges = layered(drive, foot, stops, change_min)
        seeds = requests.select("route", node(F.when(F.col("start_on_road"), DRIVE).otherwise(WALK_OUT), F.col("start")).alias("node"), F.lit(0.0).alias("dist"))
        ends = requests.select("route", node(F.when(F.col("end_on_road"), DRIVE).otherwise(WALK_IN), F.col("end")).alias("node"))
        reached = graph.relax(edges, seeds, before=True, per=("route",))
        way = graph.paths_to(reached, ends, ("route",)).drop("end").join(reached.select("route", "node", "dist"), ["route", "node"])
        way = way.select("route", "seq", F.col("node.layer").alias("layer"), F.col("node.cell").alias("cell"), "dist")
    w = Window.partitionBy("route").orderBy("seq")
    v = way.join(cells.select("cell", "road", "blocked"), "cell", "left")
    v = v.withColumns({"took": F.col("dist") - F.coalesce(F.lag("dist").over(w), F.lit(0.0)), "was": F.lag("blocked").over(w), "was_layer": F.lag("layer").over(w)})
    driving = F.col("layer") == DRIVE
    entered = driving & (F.col("was_layer") == DRIVE) & F.coalesce(F.col("blocked"), F.lit(False)) & ~F.coalesce(F.col("was"), F.lit(False))
    out = v.groupBy("route").agg(
        F.max("dist").alias("minutes"), F.sum(F.when(driving & (F.coalesce("was_layer", F.lit(DRIVE)) == DRIVE), F.col("took")).otherwise(0.0)).alias("drive_minutes"), F.count_if(driving).alias("drive_cells"), F.count_if(~driving).alias("walk_cells"),
        F.avg(F.when(driving, F.coalesce("road", F.lit(False)).cast("int"))).alias("road_share"), F.count_if(entered).alias("clearings"),
    )
    out = out.withColumn("walk_minutes", F.col("minutes") - F.col("drive_minutes"))
    return out.select("route", "minutes", "drive_minutes", "walk_minutes", "drive_cells", "walk_cells", "road_share", "clearings"), way.select("route", "seq", "layer", "cell")


def snapped(points: DataFrame, cells: DataFrame, res: float, by: tuple[str, ...] = ()) -> DataFrame:
    """points (by, iy, ix and others) with sy, sx, the nearest cell of the mask `fit`, however far, and off_m, the distance to it. cells: by, iy, ix, fit: all cells of the sites."""
    from boreal.operators import grid

    near = grid.nearest_cells(cells.select(*by, "iy", "ix", "fit"), "fit", by)
    return points.join(near, [*by, "iy", "ix"], "left").select(*points.columns, F.col("qy").alias("sy"), F.col("qx").alias("sx"), (F.sqrt(F.col("d2").cast("double")) * res).alias("off_m"))
