"""Shortest paths and components over edge tables, and travel on cell grids."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreal.plans.rounds import Rounds

# Vehicles, fixed values: km/h on main roads, forest roads and off road (0: none), minutes to clear a fallen tree (None: cannot), steepest slope, km/h on bogs (0: none), narrowest road in metres.
VEHICLES = {
    "fire_engine": (60.0, 30.0, 0.0, 15.0, 0.0, 0.0, 3.0),
    "ambulance": (70.0, 30.0, 0.0, None, 0.0, 0.0, 2.8),
    "pickup_4x4": (70.0, 40.0, 0.0, 20.0, 0.0, 0.0, 2.6),
    "atv": (40.0, 30.0, 12.0, 5.0, 20.0, 0.0, 1.5),
    "forwarder": (20.0, 20.0, 5.0, 3.0, 27.0, 2.0, 3.0),
    "foot": (5.0, 5.0, 3.5, 1.0, 45.0, 2.0, 0.8),
}
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def vehicle_table(spark) -> DataFrame:
    names = ("main", "forest", "off", "clear_min", "max_slope", "bog_speed", "min_road_w")
    rows = [F.struct(F.lit(k).alias("vehicle"), *[F.lit(x).cast("double").alias(c) for x, c in zip(v, names, strict=True)]) for k, v in VEHICLES.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def speed(road: Column, road_w: Column, cover: Column, slope: Column, bog: Column, water: Column) -> Column:
    """km/h of a row (road: 0 none, 1 main, 2 forest) that also has a vehicle's columns; 0 where it cannot go. A road too narrow for it is terrain; machines need gaps in the stand, walkers are slowed by slope and undergrowth."""
    on_road = (road > 0) & (F.coalesce(road_w, F.lit(1e9)) >= F.col("min_road_w"))
    pace = 6 * F.exp(-3.5 * F.abs(0.7 * F.tan(F.radians(slope)) + 0.05)) / 5 * (1 - 0.4 * cover)
    gaps = F.when(cover > 0.85, 0.0).otherwise((1 - 0.75 * cover) * (1 - slope / F.greatest(F.col("max_slope"), F.lit(1.0))))
    terrain = F.when((F.col("off") <= 0) | (slope > F.col("max_slope")), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("off") * F.when(F.col("vehicle") == "foot", pace).otherwise(gaps)))
    terrain = F.when(bog, F.least(terrain, F.col("bog_speed"))).otherwise(terrain)
    return F.when(water, 0.0).when(on_road & (road == 1), F.col("main")).when(on_road, F.col("forest")).otherwise(terrain)


def grid_edges(cells: DataFrame, nx: int, res: float, clearing: float | None = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Directed edges (src, dst, w minutes) between cells (iy, ix, v km/h, blocked): half of each cell at its speed, plus the clearing time on entering a blocked band; without a clearing time it is impassable."""
    arms = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(math.hypot(dy, dx) * res).alias("len")) for dy, dx in EIGHT])
    a = cells.filter("v > 0").select(*by, F.col("iy").alias("ay"), F.col("ix").alias("ax"), F.col("v").alias("va"), F.col("blocked").alias("ba"), F.explode(arms).alias("o"))
    a = a.select("*", (F.col("ay") + F.col("o.dy")).alias("iy"), (F.col("ax") + F.col("o.dx")).alias("ix"))
    e = a.join(cells.filter("v > 0").select(*by, "iy", "ix", "v", "blocked"), [*by, "iy", "ix"])
    entering = F.col("blocked") & ~F.col("ba")
    e = e.filter(~F.col("blocked")) if clearing is None else e
    w = 0.5 * F.col("o.len") * (1 / F.col("va") + 1 / F.col("v")) * 0.06 + F.when(entering, float(clearing or 0.0)).otherwise(0.0)
    return e.select(*by, (F.col("ay") * nx + F.col("ax")).cast("long").alias("src"), (F.col("iy") * nx + F.col("ix")).cast("long").alias("dst"), w.alias("w"))


def relax(edges: DataFrame, seeds: DataFrame, limit: float | None = None, before: bool = False, per: tuple[str, ...] = ()) -> DataFrame:
    """(per, node, dist) of the nodes that seeds (per, node, dist) reach, by rounds of min-plus relaxation from the nodes that improved last, until no node improves. Rounds grow with the hops of the longest path; weights are not negative. per: columns of the seeds that keep searches apart, all over the same edges.

    before: with the node that each shortest path comes from, null where it begins, for paths_to(); of equally short ones the least. No ring of edges may then weigh nothing."""
    rounds = Rounds(edges.sparkSession, "relax")
    keys = [*per, "node"]
    edges = rounds.keep(edges.select("src", "dst", "w"), "edges")
    start = seeds.groupBy(*keys).agg(F.min("dist").alias("dist"))
    dist = rounds.keep(start.withColumns({"seed": F.lit(True), "fresh": F.lit(True)}), "dist")
    while not dist.filter("fresh").isEmpty():
        sent = dist.filter("fresh").join(edges, F.col("node") == F.col("src")).select(*per, F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(False).alias("seed"), F.lit(True).alias("fresh"))
        sent = sent.filter(F.col("dist") <= limit) if limit is not None else sent
        best = dist.withColumn("fresh", F.lit(False)).union(sent).groupBy(*keys).agg(F.min(F.struct("dist", "fresh", "seed")).alias("m"))  # an old distance sorts before an equal new one
        dist = rounds.keep(best.select(*keys, "m.dist", "m.seed", "m.fresh"), "dist")
    if not before:
        rounds.drop("edges")
        return dist.select(*keys, "dist")
    reach = dist.select(*keys, "dist", "seed")
    came = reach.select(*per, F.col("node").alias("src"), F.col("dist").alias("d")).join(edges, "src").select(*per, F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("dist"), "src")
    came = came.join(reach.filter("NOT seed"), [*keys, "dist"]).groupBy(*keys).agg(F.min("src").alias("before"))
    return rounds.keep(reach.join(came, keys, "left").select(*keys, "dist", "before"), "paths")


def paths_to(paths: DataFrame, ends: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """(per, end, seq, node): the path from its beginning to each end (per, node), read back over predecessors by pointer doubling: log2 of the longest path rounds, whatever the number of ends. paths: relax() with `before`."""
    rounds = Rounds(paths.sparkSession, "paths")
    jump = rounds.keep(paths.filter("before IS NOT NULL").select(*per, "node", F.col("before").alias("to")), "jump0")
    jumps = [jump]
    while not jump.isEmpty():  # jumps[k] goes back 2**k steps, from the nodes that are as far from their path's beginning
        on = jump.select(*[F.col(c).alias(c) for c in per], F.col("node").alias("to"), F.col("to").alias("far"))
        jump = rounds.keep(jump.join(on, [*per, "to"]).select(*per, "node", F.col("far").alias("to")), f"jump{len(jumps)}")
        jumps.append(jump)
    found = ends.select(*per, "node").distinct().join(paths.select(*per, "node"), [*per, "node"], "left_semi").select(*per, F.col("node").alias("end"), "node", F.lit(0).cast("long").alias("back"))
    for k in range(len(jumps) - 2, -1, -1):  # each node found so far also stands for the one 2**k before it
        far = found.join(jumps[k], [*per, "node"]).select(*per, "end", F.col("to").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        found = rounds.keep(found.union(far), f"found{k}")
    longest = Window.partitionBy(*per, "end")
    return found.select(*per, "end", (F.max("back").over(longest) - F.col("back")).alias("seq"), "node")


def dijkstra(src: np.ndarray, dst: np.ndarray, w: np.ndarray, seeds: dict[int, float], limit: float = math.inf) -> tuple[dict[int, float], dict[int, int]]:
    """Distances and predecessors from seeds over one graph in memory."""
    order = np.argsort(src, kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    nodes, start = np.unique(src, return_index=True)
    span = dict(zip(nodes.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(src)], strict=True), strict=True))
    dist, before, queue = {}, {}, [(d, n, -1) for n, d in seeds.items()]
    heapq.heapify(queue)
    while queue:
        d, n, p = heapq.heappop(queue)
        if n in dist or d > limit:
            continue
        dist[n], before[n] = d, p
        a, b = span.get(n, (0, 0))
        for m, x in zip(dst[a:b].tolist(), w[a:b].tolist(), strict=True):
            if m not in dist:
                heapq.heappush(queue, (d + x, m, n))
    return dist, before


def shortest_paths(edges: DataFrame, seeds: DataFrame, by: str, limit: float = math.inf) -> DataFrame:
    """(by, node, dist, before) per group, each group's graph (a site, or a vehicle on it) in one task."""
    import pandas as pd

    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame({by: [], "node": [], "dist": [], "before": []})
        dist, before = dijkstra(e["src"].to_numpy(), e["dst"].to_numpy(), e["w"].to_numpy(), dict(zip(s["node"].tolist(), s["dist"].tolist(), strict=True)), limit)
        return pd.DataFrame({by: s[by].iat[0], "node": list(dist), "dist": list(dist.values()), "before": [before[n] for n in dist]})

    kind = dict(edges.dtypes)[by]
    return edges.groupBy(by).cogroup(seeds.groupBy(by)).applyInPandas(run, f"{by} {kind}, node long, dist double, before long")


def path_to(paths: DataFrame, by: str, end: int) -> DataFrame:
    """(by, seq, node) of each group's path to a node, from its predecessors."""
    import pandas as pd

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        before, out, n = dict(zip(p["node"], p["before"], strict=True)), [], end
        while n in before and n >= 0:
            out.append(n)
            n = before[n]
        return pd.DataFrame({by: [p[by].iat[0]] * len(out), "seq": range(len(out)), "node": out[::-1]})

    return paths.groupBy(by).applyInPandas(walk, f"{by} {dict(paths.dtypes)[by]}, seq int, node long")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) with the least node of each connected component, nodes without edges included."""
    rounds = Rounds(edges.sparkSession, "components")
    both = rounds.keep(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    labels = rounds.keep(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels = rounds.keep(new.join(up, "component").select("node", "old", F.least("component", "above").alias("component")), "labels")
        done = labels.filter("old <> component").isEmpty()
        labels = labels.select("node", "component")
        if done:
            return labels


def label_cells(cells: DataFrame, nx: int, eight: bool = False) -> DataFrame:
    """Connected regions of mask cells (iy, ix): the region's least cell id as its label."""
    near = EIGHT if eight else [(0, 1), (1, 0), (0, -1), (-1, 0)]
    arms = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in near])
    c = cells.select("iy", "ix", (F.col("iy") * nx + F.col("ix")).cast("long").alias("node"))
    e = c.withColumn("o", F.explode(arms)).select(F.col("node").alias("src"), (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("ix") + F.col("o.dx")).alias("ix"))
    edges = e.join(c.withColumnRenamed("node", "dst"), ["iy", "ix"]).select("src", "dst")
    return components(edges, c).join(c, "node").select("iy", "ix", F.col("component").alias("label"))
