"""Lines of masks against a plain traversal, whole across tiles; paths and fills at any distance."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreal.operators import discover, graph, grid, network


def frame(spark, cells, by=False):
    rows = [(*c,) for c in cells]
    return spark.createDataFrame(rows, ("site int, " if by else "") + "iy int, ix int").repartition(3)


def linked(mask):
    out = {}
    for y, x in mask:
        out[y, x] = {(y + dy, x + dx) for dy, dx in network.RING if (y + dy, x + dx) in mask and (dy == 0 or dx == 0 or ((y + dy, x) not in mask and (y, x + dx) not in mask))}
    return out


def walk(mask):
    """Every chain as a tuple of cells, from its less first step; rings from their least cell."""
    near, found, used = linked(mask), set(), set()
    knots = {c for c in near if len(near[c]) != 2}

    def steps(a, b):
        path = [a, b]
        while path[-1] not in knots and path[-1] != path[0]:
            path.append(next(c for c in near[path[-1]] if c != path[-2]))
        return path

    for k in [*sorted(knots), *sorted(set(near) - knots)]:
        if k in knots or k not in used:
            for n in near[k]:
                p = steps(k, n)
                used |= set(p)
                code = lambda p: (p[0][0] << 34) + (p[0][1] << 3) + network.RING.index((p[1][0] - p[0][0], p[1][1] - p[0][1]))
                found.add(tuple(min(p, p[::-1], key=code)))
    return found


def got_chains(df, by=()):
    out = {}
    for r in df.collect():
        out.setdefault((*[r[b] for b in by], r.chain), []).append((r.seq, (r.iy, r.ix)))
    return [tuple(c for _, c in sorted(v)) for v in out.values()]


SHAPES = {
    "cross": {(10, x) for x in range(21)} | {(y, 10) for y in range(21)},
    "ring": {(5, x) for x in range(5, 12)} | {(11, x) for x in range(5, 12)} | {(y, 5) for y in range(5, 12)} | {(y, 11) for y in range(5, 12)},
    "ring with a tail": {(5, x) for x in range(5, 12)} | {(11, x) for x in range(5, 12)} | {(y, 5) for y in range(5, 12)} | {(y, 11) for y in range(5, 12)} | {(y, 8) for y in range(12, 30)},
    "stairs": {(k, k) for k in range(30)} | {(k, k + 1) for k in range(30)},
    "dots": {(0, 0), (0, 5), (1, 6)},
}


@pytest.mark.parametrize("name", [*SHAPES, "random 1", "random 2"])
def test_chains_equal_a_walk(spark, name):
    rng = random.Random(name)
    mask = SHAPES.get(name) or {(y, x) for y in range(18) for x in range(18) if rng.random() < 0.4}
    got = got_chains(network.chains(frame(spark, mask)))
    assert len(got) == len(set(got)) and set(got) == walk(mask)


def test_sites_do_not_touch(spark):
    both = [(1, *c) for c in SHAPES["cross"]] + [(2, *c) for c in SHAPES["ring"]]
    df = network.chains(frame(spark, both, True), ("site",))
    assert set(got_chains(df.filter("site = 1"))) == walk(SHAPES["cross"]) and set(got_chains(df.filter("site = 2"))) == walk(SHAPES["ring"])
    nets = network.networks(network.segments(df, ("site",)), ("site",))
    assert nets.select("network").distinct().count() == 2


def test_spurs_go_and_crossings_stay(spark):
    mask = {(10, x) for x in range(60)} | {(y, 30) for y in range(11, 14)} | {(y, 40) for y in range(11, 31)}
    left = {(r.iy, r.ix) for r in network.without_spurs(frame(spark, mask), 5).collect()}
    assert left == mask - {(y, 30) for y in range(11, 14)}


def test_longest_line_of_each_part(spark):
    mask = {(10, x) for x in range(60)} | {(y, 40) for y in range(11, 15)} | {(40 + k, k) for k in range(15)}
    rows = network.longest_lines(frame(spark, mask)).collect()
    per = {}
    for r in rows:
        per.setdefault(r.line, []).append((r.seq, (r.iy, r.ix)))
    got = sorted(tuple(c for _, c in sorted(v)) for v in per.values())
    assert got in ([tuple((10, x) for x in range(60)), tuple((40 + k, k) for k in range(15))], [tuple((10, x) for x in range(59, -1, -1)), tuple((40 + k, k) for k in range(15))], [tuple((10, x) for x in range(60)), tuple((40 + k, k) for k in range(14, -1, -1))], [tuple((10, x) for x in range(59, -1, -1)), tuple((40 + k, k) for k in range(14, -1, -1))])


def land(spark, shape, road, **more):
    """Forest of 12 m with open cells where road(y, x)."""
    rows = [(y, x, 0.2 if road(y, x) else 12.0, 100.0, 1.0 if road(y, x) else 0.2, 0.8, 0.0, 0.0) for y in range(shape[0]) for x in range(shape[1])]
    return spark.createDataFrame(rows, "iy int, ix int, chm double, dtm double, ground_share double, forest double, rough double, slope double").repartition(4)


def test_track_through_four_tiles_is_one_line(spark):
    """A strip that crosses both borders of four tiles comes back as one ordered line, as it does from one tile."""
    road = lambda y, x: abs(y - (20 + 0.5 * x)) <= 2 and 4 <= x < 96
    cells = land(spark, (90, 100), road)
    none = spark.createDataFrame([(900.0, 900.0)], "x double, y double")
    four = discover.find_tracks(cells, 1.0, none, tile=50).toPandas().sort_values("seq")
    one = discover.find_tracks(cells, 1.0, none, tile=400).toPandas().sort_values("seq")
    for t in (four, one):
        assert t["track"].nunique() == 1 and len(t) > 80
        step = np.hypot(np.diff(t["x"]), np.diff(t["y"]))
        assert step.max() < 1.6 and t["x"].max() - t["x"].min() > 75 and t["straight"].iloc[0] > 0.9 and t["side"].iloc[0] > 0.9
    assert {(r.iy, r.ix) for r in network.skeleton(cells.withColumn("open", F.col("chm") < 1.5), "open", 1.0, 50).collect()} == {(r.iy, r.ix) for r in network.skeleton(cells.withColumn("open", F.col("chm") < 1.5), "open", 1.0, 400).collect()}
    line = spark.createDataFrame([(50.0, float(y)) for y in range(90)], "x double, y double")
    cut = discover.find_tracks(cells, 1.0, none, tile=50, least_m=20.0, power=line)
    assert cut.select("track").distinct().count() == 2 and cut.filter("abs(x - 50) < 10").count() == 0


def test_road_network_of_a_scan(spark):
    """A road, a branch off it, and no field: two classes of width, one network, whole across tiles."""
    road = lambda y, x: (abs(y - 30) <= 4 and x < 118) or (abs(x - 60) <= 3 and 30 <= y < 88) or (y > 60 and x < 30)
    roads, vertices = network.road_network(land(spark, (100, 120), road), 1.0, tile=60)
    r = roads.toPandas()
    assert len(r) >= 3 and r["network"].nunique() == 1 and (r["confidence"] >= 0.6).all() and r["length"].sum() > 140
    assert ((r["corridor"] - 7).abs() < 1.6).any() and ((r["corridor"] - 9).abs() < 1.6).any()
    v = vertices.toPandas()
    assert not ((v["y"] > 66) & (v["x"] < 26)).any()
    for _, g in v.sort_values("seq").groupby("chain"):
        assert np.hypot(np.diff(g["x"]), np.diff(g["y"])).max() < 1.5


def test_steep_or_closed_gaps_are_not_linked(spark):
    """Of four ends that point at another network, those over open and flat ground are linked, the shorter of two that join the same pair."""
    cols = "chain long, seq long, network int, x double, y double, ux double, uy double"
    ends = [(1, 9, 1, 20.0, 20.5, 1.0, 0.0), (2, 0, 2, 50.0, 20.5, -1.0, 0.0), (3, 5, 3, 20.0, 60.5, 1.0, 0.0), (5, 3, 5, 20.0, 90.5, 1.0, 0.0)]
    others = [(4, 7, 4, 50.0, 60.5, 0.0, 0.0), (6, 2, 6, 50.0, 90.5, 0.0, 0.0), (2, 3, 2, 60.0, 20.5, 0.0, 0.0)]
    cells = [(y, x, 12.0 if 85 < y < 95 else 0.5, 30.0 if 55 < y < 65 and x == 35 else 1.0, 1.0) for y in range(120) for x in range(80)]
    found = network.candidate_links(spark.createDataFrame(ends, cols), spark.createDataFrame(ends + others, cols), spark.createDataFrame(cells, "iy int, ix int, chm double, slope double, firm double"), 1.0)
    got = {(r.chain, r.to_chain): r for r in found.collect()}
    assert set(got) == {(1, 2), (2, 1), (3, 4), (5, 6)} and got[1, 2].d == 30 and got[3, 4].steepest == 30 and got[5, 6].open_share == 0
    assert [(r.chain, r.to_chain) for r in network.chosen_links(found).collect()] == [(1, 2)]


def test_least_links_equal_kruskal(spark):
    rng = random.Random(5)
    rows = [(k, 0, rng.randrange(12), 100 + k, 0, rng.randrange(12), round(rng.uniform(3, 60), 1), rng.choice((0.9, 0.9, 0.5)), 0.9, 5.0) for k in range(60)]
    rows = [r for r in rows if r[2] != r[5]]
    df = spark.createDataFrame(rows, "chain long, end_seq long, network int, to_chain long, to_seq long, to_network int, d double, open_share double, firm_share double, steepest double")
    group, want = list(range(12)), set()
    for r in sorted((r for r in rows if r[7] >= 0.6), key=lambda r: (r[6], r[0])):
        a, b = group[r[2]], group[r[5]]
        if a != b:
            want.add(r[0])
            group = [a if g == b else g for g in group]
    assert {r.chain for r in network.chosen_links(df).collect()} == want


def test_relax_goes_on_until_nothing_improves(spark, monkeypatch):
    """A path of 70 hops, and the way back over its predecessors, of several ends at once."""
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(70)] + [(0, 40, 50.0), (3, 5, 2.0)], "src long, dst long, w double")
    d = graph.relax(edges, spark.createDataFrame([(0, 0.0), (60, 55.0)], "node long, dist double"), before=True)
    assert {r.node: r.dist for r in d.collect()} == {k: float(k) if k < 60 else float(k - 5) for k in range(71)}
    paths = {}
    for r in graph.paths_to(d, spark.createDataFrame([(37,), (70,), (0,), (99,)], "node long")).collect():
        paths.setdefault(r.end, []).append((r.seq, r.node))
    assert [n for _, n in sorted(paths[37])] in (list(range(38)), [k for k in range(38) if k != 4])
    assert [n for _, n in sorted(paths[70])] == list(range(60, 71)) and paths[0] == [(0, 0)] and 99 not in paths


def test_fill_without_reach(spark):
    """Holes of any size take the nearest value; of equally near ones the first in row order."""
    rng = random.Random(3)
    cells = [(s, y, x, float(1000 * y + x) if rng.random() < 0.02 and s < 2 else None) for s in range(3) for y in range(30) for x in range(40)]
    df = spark.createDataFrame(cells, "site int, iy int, ix int, v double")
    got = {(r.site, r.iy, r.ix): r.v for r in grid.nearest_fill(df, "v", ("site",)).collect()}
    far = 0
    for s in range(3):
        have = [(y, x) for t, y, x, v in cells if t == s and v is not None]
        for y in range(30):
            for x in range(40):
                if not have:
                    assert got[s, y, x] is None
                    continue
                d, qy, qx = min(((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in have)
                far = max(far, d)
                assert got[s, y, x] == 1000 * qy + qx
    assert math.sqrt(far) > 8
