"""Assets burnt into cells, ordered dedupe, and storm response from a warm start, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreal.operators import assets, fleet, spatial


def burn(pieces, half):
    """First writer wins: pieces in order, each the disc around the cells that its points lie in."""
    out = {}
    r = math.ceil(half)
    for name, points in pieces:
        cells = {(math.floor(y), math.floor(x)) for x, y in points}
        for y, x in cells:
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    if dy * dy + dx * dx <= half * half:
                        out.setdefault((y + dy, x + dx), name)
    return out


def test_lines_are_burnt_in_pieces(spark):
    """A bent road and one that crosses it: the first piece has a cell, pieces are equal and near their length, and borders belong to both."""
    lines = {1: [(0.5, 0.5), (40.5, 0.5), (40.5, 30.5)], 2: [(20.5, -10.5), (20.5, 20.5)]}
    v = spark.createDataFrame([(k, i, x, y) for k, vs in lines.items() for i, (x, y) in enumerate(vs)], "line int, seq int, x double, y double")
    pieces = assets.line_pieces(assets.dense_line(v, ["line"]), ["line"], 25.0)
    want = []
    for k, vs in lines.items():
        points, at = [(0.0, *vs[0])], 0.0
        for (ax, ay), (bx, by) in zip(vs, vs[1:], strict=False):
            size = math.hypot(bx - ax, by - ay)
            points += [(at + s, ax + (bx - ax) * s / size, ay + (by - ay) * s / size) for s in range(1, int(size) + 1)]
            at += size
        n = max(1, round(at / 25))
        want += [((k, p), [(x, y) for s, x, y in points if p * at / n - 1e-6 <= s <= (p + 1) * at / n + 1e-6]) for p in range(n)]
    rows = pieces.collect()
    assert {(r.line, r.piece) for r in rows} == {name for name, _ in want}
    for name, points in want:
        assert sorted((round(r.x, 6), round(r.y, 6)) for r in rows if (r.line, r.piece) == name) == sorted((round(x, 6), round(y, 6)) for x, y in points)
    for half in (3.0, 1.8):
        got = {(r.iy, r.ix): (r.line, r.piece) for r in assets.burnt(pieces, ["line"], half).collect()}
        assert got == burn(want, half)
    wide = spark.createDataFrame([(1, 3.0), (2, 1.8)], "line int, half double")
    assert assets.burnt(pieces, ["line"], wide).filter("line = 2").count() < assets.burnt(pieces, ["line"], 3.0).filter("line = 2").count()


def test_conductors_are_reached_at_their_height(spark):
    """A tree of 15 m reaches 12 m of a conductor at 9 m: one at 11 m is struck, one at 13 m is not, though a road there is."""
    trees = spark.createDataFrame([(1, 0.5, 0.5, 15.0, 0.4)], "tree_id long, x double, y double, h double, p_fail double")
    cells = [("power", 0, 11, 1, 0), ("power", 13, 0, 2, 0), ("road", 0, -13, 3, 0), ("road", 0, -14, 4, 0)]
    raster = spark.createDataFrame(cells, "kind string, iy int, ix int, line int, piece int")
    hits = assets.strikes(trees, raster, 9.0, 36)
    assert sorted((r.kind, r.direction, r.step, r.line) for r in hits.collect()) == [("power", 0, 11, 1), ("road", 18, 13, 3)]
    p = {r.line: r.p for r in assets.piece_risk(hits, trees, 270.0, 2.0).collect()}  # wind from the west: trees fall east
    density = [math.exp(2.0 * math.cos(2 * math.pi * k / 36)) for k in range(36)]
    assert abs(p[1] - 0.4 * density[0] / sum(density)) < 1e-9 and abs(p[3] - 0.4 * 0.7 * density[18] / sum(density)) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_points_apart_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    points = [(k, rng.uniform(0, 60), rng.uniform(0, 60), rng.randrange(5)) for k in range(250)]
    kept = []
    for k, x, y, h in sorted(points, key=lambda p: (-p[3], p[0])):
        if all(math.hypot(x - a, y - b) > 5 for _, a, b in kept):
            kept.append((k, x, y))
    got = spatial.apart(spark.createDataFrame(points, "id long, x double, y double, h int"), "id", [-F.col("h"), F.col("id")], 5.0)
    assert {r.id for r in got.collect()} == {k for k, _, _ in kept}


def test_parallel_lines_are_one(spark):
    rng = random.Random(4)
    lines = []
    for k in range(60):
        a, x, y, size = rng.uniform(0, math.pi), rng.uniform(0, 120), rng.uniform(0, 120), rng.uniform(30, 90)
        lines.append((k, x, y, x + size * math.cos(a), y + size * math.sin(a), rng.randrange(40)))
        if k % 3 == 0:
            lines.append((100 + k, x + 2, y + 1, x + size * math.cos(a) + 2, y + size * math.sin(a), rng.randrange(40)))

    def distance(px, py, q):
        dx, dy = q[3] - q[1], q[4] - q[2]
        t = max(0, min(1, ((px - q[1]) * dx + (py - q[2]) * dy) / max(dx * dx + dy * dy, 1e-9)))
        return math.hypot(px - q[1] - t * dx, py - q[2] - t * dy)

    kept = []
    for p in sorted(lines, key=lambda p: (-p[5], p[0])):
        samples = [(p[1] + t * (p[3] - p[1]), p[2] + t * (p[4] - p[2])) for t in np.linspace(0, 1, 10)]
        if not any(np.mean([distance(x, y, q) < 6 for x, y in samples]) > 0.6 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(lines, "id long, ax double, ay double, bx double, by_ double, n int")
    assert {r.id for r in spatial.distinct_lines(df, "id", [-F.col("n"), F.col("id")]).collect()} == {p[0] for p in kept} and len(kept) < len(lines)


def fleet_tables(spark, seed):
    rng = random.Random(seed)
    nodes = {1: range(0, 6), 2: range(6, 12)}
    tasks = [(r, 100 * r + k, rng.choice(nodes[r][2:]), rng.randrange(8), rng.randrange(4, 14), float(rng.randrange(60, 300)), float(rng.choice((1, 2, 3))), rng.random() < 0.3) for r in nodes for k in range(40)]
    shifts = [(r, d, 10 * r + o, nodes[r][o], 480, 480 + 60 * rng.randrange(4, 9), o == 0) for r in nodes for d in range(14) for o in range(2)]
    # some places lie further away than a shift is long, so that crews travel over days
    travel = [(r, a, b, float(rng.choice((450, 700, 900)))) for r in nodes for a in nodes[r] for b in nodes[r] if a != b]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return make(tasks, "region int, task_id long, node_id long, release int, due int, duration double, prio double, needs_ms boolean"), make(shifts, "region int, day int, op_id long, home long, start int, end int, has_ms boolean"), make(travel, "region int, from long, to long, minutes double")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_plan_that_is_cut_and_resumed_is_the_same(spark, seed):
    tasks, shifts, travel = fleet_tables(spark, seed)
    whole = sorted(map(tuple, fleet.schedule(tasks, shifts, travel, "region").collect()))
    assert whole
    got, left, state = [], tasks, None
    for a, b in ((0, 3), (3, 4), (4, 14)):
        done, left, state = fleet.resume_from(left, shifts.filter(F.col("day").between(a, b - 1)), travel, "region", state)
        got += map(tuple, done.collect())
    assert sorted(got) == whole
    assert any(r.goal is not None or len(r.held) for r in fleet.resume_from(tasks, shifts.filter("day < 3"), travel, "region")[2].collect()) or seed != 1


def test_storm_response_has_three_branches_of_one_start(spark):
    tasks, shifts, travel = fleet_tables(spark, 5)
    storm = spark.createDataFrame([(r, 1000 * r + k, 6 * (r - 1) + k % 6, 40.0, float(k)) for r in (1, 2) for k in range(8)], "region int, task_id long, node_id long, duration double, exposure double")
    plan, figures = fleet.storm_response(tasks, shifts, travel, storm, 5, 6)
    rows = [tuple(r) for r in plan.collect()]
    of = {b: {r[:1] + r[2:] for r in rows if r[1] == b} for b in fleet.BRANCHES}
    before = {b: {r for r in of[b] if r[1] < 5} for b in of}
    assert before["none"] == before["emergency"] == before["uniform"] and before["none"]
    assert of["none"] == {tuple(r) for r in fleet.schedule(tasks, shifts.filter("day <= 11"), travel, "region").collect()}
    f = {(r.region, r.branch): r for r in figures.collect()}
    assert len(f) == 6 and all(f[r, "none"].storm_done == 0 and f[r, "none"].delayed == 0 for r in (1, 2))
    for r in (1, 2):
        one = [x for x in rows if x[0] == r and x[1] == "emergency" and x[4] >= 1000]
        hours = {x[4]: 24 * (x[2] - 5) + (x[5] + x[7]) / 60 + 2 for x in one}
        assert f[r, "emergency"].storm_done == len(one) > 0 and f[r, "emergency"].within_24h == sum(h <= 24 for h in hours.values())
        exposure = {t: t - 1000 * r for t in hours}
        assert abs(f[r, "emergency"].exposure_hours - sum(exposure[t] * h for t, h in hours.items()) / max(sum(exposure.values()), 1e-6)) < 1e-9
    assert sum(f[r, "emergency"].within_24h for r in (1, 2)) >= sum(f[r, "uniform"].within_24h for r in (1, 2))
