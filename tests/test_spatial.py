"""Joins on grid buckets where many rows share a position: the same rows as pair by pair, and no pair of rows made."""

import math
import os
import random

from pyspark.sql import functions as F

from boreal.functions import geo
from boreal.operators import routes, spatial
from boreal.plans.queries import QUERIES
from boreal.plans.rounds import Rounds


def crowd(seed, n, places):
    """(id, x, y, h): n rows at few positions, some without one."""
    rng = random.Random(seed)
    at = [(rng.randrange(40) / 2, rng.randrange(40) / 2) for _ in range(places)]
    return [(k, *(rng.choice(at) if k % 29 else (None, 3.0)), rng.randrange(6)) for k in range(n)]


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, x double, y double, h int")


def apart(a, b):
    return math.inf if None in (a[1], b[1]) else math.hypot(a[1] - b[1], a[2] - b[2])


def joined_rows(df):
    """The most rows that a join of the executed plan put out."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        children = [p.children().apply(i) for i in range(p.children().size())]
        children += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else []
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        plans += children
    return most


def test_nearest_among_rows_at_one_position(spark):
    a, b = crowd(1, 500, 9), crowd(2, 300, 7)
    got = spatial.nearest_within(table(spark, a, "a"), "a", table(spark, b, "b"), "b", 6.0)
    want = {p[0]: min((apart(p, q), q[0]) for q in b) for p in a}
    assert {(r.a, (r.d, r.b)) for r in got.collect()} == {(k, v) for k, v in want.items() if v[0] <= 6}
    assert joined_rows(got) <= 500


def test_three_nearest_among_rows_at_one_position(spark):
    a, b = crowd(3, 500, 9), crowd(4, 300, 7)
    got = spatial.k_nearest_within(table(spark, a, "a"), "a", table(spark, b, "b"), "b", 6.0, 3)
    want = {p[0]: sorted((apart(p, q), q[0]) for q in b if apart(p, q) <= 6)[:3] for p in a}
    assert sorted((r.a, r["rank"], r.d, r.b) for r in got.collect()) == [(k, i, *x) for k, v in sorted(want.items()) for i, x in enumerate(v, 1)]
    assert joined_rows(got) <= 3 * 500


def test_visible_trees_at_one_position(spark):
    """Trees that share an id are not compared with each other, and stay or go one by one."""
    rows = crowd(5, 400, 60)
    rows += [(k, x, y, h + 2) for k, x, y, h in rows[:40]] + [(None, *p[1:]) for p in rows[50:60]] + [(500 + k, *p[1:3], None) for k, p in enumerate(rows[60:70])]
    got = spatial.no_taller_neighbour(table(spark, rows, "tree_id"), 1.5)
    hides = lambda q, p: None not in (p[0], q[0], p[3], q[3]) and q[0] != p[0] and q[3] > p[3] and apart(p, q) <= 1.5
    want = [p for p in rows if not any(hides(q, p) for q in rows)]
    assert 0 < len(want) < len(rows) and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert joined_rows(got) <= len(rows)


def test_apart_at_one_position(spark, monkeypatch):
    """As the walk does it; of a position only the first point enters a pair."""
    rows = crowd(6, 400, 60)
    kept = []
    for p in sorted(rows, key=lambda p: (-p[3], p[0])):
        if all(apart(p, q) > 2 for q in kept):
            kept.append(p)
    pairs, walk = [], spatial.first_apart
    monkeypatch.setattr(spatial, "first_apart", lambda items, near: pairs.append(near.count()) or walk(items, near))
    got = spatial.apart(table(spark, rows, "id"), "id", [-F.col("h"), F.col("id")], 2.0)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, kept))
    assert 0 < pairs[0] <= 60 * 59 / 2


def test_points_in_polygons_at_one_position(spark, monkeypatch):
    """The rule is applied to a position and a ring once; every point and polygon that has them is in the result."""
    points = crowd(7, 300, 12)
    rings = [[(x, y), (x + 4.0, y), (x + 4.0, y + 3.0), (x, y + 3.0)] for x, y in ((0.25, 0.25), (3.25, 5.25), (9.25, 8.25), (14.25, 2.25))]
    plots = [(k, rings[k % 4]) for k in range(60)]
    inside = lambda p, ring: p[1] is not None and ring[0][0] <= p[1] < ring[2][0] and ring[0][1] <= p[2] < ring[2][1]
    asked, rule = spark.sparkContext.accumulator(0), geo.in_ring
    ask = F.udf(lambda hit: asked.add(1) or hit, "boolean")
    monkeypatch.setattr(geo, "in_ring", lambda x, y, ring: ask(rule(x, y, ring)))
    polygons = spark.createDataFrame(plots, "plot long, ring array<struct<x: double, y: double>>")
    got = spatial.points_in_polygons(table(spark, points, "id"), "id", polygons, "plot", 10.0)
    want = [(p[0], k) for p in points for k, ring in plots if inside(p, ring)]
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    assert 0 < asked.value <= 12 * 4


def test_ways_of_sites_are_searched_in_one_step(spark, monkeypatch):
    """The query's ways are written once, whatever their length; before, every step along them was."""
    written, keep = [], Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df, name: written.append(name) or keep(self, df, name))
    QUERIES["walk_drive_walk"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).collect()
    assert 0 < len(written) <= 4


def test_ways_by_site_equal_those_of_rounds(spark):
    """Equal weights, so that ways tie; ends that nothing reaches, and a start that is its end."""
    rng = random.Random(9)
    edge = lambda s, k: (s, 100 * s + rng.randrange(k), 100 * s + rng.randrange(k), float(rng.choice([1, 1, 2])))
    schema = "site int, src long, dst long, w double"
    foot, drive = (spark.createDataFrame([edge(s, 30) for s in (1, 2, 3) for _ in range(n)], schema) for n in (60, 70))
    stops = spark.createDataFrame([(s, 100 * s + k) for s in (1, 2, 3) for k in range(0, 30, 4)], "site int, cell long")
    asked = [(10 * s + i, s, 100 * s + rng.randrange(30), 100 * s + rng.randrange(32), i % 3 == 1, i % 4 == 1) for s in (1, 2, 3) for i in range(6)] + [(90, 1, 105, 105, False, False), (91, 1, 108, 108, True, True), (92, 1, None, 101, False, False)]
    requests = spark.createDataFrame(asked, "route int, site int, start long, end long, start_on_road boolean, end_on_road boolean")
    cells = spark.createDataFrame([(100 * s + k, k % 2 == 0, k % 5 == 0) for s in (1, 2, 3) for k in range(32)], "cell long, road boolean, blocked boolean")
    a, b = (routes.routes(drive, foot, stops, requests, cells, 0.5, site) for site in ("site", None))
    for x, y in zip(a, b, strict=True):
        assert sorted(map(repr, map(tuple, x.collect()))) == sorted(map(repr, map(tuple, y.select(*x.columns).collect())))
    assert 5 < a[0].count() < len(asked)
