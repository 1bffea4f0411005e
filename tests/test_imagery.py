"""Lines and roads in pictures: Hough votes against a loop, merging against the sequential fold, and a planted road and corridor."""

import math
import random
from collections import Counter

import numpy as np

from boreal.operators import imagery


def test_votes_and_peaks_equal_a_loop(spark):
    rng = random.Random(1)
    points = [(float(x), round(20 + 0.4 * x + rng.gauss(0, 0.3), 3)) for x in range(0, 90, 2)] + [(round(rng.uniform(0, 90), 3), round(rng.uniform(0, 90), 3)) for _ in range(40)] + [(5.0, float(y)) for y in range(0, 80, 2)]
    votes = Counter()
    for x, y in points:
        for k in range(36):
            a = k * math.pi / 36
            votes[k, math.floor(round((x * math.cos(a) + y * math.sin(a)) / 2, 9))] += 1
    df = spark.createDataFrame(points, "x double, y double")
    v = imagery.hough_votes(df, 36, 2.0)
    assert {(r.k, r.bin): r.votes for r in v.collect()} == dict(votes)
    strong = {p: n for p, n in votes.items() if n >= 12}

    def beside(p, q):
        dk = q[0] - p[0]
        return (abs(dk) <= 3 and abs(q[1] - p[1]) <= 3) or (36 - abs(dk) <= 3 and abs(-q[1] - 1 - p[1]) <= 3)

    want = {p for p, n in strong.items() if not any((m, -q[0], -q[1]) > (n, -p[0], -p[1]) and beside(p, q) for q, m in strong.items() if q != p)}
    peaks = imagery.hough_peaks(v, 12, 36, 3, 3)
    assert {(r.k, r.bin) for r in peaks.collect()} == want and len(want) >= 2
    pieces = imagery.straight_pieces(df, peaks, 60.0, 8.0, 36, 2.0).collect()
    ends = [sorted([(r.ax, r.ay), (r.bx, r.by_)]) for r in pieces]
    assert any(abs(a[0] - 5) < 2.5 and abs(b[0] - 5) < 2.5 and abs(a[1] - b[1]) > 70 for a, b in ends) and any(abs((b[1] - a[1]) / (b[0] - a[0]) - 0.4) < 0.1 for a, b in ends if b[0] - a[0] > 20)


def test_merging_equals_the_fold(spark):
    rng = random.Random(2)
    lines = []
    for k in range(80):
        a, d = rng.choice((0.0, 0.02, 1.0, 1.05, 2.4, 3.12)), rng.choice((0.0, 3.0, 6.0, 30.0))
        t0, size = rng.uniform(0, 80), rng.uniform(20, 60)
        at = lambda t, a=a, d=d: (t * math.cos(a) - d * math.sin(a), t * math.sin(a) + d * math.cos(a))
        ends = [at(t0), at(t0 + size)]
        lines.append((k, *(ends[0] if k % 2 else ends[1]), *(ends[1] if k % 2 else ends[0])))
    kept = []
    for k, *p in sorted(lines, key=lambda r: (-math.hypot(r[3] - r[1], r[4] - r[2]), r[0])):
        p0, p1 = np.array(p[:2]), np.array(p[2:])
        u = (p1 - p0) / (np.hypot(*(p1 - p0)) + 1e-9)
        for m in kept:
            q0, v = m["o"], m["v"]
            if abs(u @ v) > 0.995 and all(abs((e - q0) @ np.array([-v[1], v[0]])) < 8 for e in (p0, p1)):
                m["t"] += [(p0 - q0) @ v, (p1 - q0) @ v]
                break
        else:
            kept.append({"line": k, "o": p0, "v": u, "t": [0.0, (p1 - p0) @ u]})
    got = {r.line: (r.ax, r.ay, r.bx, r.by_) for r in imagery.merged_lines(spark.createDataFrame(lines, "line int, ax double, ay double, bx double, by_ double")).collect()}
    assert set(got) == {m["line"] for m in kept} and len(kept) < len(lines)
    for m in kept:
        assert np.allclose(got[m["line"]], [*(m["o"] + m["v"] * min(m["t"])), *(m["o"] + m["v"] * max(m["t"]))])


def test_planted_road_and_corridor(spark):
    """Gravel is a road, a bright green strip is a corridor, and neither is taken for the other; a mapped road is told."""
    rng = np.random.default_rng(4)
    rows = []
    for y in range(110):
        for x in range(200):
            colour = (40, 70, 35)  # crowns
            if abs(y - 15 - 0.1 * x) <= 3:
                colour = (150, 140, 130)
            elif abs(y - 85) <= 7:
                colour = (110, 160, 90)
            rows.append((1, y, x, *(int(c) for c in np.clip(np.array(colour) + rng.integers(-4, 5, 3), 0, 255))))
    cells = imagery.classified(spark.createDataFrame(rows, "photo int, iy int, ix int, red int, green int, blue int"), ("photo",)).cache()
    share = {c: cells.filter(c).count() / len(rows) for c in imagery.CLASSES}
    assert abs(share["road"] - 7 / 110) < 0.02 and 15 / 110 - 0.01 < share["cleared"] < 0.3 and share["water"] == 0
    lanes = imagery.corridors(cells, 1.0, by=("photo",)).collect()
    assert len(lanes) == 1 and abs(lanes[0].ay - 85.5) < 2 and abs(lanes[0].by_ - 85.5) < 2 and lanes[0].length > 150 and 10 < lanes[0].width < 25
    known = spark.createDataFrame([(float(x), 15 + 0.1 * x) for x in range(0, 200, 5)], "x double, y double")
    lane = spark.createDataFrame([(float(x), 85.0) for x in range(0, 200, 5)], "x double, y double")
    road = imagery.image_roads(cells, 1.0, known=known, apart_from=lane, by=("photo",)).toPandas()
    assert road["line"].nunique() == 1 and road["mapped"].all() and road["confidence"].min() > 0.8 and 5 < road["width"].iloc[0] < 9
    assert (np.abs(road["y"] - 15 - 0.1 * road["x"]) < 3).all() and road["x"].max() - road["x"].min() > 130
    assert not halved_roads(cells)


def halved_roads(cells):
    """At half the resolution every class keeps its share."""
    small = imagery.halved(cells, ("photo",))
    n = small.count()
    return n != 55 * 100 or abs(small.filter("road").count() / n - 7 / 110) > 0.03
