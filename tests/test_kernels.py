import numpy as np

from boreal.operators import discover, grid, kernels


def table(spark, **arrays):
    h, w = next(iter(arrays.values())).shape
    y, x = np.mgrid[:h, :w]
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"iy": y.ravel(), "ix": x.ravel(), **{k: a.ravel() for k, a in arrays.items()}})).selectExpr("CAST(iy AS INT) iy", "CAST(ix AS INT) ix", *arrays)


def test_distance_and_labels():
    rng = np.random.default_rng(0)
    m = rng.random((25, 31)) < 0.05
    y, x = np.nonzero(m)
    yy, xx = np.mgrid[:25, :31]
    want = np.sqrt(((yy[..., None] - y) ** 2 + (xx[..., None] - x) ** 2).min(-1))
    assert np.allclose(kernels.distance(m), want)
    a, n = kernels.label(np.array([[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 1, 0]], bool))
    assert n == 4 and a[0, 0] == a[0, 1] and a[0, 3] == a[1, 3]
    assert kernels.label(np.eye(5, dtype=bool), kernels.EIGHT)[1] == 1


def canopy(n=120, k=14):
    rng = np.random.default_rng(3)
    yy, xx = np.mgrid[:n, :n] * 0.5
    out, tops = np.zeros((n, n)), []
    for _ in range(k * 20):
        x, y, h = rng.uniform(3, n / 2 - 3), rng.uniform(3, n / 2 - 3), rng.uniform(8, 22)
        if all((x - a) ** 2 + (y - b) ** 2 > 130 for a, b, _ in tops) and len(tops) < k:
            tops.append((x, y, h))
            out = np.maximum(out, h - 1.6 * np.hypot(xx + 0.25 - x, yy + 0.25 - y) ** 1.2)
    return np.maximum(out, 0), tops


def test_trees_found_alike_in_one_tile_and_in_four(spark):
    chm, tops = canopy()
    cells = table(spark, chm=chm)
    one = sorted(map(tuple, kernels.detect_trees(cells, 0.5, 400).collect()))
    four = sorted(map(tuple, kernels.detect_trees(cells, 0.5, 60, 15.0).collect()))
    assert len(one) == len(tops)
    assert np.allclose(one, four)
    got = np.array(one)
    for x, y, h in tops:
        k = np.argmin((got[:, 0] - x) ** 2 + (got[:, 1] - y) ** 2)
        assert np.hypot(got[k, 0] - x, got[k, 1] - y) < 1 and abs(got[k, 2] - h) < 1.5
    found = spark.createDataFrame([(k, float(r[0]), float(r[1]), float(r[2])) for k, r in enumerate(one)], "found_id long, x double, y double, h double")
    truth = spark.createDataFrame([(k, *map(float, t)) for k, t in enumerate(tops)], "tree_id long, x double, y double, h double")
    m = kernels.match_trees(found, truth).collect()
    assert len(m) == len(tops) == len({r.tree_id for r in m}) == len({r.found_id for r in m})


def test_thinning_tracks_and_ground(spark):
    m = np.zeros((40, 60), bool)
    m[18:23, 4:56] = True
    s = kernels.thinned(m)
    assert 40 < s.sum() < 60 and len(discover.longest_path(s)) > 40
    cross = np.zeros((21, 21), bool)
    cross[10, :] = cross[:, 10] = True
    assert discover.junctions(cross).sum() >= 1
    chm = np.where(m, 0.2, 9.0)
    one = np.ones_like(chm)
    cells = table(spark, chm=chm, forest=one, rough=0 * one, slope=0 * one, ground_share=one)
    none = spark.createDataFrame([(900.0, 900.0)], "x double, y double")
    t = discover.find_tracks(cells, 2.0, none)
    assert t.select("track").distinct().count() == 1 and t.agg({"straight": "min"}).first()[0] > 0.9
    assert discover.find_tracks(cells, 2.0, spark.createDataFrame([(float(x), 41.0) for x in range(120)], "x double, y double")).count() == 0
    rng = np.random.default_rng(1)
    pts = [(float(x), float(y), 0.05 * float(x) + (0 if k % 3 else 12)) for k, (x, y) in enumerate(rng.uniform(0, 60, (3000, 2)))]
    g = kernels.ground_filter(spark.createDataFrame(pts, "x double, y double, z double")).toPandas()
    assert (g["ground"] == (g["z"] - 0.05 * g["x"] < 1)).mean() > 0.93


def test_buildings_wires_and_gaps(spark):
    chm = np.zeros((60, 60))
    chm[10:18, 10:20] = 5.0
    chm[40:41, 5:50] = 6.0  # too thin
    b = discover.find_buildings(table(spark, chm=chm, residual=0 * chm, ground_share=np.where(chm > 0, 0.0, 1.0)), 1.0, 64).collect()
    assert len(b) == 1 and abs(b[0].x - 15) < 0.1 and abs(b[0].y - 14) < 0.1 and 60 <= b[0].area <= 80
    rng = np.random.default_rng(2)
    line = [("s", float(t), float(0.5 * t + rng.normal(0, 0.3)), 10.0) for t in np.linspace(0, 200, 400)] + [("s", *map(float, rng.uniform(0, 200, 2)), 10.0) for _ in range(60)]
    f = discover.fit_lines(spark.createDataFrame(line, "site string, x double, y double, h double"), "site").collect()
    assert len(f) == 1 and abs(abs(f[0].uy / f[0].ux) - 0.5) < 0.03 and f[0].length > 190
    ends = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 0.0), (2, 2, 20.0, 1.0, -1.0, 0.0), (3, 3, 0.0, 20.0, 0.0, 1.0)], "end_id int, road int, x double, y double, ux double, uy double")
    assert [(r.a, r.b) for r in discover.close_gaps(ends).collect()] == [(1, 2)]


def test_nearest_fill_and_pits(spark):
    a = np.array([[1.0, np.nan, np.nan], [4.0, 0.0, 5.0], [6.0, 7.0, 8.0]])
    t = table(spark, chm=a).selectExpr("iy", "ix", "nullif(chm, 'NaN'::double) chm")
    got = {(r.iy, r.ix): r.chm for r in grid.nearest_fill(t, "chm").collect()}
    assert got[0, 1] == 1.0 and got[0, 2] == 5.0
    assert {(r.iy, r.ix): r.chm for r in grid.fill_pits(table(spark, chm=np.where(np.isnan(a), 5, a))).collect()}[1, 1] == 5.0


def test_spurs_go_and_ends_stay():
    s = np.zeros((20, 60), bool)
    s[10, 2:58] = True
    s[7:10, 30] = True  # a spur of three cells
    s[2:10, 45] = True  # a branch of eight
    out = discover.pruned(s, 4)
    assert out[10, 2:58].all() and not out[7:9, 30].any() and out[2:10, 45].all()
    assert discover.longest_path(out)[0] in ((10, 2), (10, 57)) and len(discover.longest_path(out)) == 56


def test_colour_scale(spark):
    from boreal.operators import grid

    r = grid.colour_scale(spark.range(1000), "id").first()
    assert abs(r.low - 20) <= 1 and abs(r.high - 980) <= 1
