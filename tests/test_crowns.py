"""Species and health by the best that each site has, in one plan."""

import numpy as np

from boreal.operators import crowns


def table(spark, seed=1):
    """Three sites: with colours and known trees, with intensity, with neither. Spruce is narrow and low, birch wide and bright, some trees are dead."""
    rng, points, trees, known, truth = np.random.default_rng(seed), [], [], [], {}
    for site in ("colour", "laser", "bare"):
        for k in range(90):
            kind, dead = k % 3, k % 10 == 0
            h, area = 20.0, (16.0, 9.0, 30.0)[kind]
            trees.append((site, k, h, area))
            truth[site, k] = (kind, 2 if dead else 0)
            if k % 3 != 2 or k < 60:
                known += [(site, k, kind)] if site == "colour" and k < 45 else []
            for _ in range(int(area * (0.6 if dead else 3))):
                hag = float(h * (rng.uniform(0.3, 1) if kind == 1 else rng.uniform(0.5, 1)))
                nir = int(rng.normal(60 if dead else 200, 5)) if site == "colour" else 0
                points.append((site, k, hag, 5, int(rng.normal(60, 3)), int(rng.normal(110 if kind == 2 else 70, 3)), nir, int(rng.normal(100 if dead else 300, 8)) if site == "laser" else 0))
    p = spark.createDataFrame(points + [("colour", 0, 0.5, 5, 0, 0, 0, 0), ("colour", 0, 9.0, 2, 0, 0, 0, 0)], "site string, tree_id long, hag double, cls int, red int, green int, nir int, intensity int").repartition(4)
    return p, spark.createDataFrame([*trees, ("bare", 999, 8.0, 4.0)], "site string, tree_id long, h double, crown_area double"), spark.createDataFrame(known, "site string, tree_id long, species int"), truth


def test_every_site_gets_its_best(spark):
    points, trees, known, truth = table(spark)
    f = crowns.crown_features(points, trees).cache()
    got = {(r.site, r.tree_id): r for r in crowns.classified(f, known).collect()}
    assert len(got) == 271 and got["bare", 999].pts == 0
    of = lambda site: [(r, truth[k]) for k, r in got.items() if k[0] == site and k in truth]
    assert {r.species_source for r, _ in of("colour")} == {"calibrated"} and np.mean([r.species == t[0] for r, t in of("colour")]) > 0.9
    assert {r.species_source for r, _ in of("laser")} == {"rules"} and np.mean([(r.species == 1) == (t[0] == 1) for r, t in of("laser")]) > 0.9
    assert [{r.health_source for r, _ in of(s)} for s in ("colour", "laser", "bare")] == [{"ndvi"}, {"intensity and density"}, {"density"}]
    for site in ("colour", "laser", "bare"):
        assert np.mean([(r.health == 2) == (t[1] == 2) for r, t in of(site)]) > 0.95, site
    # a trained model takes the sites that have none of their own
    models = crowns.site_models(f, known).filter("feature in ('crown_ratio', 'low_frac', 'rel_mean')")
    trained = models.selectExpr("false AS multispectral", "class", "feature", "mu", "var", "prior")
    again = crowns.classified(f, known, trained).collect()
    assert {(r.site, r.species_source) for r in again} == {("colour", "calibrated"), ("laser", "trained"), ("bare", "trained")}
    assert np.mean([r.species == truth[r.site, r.tree_id][0] for r in again if (r.site, r.tree_id) in truth]) > 0.9


def test_conductor_height(spark):
    wires = spark.createDataFrame([("a", float(k), 0.5, 100 + 8 + k / 10) for k in range(50)] + [("b", 0.5, 0.5, 120.0)], "site string, x double, y double, z double")
    ground = spark.createDataFrame([(s, 0, x, 100.0) for s in "ab" for x in range(50)], "site string, iy int, ix int, dtm double")
    got = {r.site: r for r in crowns.conductor_height(wires, ground, 1.0).collect()}
    assert abs(got["a"].conductor_h - np.percentile(8 + np.arange(50) / 10, 20)) < 1e-9 and got["a"].n == 50 and got["b"].conductor_h == 20
