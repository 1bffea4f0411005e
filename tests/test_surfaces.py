"""Scans of unlike density and classes in one call, against the same scans one at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreal.operators import surfaces


def scan(site, per_m2, told, seed, size=24):
    """A slope with crowns of 14 m on half of it; ground is classed, or not."""
    rng, rows = np.random.default_rng(seed), []
    for x, y in rng.uniform(0, size, (int(size * size * per_m2), 2)):
        ground = 100 + 0.05 * x
        tall = math.sin(x / 2) * math.sin(y / 2) > 0.3
        hit = not tall or rng.random() < 0.35
        rows.append((site, float(x), float(y), float(ground + (0 if hit else 14)), (2 if hit else 5) if told else 1))
    return rows


@pytest.fixture(scope="module")
def scans(spark):
    rows = scan("dense", 8, True, 1) + scan("sparse", 1.2, True, 2) + scan("raw", 8, False, 3)
    return spark.createDataFrame(rows, "site string, x double, y double, z double, cls int").repartition(3)


def test_each_site_has_its_own_way(spark, scans):
    """Three sites in one plan: one sparse, one without classes. Every cell of every grid has terrain, and equals what the site gives alone."""
    together = surfaces.site_surfaces(scans, 0.5).toPandas().set_index(["site", "iy", "ix"]).sort_index()
    assert together[["dtm", "chm"]].notna().all().all() and together.groupby("site").size().to_dict() == {s: 48 * 48 for s in ("dense", "sparse", "raw")}
    assert together.groupby("site")["sparse"].first().to_dict() == {"dense": False, "sparse": True, "raw": False}
    slope = 100 + 0.05 * (together.index.get_level_values("ix") + 0.5) * 0.5
    assert (np.abs(together["dtm"] - slope) < 0.3).mean() > 0.97
    for site in ("sparse", "raw"):
        alone = surfaces.site_surfaces(scans.filter(F.col("site") == site), 0.5).toPandas().set_index(["site", "iy", "ix"]).sort_index()
        assert np.allclose(alone[["dtm", "chm"]], together.loc[[site]][["dtm", "chm"]])
    tall = together["chm"] > 10
    assert all(0.15 < tall[s].mean() < 0.7 for s in ("dense", "sparse", "raw")) and (together["n"] == 0)["sparse"].mean() > 0.5


def test_ground_by_class_or_by_surface(spark, scans):
    g = surfaces.with_ground(scans).withColumn("true", F.col("z") < 101.5)
    right = {r.site: r.right for r in g.groupBy("site").agg(F.avg((F.col("ground") == F.col("true")).cast("int")).alias("right")).collect()}
    assert right["dense"] == 1 and right["sparse"] == 1 and right["raw"] > 0.85
