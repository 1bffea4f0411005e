import numpy as np
from pyspark.sql import functions as F

from boreal.__main__ import analyze
from boreal.operators import graph, grid, kernels, montecarlo, sequence, site, trees
from boreal.sources import scan3d, synth


def test_estate_end_to_end(spark, tmp_path):
    """A survey of a synthetic estate: most trees are found where they stand, at their height."""
    made = scan3d.write_las(synth.returns(spark, 60.0).withColumnRenamed("cls", "classification").coalesce(1), f"file://{tmp_path}/scans").collect()
    assert sum(r.points for r in made) > 10_000
    analyze(spark, str(tmp_path / "scans"), str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out/trees"))
    truth = synth.truth(spark, 60.0)
    m = kernels.match_trees(found.select(F.monotonically_increasing_id().alias("found_id"), "x", "y", "h"), truth)
    s = trees.detection_scores(m, truth.count(), found.count()).first()
    assert s.recall > 0.65 and s.precision > 0.85 and s.rmse < 1.5
    assert spark.read.json(str(tmp_path / "out/summary")).first().trees == found.count()
    assert spark.read.option("header", True).csv(str(tmp_path / "out/workorder")).count() == min(200, found.count())


def test_fire_runs_downwind_and_routes(spark):
    c = grid.full_grid(spark, 15, 15).withColumns({"ros": F.lit(5.0), "z": F.lit(0.0)})
    a = {(r.iy, r.ix): r.arrival for r in site.fire_arrival(c, 15, 10.0, 25.0, 270.0, [(7, 7)]).collect()}
    assert a[7, 10] < a[7, 4] and abs(a[10, 7] - a[4, 7]) < 1e-6
    barrier = site.fire_barrier(spark.createDataFrame([(7, 7, 5.0)], "iy int, ix int, arrival double"), 15.0, c)
    assert barrier.count() == 25
    v = c.select("iy", "ix", F.when(F.col("ix") == 7, 0.0).otherwise(30.0).alias("v"), F.lit(False).alias("blocked"))
    pts = spark.createDataFrame([(1, 75.0, 75.0)], "point_id int, x double, y double")
    s = site.snap(pts, v, 10.0, 30.0).first()
    assert (s.iy, s.ix) == (7, 6)
    e = graph.grid_edges(v.withColumn("blocked", F.col("ix") == 9), 15, 10.0, None)
    seeds = spark.range(1).select(F.lit("s").alias("site"), F.lit(8).cast("long").alias("node"), F.lit(0.0).alias("dist"))
    p = graph.shortest_paths(e.withColumn("site", F.lit("s")), seeds, "site")
    assert {r.node % 15 for r in p.collect()} == {8}
    assert [r.node for r in graph.path_to(p, "site", 14 * 15 + 8).orderBy("seq").collect()] == [8 + 15 * k for k in range(15)]


def test_masks_exposure_and_draws(spark):
    w = grid.full_grid(spark, 40, 40).withColumns({"water_share": F.when(F.col("ix") < 21, 0.5).otherwise(0.0), "full": F.lit(1.0), "chm": F.when(F.col("ix") < 23, 0.0).otherwise(15.0)})
    w = site.water_mask(w, 1).filter("iy = 20 AND ix > 7").collect()  # closing clears the grid's edge
    assert len(w) == 32 and all(r.water == (r.ix < 22) for r in w)
    c = grid.full_grid(spark, 30, 30).select("iy", "ix", F.when(F.col("ix") < 14, 0.0).otherwise(15.0).alias("chm"))
    t = spark.createDataFrame([(1, 16.0, 15.0, 20.0), (2, 28.0, 15.0, 15.0)], "tree_id int, x double, y double, h double")
    x = {r.tree_id: r for r in site.exposure_features(t, c.select("iy", "ix", "chm"), 1.0, 270.0).collect()}
    assert x[1].edge > x[2].edge and x[1].emergent > 0.2
    f = {(r.iy, r.ix): r.chm for r in site.fill_crowns(spark.createDataFrame([(y, k, None if (y, k) == (1, 1) else 5.0) for y in range(3) for k in range(3)], "iy int, ix int, chm double")).collect()}
    assert f[1, 1] == 5.0
    d = spark.range(400).select(F.col("id").alias("t")).crossJoin(spark.range(50).select(F.col("id").alias("r"))).select(montecarlo.uniform(F.col("t"), F.col("r"), F.lit(1)).alias("u"))
    a, b = d.agg(F.avg("u"), F.var_pop("u")).first()
    assert abs(a - 0.5) < 0.01 and abs(b - 1 / 12) < 0.003
    line = spark.createDataFrame([("a", k, float(k), 0.0 if k % 2 else 0.01) for k in range(20)], "l string, seq int, x double, y double")
    assert sequence.simplified(line, "l", "seq", 0.5).count() == 2
    assert sequence.chaikin(line, "l", "seq").count() == 40
    assert sum(r.vertices for r in sequence.pieces(line, "l", "seq", 5.0).collect()) >= 20
    assert [r.median for r in sequence.expanding_median(line.limit(3), "l", "seq", "x").orderBy("seq").collect()] == [0.0, 0.5, 1.0]
    cells = spark.createDataFrame([(y, k) for y in range(4) for k in range(4)], "iy int, ix int")
    h = grid.halo(cells, 2, 1)
    assert h.filter("core").count() == 16 and h.filter("tile_y = 0 AND tile_x = 0").count() == 9
    assert grid.upsample(cells.withColumn("v", F.lit(1)), 2).count() == 64
    assert np.isfinite(montecarlo.representative_run(spark.createDataFrame([(0, 5), (1, 9), (2, 7)], "run int, fallen int")).first().fallen)
