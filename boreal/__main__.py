"""python -m boreal analyze --scans PATH --out FOLDER [--scenario storm] | synth --size M --out FOLDER"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def analyze(spark: SparkSession, scans: str, out: str, scenario: str = "storm", res: float = 0.5) -> None:
    """Canopy cells, trees, work order and key figures of a scan, as Parquet, CSV and JSON."""
    from boreal.functions import forest as fo
    from boreal.operators import sequence, site
    from boreal.operators.kernels import detect_trees
    from boreal.operators.weather import SCENARIOS
    from boreal.sources import sinks

    site.from_scans(spark, scans, res).write.mode("overwrite").parquet(f"{out}/canopy")
    canopy = spark.read.parquet(f"{out}/canopy")
    t = detect_trees(canopy.select("iy", "ix", "chm"), res).withColumn("tree_id", F.xxhash64("x", "y"))
    t = t.withColumns({"species": F.lit(0), "health": F.lit(0), "peat": F.lit(0.0), "w_power": F.lit(0.0), "w_bld": F.lit(0.0), "w_road": F.lit(0.0)})
    t = t.withColumn("dbh", fo.dbh_cm(F.col("h"), F.col("species"))).withColumn("hd", fo.slenderness(F.col("h"), F.col("dbh")))
    _, _, _, _, gust, wet = SCENARIOS[scenario]
    t = site.exposure_features(t, canopy.select("iy", "ix", "chm"), res, 230.0)
    args = [*map(F.col, ("h", "hd", "species", "edge", "emergent", "peat", "health"))]
    t.withColumn("p_fail", fo.failure_probability(F.lit(gust), *args, wet, False)).write.mode("overwrite").parquet(f"{out}/trees")
    t = spark.read.parquet(f"{out}/trees")
    sinks.work_order(sequence.top_k(t, [F.desc("p_fail"), F.col("tree_id")], 200).select("rank", "tree_id", "x", "y", "h", "p_fail"), f"{out}/workorder")
    site.summary(t).write.mode("overwrite").json(f"{out}/summary")


def main() -> None:
    p = argparse.ArgumentParser(prog="boreal")
    s = p.add_subparsers(dest="what", required=True)
    a = s.add_parser("analyze")
    a.add_argument("--scans", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--scenario", default="storm")
    y = s.add_parser("synth")
    y.add_argument("--size", type=float, default=100.0)
    y.add_argument("--out", required=True)
    o = p.parse_args()
    spark = SparkSession.builder.appName("boreal").getOrCreate()
    if o.what == "analyze":
        analyze(spark, o.scans, o.out, o.scenario)
    else:
        from boreal.sources import scan3d, synth

        scan3d.write_las(synth.returns(spark, o.size).withColumnRenamed("cls", "classification").coalesce(1), f"{o.out}/scans").collect()
        synth.truth(spark, o.size).write.mode("overwrite").parquet(f"{o.out}/truth")


if __name__ == "__main__":
    main()
