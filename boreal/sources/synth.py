"""A synthetic estate as DataFrames, from keyed draws: ground truth trees and the laser returns that a survey would see."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.operators.montecarlo import uniform


def u(stream: int, key: str = "id"):
    return uniform(F.col(key) + 1, F.lit(stream), F.lit(stream))


def ground(x, y):
    return 100 + 4 * F.sin(x / 60) + 3 * F.cos(y / 45)


def truth(spark: SparkSession, size: float, spacing: float = 5.0) -> DataFrame:
    """tree_id, x, y, h, species, health, crown_r on a jittered grid."""
    n = int(size // spacing)
    t = spark.range(n * n).withColumns({"x": (F.col("id") % n + 0.3 + 0.4 * u(1)) * spacing, "y": (F.floor(F.col("id") / n) + 0.3 + 0.4 * u(2)) * spacing})
    return t.select(F.col("id").alias("tree_id"), "x", "y", (8 + 14 * u(3)).alias("h"), F.when(u(4) < 0.45, 0).when(u(4) < 0.8, 1).otherwise(2).alias("species"), F.when(u(5) < 0.05, 2).when(u(5) < 0.15, 1).otherwise(0).alias("health"), (1.2 + 1.2 * u(6)).alias("crown_r"))


def returns(spark: SparkSession, size: float, per_m2: float = 6.0, spacing: float = 5.0) -> DataFrame:
    """x, y, z, cls, intensity, red, nir: ground returns, and crown returns on a cone about each tree."""
    n = int(size * size * per_m2 / 2)
    g = spark.range(n).withColumns({"x": size * u(11), "y": size * u(12)})
    g = g.select("x", "y", (ground(F.col("x"), F.col("y")) + 0.05 * u(13)).alias("z"), F.lit(2).alias("cls"), F.lit(300).alias("intensity"), F.lit(90).alias("red"), F.lit(110).alias("nir"))
    k = max(8, int(per_m2 / 2 * spacing * spacing))
    t = truth(spark, size, spacing).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("id", F.col("tree_id") * k + F.col("k"))
    r, a = F.col("crown_r") * F.sqrt(u(14)), 2 * math.pi * u(15)
    t = t.withColumns({"r": r, "px": F.col("x") + r * F.cos(a), "py": F.col("y") + r * F.sin(a)})
    top = F.col("h") * (1 - 0.5 * (F.col("r") / F.col("crown_r")))
    t = t.select(F.col("px").alias("x"), F.col("py").alias("y"), (ground(F.col("px"), F.col("py")) + top).alias("z"), F.lit(5).alias("cls"), (200 + 300 * u(16)).cast("int").alias("intensity"), F.when(F.col("health") == 2, 120).otherwise(40).alias("red"), F.when(F.col("health") == 2, 130).when(F.col("health") == 1, 90).otherwise(160).alias("nir"))
    return g.union(t).filter(F.col("x").between(0, size - 1e-6) & F.col("y").between(0, size - 1e-6))
