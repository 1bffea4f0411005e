"""Species and health of every crown of many scans in one plan: features from returns, the best model that a site has, the best health measure that its sensor allows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreal.operators.trees import health_by_intensity, health_by_ndvi, species_rule

SHAPE, COLOUR = ["crown_ratio", "low_frac", "rel_mean"], ["gr_ratio", "nir_share"]
#: Trees of known species that a site's own model needs, and trees of a species that a robust z needs.
CALIBRATION, LEAST_OF_SPECIES = 15, 20


def crown_features(points: DataFrame, trees: DataFrame, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """(by, tree_id, h, pts, pt_density, low_frac, rel_mean, crown_ratio, ndvi, gr_ratio, nir_share, intensity_top, multispectral, intensity): from the returns over a metre above ground that are not ground, building, wire or water; colours and intensity of the upper half. multispectral and intensity tell what the site's sensor has. Trees without such a return have counts of 0.

    points: by, tree_id, hag, cls, red, green, nir, intensity; trees: by, tree_id, h, crown_area."""
    key = [*by, "tree_id"]
    p = points.filter((F.col("hag") > 1) & ~F.col("cls").isin(2, 6, 9, 14)).join(trees.select(*key, "h"), key).withColumn("rel", F.col("hag") / F.greatest("h", F.lit(1.0)))
    top = F.col("rel") > 0.5
    upper = lambda c: F.sum(F.when(top, F.col(c)).otherwise(0)) / F.greatest(F.count_if(top), F.lit(1))
    f = p.groupBy(*key).agg(
        F.count(F.lit(1)).alias("pts"), F.avg(F.when(F.col("rel") < 0.6, 1.0).otherwise(0.0)).alias("low_frac"), F.avg("rel").alias("rel_mean"), upper("red").alias("r"), upper("green").alias("g"), upper("nir").alias("n"), upper("intensity").alias("intensity_top"),
        F.max("nir").alias("most_nir"), F.sum("intensity").alias("i1"), F.sum(F.col("intensity").cast("double") * F.col("intensity")).alias("i2"),
    )
    total = F.sum("pts")
    sensor = f.groupBy(*by).agg((F.coalesce(F.max("most_nir"), F.lit(0)) > 0).alias("multispectral"), (F.sum("i2") / total - (F.sum("i1") / total) * (F.sum("i1") / total) > 1e-9).alias("intensity"))
    f = trees.select(*key, "h", "crown_area").join(f, key, "left").join(sensor, list(by), "left")
    f = f.na.fill(0, ["pts", "low_frac", "rel_mean", "r", "g", "n", "intensity_top"]).na.fill(False, ["multispectral", "intensity"])
    radius = F.sqrt(F.col("crown_area") / math.pi)
    return f.select(
        *key, "h", "pts", (F.col("pts") / F.greatest("crown_area", F.lit(1.0))).alias("pt_density"), "low_frac", "rel_mean", (radius / F.greatest("h", F.lit(1.0))).alias("crown_ratio"),
        ((F.col("n") - F.col("r")) / F.greatest(F.col("n") + F.col("r"), F.lit(1.0))).alias("ndvi"), (F.col("g") / F.greatest("r", F.lit(1.0))).alias("gr_ratio"), (F.col("n") / 256.0).alias("nir_share"), "intensity_top", "multispectral", "intensity",
    )


def _long(f: DataFrame, *keep: str) -> DataFrame:
    """A row for each feature that a tree's sensor gives."""
    every = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v"), F.lit(c in COLOUR).alias("colour")) for c in SHAPE + COLOUR])
    return f.select(*keep, F.col("multispectral"), F.inline(every)).filter(F.col("multispectral") | ~F.col("colour")).drop("colour")


def site_models(features: DataFrame, known: DataFrame, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """(by, class, feature, mu, var, prior): a Gaussian model of each site with at least CALIBRATION trees (by, tree_id, species) of known species; classes of fewer than two trees are left out. Variances have 0.001 added."""
    f = features.join(known, [*by, "tree_id"])
    enough = f.groupBy(*by).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= CALIBRATION)
    rows = _long(f.join(enough, list(by)), *by, "species", "members")
    per = rows.groupBy(*by, F.col("species").alias("class"), "feature").agg(F.avg("v").alias("mu"), (F.var_pop("v") + 1e-3).alias("var"), F.count(F.lit(1)).alias("n"), F.first("members").alias("members"))
    return per.filter("n >= 2").select(*by, "class", "feature", "mu", "var", (F.col("n") / F.col("members")).alias("prior"))


def _by_model(features: DataFrame, models: DataFrame, by: tuple[str, ...], on: list[str], source: str) -> DataFrame:
    key = [*by, "tree_id"]
    d = F.col("v") - F.col("mu")
    rows = _long(features, *key).join(models, on)
    s = rows.groupBy(*key, "class").agg((F.sum(-0.5 * (d * d / F.col("var") + F.ln(2 * math.pi * F.col("var")))) + F.ln(F.first("prior"))).alias("s"))
    w = Window.partitionBy(*key)
    s = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    best = s.groupBy(*key).agg(F.max_by("class", F.struct("s", -F.col("class"))).alias("species"), (F.max("e") / F.sum("e")).alias("species_conf"))
    return best.withColumn("species_source", F.lit(source))


def classified(features: DataFrame, known: DataFrame | None = None, trained: DataFrame | None = None, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """features with species (0 pine, 1 spruce, 2 birch), species_conf, species_source, health (0 healthy, 1 stressed, 2 dead) and health_source.

    Species: by the site's own model where enough trees are known (site_models()); else by a trained one (multispectral, class, feature, mu, var, prior) for its kind of sensor; else by rules of crown shape. Health: by NDVI; else by intensity against the species' usual one, with return density; else by density alone."""
    key = [*by, "tree_id"]
    none = features.limit(0).select(*key, F.lit(0).alias("species"), F.lit(0.0).alias("species_conf"), F.lit("").alias("species_source"))
    own = _by_model(features, models := site_models(features, known, by), by, [*by, "feature"], "calibrated") if known is not None else none
    rest = features.join(models.select(*by).distinct(), list(by), "left_anti") if known is not None else features
    given = _by_model(rest, trained, by, ["multispectral", "feature"], "trained") if trained is not None else none
    rest = rest.join(given.select(*key), key, "left_anti") if trained is not None else rest
    ruled = rest.select(*key, species_rule(F.col("crown_ratio"), F.col("low_frac"), F.when(F.col("multispectral"), F.col("gr_ratio")).otherwise(0.0)).alias("species"), F.lit(1.0).alias("species_conf"), F.lit("rules").alias("species_source"))
    f = features.join(own.unionByName(given).unionByName(ruled), key)
    usual = f.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("pt_density") > 0, F.col("pt_density"))), F.lit(1.0)).alias("usual"))
    lit = F.when(F.col("intensity_top") > 0, F.col("intensity_top"))
    med = f.groupBy(*by, "species").agg(F.median(lit).alias("med"), F.count(lit).alias("members"))
    f = f.join(usual, list(by)).join(med, [*by, "species"])
    mad = f.groupBy(*by, "species").agg(F.median(F.abs(lit - F.col("med"))).alias("mad"))
    f = f.join(mad, [*by, "species"])
    z = F.when((F.col("members") >= LEAST_OF_SPECIES) & (F.col("intensity_top") > 0), (F.col("intensity_top") - F.col("med")) / (1.4826 * F.col("mad") + 1e-6)).otherwise(0.0)
    health = F.when(F.col("multispectral"), health_by_ndvi(F.col("ndvi"), F.col("species"))).when(F.col("intensity"), health_by_intensity(z, F.col("pt_density"), F.col("usual"))).when(F.col("pt_density") < 0.45 * F.col("usual"), 2).otherwise(0)
    source = F.when(F.col("multispectral"), "ndvi").when(F.col("intensity"), "intensity and density").otherwise("density")
    return f.select(*features.columns, "species", "species_conf", "species_source", health.alias("health"), source.alias("health_source"))


def conductor_height(wires: DataFrame, ground: DataFrame, res: float, by: tuple[str, ...] = ("site",)) -> DataFrame:
    """(by, conductor_h, n): the fifth part of the wire returns' heights above ground that is lowest ends here (their 20th percentile). wires: by, x, y, z; ground: by, iy, ix, dtm."""
    at = lambda c: F.floor(F.col(c) / res).cast("int")
    w = wires.withColumns({"iy": at("y"), "ix": at("x")}).join(ground.select(*by, "iy", "ix", "dtm"), [*by, "iy", "ix"])
    return w.groupBy(*by).agg(F.percentile(F.col("z") - F.col("dtm"), 0.2).alias("conductor_h"), F.count(F.lit(1)).alias("n"))
