"""Tree features, species by Gaussian naive Bayes, health rules, validation measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree_features(points: DataFrame) -> DataFrame:
    """Per tree, from its returns (tree_id, hag, h, cls, red, nir, intensity): counts, shares of the crown, colour of its upper half."""
    p = points.filter((F.col("tree_id").isNotNull()) & (F.col("hag") > 1) & ~F.col("cls").isin(2, 6, 9, 14)).withColumn("rel", F.col("hag") / F.col("h"))
    top = F.col("rel") > 0.5
    mean_top = lambda c: F.sum(F.when(top, F.col(c)).otherwise(0)) / F.greatest(F.count_if(top), F.lit(1))
    f = p.groupBy("tree_id").agg(F.count(F.lit(1)).alias("pts"), F.avg(F.when(F.col("rel") < 0.6, 1.0).otherwise(0.0)).alias("low_frac"), F.avg("rel").alias("rel_mean"), mean_top("red").alias("red_top"), mean_top("nir").alias("nir_top"), mean_top("intensity").alias("intensity_top"))
    return f.withColumn("ndvi", (F.col("nir_top") - F.col("red_top")) / F.greatest(F.col("nir_top") + F.col("red_top"), F.lit(1.0)))


def nb_fit(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(class, feature, mu, var, prior) of classes with two rows at least; population variance plus 0.001."""
    long = rows.select(F.col(label).alias("class"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])))
    per = long.groupBy("class", "feature").agg(F.avg("v").alias("mu"), (F.var_pop("v") + 1e-3).alias("var"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return per.select("class", "feature", "mu", "var", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("prior"))


def nb_predict(rows: DataFrame, key: str, params: DataFrame, features: list[str]) -> DataFrame:
    """(key, class, confidence) of the likeliest class; of equals the least. params have classes times features rows, which are broadcast."""
    long = rows.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])))
    d = F.col("v") - F.col("mu")
    term = -0.5 * (d * d / F.col("var") + F.ln(2 * math.pi * F.col("var")))
    score = long.join(F.broadcast(params), "feature").groupBy(key, "class").agg((F.sum(term) + F.ln(F.first("prior"))).alias("s"))
    w = Window.partitionBy(key)
    soft = score.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    soft = soft.withColumns({"confidence": F.col("e") / F.sum("e").over(w), "r": F.row_number().over(w.orderBy(F.desc("s"), "class"))})
    return soft.filter("r = 1").select(key, "class", "confidence")


def species_rule(crown_ratio, low_frac, gr_ratio):
    """0 pine, 1 spruce, 2 birch where no model is at hand."""
    return F.when((crown_ratio < 0.11) & (low_frac > 0.35), 1).when(gr_ratio > 1.45, 2).otherwise(0)


def health_by_ndvi(ndvi, species):
    dead, stressed = F.when(species == 2, 0.20).otherwise(0.15), F.when(species == 2, 0.45).otherwise(0.40)
    return F.when(ndvi < dead, 2).when(ndvi < stressed, 1).otherwise(0)


def robust_z(rows: DataFrame, group: str, value: str, least: int = 20) -> DataFrame:
    """(x - median) / (1.4826 MAD) within groups of `least` rows at least; null in smaller ones. Medians are computed per group and joined back."""
    med = rows.groupBy(group).agg(F.median(value).alias("med"), F.count(F.lit(1)).alias("members"))
    dev = rows.join(F.broadcast(med), group)  # a row per group of a code set
    mad = dev.groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    z = (F.col(value) - F.col("med")) / F.greatest(1.4826 * F.col("mad"), F.lit(1e-6))
    return dev.join(F.broadcast(mad), group).withColumn("z", F.when(F.col("members") >= least, z)).drop("med", "members", "mad")


def health_by_intensity(z, density, median_density):
    """From the robust z of returned intensity and the point density."""
    sparse = density < 0.45 * median_density
    return F.when((z < -3.2) | (sparse & (z < -2)), 2).when(z < -2, 1).otherwise(0)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Recall and precision of each class."""
    t = rows.groupBy(F.col(truth).alias("class")).agg(F.count(F.lit(1)).alias("n_true"), F.count_if(F.col(truth) == F.col(predicted)).alias("hit"))
    p = rows.groupBy(F.col(predicted).alias("class")).agg(F.count(F.lit(1)).alias("n_pred"))
    return t.join(p, "class", "full").select("class", F.try_divide("hit", "n_true").alias("recall"), F.coalesce(F.try_divide("hit", "n_pred"), F.lit(0.0)).alias("precision"))


def detection_scores(matches: DataFrame, n_truth: int, n_found: int) -> DataFrame:
    """Recall, precision, F1, height bias and RMSE from one-to-one matches (h_found, h_true)."""
    d = F.col("h_found") - F.col("h_true")
    m = matches.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"))
    m = m.withColumns({"recall": F.col("n") / n_truth, "precision": F.col("n") / n_found})
    return m.withColumn("f1", F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def wire_axis(points: DataFrame) -> DataFrame:
    """Centre and direction of the principal axis of class-14 points (200 at least), in closed form from the covariances."""
    m = points.filter("cls = 14").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    return m.filter("n >= 200").withColumn("angle", 0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")))


def wire_vertices(points: DataFrame, step: float = 40.0) -> DataFrame:
    """Mean place of the wire points in each bin along their axis; bins of over five points."""
    p = points.filter("cls = 14").crossJoin(F.broadcast(wire_axis(points)))  # one row
    t = (F.col("x") - F.col("cx")) * F.cos("angle") + (F.col("y") - F.col("cy")) * F.sin("angle")
    return p.withColumn("bin", F.floor(t / step)).groupBy("bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).filter("n > 5")
