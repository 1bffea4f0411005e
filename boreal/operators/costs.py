"""Unit costs and euro damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.functions.forest import size_factor, stem_volume

# Default unit costs, fixed values: key, value, unit, basis.
DEFAULTS = (
    ("outage_compensation_per_customer", 100.0, "EUR / customer", "derived"),
    ("customers_per_line", 250.0, "customers", "assumption"),
    ("line_fault_repair", 2100.0, "EUR / fault", "derived"),
    ("road_tree_clearing", 300.0, "EUR / tree", "assumption"),
    ("building_tree_damage", 8000.0, "EUR / hit", "assumption"),
    ("timber_value_per_m3", 40.0, "EUR / m3", "derived"),
    ("storm_timber_loss_share", 0.3, "share", "assumption"),
    ("fire_timber_loss_torching", 1.0, "share", "assumption"),
    ("fire_timber_loss_surface", 0.3, "share", "assumption"),
    ("reforestation_per_ha", 1200.0, "EUR / ha", "assumption"),
    ("house_value", 200000.0, "EUR", "assumption"),
    ("cabin_value", 80000.0, "EUR", "assumption"),
    ("fire_building_loss_share", 0.25, "share", "assumption"),
    ("fire_line_repair", 50000.0, "EUR / line reached", "assumption"),
    ("felling_cost_per_tree", 80.0, "EUR / tree", "assumption"),
)
#: Building kinds that are not houses.
SMALL = ("cabin", "sauna", "shed", "barn")


def defaults(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"), F.lit(u).alias("unit"), F.lit(b).alias("basis")) for k, v, u, b in DEFAULTS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def merged(base: DataFrame, user: DataFrame) -> DataFrame:
    """Defaults with the user's values for known keys."""
    u = user.select("key", F.col("value").cast("double").alias("new"))
    return base.join(u, "key", "left").select("key", F.coalesce("new", "value").alias("value"), "unit", F.when(F.col("new").isNotNull(), "user").otherwise(F.col("basis")).alias("basis"))


def one_row(costs: DataFrame) -> DataFrame:
    """A column per key."""
    return costs.groupBy().pivot("key", [k for k, *_ in DEFAULTS]).agg(F.first("value"))


def storm_costs(per_run: DataFrame, costs: DataFrame) -> DataFrame:
    """Five components and the total of each run (line_hit, n_line, n_road, n_bld, volume)."""
    c = per_run.crossJoin(F.broadcast(one_row(costs)))  # one row
    return c.select(
        "run",
        (F.col("line_hit").cast("double") * F.col("customers_per_line") * F.col("outage_compensation_per_customer")).alias("outage"),
        (F.col("n_line") * F.col("line_fault_repair")).alias("line_repair"),
        (F.col("n_road") * F.col("road_tree_clearing")).alias("road_clearing"),
        (F.col("n_bld") * F.col("building_tree_damage")).alias("building_repair"),
        (F.col("volume") * F.col("timber_value_per_m3") * F.col("storm_timber_loss_share")).alias("timber"),
    ).withColumn("total", F.col("outage") + F.col("line_repair") + F.col("road_clearing") + F.col("building_repair") + F.col("timber"))


def tree_damage(trees: DataFrame, costs: DataFrame) -> DataFrame:
    """Expected euros that felling each tree (h, dbh, p_fail, w_power, w_bld, w_road) avoids."""
    t = trees.crossJoin(F.broadcast(one_row(costs)))  # one row
    line = F.col("line_fault_repair") + F.col("customers_per_line") * F.col("outage_compensation_per_customer")
    timber = stem_volume(F.col("h"), F.col("dbh")) * F.col("timber_value_per_m3") * F.col("storm_timber_loss_share")
    damage = F.col("p_fail") * (F.col("w_power") * line + F.col("w_bld") * F.col("building_tree_damage") + F.col("w_road") * size_factor(F.col("h")) * F.col("road_tree_clearing") + timber)
    return t.select(*trees.columns, damage.alias("damage"))


def fire_costs(reached: DataFrame, impacts: DataFrame, buildings: DataFrame, burned_ha: float, costs: DataFrame) -> DataFrame:
    """One row of five components from trees reached (h, dbh, p_torch) and impacts (asset, kind, minutes)."""
    c = one_row(costs)
    vol = stem_volume(F.col("h"), F.col("dbh"))
    timber = reached.agg(F.coalesce(F.sum(vol * F.col("p_torch")), F.lit(0.0)).alias("torched"), F.coalesce(F.sum(vol * (1 - F.col("p_torch"))), F.lit(0.0)).alias("scorched"))
    kinds = buildings.groupBy(F.col("name").alias("asset")).agg(F.max_by("kind", "building_id").alias("known"))
    hit = impacts.filter("minutes IS NOT NULL").join(kinds, "asset", "left").withColumn("k", F.coalesce("known", "kind"))
    bld = ~F.col("kind").isin("power_line", "road_cut")
    n = hit.agg(F.count_if(F.col("kind") == "power_line").alias("lines"), F.count_if(bld & ~F.col("k").isin(*SMALL)).alias("houses"), F.count_if(bld & F.col("k").isin(*SMALL)).alias("cabins"))
    r = timber.crossJoin(n).crossJoin(c)  # one row each
    return r.select(
        ((F.col("torched") * F.col("fire_timber_loss_torching") + F.col("scorched") * F.col("fire_timber_loss_surface")) * F.col("timber_value_per_m3")).alias("timber"),
        (F.lit(float(burned_ha)) * F.col("reforestation_per_ha")).alias("reforestation"),
        ((F.col("houses") * F.col("house_value") + F.col("cabins") * F.col("cabin_value")) * F.col("fire_building_loss_share")).alias("buildings"),
        (F.col("lines") * F.col("fire_line_repair")).alias("line_repair"),
        F.when(F.col("lines") > 0, F.col("customers_per_line") * F.col("outage_compensation_per_customer")).otherwise(0.0).alias("outage"),
    )
