"""Fuel, fire behaviour, spread and tree hazard over cell and tree tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreal.functions.forest import by_species, crown_base, torching
from boreal.functions.geo import clip

# Rate of spread constants of the FBP fuel types, fixed values: a, b, c, q, bui0, fuel load kg/m2.
FUELS = {
    "C2": (110.0, 0.0282, 1.5, 0.70, 64.0, 3.6),
    "C3": (110.0, 0.0444, 3.0, 0.75, 62.0, 2.6),
    "C4": (110.0, 0.0293, 1.5, 0.80, 66.0, 3.0),
    "D1": (30.0, 0.0232, 1.6, 0.90, 32.0, 1.0),
    "O1": (190.0, 0.0310, 1.4, 1.00, 1.0, 0.35),
}


def fuel_type(c: dict[str, Column] | None = None) -> Column:
    """Fuel type of a cell with cover, conifer, mean_h, spruce, pine, water, building, road_main: the last rule that would apply is tested first."""
    col = lambda k: (c or {}).get(k, F.col(k))
    forest = F.when(col("conifer") < 0.30, "D1").when(col("conifer") < 0.65, "M1").when(col("mean_h") < 10, "C4").when(col("spruce") >= col("pine"), "C2").otherwise("C3")
    return F.when(col("water") | col("building") | col("road_main"), "NF").when(col("cover") >= 0.25, forest).otherwise("O1")


def _constants(fuel: Column, i: int) -> Column:
    out = F.lit(0.0)
    for k, v in FUELS.items():
        out = F.when(fuel == k, v[i]).otherwise(out)
    return out


def _spread(name: str, isi: Column, bui: Column) -> Column:
    a, b, c, q, bui0, _ = FUELS[name]
    effect = F.when(bui <= 0, 1.0).otherwise(F.exp(50 * math.log(q) * (1 / F.greatest(bui, F.lit(1e-6)) - 1 / bui0))) if q < 1 else F.lit(1.0)
    return a * F.pow(1 - F.exp(-b * isi), F.lit(c)) * effect


def head_ros(fuel: Column, isi: Column, bui: Column, conifer: Column, dead: Column, bog: Column, forest_road: Column) -> Column:
    """Head fire rate of spread, m/min: grass at 70 %, mixed wood between conifer and a fifth of broadleaf, more with dead trees, half on bogs, less on forest roads."""
    conifer, dead = clip(conifer, 0, 1), clip(dead, 0, 1)
    mixed = conifer * _spread("C2", isi, bui) + (1 - conifer) * 0.2 * _spread("D1", isi, bui)
    ros = F.when(fuel == "NF", 0.0).when(fuel == "M1", mixed).when(fuel == "O1", 0.70 * _spread("O1", isi, bui))
    for k in ("C2", "C3", "C4", "D1"):
        ros = ros.when(fuel == k, _spread(k, isi, bui))
    return ros * (1 + 0.5 * dead) * F.when(bog, 0.5).otherwise(1.0) * F.when(forest_road, 0.3).otherwise(1.0)


def fuel_load(fuel: Column, conifer: Column, dead: Column) -> Column:
    conifer, dead = clip(conifer, 0, 1), clip(dead, 0, 1)
    mixed = conifer * FUELS["C2"][5] + (1 - conifer) * FUELS["D1"][5]
    return F.when(fuel == "M1", mixed).otherwise(_constants(fuel, 5)) * (1 + 0.3 * dead)


def head_intensity(load: Column, ros: Column) -> Column:
    """kW/m."""
    return 300 * load * ros


def length_to_breadth(wind: Column) -> Column:
    return 1 + 8.729 * F.pow(1 - F.exp(-0.030 * wind), F.lit(2.155))


def eccentricity(lb: Column) -> Column:
    return F.sqrt(F.greatest(1 - 1 / (lb * lb), F.lit(0.0)))


def direction_factor(ecc: Column, angle: Column) -> Column:
    return (1 - ecc) / (1 - ecc * F.cos(angle))


def slope_factor(rise: Column) -> Column:
    """Of a tangent: faster uphill (tangent cut at 1), slower down."""
    return F.when(rise > 0, F.exp(3.533 * F.pow(clip(rise, 0, 1), F.lit(1.2)))).otherwise(F.exp(-0.5 * F.abs(rise)))


#: Sixteen neighbours: eight adjacent cells and eight knight's moves.
NEIGHBOURS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]


def spread_edges(cells: DataFrame, nx: int, res: float, wind: float, wind_from: float) -> DataFrame:
    """Directed edges (src, dst, minutes) between cells (iy, ix, ros, z): both must burn; wind stretches, slope hastens."""
    ecc = eccentricity(length_to_breadth(F.lit(float(wind))))
    head = math.radians(90 - (wind_from + 180) % 360)
    arms = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(math.hypot(dy, dx) * res).alias("len"), F.lit(math.atan2(dy, dx) - head).alias("angle")) for dy, dx in NEIGHBOURS])
    a = cells.filter("ros > 1e-3").select(F.col("iy").alias("ay"), F.col("ix").alias("ax"), F.col("ros").alias("ra"), F.col("z").alias("za"), F.explode(arms).alias("o"))
    a = a.select("*", (F.col("ay") + F.col("o.dy")).alias("iy"), (F.col("ax") + F.col("o.dx")).alias("ix"))
    e = a.join(cells.filter("ros > 1e-3").select("iy", "ix", "ros", "z"), ["iy", "ix"])
    factor = direction_factor(ecc, F.col("o.angle")) * slope_factor((F.col("z") - F.col("za")) / F.col("o.len"))
    minutes = 0.5 * F.col("o.len") * (1 / F.col("ra") + 1 / F.col("ros")) / factor
    return e.select((F.col("ay") * nx + F.col("ax")).cast("long").alias("src"), (F.col("iy") * nx + F.col("ix")).cast("long").alias("dst"), minutes.alias("w"))


# By species and by health, fixed values: how well a tree burns and how dry it stands.
FLAMMABLE, STANDING_DRY = (0.7, 1.0, 0.25), (0.15, 0.55, 1.0)


def tree_hazard(trees: DataFrame, dry: float | Column) -> DataFrame:
    """cbh, p_torch and the 0..100 score of trees (h, species, health, hfi, grass) on a day of the given dryness."""
    dry = dry if isinstance(dry, Column) else F.lit(float(dry))
    t = trees.withColumn("cbh", crown_base(F.col("h"), F.col("species"), F.col("health")))
    t = t.withColumn("p_torch", torching(F.col("cbh"), F.col("health"), F.col("hfi"), F.col("grass")))
    standing = by_species(F.col("health"), STANDING_DRY)
    ladder = clip(1 - F.col("cbh") / 6, 0, 1)
    score = 0.30 * standing + 0.20 * by_species(F.col("species"), FLAMMABLE) + 0.15 * ladder + 0.15 * F.col("grass") + 0.20 * dry * (0.5 + 0.5 * standing)
    return t.withColumn("fire_hazard", 100 * clip(score, 0, 1))


def isochrone(arrival: Column, minutes: int = 30) -> Column:
    return (F.floor(arrival / minutes) * minutes).cast("int")


def dry_fuel(grass: Column, dead: Column, dry: Column, burns: Column) -> Column:
    return F.when(burns, (0.6 * grass + 1.2 * dead) * (0.35 + 0.65 * dry)).otherwise(0.0)
