"""Decisions: danger along a route, which vehicle to send, structures at risk, places to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreal.functions.forest import route_level, structure_level
from boreal.functions.geo import clip
from boreal.operators import text
from boreal.operators.spatial import near_pairs

# Vehicles that suit a mission, and the one built for it, fixed values.
MISSIONS = {"any": None, "fire": ("fire_engine", "pickup_4x4", "atv", "forwarder", "foot"), "medical": ("ambulance", "pickup_4x4", "atv", "foot"), "power": ("pickup_4x4", "forwarder", "atv", "foot")}
PRIMARY = {"fire": "fire_engine", "medical": "ambulance", "power": "pickup_4x4"}


def route_danger(stuck: Column, p_block: Column, across: Column, risk_p90: Column, torching: Column, fire_margin: Column, off_share: Column) -> Column:
    """0..100."""
    front = F.when(fire_margin < 5, 1.0).when(fire_margin < 15, 0.5).otherwise(0.0)
    danger = 0.35 * stuck + 0.15 * clip(p_block, 0, 1) + 0.15 * F.least(across / 2, F.lit(1.0)) + 0.15 * clip((risk_p90 - 20) / 60, 0, 1) + 0.1 * F.least(torching / 30, F.lit(1.0)) + 0.25 * front + 0.05 * F.least(off_share, F.lit(1.0))
    return 100 * F.least(danger, F.lit(1.0))


def route_risk(path: DataFrame, trees: DataFrame, pieces: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Danger of each vehicle's route. path: vehicle, seq, x, y, minute, piece_id (null off road), risk, arrival (of a simulated fire, or null); trees: tree_id, x, y, h, p_fail, p_torch; pieces: piece_id, p; vehicles: vehicle, clear_min."""
    w = Window.partitionBy("vehicle").orderBy("seq")
    steps = path.withColumn("len", F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")))
    base = steps.groupBy("vehicle").agg(
        F.sum("len").alias("length"), F.coalesce(F.sum(F.when(F.col("piece_id").isNull(), F.col("len"))), F.lit(0.0)).alias("off_m"), F.percentile("risk", 0.9).alias("risk_p90"), F.min(F.col("arrival") - F.col("minute")).alias("fire_margin")
    )
    driven = path.filter("piece_id IS NOT NULL").select("vehicle", "piece_id").distinct().join(pieces, "piece_id")
    blocked = driven.join(vehicles.select("vehicle", "clear_min"), "vehicle").groupBy("vehicle").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.999999)))))).alias("p_block"), F.coalesce(F.sum(F.col("p") * F.col("clear_min")), F.lit(0.0)).alias("clearing"))
    near = near_pairs(trees, path.select("vehicle", "x", "y"), 40.0).groupBy("tree_id", "r_vehicle").agg(F.min("d").alias("d"), F.first("h").alias("h"), F.first("p_fail").alias("p_fail"), F.first("p_torch").alias("p_torch"))
    beside = near.groupBy(F.col("r_vehicle").alias("vehicle")).agg(
        F.sum(F.when(F.col("d") < F.col("h"), F.col("p_fail") * 0.25).otherwise(0.0)).alias("across"), F.count_if((F.col("d") < F.col("h")) & (F.col("p_fail") >= 0.1)).alias("storm_trees"), F.count_if((F.col("d") < 15) & (F.col("p_torch") >= 0.5)).alias("torching")
    )
    r = base.join(blocked, "vehicle", "left").join(beside, "vehicle", "left").join(vehicles.select("vehicle", "clear_min"), "vehicle").na.fill(0, ["p_block", "clearing", "across", "storm_trees", "torching"])
    r = r.withColumn("stuck", F.when(F.col("clear_min").isNull(), F.col("p_block")).otherwise(0.0))
    r = r.withColumn("danger", route_danger(*map(F.col, ("stuck", "p_block", "across", "risk_p90", "torching", "fire_margin")), F.col("off_m") / F.greatest(F.col("length"), F.lit(1.0))))
    warn = text.reasons((F.col("p_block") > 0.05, "a fallen tree may block it"), (F.col("storm_trees") > 0, "storm-prone trees can fall onto it"), (F.col("torching") > 0, "trees beside it would torch"), (F.coalesce(F.col("fire_margin") < 15, F.lit(False)), "fire front near the route"))
    return r.withColumns({"level": route_level(F.col("danger")), "warnings": warn})


def plan_emergency(options: DataFrame, mission: str = "any") -> DataFrame:
    """Options (vehicle, ok, minutes, clearing, danger, stuck) ranked: expected minutes, score, whether each suits, and which is best, fastest, safest. The vehicle built for the mission is preferred while it gets through safely in about twice the best one's time."""
    suits = F.lit(True) if MISSIONS[mission] is None else F.col("vehicle").isin(*MISSIONS[mission])
    o = options.withColumns({"suits": suits, "expected_minutes": F.col("minutes") + F.col("clearing"), "p_arrive": 1 - F.col("stuck")})
    o = o.withColumn("score", F.col("expected_minutes") * (1 + F.col("danger") / 40) * (1 + 3 * F.col("stuck")) * F.when(F.col("suits"), 1.0).otherwise(1e6))
    good = F.col("ok") & F.col("suits")
    every = Window.partitionBy()
    drive = good & (F.col("vehicle") != "foot")
    first = lambda where, *by: F.min(F.when(where, F.struct(*by, "vehicle"))).over(every).getField("vehicle")
    o = o.withColumns({"by_score": first(good, "score"), "by_time": first(good, "expected_minutes"), "by_danger": first(good, "danger", "expected_minutes"), "driven": first(drive, "score")})
    best_min = F.min(F.when(F.col("vehicle") == F.col("driven"), F.col("expected_minutes"))).over(every)
    built = F.max(F.when((F.col("vehicle") == PRIMARY.get(mission, "")) & good & (F.col("p_arrive") >= 0.9) & (F.col("danger") < 50), F.col("expected_minutes"))).over(every) <= 2 * best_min + 10
    o = o.withColumn("best", F.when(built, F.lit(PRIMARY.get(mission))).otherwise(F.col("by_score")))
    role = lambda c: F.coalesce(F.col("vehicle") == F.col(c), F.lit(False))
    return o.select("vehicle", "ok", "suits", "expected_minutes", "p_arrive", "danger", "score", role("best").alias("is_best"), role("by_time").alias("is_fastest"), role("by_danger").alias("is_safest")).orderBy(F.desc("ok"), "expected_minutes", "vehicle")


def structure_scores(b: DataFrame) -> DataFrame:
    """Score, level and reasons of buildings (kind, weight, fire_risk, strikes, trees_in_reach, response_min, road_dist)."""
    sens = F.greatest(F.coalesce("weight", F.lit(0.0)), text.sensitivity(F.col("kind")))
    fire, strikes = clip((F.col("fire_risk") - 20) / 60, 0, 1), F.least(F.col("strikes") / 0.05, F.lit(1.0))
    no_road = F.col("road_dist") > 150
    access = F.least(F.greatest(F.col("response_min") - 3, F.lit(0.0)) / 15, F.lit(1.0)) * 0.5 + F.when(no_road, 0.5).otherwise(0.0)
    score = 0.35 * F.least(sens / 3, F.lit(1.0)) + 0.65 * (0.4 * fire + 0.35 * strikes + 0.25 * access)
    why = text.reasons((fire > 0.6, "high fire risk around"), (strikes > 0.4, "trees can fall on it"), (no_road, "no road access"), (~no_road & (F.col("response_min") > 10), "slow rescue access"), (sens >= 2.5, "sensitive"))
    return b.withColumns({"sensitivity": sens, "score": score, "level": structure_level(score), "reasons": why})


def structures_at_risk(buildings: DataFrame, trees: DataFrame, cells: DataFrame, res: float = 5.0) -> DataFrame:
    """Buildings (building_id, x, y, kind, weight, response_min, road_dist) with the greatest fire risk within six cells and the expected strikes of trees (x, y, p_fail, w_bld) within 35 m."""
    around = F.sequence(F.lit(-6), F.lit(6))
    at = lambda c: F.floor(F.col(c) / res).cast("int")
    w = buildings.select("building_id", at("y").alias("by"), at("x").alias("bx")).withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around))
    fire = w.select("building_id", (F.col("by") + F.col("dy")).alias("iy"), (F.col("bx") + F.col("dx")).alias("ix")).join(cells.select("iy", "ix", "risk"), ["iy", "ix"]).groupBy("building_id").agg(F.max("risk").alias("fire_risk"))
    hit = near_pairs(buildings.select("building_id", "x", "y"), trees.filter("w_bld > 0").select("x", "y", "p_fail", "w_bld"), 35.0)
    strikes = hit.groupBy("building_id").agg(F.sum(F.col("r_p_fail") * F.col("r_w_bld")).alias("strikes"), F.count(F.lit(1)).alias("trees_in_reach"))
    return structure_scores(buildings.join(fire, "building_id", "left").join(strikes, "building_id", "left").na.fill(0.0, ["fire_risk", "strikes"]).na.fill(0, ["trees_in_reach"]))


def blocked_cells(pieces: DataFrame, road_cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Road cells (2 m) in the square about the middle of each piece (mx, my, width, p) at least that likely to be blocked."""
    n = F.ceil((F.col("width") / 2 + 3) / 2).cast("int")
    p = pieces.filter(F.col("p") >= threshold).select(F.floor(F.col("my") / 2).cast("int").alias("cy"), F.floor(F.col("mx") / 2).cast("int").alias("cx"), n.alias("n"))
    p = p.withColumn("iy", F.explode(F.sequence(F.col("cy") - F.col("n"), F.col("cy") + F.col("n")))).withColumn("ix", F.explode(F.sequence(F.col("cx") - F.col("n"), F.col("cx") + F.col("n"))))
    return road_cells.join(p.select("iy", "ix").distinct(), ["iy", "ix"], "left_semi")


def strike_weights(hits: DataFrame, bearings: int, wind_from: float, kappa: float = 2.0) -> DataFrame:
    """Per tree and asset kind and piece, the probability weight of the bearings that hit it: von Mises about the downwind direction. hits: tree_id, direction, kind, piece_id."""
    import math

    head = math.radians(90 - (wind_from + 180) % 360)
    raw = [math.exp(kappa * math.cos(2 * math.pi * k / bearings - head)) for k in range(bearings)]
    weights = F.array(*[F.lit(x / sum(raw)) for x in raw])
    return hits.groupBy("tree_id", "kind", "piece_id").agg(F.sum(F.get(weights, F.col("direction"))).alias("w"))


def piece_probability(weights: DataFrame, trees: DataFrame) -> DataFrame:
    """Probability that a falling tree hits each asset piece: 1 - prod(1 - p_fail * w)."""
    from boreal.operators.montecarlo import noisy_or

    return noisy_or(weights.join(trees.select("tree_id", "p_fail"), "tree_id").withColumn("q", F.col("p_fail") * F.col("w")), ["kind", "piece_id"], "q")


def points_of_interest(trees: DataFrame, pieces: DataFrame, cells: DataFrame) -> DataFrame:
    """(what, id, value): the likeliest fall onto an asset, the worst piece of each kind, the 20 m cell with most dead trees, the cell of greatest risk within 150 m of people."""
    top = lambda df, what, key, value: df.orderBy(F.desc(value), key).limit(1).select(F.lit(what).alias("what"), F.col(key).cast("string").alias("id"), F.col(value).cast("double").alias("value"))
    dead = trees.filter("health = 2").groupBy(F.concat_ws("/", F.floor(F.col("y") / 20), F.floor(F.col("x") / 20)).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hot = cells.filter("d_human < 150").select(F.concat_ws("/", "iy", "ix").alias("id"), "risk")
    out = top(trees, "tree", "tree_id", "risk").union(top(dead, "dead_cluster", "id", "n")).union(top(hot, "fire_hotspot", "id", "risk"))
    for kind in ("power", "road"):
        out = out.union(top(pieces.filter(F.col("kind") == kind), f"worst_{kind}", "piece_id", "p"))
    return out


def ignition_point(cells: DataFrame) -> DataFrame:
    """Where to start a trial fire: greatest risk, with a bonus near people and a malus on their doorstep."""
    d = F.col("d_human")
    bonus = F.when((d >= 40) & (d < 150), 25.0).when(d < 25, -50.0).otherwise(0.0)
    return cells.orderBy(F.desc(F.col("risk") + bonus), "iy", "ix").limit(1).select("iy", "ix")


def latest_departure(path: DataFrame, cells: DataFrame, margin: float = 5.0) -> DataFrame:
    """Minutes that are left to start a route before fire reaches its neighbourhood (three cells): path: route, iy, ix, minutes; cells: iy, ix, arrival."""
    around = F.sequence(F.lit(-3), F.lit(3))
    p = path.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around))
    p = p.select("route", "minutes", (F.col("iy") + F.col("dy")).alias("iy"), (F.col("ix") + F.col("dx")).alias("ix")).join(cells.filter("arrival IS NOT NULL").select("iy", "ix", "arrival"), ["iy", "ix"])
    return p.groupBy("route").agg(F.greatest(F.lit(0.0), F.min("arrival") - F.max("minutes") - margin).alias("leave_within"))
