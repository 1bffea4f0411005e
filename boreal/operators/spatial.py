"""Spatial joins on grid buckets: an equi-join on cells, then the distance. None becomes a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreal.functions.geo import segment_distance
from boreal.plans.rounds import Rounds


def bucket(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, r: float, prefix: str = "r_") -> DataFrame:
    """All pairs of points (x, y) within r; right's columns get the prefix. The right rows go to the 3 x 3 buckets of size r around them."""
    right = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = right.withColumn("cx", F.explode(F.transform(around, lambda d: bucket(F.col(prefix + "x"), r) + d))).withColumn("cy", F.explode(F.transform(around, lambda d: bucket(F.col(prefix + "y"), r) + d)))
    left = left.withColumns({"cx": bucket(F.col("x"), r), "cy": bucket(F.col("y"), r)})
    dx, dy = F.col("x") - F.col(prefix + "x"), F.col("y") - F.col(prefix + "y")
    right = right.hint("merge")  # the size of its rows before they are copied would let it be broadcast
    return left.join(right, ["cx", "cy"]).drop("cx", "cy").withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") <= r)


def nearest_within(left: DataFrame, key: str, right: DataFrame, right_key: str, r: float) -> DataFrame:
    """Each left key's nearest right row within r: key, right key, distance; of equally near ones the least key. Searched once for all left rows at one position, among right positions, each with its least key."""
    sites = right.groupBy("x", "y").agg(F.min(right_key).alias(right_key))
    pairs = near_pairs(left.select("x", "y").distinct(), sites, r)
    best = pairs.groupBy("x", "y").agg(F.min(F.struct("d", F.col(f"r_{right_key}").alias(right_key))).alias("m"))
    return left.select(key, "x", "y").join(best, ["x", "y"]).groupBy(key).agg(F.min("m").alias("m")).select(key, f"m.{right_key}", "m.d")


def k_nearest_within(left: DataFrame, key: str, right: DataFrame, right_key: str, r: float, k: int) -> DataFrame:
    """At most k of them, with their rank. Searched once a position, as nearest_within(), among right positions, each with its k least keys."""
    from pyspark.sql import Window

    def first(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)

    sites = first(right.select(right_key, "x", "y"), ["x", "y"], right_key).drop("rank")
    pairs = near_pairs(left.select("x", "y").distinct(), sites, r).select("x", "y", F.col(f"r_{right_key}").alias(right_key), "d")
    best = first(pairs, ["x", "y"], "d", right_key).drop("rank")
    return first(left.select(key, "x", "y").join(best, ["x", "y"]).select(key, right_key, "d"), [key], "d", right_key)


def no_taller_neighbour(trees: DataFrame, r: float = 1.5) -> DataFrame:
    """Trees with none taller within r: those seen from above. A position is compared with the two tallest of each position within r, of different ids, as a tree is not compared with itself."""
    from pyspark.sql import Window

    def tallest(rows: DataFrame) -> DataFrame:
        top = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("h"), "id"))
        return rows.groupBy("x", "y", "id").agg(F.max("h").alias("h")).withColumn("place", top).filter("place <= 2")

    tops = tallest(trees.filter("tree_id IS NOT NULL AND h IS NOT NULL").select("x", "y", F.col("tree_id").alias("id"), "h")).drop("place")
    near = near_pairs(trees.select("x", "y").distinct(), tops, r).select("x", "y", F.col("r_id").alias("id"), F.col("r_h").alias("h"))
    at = lambda k: F.max(F.when(F.col("place") == k, F.struct("h", "id")))
    above = tallest(near).groupBy("x", "y").agg(at(1).alias("first"), at(2).alias("second"))
    taller = F.when(F.col("first.id") != F.col("tree_id"), F.col("first.h")).when(F.col("first.id") == F.col("tree_id"), F.col("second.h"))
    return trees.join(above, ["x", "y"], "left").filter(~F.coalesce(taller > F.col("h"), F.lit(False))).select(*trees.columns)


def unmapped(found: DataFrame, key: str, known: DataFrame, r: float) -> DataFrame:
    """Found features without a known one within r."""
    return found.join(near_pairs(found.select(key, "x", "y"), known.select("x", "y"), r).select(key).distinct(), key, "left_anti")


def nearest_segment(points: DataFrame, key: str, segments: DataFrame, r: float, size: float | None = None) -> DataFrame:
    """Each point's nearest segment (ax, ay, bx, by_) within r: key, seg_id, d, foot point. A segment goes to the buckets that its box grown by r covers."""
    size = size or max(r, 1.0)
    span = lambda a, b: F.sequence(bucket(F.least(a, b) - r, size), bucket(F.greatest(a, b) + r, size))
    s = segments.select("seg_id", "ax", "ay", "bx", "by_").withColumn("cx", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("cy", F.explode(span(F.col("ay"), F.col("by_"))))
    p = points.select(key, "x", "y").withColumns({"cx": bucket(F.col("x"), size), "cy": bucket(F.col("y"), size)})
    d, fx, fy = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"))
    pairs = p.join(s, ["cx", "cy"]).select(key, "seg_id", d.alias("d"), fx.alias("fx"), fy.alias("fy")).filter(F.col("d") <= r)
    return pairs.groupBy(key).agg(F.min(F.struct("d", "seg_id", "fx", "fy")).alias("m")).select(key, "m.*")


def covered_cells(discs: DataFrame, key: str, res: float) -> DataFrame:
    """Cells whose centre lies within r of (x, y); of several discs the least key has the cell."""
    span = lambda c: F.sequence(bucket(F.col(c) - F.col("r"), res), bucket(F.col(c) + F.col("r"), res))
    rows = discs.select(key, "x", "y", "r").withColumn("ix", F.explode(span("x"))).withColumn("iy", F.explode(span("y")))
    dx, dy = (F.col("ix") + 0.5) * res - F.col("x"), (F.col("iy") + 0.5) * res - F.col("y")
    return rows.filter(dx * dx + dy * dy <= F.col("r") * F.col("r")).groupBy("iy", "ix").agg(F.min(key).alias(key))


def densify(segments: DataFrame, step: float) -> DataFrame:
    """Points along each segment, at equal distances of at most step, both ends included: seg_id, k, x, y."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / step).cast("int"))
    rows = segments.select("seg_id", "ax", "ay", dx.alias("dx"), dy.alias("dy"), n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    return rows.select("seg_id", "k", (F.col("ax") + t * F.col("dx")).alias("x"), (F.col("ay") + t * F.col("dy")).alias("y"))


def points_in_polygons(points: DataFrame, key: str, polygons: DataFrame, polygon_key: str, size: float) -> DataFrame:
    """(key, polygon key) by the even-odd rule; polygons: an array `ring` of structs (x, y). A polygon goes to the buckets of its box. The rule is applied once to a position and a ring, whatever the points and polygons that have them."""
    from boreal.functions.geo import in_ring

    lo = lambda f, a: f(F.transform("ring", lambda p: p[a]))
    span = lambda a: F.sequence(bucket(lo(F.array_min, a), size), bucket(lo(F.array_max, a), size))
    q = polygons.select("ring").distinct().select("ring", F.explode(span("x")).alias("cx"), span("y").alias("ys")).withColumn("cy", F.explode("ys")).drop("ys")
    p = points.select("x", "y").distinct().withColumns({"cx": bucket(F.col("x"), size), "cy": bucket(F.col("y"), size)})
    inside = p.join(q.hint("merge"), ["cx", "cy"]).filter(in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("x", "y", "ring")
    owned = inside.join(polygons.select(polygon_key, "ring"), "ring").select("x", "y", polygon_key)
    return points.select(key, "x", "y").join(owned, ["x", "y"]).select(key, polygon_key)


def ray_hits(trees: DataFrame, assets: DataFrame, bearings: int = 36, res: float = 1.0) -> DataFrame:
    """First asset cell of each kind that a tree of height h meets in each direction: tree_id, direction, kind, piece_id, step. assets: (kind, iy, ix, piece_id). Steps are of one cell; trees without an asset cell within reach are dropped before the rays are cast."""
    coarse = 32.0
    near = assets.select(F.floor(F.col("iy") * res / coarse).alias("by"), F.floor(F.col("ix") * res / coarse).alias("bx")).distinct()
    reach = F.ceil(F.col("h") / res).cast("int")
    trees = trees.select("tree_id", "x", "y", "h")
    box = trees.withColumn("bx", F.explode(F.sequence(F.floor((F.col("x") - F.col("h")) / coarse), F.floor((F.col("x") + F.col("h")) / coarse)))).withColumn("by", F.explode(F.sequence(F.floor((F.col("y") - F.col("h")) / coarse), F.floor((F.col("y") + F.col("h")) / coarse))))
    close = trees.join(box.join(near, ["by", "bx"]).select("tree_id").distinct(), "tree_id", "left_semi")
    rays = close.withColumn("direction", F.explode(F.sequence(F.lit(0), F.lit(bearings - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), reach)))
    a = F.radians(F.col("direction") * (360.0 / bearings))
    rays = rays.filter(F.col("step") * res <= F.col("h")).select(
        "tree_id", "direction", "step", F.floor((F.col("x") + F.col("step") * res * F.cos(a)) / res).cast("int").alias("ix"), F.floor((F.col("y") + F.col("step") * res * F.sin(a)) / res).cast("int").alias("iy")
    )
    hits = rays.join(assets.withColumns({"ix": F.col("ix").cast("int"), "iy": F.col("iy").cast("int")}), ["iy", "ix"])
    return hits.groupBy("tree_id", "direction", "kind").agg(F.min(F.struct("step", "piece_id")).alias("m")).select("tree_id", "direction", "kind", "m.piece_id", "m.step")


def first_apart(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, kept): what a walk through the items in their order keeps, if it drops every item that an earlier kept one rules out. items: item; pairs: early, late (early comes before late in the order, and rules it out if it is kept).

    Decided in rounds for all items at once: an item is dropped as soon as an earlier one that rules it out is kept, and kept as soon as all of those are dropped. The result is that of the walk for any order; rounds grow with the longest chain of such pairs, a few for orders that are not spatial."""
    rounds = Rounds(items.sparkSession, "apart")
    pairs = rounds.keep(pairs.select("early", "late").distinct(), "pairs")
    state = rounds.keep(items.select("item", F.lit(None).cast("boolean").alias("kept")), "state")
    while not state.filter("kept IS NULL").isEmpty():
        early = pairs.join(state.select(F.col("item").alias("early"), "kept"), "early").groupBy(F.col("late").alias("item")).agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("out"), F.bool_or(F.col("kept").isNull()).alias("open"))
        now = state.withColumnRenamed("kept", "was").join(early, "item", "left")
        kept = F.when(F.col("was").isNotNull(), F.col("was")).when(F.col("out"), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True)
        state = rounds.keep(now.select("item", kept.alias("kept")), "state")
    return state


def apart(points: DataFrame, key: str, order: list[Column], r: float) -> DataFrame:
    """Points (key, x, y and what the order takes) without those that lie within r of one that comes earlier in the order and stays. The order names each point once.

    What drops a point drops the later ones at its position too, and so does the point itself if it stays: only the first of a position is walked. A point without a position stays."""
    whole = F.struct(*points.columns).alias("row")
    first = points.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y", F.struct(*order).alias("place"), whole).groupBy("x", "y").agg(F.min("place").alias("place"), F.min_by("row", "place").alias("row"))
    first = Rounds(points.sparkSession, "first").keep(first.select(F.struct("x", "y").alias("item"), "x", "y", "place", "row"), "first")
    near = near_pairs(first.drop("row"), first.drop("row"), r).filter(F.col("r_place") < F.col("place"))
    kept = first_apart(first.select("item"), near.select(F.col("r_item").alias("early"), F.col("item").alias("late")))
    return first.join(kept.filter("kept").select("item"), "item", "left_semi").select("row.*").unionByName(points.filter("x IS NULL OR y IS NULL"))


def distinct_lines(lines: DataFrame, key: str, order: list[Column], near: float = 6.0, share: float = 0.6, samples: int = 10) -> DataFrame:
    """Straight lines (key, ax, ay, bx, by_ and what the order takes) without those of which more than `share` of the sample points lie within `near` of an earlier line that stays: parallel phases of one conductor, pieces found twice."""
    p = lines.withColumn("place", F.struct(*order)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    t = F.col("k") / (samples - 1)
    p = p.select(key, "place", "k", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by_") - F.col("ay"))).alias("y"))
    size = max(4 * near, 50.0)
    span = lambda a, b: F.sequence(bucket(F.least(a, b) - near, size), bucket(F.greatest(a, b) + near, size))
    q = lines.select(F.col(key).alias("early"), F.struct(*order).alias("first"), "ax", "ay", "bx", "by_", F.explode(span("ax", "bx")).alias("cx")).withColumn("cy", F.explode(span("ay", "by_")))
    m = p.withColumns({"cx": bucket(F.col("x"), size), "cy": bucket(F.col("y"), size)}).join(q, ["cx", "cy"]).filter("first < place")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))))
    close = F.hypot(F.col("x") - F.col("ax") - u * dx, F.col("y") - F.col("ay") - u * dy) < near
    pairs = m.filter(close).groupBy("early", F.col(key).alias("late")).agg(F.countDistinct("k").alias("n")).filter(F.col("n") > share * samples)
    kept = first_apart(lines.select(F.col(key).alias("item")), pairs)
    return lines.join(kept.filter("kept").select(F.col("item").alias(key)), key, "left_semi")
