"""Roads and cleared corridors in pictures from above: pixel classes by stencils, straight lines by Hough votes as aggregates, pieces of one line merged.

Pictures are long tables of pixels (by, iy, ix, red, green, blue: 0 to 255), rows from south to north; `by` are the columns of the picture's key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreal.operators import grid, network
from boreal.operators.spatial import first_apart, unmapped
from boreal.plans.rounds import Rounds

CLASSES = ("water", "veg", "road", "cleared", "forest")


def classified(pixels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pixels with a flag for each of CLASSES. Cleared ground is vegetation much brighter, over nine pixels, than the picture's vegetation usually is (its median, by a sketch)."""
    keys = [*by, "iy", "ix"]
    r, g, b = (F.col(c) / 255.0 for c in ("red", "green", "blue"))
    total = r + g + b + 1e-6
    p = pixels.select(*keys, ((2 * g - r - b) / total).alias("exg"), (total / 3).alias("bright"), (b / total).alias("blue"))
    p = p.join(grid.opened(p.select(*keys, ((F.col("blue") > 0.37) & (F.col("bright") < 0.45) & (F.col("exg") < 0.07)).alias("water")), "water", 2, by), keys)
    p = p.withColumn("veg", (F.col("exg") > 0.045) & ~F.col("water"))
    p = p.join(grid.box_mean(p.select(*keys, F.col("bright").alias("near")), "near", 4, by), keys)
    usual = p.groupBy(*by).agg(F.coalesce(F.percentile_approx(F.when(F.col("veg"), F.col("near")), 0.5, 10_000), F.lit(0.25)).alias("usual"))
    p = p.join(usual, list(by)) if by else p.crossJoin(F.broadcast(usual))  # one row
    cleared = F.col("veg") & (F.col("near") > 1.3 * F.col("usual"))
    return p.select(*keys, "water", "veg", (~F.col("veg") & ~F.col("water") & (F.col("bright") > 0.33)).alias("road"), cleared.alias("cleared"), (F.col("veg") & ~cleared).alias("forest"))


def halved(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Classes of 2 x 2 pixels: set where more than half of the four are."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    rows = cells.groupBy(*by, half("iy"), half("ix")).agg(F.count(F.lit(1)).alias("n"), *[(F.count_if(c) > 2).alias(c) for c in CLASSES])
    return rows.filter("n = 4").drop("n")


def hough_votes(points: DataFrame, angles: int = 180, step: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, bin, votes): how many points (by, x, y) lie on each line whose normal has the angle pi k / angles and whose distance from the origin is in the bin, `step` wide."""
    k = F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("k")
    return points.select(*by, "x", "y", k).groupBy(*by, "k", _bin(angles, step).alias("bin")).agg(F.count(F.lit(1)).alias("votes"))


def _bin(angles: int, step: float) -> Column:
    a = F.col("k") * (math.pi / angles)
    return F.floor(F.round((F.col("x") * F.cos(a) + F.col("y") * F.sin(a)) / step, 9))


def hough_peaks(votes: DataFrame, least: int, angles: int = 180, near_k: int = 4, near_bin: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """The lines with at least `least` votes and more than any other within near_k angles and near_bin bins; of equals the one of the least (k, bin). Beyond the last angle the first one follows with distances of the other sign."""
    v = votes.filter(F.col("votes") >= least)
    arms = F.array(*[F.struct(F.lit(a).alias("dk"), F.lit(b).alias("db")) for a in range(-near_k, near_k + 1) for b in range(-near_bin, near_bin + 1)])
    sent = v.select(*by, F.col("k").alias("of_k"), F.col("bin").alias("of_bin"), "votes", F.explode(arms).alias("o"))
    to = F.col("of_k") + F.col("o.dk")
    round_ = (to < 0) | (to >= angles)
    sent = sent.select(*by, F.pmod(to, F.lit(angles)).alias("k"), F.when(round_, -F.col("of_bin") - 1 + F.col("o.db")).otherwise(F.col("of_bin") + F.col("o.db")).alias("bin"), F.struct(-F.col("votes"), "of_k", "of_bin").alias("rival"))
    best = sent.groupBy(*by, "k", "bin").agg(F.min("rival").alias("rival"))
    own = F.struct(-F.col("votes"), F.col("k").alias("of_k"), F.col("bin").alias("of_bin"))
    return v.join(best, [*by, "k", "bin"]).filter(own == F.col("rival")).select(*by, "k", "bin", "votes")


def straight_pieces(points: DataFrame, peaks: DataFrame, least_m: float, gap: float, angles: int = 180, step: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The runs of points along each peak's line (in its bin or those beside it) without a gap above `gap` and of at least `least_m`: (by, k, bin, piece, n, ax, ay, bx, by_), ends on the line."""
    near = peaks.select(*by, "k", "bin").withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    ks = F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("k")
    on = points.select(*by, "x", "y", ks).withColumn("at", _bin(angles, step)).join(near, [*by, "k", "at"])
    a = F.col("k") * (math.pi / angles)
    on = on.withColumn("t", F.col("y") * F.cos(a) - F.col("x") * F.sin(a))
    key = [*by, "k", "bin"]
    w = Window.partitionBy(*key).orderBy("t", "x", "y")
    on = on.withColumn("piece", F.sum(F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = on.groupBy(*key, "piece").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")).filter(F.col("t1") - F.col("t0") >= least_m)
    rho = (F.col("bin") + 0.5) * step
    end = lambda t: ((rho * F.cos(a) - F.col(t) * F.sin(a)), (rho * F.sin(a) + F.col(t) * F.cos(a)))
    (ax, ay), (bx, by_) = end("t0"), end("t1")
    return s.select(*key, "piece", "n", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by_.alias("by_"))


def merged_lines(lines: DataFrame, near: float = 8.0, cos: float = 0.995, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines (by, line, ax, ay, bx, by_), the longest first: one that is parallel to an earlier kept one, with both ends within `near` of it, extends the first such. What is kept does not depend on how far lines were extended, so all are decided at once."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    size = F.hypot(dx, dy) + 1e-9
    v = lines.select(*by, "line", "ax", "ay", "bx", "by_", (dx / size).alias("ux"), (dy / size).alias("uy"), F.struct((-size).alias("size"), "line").alias("place"))
    width = math.acos(cos)
    sector = F.floor(F.pmod(F.atan2("uy", "ux"), F.lit(math.pi)) / width)
    n = math.ceil(math.pi / width)
    late = v.withColumn("sector", sector)
    early = v.select(*[F.col(c).alias(c if c in by else f"e_{c}") for c in v.columns]).withColumn("s", F.floor(F.pmod(F.atan2("e_uy", "e_ux"), F.lit(math.pi)) / width))
    early = early.withColumn("sector", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("s") + d, F.lit(n)) for d in (-2, -1, 0, 1, 2)])))).drop("s")
    off = lambda x, y: F.abs((F.col(x) - F.col("e_ax")) * -F.col("e_uy") + (F.col(y) - F.col("e_ay")) * F.col("e_ux"))
    pairs = late.join(early, [*by, "sector"]).filter((F.col("e_place") < F.col("place")) & (F.abs(F.col("ux") * F.col("e_ux") + F.col("uy") * F.col("e_uy")) > cos) & (off("ax", "ay") < near) & (off("bx", "by_") < near))
    name = lambda p="": F.struct(*by, F.col(f"{p}line").alias("line"))
    kept = first_apart(v.select(name().alias("item")), pairs.select(name("e_").alias("early"), name().alias("late"))).filter("kept").select(F.col("item").alias("k"))
    to = pairs.withColumn("k", name("e_")).join(kept, "k", "left_semi").groupBy(*by, "line").agg(F.min(F.struct("e_place", "e_line")).alias("m")).select(*by, "line", F.col("m.e_line").alias("into"))
    gone = v.join(kept, name() == F.col("k"), "left_anti").join(to, [*by, "line"]).select(*by, F.col("into").alias("line"), F.array(F.struct("ax", "ay"), F.struct(F.col("bx").alias("ax"), F.col("by_").alias("ay"))).alias("ends"))
    own = v.join(kept, name() == F.col("k"), "left_semi")
    ends = own.select(*by, "line", F.array(F.struct("ax", "ay"), F.struct(F.col("bx").alias("ax"), F.col("by_").alias("ay"))).alias("ends")).union(gone).select(*by, "line", F.explode("ends").alias("e"))
    t = (F.col("e.ax") - F.col("ax")) * F.col("ux") + (F.col("e.ay") - F.col("ay")) * F.col("uy")
    span = ends.join(own, [*by, "line"]).groupBy(*by, "line", "ax", "ay", "ux", "uy").agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    at = lambda c, u, t: (F.col(c) + F.col(u) * F.col(t))
    return span.select(*by, "line", at("ax", "ux", "t0").alias("x0"), at("ay", "uy", "t0").alias("y0"), at("ax", "ux", "t1").alias("x1"), at("ay", "uy", "t1").alias("y1")).withColumnsRenamed({"x0": "ax", "y0": "ay", "x1": "bx", "y1": "by_"})


def _strip(cells: DataFrame, mask: Column, closings: int, openings: int, by: tuple[str, ...]) -> DataFrame:
    return grid.opened(grid.closed(cells.select(*by, "iy", "ix", mask.alias("strip")), "strip", closings, by), "strip", openings, by)


def corridors(cells: DataFrame, res: float = 1.0, least_m: float = 150.0, tile: int = 400, votes: int = 40, by: tuple[str, ...] = ()) -> DataFrame:
    """Long straight cleared strips through forest, as of power lines: (by, line, ax, ay, bx, by_, length, width, confidence). cells: halved(). A strip whose middle is gravel is a road, and is left out."""
    keys = [*by, "iy", "ix"]
    rounds = Rounds(cells.sparkSession, "corridors")
    strip = rounds.keep(_strip(cells, F.col("cleared") | F.col("road"), 2, 2, by), "strip")
    forest = grid.box_mean(cells.select(*keys, F.col("forest").cast("double").alias("forest")), "forest", 20, by)
    thin = network.skeleton(strip, "strip", res, tile, by=by).filter(F.col("half").between(3, 22)).join(forest.filter("forest > 0.25"), keys, "left_semi")
    thin = rounds.keep(thin, "thin")
    points = thin.select(*by, ((F.col("ix") + 0.5) * res).alias("x"), ((F.col("iy") + 0.5) * res).alias("y"))
    peaks = hough_peaks(hough_votes(points, by=by), votes, by=by)
    found = straight_pieces(points, peaks, least_m * 0.5, 12.0, by=by)
    found = rounds.keep(merged_lines(rounds.keep(found.withColumn("line", F.struct("k", "bin", "piece")), "pieces"), by=by), "merged")
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    found = found.withColumn("length", length).filter(F.col("length") >= least_m)
    half = grid.distance_to(strip.withColumn("not", ~F.col("strip")), "not", res, by=by).select(*keys, F.col("distance").alias("half"))
    near = lambda c, n: grid.dilate(cells.select(*keys, c), c, [o for o in grid.square(n) if abs(o[0]) + abs(o[1]) <= n], by)
    look = half.join(near("road", 3), keys).join(near("cleared", 2), keys)
    t = F.col("s") / 29.0
    s = found.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(29))))
    s = s.select(*by, "line", F.floor((F.col("ax") + t * (F.col("bx") - F.col("ax"))) / res).cast("int").alias("ix"), F.floor((F.col("ay") + t * (F.col("by_") - F.col("ay"))) / res).cast("int").alias("iy")).join(look, keys)
    seen = s.groupBy(*by, "line").agg((F.median("half") * 2).alias("width"), F.avg(F.col("road").cast("int")).alias("gravel"), F.avg(F.col("cleared").cast("int")).alias("green"))
    sure = F.least(F.lit(1.0), F.col("green") * (1 - F.col("gravel")) * F.least(F.col("length") / 300, F.lit(1.0)) + 0.2)
    return found.join(seen, [*by, "line"]).filter((F.col("gravel") <= 0.3) & (F.col("green") >= 0.6)).select(*by, "line", "ax", "ay", "bx", "by_", "length", "width", sure.alias("confidence"))


def image_roads(cells: DataFrame, res: float = 1.0, least_m: float = 50.0, tile: int = 400, known: DataFrame | None = None, apart_from: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Roads by their surface: thinned strips of 1 to 6.5 m half width through forest, each part's longest line: (by, line, seq, x, y, width, side, straight, confidence, mapped). known: vertices (x, y) of mapped roads; apart_from: points (x, y) of corridors and power lines, of which roads keep 12 m."""
    keys, key = [*by, "iy", "ix"], [*by, "line"]
    rounds = Rounds(cells.sparkSession, "image-roads")
    strip = rounds.keep(_strip(cells, F.col("road"), 2, 1, by), "strip")
    forest = grid.box_mean(cells.select(*keys, F.col("forest").cast("double").alias("forest")), "forest", 12, by)
    thin = network.skeleton(strip, "strip", res, tile, by=by).filter(F.col("half").between(1.0, 6.5)).join(forest.filter("forest > 0.3"), keys, "left_semi")
    if apart_from is not None:
        v = thin.select(*keys, "half", ((F.col("ix") + 0.5) * res).alias("x"), ((F.col("iy") + 0.5) * res).alias("y")).withColumn("v", F.struct(*keys))
        thin = unmapped(v, "v", apart_from, 12.0).drop("v", "x", "y")
    thin = rounds.keep(thin, "thin")
    path = network.longest_lines(thin, by).join(thin, keys).select(*key, "seq", "half", ((F.col("ix") + 0.5) * res).alias("x"), ((F.col("iy") + 0.5) * res).alias("y"))
    path = rounds.keep(path, "path")
    soft = network.smooth_line(path.select(*key, "seq", "x", "y"), key, 9)
    width = path.groupBy(*key).agg((F.median("half") * 2).alias("width"))
    # forest beside it: sampled like canopy, 12 m where most pixels around are forest and 0 elsewhere
    stand = grid.box_mean(cells.select(*keys, F.col("forest").cast("double").alias("f")), "f", 2, by).select(*keys, F.when(F.col("f") > 0.4, 12.0).otherwise(0.0).alias("chm"))
    stand = stand.join(strip.select(*keys, "strip"), keys).select(*keys, F.when(F.col("strip"), 0.0).otherwise(F.col("chm")).alias("chm"))
    m = width.join(network.straightness(path, key).select(*key, F.col("run").alias("length")), key).join(network.straightness(soft, key).select(*key, "straight"), key).join(network.side_contrast(soft, key, width, stand, res, by), key)
    m = m.filter((F.col("length") >= least_m) & (F.col("side") >= 0.5) & (F.col("straight") >= 0.5))
    m = m.withColumn("confidence", 0.5 * F.col("side") + 0.5 * F.least(F.col("straight") / 0.8, F.lit(1.0)))
    if known is None:
        return soft.join(m.withColumn("mapped", F.lit(False)), key)
    p = soft.withColumn("v", F.struct("line", "seq"))
    free = unmapped(p, "v", known, 9.0).groupBy(*key).agg(F.count(F.lit(1)).alias("free"))
    share = soft.groupBy(*key).agg(F.count(F.lit(1)).alias("all")).join(free, key, "left").select(*key, (1 - F.coalesce("free", F.lit(0)) / F.col("all") > 0.6).alias("mapped"))
    return soft.join(m.join(share, key), key)
