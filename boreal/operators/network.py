"""Road networks from thin cell masks: graphs of neighbouring cells, chains put in order by pointer jumping, evidence along their sides, links over gaps.

Masks are long tables (by, iy, ix) of at most 2**28 rows and 2**31 columns a site; `by` are the columns of the site's key, and sites never touch. Nothing is bounded by a tile: a line is whole however many tiles its cells come from.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreal.operators import graph, grid
from boreal.operators.kernels import distance, per_tile, thinned
from boreal.operators.spatial import bucket
from boreal.plans.rounds import Rounds

#: The neighbours of a cell (dy, dx), clockwise; every other one is diagonal.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _pick(values, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), k.cast("int") + 1)


def _arc(iy: Column, ix: Column, k: Column) -> Column:
    """The step from a cell to its k-th neighbour as one number."""
    return F.shiftleft(iy.cast("long"), 34) + F.shiftleft(ix.cast("long"), 3) + k


def _reversed(arc: Column) -> Column:
    k = arc.bitwiseAND(F.lit(7))
    iy, ix = F.shiftright(arc, 34), F.shiftright(arc, 3).bitwiseAND(F.lit((1 << 31) - 1))
    return _arc(iy + _pick([r[0] for r in RING], k), ix + _pick([r[1] for r in RING], k), (k + 4) % 8)


def cell_graph(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mask cells with `near`, the neighbours that each is linked to, as bits in the order of RING, and `degree`. Diagonal neighbours are linked only where no cell of the mask lies beside both, so that a staircase is one line and not a row of triangles."""
    keys = [*by, "iy", "ix"]
    arms = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate(RING)], F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(0).alias("bit")))
    sent = cells.select(*keys).distinct().withColumn("o", F.explode(arms)).select(*by, (F.col("iy") - F.col("o.dy")).alias("iy"), (F.col("ix") - F.col("o.dx")).alias("ix"), F.col("o.bit").alias("bit"))
    code = sent.groupBy(*keys).agg(F.sum("bit").alias("code"), F.bool_or(F.col("bit") == 0).alias("own")).filter("own")
    has = lambda k: F.col("code").bitwiseAND(F.lit(1 << k % 8)) != 0
    linked = sum((F.when(has(k) if k % 2 == 0 else has(k) & ~has(k - 1 + 8) & ~has(k + 1), 1 << k).otherwise(0) for k in range(8)), F.lit(0))
    return code.select(*keys, linked.cast("int").alias("near")).withColumn("degree", F.bit_count("near").cast("int"))


def _ranked(arcs: DataFrame, by: tuple[str, ...], rounds: Rounds, tag: str) -> tuple[DataFrame, int]:
    """arcs (by, arc, next: null at the end of a chain) with ptr, the chain's last arc, n and diag, how many arcs and diagonal arcs follow; and the number of arcs that never end, on rings, where ptr is open and least is the ring's least cell."""
    last = F.col("next").isNull()
    step = F.when(last, 0).otherwise(1).cast("long")
    now = arcs.select(*by, "arc", F.coalesce("next", "arc").alias("ptr"), step.alias("n"), F.when(last, 0).otherwise(F.col("next") % 2).cast("long").alias("diag"), last.alias("done"), F.shiftright("arc", 3).alias("least"))
    now, k, before = rounds.keep(now, f"{tag}0"), 0, -1
    while True:
        left = now.filter("NOT done").count()
        if not left or left == before and 1 << k >= left:
            return now, left
        before = left
        there = now.select(*by, F.col("arc").alias("ptr"), F.col("ptr").alias("far"), F.col("n").alias("n2"), F.col("diag").alias("diag2"), F.col("done").alias("done2"), F.col("least").alias("least2"))
        jumped = now.filter("NOT done").join(there, [*by, "ptr"]).select(*by, "arc", F.col("far").alias("ptr"), (F.col("n") + F.col("n2")).alias("n"), (F.col("diag") + F.col("diag2")).alias("diag"), F.col("done2").alias("done"), F.least("least", "least2").alias("least"))
        k += 1
        now = rounds.keep(now.filter("done").union(jumped), f"{tag}{k % 2}")


def chains(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The lines that a mask is made of: (by, chain, seq, iy, ix, diag, degree). A chain is a run of cells with two neighbours each, with the knots (ends and crossings) at its ends; a ring is cut at its least cell. seq counts from 0, diag the diagonal steps up to a cell. chain is a number of its first step; of the two ways to walk it, the one whose number is less.

    Every arc finds the end of its chain by pointer jumping, in log2 of the longest chain rounds; where it stands follows from the arc the other way. Cells without neighbours are no chain."""
    rounds = Rounds(cells.sparkSession, "chains")
    keys = [*by, "iy", "ix"]
    nodes = rounds.keep(cell_graph(cells, by), "nodes")
    k = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.col("near").bitwiseAND(_pick([1 << j for j in range(8)], j)) != 0))
    arcs = nodes.select(*by, F.col("iy").alias("ty"), F.col("ix").alias("tx"), F.col("degree").alias("t_degree"), k.alias("k"))
    arcs = arcs.withColumns({"iy": F.col("ty") + _pick([r[0] for r in RING], F.col("k")), "ix": F.col("tx") + _pick([r[1] for r in RING], F.col("k"))}).join(nodes, keys)
    back = (F.col("k") + 4) % 8
    onward = F.col("near").bitwiseAND(F.bitwise_not(_pick([1 << j for j in range(8)], back)))
    onward = F.bit_count(onward - 1)  # one bit is left: its place
    nxt = F.when(F.col("degree") == 2, _arc(F.col("iy"), F.col("ix"), onward))
    arcs = rounds.keep(arcs.select(*by, _arc(F.col("ty"), F.col("tx"), F.col("k")).alias("arc"), nxt.alias("next"), "iy", "ix", "degree", "ty", "tx", "t_degree"), "arcs")
    found, open_ = _ranked(arcs, by, rounds, "rank")
    if open_:
        rings = found.filter("NOT done").select(*by, "arc", "least")
        head = F.shiftleft(F.col("iy").cast("long"), 31) + F.col("ix").cast("long")
        cut = arcs.join(rings, [*by, "arc"]).select(*by, "arc", F.when(head != F.col("least"), F.col("next")).alias("next"))
        found = found.filter("done").union(_ranked(cut, by, rounds, "ring")[0])
    other = found.select(*by, F.col("arc").alias("rev"), F.col("ptr").alias("r_ptr"), F.col("n").alias("r_n"), F.col("diag").alias("r_diag"))
    both = arcs.join(found.select(*by, "arc", "ptr"), [*by, "arc"]).withColumn("rev", _reversed(F.col("arc"))).join(other, [*by, "rev"])
    both = both.withColumns({"chain": _reversed(F.col("r_ptr")), "twin": _reversed(F.col("ptr"))}).filter("chain < twin")
    rest = both.select(*by, "chain", (F.col("r_n") + 1).alias("seq"), "iy", "ix", (F.col("r_diag") + F.col("arc") % 2).alias("diag"), "degree")
    first = both.filter("arc = chain").select(*by, "chain", F.lit(0).cast("long").alias("seq"), F.col("ty").alias("iy"), F.col("tx").alias("ix"), F.lit(0).cast("long").alias("diag"), F.col("t_degree").alias("degree"))
    return rounds.keep(rest.union(first), "chains")


def segments(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row per chain: cells, length (in cells), and the cells and degrees of its ends: y0, x0, degree0, y1, x1, degree1."""
    end = F.struct("iy", "ix", "degree")
    s = lines.groupBy(*by, "chain").agg(F.count(F.lit(1)).alias("cells"), F.max("seq").alias("n"), F.max("diag").alias("diag"), F.min_by(end, "seq").alias("a"), F.max_by(end, "seq").alias("b"))
    at = [F.col(f"{e}.{c}").alias(f"{name}{k}") for k, e in enumerate("ab") for c, name in (("iy", "y"), ("ix", "x"), ("degree", "degree"))]
    return s.select(*by, "chain", "cells", (F.col("n") - F.col("diag") + F.col("diag") * math.sqrt(2)).alias("length"), *at)


def without_spurs(cells: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The mask without chains of under `least` cells between an end and a crossing; the crossing stays."""
    keys = [*by, "iy", "ix"]
    lines = chains(cells, by)
    s = segments(lines, by)
    spur = s.filter((F.least("degree0", "degree1") == 1) & (F.greatest("degree0", "degree1") > 2) & (F.col("cells") - 1 < least)).select(*by, "chain")
    gone = lines.join(spur, [*by, "chain"], "left_semi").filter("degree <= 2").select(*keys)
    return cells.select(*keys).distinct().join(gone, keys, "left_anti")


def networks(segs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """segs (segments()) with `network`: the least end cell (by, iy, ix) of all chains that hang together."""
    cell = lambda k: F.struct(*by, F.col(f"y{k}").alias("iy"), F.col(f"x{k}").alias("ix"))
    edges = segs.select(cell(0).alias("src"), cell(1).alias("dst"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    found = graph.components(edges, nodes)
    return segs.withColumn("node", cell(0)).join(found, "node").drop("node").withColumnRenamed("component", "network")


def longest_lines(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The longest shortest path through each connected part of a mask, as (by, line, seq, iy, ix): from the cell farthest from the part's least end to the cell farthest from that. Chains are edges here, so that a part of any size takes as many rounds as it has chains in a row; of equally far ends the least."""
    lines = chains(cells, by)
    segs = networks(segments(lines, by), by)
    cell = lambda k: F.struct(*by, F.col(f"y{k}").alias("iy"), F.col(f"x{k}").alias("ix"))
    there = segs.select(cell(0).alias("src"), cell(1).alias("dst"), F.col("length").alias("w"), "chain", F.lit(True).alias("forth"), "network")
    edges = there.union(segs.select(cell(1), cell(0), "length", "chain", F.lit(False), "network")).filter("src <> dst")
    rounds = Rounds(cells.sparkSession, "longest")
    edges = rounds.keep(edges.groupBy("src", "dst", "network").agg(F.min(F.struct("w", "chain", "forth")).alias("m")).select("src", "dst", "network", "m.*"), "edges")
    member = rounds.keep(edges.select(F.col("src").alias("node"), "network").distinct(), "member")
    seeds, reached = member.groupBy("network").agg(F.min("node").alias("node")).select("node", F.lit(0.0).alias("dist")), None
    for k in range(2):
        reached = rounds.keep(graph.relax(edges, seeds, before=True), f"reached{k}")
        far = reached.join(member, "node").groupBy("network").agg(F.min(F.struct(-F.col("dist"), "node")).alias("m")).select("network", F.col("m.node").alias("node"))
        far = rounds.keep(far, f"far{k}")
        seeds = far.select("node", F.lit(0.0).alias("dist"))
    path = graph.paths_to(reached, far).join(far.withColumnRenamed("node", "end"), "end")
    step = Window.partitionBy("network").orderBy("seq")
    hops = path.withColumn("src", F.lag("node").over(step)).filter("src IS NOT NULL").select("network", "src", F.col("node").alias("dst"), F.col("seq").alias("hop"))
    hops = hops.join(edges.drop("network"), ["src", "dst"])
    spread = hops.select(*[F.col(f"src.{b}").alias(b) for b in by], "network", "hop", "chain", "forth")
    rows = lines.join(spread, [*by, "chain"])
    order = F.struct("hop", F.when(F.col("forth"), F.col("seq")).otherwise(-F.col("seq")).alias("at"))
    rows = rows.groupBy(*by, "network", "iy", "ix").agg(F.min(order).alias("order"))  # a knot belongs to two chains, once
    return rows.select(*by, F.col("network").alias("line"), (F.row_number().over(Window.partitionBy(*by, "network").orderBy("order")) - 1).cast("long").alias("seq"), "iy", "ix")


def skeleton(cells: DataFrame, mask: str, res: float, tile: int = 400, halo_m: float = 60.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Thinned mask with `half`, the distance in metres to what is not in it. Thinning looks two cells further in each of its rounds, and takes as many rounds as an opening is wide: with a halo of 60 m tiles agree where openings are up to 30 m wide."""

    def thin(a: dict, y0: int, x0: int) -> pd.DataFrame:
        y, x = (thinned(a[mask]) & a["core"]).nonzero()
        return pd.DataFrame({"iy": y + y0, "ix": x + x0, "half": distance(~a[mask])[y, x] * res})

    return per_tile(grid.halo(cells.select(*by, "iy", "ix", mask), tile, math.ceil(halo_m / res)), "iy int, ix int, half double", thin, by)


def smooth_line(vertices: DataFrame, key: list[str], k: int) -> DataFrame:
    """vertices (key, seq, x, y) with x and y averaged over k of them, the ends repeated beyond them; lines of k or fewer stay."""
    w, all_, h = Window.partitionBy(*key).orderBy("seq"), Window.partitionBy(*key), k // 2
    n, i = F.count(F.lit(1)).over(all_), F.row_number().over(w)

    def mean(c: str) -> Column:
        first, last = F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        inside = F.sum(c).over(w.rowsBetween(-h, h))
        return F.when(n <= k, F.col(c)).otherwise((inside + F.greatest(F.lit(0), h + 1 - i) * first + F.greatest(F.lit(0), i + h - n) * last) / (2 * h + 1))

    return vertices.select(*[c for c in vertices.columns if c not in ("x", "y")], mean("x").alias("x"), mean("y").alias("y"))


def side_contrast(vertices: DataFrame, key: list[str], widths: DataFrame, cells: DataFrame, res: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, side): the share of a line's vertices that are open (under 2 m of canopy) with forest (over 5 m) on both sides, at half the width plus 5 or 8 m. Tangents are differences of the vertices before and after. Lines of under four vertices have 0. vertices: key, seq, x, y; widths: key, width; cells: by, iy, ix, chm; key begins with by."""
    w = Window.partitionBy(*key).orderBy("seq")
    diff = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    v = vertices.withColumns({"tx": diff("x"), "ty": diff("y")}).join(widths.select(*key, "width"), key)
    size = F.hypot("tx", "ty") + 1e-9
    off = F.col("width") / 2 + 5.0
    looks = [("mid", F.lit(0.0))] + [(name, sign * (off + more)) for name, sign in (("left", 1), ("right", -1)) for more in (0.0, 3.0)]
    looks = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), d.alias("d")) for name, d in looks])).alias("look")
    s = v.select(*key, "seq", (-F.col("ty") / size).alias("nx"), (F.col("tx") / size).alias("ny"), "x", "y", looks)
    at = lambda c, n: F.floor((F.col(c) + F.col("look.d") * F.col(n)) / res).cast("int")
    s = s.select(*key, "seq", F.col("look.side").alias("side"), at("x", "nx").alias("ix"), at("y", "ny").alias("iy"))
    s = s.join(cells.select(*by, "iy", "ix", "chm"), [*by, "iy", "ix"], "left")
    top = lambda name: F.max(F.when(F.col("side") == name, F.col("chm")))
    ok = s.groupBy(*key, "seq").agg(((top("mid") < 2.0) & (top("left") > 5) & (top("right") > 5)).alias("ok"))
    per = ok.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"))
    return per.select(*key, F.when(F.col("n") < 4, 0.0).otherwise(F.col("k") / F.col("n")).alias("side"))


def straightness(vertices: DataFrame, key: list[str]) -> DataFrame:
    """(key, straight, run): chord by length of each line, and its length."""
    w = Window.partitionBy(*key).orderBy("seq")
    v = vertices.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    e = v.groupBy(*key).agg(F.sum("step").alias("run"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    return e.select(*key, (F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) / F.greatest("run", F.lit(1.0))).alias("straight"), "run")


def open_ground(cells: DataFrame, res: float, by: tuple[str, ...] = ()) -> DataFrame:
    """cells (by, iy, ix, chm, dtm, ground_share) with open (canopy gaps, closed over single crowns), rough and slope of the ground and firm (its returns nearby)."""
    keys = [*by, "iy", "ix"]
    cells = cells.select(*keys, "chm", "dtm", "ground_share")
    m = grid.median3(cells.select(*keys, "chm"), "chm", by).select(*keys, (F.col("chm") < 1.5).alias("open"))
    for f, offsets in ((grid.dilate, grid.square(1)),) * 2 + ((grid.erode, grid.square(1)),) * 2 + ((grid.erode, grid.CROSS), (grid.dilate, grid.CROSS)):
        m = f(m, "open", offsets, by)
    squares = grid.stencil(cells.select(*keys, "dtm"), grid.square(1), {"m": F.avg("dtm"), "q": F.avg(F.col("dtm") * F.col("dtm"))}, by)
    rough = squares.select(*keys, F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("rough"))
    slope = grid.gradient_slope(cells, "dtm", res, by).withColumnRenamed("slope_deg", "slope")
    firm = grid.box_mean(cells.select(*keys, "ground_share"), "ground_share", 1, by).withColumnRenamed("ground_share", "firm")
    out = cells
    for part in (m, rough, slope, firm):
        out = out.join(part, keys)
    return out


def line_cells(lines: DataFrame, key: list[str]) -> DataFrame:
    """Cells of straight lines between cells (key, y0, x0, y1, x1): as many steps as the longer side, each to the nearest cell."""
    n = F.greatest(F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("x1") - F.col("x0")), F.lit(1))
    s = lines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n") + 0.5).cast("int")
    return s.select(*key, at("y0", "y1").alias("iy"), at("x0", "x1").alias("ix"), "k")


def bridged(core: DataFrame, passable: DataFrame, res: float, reach: float = 40.0, cone_deg: float = 25.0, by: tuple[str, ...] = ()) -> DataFrame:
    """A thin mask with the cells between ends that point at each other within the reach, where at least 80 % of the cells between are passable. An end points away from the cell ten steps back (or the chain's other end)."""
    keys = [*by, "iy", "ix"]
    lines = chains(core, by)
    ends = free_ends(lines, segments(lines, by), 10, by).select(*by, "chain", "seq", ((F.col("ix") + 0.5) * res).alias("x"), ((F.col("iy") + 0.5) * res).alias("y"), "iy", "ix", "ux", "uy")
    pairs = _pairs(ends, ends.select(*by, *[F.col(c).alias(f"r_{c}") for c in ends.columns if c not in by]), reach, by)
    cos = math.cos(math.radians(cone_deg))
    d = F.hypot(F.col("r_x") - F.col("x"), F.col("r_y") - F.col("y"))
    toward = ((F.col("r_x") - F.col("x")) * F.col("ux") + (F.col("r_y") - F.col("y")) * F.col("uy")) / d
    back = ((F.col("x") - F.col("r_x")) * F.col("r_ux") + (F.col("y") - F.col("r_y")) * F.col("r_uy")) / d
    pairs = pairs.filter(F.struct("iy", "ix") < F.struct("r_iy", "r_ix")).filter((d > 0) & (toward >= cos) & (back >= cos))
    ids = ["iy0", "ix0", "iy1", "ix1"]
    gaps = pairs.select(*by, F.col("iy").alias("y0"), F.col("ix").alias("x0"), F.col("r_iy").alias("y1"), F.col("r_ix").alias("x1"), F.col("iy").alias("iy0"), F.col("ix").alias("ix0"), F.col("r_iy").alias("iy1"), F.col("r_ix").alias("ix1")).distinct()
    between = line_cells(gaps, [*by, *ids]).join(passable.select(*keys, "passable"), keys, "left")
    good = between.groupBy(*by, *ids).agg(F.avg(F.when(F.col("passable"), 1.0).otherwise(0.0)).alias("share")).filter("share >= 0.8")
    return core.select(*keys).union(between.join(good, [*by, *ids], "left_semi").select(*keys)).distinct()


def free_ends(lines: DataFrame, segs: DataFrame, back: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The cells of degree 1 at chains' ends with the unit vector (ux, uy) that points out: from the cell `back` steps before it, or the chain's other end."""
    last = lines.groupBy(*by, "chain").agg(F.max("seq").alias("last"))
    v = lines.join(last, [*by, "chain"])
    ends = v.filter("degree = 1 AND (seq = 0 OR seq = last)").withColumn("ref", F.when(F.col("seq") == 0, F.least(F.lit(back), F.col("last"))).otherwise(F.greatest(F.lit(0), F.col("last") - back)))
    before = v.select(*by, "chain", F.col("seq").alias("ref"), F.col("iy").alias("by_"), F.col("ix").alias("bx_"))
    e = ends.join(before, [*by, "chain", "ref"])
    size = F.hypot(F.col("ix") - F.col("bx_"), F.col("iy") - F.col("by_"))
    return e.select(*by, "chain", "seq", "iy", "ix", ((F.col("ix") - F.col("bx_")) / size).alias("ux"), ((F.col("iy") - F.col("by_")) / size).alias("uy"))


def _pairs(a: DataFrame, b: DataFrame, reach: float, by: tuple[str, ...]) -> DataFrame:
    """Pairs of points (x, y) and (r_x, r_y) of one site within the reach, by an equi-join on squares."""
    a = a.withColumns({"by_y": bucket(F.col("y"), reach), "by_x": bucket(F.col("x"), reach)})
    for c, v in (("by_y", "r_y"), ("by_x", "r_x")):
        b = b.withColumn(c, F.explode(F.sequence(bucket(F.col(v), reach) - 1, bucket(F.col(v), reach) + 1)))
    near = F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y")) <= reach
    return a.join(b, [*by, "by_y", "by_x"]).filter(near).drop("by_y", "by_x")


def road_network(cells: DataFrame, res: float, tile: int = 400, least_m: float = 50.0, widest_m: float = 16.0, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Roads from a scan alone: open, smooth, gently sloping corridors 3 to 16 m wide that form a network of at least 50 m through forest. cells: by, iy, ix, chm, dtm, ground_share.

    Returns roads (by, chain, network, length, corridor, width, cls, side, straight, confidence, degree0, degree1) and their vertices (by, chain, seq, iy, ix, x, y)."""
    keys, key = [*by, "iy", "ix"], [*by, "chain"]
    rounds = Rounds(cells.sparkSession, "roads")
    c = rounds.keep(open_ground(cells, res, by), "ground")
    thin = rounds.keep(skeleton(c, "open", res, tile, by=by), "thin")
    core = thin.join(c, keys).filter(F.col("half").between(1.0, widest_m / 2) & (F.col("rough") < 0.25) & (F.col("slope") < 15) & (F.col("firm") > 0.3)).select(*keys)
    # short breaks, such as a crown that leans over the road, are bridged, and the result is thinned again
    wide = c.select(*keys, "open").join(core.withColumn("core", F.lit(True)), keys, "left").withColumn("core", F.coalesce("core", F.lit(False)))
    for _ in range(max(1, int(2 / res))):
        wide = _grown(wide, by)
    core = rounds.keep(skeleton(wide.withColumn("core_", F.col("core") & F.col("open")), "core_", res, tile, by=by).select(*keys), "core")
    core = rounds.keep(without_spurs(core, int(10 / res), by), "pruned")
    core = rounds.keep(bridged(core, c.select(*keys, ((F.col("rough") < 0.35) & (F.col("slope") < 18)).alias("passable")), res, by=by), "bridged")
    lines = rounds.keep(chains(core, by).join(grid.distance_to(c.withColumn("shut", ~F.col("open")).select(*keys, "shut"), "shut", res, by=by).select(*keys, F.col("distance").alias("half")), keys), "lines")
    xy = [((F.col("ix") + 0.5) * res).alias("x"), ((F.col("iy") + 0.5) * res).alias("y")]
    v = lines.select(*key, "seq", "iy", "ix", "half", *xy)
    segs = networks(segments(lines, by), by).withColumn("length", F.col("length") * res)
    segs = segs.join(v.groupBy(*key).agg((F.median("half") * 2).alias("corridor")), key)
    dangling = (F.least("degree0", "degree1") == 1) & (F.greatest("degree0", "degree1") > 2) & (F.col("length") < 15)
    segs = rounds.keep(segs.filter((F.col("length") >= 8) & ~dangling), "segments")
    halves = v.join(segs.select(*key, "network"), key).groupBy(*by, "network").agg(F.median("half").alias("mid"), F.stddev_pop("half").alias("sd"))
    nets = segs.groupBy(*by, "network").agg(F.sum("length").alias("network_m")).filter(F.col("network_m") >= least_m).join(halves, [*by, "network"])
    segs = segs.join(nets.select(*by, "network", "network_m", (F.col("mid") * 2).alias("net_width"), (F.col("sd") / F.greatest("mid", F.lit(0.5))).alias("width_cv")), [*by, "network"])
    soft, softer = smooth_line(v.select(*key, "seq", "x", "y"), key, 5), smooth_line(v.select(*key, "seq", "x", "y"), key, 9)
    side = lambda w, name: side_contrast(soft, key, segs.select(*key, F.col(w).alias("width")), c, res, by).withColumnRenamed("side", name)
    segs = segs.join(side("corridor", "side"), key).join(side("net_width", "net_side"), key).join(straightness(softer, key), key)
    segs = rounds.keep(segs, "measured")
    n_cells = F.col("cells") >= 4
    per = segs.groupBy(*by, "network").agg(F.coalesce(F.avg(F.when(n_cells, F.col("net_side"))), F.lit(0.0)).alias("forest_sides"), F.coalesce(F.avg(F.when(F.col("length") >= 25, F.col("straight"))), F.lit(0.8)).alias("course"))
    segs = segs.join(per, [*by, "network"])
    sure = 0.45 * F.col("forest_sides") + 0.25 * F.least(F.col("course") / 0.85, F.lit(1.0)) + 0.3 * (1 - F.least(F.col("width_cv") / 0.6, F.lit(1.0)))
    segs = segs.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), "width": F.greatest(F.lit(3.0), F.least(F.lit(8.0), F.col("corridor") - 5.5)), "cls": F.when((F.col("corridor") >= 11.5) & (F.col("length") >= 60), "main").otherwise("forest")})
    segs = segs.filter((F.col("confidence") >= 0.6) & (F.col("forest_sides") >= 0.35) & (F.col("side") >= 0.5) & (F.col("corridor") >= 5.5))
    roads = rounds.keep(segs.select(*key, "network", "length", "network_m", "corridor", "width", "cls", "side", "straight", "confidence", "degree0", "degree1"), "roads")
    return roads, v.join(roads.select(*key), key, "left_semi").drop("half")


def _grown(cells: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """cells (core, open) with core grown by one cell all round."""
    keys = [*by, "iy", "ix"]
    return grid.dilate(cells.select(*keys, "core"), "core", grid.square(1), by).join(cells.select(*keys, "open"), keys)


def candidate_links(ends: DataFrame, vertices: DataFrame, cells: DataFrame, res: float, gap: float = 70.0, angle_deg: float = 35.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The nearest vertex of another network that each road end points at, within the gap and the angle, and what lies between: (by, chain, end_seq, network, to_chain, to_seq, to_network, d, open_share, firm_share, steepest). ends: by, chain, seq, network, x, y, ux, uy; vertices: by, chain, seq, network, x, y; cells: by, iy, ix, chm, slope, firm. Samples lie a cell apart."""
    ends = ends.select(*by, "chain", F.col("seq").alias("end_seq"), "network", "x", "y", "ux", "uy")
    others = vertices.select(*by, F.col("chain").alias("to_chain"), F.col("seq").alias("to_seq"), F.col("network").alias("to_network"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    d = F.hypot(F.col("r_x") - F.col("x"), F.col("r_y") - F.col("y"))
    toward = ((F.col("r_x") - F.col("x")) * F.col("ux") + (F.col("r_y") - F.col("y")) * F.col("uy")) / F.greatest(d, F.lit(1e-9))
    near = _pairs(ends, others, gap, by).filter((F.col("network") != F.col("to_network")) & (d > 3) & (toward >= math.cos(math.radians(angle_deg))))
    best = near.groupBy(*by, "chain", "end_seq").agg(F.min(F.struct(d.alias("d"), "to_chain", "to_seq", "to_network", "network", "x", "y", "r_x", "r_y")).alias("m")).select(*by, "chain", "end_seq", "m.*")
    n = F.greatest(F.lit(3), F.floor(F.col("d") / res).cast("int"))
    s = best.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", F.col("k") / (F.col("n") - 1))
    at = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * F.col("t")) / res).cast("int")
    s = s.select(*by, "chain", "end_seq", at("y", "r_y").alias("iy"), at("x", "r_x").alias("ix")).join(cells.select(*by, "iy", "ix", "chm", "slope", "firm"), [*by, "iy", "ix"], "left")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    seen = s.groupBy(*by, "chain", "end_seq").agg(share(F.col("chm") < 2.0).alias("open_share"), share(F.col("firm") > 0.3).alias("firm_share"), F.max("slope").alias("steepest"))
    return best.join(seen, [*by, "chain", "end_seq"]).select(*by, "chain", "end_seq", "network", "to_chain", "to_seq", "to_network", "d", "open_share", "firm_share", "steepest")


def chosen_links(candidates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The links over open, firm, gently sloping ground that join networks with the least length: of all candidates in the order of (d, chain, end_seq), those whose two networks no shorter ones have joined. Borůvka's rounds find the same set as Kruskal's sequence: in each, every group of networks takes its first link outward."""
    rounds = Rounds(candidates.sparkSession, "links")
    fit = candidates.filter((F.col("open_share") >= 0.6) & (F.col("firm_share") >= 0.8) & (F.col("steepest") < 12))
    order = F.struct("d", *by, "chain", "end_seq")
    fit = rounds.keep(fit.withColumn("order", order), "fit")
    group = lambda c: F.struct(*by, F.col(c).alias("network"))
    links = rounds.keep(fit.select("order", group("network").alias("a"), group("to_network").alias("b")), "links")
    taken, left, k = links.select("order").limit(0), links, 0
    while not left.isEmpty():
        first = left.select(F.col("a").alias("g"), "order").union(left.select("b", "order")).groupBy("g").agg(F.min("order").alias("order"))
        taken = rounds.keep(taken.union(first.select("order").distinct()), f"taken{k % 2}")
        joined = links.join(taken, "order", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        label = graph.components(joined, nodes)
        left = links.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        left = rounds.keep(left.filter("ca <> cb").select("order", F.col("ca").alias("a"), F.col("cb").alias("b")), f"left{k % 2}")
        k += 1
    return fit.join(taken, "order", "left_semi").drop("order")
