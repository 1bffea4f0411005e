"""Queries over the sites of v_land: each table of sites holds as many as its orders ask for, and every plan keeps the site in its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.operators import assets, crowns, graph, grid, imagery, network, routes, spatial
from boreal.plans.queries import big, query, r6
from boreal.plans.rounds import Rounds
from boreal.sources.fixtures import source

SITE = ("site",)
RES = 5.0

# ---- lines of a thin mask
RING_SQL = "ring(k, dy, dx) AS (VALUES (0,-1,0),(1,-1,1),(2,0,1),(3,1,1),(4,1,0),(5,1,-1),(6,0,-1),(7,-1,-1))"
CHAINS = f"""WITH RECURSIVE {RING_SQL}, m AS MATERIALIZED (SELECT site, iy, ix FROM v_land WHERE chm < 1.5),
 e AS MATERIALIZED (SELECT a.site, a.iy, a.ix, k, b.iy AS y, b.ix AS x FROM m a CROSS JOIN ring JOIN m b ON b.site=a.site AND b.iy=a.iy+dy AND b.ix=a.ix+dx
  WHERE k%2=0 OR NOT EXISTS (SELECT 1 FROM m c WHERE c.site=a.site AND (c.iy=a.iy+dy AND c.ix=a.ix OR c.iy=a.iy AND c.ix=a.ix+dx))),
 g AS MATERIALIZED (SELECT site, iy, ix, count(*) AS degree FROM e GROUP BY 1,2,3),
 w(site, chain, seq, iy, ix, k, diag, degree) AS (
  SELECT e.site, e.iy::BIGINT*17179869184+e.ix*8+k, 0, e.iy, e.ix, k, 0, degree FROM e JOIN g ON g.site=e.site AND g.iy=e.iy AND g.ix=e.ix WHERE degree<>2
  UNION ALL
  SELECT w.site, chain, seq+1, e.y, e.x, coalesce(n.k,e.k), diag+e.k%2, g.degree FROM w JOIN e ON e.site=w.site AND e.iy=w.iy AND e.ix=w.ix AND e.k=w.k JOIN g ON g.site=e.site AND g.iy=e.y AND g.ix=e.x
   LEFT JOIN e n ON n.site=e.site AND n.iy=e.y AND n.ix=e.x AND n.k<>(e.k+4)%8 AND g.degree=2 WHERE seq=0 OR w.degree=2),
 t AS (SELECT site, chain, max(seq) AS last FROM w GROUP BY 1,2),
 twin AS (SELECT w.site, w.chain, iy::BIGINT*17179869184+ix*8+(k+4)%8 AS twin FROM w JOIN t ON t.site=w.site AND t.chain=w.chain AND seq=last),
 c AS MATERIALIZED (SELECT w.site, w.chain, seq, iy, ix, diag, degree, last FROM w JOIN t ON t.site=w.site AND t.chain=w.chain JOIN twin ON twin.site=w.site AND twin.chain=w.chain WHERE w.chain < twin),
 s AS MATERIALIZED (SELECT a.site, a.chain, a.last+1 AS cells, a.last-b.diag+b.diag*sqrt(2) AS length, a.iy AS y0, a.ix AS x0, a.degree AS degree0, b.iy AS y1, b.ix AS x1, b.degree AS degree1 FROM c a JOIN c b ON b.site=a.site AND b.chain=a.chain AND a.seq=0 AND b.seq=b.last)"""


def lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The land's cells, and the lines of its open cells."""
    land = source(spark, sf, "v_land")
    return land, network.chains(land.filter("chm < 1.5"), SITE)


@query(CHAINS + """ SELECT site::BIGINT AS site, chain, s.cells::BIGINT AS cells, round(length,6) AS length, y0::BIGINT AS y0, x0::BIGINT AS x0, y1::BIGINT AS y1, x1::BIGINT AS x1, degree0::BIGINT AS degree0, degree1::BIGINT AS degree1,
 (SELECT string_agg(iy || ':' || ix, ' ' ORDER BY seq) FROM c WHERE c.site=s.site AND c.chain=s.chain) AS path FROM s""")
def road_lines(spark, sf):
    """Ordered lines between ends and crossings, by pointer jumping."""
    _, c = lines(spark, sf)
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "iy", "ix").alias("at")))), lambda p: p["at"]), " ")
    s = network.segments(c, SITE).join(c.groupBy("site", "chain").agg(path.alias("path")), ["site", "chain"])
    return s.select(big("site").alias("site"), "chain", "cells", r6("length").alias("length"), *[big(f"{n}{k}").alias(f"{n}{k}") for k in (0, 1) for n in ("y", "x", "degree")], "path")


@query(CHAINS + """, v AS (SELECT site, chain, seq, last, (ix+0.5)*5 AS x, (iy+0.5)*5 AS y FROM c),
 d AS (SELECT *, coalesce(lead(x) OVER o, x)-coalesce(lag(x) OVER o, x) AS tx, coalesce(lead(y) OVER o, y)-coalesce(lag(y) OVER o, y) AS ty FROM v WINDOW o AS (PARTITION BY site, chain ORDER BY seq)),
 p AS (SELECT *, -ty/(sqrt(tx*tx+ty*ty)+1e-9) AS nx, tx/(sqrt(tx*tx+ty*ty)+1e-9) AS ny FROM d),
 l AS (SELECT p.site, chain, seq, last, o, land.chm FROM p CROSS JOIN (VALUES (0e0),(7.5e0),(10.5e0),(-7.5e0),(-10.5e0)) AS offs(o) LEFT JOIN v_land land ON land.site=p.site AND land.ix=CAST(floor((x+nx*o)/5) AS INT) AND land.iy=CAST(floor((y+ny*o)/5) AS INT)),
 k AS (SELECT site, chain, seq, last, coalesce(max(CASE WHEN o=0 THEN chm END)<2 AND max(CASE WHEN o>0 THEN chm END)>5 AND max(CASE WHEN o<0 THEN chm END)>5, false) AS ok FROM l GROUP BY 1,2,3,4)
 SELECT site::BIGINT AS site, chain, round(CASE WHEN any_value(last)<3 THEN 0 ELSE avg(ok::INT) END,6) AS side FROM k GROUP BY site, chain""")
def road_sides(spark, sf):
    """Forest on both sides, at offsets along the normals of each line."""
    land, c = lines(spark, sf)
    v = c.select("site", "chain", "seq", ((F.col("ix") + 0.5) * RES).alias("x"), ((F.col("iy") + 0.5) * RES).alias("y"))
    wide = c.select("site", "chain", F.lit(5.0).alias("width")).distinct()
    return network.side_contrast(v, ["site", "chain"], wide, land, RES, SITE).select(big("site").alias("site"), "chain", r6("side").alias("side"))


NETS = CHAINS + """, j AS MATERIALIZED (SELECT site, y0*1000+x0 AS a, y1*1000+x1 AS b FROM s UNION SELECT site, y1*1000+x1, y0*1000+x0 FROM s),
 reach(site, a, b) AS (SELECT DISTINCT site, a, a FROM j UNION SELECT reach.site, reach.a, j.b FROM reach JOIN j ON j.site=reach.site AND j.a=reach.b),
 net AS MATERIALIZED (SELECT site, a AS knot, min(b) AS network FROM reach GROUP BY 1,2),
 cn AS MATERIALIZED (SELECT c.*, network, (ix+0.5)*5 AS x, (iy+0.5)*5 AS y FROM c JOIN s ON s.site=c.site AND s.chain=c.chain JOIN net ON net.site=c.site AND knot=y0*1000+x0),
 g1 AS (SELECT a.site, a.iy, a.ix, a.chm, a.ground_share, a.dtm AS z, e.dtm AS e, w.dtm AS w, u.dtm AS u, d.dtm AS d FROM v_land a LEFT JOIN v_land e ON e.site=a.site AND e.iy=a.iy AND e.ix=a.ix+1 LEFT JOIN v_land w ON w.site=a.site AND w.iy=a.iy AND w.ix=a.ix-1
  LEFT JOIN v_land u ON u.site=a.site AND u.ix=a.ix AND u.iy=a.iy+1 LEFT JOIN v_land d ON d.site=a.site AND d.ix=a.ix AND d.iy=a.iy-1),
 land AS MATERIALIZED (SELECT site, iy, ix, chm, ground_share AS firm, degrees(atan(sqrt(pow(CASE WHEN e IS NULL AND w IS NULL THEN 0 ELSE (coalesce(e,z)-coalesce(w,z))/(5*((e IS NOT NULL)::INT+(w IS NOT NULL)::INT)) END,2)
  +pow(CASE WHEN u IS NULL AND d IS NULL THEN 0 ELSE (coalesce(u,z)-coalesce(d,z))/(5*((u IS NOT NULL)::INT+(d IS NOT NULL)::INT)) END,2)))) AS slope FROM g1),
 f AS (SELECT a.*, (a.ix-b.ix)/sqrt(pow(a.ix-b.ix,2)+pow(a.iy-b.iy,2)) AS ux, (a.iy-b.iy)/sqrt(pow(a.ix-b.ix,2)+pow(a.iy-b.iy,2)) AS uy FROM cn a JOIN cn b ON b.site=a.site AND b.chain=a.chain AND b.seq=CASE WHEN a.seq=0 THEN least(4,a.last) ELSE greatest(0,a.last-4) END
  WHERE a.degree=1 AND (a.seq=0 OR a.seq=a.last)),
 n1 AS (SELECT f.site, f.chain, f.seq AS end_seq, f.network, o.chain AS to_chain, o.seq AS to_seq, o.network AS to_network, f.x, f.y, o.x AS rx, o.y AS ry, sqrt(pow(o.x-f.x,2)+pow(o.y-f.y,2)) AS d, ux, uy FROM f JOIN cn o ON o.site=f.site AND o.network<>f.network),
 n2 AS (SELECT *, row_number() OVER (PARTITION BY site, chain, end_seq ORDER BY d, to_chain, to_seq) AS r FROM n1 WHERE d>3 AND d<=70 AND ((rx-x)*ux+(ry-y)*uy)/d >= cos(radians(35))),
 n3 AS MATERIALIZED (SELECT *, greatest(3, CAST(floor(d/5) AS INT)) AS n FROM n2 WHERE r=1),
 n4 AS (SELECT n3.site, chain, end_seq, CAST(floor((x+(rx-x)*k/(n-1))/5) AS INT) AS ix, CAST(floor((y+(ry-y)*k/(n-1))/5) AS INT) AS iy FROM (SELECT *, unnest(range(n)) AS k FROM n3) n3),
 n5 AS (SELECT n4.site, chain, end_seq, avg(coalesce(chm<2,false)::INT) AS open_share, avg(coalesce(firm>0.3,false)::INT) AS firm_share, max(slope) AS steepest FROM n4 LEFT JOIN land ON land.site=n4.site AND land.iy=n4.iy AND land.ix=n4.ix GROUP BY 1,2,3),
 cand AS MATERIALIZED (SELECT n3.site, n3.chain, n3.end_seq, network, to_chain, to_seq, to_network, d, open_share, firm_share, steepest, row_number() OVER (PARTITION BY n3.site ORDER BY d, n3.chain, n3.end_seq) AS r, open_share>=0.6 AND firm_share>=0.8 AND steepest<12 AS fit
  FROM n3 JOIN n5 ON n5.site=n3.site AND n5.chain=n3.chain AND n5.end_seq=n3.end_seq),
 span(site, r, network) AS (SELECT site, r, network FROM cand WHERE fit UNION SELECT span.site, span.r, CASE WHEN o.network=span.network THEN o.to_network ELSE o.network END FROM span JOIN cand o ON o.site=span.site AND o.fit AND o.r<span.r AND (o.network=span.network OR o.to_network=span.network))"""


@query(NETS + """ SELECT site::BIGINT AS site, chain, end_seq::BIGINT AS end_seq, to_chain, to_seq::BIGINT AS to_seq, round(d,6) AS d, round(open_share,6) AS open_share, round(firm_share,6) AS firm_share, round(steepest,6) AS steepest,
 fit AND NOT EXISTS (SELECT 1 FROM span WHERE span.site=cand.site AND span.r=cand.r AND span.network=cand.to_network) AS chosen FROM cand""")
def road_links(spark, sf):
    """From each free end to the nearest vertex of another network in a cone, what lies between, and the least set that joins networks."""
    land, c = lines(spark, sf)
    segs = network.networks(network.segments(c, SITE), SITE).select("site", "chain", "network")
    c = c.join(segs, ["site", "chain"]).withColumns({"x": (F.col("ix") + 0.5) * RES, "y": (F.col("iy") + 0.5) * RES})
    ends = network.free_ends(c, segs, 4, SITE).join(c.select("site", "chain", "seq", "network", "x", "y"), ["site", "chain", "seq"])
    ground = land.select("site", "iy", "ix", "chm", F.col("ground_share").alias("firm")).join(grid.gradient_slope(land, "dtm", RES, SITE).withColumnRenamed("slope_deg", "slope"), ["site", "iy", "ix"])
    found = network.candidate_links(ends, c, ground, RES, by=SITE)
    taken = network.chosen_links(found, SITE).select("site", "chain", "end_seq", F.lit(True).alias("chosen"))
    out = found.join(taken, ["site", "chain", "end_seq"], "left")
    return out.select(big("site").alias("site"), "chain", big("end_seq").alias("end_seq"), "to_chain", big("to_seq").alias("to_seq"), *[r6(x).alias(x) for x in ("d", "open_share", "firm_share", "steepest")], F.coalesce("chosen", F.lit(False)).alias("chosen"))


# ---- driving and walking over the sites: one number for a cell of a site
TRAVEL_SQL = """WITH RECURSIVE c AS MATERIALIZED (SELECT site, site*10000+iy*100+ix AS id, iy, ix, chm < 1.5 AS road, CASE WHEN chm < 1.5 THEN 30e0 ELSE 0e0 END AS vd, CASE WHEN chm < 2 THEN 5e0 WHEN chm < 15 THEN 4e0 ELSE 2.5e0 END AS vf, chm < 1.5 AND n % 7 = 0 AS blocked FROM v_land),
 p AS MATERIALIZED (SELECT a.site, a.id AS s, b.id AS d, CASE WHEN a.iy=b.iy OR a.ix=b.ix THEN 5e0 ELSE sqrt(2e0)*5e0 END AS len, a.vd AS ad, b.vd AS bd, a.vf AS af, b.vf AS bf, b.blocked AND NOT a.blocked AS entering FROM c a JOIN c b ON a.site=b.site AND abs(a.iy-b.iy)<=1 AND abs(a.ix-b.ix)<=1 AND a.id<>b.id),
 drive AS (SELECT s, d, 0.5*len*(1/ad+1/bd)*0.06+CASE WHEN entering THEN 15e0 ELSE 0e0 END AS w FROM p WHERE ad>0 AND bd>0), foot AS (SELECT s, d, 0.5*len*(1/af+1/bf)*0.06+0e0 AS w FROM p),
 e AS MATERIALIZED (SELECT 0 AS l, s, 0 AS m, d, w FROM foot UNION ALL SELECT 1, s, 1, d, w FROM drive UNION ALL SELECT 2, s, 2, d, w FROM foot UNION ALL SELECT 0, id, 1, id, {change} FROM c WHERE road UNION ALL SELECT 1, id, 2, id, {change} FROM c WHERE road),"""


def travel_layers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cells, edges of a vehicle that keeps to roads, edges of walkers, and the road cells. A fallen tree is cleared in a quarter of an hour."""
    c = source(spark, sf, "v_land").select("site", "iy", "ix", (F.col("site") * 10000 + F.col("iy") * 100 + F.col("ix")).cast("long").alias("cell"), (F.col("chm") < 1.5).alias("road"), "chm", ((F.col("chm") < 1.5) & (F.col("n") % 7 == 0)).alias("blocked"))
    c = Rounds(spark, "land").keep(c, "cells")  # every layer reads the cells
    by_cell = lambda e: e.select("site", (F.col("site") * 10000 + F.floor(F.col("src") / 100) * 100 + F.col("src") % 100).cast("long").alias("src"), (F.col("site") * 10000 + F.floor(F.col("dst") / 100) * 100 + F.col("dst") % 100).cast("long").alias("dst"), "w")
    drive = graph.grid_edges(c.withColumn("v", F.when(F.col("road"), 30.0).otherwise(0.0)), 100, RES, 15.0, SITE)
    foot = graph.grid_edges(c.withColumns({"v": F.when(F.col("chm") < 2, 5.0).when(F.col("chm") < 15, 4.0).otherwise(2.5), "blocked": F.lit(False)}), 100, RES, 0.0, SITE)
    return c, by_cell(drive), by_cell(foot), c.filter("road").select("site", "cell")


@query(TRAVEL_SQL.format(change="1e-6") + """ r(k, site, l, id, dist) AS (SELECT 0, site, 1, id, 0e0 FROM (SELECT site, min(id) AS id FROM c WHERE road GROUP BY site) q
  UNION ALL (SELECT k+1, site, m, d, min(dist+w) FROM r JOIN e ON e.l=r.l AND e.s=r.id WHERE k<110 GROUP BY k+1, site, m, d))
 SELECT site::BIGINT AS site, id::BIGINT AS cell, round(min(dist),6) AS minutes FROM r WHERE l=2 GROUP BY site, id""")
def response_minutes(spark, sf):
    """Driven from each site's entry point, walked from any road cell."""
    c, drive, foot, stops = travel_layers(spark, sf)
    depots = c.filter("road").groupBy("site").agg(F.min("cell").alias("cell")).withColumn("minutes", F.lit(0.0))
    out = routes.response(drive, foot, stops, depots, site="site")
    return out.select(big("site").alias("site"), "cell", r6("minutes").alias("minutes"))


@query(TRAVEL_SQL.format(change="2e0") + """ q AS MATERIALIZED (SELECT site AS route, min(id) FILTER (chm>15 AND iy>24) AS a, max(id) FILTER (chm>15 AND iy<6) AS b FROM (SELECT c.*, chm FROM c JOIN v_land v ON v.site=c.site AND v.iy=c.iy AND v.ix=c.ix) x GROUP BY site),
 r(k, route, l, id, dist) AS (SELECT 0, route, 0, a, 0e0 FROM q UNION ALL (SELECT k+1, route, m, d, min(dist+w) FROM r JOIN e ON e.l=r.l AND e.s=r.id WHERE k<130 GROUP BY k+1, route, m, d)),
 best AS MATERIALIZED (SELECT route, l, id, min(dist) AS dist FROM r GROUP BY 1,2,3),
 way(route, l, id, dist) AS (SELECT best.route, l, id, dist FROM best JOIN q ON q.route=best.route AND l=2 AND id=b
  UNION ALL SELECT route, l, id, dist FROM (SELECT way.route, o.l, o.id, o.dist, row_number() OVER (PARTITION BY way.route ORDER BY o.l, o.id) AS k FROM way JOIN e ON e.m=way.l AND e.d=way.id JOIN best o ON o.route=way.route AND o.l=e.l AND o.id=e.s AND o.dist+e.w=way.dist WHERE way.dist>0) z WHERE k=1),
 v AS (SELECT way.*, road, blocked, dist-coalesce(lag(dist) OVER o,0) AS took, lag(blocked) OVER o AS was, lag(l) OVER o AS was_l FROM way JOIN c ON c.id=way.id WINDOW o AS (PARTITION BY route ORDER BY dist, l))
 SELECT route::BIGINT AS route, round(max(dist),6) AS minutes, round(sum(CASE WHEN l=1 AND coalesce(was_l,1)=1 THEN took ELSE 0 END),6) AS drive_minutes, count(*) FILTER (l=1) AS drive_cells, count(*) FILTER (l<>1) AS walk_cells,
  round(avg(road::INT) FILTER (l=1),6) AS road_share, count(*) FILTER (l=1 AND was_l=1 AND blocked AND NOT was) AS clearings FROM v GROUP BY route""")
def walk_drive_walk(spark, sf):
    """One way a site from forest to forest, with two minutes to change; predecessors and pointer doubling."""
    c, drive, foot, stops = travel_layers(spark, sf)
    tall = F.col("chm") > 15
    asked = c.groupBy(F.col("site").alias("route")).agg(F.min(F.when(tall & (F.col("iy") > 24), F.col("cell"))).alias("start"), F.max(F.when(tall & (F.col("iy") < 6), F.col("cell"))).alias("end")).withColumns({"site": F.col("route"), "start_on_road": F.lit(False), "end_on_road": F.lit(False)})
    out, _ = routes.routes(drive, foot, stops, asked, c, 2.0, "site")
    return out.select(big("route").alias("route"), r6("minutes").alias("minutes"), r6("drive_minutes").alias("drive_minutes"), "drive_cells", "walk_cells", r6("road_share").alias("road_share"), "clearings")


# ---- assets: the lines of the land as roads, and as conductors
DENSE = CHAINS + """, v AS (SELECT site, chain, seq, (ix+0.5)*5 AS x, (iy+0.5)*5 AS y, (seq-diag)*5+diag*sqrt(50) AS m_at FROM c),
 ed AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(m_at) OVER o AS pat FROM v WINDOW o AS (PARTITION BY site, chain ORDER BY seq)),
 dp AS (SELECT site, chain, coalesce(pat+(m_at-pat)*k/n, m_at) AS m_at, coalesce(px+(x-px)*(k/n::DOUBLE), x) AS x, coalesce(py+(y-py)*(k/n::DOUBLE), y) AS y FROM (SELECT *, unnest(CASE WHEN px IS NULL THEN [1] ELSE range(1, n+1) END) AS k FROM (SELECT *, greatest(1, CAST(ceil(coalesce(m_at-pat,0)-1e-9) AS INT)) AS n FROM ed) a) b),
 dn AS (SELECT *, greatest(1, CAST(round(max(m_at) OVER (PARTITION BY site, chain)/{length}) AS INT)) AS n, max(m_at) OVER (PARTITION BY site, chain) AS whole FROM dp),
 pc AS (SELECT DISTINCT site, chain, j AS piece, CAST(floor(y) AS INT) AS cy, CAST(floor(x) AS INT) AS cx FROM (SELECT *, unnest(range(n)) AS j FROM dn) q WHERE m_at >= j*whole/n-1e-6 AND m_at <= (j+1)*whole/n+1e-6),
 bn AS MATERIALIZED (SELECT site, cy+dy AS iy, cx+dx AS ix, min({{'chain': chain, 'piece': piece}}) AS m FROM pc CROSS JOIN (SELECT a-5 AS dy FROM range(11) r(a)) p CROSS JOIN (SELECT a-5 AS dx FROM range(11) r(a)) q WHERE dy*dy+dx*dx <= {half}*{half} GROUP BY 1,2,3)"""


def dense_lines(spark: SparkSession, sf: str, length: float) -> tuple[DataFrame, DataFrame]:
    land, c = lines(spark, sf)
    v = c.select("site", "chain", "seq", ((F.col("ix") + 0.5) * RES).alias("x"), ((F.col("iy") + 0.5) * RES).alias("y"))
    return land, assets.line_pieces(assets.dense_line(v, ["site", "chain"]), ["site", "chain"], length)


@query(DENSE.format(length=25.0, half=3.0) + " SELECT site::BIGINT AS site, iy::BIGINT AS iy, ix::BIGINT AS ix, m.chain AS chain, m.piece::BIGINT AS piece FROM bn")
def road_cells(spark, sf):
    """Roads of 5 m burnt into cells of 1 m, in pieces of 25 m; the first piece has the cell."""
    _, pieces = dense_lines(spark, sf, assets.ROAD_PIECE_M)
    out = assets.burnt(pieces, ["site", "chain"], 3.0, SITE)
    return out.select(big("site").alias("site"), big("iy").alias("iy"), big("ix").alias("ix"), "chain", big("piece").alias("piece"))


@query(DENSE.format(length=60.0, half=1.8) + """, tr AS (SELECT site, iy*100+ix AS tree_id, (ix+0.5)*5 AS x, (iy+0.5)*5 AS y, chm AS h FROM v_land WHERE chm > 12),
 ry AS (SELECT site, tree_id, d, s, CAST(floor(round(x+s*cos(radians(d*30)),9)) AS INT) AS ix, CAST(floor(round(y+s*sin(radians(d*30)),9)) AS INT) AS iy FROM tr CROSS JOIN (SELECT unnest(range(12)) AS d) p CROSS JOIN (SELECT unnest(range(1,40)) AS s) q WHERE s <= sqrt(greatest(h*h-81,0))),
 hi AS (SELECT ry.site, tree_id, d, min({'s': s, 'm': m}) AS k FROM ry JOIN bn ON bn.site=ry.site AND bn.iy=ry.iy AND bn.ix=ry.ix GROUP BY 1,2,3)
 SELECT site::BIGINT AS site, tree_id::BIGINT AS tree_id, d::BIGINT AS direction, k.s::BIGINT AS step, k.m.chain AS line, k.m.piece::BIGINT AS piece FROM hi""")
def conductor_strikes(spark, sf):
    """What the tall trees of each site reach of a conductor at 9 m along its lines, in spans of 60 m."""
    land, pieces = dense_lines(spark, sf, assets.SPAN_M)
    raster = assets.burnt(pieces, ["site", "chain"], assets.SPAN_HALF_M, SITE).withColumnRenamed("chain", "line").withColumn("kind", F.lit("power"))
    tall = land.filter("chm > 12").select("site", (F.col("iy") * 100 + F.col("ix")).cast("long").alias("tree_id"), ((F.col("ix") + 0.5) * RES).alias("x"), ((F.col("iy") + 0.5) * RES).alias("y"), F.col("chm").alias("h"))
    out = assets.strikes(tall, raster, 9.0, 12, SITE)
    return out.select(big("site").alias("site"), "tree_id", big("direction").alias("direction"), big("step").alias("step"), "line", big("piece").alias("piece"))


@query("""WITH h AS MATERIALIZED (SELECT site, iy, ix, dtm FROM v_land WHERE ground_share >= 0.45), q AS (SELECT a.site, a.iy, a.ix, arg_min(h.dtm, CAST(pow(a.iy-h.iy,2)+pow(a.ix-h.ix,2) AS BIGINT)*100000000+h.iy*10000+h.ix) AS dtm FROM v_land a JOIN h ON h.site=a.site GROUP BY 1,2,3)
 SELECT site::BIGINT AS site, iy::BIGINT AS iy, ix::BIGINT AS ix, round(dtm,6) AS dtm FROM q""")
def ground_fill(spark, sf):
    """Ground heights of cells with too few ground returns from the nearest cell that has enough, at any distance."""
    land = source(spark, sf, "v_land").select("site", "iy", "ix", F.when(F.col("ground_share") >= 0.45, F.col("dtm")).alias("dtm"))
    return grid.nearest_fill(land, "dtm", SITE).select(big("site").alias("site"), big("iy").alias("iy"), big("ix").alias("ix"), r6("dtm").alias("dtm"))


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT tree_id, x, y, row_number() OVER (ORDER BY h DESC, tree_id) AS k FROM v_trees),
 f(k, xs, ys, ids) AS (SELECT 0::BIGINT, []::DOUBLE[], []::DOUBLE[], []::BIGINT[] UNION ALL
  SELECT f.k+1, CASE WHEN ok THEN list_append(xs, x) ELSE xs END, CASE WHEN ok THEN list_append(ys, y) ELSE ys END, CASE WHEN ok THEN list_append(ids, tree_id) ELSE ids END
  FROM (SELECT f.*, o.tree_id, o.x, o.y, len(list_filter(list_zip(xs, ys), lambda p: pow(p[1]-o.x,2)+pow(p[2]-o.y,2) <= 36)) = 0 AS ok FROM f JOIN o ON o.k = f.k+1) f)
 SELECT unnest(ids) AS tree_id FROM f WHERE k = (SELECT max(k) FROM o)""")
def trees_apart(spark, sf):
    """Trees by height, none within 6 m of a taller one that stays; decided in rounds, equal to the walk one by one."""
    return spatial.apart(source(spark, sf, "v_trees"), "tree_id", [-F.col("h"), F.col("tree_id")], 6.0).select("tree_id")


@query("""WITH p AS (SELECT site, (ix+0.5)*5 AS x, (iy+0.5)*5 AS y FROM v_land WHERE chm < 1.5),
 v AS MATERIALIZED (SELECT site, k, CAST(floor(round((x*cos(k*(pi()/36))+y*sin(k*(pi()/36)))/5,9)) AS BIGINT) AS bin, count(*) AS votes FROM p CROSS JOIN (SELECT unnest(range(36)) AS k) a GROUP BY 1,2,3 HAVING count(*) >= 8),
 d AS (SELECT a AS da, b AS db FROM (SELECT unnest(range(-2,3)) AS a) a CROSS JOIN (SELECT unnest(range(-2,3)) AS b) b),
 n AS (SELECT site, (k+da+36)%36 AS k, CASE WHEN k+da<0 OR k+da>=36 THEN -bin-1+db ELSE bin+db END AS bin, votes, k AS ok, bin AS ob FROM v CROSS JOIN d)
 SELECT site::BIGINT AS site, k::BIGINT AS k, bin, votes FROM v WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.site=v.site AND n.k=v.k AND n.bin=v.bin AND (n.votes>v.votes OR n.votes=v.votes AND (n.ok<v.k OR n.ok=v.k AND n.ob<v.bin)))""")
def straight_lines(spark, sf):
    """Hough votes of open cells, without what lies beside a stronger line."""
    p = source(spark, sf, "v_land").filter("chm < 1.5").select("site", ((F.col("ix") + 0.5) * RES).alias("x"), ((F.col("iy") + 0.5) * RES).alias("y"))
    out = imagery.hough_peaks(imagery.hough_votes(p, 36, RES, SITE), 8, 36, 2, 2, SITE)
    return out.select(big("site").alias("site"), big("k").alias("k"), "bin", "votes")


CROWNS = """WITH t AS MATERIALIZED (SELECT site, iy*100+ix AS tree_id, chm AS h, 5e0+(n%7)*3 AS crown_area FROM v_land WHERE chm > 12),
 p AS (SELECT t.site, t.tree_id, hag/greatest(h,1) AS rel, red, green, nir, intensity FROM v_returns r JOIN t ON t.site=r.site AND t.tree_id=r.iy*100+r.ix WHERE hag>1 AND cls NOT IN (2,6,9,14)),
 a AS (SELECT site, tree_id, count(*) AS pts, avg((rel<0.6)::INT) AS low_frac, avg(rel) AS rel_mean, sum(CASE WHEN rel>0.5 THEN red ELSE 0 END)/greatest(sum((rel>0.5)::INT),1)::DOUBLE AS r, sum(CASE WHEN rel>0.5 THEN green ELSE 0 END)/greatest(sum((rel>0.5)::INT),1)::DOUBLE AS g,
  sum(CASE WHEN rel>0.5 THEN nir ELSE 0 END)/greatest(sum((rel>0.5)::INT),1)::DOUBLE AS n, sum(CASE WHEN rel>0.5 THEN intensity ELSE 0 END)/greatest(sum((rel>0.5)::INT),1)::DOUBLE AS it FROM p GROUP BY 1,2),
 se AS (SELECT site, max(nir)>0 AS ms, coalesce(var_pop(intensity),0)>1e-9 AS has_i FROM p GROUP BY 1),
 f AS MATERIALIZED (SELECT t.site, t.tree_id, coalesce(pts,0) AS pts, coalesce(pts,0)/greatest(crown_area,1) AS dens, coalesce(low_frac,0) AS low_frac, coalesce(rel_mean,0) AS rel_mean, sqrt(crown_area/pi())/greatest(h,1) AS cr, coalesce((n-r)/greatest(n+r,1),0) AS ndvi, coalesce(g/greatest(r,1),0) AS gr, coalesce(n/256,0) AS nir, coalesce(it,0) AS it, coalesce(ms,false) AS ms, coalesce(has_i,false) AS has_i
  FROM t LEFT JOIN a ON a.site=t.site AND a.tree_id=t.tree_id LEFT JOIN se ON se.site=t.site)"""


def crown_table(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the tall cells of each site, taken as crowns."""
    tree = (F.col("iy") * 100 + F.col("ix")).cast("long").alias("tree_id")
    t = source(spark, sf, "v_land").filter("chm > 12").select("site", tree, F.col("chm").alias("h"), (5.0 + (F.col("n") % 7) * 3).alias("crown_area"))
    return crowns.crown_features(source(spark, sf, "v_returns").select("site", tree, "hag", "cls", "red", "green", "nir", "intensity"), t)


@query(CROWNS + """, s AS MATERIALIZED (SELECT *, CASE WHEN cr<0.11 AND low_frac>0.35 THEN 1 WHEN ms AND gr>1.45 THEN 2 ELSE 0 END AS species FROM f),
 u AS (SELECT site, median(dens) FILTER (dens>0) AS usual FROM s GROUP BY 1), m AS (SELECT site, species, median(it) FILTER (it>0) AS med, count(*) FILTER (it>0) AS k FROM s GROUP BY 1,2),
 d AS (SELECT s.site, s.species, median(abs(it-med)) FILTER (it>0) AS mad FROM s JOIN m ON m.site=s.site AND m.species=s.species GROUP BY 1,2),
 z AS (SELECT s.*, usual, CASE WHEN k>=20 AND it>0 THEN (it-med)/(1.4826*mad+1e-6) ELSE 0 END AS z FROM s JOIN u ON u.site=s.site JOIN m ON m.site=s.site AND m.species=s.species JOIN d ON d.site=s.site AND d.species=s.species)
 SELECT site::BIGINT AS site, tree_id::BIGINT AS tree_id, pts, round(dens,6) AS pt_density, round(low_frac,6) AS low_frac, round(rel_mean,6) AS rel_mean, round(cr,6) AS crown_ratio, round(ndvi,6) AS ndvi, round(gr,6) AS gr_ratio, species::BIGINT AS species,
  CASE WHEN ms THEN CASE WHEN ndvi<CASE WHEN species=2 THEN 0.20 ELSE 0.15 END THEN 2 WHEN ndvi<CASE WHEN species=2 THEN 0.45 ELSE 0.40 END THEN 1 ELSE 0 END WHEN has_i THEN CASE WHEN z < -3.2 OR dens<0.45*usual AND z < -2 THEN 2 WHEN z < -2 THEN 1 ELSE 0 END WHEN dens<0.45*usual THEN 2 ELSE 0 END::BIGINT AS health,
  CASE WHEN ms THEN 'ndvi' WHEN has_i THEN 'intensity and density' ELSE 'density' END AS health_source FROM z""")
def crown_health(spark, sf):
    """Features, species by rules and health by what each site's sensor has."""
    out = crowns.classified(crown_table(spark, sf))
    return out.select(big("site").alias("site"), "tree_id", "pts", *[r6(c).alias(c) for c in ("pt_density", "low_frac", "rel_mean", "crown_ratio", "ndvi", "gr_ratio")], big("species").alias("species"), big("health").alias("health"), "health_source")


@query(CROWNS + """, kn AS (SELECT *, tree_id % 3 AS sp FROM f WHERE tree_id % 4 = 1 AND site % 3 <> 2), l AS (SELECT site, tree_id, ms, unnest([{'feature':'crown_ratio','v':cr},{'feature':'low_frac','v':low_frac},{'feature':'rel_mean','v':rel_mean},{'feature':'gr_ratio','v':gr},{'feature':'nir_share','v':nir}]) AS q FROM f),
 e AS MATERIALIZED (SELECT site, tree_id, q.feature AS feature, q.v AS v FROM l WHERE ms OR q.feature NOT IN ('gr_ratio','nir_share')),
 mm AS (SELECT site, count(*) AS members FROM kn GROUP BY 1 HAVING count(*)>=15),
 mo AS MATERIALIZED (SELECT e.site, sp, feature, avg(v) AS mu, var_pop(v)+1e-3 AS var, count(*)/any_value(members)::DOUBLE AS prior FROM e JOIN kn ON kn.site=e.site AND kn.tree_id=e.tree_id JOIN mm ON mm.site=e.site GROUP BY 1,2,3 HAVING count(*)>=2),
 sc AS (SELECT e.site, tree_id, sp, sum(-0.5*(pow(v-mu,2)/var+ln(2*pi()*var)))+ln(any_value(prior)) AS s FROM e JOIN mo ON mo.site=e.site AND mo.feature=e.feature GROUP BY 1,2,3),
 pr AS (SELECT site, tree_id, sp, exp(s-max(s) OVER w)/sum(exp(s-m)) OVER w AS conf, row_number() OVER (PARTITION BY site, tree_id ORDER BY s DESC, sp) AS k FROM (SELECT *, max(s) OVER (PARTITION BY site, tree_id) AS m FROM sc) q WINDOW w AS (PARTITION BY site, tree_id)),
 ru AS (SELECT site, tree_id, CASE WHEN cr<0.11 AND low_frac>0.35 THEN 1 WHEN ms AND gr>1.45 THEN 2 ELSE 0 END AS sp FROM f WHERE site NOT IN (SELECT site FROM mo))
 SELECT site::BIGINT AS site, tree_id::BIGINT AS tree_id, sp::BIGINT AS species, round(conf,6) AS species_conf, 'calibrated' AS species_source FROM pr WHERE k=1 UNION ALL SELECT site::BIGINT, tree_id::BIGINT, sp::BIGINT, 1.0::DOUBLE, 'rules' FROM ru""")
def crown_species(spark, sf):
    """Sites with enough known trees have a model of their own, the others the rules, in one plan."""
    f = crown_table(spark, sf)
    known = f.filter((F.col("tree_id") % 4 == 1) & (F.col("site") % 3 != 2)).select("site", "tree_id", (F.col("tree_id") % 3).alias("species"))
    out = crowns.classified(f, known)
    return out.select(big("site").alias("site"), "tree_id", big("species").alias("species"), r6("species_conf").alias("species_conf"), "species_source")
