"""Registered queries over the forest operators, each with DuckDB SQL that computes the same independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.functions import fire_weather as fw
from boreal.functions import forest as fo
from boreal.functions import geo
from boreal.operators import costs, discover, fire, fleet, graph, grid, montecarlo, plan, sequence, site, spatial, text, trees, weather
from boreal.sources import sinks
from boreal.sources.fixtures import source, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- flagship: which trees should be felled first near these assets
FAIL = "1/(1+exp(-(-10.5+0.30*({g}-12)+0.022*(greatest(30,least(160,hd))-70)+CASE species WHEN 1 THEN 1.0 WHEN 2 THEN -0.3 ELSE 0.0 END+1.2*edge+0.5*emergent+0.8*peat+CASE health WHEN 2 THEN 1.8 WHEN 1 THEN 0.7 ELSE 0.0 END+0.03*(h-15)+{soil})))"
DBH = "(CASE species WHEN 0 THEN 1.07e0 WHEN 1 THEN 1.20e0 ELSE 0.69e0 END)*sqrt(greatest(h-1.3e0,0.01e0))/greatest(1-(CASE species WHEN 0 THEN 0.185e0 WHEN 1 THEN 0.177e0 ELSE 0.197e0 END)*sqrt(greatest(h-1.3e0,0.01e0)),0.05e0)"
SEG_D = "sqrt(pow(x-(ax+t*(bx-ax)),2)+pow(y-(ay+t*(by_-ay)),2))"
SEG_T = "greatest(0e0,least(1e0,((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/greatest((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay),1e-9)))"


def with_failure(t: DataFrame, gust: float = 25.0, wet: float = 0.9) -> DataFrame:
    t = t.withColumn("dbh", fo.dbh_cm(F.col("h"), F.col("species"))).withColumn("hd", fo.slenderness(F.col("h"), F.col("dbh")))
    return t.withColumn("p_fail", fo.failure_probability(F.lit(gust), *map(F.col, ("h", "hd", "species", "edge", "emergent", "peat", "health")), wet, False))


@query(f"""WITH t AS (SELECT *, {DBH} AS dbh FROM v_trees), f AS (SELECT *, h/greatest(dbh/100,0.02) AS hd FROM t),
 p AS (SELECT *, {FAIL.format(g=25, soil="0.6*0.9")} AS p_fail FROM f),
 s AS (SELECT tree_id, seg_id, {SEG_D} AS d FROM (SELECT *, {SEG_T} AS t FROM p CROSS JOIN v_segments) q WHERE {SEG_D} <= 18),
 n AS (SELECT tree_id, arg_min(seg_id, d*1000000+seg_id) AS seg_id, min(d) AS d FROM s GROUP BY tree_id)
 SELECT CAST(row_number() OVER (ORDER BY round(p_fail*(1-d/28),9) DESC, tree_id) AS BIGINT) AS rank, tree_id, CAST(seg_id AS BIGINT) AS seg_id, round(d,6) AS distance, round(p_fail,6) AS p_fail, round(p_fail*(1-d/28),6) AS risk
 FROM p JOIN n USING (tree_id) WHERE d <= h ORDER BY round(p_fail*(1-d/28),9) DESC, tree_id LIMIT 100""")
def felling_order(spark, sf):
    """Failure probability times nearness of the nearest segment within the tree's height."""
    t = with_failure(source(spark, sf, "v_trees"))
    near = spatial.nearest_segment(t, "tree_id", source(spark, sf, "v_segments"), 18.0)
    rows = t.join(near, "tree_id").filter(F.col("d") <= F.col("h")).withColumn("risk", F.col("p_fail") * (1 - F.col("d") / 28))
    top = rows.orderBy(F.desc(F.round("risk", 9)), "tree_id").limit(100)
    return sequence.ranked(top, [F.desc(F.round("risk", 9)), F.col("tree_id")]).select(big("rank").alias("rank"), "tree_id", big("seg_id").alias("seg_id"), r6("d").alias("distance"), r6("p_fail").alias("p_fail"), r6("risk").alias("risk"))


# ---- scalars
@query("""SELECT CAST(node_id AS BIGINT) AS node_id, round(2*6371.0088*asin(sqrt(greatest(0,least(1,pow(sin((radians(lat)-radians(62.9))/2),2)+cos(radians(62.9))*cos(radians(lat))*pow(sin((radians(lon)-radians(27.7))/2),2))))),6) AS km,
 round((lon-27.7)/(180/(pi()*6371008.8)/cos(radians(62.9))),5) AS x, round((lat-62.9)/(180/(pi()*6371008.8)),5) AS y,
 round(lon-500/(111320*cos(radians(lat))),6) AS west, round(lat-500/111320e0,6) AS south, round(lon+500/(111320*cos(radians(lat))),6) AS east, round(lat+500/111320e0,6) AS north,
 round((lon+180)/360*16384,6) AS tile_x, round((1-asinh(tan(radians(lat)))/pi())/2*16384,6) AS tile_y FROM v_nodes""")
def coordinates(spark, sf):
    """F01 haversine, F02 local frame, F08 bounding box, F09 tiles."""
    lat, lon = F.col("lat"), F.col("lon")
    x, y = geo.local_xy(lat, lon, 62.9, 27.7)
    w, s, e, n = geo.bbox_around(lat, lon, F.lit(500.0))
    tx, ty = geo.tile_xy(lat, lon, 14)
    return source(spark, sf, "v_nodes").select(big("node_id").alias("node_id"), r6(geo.haversine_km(F.lit(62.9), F.lit(27.7), lat, lon)).alias("km"), F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), r6(w).alias("west"), r6(s).alias("south"), r6(e).alias("east"), r6(n).alias("north"), r6(tx).alias("tile_x"), r6(ty).alias("tile_y"))


def _tm_sql() -> str:
    e, a = geo._E, geo._A1 * geo.K0
    f = " ".join(f"+ {h!r}*sin({2*k}*x1)*cosh({2*k}*e1)" for k, h in enumerate(geo.FORWARD, 1))
    g = " ".join(f"+ {h!r}*cos({2*k}*x1)*sinh({2*k}*e1)" for k, h in enumerate(geo.FORWARD, 1))
    return f"""WITH a AS (SELECT node_id, lat, lon, asinh(tan(radians(lat)))-{e!r}*atanh({e!r}*sin(radians(lat))) AS q, radians(lon)-{geo.LON0!r} AS l FROM v_nodes),
 b AS (SELECT *, atanh(cos(atan(sinh(q)))*sin(l)) AS e1, atan(sinh(q)) AS beta FROM a), c AS (SELECT *, asin(sin(beta)*cosh(e1)) AS x1 FROM b)
 SELECT CAST(node_id AS BIGINT) AS node_id, round({a!r}*(e1 {g})+500000,4) AS east, round({a!r}*(x1 {f}),4) AS north, round(lat,7) AS lat, round(lon,7) AS lon FROM c"""


@query(_tm_sql())
def tm35fin_round_trip(spark, sf):
    """forward projection; the inverse of it returns the input."""
    n = source(spark, sf, "v_nodes")
    e, m = geo.tm35fin(F.col("lat"), F.col("lon"))
    n = n.withColumns({"e": e, "n": m})
    lat, lon = geo.tm35fin_inverse(F.col("e"), F.col("n"))
    return n.select(big("node_id").alias("node_id"), F.round("e", 4).alias("east"), F.round("n", 4).alias("north"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(f"""WITH t AS (SELECT *, {DBH} AS dbh FROM v_trees) SELECT tree_id, round(dbh,6) AS dbh, round(h/greatest(dbh/100,0.02),6) AS hd, round(0.45*pi()*(dbh/200)*(dbh/200)*h,6) AS volume, greatest(0.1,least(1.0,(h-8)/10)) AS size_factor,
 CASE species WHEN 0 THEN 'pine' WHEN 1 THEN 'spruce' ELSE 'birch' END AS species, CASE health WHEN 0 THEN 'healthy' WHEN 1 THEN 'stressed' ELSE 'dead' END AS health FROM t""")
def tree_scalars(spark, sf):
    """F13 diameter, F14 slenderness, F16 volume, F17 size factor, P07 codes."""
    t = source(spark, sf, "v_trees").withColumn("dbh", fo.dbh_cm(F.col("h"), F.col("species")))
    return t.select("tree_id", r6("dbh").alias("dbh"), r6(fo.slenderness(F.col("h"), F.col("dbh"))).alias("hd"), r6(fo.stem_volume(F.col("h"), F.col("dbh"))).alias("volume"), fo.size_factor(F.col("h")).alias("size_factor"), fo.decode(F.col("species"), fo.SPECIES).alias("species"), fo.decode(F.col("health"), fo.HEALTH).alias("health"))


@query("""SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(CASE WHEN v<10 THEN 0 WHEN v<500 THEN 1 WHEN v<2000 THEN 2 WHEN v<4000 THEN 3 WHEN v<10000 THEN 4 ELSE 5 END AS BIGINT) AS intensity,
 CASE WHEN q<5 THEN 'low' WHEN q<10 THEN 'moderate' WHEN q<20 THEN 'high' WHEN q<30 THEN 'very high' ELSE 'extreme' END AS danger, CASE WHEN q>=50 THEN 'high' WHEN q>=25 THEN 'medium' ELSE 'low' END AS route,
 CASE WHEN q/50>=0.55 THEN 'high' WHEN q/50>=0.35 THEN 'medium' ELSE 'low' END AS structure, count(*) AS c
 FROM (SELECT l_orderkey, l_linenumber, l_extendedprice/10 AS v, l_quantity AS q FROM lineitem) t GROUP BY ALL""")
def bands(spark, sf):
    """F18 intensity, F19 danger, F20 levels."""
    l = source(spark, sf, "lineitem")
    v, q = F.col("l_extendedprice") / 10, F.col("l_quantity")
    return l.select(F.col("l_orderkey").alias("k"), big("l_linenumber").alias("n"), big(fo.intensity_class(v)).alias("intensity"), fo.danger_class(q).alias("danger"), fo.route_level(q).alias("route"), fo.structure_level(q / 50).alias("structure")).groupBy("k", "n", "intensity", "danger", "route", "structure").agg(F.count(F.lit(1)).alias("c"))


@query(f"""WITH t AS (SELECT *, {DBH} AS dbh FROM v_trees), f AS (SELECT *, h/greatest(dbh/100,0.02) AS hd FROM t)
 SELECT tree_id, round({FAIL.format(g=28, soil="0.6*0.9")},6) AS p_now, round({FAIL.format(g=25, soil="-0.8")},6) AS p_frozen FROM f""")
def failure(spark, sf):
    """G01."""
    t = with_failure(source(spark, sf, "v_trees"))
    args = [*map(F.col, ("h", "hd", "species", "edge", "emergent", "peat", "health"))]
    return t.select("tree_id", r6(fo.failure_probability(F.lit(28.0), *args, 0.9, False)).alias("p_now"), r6(fo.failure_probability(F.lit(25.0), *args, 0.0, True)).alias("p_frozen"))


# ---- weather
FWI_SQL = """
WITH RECURSIVE d AS (SELECT *, CAST([6.5,7.5,9.0,12.8,13.9,13.9,12.4,10.9,9.4,8.0,7.0,6.0][mon] AS DOUBLE) AS le, CAST([-1.6,-1.6,-1.6,0.9,3.8,5.8,6.4,5.0,2.4,0.4,-1.6,-1.6][mon] AS DOUBLE) AS lf,
  0.942*pow(rh,0.679)+11*exp((rh-100)/10)+0.18*(21.1-t_c)*(1-exp(-0.115*rh)) AS ed, 0.618*pow(rh,0.753)+10*exp((rh-100)/10)+0.18*(21.1-t_c)*(1-exp(-0.115*rh)) AS ew,
  (0.424*(1-pow(rh/100,1.7))+0.0694*sqrt(w_kmh)*(1-pow(rh/100,8)))*0.581*exp(0.0365*t_c) AS kd, (0.424*(1-pow((100-rh)/100,1.7))+0.0694*sqrt(w_kmh)*(1-pow((100-rh)/100,8)))*0.581*exp(0.0365*t_c) AS kw FROM v_days),
 f AS (SELECT series, CAST(-1 AS INT) AS seq, 85e0 AS ffmc, 6e0 AS dmc, 15e0 AS dc, 0e0 AS w
  UNION ALL
  SELECT series, seq, least(greatest(59.5*(250-m2)/(147.2+m2),0),101), greatest(CASE WHEN rain>1.5 THEN greatest(244.72-43.43*ln(20+exp(5.6348-dmc/43.43)+1000*(0.92*rain-1.27)/(48.77+b*(0.92*rain-1.27))-20),0) ELSE dmc END
    + 1.894*(greatest(t_c,-1.1)+1.1)*(100-rh)*le*1e-4, 0),
   CASE WHEN rain>2.8 THEN greatest(400*ln(800/(800*exp(-dc/400)+3.937*(0.83*rain-1.27))),0) ELSE dc END + greatest((0.36*(greatest(t_c,-2.8)+2.8)+lf)/2,0), w_kmh
  FROM (SELECT *, CASE WHEN m1>ed THEN ed+(m1-ed)*pow(10,-kd) WHEN m1<ew THEN ew-(ew-m1)*pow(10,-kw) ELSE m1 END AS m2,
      CASE WHEN dmc<=33 THEN 100/(0.5+0.3*dmc) WHEN dmc<=65 THEN 14-1.3*ln(dmc) ELSE 6.2*ln(dmc)-17.2 END AS b
    FROM (SELECT *, CASE WHEN rain>0.5 THEN least(m0+42.5*(rain-0.5)*exp(-100/(251-m0))*(1-exp(-6.93/(rain-0.5)))+CASE WHEN m0>150 THEN 0.0015*pow(m0-150,2)*sqrt(rain-0.5) ELSE 0 END,250) ELSE m0 END AS m1
      FROM (SELECT d.*, f.dmc, f.dc, 147.2*(101-f.ffmc)/(59.5+f.ffmc) AS m0 FROM f JOIN d ON d.series=f.series AND d.seq=f.seq+1) q0) q1) q2),
 i AS (SELECT *, 147.2*(101-ffmc)/(59.5+ffmc) AS m FROM f WHERE seq>=0),
 j AS (SELECT *, 19.115*exp(-0.1386*m)*(1+pow(m,5.31)/4.93e7)*exp(0.05039*w) AS isi, CASE WHEN dmc<=0 THEN 0 WHEN dmc<=0.4*dc THEN 0.8*dmc*dc/(dmc+0.4*dc) ELSE greatest(dmc-(1-0.8*dc/(dmc+0.4*dc))*(0.92+pow(0.0114*dmc,1.7)),0) END AS bui FROM i),
 k AS (SELECT *, 0.1*isi*CASE WHEN bui<=80 THEN 0.626*pow(bui,0.809)+2 ELSE 1000/(25+108.64*exp(-0.023*bui)) END AS bb FROM j)
SELECT series, CAST(seq AS BIGINT) AS seq, round(ffmc,4) AS ffmc, round(dmc,4) AS dmc, round(dc,4) AS dc, round(isi,4) AS isi, round(bui,4) AS bui, round(CASE WHEN bb>1 THEN exp(2.72*pow(0.434*ln(bb),0.647)) ELSE bb END,4) AS fwi FROM k"""
FWI_SQL = FWI_SQL.replace("SELECT series, CAST(-1 AS INT) AS seq, 85e0", "SELECT DISTINCT series, CAST(-1 AS INT) AS seq, 85e0").replace("0e0 AS w\n", "0e0 AS w FROM v_days\n")


@query(FWI_SQL)
def fwi_codes(spark, sf):
    """The daily fold of every series."""
    s = weather.fwi_series(source(spark, sf, "v_days"))
    return s.select("series", big("seq").alias("seq"), *[F.round(c, 4).alias(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")])


@query("SELECT CAST(station_id AS BIGINT) AS station_id, param, arg_max(epoch_us(ts), (ts, event_id)) AS ts_us, arg_max(value, (ts, event_id)) AS value FROM v_obs WHERE NOT isnan(value) GROUP BY 1, 2")
def latest_reading(spark, sf):
    """S28, §2.18: latest value of each parameter at each station."""
    return weather.latest(source(spark, sf, "v_obs"), ["station_id", "param"]).select(big("station_id").alias("station_id"), "param", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value")


@query("SELECT series, CAST(seq AS BIGINT) AS seq, sum(rain) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rolled FROM v_days")
def rolling_rain(spark, sf):
    """N04."""
    return weather.rolling_sum(source(spark, sf, "v_days"), "series", "seq", "rain").select("series", big("seq").alias("seq"), "rolled")


# ---- grids
@query("SELECT CAST(greatest(0,least(99,trunc(x/2))) AS BIGINT) AS ix, CAST(greatest(0,least(99,trunc(y/2))) AS BIGINT) AS iy, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN cls IN (2,9) THEN z END),6) AS dtm, max(CASE WHEN cls NOT IN (6,14,9,7,18) THEN z END) AS dsm, min(z) AS z_min, 0*avg(CASE WHEN cls IN (2,9) THEN z END)+0*max(CASE WHEN cls NOT IN (6,14,9,7,18) THEN z END)+round(greatest(0,least(45,max(CASE WHEN cls NOT IN (6,14,9,7,18) THEN z END)-avg(CASE WHEN cls IN (2,9) THEN z END))),6) AS chm FROM v_points GROUP BY 1,2")
def surfaces(spark, sf):
    """Terrain, surface and canopy cells of 2 m."""
    c = grid.canopy_height(grid.surfaces(source(spark, sf, "v_points"), 2.0, 100, 100))
    return c.select(big("ix").alias("ix"), big("iy").alias("iy"), "n", r6("dtm").alias("dtm"), "dsm", "z_min", r6("chm").alias("chm"))


@query("SELECT CAST(floor(iy/3) AS BIGINT) AS iy, CAST(floor(ix/3) AS BIGINT) AS ix, CAST(sum(n) AS BIGINT) AS n, max(z_max) AS z_max, round(avg(z_max),6) AS z_mean FROM v_cells WHERE iy<39 AND ix<39 GROUP BY 1,2")
def coarse_cells(spark, sf):
    """3 x 3 blocks, ragged edge dropped."""
    c = grid.coarsen(source(spark, sf, "v_cells"), 3, 41, 41, F.sum("n").alias("n"), F.max("z_max").alias("z_max"), F.avg("z_max").alias("z_mean"))
    return c.select(big("iy").alias("iy"), big("ix").alias("ix"), "n", "z_max", r6("z_mean").alias("z_mean"))


@query("SELECT a.src_key, CAST(a.ret_no AS BIGINT) AS ret_no, count(*) AS c, round(sum(a.z - c.z_max),6) AS below FROM v_points a JOIN v_cells c ON c.ix = CAST(greatest(0,least(40,trunc(a.x/5))) AS INT) AND c.iy = CAST(greatest(0,least(40,trunc(a.y/5))) AS INT) GROUP BY 1,2")
def cell_lookup(spark, sf):
    """J01, P05."""
    p = grid.lookup(source(spark, sf, "v_points"), source(spark, sf, "v_cells"), 0.0, 0.0, 5.0, 41, 41)
    return p.groupBy("src_key", big("ret_no").alias("ret_no")).agg(F.count(F.lit(1)).alias("c"), r6(F.sum(F.col("z") - F.col("z_max"))).alias("below"))


@query("""WITH o AS (SELECT unnest([-1,0,1]) AS d), s AS (SELECT a.iy, a.ix, b.z_max AS z FROM v_cells a CROSS JOIN o p CROSS JOIN o q JOIN v_cells b ON b.iy=a.iy+p.d AND b.ix=a.ix+q.d)
 SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, max(z) AS top, min(z) AS low, median(z) AS med, round(avg(z),6) AS mean FROM s GROUP BY 1,2""")
def stencils(spark, sf):
    """3 x 3 maximum, minimum, median and mean."""
    s = grid.stencil(source(spark, sf, "v_cells"), grid.square(1), {"top": F.max("z_max"), "low": F.min("z_max"), "med": F.median("z_max"), "mean": F.avg("z_max")})
    return s.select(big("iy").alias("iy"), big("ix").alias("ix"), "top", "low", "med", r6("mean").alias("mean"))


@query("""WITH w AS (SELECT d, exp(-d*d/2e0) AS g FROM (SELECT unnest(range(-4,5)) AS d) t), a AS (SELECT c.iy, c.ix, sum(b.z_max*g)/sum(g) AS z FROM v_cells c CROSS JOIN w JOIN v_cells b ON b.iy=c.iy AND b.ix=c.ix+d GROUP BY 1,2)
 SELECT CAST(c.iy AS BIGINT) AS iy, CAST(c.ix AS BIGINT) AS ix, round(sum(b.z*g)/sum(g),6) AS z FROM a c CROSS JOIN w JOIN a b ON b.ix=c.ix AND b.iy=c.iy+d GROUP BY 1,2""")
def gaussian_blur(spark, sf):
    """R03."""
    return grid.gaussian(source(spark, sf, "v_cells"), "z_max", 1.0).select(big("iy").alias("iy"), big("ix").alias("ix"), r6("z_max").alias("z"))


@query("""WITH n AS (SELECT c.iy, c.ix, c.z_max AS z, e.z_max AS e, w.z_max AS w, u.z_max AS u, s.z_max AS s FROM v_cells c LEFT JOIN v_cells e ON e.iy=c.iy AND e.ix=c.ix+1 LEFT JOIN v_cells w ON w.iy=c.iy AND w.ix=c.ix-1
  LEFT JOIN v_cells u ON u.ix=c.ix AND u.iy=c.iy+1 LEFT JOIN v_cells s ON s.ix=c.ix AND s.iy=c.iy-1),
 g AS (SELECT iy, ix, CASE WHEN e IS NULL AND w IS NULL THEN 0 ELSE (coalesce(e,z)-coalesce(w,z))/(5e0*((e IS NOT NULL)::INT+(w IS NOT NULL)::INT)) END AS gx,
  CASE WHEN u IS NULL AND s IS NULL THEN 0 ELSE (coalesce(u,z)-coalesce(s,z))/(5e0*((u IS NOT NULL)::INT+(s IS NOT NULL)::INT)) END AS gy FROM n)
 SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, round(degrees(atan(sqrt(gx*gx+gy*gy))),6) AS slope FROM g""")
def slope(spark, sf):
    """F12, R05."""
    return grid.gradient_slope(source(spark, sf, "v_cells"), "z_max", 5.0).select(big("iy").alias("iy"), big("ix").alias("ix"), r6("slope_deg").alias("slope"))


@query("""WITH m AS (SELECT iy, ix, z_max > 112 AS k FROM v_cells), o AS (SELECT * FROM (VALUES (0,0),(0,1),(0,-1),(1,0),(-1,0)) AS v(dy,dx)),
 d AS (SELECT a.iy, a.ix, bool_or(b.k) AS k FROM m a CROSS JOIN o JOIN m b ON b.iy=a.iy+dy AND b.ix=a.ix+dx GROUP BY 1,2),
 e AS (SELECT a.iy, a.ix, bool_and(b.k) AND count(*)=5 AS k FROM d a CROSS JOIN o JOIN d b ON b.iy=a.iy+dy AND b.ix=a.ix+dx GROUP BY 1,2)
 SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, k FROM e""")
def closing(spark, sf):
    """R10."""
    m = source(spark, sf, "v_cells").select("iy", "ix", (F.col("z_max") > 112).alias("k"))
    return grid.closed(m, "k").select(big("iy").alias("iy"), big("ix").alias("ix"), "k")


@query("""WITH c AS (SELECT iy, ix, z_max-100 AS chm FROM v_cells), s AS (SELECT a.iy, a.ix, a.chm, max(CASE WHEN greatest(abs(b.iy-a.iy),abs(b.ix-a.ix))<=1 THEN b.chm END) AS m1, max(CASE WHEN greatest(abs(b.iy-a.iy),abs(b.ix-a.ix))<=2 THEN b.chm END) AS m2, max(b.chm) AS m3
  FROM c a JOIN c b ON b.iy BETWEEN a.iy-3 AND a.iy+3 AND b.ix BETWEEN a.ix-3 AND a.ix+3 GROUP BY 1,2,3)
 SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, chm FROM s WHERE chm>=3 AND chm >= CASE WHEN chm<8 THEN m1 WHEN chm<18 THEN m2 ELSE m3 END - 1e-6""")
def tree_tops(spark, sf):
    """R07, M01's peaks."""
    c = source(spark, sf, "v_cells").select("iy", "ix", (F.col("z_max") - 100).alias("chm"))
    return grid.local_maxima(c).select(big("iy").alias("iy"), big("ix").alias("ix"), "chm")


@query("""WITH m AS (SELECT iy, ix FROM v_cells WHERE n_veg >= (SELECT quantile_cont(n_veg, 0.9) FROM v_cells)), d AS (SELECT a.iy, a.ix, min((a.iy-b.iy)*(a.iy-b.iy)+(a.ix-b.ix)*(a.ix-b.ix)) AS d2 FROM v_cells a CROSS JOIN m b GROUP BY 1,2)
 SELECT CAST(c.iy AS BIGINT) AS iy, CAST(c.ix AS BIGINT) AS ix, round(coalesce(sqrt(d2)*5,1000),6) AS distance FROM v_cells c LEFT JOIN d ON d.iy=c.iy AND d.ix=c.ix""")
def distance_map(spark, sf):
    """R11."""
    c = source(spark, sf, "v_cells")
    cut = c.agg(F.percentile("n_veg", 0.9).alias("cut"))
    m = c.crossJoin(F.broadcast(cut)).select("iy", "ix", (F.col("n_veg") >= F.col("cut")).alias("m"))  # one row
    return grid.distance_to(m, "m", 5.0).select(big("iy").alias("iy"), big("ix").alias("ix"), r6("distance").alias("distance"))


@query()
def regions(spark, sf):
    """4-connected components."""
    m = source(spark, sf, "v_cells").filter("z_max > 118")
    return graph.label_cells(m, 64).select(big("iy").alias("iy"), big("ix").alias("ix"), "label")


@query("WITH a AS (SELECT iy, ix, n_veg/CAST(n AS DOUBLE) AS pre, (n_veg % 3)/4e0 AS post FROM v_cells) SELECT round(sum((pre>0.55)::INT)*25/10000e0,6) AS forest_ha, round(sum((pre>0.55 AND post-pre< -0.15)::INT)*25/10000e0,6) AS loss_ha, round(sum((pre<0.4 AND post-pre>0.15)::INT)*25/10000e0,6) AS gain_ha, round(avg(post-pre),6) AS mean_change FROM a")
def canopy_change(spark, sf):
    """R23, A25."""
    c = source(spark, sf, "v_cells")
    out = grid.canopy_change(c.select("iy", "ix", (F.col("n_veg") / F.col("n")).alias("ndvi")), c.select("iy", "ix", ((F.col("n_veg") % 3) / 4).alias("ndvi")), 5.0)
    return out.select(*[r6(x).alias(x) for x in out.columns])


# ---- spatial joins
@query("SELECT tree_id, CAST(arg_min(building_id, d*1000000+building_id) AS BIGINT) AS building_id, round(min(d),6) AS d FROM (SELECT t.tree_id, b.building_id, sqrt(pow(t.x-b.x,2)+pow(t.y-b.y,2)) AS d FROM v_trees t JOIN v_buildings b ON abs(t.x-b.x)<=35 AND abs(t.y-b.y)<=35) q WHERE d<=35 GROUP BY tree_id")
def nearest_building(spark, sf):
    """Nearest within 35 m."""
    n = spatial.nearest_within(source(spark, sf, "v_trees"), "tree_id", source(spark, sf, "v_buildings"), "building_id", 35.0)
    return n.select("tree_id", "building_id", r6("d").alias("d"))


@query("SELECT * FROM (SELECT t.tree_id, b.building_id, round(sqrt(pow(t.x-b.x,2)+pow(t.y-b.y,2)),6) AS d, CAST(row_number() OVER (PARTITION BY t.tree_id ORDER BY sqrt(pow(t.x-b.x,2)+pow(t.y-b.y,2)), b.building_id) AS BIGINT) AS rank FROM v_trees t JOIN v_buildings b ON sqrt(pow(t.x-b.x,2)+pow(t.y-b.y,2))<=60) q WHERE rank<=3")
def three_nearest(spark, sf):
    """J05."""
    return spatial.k_nearest_within(source(spark, sf, "v_trees"), "tree_id", source(spark, sf, "v_buildings"), "building_id", 60.0, 3).select("tree_id", "building_id", r6("d").alias("d"), big("rank").alias("rank"))


@query("SELECT a.tree_id, a.h FROM v_trees a WHERE NOT EXISTS (SELECT 1 FROM v_trees b WHERE b.tree_id<>a.tree_id AND b.h>a.h AND pow(a.x-b.x,2)+pow(a.y-b.y,2)<=36)")
def visible_trees(spark, sf):
    """J06."""
    return spatial.no_taller_neighbour(source(spark, sf, "v_trees"), 6.0).select("tree_id", "h")


@query("SELECT b.building_id FROM v_buildings b WHERE NOT EXISTS (SELECT 1 FROM v_trees t WHERE pow(t.x-b.x,2)+pow(t.y-b.y,2)<=100)")
def unmapped_buildings(spark, sf):
    """Anti-join on distance."""
    return spatial.unmapped(source(spark, sf, "v_buildings"), "building_id", source(spark, sf, "v_trees"), 10.0).select("building_id")


@query(f"WITH q AS (SELECT *, {SEG_T} AS t FROM v_trees CROSS JOIN v_segments), r AS (SELECT tree_id, seg_id, {SEG_D} AS d FROM q) SELECT tree_id, CAST(arg_min(seg_id, d*1000000+seg_id) AS BIGINT) AS seg_id, round(min(d),6) AS d FROM r WHERE d<=40 GROUP BY tree_id")
def nearest_road(spark, sf):
    """J08, J09, F06, F07."""
    return spatial.nearest_segment(source(spark, sf, "v_trees"), "tree_id", source(spark, sf, "v_segments"), 40.0).select("tree_id", big("seg_id").alias("seg_id"), r6("d").alias("d"))


@query("WITH g AS (SELECT iy, ix FROM (SELECT unnest(range(-4,84)) AS iy) a CROSS JOIN (SELECT unnest(range(-4,84)) AS ix) b) SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, min(building_id) AS building_id FROM g JOIN v_buildings b ON pow((ix+0.5)*5-b.x,2)+pow((iy+0.5)*5-b.y,2)<=b.r*b.r GROUP BY 1,2")
def building_cells(spark, sf):
    """J10, R21."""
    return spatial.covered_cells(source(spark, sf, "v_buildings"), "building_id", 5.0).select(big("iy").alias("iy"), big("ix").alias("ix"), "building_id")


@query("SELECT CAST(seg_id AS BIGINT) AS seg_id, CAST(k AS BIGINT) AS k, round(ax+(bx-ax)*k/8e0,6) AS x, round(ay+(by_-ay)*k/8e0,6) AS y FROM v_segments CROSS JOIN (SELECT unnest(range(0,9)) AS k) t")
def dense_segments(spark, sf):
    """40 m segments at 5 m."""
    return spatial.densify(source(spark, sf, "v_segments"), 5.0).select(big("seg_id").alias("seg_id"), big("k").alias("k"), r6("x").alias("x"), r6("y").alias("y"))


@query("SELECT tree_id, building_id FROM v_trees t JOIN v_buildings b ON (b.y-b.r>t.y)<>(b.y+b.r>t.y) AND t.x<b.x+b.r AND NOT t.x<b.x-b.r")
def trees_in_plots(spark, sf):
    """Even-odd rule in square plots about buildings."""
    corner = lambda sx, sy: F.struct((F.col("x") + sx * F.col("r")).alias("x"), (F.col("y") + sy * F.col("r")).alias("y"))
    plots = source(spark, sf, "v_buildings").select("building_id", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))
    return spatial.points_in_polygons(source(spark, sf, "v_trees"), "tree_id", plots, "building_id", 20.0)


@query("""WITH b AS (SELECT CAST(floor(x/4) AS INT) AS ix, CAST(floor(y/4) AS INT) AS iy, min(building_id) AS piece FROM v_buildings GROUP BY 1,2),
 r AS (SELECT tree_id, d, s, CAST(floor(round(x+s*4*cos(radians(d*30)),9)/4) AS INT) AS ix, CAST(floor(round(y+s*4*sin(radians(d*30)),9)/4) AS INT) AS iy FROM v_trees CROSS JOIN (SELECT unnest(range(0,12)) AS d) p CROSS JOIN (SELECT unnest(range(1,9)) AS s) q WHERE s*4<=h)
 SELECT tree_id, CAST(d AS BIGINT) AS direction, CAST(min(s) AS BIGINT) AS step, arg_min(piece, s) AS piece_id FROM r JOIN b USING (iy, ix) GROUP BY 1,2""")
def strike_rays(spark, sf):
    """First building cell along twelve bearings."""
    cells = source(spark, sf, "v_buildings").groupBy(F.floor(F.col("x") / 4).cast("int").alias("ix"), F.floor(F.col("y") / 4).cast("int").alias("iy")).agg(F.min("building_id").alias("piece_id")).withColumn("kind", F.lit("bld"))
    return spatial.ray_hits(source(spark, sf, "v_trees"), cells, 12, 4.0).select("tree_id", big("direction").alias("direction"), big("step").alias("step"), "piece_id")


# ---- sequences
VERTICES = "SELECT n_regionkey AS line_id, n_nationkey AS seq, CAST((n_nationkey*16) % 400 AS DOUBLE) AS x, CAST((n_nationkey*48) % 400 AS DOUBLE) AS y, n_nationkey % 3 = 0 AS flag FROM nation"


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    n = source(spark, sf, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_regionkey").alias("line_id"), k.alias("seq"), ((k * 16) % 400).cast("double").alias("x"), ((k * 48) % 400).cast("double").alias("y"), (k % 3 == 0).alias("flag"))


@query(f"""WITH v AS ({VERTICES}), s AS (SELECT *, coalesce(sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)),0) AS step FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq))
 SELECT CAST(line_id AS BIGINT) AS line_id, CAST(seq AS BIGINT) AS seq, round(step,6) AS step, round(sum(step) OVER (PARTITION BY line_id ORDER BY seq),6) AS upto FROM s""")
def arc_lengths(spark, sf):
    """N02, N03."""
    return sequence.steps(vertices(spark, sf), "line_id", "seq").select(big("line_id").alias("line_id"), big("seq").alias("seq"), r6("step").alias("step"), r6("upto").alias("upto"))


@query(f"""WITH v AS ({VERTICES}), g AS (SELECT *, CASE WHEN seq-lag(seq) OVER w > 4 THEN 1 ELSE 0 END AS b FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq)), i AS (SELECT *, sum(b) OVER (PARTITION BY line_id ORDER BY seq) AS island FROM g),
 r AS (SELECT line_id, island, min(seq) AS first, max(seq) AS last, count(*) AS n FROM i GROUP BY 1,2)
 SELECT CAST(line_id AS BIGINT) AS line_id, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, n FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY n DESC, island) AS k FROM r) q WHERE k=1""")
def longest_run(spark, sf):
    """Gaps and islands."""
    return sequence.longest_run(vertices(spark, sf), "line_id", "seq", 4).select(big("line_id").alias("line_id"), big("first").alias("first"), big("last").alias("last"), "n")


@query(f"""WITH v AS ({VERTICES}), i AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY line_id) AS n FROM v), o AS (SELECT unnest(range(-2,3)) AS d)
 SELECT CAST(a.line_id AS BIGINT) AS line_id, CAST(a.seq AS BIGINT) AS seq, round(avg(b.x),6) AS smooth FROM i a CROSS JOIN o JOIN i b ON b.line_id=a.line_id AND b.i=greatest(1,least(a.n,a.i+d)) GROUP BY 1,2""")
def moving_average(spark, sf):
    """Edge-padded."""
    return sequence.smoothed(vertices(spark, sf), "line_id", "seq", "x", 5).select(big("line_id").alias("line_id"), big("seq").alias("seq"), r6("smooth").alias("smooth"))


@query(f"""WITH v AS ({VERTICES}) SELECT CAST(line_id AS BIGINT) AS line_id, sum(CASE WHEN flag AND NOT coalesce(p,false) THEN 1 ELSE 0 END)::BIGINT AS entries FROM (SELECT *, lag(flag) OVER (PARTITION BY line_id ORDER BY seq) AS p FROM v) q GROUP BY 1""")
def band_entries(spark, sf):
    """N09."""
    return sequence.entries(vertices(spark, sf), "line_id", "seq", "flag").select(big("line_id").alias("line_id"), "entries")


@query(f"""WITH v AS ({VERTICES}), r AS (SELECT *, seq - row_number() OVER (PARTITION BY line_id ORDER BY seq)*5 AS island FROM v WHERE flag) SELECT CAST(line_id AS BIGINT) AS line_id, count(*)::BIGINT AS n, CAST(min(seq) AS BIGINT) AS first FROM r GROUP BY line_id, island""")
def true_runs(spark, sf):
    """Runs of a flag, with vertices numbered along each line."""
    v = vertices(spark, sf).withColumn("k", F.floor(F.col("seq") / 5))
    r = grid.run_lengths(v, "flag", ["line_id"], "k")
    return r.select(big("line_id").alias("line_id"), "n", (F.col("first") * 5 + F.col("line_id")).cast("long").alias("first"))


@query(f"""WITH v AS ({VERTICES}), i AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq)-1 AS i, count(*) OVER (PARTITION BY line_id) AS n FROM v) SELECT CAST(line_id AS BIGINT) AS line_id, CAST(seq AS BIGINT) AS seq, x, y FROM i WHERE i%2=0 OR i=n-1""")
def thinned_path(spark, sf):
    """P10."""
    return sequence.thinned(vertices(spark, sf), "line_id", "seq").select(big("line_id").alias("line_id"), big("seq").alias("seq"), "x", "y")


@query("SELECT src_key, CAST(ret_no AS BIGINT) AS ret_no, x, y, count(*) AS c FROM v_points WHERE src_key % 13 = 0 GROUP BY ALL")
def stride(spark, sf):
    """Every 13th record."""
    return sequence.strided(source(spark, sf, "v_points"), "src_key", 13_000, 1_000).groupBy("src_key", big("ret_no").alias("ret_no"), "x", "y").agg(F.count(F.lit(1)).alias("c"))


# ---- text and attributes
@query(r"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(html,'<[^>]+>',' ','g'),'\s+',' ','g')),1,300) AS text, CASE WHEN contains(lower(html),'fire') THEN 'forest_fire' WHEN contains(lower(html),'wind') THEN 'wind' ELSE 'other' END AS kind, substr(sha1(url),1,24) AS cache_key FROM pages""")
def page_text(spark, sf):
    """F28, F29, F34, S29, S30."""
    return source(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"), text.warning_kind(F.col("html")).alias("kind"), text.cache_key(F.col("url")).alias("cache_key"))


@query("""WITH w AS (SELECT p_partkey AS k, ['primary','residential','track','footway'][p_partkey%4+1] AS hw, CASE WHEN p_partkey%5=0 THEN NULL WHEN p_partkey%5=1 THEN '20000;110000' WHEN p_partkey%5=2 THEN 'x' ELSE '400' END AS volt, CASE WHEN p_partkey%3=0 THEN 'minor_line' ELSE 'line' END AS power FROM part),
 v AS (SELECT *, CASE WHEN volt LIKE '%;%' THEN 110.0 WHEN volt='400' THEN 0.4 WHEN power='minor_line' THEN 20.0 END AS kv FROM w)
 SELECT k, CASE hw WHEN 'primary' THEN 'main' WHEN 'footway' THEN 'path' ELSE 'forest' END AS cls, CASE hw WHEN 'primary' THEN 7.0 WHEN 'residential' THEN 5.0 WHEN 'track' THEN 3.5 ELSE 1.5 END::DOUBLE AS width, kv::DOUBLE AS kv, CASE WHEN kv<=45 THEN 9.0 ELSE 15.0 END::DOUBLE AS conductor_h, CASE WHEN kv<=45 THEN 5.0 ELSE 13.0 END::DOUBLE AS row_half FROM v""")
def map_tags(spark, sf):
    """Road classes, voltages, conductors."""
    k = F.col("p_partkey")
    w = source(spark, sf, "part").select(k.alias("k"), F.element_at(F.array(*map(F.lit, ("primary", "residential", "track", "footway"))), (k % 4 + 1).cast("int")).alias("hw"), F.when(k % 5 == 1, "20000;110000").when(k % 5 == 2, "x").when(k % 5 > 2, "400").alias("volt"), F.when(k % 3 == 0, "minor_line").otherwise("line").alias("power"))
    cls, width = text.road_class(F.col("hw"))
    w = w.withColumn("kv", text.line_kv(F.col("volt"), F.col("power")))
    h, half = text.conductor(F.col("kv"))
    return w.select("k", cls.alias("cls"), width.alias("width"), "kv", h.alias("conductor_h"), half.alias("row_half"))


@query("""SELECT o_orderkey AS k, CAST(CASE WHEN month(o_orderdate)>=7 THEN year(o_orderdate) ELSE year(o_orderdate)-1 END AS BIGINT) AS season, datediff('day', DATE '1970-01-01', least(make_date(CASE WHEN month(o_orderdate)>=7 THEN year(o_orderdate) ELSE year(o_orderdate)-1 END,9,15), CAST(o_orderdate AS DATE)))::BIGINT AS post_end,
 lpad(CAST(o_orderkey%1440//60 AS VARCHAR),2,'0')||':'||lpad(CAST(o_orderkey%60 AS VARCHAR),2,'0') AS clock, CAST(o_orderkey%1440 AS BIGINT) AS minutes FROM orders""")
def seasons_and_clock(spark, sf):
    """F21-F25."""
    o = source(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    _, _, start, end = text.season(d)
    clock = text.clock((F.col("o_orderkey") % 1440).cast("double"))
    return o.select(F.col("o_orderkey").alias("k"), big(F.year(start)).alias("season"), big(F.datediff(end, F.lit("1970-01-01").cast("date"))).alias("post_end"), clock.alias("clock"), big(text.minutes(clock)).alias("minutes"))


@query("""SELECT building_id, kind, CASE kind WHEN 'care_home' THEN 3.0 WHEN 'school' THEN 2.5 WHEN 'cabin' THEN 0.8 ELSE 1.0 END::DOUBLE AS sensitivity, kind<>'cabin' AS house, concat_ws('; ', CASE WHEN r>9 THEN 'large' END, CASE WHEN x<100 THEN 'west' END, CASE WHEN kind='care_home' THEN 'people at risk' END) AS reasons FROM v_buildings""")
def building_rules(spark, sf):
    """F31, F32, F36, F43, J18, O06."""
    b = source(spark, sf, "v_buildings")
    return b.select("building_id", "kind", text.sensitivity(F.col("kind")).alias("sensitivity"), text.is_house(F.col("kind")).alias("house"), text.reasons((F.col("r") > 9, "large"), (F.col("x") < 100, "west"), (F.col("kind") == "care_home", "people at risk")).alias("reasons"))


@query("""SELECT ix, iy, round(h,6) AS h, round(CASE WHEN hi=0 THEN 0 ELSE (hi-lo)/hi END,6) AS s, round(hi,6) AS v, round(exg,6) AS exg FROM (
 SELECT *, CASE WHEN hi=lo THEN 0 WHEN hi=r THEN ((g-b)/(hi-lo) - 6*floor((g-b)/(hi-lo)/6)) WHEN hi=g THEN (b-r)/(hi-lo)+2 ELSE (r-g)/(hi-lo)+4 END/6 AS h FROM (
 SELECT *, greatest(r,g,b) AS hi, least(r,g,b) AS lo, (2*g-r-b)*255/(r*255+g*255+b*255+1e-6) AS exg FROM (SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, (n*7%256)/255e0 AS r, (n_veg*11%256)/255e0 AS g, ((n+ix)*13%256)/255e0 AS b FROM v_cells) a) q) p""")
def pixel_colours(spark, sf):
    """HSV and excess green."""
    c = source(spark, sf, "v_cells").select(big("ix").alias("ix"), big("iy").alias("iy"), (F.col("n") * 7 % 256).cast("double").alias("r"), (F.col("n_veg") * 11 % 256).cast("double").alias("g"), ((F.col("n") + F.col("ix")) * 13 % 256).cast("double").alias("b"))
    h, s, v = text.hsv(F.col("r"), F.col("g"), F.col("b"))
    return c.select("ix", "iy", r6(h).alias("h"), r6(s).alias("s"), r6(v).alias("v"), r6(text.excess_green(F.col("r"), F.col("g"), F.col("b"))).alias("exg"))


# ---- aggregates and learning
@query("""WITH t AS (SELECT species, tree_id, h, median(h) OVER (PARTITION BY species) AS med FROM v_trees), m AS (SELECT *, median(abs(h-med)) OVER (PARTITION BY species) AS mad FROM t)
 SELECT tree_id, round((h-med)/greatest(1.4826*mad,1e-6),6) AS z FROM m""")
def robust_z(spark, sf):
    """A07, M07."""
    return trees.robust_z(source(spark, sf, "v_trees"), "species", "h").select("tree_id", r6("z").alias("z"))


@query("""WITH e AS (SELECT vec_id, label, unnest([1,2,3,4,5]) AS f, CAST(unnest(embedding[1:5]) AS DOUBLE) AS v FROM embeddings), p AS (SELECT label, f, avg(v) AS mu, var_pop(v)+1e-3 AS var, count(*) AS n FROM e GROUP BY 1,2 HAVING count(*)>=2), q AS (SELECT *, n/sum(n) OVER (PARTITION BY f) AS prior FROM p),
 s AS (SELECT e.vec_id, q.label AS class, sum(-0.5*(pow(v-mu,2)/var+ln(2*pi()*var)))+ln(any_value(prior)) AS s FROM e JOIN q USING (f) GROUP BY 1,2),
 w AS (SELECT *, exp(s-max(s) OVER (PARTITION BY vec_id)) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class) AS k FROM s)
 SELECT vec_id, CAST(class AS BIGINT) AS class, round(c,6) AS confidence FROM (SELECT *, x/sum(x) OVER (PARTITION BY vec_id) AS c FROM w) z WHERE k=1""".replace("e JOIN q USING (f)", "e JOIN q ON q.f = e.f"))
def naive_bayes(spark, sf):
    """Fit and predict."""
    e = source(spark, sf, "embeddings")
    names = [f"f{k}" for k in range(1, 6)]
    e = e.select("vec_id", "label", *[F.element_at("embedding", k).cast("double").alias(f"f{k}") for k in range(1, 6)])
    return trees.nb_predict(e, "vec_id", trees.nb_fit(e, "label", names), names).select("vec_id", big("class").alias("class"), r6("confidence").alias("confidence"))


@query("SELECT CAST(species AS BIGINT) AS truth, CAST(health AS BIGINT) AS predicted, count(*) AS n FROM v_trees GROUP BY 1,2")
def confusion(spark, sf):
    """A10."""
    return trees.confusion(source(spark, sf, "v_trees").select(big("species").alias("truth"), big("health").alias("predicted")), "truth", "predicted")


@query("""WITH c AS (SELECT u.k AS class FROM (SELECT unnest([0,1,2]) AS k) u) SELECT CAST(class AS BIGINT) AS class, round((SELECT avg((health=class)::INT) FROM v_trees WHERE species=class),6) AS recall, round((SELECT avg((species=class)::INT) FROM v_trees WHERE health=class),6) AS precision FROM c""")
def class_scores(spark, sf):
    """A10, A11."""
    return trees.class_scores(source(spark, sf, "v_trees"), "species", "health").select(big("class").alias("class"), r6("recall").alias("recall"), r6("precision").alias("precision"))


@query("SELECT CAST(floor(x/50) AS BIGINT) AS bx, CAST(floor(y/50) AS BIGINT) AS b_y, round(1-exp(sum(ln(1-least(h/40,0.999999)))),6) AS p FROM v_trees GROUP BY 1,2")
def noisy_or(spark, sf):
    """A12, A13."""
    t = source(spark, sf, "v_trees").select(big(F.floor(F.col("x") / 50)).alias("bx"), big(F.floor(F.col("y") / 50)).alias("b_y"), (F.col("h") / 40).alias("q"))
    return montecarlo.noisy_or(t, ["bx", "b_y"], "q").select("bx", "b_y", r6("p").alias("p"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY h*crown_area DESC, tree_id) AS k, sum(h*crown_area) OVER (ORDER BY h*crown_area DESC, tree_id) AS upto, sum(h*crown_area) OVER () AS whole FROM v_trees)
 SELECT min(CASE WHEN upto>=0.5*whole THEN k END) AS n_50, min(CASE WHEN upto>=0.8*whole THEN k END) AS n_80, count(*) AS n FROM r""")
def pareto(spark, sf):
    """A16, N10."""
    out = montecarlo.pareto(source(spark, sf, "v_trees").withColumn("v", F.col("h") * F.col("crown_area")), "v", "tree_id")
    return out.select(*[big(c).alias(c) for c in out.columns])


@query("WITH p AS (SELECT * FROM v_points WHERE cls=14), m AS (SELECT count(*) AS n, avg(x) AS cx, avg(y) AS cy, 0.5*atan2(2*covar_pop(x,y), var_pop(x)-var_pop(y)) AS angle FROM p) SELECT CAST(floor(((x-cx)*cos(angle)+(y-cy)*sin(angle))/40) AS BIGINT) AS bin, round(avg(x),6) AS x, round(avg(y),6) AS y, count(*) AS n FROM p CROSS JOIN m WHERE m.n>=200 GROUP BY 1 HAVING count(*)>5")
def wire_line(spark, sf):
    """Principal axis and binned vertices."""
    return trees.wire_vertices(source(spark, sf, "v_points")).select(big("bin").alias("bin"), r6("x").alias("x"), r6("y").alias("y"), "n")


@query("WITH p AS (SELECT CAST(src_key % 200 AS BIGINT) AS tree_id, z-100 AS hag, 30e0 AS h, cls, red, nir FROM v_points WHERE z-100>1 AND cls NOT IN (2,6,9,14)) SELECT tree_id, count(*) AS pts, round(avg((hag/h<0.6)::INT),6) AS low_frac, round(avg(hag/h),6) AS rel_mean, round((sum(CASE WHEN hag/h>0.5 THEN nir ELSE 0 END)/greatest(sum((hag/h>0.5)::INT),1)-sum(CASE WHEN hag/h>0.5 THEN red ELSE 0 END)/greatest(sum((hag/h>0.5)::INT),1))/greatest(sum(CASE WHEN hag/h>0.5 THEN nir ELSE 0 END)/greatest(sum((hag/h>0.5)::INT),1)+sum(CASE WHEN hag/h>0.5 THEN red ELSE 0 END)/greatest(sum((hag/h>0.5)::INT),1),1),6) AS ndvi FROM p GROUP BY 1")
def tree_features(spark, sf):
    """A05, M02, F15."""
    p = source(spark, sf, "v_points").select((F.col("src_key") % 200).alias("tree_id"), (F.col("z") - 100).alias("hag"), F.lit(30.0).alias("h"), "cls", "red", "nir", "intensity")
    return trees.tree_features(p).select("tree_id", "pts", r6("low_frac").alias("low_frac"), r6("rel_mean").alias("rel_mean"), r6("ndvi").alias("ndvi"))


# ---- storms and euros
RNG = "(SELECT *, (s2*s2+t)%2147483647/2147483648e0 AS u FROM (SELECT *, (s1*s1+69621*r+c)%2147483647 AS s2 FROM (SELECT *, (s0*s0+48271*t+r)%2147483647 AS s1 FROM (SELECT *, (1103515245*t+12345*r+c)%2147483647 AS s0 FROM ({src}) a) b) d) e)"
STORM = f"""WITH t AS (SELECT *, {DBH} AS dbh FROM v_trees), f AS (SELECT *, h/greatest(dbh/100,0.02) AS hd FROM t), p AS (SELECT tree_id, {FAIL.format(g=25, soil="0.6*0.9")} AS p, (tree_id%8)/16e0 AS wp, (tree_id%4)/16e0 AS wb, 0.125e0 AS wr FROM f),
 a AS {RNG.format(src="SELECT tree_id AS t, r, 1::BIGINT AS c, p, wp, wb, wr FROM p CROSS JOIN (SELECT unnest(range(0,50)) AS r) q")}, b AS {RNG.format(src="SELECT tree_id AS t, r, 2::BIGINT AS c FROM p CROSS JOIN (SELECT unnest(range(0,50)) AS r) q")},
 o AS (SELECT r, count(*) AS fallen, sum((v<wp)::INT) AS n_line, sum((v>=wp AND v<wp+wb)::INT) AS n_bld, sum((v>=wp+wb AND v<wp+wb+wr)::INT) AS n_road FROM (SELECT a.*, b.u AS v FROM a JOIN b ON a.t=b.t AND a.r=b.r WHERE a.u<a.p) q GROUP BY r),
 runs AS (SELECT x.r AS run, coalesce(fallen,0) AS fallen, coalesce(n_line,0)::BIGINT AS n_line, coalesce(n_bld,0)::BIGINT AS n_bld, coalesce(n_road,0)::BIGINT AS n_road FROM (SELECT unnest(range(0,50)) AS r) x LEFT JOIN o ON o.r=x.r)"""


def stormy(spark: SparkSession, sf: str) -> DataFrame:
    t = with_failure(source(spark, sf, "v_trees"))
    return t.withColumns({"volume": F.lit(1.0), "w_power": (F.col("tree_id") % 8) / 16, "w_bld": (F.col("tree_id") % 4) / 16, "w_road": F.lit(0.125)})


@query(STORM + " SELECT CAST(run AS BIGINT) AS run, fallen, n_line, n_bld, n_road FROM runs")
def storm_runs(spark, sf):
    """Keyed Monte-Carlo."""
    return montecarlo.storm(stormy(spark, sf), 50).select(big("run").alias("run"), "fallen", "n_line", "n_bld", "n_road")


@query(STORM + """, c AS (SELECT (n_line>0)::INT*25000e0+n_line*2100e0+n_road*300e0+n_bld*8000e0+fallen*12e0 AS total FROM runs) SELECT round(avg(total),4) AS total_mean, round(quantile_cont(total,0.05),4) AS total_p5, round(quantile_cont(total,0.5),4) AS total_p50, round(quantile_cont(total,0.95),4) AS total_p95 FROM c""")
def storm_euros(spark, sf):
    """Costs per run and their spread."""
    c = costs.storm_costs(montecarlo.storm(stormy(spark, sf), 50), costs.defaults(spark))
    out = montecarlo.spread(c, ["total"])
    return out.select(*[F.round(x, 4).alias(x) for x in out.columns])


@query(f"WITH t AS (SELECT *, {DBH} AS dbh FROM v_trees), f AS (SELECT *, h/greatest(dbh/100,0.02) AS hd FROM t) SELECT CAST(g AS DOUBLE) AS gust, round(sum({FAIL.format(g='g', soil='0.6*0.9')}),4) AS expected FROM f CROSS JOIN (SELECT unnest(range(10,41,2)) AS g) q GROUP BY g")
def gust_curve(spark, sf):
    """G06's curve."""
    args = [*map(F.col, ("h", "hd", "species", "edge", "emergent", "peat", "health"))]
    out = montecarlo.gust_curve(with_failure(source(spark, sf, "v_trees")), lambda g: fo.failure_probability(g, *args, 0.9, False))
    return out.select("gust", F.round("expected", 4).alias("expected"))


@query(f"WITH t AS (SELECT *, {DBH} AS dbh FROM v_trees), f AS (SELECT *, h/greatest(dbh/100,0.02) AS hd FROM t), p AS (SELECT *, {FAIL.format(g=25, soil='0.6*0.9')} AS p FROM f) SELECT tree_id, round(p*((tree_id%8)/16e0*27100+(tree_id%4)/16e0*8000+0.125*greatest(0.1,least(1.0,(h-8)/10))*300+0.45*pi()*(dbh/200)*(dbh/200)*h*12),5) AS damage FROM p ORDER BY round(p*((tree_id%8)/16e0*27100+(tree_id%4)/16e0*8000+0.125*greatest(0.1,least(1.0,(h-8)/10))*300+0.45*pi()*(dbh/200)*(dbh/200)*h*12),5) DESC, tree_id LIMIT 25")
def worst_trees(spark, sf):
    """G17, O02."""
    d = costs.tree_damage(stormy(spark, sf).drop("volume"), costs.defaults(spark)).select("tree_id", F.round("damage", 5).alias("damage"))
    return d.orderBy(F.desc("damage"), "tree_id").limit(25)


# ---- fire
FUEL = "CASE WHEN z_max>124 THEN 'NF' WHEN n_veg/n::DOUBLE>=0.25 THEN CASE WHEN (ix%10)/10e0<0.30 THEN 'D1' WHEN (ix%10)/10e0<0.65 THEN 'M1' WHEN z_max-100<10 THEN 'C4' WHEN iy%2=0 THEN 'C2' ELSE 'C3' END ELSE 'O1' END"


def fire_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = source(spark, sf, "v_cells").withColumns({"cover": F.col("n_veg") / F.col("n"), "conifer": (F.col("ix") % 10) / 10, "mean_h": F.col("z_max") - 100, "spruce": F.lit(1.0), "pine": (F.col("iy") % 2) * 2.0, "water": F.col("z_max") > 124, "building": F.lit(False), "road_main": F.lit(False), "dead": (F.col("iy") % 4) / 4, "bog": F.col("ix") % 7 == 0, "road_forest": F.col("iy") % 9 == 0})
    c = c.withColumn("fuel", fire.fuel_type())
    c = c.withColumn("ros", fire.head_ros(F.col("fuel"), F.lit(10.0), F.lit(50.0), F.col("conifer"), F.col("dead"), F.col("bog"), F.col("road_forest")))
    return c.withColumn("hfi", fire.head_intensity(fire.fuel_load(F.col("fuel"), F.col("conifer"), F.col("dead")), F.col("ros")))


def _rsi(a, b, c, q, b0):
    return f"{a}*pow(1-exp(-{b}*10),{c})" + (f"*exp(50*ln({q})*(1/50e0-1/{b0}e0))" if q < 1 else "")


FIRE = f"""WITH f AS (SELECT *, {FUEL} AS fuel, (ix%10)/10e0 AS con, (iy%4)/4e0 AS dead FROM v_cells), r AS (SELECT *, CASE fuel WHEN 'NF' THEN 0 WHEN 'O1' THEN 0.70*{_rsi(190,0.0310,1.4,1,1)} WHEN 'C2' THEN {_rsi(110,0.0282,1.5,0.7,64)} WHEN 'C3' THEN {_rsi(110,0.0444,3.0,0.75,62)} WHEN 'C4' THEN {_rsi(110,0.0293,1.5,0.8,66)}
 WHEN 'D1' THEN {_rsi(30,0.0232,1.6,0.9,32)} ELSE con*{_rsi(110,0.0282,1.5,0.7,64)}+(1-con)*0.2*{_rsi(30,0.0232,1.6,0.9,32)} END*(1+0.5*dead)*CASE WHEN ix%7=0 THEN 0.5 ELSE 1 END*CASE WHEN iy%9=0 THEN 0.3 ELSE 1 END AS ros,
 CASE fuel WHEN 'NF' THEN 0 WHEN 'O1' THEN 0.35 WHEN 'C2' THEN 3.6 WHEN 'C3' THEN 2.6 WHEN 'C4' THEN 3.0 WHEN 'D1' THEN 1.0 ELSE con*3.6+(1-con)*1.0 END*(1+0.3*dead) AS tfc FROM f), h AS (SELECT *, 300*tfc*ros AS hfi FROM r)"""


@query(FIRE + " SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, fuel, round(ros,6) AS ros, round(hfi,4) AS hfi, round(CASE WHEN hfi<=0 THEN 0 ELSE 100*greatest(0,least(1,log10(hfi+1)/4))*(0.5+0.5*(0.3+0.7*exp(-ix*5/150e0)))*(0.55+0.30*greatest(0,least(1,exp(-iy*5/200e0)+0.5*exp(-ix*5/60e0)))+0.15*greatest(0,least(1,iy/45e0))) END,6) AS risk FROM h")
def fire_behaviour(spark, sf):
    """H04, H05, H06."""
    c = fire_cells(spark, sf)
    ix, iy = F.col("ix").cast("double"), F.col("iy").cast("double")
    return c.select(big("iy").alias("iy"), big("ix").alias("ix"), "fuel", r6("ros").alias("ros"), F.round("hfi", 4).alias("hfi"), r6(fo.risk_index(F.col("hfi"), ix * 5, iy * 5, ix * 5, iy)).alias("risk"))


@query(FIRE + ", s AS (SELECT CAST(CASE WHEN hfi<10 THEN 0 WHEN hfi<500 THEN 1 WHEN hfi<2000 THEN 2 WHEN hfi<4000 THEN 3 WHEN hfi<10000 THEN 4 ELSE 5 END AS BIGINT) AS intensity FROM h) SELECT intensity, count(*) AS n, round(count(*)/sum(count(*)) OVER (),6) AS share FROM s GROUP BY intensity")
def intensity_shares(spark, sf):
    """A17."""
    from pyspark.sql import Window

    c = fire_cells(spark, sf).groupBy(big(fo.intensity_class(F.col("hfi"))).alias("intensity")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("intensity", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("""WITH t AS (SELECT *, greatest(0.3,h*CASE species WHEN 0 THEN 0.45 WHEN 1 THEN 0.15 ELSE 0.35 END*CASE WHEN health=2 THEN 0.6 ELSE 1 END) AS cbh, edge*8000 AS hfi, emergent AS grass, CASE health WHEN 0 THEN 0.15 WHEN 1 THEN 0.55 ELSE 1 END AS dry FROM v_trees)
 SELECT tree_id, round(cbh,6) AS cbh, round(1-exp(-pow(hfi*(0.20+0.15*grass)/greatest(pow(0.010*cbh*(460+25.9*CASE health WHEN 0 THEN 100 WHEN 1 THEN 80 ELSE 35 END),1.5),1),1.5)),6) AS p_torch,
 round(100*least(1,greatest(0,0.30*dry+0.20*CASE species WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 ELSE 0.25 END+0.15*greatest(0,least(1,1-cbh/6))+0.15*grass+0.20*0.6*(0.5+0.5*dry))),6) AS fire_hazard FROM t""")
def tree_fire_hazard(spark, sf):
    """H10, W09."""
    t = source(spark, sf, "v_trees").withColumns({"hfi": F.col("edge") * 8000, "grass": F.col("emergent")})
    return fire.tree_hazard(t, 0.6).select("tree_id", r6("cbh").alias("cbh"), r6("p_torch").alias("p_torch"), r6("fire_hazard").alias("fire_hazard"))


GRAPH = """WITH RECURSIVE c AS MATERIALIZED (SELECT iy AS y, ix AS x, iy*64+ix AS id, 1+n%5 AS v FROM v_cells),
 e AS MATERIALIZED (SELECT a.id AS s, b.id AS d, 0.5*sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))*100*(1/a.v::DOUBLE+1/b.v::DOUBLE)*0.06 AS w FROM c a JOIN c b ON abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND a.id<>b.id),
 r(k, id, dist) AS (SELECT 0, 0, 0e0 UNION ALL (SELECT k+1, d, min(dist+w) FROM r JOIN e ON r.id=e.s WHERE k<160 GROUP BY k+1, d))"""


def speed_grid(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf, "v_cells").select("iy", "ix", (1 + F.col("n") % 5).cast("double").alias("v"), F.lit(False).alias("blocked"))


@query(GRAPH + " SELECT CAST(id AS BIGINT) AS node, round(min(dist),6) AS dist FROM r GROUP BY id")
def travel_times(spark, sf):
    """Min-plus relaxation over all cells."""
    seeds = spark.range(1).select(F.col("id").alias("node"), F.lit(0.0).alias("dist"))
    return graph.relax(grid_edges(spark, sf), seeds).select("node", r6("dist").alias("dist"))


def grid_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.grid_edges(speed_grid(spark, sf), 64, 100.0)


@query(GRAPH + " SELECT CAST(id AS BIGINT) AS node, round(min(dist),6) AS dist, 'a' AS site FROM r GROUP BY id")
def travel_times_per_site(spark, sf):
    """The same by a priority queue, one site a task."""
    seeds = spark.range(1).select(F.lit("a").alias("site"), F.col("id").alias("node"), F.lit(0.0).alias("dist"))
    return graph.shortest_paths(grid_edges(spark, sf).withColumn("site", F.lit("a")), seeds, "site").select("node", r6("dist").alias("dist"), "site")


@query("""WITH v(vehicle, main, forest, off, bog_v, slope_m, w) AS (VALUES ('fire_engine',60,30,0,0,0,3.0),('ambulance',70,30,0,0,0,2.8),('pickup_4x4',70,40,0,0,0,2.6),('atv',40,30,12,0,20,1.5),('forwarder',20,20,5,2,27,3.0),('foot',5,5,3.5,2,45,0.8)),
 c AS (SELECT iy, ix, (ix+iy)%3 AS road, 1+(ix%4) AS road_w, n_veg/n::DOUBLE AS cover, CAST(iy%30 AS DOUBLE) AS slope, ix%11=0 AS bog, iy%13=0 AS water FROM v_cells),
 t AS (SELECT *, CASE WHEN off<=0 OR slope>slope_m THEN 0 WHEN vehicle='foot' THEN off*6*exp(-3.5*abs(0.7*tan(radians(slope))+0.05))/5*(1-0.4*cover) WHEN cover>0.85 THEN 0 ELSE off*(1-0.75*cover)*(1-slope/greatest(slope_m,1)) END AS ter FROM c CROSS JOIN v)
 SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, vehicle, round(CASE WHEN water THEN 0 WHEN road>0 AND road_w>=w THEN CASE road WHEN 1 THEN main ELSE forest END ELSE CASE WHEN bog THEN least(greatest(0,ter),bog_v) ELSE greatest(0,ter) END END,6) AS kmh FROM t""")
def vehicle_speeds(spark, sf):
    """G08."""
    c = source(spark, sf, "v_cells").select("iy", "ix", ((F.col("ix") + F.col("iy")) % 3).alias("road"), (1 + F.col("ix") % 4).cast("double").alias("road_w"), (F.col("n_veg") / F.col("n")).alias("cover"), (F.col("iy") % 30).cast("double").alias("slope"), (F.col("ix") % 11 == 0).alias("bog"), (F.col("iy") % 13 == 0).alias("water"))
    c = c.crossJoin(F.broadcast(graph.vehicle_table(spark)))  # six vehicles
    return c.select(big("iy").alias("iy"), big("ix").alias("ix"), "vehicle", r6(graph.speed(*map(F.col, ("road", "road_w", "cover", "slope", "bog", "water")))).alias("kmh"))


# ---- fleet
TRAVEL = "SELECT a.node_id AS f, b.node_id AS t, CAST(10+(a.node_id*7+b.node_id*3)%50 AS DOUBLE) AS minutes FROM v_nodes a JOIN v_nodes b ON (a.node_id+b.node_id)%2=0 AND a.node_id<>b.node_id"


def travel(spark: SparkSession, sf: str) -> DataFrame:
    n = source(spark, sf, "v_nodes").select("node_id")
    a, b = n.select(F.col("node_id").alias("from"), (F.col("node_id") % 2).alias("p")), n.select(F.col("node_id").alias("to"), (F.col("node_id") % 2).alias("p"))
    return a.join(b, "p").filter("from <> to").select("from", "to", (10 + (F.col("from") * 7 + F.col("to") * 3) % 50).cast("double").alias("minutes"))


@query(f"WITH t AS ({TRAVEL}), k AS (SELECT minutes, 2*6371.0088*asin(sqrt(pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon)-radians(a.lon))/2),2))) AS km FROM t JOIN v_nodes a ON a.node_id=f JOIN v_nodes b ON b.node_id=t.t), q AS (SELECT * FROM k WHERE km>1), g AS (SELECT regr_slope(minutes,km) AS a, regr_intercept(minutes,km) AS b FROM q) SELECT round(a,6) AS a, round(b,6) AS b, round(avg(abs(minutes-a*km-b)),6) AS mae FROM q CROSS JOIN g GROUP BY a, b")
def travel_fit(spark, sf):
    """A20, S17."""
    out = fleet.travel_fit(source(spark, sf, "v_nodes"), travel(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"WITH t AS ({TRAVEL}), n AS (SELECT a.node_id AS f, b.node_id AS t, 2*6371.0088*asin(sqrt(greatest(0,least(1,pow(sin((radians(b.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin((radians(b.lon)-radians(a.lon))/2),2))))) AS km FROM v_nodes a CROSS JOIN v_nodes b) SELECT CAST(n.f AS BIGINT) AS f, CAST(n.t AS BIGINT) AS t, round(CASE WHEN n.f=n.t THEN 0 ELSE coalesce(t.minutes, 0.9*km+5) END,6) AS minutes FROM n LEFT JOIN t ON t.f=n.f AND t.t=n.t")
def travel_matrix(spark, sf):
    """J17, Q01."""
    return fleet.travel_matrix(source(spark, sf, "v_nodes"), travel(spark, sf), 0.9, 5.0).select(big("from").alias("f"), big("to").alias("t"), r6("minutes").alias("minutes"))


@query(f"""WITH t AS ({TRAVEL}), o AS (SELECT n_nationkey AS op_id, n_nationkey AS node_id, 300+n_nationkey*10 AS left_, n_nationkey%3=0 AS ms FROM nation), k AS (SELECT *, setup_min+flight_min AS duration, release_d + CAST(task_id%20 AS INT) AS due_d FROM v_tasks WHERE release_d<=DATE '1998-06-01'),
 s AS (SELECT o.op_id, k.task_id, prio*CASE WHEN sl>=0 THEN 1+3/(1+sl)::DOUBLE ELSE 4+0.5*least(-sl,10) END*100/(minutes+duration+30)*CASE WHEN ms AND NOT needs_ms THEN 0.6 ELSE 1 END AS score FROM (SELECT *, datediff('day', DATE '1998-06-01', due_d) AS sl FROM k) k JOIN t ON t.t=k.node_id JOIN o ON o.node_id=t.f WHERE minutes+duration<=left_ AND (NOT needs_ms OR ms))
 SELECT CAST(op_id AS BIGINT) AS op_id, task_id, round(score,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY score DESC, task_id) AS k FROM s) q WHERE k=1""")
def best_tasks(spark, sf):
    """J16, Q02, W13, O05."""
    o = source(spark, sf, "nation").select(F.col("n_nationkey").alias("op_id"), F.col("n_nationkey").alias("node_id"), (300 + F.col("n_nationkey") * 10).alias("minutes_left"), (F.col("n_nationkey") % 3 == 0).alias("has_ms"))
    t = source(spark, sf, "v_tasks").withColumns({"duration": F.col("setup_min") + F.col("flight_min"), "due_d": F.date_add("release_d", (F.col("task_id") % 20).cast("int"))})
    best = fleet.best_per_operator(fleet.candidate_scores(o, t, travel(spark, sf), F.lit("1998-06-01").cast("date")))
    return best.select(big("op_id").alias("op_id"), "task_id", r6("score").alias("score"))


@query("""WITH k AS (SELECT task_id, lat, lon, area_ha, 2*6371.0088*asin(sqrt(pow(sin((radians(lat)-radians(62.9))/2),2)+cos(radians(62.9))*cos(radians(lat))*pow(sin((radians(lon)-radians(27.7))/2),2))) AS km FROM v_tasks JOIN v_nodes USING (node_id)), g AS (SELECT *, 32*(1-0.45*pow(km/250,2)) AS gust, greatest(20,0.5*area_ha) AS area FROM k WHERE km<=250)
 SELECT task_id, round(km,6) AS km, round(gust,6) AS gust, area::DOUBLE AS area, round(pow(greatest(gust-15,0),2)*area/100,6) AS exposure FROM g""")
def storm_tasks(spark, sf):
    """Q05."""
    t = source(spark, sf, "v_tasks").join(F.broadcast(source(spark, sf, "v_nodes")), "node_id")
    return fleet.storm_tasks(t, 62.9, 27.7, 250.0, 32.0).select("task_id", r6("km").alias("km"), r6("gust").alias("gust"), F.col("area").cast("double").alias("area"), r6("exposure").alias("exposure"))


@query()
def fleet_plan(spark, sf):
    """Q03, Q04, Q06: three scenarios planned in parallel by the greedy planner."""
    scenarios = F.explode(F.array(*map(F.lit, ("none", "emergency", "uniform")))).alias("scenario")
    t = source(spark, sf, "v_tasks").select(scenarios, "*")
    late = F.datediff("release_d", F.lit("1995-01-01").cast("date")) % 20
    t = t.select("scenario", "task_id", F.col("node_id").cast("long").alias("node_id"), late.alias("release"), (late + 3 + F.col("task_id") % 7).cast("int").alias("due"), (F.col("setup_min") + F.col("flight_min")).cast("double").alias("duration"), F.when((F.col("scenario") == "emergency") & (F.col("task_id") % 300 == 0), 12.0).when(F.col("scenario") == "uniform", 3.0).otherwise(F.col("prio")).alias("prio"), "needs_ms", "area_ha")
    s = source(spark, sf, "nation").select(scenarios, big("n_nationkey").alias("op_id"), big("n_nationkey").alias("home"), (F.col("n_nationkey") % 3 == 0).alias("has_ms"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("day"), F.lit(480).alias("start"), F.lit(960).alias("end"))
    m = fleet.travel_matrix(source(spark, sf, "v_nodes"), travel(spark, sf), 0.9, 5.0).select(scenarios, big("from").alias("from"), big("to").alias("to"), "minutes")
    return fleet.kpis(fleet.schedule(t, s, m), t)


@query()
def storm_response(spark, sf):
    """Q06, Q04, Q05: a storm in the midst of a running plan, three ways from one warm start, each region a plan of its own."""
    nodes = source(spark, sf, "v_nodes").join(source(spark, sf, "nation").select(F.col("n_nationkey").alias("node_id"), F.col("n_regionkey").alias("region")), "node_id")
    late = F.datediff("release_d", F.lit("1995-01-01").cast("date")) % 20
    v = source(spark, sf, "v_tasks").join(nodes, "node_id")
    t = v.select("region", "task_id", big("node_id").alias("node_id"), late.alias("release"), (late + 3 + F.col("task_id") % 7).cast("int").alias("due"), (F.col("setup_min") + F.col("flight_min")).cast("double").alias("duration"), "prio", "needs_ms")
    hit = fleet.storm_tasks(v, 62.9, 27.7, 150.0, 32.0)
    storm = hit.select("region", (F.col("task_id") + 10**9).alias("task_id"), "node_id", (10 + 0.6 * F.col("area")).alias("duration"), "exposure")
    s = nodes.select("region", big("node_id").alias("op_id"), big("node_id").alias("home"), (F.col("node_id") % 3 == 0).alias("has_ms"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("day"), F.lit(480).alias("start"), F.lit(960).alias("end"))
    m = fleet.travel_matrix(source(spark, sf, "v_nodes"), travel(spark, sf), 0.9, 5.0)
    ends = nodes.select("region", F.col("node_id").alias("from")).join(nodes.select(F.col("region").alias("r"), F.col("node_id").alias("to")), F.col("region") == F.col("r"))
    m = ends.join(m, ["from", "to"]).select("region", big("from").alias("from"), big("to").alias("to"), "minutes")
    _, figures = fleet.storm_response(t, s, m, storm, 10)
    return figures.select(big("region").alias("region"), "branch", "n_storm", "storm_done", "within_24h", "within_48h", r6("exposure_hours").alias("exposure_hours"), "regular_done", r6("regular_on_time").alias("regular_on_time"), r6("high_on_time").alias("high_on_time"), "delayed")


@query("SELECT mode, CASE WHEN species IS NULL THEN -1 ELSE species END::BIGINT AS species, CASE WHEN health IS NULL THEN -1 ELSE health END::BIGINT AS health, n FROM (SELECT 'inventory' AS mode, species, health, count(*) AS n FROM v_trees GROUP BY ROLLUP (species, health)) q")
def inventory(spark, sf):
    """Counts by species and health with subtotals."""
    t = source(spark, sf, "v_trees").rollup("species", "health").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.lit("inventory").alias("mode"), big(F.coalesce("species", F.lit(-1))).alias("species"), big(F.coalesce("health", F.lit(-1))).alias("health"), "n")


# ---- sites
SPREAD = """WITH RECURSIVE c AS MATERIALIZED (SELECT iy AS y, ix AS x, iy*64+ix AS id, 1+n%5 AS ros, (ix+2*iy)::DOUBLE AS z FROM v_cells),
 k AS (SELECT sqrt(1-1/(lb*lb)) AS ecc FROM (SELECT 1+8.729*pow(1-exp(-0.03*20),2.155) AS lb) q),
 e AS MATERIALIZED (SELECT a.id AS s, b.id AS d, 0.5*len*(1/a.ros::DOUBLE+1/b.ros::DOUBLE)/((1-ecc)/(1-ecc*cos(atan2(b.y-a.y,b.x-a.x)-radians(0)))*CASE WHEN b.z>a.z THEN exp(3.533*pow(least(1,(b.z-a.z)/len),1.2)) ELSE exp(-0.5*abs((b.z-a.z)/len)) END) AS w
   FROM (SELECT a.id AS ai, b.id AS bi, 20*sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS len FROM c a JOIN c b ON a.id<>b.id AND abs(a.x-b.x)<=2 AND abs(a.y-b.y)<=2 AND (greatest(abs(a.x-b.x),abs(a.y-b.y))=1 OR abs(a.x-b.x)+abs(a.y-b.y)=3)) p JOIN c a ON a.id=ai JOIN c b ON b.id=bi CROSS JOIN k),
 r(k, id, dist) AS (SELECT 0, 195, 0e0 UNION ALL (SELECT k+1, d, min(dist+w) FROM r JOIN e ON r.id=e.s WHERE k<160 AND dist+w<=240 GROUP BY k+1, d)), m AS (SELECT id, min(dist) AS arrival FROM r GROUP BY id)"""


def spreading(spark: SparkSession, sf: str) -> DataFrame:
    c = source(spark, sf, "v_cells").select("iy", "ix", (1 + F.col("n") % 5).cast("double").alias("ros"), (F.col("ix") + 2 * F.col("iy")).cast("double").alias("z"))
    return site.fire_arrival(c, 64, 20.0, 20.0, 270.0, [(3, 3)])


@query(SPREAD + " SELECT CAST(id//64 AS BIGINT) AS iy, CAST(id%64 AS BIGINT) AS ix, round(arrival,6) AS arrival, CAST(floor(arrival/30)*30 AS BIGINT) AS band FROM m")
def fire_spread(spark, sf):
    """Wind-driven spread over sixteen neighbours, and its isochrones."""
    a = spreading(spark, sf)
    return a.select(big("iy").alias("iy"), big("ix").alias("ix"), r6("arrival").alias("arrival"), big(fire.isochrone(F.col("arrival"))).alias("band"))


@query(SPREAD + ", b AS (SELECT building_id AS asset_id, x/2 AS x, y/2 AS y, 30e0 AS r FROM v_buildings) SELECT asset_id, round(min(arrival),6) AS minutes FROM b LEFT JOIN (SELECT id%64 AS ix, id//64 AS iy, arrival FROM m) m ON pow((ix+0.5)*20-b.x,2)+pow((iy+0.5)*20-b.y,2)<=900 GROUP BY asset_id")
def fire_impacts(spark, sf):
    """H11, A26, O03."""
    b = source(spark, sf, "v_buildings").select(F.col("building_id").alias("asset_id"), (F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y"), F.lit(30.0).alias("r"))
    return site.fire_impacts(spreading(spark, sf), b, 20.0).select("asset_id", r6("minutes").alias("minutes"))


@query(SPREAD + " SELECT h::DOUBLE AS hours, round(count(*)*0.04e0,6) AS ha FROM m JOIN (SELECT unnest([0.5,1,2,4]) AS h) t ON ceil(arrival)<=h*60 GROUP BY h")
def burned_area(spark, sf):
    """H11."""
    return site.burned_area(spreading(spark, sf), 20.0).select("hours", r6("ha").alias("ha"))


@query(f"""WITH t AS (SELECT *, {DBH} AS dbh FROM v_trees), f AS (SELECT *, h/greatest(dbh/100,0.02) AS hd, (tree_id%8)/16e0 AS wp, (tree_id%4)/16e0 AS wb FROM t), p AS (SELECT *, {FAIL.format(g=25, soil="0.6*0.9")} AS p FROM f)
 SELECT count(*) AS trees, sum((health=2)::INT)::BIGINT AS dead, sum((health=1)::INT)::BIGINT AS stressed, sum((wp>0)::INT)::BIGINT AS reach_line, count(*) AS reach_any, round(avg(h),6) AS mean_h, round(quantile_cont(h,0.95),6) AS h_p95, round(sum(p),6) AS expected_falls, round(1-exp(sum(ln(1-least(p*wp,0.999999)))),6) AS p_outage FROM p""")
def site_summary(spark, sf):
    """A23, A13."""
    out = site.summary(stormy(spark, sf))
    return out.select("trees", "dead", "stressed", "reach_line", "reach_any", *[r6(c).alias(c) for c in ("mean_h", "h_p95", "expected_falls", "p_outage")])


@query("""WITH s AS (SELECT building_id, kind, CASE kind WHEN 'care_home' THEN 3.0 WHEN 'school' THEN 2.5 WHEN 'cabin' THEN 0.8 ELSE 1.0 END AS sens, (building_id*13)%100 AS fr, (building_id%7)/100e0 AS st, (building_id%40)::DOUBLE AS rm, (building_id*11)%300 AS rd FROM v_buildings),
 q AS (SELECT *, 0.35*least(sens/3,1)+0.65*(0.4*greatest(0,least(1,(fr-20)/60e0))+0.35*least(st/0.05,1)+0.25*(least(greatest(rm-3,0)/15,1)*0.5+CASE WHEN rd>150 THEN 0.5 ELSE 0 END)) AS score FROM s) SELECT building_id, round(score,6) AS score, CASE WHEN score>=0.55 THEN 'high' WHEN score>=0.35 THEN 'medium' ELSE 'low' END AS level FROM q""")
def structure_ranking(spark, sf):
    """G16."""
    k = F.col("building_id")
    b = source(spark, sf, "v_buildings").withColumns({"weight": F.lit(0.0), "fire_risk": ((k * 13) % 100).cast("double"), "strikes": (k % 7) / 100, "trees_in_reach": F.lit(1), "response_min": (k % 40).cast("double"), "road_dist": ((k * 11) % 300).cast("double")})
    return plan.structure_scores(b).select("building_id", r6("score").alias("score"), "level")


@query("""WITH v(vehicle, m, c, d, s, suits) AS (VALUES ('fire_engine',12e0,2e0,20e0,0e0,true),('ambulance',9e0,0e0,15e0,0.3e0,false),('pickup_4x4',11e0,3e0,30e0,0e0,true),('atv',15e0,1e0,10e0,0e0,true),('forwarder',40e0,0.5e0,12e0,0e0,true),('foot',25e0,0e0,8e0,0e0,true)),
 q AS (SELECT *, (m+c)*(1+d/40)*(1+3*s)*CASE WHEN suits THEN 1 ELSE 1e6 END AS score FROM v) SELECT vehicle, true AS ok, suits, round(m+c,6) AS expected_minutes, round(score,6) AS score, vehicle='fire_engine' AS is_best, vehicle=(SELECT arg_min(vehicle,m+c) FROM q WHERE suits) AS is_fastest, vehicle=(SELECT arg_min(vehicle,d) FROM q WHERE suits) AS is_safest FROM q""")
def emergency_plan(spark, sf):
    """The engine built for the mission goes where it gets through."""
    rows = [("fire_engine", 12.0, 2.0, 20.0, 0.0), ("ambulance", 9.0, 0.0, 15.0, 0.3), ("pickup_4x4", 11.0, 3.0, 30.0, 0.0), ("atv", 15.0, 1.0, 10.0, 0.0), ("forwarder", 40.0, 0.5, 12.0, 0.0), ("foot", 25.0, 0.0, 8.0, 0.0)]
    o = spark.createDataFrame([(v, True, m, c, d, s) for v, m, c, d, s in rows], "vehicle string, ok boolean, minutes double, clearing double, danger double, stuck double")
    return plan.plan_emergency(o, "fire").select("vehicle", "ok", "suits", r6("expected_minutes").alias("expected_minutes"), r6("score").alias("score"), "is_best", "is_fastest", "is_safest")


@query("""WITH n AS (SELECT sum((cls=14)::INT) AS w, median(z) FILTER (cls=2) AS g FROM v_points), s AS (SELECT ax,ay,bx,by_ FROM v_segments), p AS (SELECT src_key, ret_no, x, y, z, cls FROM v_points),
 h AS (SELECT p.*, EXISTS (SELECT 1 FROM s WHERE sqrt(pow(x-(ax+greatest(0,least(1,((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/1600e0))*(bx-ax)),2)+pow(y-(ay+greatest(0,least(1,((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/1600e0))*(by_-ay)),2))<=2.5) AS near FROM p)
 SELECT CAST(CASE WHEN near AND cls NOT IN (2,9) AND z-g>4 AND z-g<40 THEN 14 ELSE cls END AS BIGINT) AS cls, count(*) AS n FROM h CROSS JOIN (SELECT median(z) FILTER (cls=2) AS g FROM p) m GROUP BY 1""")
def wire_labels(spark, sf):
    """W05, V11."""
    p = source(spark, sf, "v_points").select("x", "y", "z", "cls")
    return site.label_wires(p, source(spark, sf, "v_segments"), 2.5, 10**9).groupBy(big("cls").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tree_id, CAST(c.n AS BIGINT) AS n, c.z_max FROM v_trees t JOIN v_cells c ON c.iy=CAST(floor(t.y/2/5) AS INT) AND c.ix=CAST(floor(t.x/2/5) AS INT)")
def tree_cells(spark, sf):
    """Equi-join on derived cells."""
    t = source(spark, sf, "v_trees").select("tree_id", F.floor(F.col("y") / 10).cast("int").alias("iy"), F.floor(F.col("x") / 10).cast("int").alias("ix"))
    return t.join(source(spark, sf, "v_cells"), ["iy", "ix"]).select("tree_id", "n", "z_max")


# ---- rules and small tables
@query("""SELECT tree_id, CAST(CASE WHEN v<(CASE WHEN species=2 THEN 0.20 ELSE 0.15 END) THEN 2 WHEN v<(CASE WHEN species=2 THEN 0.45 ELSE 0.40 END) THEN 1 ELSE 0 END AS BIGINT) AS by_ndvi,
 CAST(CASE WHEN z< -3.2 OR (d<0.45*40 AND z< -2) THEN 2 WHEN z< -2 THEN 1 ELSE 0 END AS BIGINT) AS by_intensity, CAST(CASE WHEN edge<0.11 AND emergent>0.35 THEN 1 WHEN h/10>1.45 THEN 2 ELSE 0 END AS BIGINT) AS species
 FROM (SELECT *, (tree_id % 17)/16e0 AS v, (tree_id % 9)/1e0-6 AS z, (tree_id % 50)/1e0 AS d FROM v_trees) t""")
def tree_rules(spark, sf):
    """M05's rule, M06, M07: species and health where no model is at hand."""
    k, t = F.col("tree_id"), source(spark, sf, "v_trees")
    ndvi, z, density = (k % 17) / 16, (k % 9) - 6.0, (k % 50).cast("double")
    return t.select("tree_id", big(trees.health_by_ndvi(ndvi, F.col("species"))).alias("by_ndvi"), big(trees.health_by_intensity(z, density, F.lit(40.0))).alias("by_intensity"), big(trees.species_rule(F.col("edge"), F.col("emergent"), F.col("h") / 10)).alias("species"))


@query("SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, round(greatest(0, cos(radians(45))*cos(radians(s))+sin(radians(45))*sin(radians(s))*cos(radians(315-a))),6) AS shade FROM (SELECT iy, ix, (n % 60)/1e0 AS s, (n_veg*7 % 360)/1e0 AS a FROM v_cells) c")
def shaded(spark, sf):
    """R16."""
    c = source(spark, sf, "v_cells")
    return c.select(big("iy").alias("iy"), big("ix").alias("ix"), r6(sinks.hillshade((F.col("n") % 60).cast("double"), (F.col("n_veg") * 7 % 360).cast("double"))).alias("shade"))


@query("""SELECT CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, CASE WHEN d>0.45 THEN 'dead' WHEN y+0.5*d>0.3 THEN 'stressed' ELSE 'healthy' END AS health,
 CASE WHEN w OR p< -60 THEN 'above' WHEN p> -45 THEN 'ground' WHEN s>0.12 THEN 'ground' ELSE 'above' END AS view FROM (SELECT iy, ix, (n % 64)/64e0 AS d, (n_veg % 32)/64e0 AS y, ix % 7 = 0 AS w, -(n % 90)/1e0 AS p, (n_veg % 16)/64e0 AS s FROM v_cells) c""")
def picture_rules(spark, sf):
    """X01's view, X02's rule."""
    c = source(spark, sf, "v_cells")
    health = discover.aerial_health((F.col("n") % 64) / 64, (F.col("n_veg") % 32) / 64)
    view = discover.photo_view(F.col("ix") % 7 == 0, -(F.col("n") % 90).cast("double"), (F.col("n_veg") % 16) / 64)
    return c.select(big("iy").alias("iy"), big("ix").alias("ix"), health.alias("health"), view.alias("view"))


@query("""SELECT tree_id, CASE WHEN corridor>=11.5 AND h*4>=60 THEN 'main' ELSE 'forest' END AS cls, round(greatest(3,least(8,corridor-5.5)),6) AS width, round(c,6) AS confidence
 FROM (SELECT *, 0.45*emergent+0.25*edge*1.6+0.3*(1-least((crown_area/10)/0.6,1)) AS c, crown_area*3 AS corridor FROM v_trees) t WHERE round(c,9)>=0.6 AND emergent>=0.5 AND corridor>=5.5""")
def road_network(spark, sf):
    """Class, width and confidence of segments that pass the gates; a row per tree stands for a segment."""
    t = source(spark, sf, "v_trees").select("tree_id", (F.col("h") * 4).alias("length"), (F.col("crown_area") * 3).alias("corridor"), F.col("emergent").alias("side"), (F.col("edge") * 1.6).alias("straight"), (F.col("crown_area") / 10).alias("width_cv"))
    return discover.road_segments(t).select("tree_id", "cls", r6("width").alias("width"), r6("confidence").alias("confidence"))


@query("SELECT round(sum(e*(24*d+(480+m)/60e0+2))/greatest(sum(e),1e-6),6) AS hours FROM (SELECT area_ha/100e0 AS e, task_id % 5 AS d, flight_min AS m FROM v_tasks) t")
def hours_to_data(spark, sf):
    """Q07: exposure-weighted hours from storm to data."""
    t = source(spark, sf, "v_tasks").select((F.col("area_ha") / 100).alias("exposure"), (F.col("task_id") % 5).alias("days"), F.lit(480.0).alias("start"), F.col("flight_min").cast("double").alias("duration"))
    return fleet.exposure_weighted_hours(t).select(r6("hours").alias("hours"))


@query("SELECT CASE task_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS scenario, CAST(task_id % 44 AS BIGINT) AS day, count(*) AS n FROM v_tasks GROUP BY 1,2")
def assignments_per_day(spark, sf):
    """A29."""
    t = source(spark, sf, "v_tasks").select(F.element_at(F.array(*map(F.lit, "abc")), (F.col("task_id") % 3 + 1).cast("int")).alias("scenario"), (F.col("task_id") % 44).alias("day"))
    return fleet.per_day(t).select("scenario", big("day").alias("day"), "n")


@query("SELECT series, CAST(seq AS BIGINT) AS seq, round(rain,6) AS rain FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY seq DESC) AS back FROM v_days) d WHERE back<=21")
def last_days(spark, sf):
    """The last 21 rows of each series."""
    return weather.last_rows(source(spark, sf, "v_days"), "series", "seq").select("series", big("seq").alias("seq"), r6("rain").alias("rain"))


@query("SELECT series, CAST(seq AS BIGINT) AS seq, round(0.6*greatest(0,least(1,(rh-70)/25))+0.4*greatest(0,least(1,t_c*3/80)),6) AS dryness FROM v_days")
def dryness_of_days(spark, sf):
    """H09."""
    return source(spark, sf, "v_days").select("series", big("seq").alias("seq"), r6(fo.dryness(F.col("rh"), F.col("t_c") * 3)).alias("dryness"))


@query("SELECT kind, discovered, count(*) AS n, count(r) AS n_r FROM (SELECT kind, r, false AS discovered FROM v_buildings UNION ALL SELECT cls, NULL, true FROM v_segments) u GROUP BY 1,2")
def mapped_and_discovered(spark, sf):
    """U02."""
    u = discover.united(source(spark, sf, "v_buildings").select("kind", "r"), source(spark, sf, "v_segments").select(F.col("cls").alias("kind")))
    return u.groupBy("kind", "discovered").agg(F.count(F.lit(1)).alias("n"), F.count("r").alias("n_r"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '[^A-Za-z0-9._-]', '_', 'g') AS name, substr(sha1(url),1,24) AS key FROM pages")
def landed_names(spark, sf):
    """names and keys of landed files."""
    return source(spark, sf, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"), text.cache_key(F.col("url")).alias("key"))


@query("""SELECT 'house_value' AS key, 12345e0 AS value, 'user' AS basis UNION ALL SELECT 'felling_cost_per_tree', 80e0, 'assumption'""")
def user_costs(spark, sf):
    """A user's value for a known key wins, unknown keys are ignored."""
    user = source(spark, sf, "nation").filter("n_nationkey < 2").select(F.when(F.col("n_nationkey") == 0, "house_value").otherwise("nothing").alias("key"), F.lit(12345.0).alias("value"))
    return costs.merged(costs.defaults(spark), user).filter(F.col("key").isin("house_value", "felling_cost_per_tree")).select("key", "value", "basis")


from boreal.plans import land  # noqa: E402, F401  registers its queries
