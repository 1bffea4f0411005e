"""Views that give the driver's tables the shapes of forest data. One SQL text each, which Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_points": """SELECT l_orderkey AS src_key, l_linenumber AS ret_no,
 CAST(l_orderkey % 200 AS DOUBLE) + l_quantity/64e0 AS x, CAST(l_partkey % 200 AS DOUBLE) + l_linenumber/8e0 AS y,
 100e0 + CAST((l_orderkey % 200 + 2*(l_partkey % 200)) % 16 AS DOUBLE)/8e0
   + CASE WHEN l_returnflag='R' THEN 0e0 WHEN l_returnflag='N' THEN l_quantity/2e0 WHEN l_linestatus='F' THEN 1.5e0 ELSE 9e0 END AS z,
 CASE WHEN l_returnflag='R' THEN 2 WHEN l_returnflag='N' THEN 5 WHEN l_linestatus='F' THEN 3 WHEN l_suppkey % 4 = 0 THEN 14 WHEN l_suppkey % 4 = 1 THEN 6 ELSE 9 END AS cls,
 CAST(l_suppkey % 256 AS INT) AS red, CAST((l_suppkey*3) % 256 AS INT) AS nir, CAST((l_partkey*7) % 1024 AS INT) AS intensity FROM lineitem""",
    "v_trees": """SELECT p_partkey AS tree_id, CAST((p_partkey*37) % 400 AS DOUBLE)+0.5e0 AS x, CAST((p_partkey*91) % 400 AS DOUBLE)+0.25e0 AS y,
 3e0 + p_size/2e0 AS h, CAST(p_partkey % 3 AS INT) AS species, CASE WHEN p_partkey % 10 = 0 THEN 2 WHEN p_partkey % 10 < 3 THEN 1 ELSE 0 END AS health,
 2e0 + (p_size % 16)/4e0 AS crown_area, CAST(p_partkey % 5 AS DOUBLE)/8e0 AS edge, CAST(p_partkey % 7 AS DOUBLE)/8e0 AS emergent, CASE WHEN p_partkey % 6 = 0 THEN 1e0 ELSE 0e0 END AS peat FROM part""",
    "v_buildings": """SELECT s_suppkey AS building_id, CAST((s_suppkey*53) % 400 AS DOUBLE) AS x, CAST((s_suppkey*29) % 400 AS DOUBLE) AS y, CAST(5 + s_suppkey % 8 AS DOUBLE) AS r,
 CASE s_nationkey % 5 WHEN 0 THEN 'care_home' WHEN 1 THEN 'cabin' WHEN 2 THEN 'school' ELSE 'house' END AS kind FROM supplier""",
    "v_segments": """SELECT n_nationkey AS seg_id, n_regionkey AS line_id, CAST((n_nationkey*16) % 400 AS DOUBLE) AS ax, CAST((n_nationkey*48) % 400 AS DOUBLE) AS ay,
 CAST((n_nationkey*16) % 400 + 24 AS DOUBLE) AS bx, CAST((n_nationkey*48) % 400 + 32 AS DOUBLE) AS by_, CASE WHEN n_nationkey % 5 = 0 THEN 'main' ELSE 'forest' END AS cls FROM nation""",
    "v_obs": "SELECT user_id % 20 AS station_id, event_type AS param, ts, event_id, value, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM events",
    "v_days": """SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY d) - 1 AS INT) AS seq, CAST(5 + n % 25 AS DOUBLE) AS t_c, CAST(20 + sk % 75 AS DOUBLE) AS rh, CAST(n % 40 AS DOUBLE) AS w_kmh,
 CASE WHEN sk % 4 = 1 THEN CAST(sk % 120 AS DOUBLE)/8e0 ELSE 0e0 END AS rain, CAST(month(d) AS INT) AS mon
 FROM (SELECT event_type AS series, CAST(ts AS DATE) AS d, count(*) AS n, sum(CAST(regexp_extract(props,'([0-9]+)',1) AS INT)) AS sk FROM events GROUP BY event_type, CAST(ts AS DATE)) q""",
    "v_tasks": """SELECT o_orderkey AS task_id, o_custkey % 25 AS node_id, CAST(o_orderdate AS DATE) AS release_d, CAST(10 + o_orderkey % 30 AS INT) AS setup_min, CAST(20 + o_custkey % 120 AS INT) AS flight_min,
 CASE o_orderpriority WHEN '1-URGENT' THEN 3e0 WHEN '2-HIGH' THEN 3e0 WHEN '3-MEDIUM' THEN 2e0 ELSE 1e0 END AS prio, (o_orderkey % 10 < 3) AS needs_ms, CAST(20 + o_orderkey % 300 AS INT) AS area_ha FROM orders""",
    "v_nodes": "SELECT n_nationkey AS node_id, 60e0 + n_nationkey/4e0 AS lat, 21e0 + CAST((n_nationkey*7) % 25 AS DOUBLE)/4e0 AS lon FROM nation",
    "v_cells": """SELECT CAST(floor(y/5e0) AS INT) AS iy, CAST(floor(x/5e0) AS INT) AS ix, CAST(count(*) AS BIGINT) AS n, max(z) AS z_max, CAST(sum(CASE WHEN cls=5 THEN 1 ELSE 0 END) AS BIGINT) AS n_veg FROM v_points GROUP BY 1,2""",
    # sites of 200 m x 200 m, one for each 7,500 orders: forest with a winding road, a branch off it, a road apart from both, and in most sites a field between
    "v_land": """SELECT site, iy, ix, count(*) AS n, CASE WHEN road THEN 0e0 WHEN field THEN 1.75e0 ELSE max(h) END AS chm, avg(100e0 + x/41e0 + y/53e0) AS dtm, avg(CASE WHEN road OR field OR flag='R' THEN 1e0 ELSE 0e0 END) AS ground_share
 FROM (SELECT *, iy = 8 + abs((ix + 5*site) % 24 - 12) OR ix = 30 AND iy >= 8 + abs((30 + 5*site) % 24 - 12) OR iy = 33 AND ix <= 18 AS road, iy BETWEEN 31 AND 35 AND site % 3 < 2 AS field
  FROM (SELECT CAST(floor(l_orderkey/7500e0) AS INT) AS site, CAST(floor((l_partkey % 200 + l_linenumber/8e0)/5e0) AS INT) AS iy, CAST(floor((l_orderkey % 200 + l_quantity/64e0)/5e0) AS INT) AS ix,
   l_orderkey % 200 + l_quantity/64e0 AS x, l_partkey % 200 + l_linenumber/8e0 AS y, 5e0 + l_quantity/4e0 AS h, l_returnflag AS flag FROM lineitem) p) q GROUP BY site, iy, ix, road, field""",
    # the returns over the same cells; every other site has no near infrared, every third of these no intensity
    "v_returns": """SELECT site, iy, ix, h AS hag, CASE WHEN flag='R' THEN 2 ELSE 5 END AS cls, CAST(sk % 200 AS INT) AS red, CAST((sk*5) % 256 AS INT) AS green, CASE WHEN site % 2 = 0 THEN CAST((sk*3) % 256 AS INT) ELSE 0 END AS nir, CASE WHEN site % 6 = 5 THEN 0 ELSE CAST((pk*7 + iy*ix) % 1024 AS INT) END AS intensity
 FROM (SELECT CAST(floor(l_orderkey/7500e0) AS INT) AS site, CAST(floor((l_partkey % 200 + l_linenumber/8e0)/5e0) AS INT) AS iy, CAST(floor((l_orderkey % 200 + l_quantity/64e0)/5e0) AS INT) AS ix, 5e0 + l_quantity/4e0 AS h, l_returnflag AS flag, l_suppkey AS sk, l_partkey AS pk FROM lineitem) p""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for table in TABLES + list(VIEWS):
        sql = re.sub(rf"\bFROM {table}\b", f"FROM {{{table}}}", sql)
    return spark.sql(sql, **{t: source(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def with_views(body: str) -> str:
    """DuckDB SQL: body preceded by the views that it names."""
    def needs(text: str) -> list[str]:
        out: list[str] = []
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text):
                out += [*needs(VIEWS[v]), v]
        return out

    used = list(dict.fromkeys(needs(body)))
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    rest = body[15:] if recursive else body[5:] if body.upper().startswith("WITH ") else None
    return f"WITH {'RECURSIVE ' * recursive}{head}{', ' if rest else ' '}{rest or body}" if used else body
