import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from boreal.operators import discover, graph, plan, trees
from boreal.sources import ingest, sinks


def put(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_map_elements(spark, tmp_path):
    g = [{"lon": 27.0, "lat": 62.0}, {"lon": 27.2, "lat": 62.4}]
    e = [
        {"type": "way", "id": 1, "tags": {"highway": "secondary", "ref": "55"}, "geometry": g}, {"type": "way", "id": 1, "tags": {"highway": "secondary"}, "geometry": g[:1]},
        {"type": "way", "id": 2, "tags": {"highway": "track"}, "geometry": g}, {"type": "way", "id": 3, "tags": {"power": "minor_line", "voltage": "20000;400"}, "geometry": g},
        {"type": "way", "id": 4, "tags": {"building": "yes", "amenity": "nursing_home", "name": "Home"}, "geometry": g}, {"type": "node", "id": 5, "lat": 62.1, "lon": 27.1, "tags": {"amenity": "fire_station"}},
    ]
    m = ingest.map_elements(spark, put(tmp_path / "o.json", {"elements": e}))
    assert m.count() == 5
    r = {x.id: x for x in ingest.roads(m).collect()}
    assert (r[1].name, r[1].cls, r[1].width, len(r[1].path)) == ("55", "main", 7.0, 2) and r[2].width == 3.5
    p = ingest.power_lines(m).first()
    assert (p.kv, p.conductor_h, p.row_half) == (20.0, 9.0, 5.0)
    b = ingest.buildings(m).first()
    assert (b.kind, b.weight, b.r) == ("care_home", 3.0, 8.0) and abs(b.lat - 62.2) < 1e-9
    assert ingest.fire_stations(m, 62.0, 27.0).first().name == "Fire station"


def test_register_stands_and_context(spark, tmp_path):
    f = lambda g, c, **p: {"type": "Feature", "geometry": {"type": g, "coordinates": c}, "properties": p}
    path = put(tmp_path / "r.json", {"features": [f("LineString", [[0, 0], [1, 1]], kohdeluokka=12141), f("Point", [5, 6], kohdeluokka=42231), f("Point", [5, 6], kohdeluokka=1, kayttotarkoitus=2), f("Polygon", [[[0, 0], [10, 0], [10, 10], [0, 10]]], standid=7, maintreespecies=2, meanheight=12)]})
    fe = ingest.features(spark, path)
    assert ingest.register_roads(fe).first().width == 4.0
    assert sorted(r.kind for r in ingest.register_buildings(fe.filter("geometry = 'Point'")).collect()) == ["cabin", "public"]
    t = spark.createDataFrame([(1, 2.0, 2.0, 1, 9.0), (2, 3.0, 3.0, 0, 4.0), (3, 50.0, 3.0, 0, 90.0)], "tree_id long, x double, y double, species int, crown_area double")
    c = ingest.stand_check(ingest.stands(fe), t).first()
    assert c.registered == 1 and c.found == 1 and c.agrees
    kv = fe.select(ingest.register_voltage(F.create_map(F.lit("Jannite"), F.lit("20000")))).first()[0]
    assert kv == 20.0
    ctx = ingest.context(spark, put(tmp_path / "c.json", {"features": [f("LineString", [[0, 0], [1, 1]], kind="road", **{"class": "main"}), f("LineString", [[0, 0]], kind="powerline"), f("Point", [1, 2], kind="depot"), f("Point", [3, 4], type="cabin")]}))
    assert (ctx["roads"].first().width, ctx["powerlines"].first().kv, ctx["depot"].first().lat, ctx["buildings"].first().kind) == (7.0, 20.0, 2.0, "cabin")
    assert {r.source: r.n for r in ingest.source_status(a=ctx["roads"], b=ctx["depot"].limit(0)).collect()} == {"a": 1, "b": 0}


def test_xml_scenes_photos_fleet(spark, tmp_path):
    m = "<wfs:member><BsWfs:BsWfsElement><BsWfs:Location><gml:Point><gml:pos>62.5 27.5 </gml:pos></gml:Point></BsWfs:Location><BsWfs:Time>{t}</BsWfs:Time><BsWfs:ParameterName>gust</BsWfs:ParameterName><BsWfs:ParameterValue>{v}</BsWfs:ParameterValue></BsWfs:BsWfsElement></wfs:member>"
    x = '<?xml version="1.0"?><w xmlns:wfs="a" xmlns:BsWfs="b" xmlns:gml="c">' + m.format(t="2026-10-03T10:00:00Z", v="11.8") + m.format(t="2026-10-03T11:00:00Z", v="NaN") + "</w>"
    o = ingest.observations(spark, put(tmp_path / "f.xml", x)).collect()
    assert [(r.param, r.value, r.lat, r.lon) for r in o] == [("gust", 11.8, 62.5, 27.5)]
    w = ingest.warnings(spark, put(tmp_path / "w.xml", "<feed><entry><title>Yellow wind warning: North</title><updated>u</updated><summary>s</summary></entry><entry><title>Sea wind</title><updated>u</updated><summary>x</summary></entry></feed>"), ["north"]).collect()
    assert [r.kind for r in w] == ["wind"]
    entry = "<entry><title>{t}</title><updated>u</updated><summary>s</summary>{p}</entry>"
    square, far, empty = "<polygon>62,27 62,28 63,28 63,27 62,27</polygon>", "<polygon>10,10 10,11 11,11</polygon>", "<polygon></polygon>"
    feed = put(tmp_path / "areas.xml", "<feed>" + "".join(entry.format(t=t, p=p) for t, p in (("inside", square), ("north, far", far), ("either", far + square), ("north, empty", empty), ("north", ""), ("south", ""))) + "</feed>")
    assert sorted(r.title for r in ingest.warnings(spark, feed, ["north"], 62.5, 27.5).collect()) == ["either", "inside", "north", "north, empty"]
    assert sorted(r.title for r in ingest.warnings(spark, feed, ["north"]).collect()) == ["north", "north, empty", "north, far"]
    s = ingest.scenes(spark, put(tmp_path / "s.json", {"features": [{"id": "a", "bbox": [0, 0, 1, 1], "properties": {"datetime": "2026", "eo:cloud_cover": 1.0}}, {"id": "b", "bbox": [0, 0, 9, 9], "properties": {"datetime": "2026", "eo:cloud_cover": 9.0}}, {"id": "c", "bbox": [0, 0, 9, 9], "properties": {"datetime": "2026", "eo:cloud_cover": 90.0}}]}), 1, 1, 5, 5).collect()
    assert [r.id for r in s] == ["b", "a"]
    p = ingest.photos(spark, put(tmp_path / "p.json", {"query": {"pages": {"0": {"title": "File:A b.jpg", "coordinates": [{"lat": 1.0, "lon": 2.0}], "imageinfo": [{"thumburl": "t", "descriptionurl": "d", "extmetadata": {"Artist": {"value": "<b>Me</b>"}}}]}}}})).first()
    assert (p.title, p.artist, p.lat) == ("A b", "Me", 1.0)
    d = tmp_path / "fleet"
    d.mkdir()
    put(d / "operators.json", {"operators": [{"name": "n", "homeLocation": {"id": "A", "latitude": 1.0, "longitude": 2.0}, "supportedDroneConfigurations": ["Multispectral X"], "availability": [{"date": "2026-09-01", "status": "available", "start": "08:00", "end": "16:30"}, {"date": "2026-09-02", "status": "off", "start": "08:00", "end": "16:00"}]}]})
    put(d / "flight-tasks.json", {"flightTasks": [{"id": "t", "name": "n", "location": {"id": "B", "latitude": 1.0, "longitude": 2.0}, "areaHectares": 5.0, "priority": "high", "availableFrom": "2026-09-01", "dueDate": "2026-09-05", "requiredDroneConfiguration": "LiDAR", "setupMinutes": 10.0, "estimatedFlightMinutes": 20.0}]})
    put(d / "travel-times.json", {"nodes": [{"nodeId": "A", "latitude": 1.0, "longitude": 2.0}, {"nodeId": "B", "latitude": 1.0, "longitude": 2.0}], "durationsMinutes": [[0, 7.5], [8.5, 0]]})
    fl = ingest.fleet(spark, str(d))
    assert fl["operators"].first().has_ms and [(r.start, r.end) for r in fl["operator_days"].collect()] == [(480, 990)]
    assert fl["tasks"].first().duration == 30.0 and {(r["from"], r.to): r.minutes for r in fl["travel"].collect()}["B", "A"] == 8.5


def test_plan(spark):
    o = spark.createDataFrame([("ambulance", True, 20.0, 0.0, 10.0, 0.0), ("atv", True, 18.0, 1.0, 30.0, 0.0), ("fire_engine", True, 5.0, 0.0, 0.0, 0.0), ("foot", False, 1.0, 0.0, 0.0, 0.0)], "vehicle string, ok boolean, minutes double, clearing double, danger double, stuck double")
    r = {x.vehicle: x for x in plan.plan_emergency(o, "medical").collect()}
    assert r["ambulance"].is_best and r["atv"].is_fastest and r["ambulance"].is_safest and not r["fire_engine"].suits
    b = spark.createDataFrame([(1, 50.0, 50.0, "care_home", 3.0, 20.0, 200.0), (2, 300.0, 300.0, "cabin", 0.8, 1.0, 10.0)], "building_id int, x double, y double, kind string, weight double, response_min double, road_dist double")
    t = spark.createDataFrame([(60.0, 50.0, 0.3, 0.4)], "x double, y double, p_fail double, w_bld double")
    c = spark.createDataFrame([(10, 12, 90.0)], "iy int, ix int, risk double")
    s = {x.building_id: x for x in plan.structures_at_risk(b, t, c).collect()}
    assert abs(s[1].score - (0.35 + 0.65 * (0.4 + 0.35 + 0.25))) < 1e-9 and s[1].level == "high" and "no road access" in s[1].reasons and s[2].level == "low"
    path = spark.createDataFrame([("foot", k, 10.0 * k, 0.0, float(k), k // 2 if k < 4 else None, 50.0, 12.0 if k == 3 else None) for k in range(6)], "vehicle string, seq int, x double, y double, minute double, piece_id int, risk double, arrival double")
    tr = spark.createDataFrame([(1, 20.0, 5.0, 15.0, 0.4, 0.9), (2, 20.0, 39.0, 15.0, 0.4, 0.9)], "tree_id int, x double, y double, h double, p_fail double, p_torch double")
    pc = spark.createDataFrame([(0, 0.5), (1, 0.5)], "piece_id int, p double")
    k = plan.route_risk(path, tr, pc, graph.vehicle_table(spark)).first()
    assert abs(k.p_block - 0.75) < 1e-9 and k.storm_trees == 1 and k.torching == 1 and k.fire_margin == 9.0 and k.off_m == 10.0 and k.stuck == 0
    assert abs(k.danger - 100 * (0.15 * 0.75 + 0.15 * 0.05 + 0.15 * 0.5 + 0.1 / 30 + 0.25 * 0.5 + 0.05 * 0.2)) < 1e-9
    cells = spark.createDataFrame([(0, 0, 60.0, 10.0, 30.0), (5, 5, 55.0, 60.0, 40.0)], "iy int, ix int, risk double, d_human double, arrival double")
    assert plan.ignition_point(cells).first().iy == 5
    assert plan.latest_departure(spark.createDataFrame([("r", 1, 1, 10.0)], "route string, iy int, ix int, minutes double"), cells).first().leave_within == 15.0
    hits = spark.createDataFrame([(1, d, "bld", 7) for d in range(4)], "tree_id int, direction int, kind string, piece_id int")
    w = plan.strike_weights(hits, 4, 270.0)
    assert abs(w.first().w - 1) < 1e-12
    assert abs(plan.piece_probability(w, tr).first().p - 0.4) < 1e-9
    pieces = spark.createDataFrame([(4.0, 4.0, 4.0, 0.9)], "mx double, my double, width double, p double")
    road = spark.createDataFrame([(2, x) for x in range(12)], "iy int, ix int")
    assert plan.blocked_cells(pieces, road).count() == 6


def test_sinks_and_pictures(spark, tmp_path):
    d = spark.createDataFrame([(1, 27.0, 62.0, float("nan"))], "rank int, lon double, lat double, p double").withColumn("p", sinks.finite(F.col("p")))
    sinks.work_order(d, str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).first().lon == "27.0"
    sinks.write_geojson(d, ["rank", "p"], str(tmp_path / "g"))
    assert json.loads(spark.read.text(str(tmp_path / "g")).first()[0])["geometry"]["coordinates"] == [27.0, 62.0]
    raw = sinks.point_cloud_bytes(spark.createDataFrame([(1.0, 2.0, 3.0, 9)], "x double, y double, z double, cls int"), ["cls"])
    n = struct.unpack_from("<I", raw)[0]
    assert json.loads(raw[4 : 4 + n])["n"] == 1 and raw[-1] == 9 and len(raw) == 4 + n + 13
    cells = spark.createDataFrame([(0, 0, 0.0), (1, 1, 1.0)], "iy int, ix int, v double")
    pic = sinks.layer_png(cells, "v", 2, 2, 0, 1, [(0, 0, 0), (200, 100, 50)])
    assert pic[:4] == b"\x89PNG" and b"".join([bytes([200, 100, 50])]) in zlib.decompress(pic[pic.index(b"IDAT") + 4 : -16])
    assert sinks.upload_fault("a.las", b"LASF", 9) is None and sinks.upload_fault("a.las", b"x", 9) == "kind" and sinks.upload_fault("../a", b"", 9) == "name"
    px = spark.createDataFrame([("p", r, 40.0, 160.0, 40.0) for r in range(7)] + [("p", r, 150.0, 90.0, 30.0) for r in range(7, 10)], "photo string, r int, red double, green double, blue double")
    g = discover.ground_photo(px, 10).first()
    assert g.green == 1.0 and g.dry_fuel == 1.0
    assert np.isclose(trees.detection_scores(spark.createDataFrame([(10.0, 11.0), (9.0, 9.0)], "h_found double, h_true double"), 4, 2).first().f1, 2 / 3)
