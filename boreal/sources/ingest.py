"""Landed open-data files as typed tables: map elements, register features, observations, warnings, context GeoJSON, fleet JSON.

Nothing here reaches the network: an ingestion job lands responses as files, and these readers parse them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreal.functions.geo import haversine_km, in_ring
from boreal.operators import text

# Classes of the national topographic register, fixed values: code, class, width.
ROAD_CODES = (
    (12111, "main", 8.0), (12112, "main", 8.0), (12121, "main", 7.0), (12122, "main", 7.0), (12131, "forest", 5.0), (12132, "forest", 4.5),
    (12141, "forest", 4.0), (12312, "forest", 4.0), (12313, "path", 1.5), (12314, "path", 2.5), (12316, "forest", 3.0),
)
# Building groups by either generation of codes, and by use code, fixed values.
BUILDING_CODES = (
    ("house", (41100, 42210, 42211, 42212, 42213, 42214)),
    ("public", (41200, 42220, 42221, 42222, 42223, 42224)),
    ("cabin", (41300, 42230, 42231, 42232, 42233, 42234)),
    ("industrial", (41400, 42240, 42241, 42242, 42243, 42244)),
    ("church", (41500, 41510, 42250, 42251, 42252, 42253, 42254, 42270)),
    ("other", (41600, 42260, 42261, 42262, 42263, 42264)),
)
USE_CODES = {1: "house", 2: "public", 3: "cabin", 4: "industrial", 5: "church", 8: "other"}
ELEMENTS = "elements array<struct<type string, id bigint, lat double, lon double, tags map<string,string>, geometry array<struct<lon double, lat double>>>>"


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per (type, id) of landed map responses: the first by geometry size, then tags. With the mean place of the geometry."""
    e = json_file(spark, path, ELEMENTS).select(F.explode("elements").alias("e")).select("e.*")
    w = Window.partitionBy("type", "id").orderBy(F.desc(F.size(F.coalesce("geometry", F.array().cast("array<struct<lon:double,lat:double>>")))), F.to_json("tags"))
    e = e.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    mean = lambda c: F.coalesce(F.aggregate("geometry", F.lit(0.0), lambda a, p: a + p[c]) / F.nullif(F.size("geometry"), F.lit(0)), F.col(c))
    return e.select("type", "id", "tags", "geometry", mean("lat").alias("lat"), mean("lon").alias("lon"))


def roads(elements: DataFrame) -> DataFrame:
    t = lambda k: F.col("tags")[k]
    cls, width = text.road_class(t("highway"))
    return elements.filter(t("highway").isNotNull()).select("id", F.coalesce(t("name"), t("ref"), t("highway")).alias("name"), cls.alias("cls"), width.alias("width"), F.col("geometry").alias("path"))


def power_lines(elements: DataFrame) -> DataFrame:
    t = lambda k: F.col("tags")[k]
    kv = text.line_kv(t("voltage"), t("power"))
    h, half = text.conductor(F.coalesce(kv, F.lit(20.0)))
    rows = elements.filter(t("power").isin("line", "minor_line", "cable"))
    return rows.select("id", t("power").alias("kind"), kv.alias("kv"), h.alias("conductor_h"), half.alias("row_half"), F.col("geometry").alias("path"))


def buildings(elements: DataFrame) -> DataFrame:
    t = lambda k: F.col("tags")[k]
    kind = (
        F.when(t("amenity").isin("nursing_home", "social_facility") | (t("building") == "nursing_home"), "care_home").when(t("amenity").isin("hospital", "clinic") | (t("building") == "hospital"), "hospital")
        .when(t("amenity").isin("school", "kindergarten") | t("building").isin("school", "kindergarten"), "school").when(t("power") == "substation", "substation").otherwise(t("building"))
    )
    rows = elements.filter(t("building").isNotNull() & F.coalesce(t("amenity") != "fire_station", F.lit(True)))
    rows = rows.select("id", F.coalesce(t("name"), F.concat_ws(" ", t("addr:street"), t("addr:housenumber"))).alias("name"), kind.alias("kind"), "lat", "lon")
    return rows.withColumns({"weight": text.sensitivity(F.col("kind")), "r": F.when(F.col("kind").isin("substation", "school", "hospital", "care_home"), 8.0).otherwise(6.0)})


def fire_stations(elements: DataFrame, lat: float, lon: float, k: int = 5) -> DataFrame:
    """The k nearest."""
    d = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return elements.filter(F.col("tags")["amenity"] == "fire_station").select("id", F.coalesce(F.col("tags")["name"], F.lit("Fire station")).alias("name"), "lat", "lon", F.round(d, 1).alias("distance_km")).orderBy("distance_km", "id").limit(k)


def features(spark: SparkSession, path: str) -> DataFrame:
    """geometry type, coordinates as JSON text and properties of landed GeoJSON features."""
    raw = json_file(spark, path, "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string,string>>>")
    return raw.select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def line_of(coordinates) -> Column:
    return F.from_json(coordinates, "array<array<double>>")


def context(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """roads, powerlines, buildings and depot of a context file, with defaults."""
    f = features(spark, path)
    p = lambda k, default: F.coalesce(F.col("properties")[k], F.lit(default))
    kind, line = F.col("properties")["kind"], F.col("geometry") == "LineString"
    point = F.from_json("coordinates", "array<double>")
    at = f.filter(F.col("geometry") == "Point").withColumn("p", point)
    return {
        "roads": f.filter(line & (kind == "road")).select(p("name", "").alias("name"), p("class", "forest").alias("cls"), F.coalesce(F.col("properties")["width"].cast("double"), F.when(p("class", "forest") == "main", 7.0).otherwise(4.0)).alias("width"), line_of("coordinates").alias("path")),
        "powerlines": f.filter(line & (kind == "powerline")).select(p("name", "").alias("name"), p("kv", "20").cast("double").alias("kv"), p("conductor_h", "9").cast("double").alias("conductor_h"), line_of("coordinates").alias("path")),
        "depot": at.filter(kind == "depot").select(F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")),
        "buildings": at.filter(F.coalesce(kind, F.lit("building")) != "depot").select(p("name", "").alias("name"), p("type", "house").alias("kind"), p("radius", "6").cast("double").alias("r"), p("weight", "1").cast("double").alias("weight"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")),
    }


def road_code(code) -> tuple:
    cls = width = None
    for k, c, w in ROAD_CODES:
        cls = F.when(code == k, c) if cls is None else cls.when(code == k, c)
        width = F.when(code == k, w) if width is None else width.when(code == k, w)
    return cls.otherwise("forest"), width.otherwise(4.0)


def register_roads(f: DataFrame) -> DataFrame:
    code = F.col("properties")["kohdeluokka"].try_cast("int")
    cls, width = road_code(code)
    return f.filter(F.col("geometry") == "LineString").select(code.alias("code"), cls.alias("cls"), width.alias("width"), line_of("coordinates").alias("path"))


def register_buildings(f: DataFrame) -> DataFrame:
    """Kind by use code, else by class code, else house."""
    use, code = F.col("properties")["kayttotarkoitus"].try_cast("int"), F.col("properties")["kohdeluokka"].try_cast("int")
    kind = None
    for k, name in USE_CODES.items():
        kind = F.when(use == k, name) if kind is None else kind.when(use == k, name)
    for name, codes in BUILDING_CODES:
        kind = kind.when(code.isin(*codes), name)
    return f.select(code.alias("code"), kind.otherwise("house").alias("kind"), F.from_json("coordinates", "array<double>").alias("p")).select("code", "kind", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def register_voltage(properties) -> Column:
    """kV from the first property that names a voltage; volts above 1000, else as it is."""
    hit = F.element_at(F.map_values(F.map_filter(properties, lambda k, _: F.lower(k).rlike("jannite|voltage"))), 1).try_cast("double")
    return F.when(hit > 1000, hit / 1000).otherwise(hit)


def stands(f: DataFrame) -> DataFrame:
    """Register stands, their properties found by part of the name, first hit first: stand_id, species, height, age and the outer ring."""
    rings = F.from_json("coordinates", "array<array<array<double>>>")
    return f.filter(F.col("geometry") == "Polygon").select(
        _prop("standid").alias("stand_id"), _prop("maintreespecies").try_cast("int").alias("species"), _prop("meanheight").try_cast("double").alias("height"), _prop("meanage").try_cast("double").alias("age"),
        F.transform(rings[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"),
    )


def _prop(part: str) -> Column:
    keys = F.filter(F.map_keys("properties"), lambda k: F.contains(F.lower(k), F.lit(part)))
    return F.try_element_at(F.col("properties"), F.get(keys, F.lit(0)))


def stand_check(stands_: DataFrame, trees: DataFrame) -> DataFrame:
    """Each stand's dominant species by crown area (least code on ties) beside the register's (1, 2, 3 for 0, 1, 2)."""
    from boreal.operators.spatial import points_in_polygons

    inside = points_in_polygons(trees.select("tree_id", "x", "y"), "tree_id", stands_, "stand_id", 50.0).join(trees.select("tree_id", "species", "crown_area"), "tree_id")
    area = inside.groupBy("stand_id", "species").agg(F.sum("crown_area").alias("a"))
    top = area.groupBy("stand_id").agg(F.max_by("species", F.struct("a", -F.col("species"))).alias("found"))
    return stands_.select("stand_id", (F.col("species") - 1).alias("registered")).join(top, "stand_id", "left").withColumn("agrees", F.col("registered") == F.col("found"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(time, param, value, lat, lon) of a landed simple-feature XML; values that are no numbers are dropped."""
    r = spark.read.option("rowTag", "BsWfs:BsWfsElement").schema("`BsWfs:Location` struct<`gml:Point`: struct<`gml:pos`: string>>, `BsWfs:Time` string, `BsWfs:ParameterName` string, `BsWfs:ParameterValue` string").format("xml").load(path)
    pos = F.split(F.trim(F.col("`BsWfs:Location`.`gml:Point`.`gml:pos`")), " ")
    rows = r.select(F.to_timestamp("BsWfs:Time").alias("ts"), F.col("BsWfs:ParameterName").alias("param"), F.col("BsWfs:ParameterValue").try_cast("double").alias("value"), pos[0].cast("double").alias("lat"), pos[1].cast("double").alias("lon"))
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def warnings(spark: SparkSession, path: str, region_words: list[str], lat: float | None = None, lon: float | None = None) -> DataFrame:
    """Entries of a landed warning feed that concern the region, with their kind: where a place is given, by whether an entry's areas cover it; entries without areas, and all without a place, by the region's names."""
    e = spark.read.option("rowTag", "entry").schema("title string, updated string, summary string, polygon array<string>").format("xml").load(path)
    body = F.lower(F.concat_ws(" ", "title", "summary"))
    near = F.lit(False)
    for w in region_words:
        near = near | body.contains(w.lower())
    if lat is not None and lon is not None:
        rings = F.filter(F.transform(F.coalesce("polygon", F.array().cast("array<string>")), lat_lon_ring), lambda r: F.size(r) > 0)
        near = F.when(F.size(rings) > 0, F.exists(rings, lambda r: in_ring(F.lit(lat), F.lit(lon), r))).otherwise(near)
    return e.filter(near).select(F.substring("title", 1, 80).alias("title"), "updated", text.warning_kind(F.concat_ws(" ", "title", "summary")).alias("kind"), F.substring("summary", 1, 300).alias("summary"))


def lat_lon_ring(area: Column) -> Column:
    """The corners (x: latitude, y: longitude) of an area written as "lat,lon lat,lon ..."; none if it is null or empty."""
    v = F.transform(F.filter(F.split(area, "[,\\s]+"), lambda c: c != ""), lambda c: c.try_cast("double"))
    corners = F.transform(v, lambda a, i: F.struct(a.alias("x"), F.get(v, i + 1).alias("y"), (i % 2 == 0).alias("first")))
    return F.coalesce(F.filter(corners, lambda c: c["first"] & c["x"].isNotNull() & c["y"].isNotNull()), F.array().cast("array<struct<x: double, y: double, first: boolean>>"))


def scenes(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, cloud: float = 25.0) -> DataFrame:
    """Satellite scenes under a cloud limit: those that cover the box first, then by cloud, then by date."""
    f = json_file(spark, path, "features array<struct<id: string, bbox: array<double>, properties: struct<datetime: string, `eo:cloud_cover`: double>>>").select(F.explode("features").alias("f"))
    b = F.col("f.bbox")
    rows = f.select(F.col("f.id").alias("id"), F.col("f.properties.datetime").alias("date"), F.col("f.properties.`eo:cloud_cover`").alias("cloud"), ((b[0] <= west) & (b[1] <= south) & (b[2] >= east) & (b[3] >= north)).alias("covers"))
    return rows.filter(F.col("cloud") < cloud).orderBy(F.desc("covers"), "cloud", "date")


def photos(spark: SparkSession, path: str) -> DataFrame:
    """Geotagged pictures of a landed page query, without HTML."""
    p = json_file(spark, path, "query struct<pages: map<string, struct<title: string, coordinates: array<struct<lat: double, lon: double>>, imageinfo: array<struct<thumburl: string, descriptionurl: string, extmetadata: map<string, struct<value: string>>>>>>>")
    v = p.select(F.explode(F.map_values("query.pages")).alias("v"))
    info = F.col("v.imageinfo")[0]
    return v.select(F.substring(F.regexp_replace(F.col("v.title"), r"^File:|\.\w+$", ""), 1, 80).alias("title"), F.col("v.coordinates")[0]["lat"].alias("lat"), F.col("v.coordinates")[0]["lon"].alias("lon"), text.strip_tags(info["extmetadata"]["Artist"]["value"], 80).alias("artist"), info["descriptionurl"].alias("url"))


def fleet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """operators, operator_days, tasks, nodes and travel of a fleet folder."""
    o = json_file(spark, f"{folder}/operators.json", "operators array<struct<name: string, homeLocation: struct<id: string, latitude: double, longitude: double>, supportedDroneConfigurations: array<string>, availability: array<struct<date: string, status: string, start: string, end: string>>>>").select(F.posexplode("operators")).select(F.col("pos").alias("op_id"), "col.*")
    days = o.select("op_id", F.explode("availability").alias("a")).filter(F.coalesce(F.col("a.status"), F.lit("available")) == "available")
    t = json_file(spark, f"{folder}/flight-tasks.json", "flightTasks array<struct<id: string, name: string, location: struct<id: string, latitude: double, longitude: double>, areaHectares: double, priority: string, availableFrom: string, dueDate: string, requiredDroneConfiguration: string, setupMinutes: double, estimatedFlightMinutes: double>>").select(F.explode("flightTasks").alias("t")).select("t.*")
    m = json_file(spark, f"{folder}/travel-times.json", "nodes array<struct<nodeId: string, latitude: double, longitude: double>>, durationsMinutes array<array<double>>")
    rows = m.select("nodes", F.posexplode("durationsMinutes").alias("i", "row")).select("nodes", "i", F.posexplode("row").alias("j", "minutes"))
    name = lambda c: F.col("nodes")[F.col(c)]["nodeId"]
    return {
        "operators": o.select("op_id", "name", F.col("homeLocation.id").alias("node_id"), F.col("homeLocation.latitude").alias("lat"), F.col("homeLocation.longitude").alias("lon"), F.exists("supportedDroneConfigurations", lambda c: F.lower(c).contains("multispectral")).alias("has_ms")),
        "operator_days": days.select("op_id", F.to_date("a.date").alias("day"), text.minutes(F.col("a.start")).alias("start"), text.minutes(F.col("a.end")).alias("end")),
        "tasks": t.select(F.col("id").alias("task_id"), "name", F.col("location.id").alias("node_id"), F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lon"), F.col("areaHectares").alias("area_ha"), F.when(F.col("priority") == "high", 3.0).when(F.col("priority") == "medium", 2.0).otherwise(1.0).alias("prio"), F.to_date("availableFrom").alias("release_d"), F.to_date("dueDate").alias("due_d"), F.lower("requiredDroneConfiguration").contains("multispectral").alias("needs_ms"), (F.col("setupMinutes") + F.col("estimatedFlightMinutes")).alias("duration")),
        "nodes": m.select(F.explode("nodes").alias("n")).select(F.col("n.nodeId").alias("node_id"), F.col("n.latitude").alias("lat"), F.col("n.longitude").alias("lon")),
        "travel": rows.select(name("i").alias("from"), name("j").alias("to"), "minutes"),
    }


def source_status(**sources: DataFrame) -> DataFrame:
    """A row per source with its number of rows: what an interface shows of open data."""
    out = None
    for name, df in sources.items():
        row = df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 0).alias("ok"))
        out = row if out is None else out.union(row)
    return out
