"""The conditions of a scenario or of a landed forecast, as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreal.functions.forest import danger_class
from boreal.operators import weather


def of_scenario(spark: SparkSession, name: str, note: str = "") -> DataFrame:
    """The last of 45 synthetic days, with the codes that they lead to."""
    t, rh, w, _, gust, wet = weather.SCENARIOS[name]
    last = weather.fwi_series(weather.scenario_days(spark, name)).filter(f"seq = {44}")
    return last.select(F.lit("synthetic").alias("source"), F.lit(name).alias("scenario"), F.lit(t).alias("temp_c"), F.lit(rh).alias("rh"), F.lit(w).alias("wind_kmh"), F.lit(gust).alias("gust_ms"), F.lit(wet).alias("soil_wet"), "ffmc", "dmc", "dc", "isi", "bui", "fwi", danger_class(F.col("fwi")).alias("danger"), F.lit(note).alias("note"))


def of_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Noon rows of a landed hourly forecast folded to today's codes; without usable rows the normal scenario, which says so in its note."""
    h = spark.read.schema("hourly struct<time: array<string>, temperature_2m: array<double>, relative_humidity_2m: array<double>, wind_speed_10m: array<double>, wind_gusts_10m: array<double>, precipitation: array<double>, soil_moisture_3_to_9cm: array<double>>").option("multiLine", True).json(path)
    feed = h.filter("hourly IS NOT NULL").select(F.lit(1).alias("site_id"), F.col("hourly.time").alias("time"), F.col("hourly.temperature_2m").alias("temperature"), F.col("hourly.relative_humidity_2m").alias("humidity"), F.col("hourly.wind_speed_10m").alias("wind"), F.col("hourly.wind_gusts_10m").alias("gust"), F.col("hourly.precipitation").alias("rain"))
    noon = weather.noon_rows(feed).filter("temperature IS NOT NULL AND humidity IS NOT NULL AND wind IS NOT NULL")
    days = noon.select(F.lit("forecast").alias("series"), F.floor(F.col("hour") / 24).cast("int").alias("seq"), F.col("temperature").alias("t_c"), F.col("humidity").alias("rh"), F.col("wind").alias("w_kmh"), F.coalesce("rain_24h", F.lit(0.0)).alias("rain"), F.substring("time", 6, 2).cast("int").alias("mon"), F.col("gust_48h"))
    if days.isEmpty():
        return of_scenario(spark, "normal", "no forecast was landed: the normal scenario stands in")
    moist = h.select(F.avg(weather.soil_wetness(F.try_divide(F.aggregate(F.filter("hourly.soil_moisture_3_to_9cm", lambda m: m.isNotNull()), F.lit(0.0), lambda a, m: a + m), F.size(F.filter("hourly.soil_moisture_3_to_9cm", lambda m: m.isNotNull()))))).alias("soil_wet"))
    codes = weather.fwi_series(days).join(days.drop("series"), "seq").orderBy(F.desc("seq")).limit(1).crossJoin(moist)  # one row
    return codes.select(F.lit("forecast").alias("source"), F.lit("live").alias("scenario"), F.col("t_c").alias("temp_c"), "rh", F.col("w_kmh").alias("wind_kmh"), F.col("gust_48h").alias("gust_ms"), "soil_wet", "ffmc", "dmc", "dc", "isi", "bui", "fwi", danger_class(F.col("fwi")).alias("danger"), F.lit("").alias("note"))
