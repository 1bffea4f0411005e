"""Weather series: the fire weather fold, rolling sums, latest readings, scenario days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreal.functions import fire_weather as fw

# Scenario means (temperature, humidity, wind, rain chance, gust m/s, soil wetness), fixed values.
SCENARIOS = {"normal": (18.0, 55.0, 10.0, 0.25, 10.0, 0.4), "heatwave": (28.0, 30.0, 18.0, 0.02, 14.0, 0.15), "storm": (9.0, 80.0, 45.0, 0.5, 32.0, 0.9)}


def fwi_series(days: DataFrame, key: str = "series") -> DataFrame:
    """Six codes a day for every series of days (seq, t_c, rh, w_kmh, rain, mon), folded in the order of seq from the start values. A series is one array, so it must fit in a row: a season or a century of days does."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "t_c", "rh", "w_kmh", "rain", "mon")))
    start = F.struct(*[F.lit(v).alias(k) for k, v in fw.START.items()])

    def step(acc: Column, d: Column) -> Column:
        last = acc["last"]
        now = F.struct(
            fw.ffmc_step(last["ffmc"], d["t_c"], d["rh"], d["w_kmh"], d["rain"]).alias("ffmc"),
            fw.dmc_step(last["dmc"], d["t_c"], d["rh"], d["rain"], d["mon"]).alias("dmc"),
            fw.dc_step(last["dc"], d["t_c"], d["rain"], d["mon"]).alias("dc"),
        )
        return F.struct(now.alias("last"), F.concat(acc["days"], F.array(F.struct(d["seq"].alias("seq"), d["w_kmh"].alias("w"), now["ffmc"].alias("ffmc"), now["dmc"].alias("dmc"), now["dc"].alias("dc")))).alias("days"))

    none = F.array().cast("array<struct<seq:int,w:double,ffmc:double,dmc:double,dc:double>>")
    folded = days.groupBy(key).agg(ordered.alias("d")).select(key, F.aggregate("d", F.struct(start.alias("last"), none.alias("days")), step, lambda acc: acc["days"]).alias("d"))
    rows = folded.select(key, F.inline("d"))
    rows = rows.withColumn("isi", fw.isi(F.col("ffmc"), F.col("w"))).withColumn("bui", fw.bui(F.col("dmc"), F.col("dc")))
    return rows.withColumn("fwi", fw.fwi(F.col("isi"), F.col("bui"))).drop("w")


def latest(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The latest value of each parameter; of equal times the greatest event_id."""
    return obs.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys).agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("m")).select(*keys, "m.ts", "m.value")


def rolling_sum(hours: DataFrame, key: str, order: str, value: str, n: int = 24) -> DataFrame:
    """Sum of the last n rows, the current one included."""
    return hours.withColumn("rolled", F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)))


def noon_rows(hourly: DataFrame) -> DataFrame:
    """Noon rows with the day's rain of hourly arrays (time, temperature, humidity, wind, gust, rain), and the greatest gust of the 48 hours from there."""
    rows = hourly.select("site_id", F.posexplode(F.arrays_zip("time", "temperature", "humidity", "wind", "gust", "rain"))).select("site_id", F.col("pos").alias("hour"), "col.*")
    w = Window.partitionBy("site_id").orderBy("hour")
    rows = rows.withColumns({"rain_24h": F.sum("rain").over(w.rowsBetween(-23, 0)), "gust_48h": F.max("gust").over(w.rowsBetween(0, 47))})
    return rows.filter(F.substring("time", 12, 2) == "12")


def soil_wetness(moisture: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (moisture - 0.15) / 0.30))


def scenario_days(spark, scenario: str, n: int = 45) -> DataFrame:
    """n synthetic days about a scenario's means, the last pinned to them, from a keyed generator."""
    from boreal.operators.montecarlo import uniform

    t, rh, w, p, _, _ = SCENARIOS[scenario]
    d = spark.range(n).select(F.col("id").cast("int").alias("seq"), *[uniform(F.col("id") + 1, F.lit(s), F.lit(s)).alias(f"u{s}") for s in range(1, 5)])
    last = F.col("seq") == n - 1
    return d.select(
        F.lit(scenario).alias("series"), "seq",
        F.when(last, t).otherwise(t + 6 * (F.col("u1") - 0.5)).alias("t_c"), F.when(last, rh).otherwise(rh + 20 * (F.col("u2") - 0.5)).alias("rh"),
        F.when(last, w).otherwise(w * (0.6 + 0.8 * F.col("u3"))).alias("w_kmh"), F.when(last | (F.col("u4") >= p), 0.0).otherwise(12 * F.col("u4") / p).alias("rain"), F.lit(7).alias("mon"),
    )


def last_rows(history: DataFrame, by: str, order: str, n: int = 21) -> DataFrame:
    """The last n rows of each series."""
    return history.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("back") <= n).drop("back")
