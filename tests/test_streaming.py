import time

from pyspark.sql import functions as F

from boreal.operators import weather
from boreal.sources.fixtures import source
from boreal.streaming import weather as stream

SF = "/root/testdata/sf0.001"


def drained(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name)


def test_fwi_stream_equals_batch(spark, tmp_path):
    days = source(spark, SF, "v_days")
    for k, part in enumerate((days.filter("seq >= 15"), days.filter("seq < 15"))):  # the later days come first
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        time.sleep(0.1)
    live = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {(r.series, r.seq): (r.ffmc, r.dmc, r.dc) for r in drained(stream.fwi_stream(live), "fwi", "append").collect()}
    want = {(r.series, r.seq): (r.ffmc, r.dmc, r.dc) for r in weather.fwi_series(days).collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-6 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_latest_and_windows(spark, tmp_path):
    obs = source(spark, SF, "v_obs").withColumn("ts", F.col("ts").cast("timestamp"))
    obs.repartition(2).write.parquet(str(tmp_path / "o"))
    live = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "o"))
    got = {(r.station_id, r.param): r.value for r in drained(stream.latest(live), "latest", "complete").collect()}
    assert got == {(r.station_id, r.param): r.value for r in weather.latest(obs, ["station_id", "param"]).collect()}
    assert drained(stream.sliding(live), "windows", "append").count() > 0
    assert drained(stream.once(live), "once", "append").count() == obs.select("event_id").distinct().count()


def test_published_case(spark):
    d = spark.createDataFrame([("a", 0, 17.0, 42.0, 25.0, 0.0, 4)], "series string, seq int, t_c double, rh double, w_kmh double, rain double, mon int")
    r = weather.fwi_series(d).first()
    for c, v in {"ffmc": 87.69, "dmc": 8.55, "dc": 19.01, "isi": 10.85, "bui": 8.49, "fwi": 10.10}.items():
        assert abs(r[c] - v) < 0.02
    s = weather.fwi_series(weather.scenario_days(spark, "heatwave")).agg({"fwi": "max"}).first()[0]
    assert s > weather.fwi_series(weather.scenario_days(spark, "normal")).agg({"fwi": "max"}).first()[0]
