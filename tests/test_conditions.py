import json

from boreal.sources import conditions


def test_forecast_and_fallback(spark, tmp_path):
    n = 72
    hourly = {"time": [f"2026-07-{1 + k // 24:02d}T{k % 24:02d}:00" for k in range(n)], "temperature_2m": [20.0] * n, "relative_humidity_2m": [40.0] * n, "wind_speed_10m": [15.0] * n, "wind_gusts_10m": [10.0 + k / 10 for k in range(n)], "precipitation": [0.1] * n, "soil_moisture_3_to_9cm": [0.30] * n}
    (tmp_path / "f.json").write_text(json.dumps({"hourly": hourly}))
    r = conditions.of_forecast(spark, str(tmp_path / "f.json")).first()
    assert r.source == "forecast" and abs(r.soil_wet - 0.5) < 1e-9 and abs(r.gust_ms - 17.1) < 1e-9 and r.fwi > 0
    (tmp_path / "g.json").write_text("{}")
    s = conditions.of_forecast(spark, str(tmp_path / "g.json")).first()
    assert s.scenario == "normal" and "stands in" in s.note
