"""Structured Streaming forms of the time-dependent operators."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(obs: DataFrame) -> DataFrame:
    """Latest value of each station and parameter, in update mode; of equal times the greatest event_id."""
    return obs.groupBy("station_id", "param").agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("m")).select("station_id", "param", "m.ts", "m.value")


def sliding(obs: DataFrame, late: str = "1 hour", width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Sum, maximum and count of each parameter over sliding windows; rows later than `late` are dropped."""
    return obs.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "station_id", "param").agg(F.sum("value").alias("total"), F.max("value").alias("top"), F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "station_id", "param", "total", "top", "n")


def once(obs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, though it is delivered again within `late`."""
    return obs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a job's events without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "station_id").agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", "station_id", "n")


def _step(last: tuple[float, float, float], d) -> tuple[float, float, float]:
    """The three daily codes after one day, by the same formulas as the column expressions."""
    import math

    from boreal.functions.fire_weather import DC_MONTH, DMC_MONTH

    f, dm, dc = last
    t, h, w, rain, mon = d.t_c, d.rh, d.w_kmh, d.rain, int(d.mon) - 1
    m = 147.2 * (101 - f) / (59.5 + f)
    if rain > 0.5:
        r = rain - 0.5
        m = min(m + 42.5 * r * math.exp(-100 / (251 - m)) * (1 - math.exp(-6.93 / r)) + (0.0015 * (m - 150) ** 2 * math.sqrt(r) if m > 150 else 0), 250)
    common = 0.18 * (21.1 - t) * (1 - math.exp(-0.115 * h))
    dry, damp = 0.942 * h**0.679 + 11 * math.exp((h - 100) / 10) + common, 0.618 * h**0.753 + 10 * math.exp((h - 100) / 10) + common
    rate = lambda x: (0.424 * (1 - x**1.7) + 0.0694 * math.sqrt(w) * (1 - x**8)) * 0.581 * math.exp(0.0365 * t)
    m = dry + (m - dry) * 10 ** -rate(h / 100) if m > dry else damp - (damp - m) * 10 ** -rate((100 - h) / 100) if m < damp else m
    f = min(max(59.5 * (250 - m) / (147.2 + m), 0), 101)
    if rain > 1.5:
        b = 100 / (0.5 + 0.3 * dm) if dm <= 33 else 14 - 1.3 * math.log(dm) if dm <= 65 else 6.2 * math.log(dm) - 17.2
        wet = 0.92 * rain - 1.27
        dm = max(244.72 - 43.43 * math.log(math.exp(5.6348 - dm / 43.43) + 1000 * wet / (48.77 + b * wet)), 0)
    dm = max(dm + 1.894 * (max(t, -1.1) + 1.1) * (100 - h) * DMC_MONTH[mon] * 1e-4, 0)
    if rain > 2.8:
        dc = max(400 * math.log(800 / (800 * math.exp(-dc / 400) + 3.937 * (0.83 * rain - 1.27))), 0)
    dc += max((0.36 * (max(t, -2.8) + 2.8) + DC_MONTH[mon]) / 2, 0)
    return f, dm, dc


def fwi_stream(days: DataFrame) -> DataFrame:
    """The fire weather fold as a stream keyed by series: three numbers of state, and days that came early wait for those before them. days: series, seq, t_c, rh, w_kmh, rain, mon."""
    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, *last, wait = state.get if state.exists else (0, 85.0, 6.0, 15.0, "[]")
        held = pd.read_json(io.StringIO(wait)) if wait != "[]" else pd.DataFrame()
        rows = pd.concat([held, *batches]).drop_duplicates("seq").sort_values("seq")
        out, last = [], tuple(last)
        for d in rows[rows["seq"] >= nxt].itertuples():
            if d.seq != nxt:
                break
            last = _step(last, d)
            out.append((key[0], int(nxt), *last))
            nxt += 1
        left = rows[rows["seq"] >= nxt]
        state.update((int(nxt), *map(float, last), left.to_json(orient="records") if len(left) else "[]"))
        yield pd.DataFrame(out, columns=["series", "seq", "ffmc", "dmc", "dc"])

    columns = ["series", "seq", "t_c", "rh", "w_kmh", "rain", "mon"]
    return days.select(*columns).groupBy("series").applyInPandasWithState(fold, "series string, seq int, ffmc double, dmc double, dc double", "next int, ffmc double, dmc double, dc double, waiting string", "append", GroupStateTimeout.NoTimeout)
