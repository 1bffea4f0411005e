"""The Canadian fire weather codes as column expressions: three daily codes with memory and three indices without."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes before the first day.
START = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}
# Day-length factors by month of the published system, fixed values.
DMC_MONTH = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DC_MONTH = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)


def by_month(month: Column, factors) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in factors]), month.cast("int"))


def ffmc_step(last: Column, t: Column, rh: Column, wind: Column, rain: Column) -> Column:
    """Fine fuel moisture code after a day (degC, %, km/h, mm)."""
    m0 = 147.2 * (101 - last) / (59.5 + last)
    wet = F.greatest(rain - 0.5, F.lit(1e-9))
    soaked = m0 + 42.5 * wet * F.exp(-100 / (251 - m0)) * (1 - F.exp(-6.93 / wet)) + F.when(m0 > 150, 0.0015 * (m0 - 150) * (m0 - 150) * F.sqrt(wet)).otherwise(0.0)
    m = F.when(rain > 0.5, F.least(soaked, F.lit(250.0))).otherwise(m0)
    shared = 0.18 * (21.1 - t) * (1 - F.exp(-0.115 * rh))
    dry = 0.942 * F.pow(rh, F.lit(0.679)) + 11 * F.exp((rh - 100) / 10) + shared
    damp = 0.618 * F.pow(rh, F.lit(0.753)) + 10 * F.exp((rh - 100) / 10) + shared
    rate = lambda h: (0.424 * (1 - F.pow(h, F.lit(1.7))) + 0.0694 * F.sqrt(wind) * (1 - F.pow(h, F.lit(8.0)))) * 0.581 * F.exp(0.0365 * t)
    drying = dry + (m - dry) * F.pow(F.lit(10.0), -rate(rh / 100))
    wetting = damp - (damp - m) * F.pow(F.lit(10.0), -rate((100 - rh) / 100))
    m = F.when(m > dry, drying).when(m < damp, wetting).otherwise(m)
    return F.least(F.greatest(59.5 * (250 - m) / (147.2 + m), F.lit(0.0)), F.lit(101.0))


def dmc_step(last: Column, t: Column, rh: Column, rain: Column, month: Column) -> Column:
    """Duff moisture code after a day."""
    drying = 1.894 * (F.greatest(t, F.lit(-1.1)) + 1.1) * (100 - rh) * by_month(month, DMC_MONTH) * 1e-4
    slope = F.when(last <= 33, 100 / (0.5 + 0.3 * last)).when(last <= 65, 14 - 1.3 * F.ln(F.greatest(last, F.lit(1e-9)))).otherwise(6.2 * F.ln(F.greatest(last, F.lit(1e-9))) - 17.2)
    wet = 0.92 * rain - 1.27
    moist = 20 + F.exp(5.6348 - last / 43.43) + 1000 * wet / (48.77 + slope * wet)
    rained = F.greatest(244.72 - 43.43 * F.ln(F.greatest(moist - 20, F.lit(1e-9))), F.lit(0.0))
    return F.greatest(F.when(rain > 1.5, rained).otherwise(last) + drying, F.lit(0.0))


def dc_step(last: Column, t: Column, rain: Column, month: Column) -> Column:
    """Drought code after a day."""
    drying = F.greatest((0.36 * (F.greatest(t, F.lit(-2.8)) + 2.8) + by_month(month, DC_MONTH)) / 2, F.lit(0.0))
    moist = 800 * F.exp(-last / 400) + 3.937 * (0.83 * rain - 1.27)
    rained = F.greatest(400 * F.ln(800 / F.greatest(moist, F.lit(1e-9))), F.lit(0.0))
    return F.when(rain > 2.8, rained).otherwise(last) + drying


def isi(ffmc: Column, wind: Column) -> Column:
    m = 147.2 * (101 - ffmc) / (59.5 + ffmc)
    return 19.115 * F.exp(-0.1386 * m) * (1 + F.pow(m, F.lit(5.31)) / 4.93e7) * F.exp(0.05039 * wind)


def bui(dmc: Column, dc: Column) -> Column:
    ratio = F.try_divide(0.8 * dc, dmc + 0.4 * dc)
    low = dmc * ratio
    high = dmc - (1 - ratio) * (0.92 + F.pow(0.0114 * dmc, F.lit(1.7)))
    return F.when(dmc <= 0, 0.0).otherwise(F.greatest(F.when(dmc <= 0.4 * dc, low).otherwise(high), F.lit(0.0)))


def fwi(isi_: Column, bui_: Column) -> Column:
    depth = F.when(bui_ <= 80, 0.626 * F.pow(bui_, F.lit(0.809)) + 2).otherwise(1000 / (25 + 108.64 * F.exp(-0.023 * bui_)))
    b = 0.1 * isi_ * depth
    return F.when(b > 1, F.exp(2.72 * F.pow(F.greatest(0.434 * F.ln(F.greatest(b, F.lit(1e-9))), F.lit(0.0)), F.lit(0.647)))).otherwise(b)
