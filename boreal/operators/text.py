"""Text, code and attribute rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes of map tags, fixed values.
MAIN_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
LOCAL_ROADS = ("unclassified", "residential", "service", "living_street", "road")
#: Weight of a building's kind where people are at risk; others count as houses.
SENSITIVITY = {"hospital": 3.0, "care_home": 3.0, "school": 2.5, "substation": 2.5, "mast": 1.5, "house": 1.0, "cabin": 0.8}


def strip_tags(html: Column, most: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")), 1, most)


def warning_kind(text: Column) -> Column:
    """forest_fire before wind, else other."""
    t = F.lower(text)
    return F.when(t.contains("fire"), "forest_fire").when(t.contains("wind"), "wind").otherwise("other")


def road_class(highway: Column) -> tuple[Column, Column]:
    """Class and width in metres."""
    cls = F.when(highway.isin(*MAIN_ROADS), "main").when(highway.isin(*LOCAL_ROADS) | (highway == "track"), "forest").otherwise("path")
    width = F.when(highway.isin(*MAIN_ROADS), 7.0).when(highway.isin(*LOCAL_ROADS), 5.0).when(highway == "track", 3.5).otherwise(1.5)
    return cls, width


def line_kv(voltage: Column, power: Column) -> Column:
    """The greatest of the `;`-separated volts, in kV; without one 20 for minor lines, else null."""
    volts = F.transform(F.filter(F.split(F.coalesce(voltage, F.lit("")), ";"), lambda v: F.trim(v).rlike("^[0-9]+$")), lambda v: F.trim(v).cast("double"))
    return F.coalesce(F.array_max(volts) / 1000, F.when(power == "minor_line", 20.0))


def conductor(kv: Column) -> tuple[Column, Column]:
    """Height of the conductors and half the width of the cleared way."""
    return F.when(kv <= 45, 9.0).otherwise(15.0), F.when(kv <= 45, 5.0).otherwise(13.0)


def sensitivity(kind: Column) -> Column:
    out = F.lit(SENSITIVITY["house"])
    for k, v in SENSITIVITY.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def cache_key(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 24)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), "[^A-Za-z0-9._-]", "_")


def minutes(hhmm: Column) -> Column:
    return F.split(hhmm, ":")[0].cast("int") * 60 + F.split(hhmm, ":")[1].cast("int")


def clock(minute: Column) -> Column:
    """HH:MM of minutes since midnight, the minute rounded; the hour is not carried."""
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (F.round(minute).cast("int") % 60))


def season(today: Column) -> tuple[Column, Column, Column, Column]:
    """Growing-season windows before and after: of last year and this one from 1 July on, else a year earlier; the later ends today at the latest."""
    year = F.year(today) - F.when(F.month(today) >= 7, 0).otherwise(1)
    day = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    return day(year - 1, 6, 1), day(year - 1, 9, 15), day(year, 6, 1), F.least(day(year, 9, 15), today)


def reasons(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, in order, joined by `; `."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])), "; ")


def is_house(kind: Column) -> Column:
    return ~kind.isin("cabin", "sauna", "shed", "barn")


def hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in 0..1 of 0..255 colours."""
    r, g, b = red / 255, green / 255, blue / 255
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(d == 0, 0.0).when(hi == r, F.pmod(F.try_divide(g - b, d), F.lit(6.0))).when(hi == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4) / 6
    return h, F.coalesce(F.try_divide(d, hi), F.lit(0.0)), hi


def excess_green(red: Column, green: Column, blue: Column) -> Column:
    return (2 * green - red - blue) / (red + green + blue + 1e-6)


def gsd_cm(altitude: Column, focal35: Column, width_px: Column) -> Column:
    return altitude * 36 / (F.coalesce(focal35, F.lit(24.0)) * width_px) * 100
