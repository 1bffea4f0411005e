"""Tree, fire and weather scalars as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from boreal.functions.geo import clip

SPECIES, HEALTH = ("pine", "spruce", "birch"), ("healthy", "stressed", "dead")
# Naslund's height curve of each species, fixed values: (a, b).
NASLUND = {0: (1.07, 0.185), 1: (1.20, 0.177), 2: (0.69, 0.197)}


def by_species(species: Column, values) -> Column:
    return F.when(species == 0, float(values[0])).when(species == 1, float(values[1])).otherwise(float(values[2]))


def decode(code: Column, names) -> Column:
    """Name of a code that counts from 0; null beyond."""
    return F.get(F.array(*map(F.lit, names)), code.cast("int"))


def dbh_cm(h: Column, species: Column) -> Column:
    s = F.sqrt(F.greatest(h - 1.3, F.lit(0.01)))
    a, b = (by_species(species, [NASLUND[k][i] for k in range(3)]) for i in (0, 1))
    return a * s / F.greatest(1 - b * s, F.lit(0.05))


def slenderness(h: Column, dbh: Column) -> Column:
    return h / F.greatest(dbh / 100, F.lit(0.02))


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / F.greatest((nir + red).cast("double"), F.lit(1.0))


def stem_volume(h: Column, dbh: Column) -> Column:
    return 0.45 * math.pi * (dbh / 200) * (dbh / 200) * h


def size_factor(h: Column) -> Column:
    return clip((h - 8) / 10, 0.1, 1)


def bands(c: Column, edges, names) -> Column:
    """The name of the band that a value falls into; each edge belongs to the band above it."""
    out = F.lit(names[-1])
    for e, n in reversed(list(zip(edges, names, strict=False))):
        out = F.when(c < e, F.lit(n)).otherwise(out)
    return out


def intensity_class(hfi: Column) -> Column:
    return bands(hfi, (10, 500, 2000, 4000, 10000), (0, 1, 2, 3, 4, 5))


def danger_class(fwi: Column) -> Column:
    return bands(fwi, (5, 10, 20, 30), ("low", "moderate", "high", "very high", "extreme"))


def route_level(danger: Column) -> Column:
    return bands(danger, (25, 50), ("low", "medium", "high"))


def structure_level(score: Column) -> Column:
    return bands(score, (0.35, 0.55), ("low", "medium", "high"))


def failure_probability(gust, h, hd, species, edge, emergent, peat, health, soil_wet: float, frozen: bool) -> Column:
    """Logistic probability that a gust (m/s) fells a tree."""
    logit = (
        -10.5 + 0.30 * (gust - 12) + 0.022 * (clip(hd, 30, 160) - 70)
        + F.when(species == 1, 1.0).when(species == 2, -0.3).otherwise(0.0)
        + 1.2 * edge + 0.5 * emergent + 0.8 * peat
        + F.when(health == 2, 1.8).when(health == 1, 0.7).otherwise(0.0) + 0.03 * (h - 15)
    )
    return 1 / (1 + F.exp(-(logit + (-0.8 if frozen else 0.6 * soil_wet))))


def dryness(ffmc: Column, bui: Column) -> Column:
    return 0.6 * clip((ffmc - 70) / 25, 0, 1) + 0.4 * clip(bui / 80, 0, 1)


def risk_index(hfi, d_human, d_building, d_power, response) -> Column:
    hazard = F.log10(hfi + 1) / 4
    ignition = 0.3 + 0.7 * F.exp(-d_human / 150)
    exposure = F.exp(-d_building / 200) + 0.5 * F.exp(-d_power / 60)
    risk = 100 * clip(hazard, 0, 1) * (0.5 + 0.5 * ignition) * (0.55 + 0.30 * clip(exposure, 0, 1) + 0.15 * clip(F.coalesce(response, F.lit(60.0)) / 45, 0, 1))
    return F.when(hfi <= 0, 0.0).otherwise(risk)


def crown_base(h: Column, species: Column, health: Column) -> Column:
    return F.greatest(h * by_species(species, (0.45, 0.15, 0.35)) * F.when(health == 2, 0.6).otherwise(1.0), F.lit(0.3))


def torching(cbh: Column, health: Column, hfi: Column, grass: Column) -> Column:
    """Probability that a surface fire of hfi kW/m reaches the crown."""
    moisture = F.when(health == 0, 100.0).when(health == 1, 80.0).otherwise(35.0)
    critical = (0.010 * cbh * (460 + 25.9 * moisture)) ** 1.5
    surface = hfi * (0.20 + 0.15 * grass)
    return 1 - F.exp(-((surface / F.greatest(critical, F.lit(1.0))) ** 1.5))
