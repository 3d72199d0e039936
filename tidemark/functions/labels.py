"""Alert, confidence and place labels; JSON-safe numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, OUTSIDE, REGIONS, VALIDATED_REGIONS, Config
from .pixels import finite


def alert_level(area_km2: Column, distance_km: Column) -> Column:
    """Critical, High, Moderate or Low; an unknown distance counts as far away. All comparisons are strict."""
    d = F.when(finite(distance_km), distance_km).otherwise(F.lit(float("inf")))
    return F.when((area_km2 > 5) & (d < 15), "Critical").when((area_km2 > 5) & (d < 30), "High").when((area_km2 > 1) | (d < 10), "Moderate").otherwise("Low")


def severity(area_km2: Column, distance_km: Column, mean_probability: Column | None = None) -> Column:
    """The alert level under its older name; the probability has no part in it."""
    return alert_level(area_km2, distance_km)


def detection_confidence(mean_probability: Column, cfg: Config = DEFAULT) -> Column:
    p = F.when(finite(mean_probability), mean_probability).otherwise(F.lit(float("-inf")))
    return F.when(p >= cfg.confidence_high, "High").when(p >= cfg.confidence_medium, "Medium").otherwise("Low")


def rank(label: Column, order: tuple[str, ...]) -> Column:
    """Place in ``order`` from 0; -1 for an unknown label."""
    return F.array_position(F.array(*map(F.lit, order)), label) - 1


def region_label(lon: Column, lat: Column) -> Column:
    """First area of REGIONS that holds the point, edges included."""
    out = F.lit(OUTSIDE)
    for name, west, east, south, north in reversed(REGIONS):
        out = F.when(lon.between(west, east) & lat.between(south, north), name).otherwise(out)
    return out


def inside_validated(label: Column, lon: Column, lat: Column) -> Column:
    out = F.lit(False)
    for name, west, east, south, north in VALIDATED_REGIONS:
        out = out | ((label == name) & lon.between(west, east) & lat.between(south, north))
    return F.coalesce(out, F.lit(False))


def json_number(v: Column) -> Column:
    return F.when(finite(v), v)


def operating_status(cfg: Config = DEFAULT) -> Column:
    return F.format_string("screener %.2f, mask %.2f, opening %d, minimum %d px", F.lit(cfg.screener_threshold), F.lit(cfg.mask), F.lit(cfg.opening_radius), F.lit(cfg.min_blob))
